"""Aggregations, statistics, windows, sorts and chart data (E, F, G, L).

Shuffle shape: per-case values come from ``groupBy(case)`` (partial
aggregation), per-variant values from a second ``groupBy(variant)``;
ranks and running sums over whole result tables use
``plans.ranking.global_rank_sum`` (range-partitioned), never a
single-partition window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import exact_mean_std, r6, seconds_between, us_between
from ..log import EventLog
from ..plans.cases import (SIGNATURE, case_signatures, case_variants, kept_once, variant_counts, variant_table,
                           with_variant_text)
from ..plans.ranking import global_rank_sum


# ------------------------------------------------------------- variants

def variant_stats(log: EventLog) -> DataFrame:
    """Cases per variant."""
    return variant_counts(log)


def variant_pareto(log: EventLog) -> DataFrame:
    """E1 plus log2 frequency, percentage and cumulative percentage."""
    return _pareto(log).drop("n_total")


def _pareto(log: EventLog) -> DataFrame:
    """E1 plus log2 frequency, percentage and cumulative percentage.

    Rank order: count desc, variant asc. Percentages are relative to the
    number of cases; the cumulative value is computed from the exact
    running count, then divided.
    """
    v = variant_counts(log)
    ranked = global_rank_sum(v, [F.col("n_cases").desc(), F.col("variant").asc()],
                             {"_cum": F.col("n_cases")}, rank_name="rank0", totals=True)
    total = F.col("_cum_total")
    return ranked.select(
        "variant", "n_cases", "rank0",
        r6(F.log2(F.col("n_cases").cast("double"))).alias("frequency"),
        r6(F.col("n_cases") * 100.0 / total).alias("percentage"),
        r6(F.col("_cum") * 100.0 / total).alias("cum_percentage"), "n_total")


def frequency_ranks(log: EventLog) -> DataFrame:
    """Ranks by frequency without texts: per level of equal ``n_cases`` its variants, their ranks and totals.

    ``first``, ``last``: 0-based ranks of the level; ``before``: cases of
    more frequent variants; ``n_variants``, ``n_total``: of the whole log.
    """
    levels = variant_table(log, case_signatures(log)).groupBy("n_cases").agg(F.count(F.lit(1)).alias("k"))
    down = Window.orderBy(F.col("n_cases").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy(F.col("n_cases").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cases = F.col("k") * F.col("n_cases")
    return levels.select("n_cases", (F.sum("k").over(down) - F.col("k")).alias("first"),
                         (F.sum("k").over(down) - 1).alias("last"), (F.sum(cases).over(down) - cases).alias("before"),
                         F.sum("k").over(whole).alias("n_variants"), F.sum(cases).over(whole).alias("n_total"))


def pareto_check(log: EventLog, share: float = 0.2, threshold: float = 80.0) -> DataFrame:
    """Cumulative percentage at 0-based rank floor(share * n_variants) > threshold."""
    at = F.floor(F.col("n_variants") * F.lit(share)).cast("long")
    run = F.col("before") + (at - F.col("first") + 1) * F.col("n_cases")
    pct = r6(run * 100.0 / F.col("n_total"))
    return (frequency_ranks(log).where((F.col("first") <= at) & (at <= F.col("last")))
            .select(F.col("n_variants").cast("long").alias("n_variants"), at.alias("pareto_rank"),
                    pct.alias("cum_percentage"), (pct > F.lit(threshold)).alias("is_pareto")))


# ------------------------------------------------------------- case / variant profiles

def case_profile(log: EventLog) -> DataFrame:
    """Per case: events, activity list (', '), distinct resources, duration (s)."""
    acts = case_variants(log, sep=", ", name="activity_list").drop("activity_list_len")
    return _case_figures(log).join(acts, log.case).select(
        log.case, "n_events", "activity_list", "n_resources", "duration_s")


def _case_figures(log: EventLog) -> DataFrame:
    res = (F.count_distinct("resource") if "resource" in log.df.columns
           else F.lit(None).cast("long"))       # logs without a resource column
    return log.df.groupBy(log.case).agg(
        F.count(F.lit(1)).alias("n_events"), res.alias("n_resources"),
        seconds_between(F.min("ts"), F.max("ts")).alias("duration_s"),
        us_between(F.min("ts"), F.max("ts")).alias("duration_us"))


def variant_profile(log: EventLog) -> DataFrame:
    """Per activity list: mean events, cases, mean resources, duration mean/min/std, sum."""
    p = _case_figures(log).join(case_signatures(log), log.case)
    mean, std = exact_mean_std(F.col("duration_us"))
    g = kept_once(p.groupBy(*SIGNATURE).agg(
        F.avg("n_events").alias("avg_events"),
        F.count(F.lit(1)).alias("cases"),
        F.avg("n_resources").alias("avg_resource"),
        mean.alias("_avg"), std.alias("_std"),
        F.min("duration_us").alias("_min"),
        F.sum("duration_us").alias("_sum"), F.min(log.case).alias("_rep")))
    # exact sums and the same final double operations in every engine: no rounding
    # (rounding a mean of integer microseconds would meet .5 ties)
    return with_variant_text(log, g, ", ", "activity_list").select(
        "activity_list", "avg_events", "cases", "avg_resource",
        F.col("_avg").alias("avg_duration"),
        (F.col("_min") / 1e6).alias("min_duration"),
        F.col("_std").alias("std_duration"),
        (F.col("_sum") / 1e6).alias("sum_duration"))


def attribute_values(log: EventLog, attr: str) -> DataFrame:
    """Value -> number of events for one attribute."""
    return log.df.groupBy(F.col(attr).alias("value")).agg(F.count(F.lit(1)).alias("n_events"))


def activity_counts(log: EventLog) -> DataFrame:
    """Events per activity."""
    return attribute_values(log, log.activity).withColumnRenamed("value", "activity")


def topic_dimensions(df: DataFrame, topic: str, sums: Sequence[str], ts: str = "ts",
                     seconds_of_day: bool = False) -> DataFrame:
    """Per topic: occurrences, sum of each listed column, duration max-min (s).

    ``seconds_of_day``: only the part of the duration beyond whole days.
    """
    us = us_between(F.min(ts), F.max(ts))
    duration = F.pmod(us, F.lit(86_400_000_000)) / F.lit(1_000_000.0) if seconds_of_day else us / F.lit(1_000_000.0)
    return df.groupBy(F.col(topic).alias("topic")).agg(
        F.count(F.lit(1)).alias("occurrences"),
        *[_sum_keep_type(df, c).alias(f"sum_{c}") for c in sums],
        duration.alias("duration_s"))


def _sum_keep_type(df: DataFrame, c: str) -> Column:
    t = dict(df.dtypes)[c]
    if t.startswith("decimal"):
        return F.sum(c).cast("double")
    if t in ("double", "float"):
        return r6(F.sum(c))
    return F.sum(c).cast("long")


def topic_counts(df: DataFrame, topic: str) -> DataFrame:
    """Rows per topic."""
    return df.groupBy(F.col(topic).alias("topic")).agg(F.count(F.lit(1)).alias("n_rows"))


def group_totals(df: DataFrame, key: str) -> DataFrame:
    """Sum of every numeric column per key."""
    nums = [c for c, t in df.dtypes if c != key and (t in ("int", "bigint", "double", "float", "smallint")
                                                      or t.startswith("decimal"))]
    return df.groupBy(key).agg(*[_sum_keep_type(df, c).alias(f"sum_{c}") for c in nums])


def distinct_per_column(df: DataFrame, approx: bool = False) -> DataFrame:
    """Number of distinct non-NULL values per column, one pass over the table."""
    fn = F.approx_count_distinct if approx else F.count_distinct
    row = df.agg(*[fn(F.col(c)).alias(c) for c in df.columns])
    return row.unpivot([], df.columns, "column", "n_distinct")


def nulls_per_column(df: DataFrame) -> DataFrame:
    """Number of NULL values per column, one pass over the table."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return row.unpivot([], df.columns, "column", "n_null")


def value_counts_all(df: DataFrame, cols: Sequence[str], max_distinct: int | None = None) -> DataFrame:
    """Value counts of each listed column; ``max_distinct`` (off) leaves out columns with that many values."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], list(cols), "column", "value")
    vc = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    if max_distinct is None:
        return vc
    per_col = vc.groupBy("column").agg(F.count(F.lit(1)).alias("_nd")).where(F.col("_nd") < max_distinct)
    # one row per listed column: a bounded broadcast side
    return vc.join(F.broadcast(per_col.select("column")), "column")


def crosstab_case_activity(log: EventLog, values: Sequence[str] | None = None) -> DataFrame:
    """Case x activity count matrix (0 where absent)."""
    p = log.df.groupBy(log.case).pivot(log.activity, list(values) if values else None).count()
    return p.fillna(0, subset=[c for c in p.columns if c != log.case])


def pivot_start_end(log: EventLog) -> DataFrame:
    """First and last timestamp per case."""
    return log.df.groupBy(log.case).agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))


def events_per_case_by(log: EventLog, category: str) -> DataFrame:
    """Events, cases and events per case (2 decimals) per category."""
    return log.df.groupBy(category).agg(
        F.count(F.lit(1)).alias("n_events"), F.count_distinct(log.case).alias("n_cases"),
    ).select(category, "n_events", "n_cases",
             F.round(F.col("n_events") / F.col("n_cases"), 2).alias("events_per_case"))


def filter_effect(log: EventLog, area: str, dup_id: str, d1, d2) -> DataFrame:
    """Cases before / after each cleaning step and the share lost.

    Steps in order: drop cases with an empty ``area``; drop every row of a
    duplicated ``dup_id``; keep cases contained in [d1, d2] (on the rows
    left). One conditional aggregate per case, then one over cases.
    """
    once = log.df.groupBy(dup_id).agg(F.count(F.lit(1)).alias("_dn"))
    # a NULL id is no duplicate of anything: it stays
    ev = log.df.join(once.where(F.col(dup_id).isNotNull()), dup_id, "left")
    ok = F.coalesce("_dn", F.lit(1)) == 1
    per = ev.groupBy(log.case).agg(
        F.bool_and(F.nullif(F.col(area), F.lit("")).isNotNull()).alias("ok_area"),
        F.count_if(ok).alias("n_left"),
        F.min(F.when(ok, F.col("ts"))).alias("t0"), F.max(F.when(ok, F.col("ts"))).alias("t1"))
    s1 = F.col("ok_area")
    s2 = s1 & (F.col("n_left") > 0)
    s3 = s2 & (F.col("t0") >= F.lit(d1).cast("timestamp_ntz")) & (F.col("t1") <= F.lit(d2).cast("timestamp_ntz"))
    tot = per.agg(F.count(F.lit(1)).alias("c0"), F.count_if(s1).alias("c1"),
                  F.count_if(s2).alias("c2"), F.count_if(s3).alias("c3"))
    steps = F.array(
        F.struct(F.lit(1).alias("step"), F.lit("empty_area").alias("filter"), F.col("c0").alias("before"), F.col("c1").alias("after")),
        F.struct(F.lit(2).alias("step"), F.lit("duplicate_ids").alias("filter"), F.col("c1").alias("before"), F.col("c2").alias("after")),
        F.struct(F.lit(3).alias("step"), F.lit("date_contained").alias("filter"), F.col("c2").alias("before"), F.col("c3").alias("after")))
    out = tot.select(F.inline(steps))
    return out.select("step", "filter", "before", "after",
                      r6((1 - F.try_divide(F.col("after").cast("double"), F.col("before"))) * 100).alias("lost_pct"))


# ------------------------------------------------------------- windows (F)

def cumulative_percentage(counts: DataFrame, label: str, n: str) -> DataFrame:
    """percentage and running percentage in (n desc, label asc) order."""
    r = global_rank_sum(counts, [F.col(n).desc(), F.col(label).asc()], {"_cum": F.col(n)}, "rank0",
                        totals=True)
    total = F.col("_cum_total")
    return r.select(label, n, "rank0", r6(F.col(n) * 100.0 / total).alias("percentage"),
                    r6(F.col("_cum") * 100.0 / total).alias("cum_percentage"))


def rank_index(df: DataFrame, order: Sequence[Column], name: str = "rank0") -> DataFrame:
    """F2 / G1: dense 0-based index after a total sort (distributed)."""
    return global_rank_sum(df, order, {}, name)


def zscore_columns(df: DataFrame, key: str) -> DataFrame:
    """(x - mean) / sample std for every numeric column; the moments are one row joined back."""
    nums = [c for c, t in df.dtypes if c != key and t in ("int", "bigint", "double", "float")]
    df = kept_once(df)      # read twice, computed once
    moments = df.agg(*[f(c).alias(f"_{n}_{c}") for c in nums for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    one = F.broadcast(moments.withColumn("_one", F.lit(1)))     # a single row
    return df.withColumn("_one", F.lit(1)).join(one, "_one").select(key, *[
        r6(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}"))).alias(f"z_{c}") for c in nums])


def histogram_bins(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """L1: equal-width bins over [min, max], last bin closed; empty bins included."""
    edge = df.agg(F.min(col).cast("double"), F.max(col).cast("double")).first()
    lo, hi = F.lit(edge[0]).cast("double"), F.lit(edge[1]).cast("double")
    width = (hi - lo) / F.lit(bins)
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col(col) - lo) / width), F.lit(bins - 1))).cast("int")
    counts = df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (F.broadcast(frame).join(counts, "bin", "left")
            .select("bin", r6(lo + F.col("bin") * width).alias("lo"),
                    r6(lo + (F.col("bin") + 1) * width).alias("hi"),
                    F.coalesce(F.col("n"), F.lit(0)).alias("n")))


def empirical_cdf(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """PDF and CDF over the histogram bins (bins are few: plain window)."""
    h = histogram_bins(df, col, bins)
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return h.select("bin", "hi", "n", r6(F.col("n") / total).alias("pdf"),
                    r6(F.sum("n").over(w) / total).alias("cdf"))


# ------------------------------------------------------------- top-k (G)

def top_n_frame(df: DataFrame, order: Sequence[Column], n: int = 100) -> DataFrame:
    """First ``n`` rows in a total order (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


# ------------------------------------------------------------- chart data (L)

def pie_others(df: DataFrame, label: str, value: str, share: float = 0.05) -> DataFrame:
    """L2: labels under ``share`` of the total folded into one 'others' row (always present)."""
    total = df.select(F.sum(value)).scalar()
    small = F.col(value) < F.lit(share) * total
    keep = df.where(~small).select(F.col(label).cast("string").alias("label"), F.col(value).alias("value"))
    others = df.agg(F.lit("others").alias("label"),
                    F.coalesce(F.sum(F.when(small, F.col(value))), F.lit(0)).alias("value"))
    return keep.unionByName(others)


def category_ratio(log: EventLog, category: str) -> DataFrame:
    """Cases per category and their share of all cases."""
    per = log.df.groupBy(log.case).agg(F.min(category).alias("category"))
    c = per.groupBy("category").agg(F.count(F.lit(1)).alias("n_cases"))
    total = c.select(F.sum("n_cases")).scalar()
    return c.select("category", "n_cases", r6(F.col("n_cases") * 100.0 / total).alias("percentage"))
