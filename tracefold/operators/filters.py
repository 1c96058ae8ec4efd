"""Case and event filters (inventory group C, plus D2/D3).

Every case filter is "find the qualifying case ids, keep their events":
a partially aggregated ``groupBy(case)`` (or the variant table) followed by
a ``left_semi`` / ``left_anti`` join, which AQE can split when one case is
huge. Event filters are plain ``filter`` calls that Catalyst pushes into
the parquet scan when they touch source columns.

All filters take and return an ``EventLog`` so they chain with
``log.transform(...)``. ``None`` means "parameter not set"; 0 is a value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..log import EventLog, micros
from ..plans.cases import (SIGNATURE, case_signatures, case_table, first_of_level, keep_cases, kept_once, level_at,
                           trace_signatures, variant_activities, variant_table)
from ..plans.sequence import running, sequenced


def _as_list(x) -> list:
    """A single value or a list (the reference loses single strings)."""
    if x is None:
        return []
    if isinstance(x, (list, tuple, set)):
        return list(x)
    return [x]


def _ts(v) -> Column:
    return F.lit(v).cast("timestamp_ntz") if isinstance(v, str) else F.lit(v)


# ------------------------------------------------------------------ time

def time_contained(log: EventLog, d1, d2) -> EventLog:
    """Cases whose first and last event lie in [d1, d2]."""
    c = case_table(log).where((F.col("case_start") >= _ts(d1)) & (F.col("case_end") <= _ts(d2)))
    return keep_cases(log, c)


def time_intersecting(log: EventLog, d1, d2) -> EventLog:
    """Cases whose time span overlaps [d1, d2]."""
    c = case_table(log).where((F.col("case_start") <= _ts(d2)) & (F.col("case_end") >= _ts(d1)))
    return keep_cases(log, c)


def time_events(log: EventLog, d1, d2) -> EventLog:
    """Events with d1 <= ts <= d2 (pushed to the scan)."""
    return log.with_df(log.df.where(F.col("ts").between(_ts(d1), _ts(d2))))


def case_performance(log: EventLog, min_s: float, max_s: float) -> EventLog:
    """C4: cases whose duration (last - first ts) is in [min_s, max_s] seconds."""
    dur = micros(F.col("case_end")) - micros(F.col("case_start"))
    c = case_table(log).where(dur.between(F.lit(int(min_s * 1_000_000)), F.lit(int(max_s * 1_000_000))))
    return keep_cases(log, c)


# ------------------------------------------------------------------ endpoints

def start_activity(log: EventLog, acts) -> EventLog:
    """Cases starting with one of ``acts``."""
    return keep_cases(log, case_table(log).where(F.col("first_activity").isin(_as_list(acts))))


def end_activity(log: EventLog, acts) -> EventLog:
    """Cases ending with one of ``acts``."""
    return keep_cases(log, case_table(log).where(F.col("last_activity").isin(_as_list(acts))))


def decreasing_factor_values(counts: DataFrame, value: str, n: str, factor: float) -> DataFrame:
    """Rank by count desc, name asc; keep rank 1, then while n_i >= factor * n_(i-1).

    ``counts`` is a per-activity table (bounded by the alphabet), so one
    ordered window over it is fine.
    """
    w = Window.orderBy(F.col(n).desc(), F.col(value).asc())
    fail = F.when(F.col(n) < F.lit(factor) * F.lag(n).over(w), 1).otherwise(0)
    flagged = counts.select(value, n, fail.alias("_fail"))
    w2 = Window.orderBy(F.col(n).desc(), F.col(value).asc()).rowsBetween(Window.unboundedPreceding, 0)
    return flagged.select(value, n, F.sum("_fail").over(w2).alias("_fails")).where("_fails = 0").drop("_fails")


def start_activity_counts(log: EventLog) -> DataFrame:
    """E8 (start): (activity, n_cases) for the first activity of every case."""
    return (case_table(log).groupBy(F.col("first_activity").alias("activity"))
            .agg(F.count(F.lit(1)).alias("n_cases")))


def end_activity_counts(log: EventLog) -> DataFrame:
    """E8 (end): (activity, n_cases) for the last activity of every case."""
    return (case_table(log).groupBy(F.col("last_activity").alias("activity"))
            .agg(F.count(F.lit(1)).alias("n_cases")))


def start_frequent(log: EventLog, factor: float = 0.6) -> EventLog:
    """Keep cases whose start activity survives the decreasing factor S4."""
    keep = decreasing_factor_values(start_activity_counts(log), "activity", "n_cases", factor)
    ct = case_table(log).join(keep.select(F.col("activity").alias("first_activity")),
                              "first_activity", "left_semi")
    return keep_cases(log, ct)


def endpoint_keywords(log: EventLog, start_words: Sequence[str], end_words: Sequence[str]) -> EventLog:
    """Start / end activity lists from keywords in the activity names.

    Matching is case-insensitive for both lists (the reference lower-cases
    only the end side). The activity alphabet is small; it is joined, not
    collected.
    """
    acts = log.df.select(F.col(log.activity).alias("a")).distinct()
    def has_any(words):
        cond = F.lit(False)
        for w in words:
            cond = cond | F.lower(F.col("a")).contains(w.lower())
        return cond
    starts = acts.where(has_any(start_words)).select(F.col("a").alias("first_activity"))
    ends = acts.where(has_any(end_words)).select(F.col("a").alias("last_activity"))
    ct = (case_table(log).join(starts, "first_activity", "left_semi")
          .join(ends, "last_activity", "left_semi"))
    return keep_cases(log, ct)


# ------------------------------------------------------------------ variants

def variants_in(log: EventLog, variants, positive: bool = True) -> EventLog:
    """Keep (positive) or drop the cases of the given variants.

    A variant is its text (separators in names escaped) or a list of activity names.
    """
    traces = [variant_activities(v) if isinstance(v, str) else list(v) for v in _as_list(variants)]
    wanted = trace_signatures(log.spark, traces)
    return keep_cases(log, case_signatures(log).join(wanted, SIGNATURE, "left_semi"), negate=not positive)


def _variants(log: EventLog) -> tuple[DataFrame, DataFrame]:
    """Signatures of the cases and the variant table, both written once."""
    signatures = kept_once(case_signatures(log))
    return signatures, kept_once(variant_table(log, signatures))


def _keep_variants(log: EventLog, signatures: DataFrame, kept: DataFrame) -> EventLog:
    """Events of the cases whose variant is in ``kept``."""
    return keep_cases(log, signatures.join(kept.select(*SIGNATURE), SIGNATURE, "left_semi"))


def _most_frequent(log: EventLog, variants: DataFrame, level, many: int) -> DataFrame:
    """Variants above a level and ``many`` of it; only a level that is cut needs texts, to order it by."""
    above = variants.where(F.col("n_cases") > level["n_cases"])
    if many <= 0:
        return above
    return above.select(*SIGNATURE).unionByName(
        first_of_level(log, variants, level["n_cases"], 0, many).select(*SIGNATURE))


def variants_percentage(log: EventLog, pct: float) -> EventLog:
    """Most frequent variants while the cumulative share <= pct (rank 1 always)."""
    signatures, variants = _variants(log)
    limit = pct * (signatures.count())
    level = level_at(variants, F.col("k") * F.col("n_cases"), limit)
    if level is None:
        return _keep_variants(log, signatures, variants)
    n = level["n_cases"]
    before = level["run"] - level["k"] * n
    many = max(int((limit - before) // n), 0 if before else 1)
    return _keep_variants(log, signatures, _most_frequent(log, variants, level, many))


def variants_top_k(log: EventLog, k: int) -> EventLog:
    """C11: cases of the k most frequent variants."""
    signatures, variants = _variants(log)
    level = level_at(variants, F.col("k"), k)
    if level is None:
        return _keep_variants(log, signatures, variants)
    return _keep_variants(log, signatures, _most_frequent(log, variants, level, k - (level["run"] - level["k"])))


def variants_coverage(log: EventLog, min_share: float) -> EventLog:
    """Variants covering at least ``min_share`` of the cases."""
    signatures, variants = _variants(log)
    return _keep_variants(log, signatures, variants.where(F.col("n_cases") >= F.lit(min_share * signatures.count())))


def variant_at(log: EventLog, row: int = 0, match: str = "exact") -> EventLog:
    """Cases matching the variant at rank ``row``.

    ``exact``: the case's variant equals it. ``substring``: the reference's
    behaviour, a case passes when any of its activity names occurs as a
    substring of that variant's text.
    """
    signatures, variants = _variants(log)
    level = level_at(variants, F.col("k"), row)
    if level is None:
        return log.with_df(log.df.where(F.lit(False)))
    here = first_of_level(log, variants, level["n_cases"], row - (level["run"] - level["k"]), 1)
    if match == "exact":
        return _keep_variants(log, signatures, here)
    ids = log.df.where(F.contains(here.select("variant").scalar(), F.col(log.activity))).select(log.case).distinct()
    return keep_cases(log, ids)


# ------------------------------------------------------------------ attributes

def attr_cases(log: EventLog, attr: str, values, positive: bool = True) -> EventLog:
    """Whole cases where some event has ``attr`` in ``values`` (or none does)."""
    ids = (log.df.where(F.col(attr).isin(_as_list(values))).select(log.case).distinct())
    return keep_cases(log, ids, negate=not positive)


def attr_events(log: EventLog, attr: str, values, positive: bool = True) -> EventLog:
    """C14: only the events with ``attr`` in ``values`` (or not in)."""
    cond = F.col(attr).isin(_as_list(values))
    return log.with_df(log.df.where(cond if positive else ~F.coalesce(cond, F.lit(False))))


def numeric_cases(log: EventLog, attr: str, lo: float, hi: float) -> EventLog:
    """Whole cases where some event has lo <= attr <= hi."""
    ids = log.df.where(F.col(attr).cast("double").between(lo, hi)).select(log.case).distinct()
    return keep_cases(log, ids)


def numeric_events(log: EventLog, attr: str, lo: float, hi: float) -> EventLog:
    """Events with lo <= attr <= hi."""
    return log.with_df(log.df.where(F.col(attr).cast("double").between(lo, hi)))


# ------------------------------------------------------------------ shape

def between(log: EventLog, act1: str, act2: str) -> EventLog:
    """Sub-cases from ``act1`` to the next ``act2``; id ``case_id#k``.

    Each case is cut after every ``act2``; the piece keeps the events from
    its first ``act1`` up to and including the ``act2``. When act1 == act2
    every pair of successive occurrences is a piece, and an inner
    occurrence belongs to two pieces.
    """
    a = F.col(log.activity)
    is2 = (a == F.lit(act2)).cast("long")
    r = running(log, None, [log.case], {"_c2": ("sum", is2), "_pos": ("sum", F.lit(1))})
    r = r.withColumn("_pos", F.col("_pos") - 1)
    if act1 == act2:
        tot = log.df.groupBy(log.case).agg(F.sum(is2).alias("_tot"))
        r = r.join(tot, log.case)
        c = F.col("_c2")
        ks = F.when(a == F.lit(act2),
                    F.array_compact(F.array(F.when(c >= 2, c - 1), F.when(c < F.col("_tot"), c))))
        ks = ks.otherwise(F.when((c >= 1) & (c < F.col("_tot")), F.array(c)).otherwise(F.array()))
        out = r.withColumn("_k", F.explode(ks))
    else:
        r = r.withColumn("_k", F.col("_c2") - is2)
        piece = (r.groupBy(log.case, "_k")
                 .agg(F.min(F.when(a == F.lit(act1), F.col("_pos"))).alias("_p1"),
                      F.max(F.when(a == F.lit(act2), F.col("_pos"))).alias("_p2"))
                 .where(F.col("_p1").isNotNull() & F.col("_p2").isNotNull()))
        out = (r.join(piece, [log.case, "_k"])
               .where((F.col("_pos") >= F.col("_p1")) & (F.col("_pos") <= F.col("_p2"))))
    cols = [F.concat(F.col(log.case), F.lit("#"), F.col("_k").cast("string")).alias(log.case)]
    cols += [F.col(c) for c in log.df.columns if c != log.case]
    return log.with_cases(out.select(*cols))


def case_size(log: EventLog, lo: int, hi: int) -> EventLog:
    """Cases with lo <= number of events <= hi."""
    return keep_cases(log, case_table(log).where(F.col("case_size").between(lo, hi)))


def rework(log: EventLog, activity: str, min_count: int) -> EventLog:
    """Cases where ``activity`` occurs at least ``min_count`` times."""
    ids = (log.df.groupBy(log.case)
           .agg(F.count_if(F.col(log.activity) == F.lit(activity)).alias("_n"))
           .where(F.col("_n") >= min_count))
    return keep_cases(log, ids)


def paths_performance(log: EventLog, a: str, b: str, lo_s: float, hi_s: float) -> EventLog:
    """Cases with a directly-follows pair (a, b) whose gap is in [lo_s, hi_s] s."""
    s = sequenced(log, carry=("activity", "ts"))
    gap = micros(F.col("next_ts")) - micros(F.col("ts"))
    ids = (s.where((F.col("activity") == a) & (F.col("next_activity") == b)
                   & gap.between(F.lit(int(lo_s * 1e6)), F.lit(int(hi_s * 1e6))))
           .select(log.case).distinct())
    return keep_cases(log, ids)


def case_predicate(log: EventLog, predicate: Callable[[DataFrame], Column]) -> EventLog:
    """User predicate over the case table (``case_size``, ``case_start``, ...)."""
    ct = case_table(log)
    return keep_cases(log, ct.where(predicate(ct)))


def event_predicate(log: EventLog, predicate: Column) -> EventLog:
    """User predicate over events, applied to every case."""
    return log.with_df(log.df.where(predicate))


# ------------------------------------------------------------------ rule flags

def case_flags(log: EventLog, x: str, y: str, extra: Sequence[str] = (),
               category: str | None = None) -> DataFrame:
    """One aggregate per case carrying every flag C24-C27 need.

    ``first_xy``: which of x / y occurs first (NULL if neither);
    ``bal``: count(x) - count(y); ``has_<a>`` for x, y and ``extra``.
    """
    a = F.col(log.activity)
    o = F.struct(*[F.col(c) for c in log.order_cols])
    xy = a.isin(x, y)
    aggs = [F.min_by(F.when(xy, a), F.when(xy, o)).alias("first_xy"),
            (F.count_if(a == x) - F.count_if(a == y)).alias("bal")]
    if category is not None:
        aggs.append(F.min(category).alias("_cat"))
    for act in dict.fromkeys([x, y, *extra]):
        aggs.append(F.bool_or(a == act).alias(f"has_{act}"))
    return log.df.groupBy(log.case).agg(*aggs)


def first_of(log: EventLog, x: str, y: str, want_first: str) -> EventLog:
    """Cases where, of x and y, ``want_first`` occurs first."""
    return keep_cases(log, case_flags(log, x, y).where(F.col("first_xy") == want_first))


def balanced(log: EventLog, x: str, y: str) -> EventLog:
    """Cases where x and y occur equally often."""
    return keep_cases(log, case_flags(log, x, y).where(F.col("bal") == 0))


def has_activity(log: EventLog, act: str) -> EventLog:
    """Cases containing ``act``."""
    ids = log.df.groupBy(log.case).agg(F.bool_or(F.col(log.activity) == act).alias("_h")).where("_h")
    return keep_cases(log, ids)


# The four purchase-order item categories of the reference.
CATEGORIES = ["2-way match", "Consignment", "3-way match, invoice after GR",
              "3-way match, invoice before GR"]


def category_compliant(log: EventLog, category: str, invoice: str, goods: str,
                       clear: str) -> EventLog:
    """Per-category rule set, one independent predicate per category.

    3-way after / before: goods and invoice first in that order, balanced,
    all three present; 2-way: invoice and clear present; consignment:
    goods present.
    """
    f = case_flags(log, invoice, goods, extra=[clear], category=category)
    cat = F.col("_cat")
    first = F.col("first_xy")
    has_i, has_g, has_c = F.col(f"has_{invoice}"), F.col(f"has_{goods}"), F.col(f"has_{clear}")
    three = (F.col("bal") == 0) & has_i & has_g & has_c
    rule = (F.when(cat == CATEGORIES[2], three & (first == goods))
            .when(cat == CATEGORIES[3], three & (first == invoice))
            .when(cat == CATEGORIES[0], has_i & has_c)
            .when(cat == CATEGORIES[1], has_g)
            .otherwise(F.lit(False)))
    return keep_cases(log, f.where(rule))


# Whether the invoice is verified against the receipt, and
# whether goods are received, as each category requires.
CATEGORY_FLAGS = {"3-way match, invoice after GR": (True, True), "3-way match, invoice before GR": (False, True),
                  "2-way match": (False, False), "Consignment": (False, True)}


def category_flags(log: EventLog, category: str, verified: str, received: str) -> EventLog:
    """C27 (boolean attributes): events whose two flags are those their category requires; one row filter."""
    ok = F.lit(False)
    for name, (v, g) in CATEGORY_FLAGS.items():
        ok = ok | ((F.col(category) == name) & (F.col(verified) == v) & (F.col(received) == g))
    return log.with_df(log.df.where(ok))


# ------------------------------------------------------------------ cleaning

def empty_attr(log: EventLog, attr: str) -> EventLog:
    """Drop cases that have an event with an empty or NULL ``attr``."""
    bad = log.df.where(F.nullif(F.col(attr), F.lit("")).isNull()).select(log.case).distinct()
    return keep_cases(log, bad, negate=True)


def duplicates_none(log: EventLog, id_col: str) -> EventLog:
    """Remove every row whose ``id_col`` value occurs more than once; rows without a value stay."""
    more = log.df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return log.with_df(log.df.join(more.select(id_col), id_col, "left_anti"))


def single_case(log: EventLog, case_id: str) -> EventLog:
    """Events of one case."""
    return log.with_df(log.df.where(F.col(log.case) == case_id))


def frequent_activities(log: EventLog, min_share: float = 0.05) -> DataFrame:
    """Activities with more than ``min_share`` of all events."""
    counts = log.df.groupBy(F.col(log.activity).alias("activity")).agg(F.count(F.lit(1)).alias("n_events"))
    total = counts.select(F.sum("n_events")).scalar()
    share = F.col("n_events") / total
    return counts.where(share > min_share).select("activity", "n_events", F.round(share, 6).alias("share"))


def semi_case_ids(log: EventLog, ids: DataFrame) -> EventLog:
    """Events of the cases listed in ``ids`` (an isin over a table)."""
    return keep_cases(log, ids)
