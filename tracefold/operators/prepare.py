"""Reading a table as a log and preparing it (inventory group B, joins D1, D5).

Case-order values come from ``plans.sequence.sequenced`` (chunked case
windows); per-case attributes from partially aggregated ``groupBy``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import r6, seconds_between, us_between
from ..log import END_SYMBOL, START_SYMBOL, XES_NAMES, EventLog
from ..plans.cases import case_arrays, case_table
from ..plans.ranking import global_rank_sum
from ..plans.sequence import sequenced


def rename(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """B1: rename source columns to canonical names (XES names map to internal ones)."""
    mapping = dict(mapping or {})
    out = df.withColumnsRenamed(mapping)
    xes = {k: v for k, v in XES_NAMES.items() if k in out.columns}
    return out.withColumnsRenamed(xes) if xes else out


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """B2: drop unused columns (Catalyst then prunes them from the scan)."""
    return df.drop(*cols)


def sorted_log(log: EventLog) -> DataFrame:
    """Events in case order (output ordering only; operators order inside windows)."""
    return log.df.orderBy(log.case, *log.order_cols)


def event_index(log: EventLog) -> DataFrame:
    """``index`` (global position by time) and ``index_in_trace`` (position in case)."""
    s = sequenced(log, carry=())
    s = s.withColumnRenamed("pos", "index_in_trace").drop("case_size")
    return global_rank_sum(s, [F.col(c).asc() for c in log.order_cols] + [F.col(log.case).asc()],
                           {}, "index")


def to_cases(log: EventLog, cols: Sequence[str] = ("activity", "ts")) -> DataFrame:
    """One row per case with its events as an ordered array of structs."""
    return case_arrays(log, list(cols))


def from_cases(cases: DataFrame, case: str = "case_id") -> DataFrame:
    """Case rows back to one row per event, with the position in the case."""
    return cases.select(case, F.posexplode("events").alias("pos", "_e")).select(
        case, F.col("pos").cast("long").alias("pos"), "_e.*")


def case_attributes(log: EventLog, cols: Sequence[str]) -> DataFrame:
    """Case-level attributes lifted from event columns (min for determinism)."""
    return log.df.groupBy(log.case).agg(*[F.min(c).alias(c) for c in cols])


def relative_time(log: EventLog) -> DataFrame:
    """Each event with its case start / end, seconds and whole days since the start."""
    s = sequenced(log, carry=("ts",))
    rel = us_between(F.col("first_ts"), F.col("ts"))
    return s.select(log.case, log.activity, *log.order_cols,
                    F.col("first_ts").alias("case_start"), F.col("last_ts").alias("case_end"),
                    (rel / 1e6).alias("rel_s"), F.floor(rel / F.lit(86_400_000_000)).alias("rel_days"))


def classifier(log: EventLog, cols: Sequence[str], sep: str = "+") -> DataFrame:
    """Composite activity key from several attributes."""
    return log.df.withColumn("classifier", F.concat_ws(sep, *[F.col(c) for c in cols]))


def artificial_ends(log: EventLog) -> DataFrame:
    """The events plus a start (▶) and an end (■) event per case."""
    s = sequenced(log, carry=("ts",))
    base = s.select(log.case, log.activity, "ts", F.col("pos").cast("long").alias("pos"))
    start = s.where(F.col("pos") == 0).select(
        log.case, F.lit(START_SYMBOL).alias(log.activity), F.col("first_ts").alias("ts"),
        F.lit(-1).cast("long").alias("pos"))
    end = s.where(F.col("pos") == F.col("case_size") - 1).select(
        log.case, F.lit(END_SYMBOL).alias(log.activity), F.col("last_ts").alias("ts"),
        F.col("case_size").cast("long").alias("pos"))
    return base.unionByName(start).unionByName(end)


def number_in(label: Column) -> Column:
    """The first run of digits of a text as a number."""
    return F.regexp_extract(label, r"(\d+)", 1).try_cast("long")


def case_number(df: DataFrame, col: str = "case_id") -> DataFrame:
    """The first run of digits of a case label as a number ("patient12" -> 12)."""
    return df.select(col).distinct().select(
        col, number_in(F.col(col)).alias("case_number"))


def _feature_name(kind: str, *names: str) -> str:
    return "_".join([kind, *[n.replace("\\", "\\\\").replace("_", "\\_") if len(names) > 1 else n for n in names]])


def trace_feature_map(log: EventLog) -> DataFrame:
    """B12, sparse: per case a map from feature to count, whatever the alphabet.

    Features are structs ``(a, b)``: an activity (``b`` null) or a step from
    ``a`` to ``b``. They are counted as rows with partial aggregation; a
    case's map holds the features it has, nothing for the others.
    """
    s = sequenced(log, carry=("activity",))
    none = F.lit(None).cast("string")
    both = F.array(F.struct(F.col("activity").alias("a"), none.alias("b")),
                   F.when(F.col("next_activity").isNotNull(),
                          F.struct(F.col("activity").alias("a"), F.col("next_activity").alias("b"))))
    counts = (s.select(log.case, F.explode(F.array_compact(both)).alias("_f"))
              .groupBy(log.case, "_f").agg(F.count(F.lit(1)).alias("_n")))
    return counts.groupBy(log.case).agg(F.map_from_entries(F.collect_list(F.struct("_f", "_n"))).alias("features"))


def trace_features(log: EventLog, values: Sequence[str], num: str = "num") -> DataFrame:
    """Per case: count of each activity, of each succession a->b, last numeric value.

    ``values`` is the activity alphabet to encode (the feature columns);
    ``_`` in the names of a succession is escaped, so no two columns share
    a name. Columns are looked up in the case's sparse map.
    """
    def count(a: str, b: str | None) -> Column:
        key = F.struct(F.lit(a).alias("a"), F.lit(b).cast("string").alias("b"))
        return F.coalesce(F.try_element_at(F.col("features"), key), F.lit(0).cast("long"))

    o = F.struct(*[F.col(c) for c in log.order_cols])
    last = log.df.groupBy(log.case).agg(F.max_by(F.col(num), o).alias(f"last_{num}"))
    return trace_feature_map(log).join(last, log.case).select(
        log.case, *[count(v, None).alias(_feature_name("act", v)) for v in values],
        *[count(a, b).alias(_feature_name("succ", a, b)) for a in values for b in values], f"last_{num}")


def region_value(orders: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Per region: units sold x the region's unit price (joined on the region key)."""
    cn = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    sold = (orders.join(cn, orders.o_custkey == cn.c_custkey)
            .groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("sold")))
    price = cn.groupBy("n_regionkey").agg(
        (F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double")
         / F.count(F.lit(1)).cast("double")).alias("unit_price"))
    return (sold.join(price, "n_regionkey").join(region, F.col("n_regionkey") == region.r_regionkey)
            .select("r_name", "sold", r6(F.col("unit_price")).alias("unit_price"),
                    r6(F.col("sold") * F.col("unit_price")).alias("value")))


def tiered_value(df: DataFrame, key: str, flags: dict[str, Column], threshold: int = 3,
                 low: int = 100, high: int = 120) -> DataFrame:
    """Row-wise sum of 0/1 flags; price ``low`` below ``threshold`` flags, else ``high``."""
    n = sum((c.cast("int") for c in flags.values()), F.lit(0))
    return df.select(key, *[c.cast("int").alias(k) for k, c in flags.items()],
                     n.alias("n_flags"),
                     F.when(n < threshold, F.lit(low)).otherwise(F.lit(high)).alias("price"))


def join_case_stats(log: EventLog) -> DataFrame:
    """Every event joined with its case's size and duration."""
    ct = case_table(log).select(log.case, "case_size",
                                seconds_between(F.col("case_start"), F.col("case_end")).alias("case_duration_s"))
    return log.df.join(ct, log.case)


def compare_side_by_side(as_is: DataFrame, to_be: DataFrame, key: str) -> DataFrame:
    """Two aggregates by the same key, full outer join."""
    return as_is.join(to_be, key, "full_outer")
