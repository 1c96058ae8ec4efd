"""Event log = a plain DataFrame plus the names of its key columns.

Canonical columns inside the engine: ``case_id`` (string), ``activity``
(string), ``ts`` (timestamp), one or more tie columns that make the order
total within a case, and optional ``resource``, ``num``, ``start_ts``.
The order of a case is ``ORDER BY ts, tie...``; a log without a unique
tie is refused by the operators that depend on order (the oracle
comparison would otherwise flicker).

Every operator is a function ``EventLog -> DataFrame`` (statistics) or
``EventLog -> EventLog`` (filters), so filters chain with ``transform``.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The reference's canonical XES column names and the
# engine's internal names they map to at the boundary.
XES_NAMES = {
    "case:concept:name": "case_id",
    "concept:name": "activity",
    "time:timestamp": "ts",
    "start_timestamp": "start_ts",
    "org:resource": "resource",
}
# Artificial start / end activity symbols.
START_SYMBOL = "▶"
END_SYMBOL = "■"
# Fixed value: separator of activities in a variant string.
VARIANT_SEP = ","

# Events per chunk above which one case is split into ordered chunks
# (see plans/sequence.py). Overridable per call and by the session conf
# ``tracefold.case.splitRows``.
DEFAULT_SPLIT_ROWS = 2_000_000


@dataclass(frozen=True)
class EventLog:
    df: DataFrame
    order: tuple[str, ...] = ("ts",)        # primary time / order column(s)
    tie: tuple[str, ...] = ()                # unique tie-break columns
    case: str = "case_id"
    activity: str = "activity"
    split_rows: int | None = None            # chunk size for hot cases
    extra: dict = field(default_factory=dict)

    @property
    def order_cols(self) -> list[str]:
        return list(self.order) + list(self.tie)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def chunk_rows(self) -> int:
        if self.split_rows:
            return int(self.split_rows)
        conf = self.spark.conf.get("tracefold.case.splitRows", None)
        return int(conf) if conf else DEFAULT_SPLIT_ROWS

    def with_df(self, df: DataFrame) -> "EventLog":
        """Same cases (or a subset), new rows: remembered case statistics stay."""
        return replace(self, df=df)

    def with_cases(self, df: DataFrame) -> "EventLog":
        """New case ids (pieces, sub-logs): nothing remembered carries over."""
        return replace(self, df=df, extra={})

    def transform(self, fn: Callable[..., "EventLog"], *args, **kw) -> "EventLog":
        return fn(self, *args, **kw)

    def order_number(self) -> Column:
        """Numeric, order-preserving image of the first order column."""
        return order_number(self.df, self.order[0])


def order_number(df: DataFrame, col: str) -> Column:
    dtype = dict(df.dtypes)[col]
    if dtype.startswith("timestamp"):
        return micros(F.col(col))
    if dtype == "date":
        return F.unix_date(F.col(col)).cast("long")
    return F.col(col).cast("double")


def micros(c: Column) -> Column:
    """Microseconds since the epoch of a TIMESTAMP or TIMESTAMP_NTZ (UTC)."""
    return F.unix_micros(c.cast("timestamp"))


# ---------------------------------------------------------------- builders

def from_table(df: DataFrame, case: str, activity: str, ts: str | None,
               tie: Sequence[str] = (), rename: dict | None = None,
               keep: Sequence[str] = (), order: Sequence[str] | None = None,
               split_rows: int | None = None) -> EventLog:
    """Canonical log from any table: pick and rename the key columns."""
    cols = [F.col(case).cast("string").alias("case_id"),
            F.col(activity).cast("string").alias("activity")]
    if ts is not None:
        cols.append(F.col(ts).alias("ts"))
    cols += [F.col(t) for t in tie]
    cols += [F.col(k) for k in keep]
    out = df.select(*cols)
    if rename:
        out = out.withColumnsRenamed(rename)
    if order is None:
        order = ("ts",) if ts is not None else tuple(tie[:1])
        tie = tuple(tie) if ts is not None else tuple(tie[1:])
    return EventLog(out, order=tuple(order), tie=tuple(tie), split_rows=split_rows)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events")


def day_log(spark: SparkSession, sf_dir: str, split_rows: int | None = None) -> EventLog:
    """DAY: one case per user and calendar day of ``events``."""
    e = _events_base(spark, sf_dir)
    df = e.select(
        F.concat(F.col("user_id").cast("string"), F.lit("_"),
                 F.date_format("ts", "yyyy-MM-dd")).alias("case_id"),
        F.col("event_type").alias("activity"),
        F.col("ts"),
        F.col("event_id").alias("tie"),
        F.get_json_object("props", "$.k").alias("resource"),
        F.col("value").alias("num"),
        F.col("user_id"),
    )
    return EventLog(df, order=("ts",), tie=("tie",), split_rows=split_rows)


def user_log(spark: SparkSession, sf_dir: str, split_rows: int | None = None) -> EventLog:
    """USER: one case per user of ``events`` (long cases)."""
    e = _events_base(spark, sf_dir)
    df = e.select(
        F.col("user_id").cast("string").alias("case_id"),
        F.col("event_type").alias("activity"),
        F.col("ts"),
        F.col("event_id").alias("tie"),
        F.get_json_object("props", "$.k").alias("resource"),
        F.col("value").alias("num"),
        F.col("user_id"),
    )
    return EventLog(df, order=("ts",), tie=("tie",), split_rows=split_rows)


def ivl_log(spark: SparkSession, sf_dir: str, per_user: bool = False,
            split_rows: int | None = None) -> EventLog:
    """IVL: DAY (or USER) with interval events; start = ts - floor(value*60) s."""
    base = user_log(spark, sf_dir) if per_user else day_log(spark, sf_dir)
    df = base.df.withColumn(
        "start_ts",
        F.timestamp_add("SECOND", -F.floor(F.col("num") * 60), F.col("ts")))
    return EventLog(df, order=("ts",), tie=("tie",), split_rows=split_rows)


def ord_log(spark: SparkSession, sf_dir: str, split_rows: int | None = None) -> EventLog:
    """ORD: lineitems as events of their order."""
    li = read_table(spark, sf_dir, "lineitem")
    df = li.select(
        F.col("l_orderkey").cast("string").alias("case_id"),
        F.concat("l_returnflag", "l_linestatus").alias("activity"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_linenumber").cast("long").alias("tie"),
        F.col("l_partkey").alias("tie2"),
        F.col("l_suppkey").alias("tie3"),
        F.col("l_suppkey").cast("string").alias("resource"),
        F.col("l_quantity").alias("num"),
    )
    return EventLog(df, order=("ts",), tie=("tie", "tie2", "tie3"), split_rows=split_rows)


def conv_log(spark: SparkSession, sf_dir: str, split_rows: int | None = None) -> EventLog:
    """CONV: turns of a conversation; no timestamp, ordered by turn."""
    cv = read_table(spark, sf_dir, "conversations")
    df = cv.select(
        F.col("conv_id").cast("string").alias("case_id"),
        F.col("role").alias("activity"),
        F.col("turn"),
    )
    return EventLog(df, order=("turn",), tie=(), split_rows=split_rows)
