"""Readers and writers for event logs (inventory group A).

CSV and XES become the canonical event table (``tracefold.log``); tables
are written as parquet / CSV / JSON with Spark's writers. Scratch output
(round trips, intermediate tables) goes under the shared folder the
session names (``tracefold.scratch.dir``, else the checkpoint folder),
never a machine-local temporary folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..log import XES_NAMES
from ..session import ensure_checkpoint_dir

# Fixed value: microsecond timestamp text used in CSV files (the default
# writer format keeps milliseconds only).
CSV_TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
# Timestamp formats tried when text columns are parsed.
TIMESTAMP_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss",
                     "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "dd.MM.yyyy HH:mm:ss",
                     "dd.MM.yyyy HH:mm", "yyyy-MM-dd"]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared scratch location for ``name``; it goes when the session ends."""
    base = spark.conf.get("tracefold.scratch.dir", None) or ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/tracefold-{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


# ------------------------------------------------------------------ CSV (A1-A3)

def read_csv_log(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                 sep: str = ",", encoding: str = "ISO-8859-1", rename: dict | None = None,
                 header: bool = True, timestamp_format: str | None = None) -> DataFrame:
    """A1 / A2: CSV to event table with an explicit schema, then canonical names.

    Without a schema every column is read as text (inference is opt-in via
    ``parse_timestamps`` and casts). Without ``timestamp_format`` Spark's own
    reading applies: ISO dates and times, with ``T`` or a blank between.
    """
    r = (spark.read.option("header", header).option("sep", sep).option("encoding", encoding)
         .option("mode", "FAILFAST"))
    if timestamp_format:
        r = r.option("timestampNTZFormat", timestamp_format).option("timestampFormat", timestamp_format)
    df = r.schema(schema).csv(path) if schema is not None else r.csv(path)
    if rename:
        df = df.withColumnsRenamed(rename)
    xes = {k: v for k, v in XES_NAMES.items() if k in df.columns}
    return df.withColumnsRenamed(xes) if xes else df


def _parse_ts(c: Column, formats: Sequence[str]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def parse_timestamps(df: DataFrame, cols: Sequence[str] | None = None,
                     formats: Sequence[str] = TIMESTAMP_FORMATS) -> DataFrame:
    """A3: convert every text column whose non-empty values all parse as timestamps.

    One aggregate pass decides which columns qualify (a count of values
    that fail per column); the conversion itself stays lazy.
    """
    text = [c for c, t in df.dtypes if t == "string" and (cols is None or c in cols)]
    if not text:
        return df
    value = {c: F.nullif(F.col(c), F.lit("")) for c in text}
    row = df.agg(*[F.count(value[c]).alias(f"n_{k}") for k, c in enumerate(text)],
                 *[F.count_if(value[c].isNotNull() & _parse_ts(F.col(c), formats).isNull()).alias(f"bad_{k}")
                   for k, c in enumerate(text)]).first()
    ok = [c for k, c in enumerate(text) if row[f"bad_{k}"] == 0 and row[f"n_{k}"] > 0]
    return df.withColumns({c: _parse_ts(F.col(c), formats) for c in ok}) if ok else df


# ------------------------------------------------------------------ parquet

def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A4: read back a stored intermediate table."""
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
                **options) -> str:
    """Write a table (parquet, csv, json), optionally one folder per category."""
    w = df.write.mode("overwrite").options(**options)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = (w.option("header", True).option("timestampNTZFormat", CSV_TS_FORMAT)
             .option("timestampFormat", CSV_TS_FORMAT))
    w.format(fmt).save(path)
    return path


def write_report(rating: DataFrame, path: str) -> str:
    """Dated report of ranked models as JSON lines (one row per model)."""
    dated = rating.withColumn("report_date", F.current_date())
    return write_table(dated.coalesce(1), path, fmt="json")   # one small file: a rating table is model-sized


# ------------------------------------------------------------------ XES (A5)

_ATTR = T.ArrayType(T.StructType([T.StructField("_key", T.StringType()), T.StructField("_value", T.StringType())]))
_TAGS = ["string", "date", "int", "float", "boolean"]
XES_TRACE_SCHEMA = T.StructType(
    [T.StructField(tag, _ATTR) for tag in _TAGS]
    + [T.StructField("event", T.ArrayType(T.StructType([T.StructField(tag, _ATTR) for tag in _TAGS])))])


def _attrs(x: Column) -> Column:
    """All typed attribute lists of one element merged into a map key -> text."""
    parts = [F.coalesce(x[tag], F.array().cast(_ATTR)) for tag in _TAGS]
    return F.map_from_entries(F.transform(F.flatten(F.array(*parts)),
                                          lambda e: F.struct(e["_key"], e["_value"])))


def read_xes(spark: SparkSession, path: str) -> DataFrame:
    """A5: XES log to the canonical event table (case_id, activity, ts, resource, attrs, case_attrs).

    Rows are traces (``rowTag=trace``); events are exploded with their
    position. Dates are zoned in XES and read as UTC. ``case_attrs`` holds
    the trace's own attributes (``creator`` and the like) as a map.
    """
    e = _xes_traces(spark, path).select("case_id", "case_attrs", F.posexplode("event").alias("pos", "ev")).select(
        "case_id", "case_attrs", "pos", _attrs(F.col("ev")).alias("eattr"))
    return e.select(
        "case_id",
        F.col("eattr")["concept:name"].alias("activity"),
        F.to_timestamp(F.col("eattr")["time:timestamp"]).cast("timestamp_ntz").alias("ts"),
        F.col("pos").cast("long").alias("tie"),
        F.col("eattr")["org:resource"].alias("resource"),
        F.map_filter("eattr", lambda k, v: ~k.isin("concept:name", "time:timestamp", "org:resource")).alias("attrs"),
        "case_attrs")


def read_xes_cases(spark: SparkSession, path: str) -> DataFrame:
    """A5 (cases): every trace with its number of events and attributes, also those without events."""
    return _xes_traces(spark, path).select(
        "case_id", F.coalesce(F.size("event"), F.lit(0)).cast("long").alias("n_events"), "case_attrs")


def _xes_traces(spark: SparkSession, path: str) -> DataFrame:
    tr = spark.read.format("xml").option("rowTag", "trace").schema(XES_TRACE_SCHEMA).load(path)
    t = tr.select(_attrs(F.struct(*[F.col(tag) for tag in _TAGS])).alias("tattr"), "event")
    return t.select(F.col("tattr")["concept:name"].alias("case_id"), "event",
                    F.map_filter("tattr", lambda k, v: k != "concept:name").alias("case_attrs"))


# The standard keys of an event, and the XES tag of each kind of column (text otherwise).
_STANDARD = {"activity": "concept:name", "resource": "org:resource", "ts": "time:timestamp"}
_TAG_OF = {"timestamp": "date", "timestamp_ntz": "date", "date": "date", "tinyint": "int", "smallint": "int",
           "int": "int", "bigint": "int", "float": "float", "double": "float", "boolean": "boolean"}
_XES_DATE = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"


def _tagged(fields: dict[str, tuple[str, Column]], maps: Sequence[Column] = ()) -> list[Column]:
    """One list of (_key, _value) per XES tag; attributes without a value are left out.

    ``fields``: key -> (type, value); ``maps``: text maps, whose entries become strings.
    """
    item = T.ArrayType(T.StructType([T.StructField("_key", T.StringType()), T.StructField("_value", T.StringType())]))
    lists = {tag: [] for tag in _TAGS}
    for key, (kind, value) in fields.items():
        text = F.date_format(value, _XES_DATE) if _TAG_OF.get(kind) == "date" else value.cast("string")
        lists[_TAG_OF.get(kind, "string")].append(F.struct(F.lit(key).alias("_key"), text.alias("_value")))
    out = []
    for tag, pairs in lists.items():
        whole = F.array(*pairs).cast(item) if pairs else F.array().cast(item)
        if tag == "string":
            for m in maps:
                whole = F.concat(whole, F.coalesce(F.transform(F.map_entries(m), lambda e: F.struct(
                    e["key"].alias("_key"), e["value"].alias("_value"))), F.array().cast(item)))
        out.append(F.filter(whole, lambda e: e["_value"].isNotNull()).alias(tag))
    return out


def write_xes(cases: DataFrame, path: str) -> str:
    """Write (case_id, events ARRAY<STRUCT<activity, ts, resource, ...>>, ...) as an XES file.

    Every further event field becomes an event attribute, every further column a trace
    attribute, tagged by its type (date, int, float, boolean, else string). Map columns,
    ``attrs`` and ``case_attrs`` of ``read_xes`` among them, give one string attribute per
    key, so a log that is read, written and read again keeps its attributes. Null values
    are left out; a trace without events stays.
    """
    kinds = dict(cases.dtypes)
    fields = cases.schema["events"].dataType.elementType.fields

    def event(e: Column) -> Column:
        flat = {_STANDARD.get(f.name, f.name): (f.dataType.simpleString(), e[f.name]) for f in fields
                if not isinstance(f.dataType, T.MapType)}
        return F.struct(*_tagged(flat, [e[f.name] for f in fields if isinstance(f.dataType, T.MapType)]))
    own = [c for c in cases.columns if c not in ("case_id", "events")]
    flat = {"concept:name": ("string", F.col("case_id")),
            **{c: (kinds[c], F.col(c)) for c in own if not kinds[c].startswith("map<")}}
    out = cases.select(*_tagged(flat, [F.col(c) for c in own if kinds[c].startswith("map<")]),
                       F.transform("events", event).alias("event"))
    out.write.mode("overwrite").format("xml").option("rowTag", "trace").option("rootTag", "log").save(path)
    return path
