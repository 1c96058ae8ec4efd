"""Hand-made logs for unit tests."""

import datetime as dt

from tracefold.log import EventLog

T0 = dt.datetime(2024, 1, 1, 9, 0, 0)


def t(minutes: float) -> dt.datetime:
    return T0 + dt.timedelta(minutes=minutes)


def make_log(spark, rows, split_rows=None, extra_schema=""):
    """rows: (case_id, activity, minutes, tie[, resource][, ...])."""
    schema = "case_id string, activity string, ts timestamp_ntz, tie long"
    if rows and len(rows[0]) > 4:
        schema += ", resource string"
    schema += extra_schema
    data = [(r[0], r[1], t(r[2]), *r[3:]) for r in rows]
    df = spark.createDataFrame(data, schema)
    return EventLog(df, order=("ts",), tie=("tie",), split_rows=split_rows)
