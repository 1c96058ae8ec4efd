"""XES and CSV readers on hand-made files (FIXTURES §4)."""

import datetime as dt

from tracefold.sources import io as A

XES = """<?xml version="1.0" encoding="UTF-8"?>
<log xes.version="1.0">
  <trace>
    <string key="concept:name" value="t1"/>
    <event>
      <string key="concept:name" value="register"/>
      <date key="time:timestamp" value="2024-01-05T10:00:00.000+01:00"/>
    </event>
  </trace>
  <trace>
    <string key="concept:name" value="t2"/>
    <string key="creator" value="someone"/>
    <event>
      <string key="concept:name" value="register"/>
      <string key="org:resource" value="Pete"/>
      <int key="Costs" value="50"/>
      <date key="time:timestamp" value="2024-01-05T10:00:00.000+00:00"/>
    </event>
    <event>
      <string key="concept:name" value="decide"/>
      <string key="org:resource" value="Sara"/>
      <date key="time:timestamp" value="2024-01-06T11:30:00.000+00:00"/>
    </event>
  </trace>
</log>
"""


def test_read_xes_one_and_several_attributes(spark, tmp_path):
    p = tmp_path / "log.xes"
    p.write_text(XES)
    rows = sorted(A.read_xes(spark, str(p)).collect(), key=lambda r: (r["case_id"], r["tie"]))
    assert [(r["case_id"], r["activity"], r["tie"]) for r in rows] == [
        ("t1", "register", 0), ("t2", "register", 0), ("t2", "decide", 1)]
    assert rows[0]["ts"] == dt.datetime(2024, 1, 5, 9, 0)       # +01:00 read as UTC
    assert rows[1]["resource"] == "Pete" and rows[1]["attrs"] == {"Costs": "50"}
    assert rows[0]["resource"] is None


def test_parse_timestamps_only_converts_timestamp_text(spark):
    df = spark.createDataFrame([("2024-01-05 10:00:00", "x", "3"), ("2024-01-06 11:30:00", "y", "")],
                               "a string, b string, c string")
    out = A.parse_timestamps(df)
    types = dict(out.dtypes)
    assert types["a"] == "timestamp_ntz" and types["b"] == "string" and types["c"] == "string"
