"""Plan shape at scale: one exchange on the case key, pruned scans, pushed filters."""

import re

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.01"


@pytest.fixture()
def static(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # the shape without small-table shortcuts
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def _plan(spark, name):
    return E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["dfg_frequency", "dfg_performance", "temporal_profile",
                                  "flt_case_size", "case_durations", "lead_cycle_time"])
def test_one_exchange_on_case(static, name):
    plan = _plan(static, name)
    case_ex = re.findall(r"Exchange hashpartitioning\(case_id#\d+, \d+\)", plan)
    assert 1 <= len(case_ex) <= 2, plan       # events once; at most one more for a partial aggregate
    # the exact edge median windows one row per partition, nothing else meets in one task
    assert "SinglePartition" not in plan or name == "dfg_performance"


def test_dfg_reads_only_needed_columns(static):
    plan = _plan(static, "dfg_frequency")
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all("props" not in s and "value" not in s for s in schemas)


def test_time_filter_pushed_to_scan(static):
    plan = _plan(static, "flt_time_events")
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts", plan)
