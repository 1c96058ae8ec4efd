"""Rating of many nets in one pass against the operators for one net; XES attributes; numbering by place."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tracefold.log import EventLog
from tracefold.operators import conformance as J
from tracefold.operators import evaluation as K
from tracefold.operators import prepare as B
from tracefold.operators import rating
from tracefold.plans.ranking import global_rank_sum
from tracefold.sources import io as A

T0 = dt.datetime(2024, 1, 1)
FIGURES = ["perc_fit_traces", "average_trace_fitness", "log_fitness", "precision", "generalization", "simplicity",
           "score", "score_compat"]


def log_of(spark, traces, split=None):
    rows = [(f"c{k}", a, T0 + dt.timedelta(minutes=i), i) for k, t in enumerate(traces) for i, a in enumerate(t)]
    df = spark.createDataFrame(rows, "case_id string, activity string, ts timestamp_ntz, tie long")
    return EventLog(df, ("ts",), ("tie",), split_rows=split)


def random_nets(r, n):
    nets = {}
    for k in range(n):
        names = [f"p{j}" for j in range(r.randint(2, 5))]
        places = [(p, int(j == 0), int(j == len(names) - 1)) for j, p in enumerate(names)]
        arcs = [(a, p, phase, -1 if phase == 0 else 1)
                for a in "abc" for phase in (0, 1) for p in r.sample(names, r.randint(1, 2))]
        nets[f"net{k}"] = (places, arcs)
    return nets


@pytest.mark.parametrize("seed,split,places", [(1, None, 100), (2, 2, 100), (3, None, 6)])
def test_one_pass_equals_each_net_alone(spark, monkeypatch, seed, split, places):
    """Also with cases cut into slices, and with the nets dealt to several passes."""
    monkeypatch.setattr(rating, "PASS_PLACES", places)
    r = random.Random(seed)
    log = log_of(spark, ["".join(r.choice("abcx") for _ in range(r.randint(1, 6))) for _ in range(12)], split)
    nets = {name: J.net_tables(spark, *net) for name, net in random_nets(r, 3).items()}
    got = {x["model"]: x for x in K.rating_table(log, nets).collect()}
    assert set(got) == set(nets)
    for name, net in nets.items():
        alone = K.rate_net(log, *net, name).first()
        assert [got[name][c] for c in FIGURES] == pytest.approx([alone[c] for c in FIGURES], abs=2e-6)
    assert sorted(x["rank"] for x in got.values()) == [1, 2, 3]


def test_rating_of_bare_nets_and_empty_logs(spark):
    """A net that never enables anything has no precision and ranks last; without events there is no fitness."""
    bare = J.net_tables(spark, [("p", 0, 0)], [("a", "p", 0, -1), ("b", "p", 1, 1)])
    fixed = J.net_tables(spark)
    shut = J.net_tables(spark, [("p", 0, 0)], [("a", "p", 0, -1)])
    got = {x["model"]: x for x in K.rating_table(log_of(spark, ["ba"]), {"bare": bare, "fixed": fixed, "shut": shut}).collect()}
    # before b only b is enabled, before a both are and b does not come: one of three escapes
    assert got["bare"]["precision"] == pytest.approx(2 / 3, abs=1e-6)
    assert got["shut"]["precision"] is None and got["shut"]["score"] is None and got["shut"]["rank"] == 3
    none = K.rating_table(log_of(spark, []), {"fixed": fixed}).first()
    assert none["perc_fit_traces"] is None and none["precision"] is None and none["simplicity"] is not None


def test_rating_reads_the_events_once_by_case(spark):
    log = log_of(spark, ["ab", "ac"])
    nets = {n: J.net_tables(spark, *net) for n, net in random_nets(random.Random(4), 4).items()}
    two, four = ({k: nets[k] for k in list(nets)[:n]} for n in (2, 4))
    shuffles = [K.rating_table(log, some)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(case_id")
                for some in (two, four)]
    assert shuffles[0] == shuffles[1]


def test_refuses_silent_labels(spark):
    silent = J.net_tables(spark, [("p", 1, 0)], [("", "p", 0, -1)])
    with pytest.raises(ValueError):
        K.rating_table(log_of(spark, ["a"]), {"silent": silent})


def test_xes_keeps_every_attribute(spark, tmp_path):
    """Typed event fields, map attributes, trace attributes; nulls are left out, empty traces stay."""
    cases = spark.sql("""SELECT 'c1' AS case_id, array(
        named_struct('activity', 'a & <b>', 'ts', timestamp_ntz'2024-01-02 03:04:05.000006', 'resource', 'r',
                     'Costs', 50L, 'share', 0.5D, 'ok', true, 'attrs', map('note', 'x;y')),
        named_struct('activity', 'b', 'ts', timestamp_ntz'2024-01-02 03:04:06', 'resource', null,
                     'Costs', null, 'share', null, 'ok', false, 'attrs', null)) AS events,
        map('creator', 'me') AS case_attrs, 7 AS priority
      UNION ALL SELECT 'c2', array(), null, null""")
    path = A.write_xes(cases, str(tmp_path / "log"))
    first, second = A.read_xes(spark, path).orderBy("tie").collect()
    assert first["activity"] == "a & <b>" and first["ts"] == dt.datetime(2024, 1, 2, 3, 4, 5, 6) and first["resource"] == "r"
    assert first["attrs"] == {"Costs": "50", "share": "0.5", "ok": "true", "note": "x;y"}
    assert second["resource"] is None and second["attrs"] == {"ok": "false"}
    assert first["case_attrs"] == {"creator": "me", "priority": "7"}
    assert {r["case_id"]: (r["n_events"], r["case_attrs"]) for r in A.read_xes_cases(spark, path).collect()} == {
        "c1": (2, {"creator": "me", "priority": "7"}), "c2": (0, {})}
    # read, written and read again: maps hold text, which comes back as it was
    again = A.read_xes(spark, path).groupBy("case_id").agg(
        F.first("case_attrs").alias("case_attrs"), F.collect_list(F.struct("tie", "activity", "ts", "resource", "attrs")).alias("_e"))
    cases = again.select("case_id", "case_attrs", F.transform(
        F.array_sort("_e", lambda x, y: (x["tie"] - y["tie"]).cast("int")),
        lambda e: F.struct(e["activity"].alias("activity"), e["ts"].alias("ts"), e["resource"].alias("resource"),
                           e["attrs"].alias("attrs"))).alias("events"))
    back = A.write_xes(cases, str(tmp_path / "again"))
    assert A.read_xes(spark, back).orderBy("tie").collect() == [first, second]


def test_numbering_needs_no_second_shuffle(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("k"), (F.col("id") % 3).alias("v"))
    ranked = global_rank_sum(df, [F.col("k")], {}, "rank0", 5)
    assert "Window [row_number" not in ranked._jdf.queryExecution().executedPlan().toString()
    assert all(r["k"] == r["rank0"] for r in ranked.collect())
    summed = global_rank_sum(df, [F.col("k")], {"run": F.col("v")}, "rank0", 5, totals=True).orderBy("k").collect()
    run = 0
    for r in summed:
        run += r["v"]
        assert (r["rank0"], r["run"], r["n_total"], r["run_total"]) == (r["k"], run, 1000, sum(x["v"] for x in summed))
    log = log_of(spark, ["abc", "ab"])
    assert sorted(r["index"] for r in B.event_index(log).collect()) == [0, 1, 2, 3, 4]
