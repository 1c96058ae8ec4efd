"""Edge rows and properties of repaired operators: exact statistics, variant identity, trees, readers, NULLs."""

import datetime as dt
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helpers import make_log
from tracefold.functions.columns import exact_mean_std
from tracefold.log import EventLog
from tracefold.operators import conformance as J
from tracefold.operators import discovery as I
from tracefold.operators import evaluation as K
from tracefold.operators import filters as C
from tracefold.operators import prepare as B
from tracefold.operators import stats as S
from tracefold.operators import timing as H
from tracefold.plans.cases import case_variants, variant_text
from tracefold.sources import io as A

DAY_US = 86_400_000_000


def test_std_of_two_million_long_steps(spark):
    """Two million steps around 120 days, and a span of twenty years: no overflow, exact to the rounding."""
    df = spark.range(2_000_000).select((F.lit(120 * DAY_US) + F.col("id") % 2).alias("x"))
    mean, std = exact_mean_std(F.col("x"))
    row = df.agg(mean.alias("m"), std.alias("s")).first()
    assert row["m"] == pytest.approx(120 * 86400 + 0.5e-6, rel=1e-15)
    assert row["s"] == pytest.approx(0.5e-6, abs=5e-7)
    wide = spark.range(1_000_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(20 * 365 * DAY_US).cast("long").alias("x"))
    half = 10 * 365 * 86400
    got = wide.agg(mean.alias("m"), std.alias("s")).first()
    assert got["m"] == half and got["s"] == pytest.approx(half * math.sqrt(1_000_000 / 999_999), rel=1e-12)


def plain_profile(rows):
    by, out = {}, {}
    for c, a, t, tie, *_ in rows:
        by.setdefault(c, []).append((t, tie, a))
    for ev in by.values():
        ev.sort()
        for i in range(len(ev)):
            for j in range(i + 1, len(ev)):
                out.setdefault((ev[i][2], ev[j][2]), []).append((ev[j][0] - ev[i][0]) * 60)
    return out


@pytest.mark.parametrize("alphabet,split", [(4, None), (300, None), (300, 5)])
def test_temporal_profile_any_alphabet(spark, alphabet, split):
    r = random.Random(alphabet)
    rows = [(f"c{r.randint(0, 30)}", f"a{r.randrange(alphabet)}", r.randint(0, 500), i) for i in range(500)]
    want = plain_profile(rows)
    got = {(x["a"], x["b"]): x for x in H.temporal_profile(make_log(spark, rows, split_rows=split)).collect()}
    assert set(got) == set(want)
    for k, d in want.items():
        m = sum(d) / len(d)
        assert got[k]["n_pairs"] == len(d) and got[k]["mean_s"] == pytest.approx(m)
        if len(d) > 1:
            assert got[k]["std_s"] == pytest.approx(math.sqrt(sum((x - m) ** 2 for x in d) / (len(d) - 1)), abs=1e-5)


def test_edge_median(spark):
    rows = [("c1", "a", 0, 0), ("c1", "b", 1, 1), ("c2", "a", 0, 2), ("c2", "b", 5, 3), ("c3", "a", 0, 4), ("c3", "b", 7, 5),
            ("c4", "a", 0, 6), ("c4", "b", 9, 7)]
    row = I.dfg_performance(make_log(spark, rows)).first()
    assert row["median_s"] == 360.0 and row["n"] == 4


COMMA = [("c1", "a,b", 0, 0), ("c2", "a", 0, 1), ("c2", "b", 1, 2), ("c3", "a\\", 0, 3), ("c3", "b", 1, 4), ("c4", "a\\,b", 0, 5)]


def test_variants_are_their_traces(spark):
    log = make_log(spark, COMMA)
    assert Counter(r["n_cases"] for r in S.variant_stats(log).collect()) == {1: 4}
    assert S.pareto_check(log, 0.0).first()["n_variants"] == 4
    assert {r["case_id"] for r in C.variants_in(log, [["a,b"]]).df.collect()} == {"c1"}
    assert {r["case_id"] for r in C.variants_in(log, ["a,b"]).df.collect()} == {"c2"}
    assert {r["case_id"] for r in C.variants_in(log, [["a\\,b"]], positive=False).df.collect()} == {"c1", "c2", "c3"}
    assert {r["variant"] for r in case_variants(log).collect()} == {
        variant_text(t) for t in (["a,b"], ["a", "b"], ["a\\", "b"], ["a\\,b"])}
    for few in (C.variants_top_k(log, 1), C.variants_percentage(log, 0.25), C.variant_at(log, 0)):
        assert few.df.select("case_id").distinct().count() == 1
    assert len(S.variant_profile(make_log(spark, [(*r, "r") for r in COMMA])).collect()) == 4


def accepts(tree, node, trace):
    """Whether a trace is in the language of the subtree."""
    op, act, kids = tree[node]
    if op == "tau":
        return not trace
    if op == "activity":
        return trace == (act,)
    if op == "flower":
        return set(trace) <= {tree[k][1] for k in kids}
    if op == "xor":
        return any(accepts(tree, k, trace) for k in kids)
    if op == "sequence":
        if not kids:
            return not trace
        return any(accepts(tree, kids[0], trace[:i]) and _rest(tree, kids[1:], trace[i:]) for i in range(len(trace) + 1))
    if op == "parallel":
        sets = [alphabet(tree, k) for k in kids]
        return set(trace) <= set().union(*sets) and all(
            accepts(tree, k, tuple(x for x in trace if x in s)) for k, s in zip(kids, sets))
    do, redo = kids[0], kids[1]
    return any(accepts(tree, do, trace[:i]) and (i == len(trace) or any(
        accepts(tree, redo, trace[i:j]) and (j > i or len(trace[j:]) < len(trace)) and accepts(tree, node, trace[j:])
        for j in range(i, len(trace) + 1))) for i in range(len(trace) + 1))


def _rest(tree, kids, trace):
    if not kids:
        return not trace
    return any(accepts(tree, kids[0], trace[:i]) and _rest(tree, kids[1:], trace[i:]) for i in range(len(trace) + 1))


def alphabet(tree, node):
    op, act, kids = tree[node]
    return {act} if op == "activity" else set().union(*[alphabet(tree, k) for k in kids], set())


def tree_of(spark, traces):
    rows = [(f"c{k}", a, i, i) for k, t in enumerate(traces) for i, a in enumerate(t)]
    out = {}
    for r in I.inductive_tree(make_log(spark, rows)).collect():
        out[r["node"]] = (r["op"], r["activity"], [])
    for n in sorted(out, key=lambda n: [int(x) for x in n.split(".")]):
        if "." in n:
            out[n.rsplit(".", 1)[0]][2].append(n)
    return out


@pytest.mark.parametrize("traces", [["abc", "ac"], ["aa", "a"], ["saae", "sae"], ["a"], ["ab", "ba"], ["abab", "ab"],
                                    ["abcbd", "abd"], ["ab", "cd"], ["a", "ab", "abb", "b"]])
def test_tree_holds_its_log(spark, traces):
    tree = tree_of(spark, traces)
    for t in traces:
        assert accepts(tree, "0", tuple(t)), (t, tree)


def test_tree_is_not_looser_than_needed(spark):
    assert not accepts(tree_of(spark, ["abc", "ac"]), "0", tuple("abbc"))
    assert not accepts(tree_of(spark, ["ab", "ac"]), "0", tuple("abc"))
    assert accepts(tree_of(spark, ["aa", "a"]), "0", tuple("aaa"))


def test_random_trees_hold_their_logs(spark):
    r = random.Random(13)
    for _ in range(6):
        traces = ["".join(r.choice("abcd") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 6))]
        tree = tree_of(spark, traces)
        assert all(accepts(tree, "0", tuple(t)) for t in traces), (traces, tree)


def test_sweep_keeps_every_setting(spark):
    rows = [("c1", "a", 0, 0), ("c1", "b", 1, 1), ("c2", "a", 0, 2), ("c2", "b", 1, 3)]
    got = {r["dep_t"]: r for r in I.parameter_sweep(make_log(spark, rows), [(0.1, 1, 1), (0.99, 100, 100)]).collect()}
    assert (got[0.1]["n_edges"], got[0.1]["fitness"], got[0.1]["simplicity"]) == (1, 1.0, 1.0)
    assert (got[0.99]["n_edges"], got[0.99]["n_activities"], got[0.99]["covered_steps"], got[0.99]["fitness"]) == (0, 0, 0, 0.0)


def test_value_counts_without_a_cap(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("v"))
    assert S.value_counts_all(df, ["v"]).count() == 5000
    assert S.value_counts_all(df, ["v"], max_distinct=2000).count() == 0


def test_nulls_stay(spark):
    rows = [("c1", "a", 0, 0, None), ("c1", "b", 1, 1, "x"), ("c2", "a", 0, 2, "y"), ("c2", "b", 1, 3, "y")]
    log = make_log(spark, rows)
    assert C.attr_events(log, "resource", ["x"], positive=False).df.count() == 3
    assert C.attr_events(log, "resource", ["x"]).df.count() == 1
    assert {r["tie"] for r in C.duplicates_none(log, "resource").df.collect()} == {0, 1}
    area = log.with_df(log.df.withColumn("area", F.lit("z")))
    steps = S.filter_effect(area, "area", "resource", dt.datetime(2000, 1, 1), dt.datetime(2100, 1, 1)).collect()
    assert [(r["before"], r["after"]) for r in sorted(steps, key=lambda r: r["step"])] == [(2, 2), (2, 1), (1, 1)]


def test_last_activity_is_no_pair(spark):
    log = make_log(spark, [("c1", "x", 0, 0), ("c1", "a->b", 1, 1)])
    log = log.with_df(log.df.withColumn("num", F.lit(1.0)))
    row = B.trace_features(log, ["a", "b"]).first()
    assert row["succ_a_b"] == 0


def test_replay_without_time_and_without_tokens(spark):
    df = spark.createDataFrame([("c1", "go", 1), ("c1", "stop", 2), ("c2", "other", 1)], "case_id string, activity string, turn int")
    log = EventLog(df, order=("turn",))
    places = spark.createDataFrame([("p", 0, 0), ("q", 0, 0), ("i", 1, 0)], "place string, m0 int, mf int")
    arcs = spark.createDataFrame([("go", "i", 0, -1), ("go", "p", 1, 1), ("stop", "p", 0, -1)],
                                 "activity string, place string, phase int, delta int")
    got = {r["case_id"]: r for r in J.token_replay(log, places, arcs).collect()}
    assert got["c1"]["is_fit"] and got["c1"]["fitness"] == 1.0
    assert got["c2"]["consumed"] == 0 and got["c2"]["fitness"] == 0.5 and got["c2"]["skipped"] == 1
    assert K.replay_fitness(log, places, arcs).first()["perc_fit_traces"] == 50.0
    assert J.replay_problems(log, places, arcs).count() == 0


@pytest.mark.parametrize("stamp,fmt", [("2024-01-01 10:00:00", None), ("2024-01-01T10:00:00.000001", None),
                                       ("01.01.2024 10:00", "dd.MM.yyyy HH:mm")])
def test_csv_timestamps(spark, tmp_path, stamp, fmt):
    (tmp_path / "log.csv").write_text(f"case,act,ts\nc1,a,{stamp}\n")
    row = A.read_csv_log(spark, str(tmp_path / "log.csv"), schema="`case` string, act string, ts timestamp_ntz",
                         timestamp_format=fmt).first()
    assert row["ts"].replace(microsecond=0) == dt.datetime(2024, 1, 1, 10)


XES = """<log><trace><string key="concept:name" value="1"/><string key="creator" value="x"/>
<event><string key="concept:name" value="a"/><string key="org:resource" value="r"/>
<date key="time:timestamp" value="2024-01-01T10:00:00.000+01:00"/></event></trace>
<trace><string key="concept:name" value="2"/><string key="creator" value="y"/></trace></log>"""


def test_xes_trace_attributes(spark, tmp_path):
    (tmp_path / "log.xes").write_text(XES)
    row = A.read_xes(spark, str(tmp_path / "log.xes")).first()
    assert (row["case_id"], row["activity"], row["case_attrs"]) == ("1", "a", {"creator": "x"})
    assert row["ts"] == dt.datetime(2024, 1, 1, 9)
    cases = {r["case_id"]: (r["n_events"], r["case_attrs"]["creator"]) for r in A.read_xes_cases(spark, str(tmp_path / "log.xes")).collect()}
    assert cases == {"1": (1, "x"), "2": (0, "y")}


def test_session_tuning_is_the_callers(spark):
    from tracefold.session import apply_engine_conf
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "200m")
    apply_engine_conf(spark)
    assert spark.conf.get(key) == "200m"
    spark.conf.set(key, before)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_are_few(spark):
    import __spark_entry__ as E
    q = E.queries()
    sf = "/root/testdata/sf0.001"
    scans = lambda n: plan_of(q[n](spark, sf)).count("Scan parquet")
    assert scans("zscore_columns") <= 1
    assert scans("histogram_bins") <= 2 and scans("empirical_cdf") <= 2
    assert scans("set_all_categories") <= 2
    assert scans("scatter_case_time") <= 1


def test_discovered_net_fits_its_log(spark):
    rows = [("c1", a, i, i) for i, a in enumerate("abd")] + [("c2", a, i, 10 + i) for i, a in enumerate("acd")]
    log = make_log(spark, rows)
    places, arcs = I.alpha_net(log)
    table = {r["model"]: r for r in K.rating_table(log, {"alpha": (places, arcs), "fixed": J.net_tables(spark)}).collect()}
    assert table["alpha"]["perc_fit_traces"] == 100.0 and table["alpha"]["rank"] == 1
    assert J.replay_outside(log, arcs).count() == 0
    assert {r["activity"]: (r["n_events"], r["n_cases"]) for r in J.replay_outside(log, arcs.where("activity <> 'd'")).collect()} == {"d": (2, 2)}


def test_alignments_keep_commas_apart(spark):
    log = make_log(spark, [("c1", "x,y", 0, 0), ("c2", "x", 0, 1), ("c2", "y", 1, 2)])
    got = {r["variant"]: r for r in J.nearest_trace_alignment(log, [["x,y"]]).collect()}
    assert {k: r["cost"] for k, r in got.items()} == {"x\\,y": 0, "x,y": 3}
    moves = J.alignment_moves(log, [["x,y"]]).collect()
    assert len(moves) == 4 and sum(r["log_act"] == r["model_act"] for r in moves) == 1


@pytest.mark.parametrize("traces", [["ab", "cd"], ["abc", "acb", "ac"], ["ab", "ba", "ab"], ["abcbd", "abd", "acd"], ["abxab", "ab"],
                                    ["a", "aa"], ["abab", "ba", "bb"]])
def test_cut_equals_its_twin(spark, traces):
    """Each kind of cut: the operator and the recursive SQL agree."""
    import duckdb
    from tracefold.oracle import SQL
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    rows = [(f"c{k}", a, i, 100 * k + i) for k, t in enumerate(traces) for i, a in enumerate(t)]
    for c, a, i, tie in rows:
        con.execute("INSERT INTO events VALUES (?, ?, ?, ?, 0, '{}')", [tie, dt.datetime(2024, 1, 1, 0, i), int(c[1:]), a])
    want = {(r[0], r[1], r[2], r[3]) for r in con.execute(
        f"SELECT activity, cut, grp, grp_order FROM ({SQL['activity_cut']})").fetchall()}
    assert {tuple(r) for r in I.activity_cut(make_log(spark, rows)).collect()} == want
