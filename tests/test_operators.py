"""Edge rows of FIXTURES §4 and invariants of SURVEY §5.2."""

import math

import pytest
from pyspark.sql import functions as F

from helpers import make_log, t
from tracefold.log import EventLog
from tracefold.operators import conformance as J
from tracefold.operators import discovery as I
from tracefold.operators import evaluation as K
from tracefold.operators import filters as C
from tracefold.operators import stats as S
from tracefold.operators import timing as H


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_one_event_case_std_null_and_no_pairs(spark):
    log = make_log(spark, [("a", "x", 0, 1), ("b", "x", 0, 2), ("b", "y", 5, 3)])
    tp = {(r["a"], r["b"]): r for r in H.temporal_profile(log).collect()}
    assert set(tp) == {("x", "y")}
    assert tp[("x", "y")]["std_s"] is None and tp[("x", "y")]["mean_s"] == 300.0
    d = dict(rows_of(H.case_durations(log), "case_id", "duration_s"))
    assert d == {"a": 0.0, "b": 300.0}


def test_empty_log(spark):
    log = make_log(spark, [("a", "x", 0, 1)])
    empty = log.with_df(log.df.where("false"))
    assert S.variant_stats(empty).count() == 0
    assert I.dfg_frequency(empty).count() == 0
    assert H.case_arrival_avg(empty).collect()[0][0] == 0.0


def test_null_resource_distinct_counts(spark):
    log = make_log(spark, [("a", "x", 0, 1, None), ("a", "y", 1, 2, "r1"), ("a", "z", 2, 3, "r1")])
    p = S.case_profile(log).collect()[0]
    assert p["n_resources"] == 1 and p["n_events"] == 3 and p["activity_list"] == "x, y, z"


def test_empty_attr_and_duplicates_none(spark):
    log = make_log(spark, [("a", "x", 0, 1, ""), ("a", "y", 1, 2, "r"), ("b", "x", 0, 3, None),
                           ("c", "x", 0, 4, "r"), ("c", "y", 1, 5, "r"), ("c", "z", 2, 6, "r")])
    assert {r[0] for r in C.empty_attr(log, "resource").df.select("case_id").collect()} == {"c"}
    dup = log.with_df(log.df.withColumn("eid", F.when(F.col("tie") <= 2, 1).when(F.col("tie") <= 5, 2)
                                        .otherwise(3)))
    kept = C.duplicates_none(dup, "eid").df
    assert rows_of(kept, "tie") == [(6,)]  # id 1 twice, id 2 three times: all copies dropped


def test_between_same_activity_pairs(spark):
    # A B A C A with act1 = act2 = A: pieces (A B A) and (A C A); the middle A is in both
    log = make_log(spark, [("k", a, i, i) for i, a in enumerate("ABACA")])
    out = rows_of(C.between(log, "A", "A").df, "case_id", "activity", "tie")
    assert out == sorted([("k#1", "A", 0), ("k#1", "B", 1), ("k#1", "A", 2),
                          ("k#2", "A", 2), ("k#2", "C", 3), ("k#2", "A", 4)])


def test_between_drops_unclosed_and_reversed(spark):
    log = make_log(spark, [("k", a, i, i) for i, a in enumerate("YXQXZ")])  # act1 X, act2 Z
    out = rows_of(C.between(log, "X", "Z").df, "case_id", "tie")
    assert out == [("k#0", 1), ("k#0", 2), ("k#0", 3), ("k#0", 4)]
    log2 = make_log(spark, [("k", a, i, i) for i, a in enumerate("ZXQ")])  # act2 before act1, never closed
    assert C.between(log2, "X", "Z").df.count() == 0


def test_contained_subset_of_intersecting(spark):
    log = make_log(spark, [("a", "x", 0, 1), ("a", "y", 100, 2), ("b", "x", 10, 3), ("b", "y", 20, 4),
                           ("c", "x", -50, 5), ("c", "y", 500, 6)])
    d1, d2 = t(5), t(200)
    cont = {r[0] for r in C.time_contained(log, d1, d2).df.select("case_id").collect()}
    inter = {r[0] for r in C.time_intersecting(log, d1, d2).df.select("case_id").collect()}
    assert cont == {"b"} and inter == {"a", "b", "c"} and cont <= inter


def test_dfg_invariant_and_cumulative_100(spark):
    rows = [("a", "x", 0, 1), ("a", "y", 1, 2), ("a", "x", 2, 3), ("b", "y", 0, 4), ("c", "x", 0, 5),
            ("c", "y", 1, 6)]
    log = make_log(spark, rows)
    assert I.dfg_frequency(log).agg(F.sum("n")).collect()[0][0] == len(rows) - 3
    p = S.variant_pareto(log).orderBy(F.col("rank0").desc()).first()
    assert p["cum_percentage"] == 100.0


def test_topk_subset_of_coverage(spark):
    rows = [(f"c{i}", a, j, i * 10 + j) for i, v in enumerate(["xy", "xy", "xy", "yx", "yx", "z"])
            for j, a in enumerate(v)]
    log = make_log(spark, rows)
    top = {r[0] for r in C.variants_top_k(log, 1).df.select("case_id").distinct().collect()}
    cov = {r[0] for r in C.variants_coverage(log, 0.3).df.select("case_id").distinct().collect()}
    assert top == {"c0", "c1", "c2"} and top <= cov


def _ivl(spark, rows, split=None):
    # rows: (case, activity, start_min, end_min, tie)
    df = spark.createDataFrame([(c, a, t(s), t(e), k) for c, a, s, e, k in rows],
                               "case_id string, activity string, start_ts timestamp_ntz, ts timestamp_ntz, tie long")
    return EventLog(df, order=("ts",), tie=("tie",), split_rows=split)


@pytest.mark.parametrize("split", [None, 1])
def test_lead_cycle_overlap_nested_touching(spark, split):
    log = _ivl(spark, [("k", "a", 0, 10, 1), ("k", "b", 5, 8, 2),      # nested
                       ("k", "c", 8, 20, 3),                            # overlaps the first
                       ("k", "d", 20, 25, 4),                           # touches
                       ("k", "e", 30, 31, 5)], split)                   # gap of 5 minutes
    r = {x["tie"]: x for x in H.lead_cycle_time(log).collect()}
    last = r[5]
    assert last["partial_cycle_s"] == 26 * 60          # union of intervals: 0-25 and 30-31
    assert last["partial_lead_s"] == 31 * 60           # span
    assert last["this_waste_s"] == 5 * 60
    for x in r.values():                               # lead = cycle + waste
        assert math.isclose(x["partial_lead_s"], x["partial_cycle_s"] + x["overall_waste_s"])


def test_business_hours_weekend_and_midnight(spark):
    import datetime as dt
    fri = dt.datetime(2024, 1, 5, 15, 0)   # Friday 15:00
    mon = dt.datetime(2024, 1, 8, 9, 30)   # Monday 09:30
    late = dt.datetime(2024, 1, 8, 23, 0)
    nxt = dt.datetime(2024, 1, 9, 8, 30)
    df = spark.createDataFrame([(fri, mon), (late, nxt), (mon, fri)], "a timestamp_ntz, b timestamp_ntz")
    got = [r[0] for r in df.select(H.business_seconds(F.col("a"), F.col("b"))).collect()]
    assert got == [3600 + 5400, 1800, 0.0]


def _replay_loop(traces, places, arcs):
    """Plain-Python token replay (independent check of J1)."""
    out = {}
    pre = {}
    post = {}
    for a, p, ph, d in arcs:
        (pre if d < 0 else post).setdefault(a, []).append(p)
    for case, acts in traces.items():
        tok = {p: m0 for p, m0, _ in places}
        prod = sum(m0 for _, m0, _ in places)
        cons = miss = 0
        for a in acts:
            if a not in pre and a not in post:
                continue
            for p in pre.get(a, []):
                if tok[p] == 0:
                    miss += 1
                    tok[p] += 1
                tok[p] -= 1
                cons += 1
            for p in post.get(a, []):
                tok[p] += 1
                prod += 1
        for p, _, mf in places:
            for _ in range(mf):
                if tok[p] == 0:
                    miss += 1
                    tok[p] += 1
                tok[p] -= 1
                cons += 1
        out[case] = (prod, cons, miss, sum(tok.values()))
    return out


@pytest.mark.parametrize("split", [None, 2])
def test_token_replay_matches_loop(spark, split):
    traces = {"fit1": ["signup", "error"], "fit2": ["signup", "click", "view", "purchase"],
              "skip": ["signup", "oops", "error"], "twice": ["signup", "signup", "view"],
              "bad": ["purchase", "view"], "self": ["signup", "view", "view", "click", "purchase"]}
    rows, k = [], 0
    for c, acts in traces.items():
        for i, a in enumerate(acts):
            k += 1
            rows.append((c, a, i, k))
    log = make_log(spark, rows, split_rows=split)
    p, a = J.net_tables(spark)
    got = {r["case_id"]: r for r in J.token_replay(log, p, a).collect()}
    want = _replay_loop(traces, J.FIXED_NET_PLACES, J.FIXED_NET_ARCS)
    for c, (pp, cc, mm, rr) in want.items():
        g = got[c]
        assert (g["produced"], g["consumed"], g["missing"], g["remaining"]) == (pp, cc, mm, rr), c
        assert g["produced"] + g["missing"] == g["consumed"] + g["remaining"]
    assert got["fit1"]["is_fit"] and got["fit2"]["is_fit"] and not got["twice"]["is_fit"]
    assert got["skip"]["skipped"] == 1 and got["skip"]["is_fit"]
    assert got["twice"]["remaining"] > 0        # places filled twice, never emptied


def test_self_loop_net(spark):
    # a transition that consumes and produces the same place
    places = [("i", 1, 0), ("p", 0, 0), ("o", 0, 1)]
    arcs = [("start", "i", 0, -1), ("start", "p", 1, 1), ("loop", "p", 0, -1), ("loop", "p", 1, 1),
            ("stop", "p", 0, -1), ("stop", "o", 1, 1)]
    traces = {"a": ["start", "loop", "loop", "stop"], "b": ["start", "stop", "loop"]}
    rows = [(c, x, i, hash((c, i)) % 10**9) for c, acts in traces.items() for i, x in enumerate(acts)]
    log = make_log(spark, rows)
    pdf, adf = J.net_tables(spark, places, arcs)
    got = {r["case_id"]: (r["produced"], r["consumed"], r["missing"], r["remaining"])
           for r in J.token_replay(log, pdf, adf).collect()}
    assert got == _replay_loop(traces, places, arcs)


def test_temporal_profile_matches_pairs(spark):
    import statistics
    rows = [("a", "x", 0, 1), ("a", "y", 3, 2), ("a", "x", 4, 3), ("a", "y", 10, 4),
            ("b", "y", 0, 5), ("b", "x", 7, 6), ("b", "y", 8, 7)]
    log = make_log(spark, rows, split_rows=2)
    got = {(r["a"], r["b"]): r for r in H.temporal_profile(log).collect()}
    pairs = {}
    for c in "ab":
        ev = sorted([r for r in rows if r[0] == c], key=lambda r: (r[2], r[3]))
        for i in range(len(ev)):
            for j in range(i + 1, len(ev)):
                pairs.setdefault((ev[i][1], ev[j][1]), []).append((ev[j][2] - ev[i][2]) * 60.0)
    assert set(got) == set(pairs)
    for k, v in pairs.items():
        assert got[k]["n_pairs"] == len(v)
        assert math.isclose(got[k]["mean_s"], statistics.mean(v), abs_tol=1e-6)
        sd = statistics.stdev(v) if len(v) > 1 else None
        assert (got[k]["std_s"] is None) if sd is None else math.isclose(got[k]["std_s"], sd, abs_tol=1e-6)


def test_score_compat_constants(spark):
    # perfect fitness {100, 1, 1, 100} -> (1 + .01 + .01 + 1) / 4 = 0.505; total 2.3272
    fit = spark.createDataFrame([(100.0, 1.0, 1.0)], "perc_fit_traces double, average_trace_fitness double, log_fitness double")
    one = lambda n, v: spark.createDataFrame([(v,)], f"{n} double")
    r = K.model_score(fit, one("precision", 0.4337), one("generalization", 0.7218),
                      one("simplicity", 0.6667)).collect()[0]
    assert math.isclose(r["score_compat"], 0.505 + 0.4337 + 0.7218 + 0.6667, abs_tol=1e-9)
    assert math.isclose(round(r["score_compat"], 4), 2.3272)
    assert math.isclose(r["score"], 1.0 + 0.4337 + 0.7218 + 0.6667, abs_tol=1e-9)


def test_simplicity_chain_is_one(spark):
    # strict chain i -> a -> p -> b -> o: every node degree <= 2 -> simplicity 1.0
    places = [("i", 1, 0), ("p", 0, 0), ("o", 0, 1)]
    arcs = [("a", "i", 0, -1), ("a", "p", 1, 1), ("b", "p", 0, -1), ("b", "o", 1, 1)]
    p, a = J.net_tables(spark, places, arcs)
    assert K.simplicity(p, a).collect()[0][0] == 1.0


def test_business_seconds_closed_form_matches_day_loop(spark):
    import datetime as dt
    import random
    rnd = random.Random(7)

    def loop(a, b, work=(8, 16), weekends=(6, 7)):
        total, day = 0.0, dt.datetime(a.year, a.month, a.day)
        while day <= b:
            if day.isoweekday() not in weekends:
                lo = max(a, day + dt.timedelta(hours=work[0]))
                hi = min(b, day + dt.timedelta(hours=work[1]))
                total += max(0.0, (hi - lo).total_seconds())
            day += dt.timedelta(days=1)
        return total

    base = dt.datetime(2023, 12, 20)
    pairs = []
    for _ in range(300):
        a = base + dt.timedelta(seconds=rnd.randint(0, 40 * 86400), microseconds=rnd.randint(0, 999999))
        b = a + dt.timedelta(seconds=rnd.choice([rnd.randint(0, 7200), rnd.randint(0, 20 * 86400)]))
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a timestamp_ntz, b timestamp_ntz")
    for weekends in [(6, 7), (5, 6, 7), (1,)]:
        got = df.select("a", "b", H.business_seconds(F.col("a"), F.col("b"), (8, 16), weekends).alias("s")).collect()
        for r in got:
            assert math.isclose(r["s"], loop(r["a"], r["b"], weekends=weekends), abs_tol=1e-6), (r, weekends)


def _between_loop(traces, a1, a2):
    """S7 by hand: pieces end at every a2; keep from the first a1 strictly before it."""
    out = set()
    for c, tr in traces.items():
        if a1 == a2:
            occ = [i for i, x in enumerate(tr) if x == a1]
            for k in range(len(occ) - 1):
                for i in range(occ[k], occ[k + 1] + 1):
                    out.add((f"{c}#{k + 1}", i))
            continue
        k, start = 0, 0
        for i, x in enumerate(tr):
            if x == a2:
                firsts = [j for j in range(start, i) if tr[j] == a1]
                if firsts:
                    for j in range(firsts[0], i + 1):
                        out.add((f"{c}#{k}", j))
                k, start = k + 1, i + 1
    return out


@pytest.mark.parametrize("a1,a2,split", [("A", "C", None), ("A", "A", None), ("A", "C", 3), ("B", "B", 3)])
def test_between_matches_loop(spark, a1, a2, split):
    import random
    rnd = random.Random(11)
    traces = {f"c{n}": [rnd.choice("ABC") for _ in range(rnd.randint(1, 14))] for n in range(40)}
    rows, k = [], 0
    for c, tr in traces.items():
        for i, x in enumerate(tr):
            k += 1
            rows.append((c, x, i, k))
    log = make_log(spark, rows, split_rows=split)
    first = {c: min(r[3] for r in rows if r[0] == c) for c in traces}
    got = {(r["case_id"], r["tie"] - first[r["case_id"].split("#")[0]])
           for r in C.between(log, a1, a2).df.collect()}
    assert got == _between_loop(traces, a1, a2)


def test_token_replay_random_traces_match_loop(spark):
    import random
    rnd = random.Random(3)
    acts = ["signup", "view", "click", "purchase", "error", "oops"]
    traces = {f"r{n}": [rnd.choice(acts) for _ in range(rnd.randint(1, 12))] for n in range(60)}
    rows, k = [], 0
    for c, tr in traces.items():
        for i, a in enumerate(tr):
            k += 1
            rows.append((c, a, i, k))
    p, a = J.net_tables(spark)
    want = _replay_loop(traces, J.FIXED_NET_PLACES, J.FIXED_NET_ARCS)
    for split in (None, 3):
        got = {r["case_id"]: (r["produced"], r["consumed"], r["missing"], r["remaining"])
               for r in J.token_replay(make_log(spark, rows, split_rows=split), p, a).collect()}
        assert got == want
