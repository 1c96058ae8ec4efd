"""Variants by signature, selection of medians, alignments to tables of traces, empty logs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracefold.operators import alignment as A
from tracefold.operators import conformance as J
from tracefold.operators import discovery as I
from tracefold.operators import evaluation as K
from tracefold.operators import filters as C
from tracefold.operators import prepare as B
from tracefold.operators import stats as S
from tracefold.operators import timing as H
from tracefold.plans import cases as P

from helpers import make_log


def log_of(spark, traces, split_rows=None):
    """``{case: activities}``, one event a minute."""
    return make_log(spark, [(c, a, float(k), k, "r") for c, t in traces.items() for k, a in enumerate(t)], split_rows)


def kept(log):
    return {r[0] for r in log.df.select("case_id").distinct().collect()}


@pytest.fixture(scope="module")
def mixed():
    r = random.Random(4)
    names = ["a", "b", "a,b", "a\\", "b,"]
    shapes = [[r.choice(names) for _ in range(r.randint(1, 4))] for _ in range(14)]
    return {f"c{i:03d}": r.choice(shapes[:1 + i % 14]) for i in range(150)}


def ranks(traces):
    counts = Counter(P.variant_text(t) for t in traces.values())
    return sorted(counts.items(), key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("split", [None, 2])
def test_variant_filters_against_texts(spark, mixed, split):
    log = log_of(spark, mixed, split)
    order = ranks(mixed)
    text = {c: P.variant_text(t) for c, t in mixed.items()}
    assert {(r["variant"], r["n_cases"]) for r in S.variant_stats(log).collect()} == set(order)
    of = lambda vs: {c for c, v in text.items() if v in vs}
    for k in (1, 3, 6, 99):
        assert kept(C.variants_top_k(log, k)) == of({v for v, _ in order[:k]})
    for pct in (0.0, 0.3, 0.77, 1.0):
        run, want = 0, set()
        for i, (v, n) in enumerate(order):
            run += n
            if i == 0 or run <= pct * len(text):
                want.add(v)
        assert kept(C.variants_percentage(log, pct)) == of(want), pct
    assert kept(C.variants_coverage(log, 0.1)) == of({v for v, n in order if n >= 0.1 * len(text)})
    for row in (0, 4, len(order) - 1):
        assert kept(C.variant_at(log, row)) == of({order[row][0]})
    assert kept(C.variant_at(log, len(order))) == set()
    some = [order[1][0], mixed["c000"]]
    assert kept(C.variants_in(log, some)) == of({order[1][0], P.variant_text(mixed["c000"])})
    assert kept(C.variants_in(log, some, positive=False)) == set(text) - kept(C.variants_in(log, some))
    check = S.pareto_check(log, 0.2).first()
    at = int(len(order) * 0.2)
    assert check["n_variants"] == len(order) and check["pareto_rank"] == at
    assert check["cum_percentage"] == pytest.approx(100 * sum(n for _, n in order[:at + 1]) / len(text), abs=1e-6)


def test_variant_text_and_back():
    for t in (["a", "b"], ["a,b"], ["a\\", "b"], ["a\\,", ",", "\\"], [""]):
        assert P.variant_activities(P.variant_text(t)) == t


def test_hot_case_needs_no_text(spark):
    """A case of twenty slices is counted and filtered without collecting it anywhere."""
    traces = {"hot": ["a", "b"] * 200, "twin": ["a", "b"] * 200, "swap": ["a", "b"] * 199 + ["b", "a"],
              **{f"c{i}": ["a"] for i in range(5)}}
    log = log_of(spark, traces, 20)
    assert kept(C.variants_top_k(log, 1)) == {f"c{i}" for i in range(5)}
    assert kept(C.variants_in(log, [["a", "b"] * 200])) == {"hot", "twin"}
    assert kept(C.variants_coverage(log, 0.2)) == {"hot", "twin"} | {f"c{i}" for i in range(5)}
    for out in (C.variants_in(log, [["a", "b"] * 200]).df, P.case_signatures(log), S.pareto_check(log), I.sweep_bounds(log)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and "array_join" not in plan


# ------------------------------------------------------------------ selection

@pytest.mark.parametrize("listed", [1, 10, 1_000_000])
def test_group_median(spark, monkeypatch, listed):
    """Against sorting: signs, repeats, one value, huge numbers in one bin, two middle values far apart, nulls."""
    monkeypatch.setattr(H, "SELECT_LISTED", listed)
    monkeypatch.setattr(H, "SELECT_PARTS", 7)
    r = random.Random(listed)
    groups = {"signs": [r.randint(-50, 50) for _ in range(101)], "repeat": [7] * 60 + [8] * 60, "one": [5],
              "dense": [1_700_000_000_000_000 + r.randint(0, 3000) for _ in range(200)], "apart": [0, 10**15],
              "wide": [int(10 ** r.uniform(0, 17)) * r.choice([1, -1]) for _ in range(150)], "min": [-2**62, 2**62, 0]}
    rows = [(k, x) for k, xs in groups.items() for x in [*xs, None]] + [("none", None)]
    got = {x["k"]: x["median"] for x in H.group_median(spark.createDataFrame(rows, "k string, x long"), ["k"], "x").collect()}
    for k, xs in groups.items():
        xs = sorted(xs)
        assert got.pop(k) == pytest.approx((xs[(len(xs) - 1) // 2] + xs[len(xs) // 2]) / 2, rel=1e-15)
    assert not got


def test_step_times_and_decoration(spark):
    log = log_of(spark, {"x": "abab", "y": "ab", "z": "a"})
    row = {(r["a"], r["b"]): r for r in I.dfg_performance(log).collect()}
    assert row["a", "b"]["n"] == 3 and row["a", "b"]["median_s"] == 60.0 and row["b", "a"]["n"] == 1
    edges = spark.createDataFrame([("a", "b"), ("a", "z")], "a string, b string")
    deco = I.model_decoration(log, edges)
    assert {(r["a"], r["b"], r["freq"]) for r in deco.collect()} == {("a", "b", 3), ("a", "z", 0)}
    assert "decimal(38,0)" in deco._jdf.queryExecution().optimizedPlan().toString() and "_bin" not in str(
        deco._jdf.queryExecution().optimizedPlan().toString())


# ------------------------------------------------------------------ alignments

def lcs(v, m):
    rows = [[0] * (len(m) + 1)]
    for x in v:
        new = [0]
        for j, y in enumerate(m):
            new.append(rows[-1][j] + 1 if x == y else max(rows[-1][j + 1], new[j]))
        rows.append(new)
    return rows[-1][-1]


def check_moves(pairs, v, m, cost):
    assert [a for a, _ in pairs if a is not None] == list(v) and [b for _, b in pairs if b is not None] == list(m)
    assert all(a == b for a, b in pairs if a is not None and b is not None)
    assert sum(a is None or b is None for a, b in pairs) == cost


def test_moves_are_optimal_for_any_step():
    r = random.Random(2)
    for _ in range(150):
        v, m = ([r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in range(2))
        for step in (1, 3, 512):
            check_moves(A.moves(v, m, step), v, m, len(v) + len(m) - 2 * lcs(v, m))


def test_prefix_rows_are_shared_and_right():
    r = random.Random(3)
    for _ in range(60):
        v = [r.choice("abc") for _ in range(r.randint(0, 8))]
        block = sorted([r.choice("abcd") for _ in range(r.randint(0, 6))] for _ in range(r.randint(1, 12)))
        want = min((len(v) + len(m) - 2 * lcs(v, m), ",".join(m), m) for m in block)
        assert A.nearest_in(v, block) == want


def test_long_trace():
    r = random.Random(6)
    v, m = ([r.choice("abcdefgh") for _ in range(n)] for n in (20_000, 200))
    cost, _, _ = A.nearest_in(v, [m])
    check_moves(A.moves(v, m), v, m, cost)


@pytest.mark.parametrize("block_bytes", [16 << 20, 200])
def test_table_of_model_traces(spark, monkeypatch, block_bytes):
    """Model traces as a table, in one block and in many; a log's own traces fit it."""
    monkeypatch.setattr(A, "BLOCK_BYTES", block_bytes)
    r = random.Random(9)
    traces = {f"c{i}": [r.choice("abcd") for _ in range(r.randint(1, 7))] for i in range(40)}
    model = [[r.choice("abcd") for _ in range(r.randint(1, 6))] for _ in range(60)]
    log = log_of(spark, traces)
    table = spark.createDataFrame([(m,) for m in [*model, model[0]]] + [(None,)], "trace array<string>")
    got = {x["variant"]: x for x in J.nearest_trace_alignment(log, table).collect()}
    counts = Counter(",".join(t) for t in traces.values())
    assert {v: x["n_cases"] for v, x in got.items()} == counts
    by_variant = {}
    for x in J.alignment_moves(log, table).orderBy("variant", "pos").collect():
        by_variant.setdefault(x["variant"], []).append((x["log_act"], x["model_act"]))
    for v, x in got.items():
        t = v.split(",")
        cost, _, m = min((len(t) + len(m) - 2 * lcs(t, m), ",".join(m), m) for m in model)
        assert (x["cost"], x["model_trace"]) == (cost, ",".join(m))
        assert x["fitness"] == pytest.approx(1 - cost / (len(t) + min(map(len, model))), abs=1e-6)
        check_moves(by_variant[v], t, m, cost)
    assert {x["cost"] for x in J.nearest_trace_alignment(log, A.trace_table(log)).collect()} == {0}


def test_ten_thousand_model_traces(spark):
    r = random.Random(1)
    model = [[r.choice("abcdefgh") for _ in range(10)] for _ in range(10_000)]
    log = log_of(spark, {"x": model[17][:9], "y": ["z"] * 30})
    got = {x["variant"]: x["cost"] for x in J.nearest_trace_alignment(
        log, spark.createDataFrame([(m,) for m in model], "trace array<string>")).collect()}
    assert got[",".join(model[17][:9])] == 1 and got[",".join(["z"] * 30)] == 40


# ------------------------------------------------------------------ empty logs and nets, names

def empty_operators(spark, log, net):
    places, arcs = net
    edges = spark.createDataFrame([("a", "b")], "a string, b string")
    cost = lambda: J.alignment_costs(J.positional_moves(log))
    return {
        "variant_stats": lambda: S.variant_stats(log), "variant_pareto": lambda: S.variant_pareto(log),
        "pareto_check": lambda: S.pareto_check(log), "case_profile": lambda: S.case_profile(log),
        "variant_profile": lambda: S.variant_profile(log), "top_k": lambda: C.variants_top_k(log, 3).df,
        "percentage": lambda: C.variants_percentage(log, 0.5).df, "coverage": lambda: C.variants_coverage(log, 0.5).df,
        "variant_at": lambda: C.variant_at(log, 0).df, "variants_in": lambda: C.variants_in(log, ["a"]).df,
        "dfg_frequency": lambda: I.dfg_frequency(log), "dfg_performance": lambda: I.dfg_performance(log),
        "footprint": lambda: I.footprint(log), "dependency": lambda: I.dependency_graph(log),
        "alpha_places": lambda: I.alpha_places(log), "decoration": lambda: I.model_decoration(log, edges).where("freq > 0"),
        "features": lambda: B.trace_features(log, ["a", "b"], "tie"), "feature_map": lambda: B.trace_feature_map(log),
        "token_replay": lambda: J.token_replay(log, places, arcs), "edge_conformance": lambda: J.edge_conformance(log, edges),
        "replay_problems": lambda: J.replay_problems(log, places, arcs),
        "diagnostics": lambda: J.replay_diagnostics_transitions(log, places, arcs),
        "nearest": lambda: J.nearest_trace_alignment(log), "moves": lambda: J.alignment_moves(log),
        "alignment_summary": lambda: J.alignment_summary(cost()), "consensus": lambda: J.consensus_sequence(log),
        "temporal_profile": lambda: H.temporal_profile(log), "event_index": lambda: B.event_index(log),
    }


def test_operators_on_an_empty_log(spark):
    log = log_of(spark, {"x": "ab"})
    log = log.with_cases(log.df.where("false"))
    for name, run in empty_operators(spark, log, J.net_tables(spark)).items():
        assert run().count() == 0, name
    places, arcs = J.net_tables(spark)
    fit = K.replay_fitness(log, places, arcs).first()
    assert fit["perc_fit_traces"] is None and fit["average_trace_fitness"] is None
    odds = J.anomaly_odds(J.alignment_costs(J.positional_moves(log))).first()
    assert (odds["n_unfit"], odds["n_fit"], odds["unfit_share"]) == (0, 0, None)
    assert H.median_case_duration(log).first()["median_s"] is None
    sweep = I.parameter_sweep(log).collect()
    assert len(sweep) == len(I.SWEEP_SETTINGS) and all(
        (r["n_edges"], r["n_activities"], r["covered_steps"], r["fitness"], r["simplicity"]) == (0, 0, 0, 0.0, 1.0) for r in sweep)


def test_empty_nets(spark):
    places, arcs = J.net_tables(spark)
    assert K.simplicity(places.where("false"), arcs.where("false")).first()["simplicity"] == 1.0
    log = log_of(spark, {"x": "ab", "y": "q"})
    unmarked = spark.createDataFrame([("p", 0, 0)], "place string, m0 int, mf int")
    takes = spark.createDataFrame([("a", "p", 1, 1), ("b", "p", 0, -1)], "activity string, place string, phase int, delta int")
    got = {r["case_id"]: r for r in J.token_replay(log, unmarked, takes).collect()}
    assert set(got) == {"x", "y"} and got["x"]["is_fit"] and got["x"]["produced"] == 1
    assert got["y"]["is_fit"] and got["y"]["produced"] == 0 and got["y"]["skipped"] == 1


def test_shared_labels_are_refused(spark):
    places, _ = J.net_tables(spark)
    arcs = spark.createDataFrame([("t1", "a", "p", 1, 1), ("t2", "a", "q", 1, 1)],
                                 "transition string, activity string, place string, phase int, delta int")
    with pytest.raises(ValueError, match="uniquely labelled"):
        J.token_replay(log_of(spark, {"x": "a"}), places, arcs)


def test_place_names_tell_places_apart(spark):
    log = log_of(spark, {"1": ["s", "a", "x"], "2": ["s", "b", "x"], "3": ["s", "a,b", "y"], "4": ["s", "a|b", "y"]})
    sets = I.alpha_place_sets(log).collect()
    assert len({r["place"] for r in sets}) == len(sets)
    names = {(tuple(r["inputs"]), tuple(r["outputs"])): r["place"] for r in sets}
    assert (("a,b", "a|b"), ("y",)) in names and (("a", "b"), ("x",)) in names


def test_features_without_clashes(spark):
    log = log_of(spark, {"x": ["a_b", "c"], "y": ["a", "b_c", "a", "b_c"]})
    row = {r["case_id"]: r.asDict() for r in B.trace_features(log, ["a", "a_b", "b_c", "c"], "tie").collect()}
    assert row["x"]["succ_a\\_b_c"] == 1 and row["x"]["succ_a_b\\_c"] == 0 and row["y"]["succ_a_b\\_c"] == 2
    assert row["y"]["act_b_c"] == 2 and row["x"]["last_tie"] == 1
    many = log_of(spark, {"x": [f"n{i}" for i in range(200)]})
    assert len(B.trace_feature_map(many).first()["features"]) == 399


def test_seconds_of_day(spark):
    df = make_log(spark, [("x", "a", 0.0, 0), ("x", "a", 1501.5, 1)]).df
    assert S.topic_dimensions(df, "activity", ["tie"]).first()["duration_s"] == 90_090.0
    assert S.topic_dimensions(df, "activity", ["tie"], seconds_of_day=True).first()["duration_s"] == 3_690.0


def test_alpha_places_against_all_subsets(spark):
    """Random logs: the maximal pairs among all pairs of sets; and a choice of 150."""
    from itertools import chain, combinations

    r = random.Random(11)
    for _ in range(2):
        traces = {str(i): [r.choice("abcde") for _ in range(r.randint(1, 5))] for i in range(6)}
        log = log_of(spark, traces)
        rel = {(x["a"], x["b"]): x["relation"] for x in I.footprint(log).collect()}
        acts = sorted({a for a, _ in rel})
        sets = [set(s) for s in chain.from_iterable(combinations(acts, k) for k in range(1, len(acts) + 1))]
        free = [s for s in sets if all(rel[a, b] == "#" for a in s for b in s)]
        valid = [(A, B) for A in free for B in free if all(rel[a, b] == "->" for a in A for b in B)]
        want = {(tuple(sorted(A)), tuple(sorted(B))) for A, B in valid
                if not any((A, B) != (C, D) and A <= C and B <= D for C, D in valid)}
        got = {(tuple(x["inputs"]), tuple(x["outputs"])) for x in I.alpha_place_sets(log).collect() if x["kind"] == "inner"}
        assert got == want
    many = log_of(spark, {str(i): ["s", f"x{i:03d}", "e"] for i in range(150)})
    inner = [x for x in I.alpha_place_sets(many).collect() if x["kind"] == "inner"]
    assert len(inner) == 2 and sorted(len(x["inputs"]) + len(x["outputs"]) for x in inner) == [151, 151]
