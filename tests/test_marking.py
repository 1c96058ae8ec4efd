"""Marking graphs of nets and alignments against them, held against plain searches."""

import heapq
import random
from collections import Counter

import pytest

from tracefold.operators import conformance as J
from tracefold.operators import marking as M

from helpers import make_log

# i -> (a | a') -> p -> b* loop by a silent step -> c -> o; two transitions carry the label a, one step is silent
PLACES = [("i", 1, 0), ("p", 0, 0), ("q", 0, 0), ("r", 0, 0), ("o", 0, 1)]
ARCS = [("a", "a1", "i", 0, -1), ("a", "a1", "p", 1, 1), ("a", "a2", "i", 0, -1), ("a", "a2", "r", 1, 1),
        ("b", "b", "p", 0, -1), ("b", "b", "q", 1, 1), (None, "back", "q", 0, -1), (None, "back", "p", 1, 1),
        ("c", "c", "q", 0, -1), ("c", "c", "o", 1, 1), ("d", "d", "r", 0, -1), ("d", "d", "o", 1, 1)]


def net(spark, places=PLACES, arcs=ARCS):
    return (spark.createDataFrame(places, "place string, m0 int, mf int"),
            spark.createDataFrame(arcs, "activity string, transition string, place string, phase int, delta int"))


def log_of(spark, traces):
    return make_log(spark, [(f"c{c}", a, float(k), k) for c, t in enumerate(traces) for k, a in enumerate(t)])


def firing(arcs):
    need, change, label = {}, {}, {}
    for a, t, p, _, d in arcs:
        label[t] = a or ""
        change.setdefault(t, Counter())[p] += d
        if d < 0:
            need.setdefault(t, Counter())[p] -= d
    return need, change, label


def fire(marking, need, change):
    if any(marking.get(p, 0) < n for p, n in need.items()):
        return None
    new = Counter(marking)
    for p, d in change.items():
        new[p] += d
    return {p: n for p, n in new.items() if n}


def plain_cost(trace, places, arcs):
    """Dijkstra over (cost, log moves) in the product of trace and net."""
    need, change, label = firing(arcs)
    key = lambda m: tuple(sorted(m.items()))
    final = key({p: f for p, _, f in places if f})
    queue, done, tick = [((0, 0), 0, 0, {p: m for p, m, _ in places if m})], set(), 0
    while queue:
        cost, _, i, m = heapq.heappop(queue)
        if (i, key(m)) in done:
            continue
        done.add((i, key(m)))
        if i == len(trace) and key(m) == final:
            return cost
        steps = [((cost[0] + 1, cost[1] + 1), i + 1, m)] if i < len(trace) else []
        for t in need:
            new = fire(m, need[t], change[t])
            if new is not None:
                steps.append(((cost[0] + bool(label[t]), cost[1]), i, new))
                if i < len(trace) and label[t] and trace[i] == label[t]:
                    steps.append((cost, i + 1, new))
        for c, j, n in steps:
            tick += 1
            heapq.heappush(queue, (c, tick, j, n))


def random_net(r):
    """A bounded net: a token moves, splits into two threads and joins again."""
    arcs, names = [], iter(range(100))

    def arc(label, ins, outs):
        t = f"t{next(names)}"
        arcs.extend([(label, t, p, 0, -1) for p in ins] + [(label, t, p, 1, 1) for p in outs])
    letters = ["a", "b", "c", None]
    arc(r.choice(letters), ["i"], ["x0", "y0"])
    for thread in "xy":
        for k in range(r.randint(1, 3)):
            arc(r.choice(letters), [f"{thread}{k}"], [f"{thread}{k + 1}"])
        if r.random() < 0.6:
            arc(r.choice(letters), [f"{thread}{k + 1}"], [f"{thread}0"])
        if r.random() < 0.5:
            arc(r.choice(letters), [f"{thread}0"], [f"{thread}{k + 1}"])
        last = f"{thread}{k + 1}"
        arc(r.choice(letters), [last], [f"{thread}end"])
    arc(r.choice(letters), ["xend", "yend"], ["o"])
    places = sorted({p for _, _, p, _, _ in arcs})
    return [(p, int(p == "i"), int(p == "o")) for p in places], arcs


def check_moves(moves, trace, places, arcs, cost):
    need, change, label = firing(arcs)
    assert [m[0] for m in moves if m[0] is not None] == list(trace)
    m, paid = {p: n for p, n, _ in places if n}, 0
    for log_act, model_act, t in moves:
        if t is not None:
            assert (model_act or "") == label[t] and (log_act is None or log_act == model_act)
            m = fire(m, need[t], change[t])
            assert m is not None
        paid += (log_act is None) != (model_act is None)
    assert m == {p: f for p, _, f in places if f} and paid == cost


@pytest.mark.parametrize("seed", range(3))
def test_random_nets_against_plain_search(spark, seed):
    r = random.Random(seed)
    places, arcs = random_net(r)
    traces = [[r.choice("abcz") for _ in range(r.randint(1, 9))] for _ in range(40)]
    graph = M._graph(*net(spark, places, arcs))
    for trace, found in zip(traces, graph.costs(traces)):
        assert found == plain_cost(trace, places, arcs)
        for step in (1, 3, 512):
            check_moves(graph.moves(trace, step), trace, places, arcs, found[0])
    check_moves(graph.moves([]), [], places, arcs, plain_cost([], places, arcs)[0])


def test_double_labels_and_silent_steps(spark):
    traces = [["a", "d"], ["a", "b", "c"], ["a", "b", "b", "b", "c"], ["a", "c"], ["x", "a", "d"], ["a", "d"]]
    log, (places, arcs) = log_of(spark, traces), net(spark)
    got = {r["variant"]: r for r in M.net_alignment(log, places, arcs).collect()}
    assert {v: r["cost"] for v, r in got.items()} == {"a,d": 0, "a,b,c": 0, "a,b,b,b,c": 0, "a,c": 1, "x,a,d": 1}
    assert got["a,d"]["n_cases"] == 2 and got["a,d"]["fitness"] == 1.0
    assert (got["x,a,d"]["log_moves"], got["x,a,d"]["model_moves"], got["x,a,d"]["sync_moves"]) == (1, 0, 2)
    assert (got["a,c"]["log_moves"], got["a,c"]["model_moves"]) == (0, 1) and got["a,c"]["fitness"] == 0.75
    moves = {}
    for r in sorted(M.net_alignment_moves(log, places, arcs).collect(), key=lambda r: (r["variant"], r["pos"])):
        moves.setdefault(r["variant"], []).append((r["log_act"], r["model_act"], r["transition"]))
    for v, r in got.items():
        check_moves(moves[v], v.split(","), PLACES, ARCS, r["cost"])
    assert moves["a,b,b,b,c"].count((None, None, "back")) == 2


def test_graph_of_the_fixed_net(spark):
    states, steps = M.marking_graph(*J.net_tables(spark))
    assert states.count() == 6 and steps.count() == 7
    assert states.where("is_start").count() == states.where("is_final").count() == 1


def test_long_trace_in_blocks(spark):
    graph = M._graph(*net(spark))
    trace = ["a"] + ["b", "z"] * 3000 + ["c"]
    assert graph.costs([trace]) == [(3000, 3000)]
    check_moves(graph.moves(trace), trace, PLACES, ARCS, 3000)


def test_refused_nets_and_empty_logs(spark):
    grow = [("a", "a", "i", 0, -1), ("a", "a", "i", 1, 1), ("a", "a", "o", 1, 1)]
    with pytest.raises(ValueError, match="bounded"):
        M.marking_graph(*net(spark, [("i", 1, 0), ("o", 0, 1)], grow))
    with pytest.raises(ValueError, match="input places"):
        M.marking_graph(*net(spark, [("o", 0, 1)], [("a", "a", "o", 1, 1)]))
    with pytest.raises(ValueError, match="markings"):
        M.marking_graph(*net(spark), most_markings=3)
    with pytest.raises(ValueError, match="final"):
        M.net_alignment(log_of(spark, [["a"]]), *net(spark, [("i", 1, 0), ("o", 0, 2)], ARCS))
    log = log_of(spark, [["a"]])
    assert M.net_alignment(log.with_df(log.df.limit(0)), *net(spark)).collect() == []
    assert M.net_alignment_moves(log.with_df(log.df.limit(0)), *net(spark)).collect() == []
