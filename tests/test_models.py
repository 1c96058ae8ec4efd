"""Alignments, alpha places and inductive cuts against brute force on small logs."""

import itertools

import pytest

from helpers import make_log
from tracefold.operators import conformance as J
from tracefold.operators import discovery as I


def _log(spark, traces, split=None):
    rows, k = [], 0
    for c, tr in enumerate(traces):
        for i, a in enumerate(tr):
            k += 1
            rows.append((f"c{c}", a, i, k))
    return make_log(spark, rows, split_rows=split)


def _lcs(x, y):
    r = [0] * (len(y) + 1)
    for c in x:
        n = [0]
        for j in range(1, len(y) + 1):
            n.append(r[j - 1] + 1 if c == y[j - 1] else max(r[j], n[j - 1]))
        r = n
    return r[-1]


def test_nearest_trace_alignment_and_moves(spark):
    traces = [list("abcd"), list("acbd"), list("aed"), list("abd"), list("xbcd"), list("abcdd")]
    model = [list("abcd"), list("aed")]
    log = _log(spark, traces)
    got = {r["variant"]: r for r in J.nearest_trace_alignment(log, model).collect()}
    for t in traces:
        best = min(len(t) + len(m) - 2 * _lcs(t, m) for m in model)
        r = got[",".join(t)]
        assert r["cost"] == best
        assert abs(r["fitness"] - (1 - best / (len(t) + 3))) < 1e-6
    moves = {}
    for r in J.alignment_moves(log, model).collect():
        moves.setdefault(r["variant"], []).append((r["pos"], r["log_act"], r["model_act"]))
    for v, mv in moves.items():
        mv.sort()
        assert [l for _, l, _ in mv if l] == v.split(",")
        assert sum(1 for _, l, m in mv if l is None or m is None) == got[v]["cost"]
        assert all(l == m for _, l, m in mv if l and m)


def test_alpha_places_running_example(spark):
    log = _log(spark, [list("abcd"), list("acbd"), list("aed")])
    got = {(r["inputs"], r["outputs"]) for r in I.alpha_places(log).collect()}
    assert got == {("a", "b,e"), ("a", "c,e"), ("b,e", "d"), ("c,e", "d"), ("", "a"), ("d", "")}


@pytest.mark.parametrize("traces,cut,groups", [
    ([list("ab"), list("cd")], "xor", [{"a", "b"}, {"c", "d"}]),
    ([list("abc"), list("acb")], "sequence", [{"a"}, {"b", "c"}]),
    ([list("ab"), list("ba")], "parallel", [{"a"}, {"b"}]),
    ([list("a"), list("aba"), list("ababa")], "loop", [{"a"}, {"b"}]),
])
def test_activity_cut(spark, traces, cut, groups):
    rows = I.activity_cut(_log(spark, traces)).collect()
    assert {r["cut"] for r in rows} == {cut}
    by = {}
    for r in rows:
        by.setdefault((r["grp_order"], r["grp"]), set()).add(r["activity"])
    got = [v for _, v in sorted(by.items())]
    if cut in ("sequence", "loop"):
        assert got == groups
    else:
        assert sorted(map(sorted, got)) == sorted(map(sorted, groups))


def test_log_split_loop_pieces(spark):
    log = _log(spark, [list("ababa")])
    cut = I.activity_cut(log)
    out = sorted((r["sub_case"], r["activity"]) for r in I.log_split_by_cut(log, cut).collect())
    assert [s for s, _ in out] == ["c0#1", "c0#2", "c0#3", "c0#4", "c0#5"]


def _tree(spark, traces):
    rows = I.inductive_tree(_log(spark, traces)).collect()
    kids = {}
    nodes = {r["node"]: r for r in rows}
    for r in rows:
        kids.setdefault(r["parent"], []).append(r["node"])

    def show(n):
        r = nodes[n]
        if r["op"] == "activity":
            return r["activity"]
        ch = [show(c) for c in sorted(kids.get(n, []))]
        if r["op"] in ("xor", "parallel", "flower"):
            ch = sorted(ch)
        return f"{r['op']}({', '.join(ch)})"
    return show("0")


def test_inductive_tree(spark):
    assert _tree(spark, [list("abcd"), list("acbd")]) == "sequence(a, parallel(b, c), d)"
    assert _tree(spark, [list("ab"), list("cd")]) == "xor(sequence(a, b), sequence(c, d))"
    assert _tree(spark, [list("a"), list("aba"), list("ababa")]) == "loop(a, b)"
