import re
from collections import Counter

from .conftest import SF, edge_rows
from tracefold.llm import mixing as M

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_targets(sizes):
    """``{source: words}`` to targets, sources by code point and None last."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        if not free:
            break
        unit = (total - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * unit > 2 * sizes[s]}
        if not over:
            break
        full |= over
    return {s: 2 * sizes[s] if s in full else weight[s] * unit for s in order}


def check(rows, sources, near):
    """``sources``: id to source; taken words within ``near`` of the target or the smallest document left."""
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[sources[r["doc_id"]]] += r["size"]
        taken[sources[r["doc_id"]]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
    want = plain_targets(dict(sizes))
    for r in rows:
        s = sources[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= near * max(1, want[s]), (s, taken[s], want[s])


def test_whole_table(spark, docs):
    rows = M.op1_mix(spark, SF).collect()
    text = {r["doc_id"]: r for r in docs.collect()}
    assert len(rows) == len(text)
    assert all(r["size"] == len(WORD.findall(text[r["doc_id"]]["text"])) for r in rows)
    check(rows, {i: r["source"] for i, r in text.items()}, 0.05)


def test_reruns_agree(spark, docs):
    one, two = (sorted(M.mix_report(d).collect()) for d in (docs, docs.repartition(7)))
    assert one == two


def test_hot_source_and_size(spark):
    """A third of all rows share source and size: copies are dealt evenly, the target is met."""
    rows = [(i, "a b c d", "hot") for i in range(600)] + [(1000 + i, "w " * (1 + i % 90), f"s{i % 7}") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = M.mix_report(df).collect()
    check(got, {i: s for i, _, s in rows}, 0.02)
    assert len({r["copies"] for r in got if r["doc_id"] < 1000}) <= 2


def test_tilt_is_exponential_in_words(spark):
    """Before rounding, log odds of the rates are one line in the words of a document."""
    import math
    groups = spark.createDataFrame([("aone", s, 5) for s in range(1, 40)] + [("atwo", s, 3) for s in range(5, 25)],
                                   "_k string, _size long, _n long")
    goals = M.targets(groups)
    rated = M.balance(groups, goals).collect()
    for k in ("aone", "atwo"):
        mine = sorted((r["_size"], r["_r"]) for r in rated if r["_k"] == k)
        target = next(r["target"] for r in rated if r["_k"] == k)
        n = 5 if k == "aone" else 3
        assert abs(sum(s * r * n for s, r in mine) - target) <= 1e-3 * target
        odds = [math.log(r / (2 - r)) / s for s, r in mine if 0 < r < 2]
        assert not odds or max(odds) - min(odds) < 1e-9


def test_edges(spark, edge_docs, no_docs):
    rows = M.mix_report(edge_docs).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in rows) == sorted(
        (str(i), len(WORD.findall(t or ""))) for i, t, *_ in edge_rows())
    assert M.mix_report(no_docs).collect() == []
    mixed = M.mixed_rows(edge_docs)
    assert mixed.columns == edge_docs.columns
    assert mixed.count() == sum(r["copies"] for r in rows)
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r["taken"], r["target"]) for r in M.mix_report(empty).collect()} == {(0, 0.0)}


def test_mix_holds_documents_as_often_as_taken(docs):
    report = {r["doc_id"]: r["copies"] for r in M.mix_report(docs).collect()}
    assert Counter(r["doc_id"] for r in M.mixed_rows(docs).collect()) == Counter({i: c for i, c in report.items() if c})
