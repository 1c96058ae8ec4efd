import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from .conftest import SF, doc_schema, edge_rows
from tracefold.llm import audit as A

LABELS = "doc_id long, quality int, toxic int, source string"


def plain(rows, filters="ABCDE"):
    """``rows``: (part, set of failing filters, good, toxic). Each order applied filter by filter."""
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = defaultdict(int)
        for order in itertools.permutations(filters):
            left = list(mine)
            for step, f in enumerate(order, 1):
                before, hit = left, [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(hit)
                out[part, "".join(order), step] = [
                    len(left), len(hit), sum(f in r[1] for r in mine) - len(hit), sum(r[1] == {f} for r in mine),
                    sum(r[2] for r in hit), sum(r[3] for r in hit), f]
                assert len(before) == len(left) + len(hit)
        for key, row in out.items():
            if key[0] == part:
                row[6] = shapley[row[6]] if isinstance(row[6], str) else row[6]
    return {k: tuple(v) for k, v in out.items()}


def failing(docs, labels):
    """Rows for ``plain`` from documents (id, text, source) and labels (id, quality, toxic)."""
    white = "\x20\t\n\x0b\x0c\r"
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    rows = []
    for i, t, source in docs:
        text = t or ""
        words = [w for w in "".join(" " if c in white else c for c in text).split(" ") if w]
        bad = set()
        if len(words) < 200:
            bad.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            bad.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text):
            bad.add("C")
        if any(c in "#$%&*|" for c in text):
            bad.add("D")
        if i is not None and first[text] < i:
            bad.add("E")
        mine = [x for x in labels if x[0] == i and i is not None]
        rows.append((source or "", bad, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    return rows


def as_dict(df):
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"],
                                                        r["good_lost"], r["toxic_lost"], r["shapley"]) for r in df.collect()}


def test_whole_table(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    docs = [tuple(r) for r in read("documents").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in read("labels").select("doc_id", "quality", "toxic").collect()]
    got = A.op12_audit(spark, SF)
    assert as_dict(got) == plain(failing(docs, labels)) and got.count() == 600 * len({s or "" for _, _, s in docs})


@pytest.mark.parametrize("span", [1, 7, 1 << 16])
def test_random_flags_in_ranges(spark, span, monkeypatch):
    """Posting lists cut into ranges of any size give the same sums; three filters, three marks."""
    r = random.Random(span)
    rows = [(r.choice(["x", "y", "", None]), *[r.choice([True, False, None]) for _ in range(5)]) for _ in range(200)]
    df = spark.createDataFrame(rows, "part string, P boolean, Q boolean, R boolean, good boolean, toxic boolean").repartition(3)
    monkeypatch.setattr(A.posting_lists, "__defaults__", ("part", span))
    want = plain([(p or "", {f for f, v in zip("PQR", flags) if v}, bool(flags[3]), bool(flags[4])) for p, *flags in rows], "PQR")
    assert as_dict(A.audit(df, ["P", "Q", "R"])) == want


def test_posting_lists(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("part"), (F.col("id") % 2 == 0).alias("A"),
                                  F.lit(False).alias("m"))
    lists = A.posting_lists(df, ["A"], ["m"], span=100).collect()
    assert sum(x["n"] for x in lists) == 1000 and sum(len(x["A"]) for x in lists) == 500
    assert all(x["A"] == sorted(x["A"]) and not x["m"] and len(x["A"]) <= x["n"] <= 100 for x in lists)


def test_merges():
    r = random.Random(1)
    for _ in range(200):
        lists = [np.array(sorted(r.sample(range(60), r.randint(0, 40))), np.int64) for _ in range(r.randint(1, 5))]
        assert A.union(lists).tolist() == sorted(set().union(*map(set, map(np.ndarray.tolist, lists))))
        there, _ = A.gallop(lists[0], lists[-1])
        assert lists[0][there].tolist() == sorted(set(lists[0].tolist()) & set(lists[-1].tolist()))


def test_edges(spark, edge_docs, no_docs):
    """Null ids, texts and sources, repeated ids, repeated and contradictory labels, clashing columns."""
    labels = [(1, 1, 0, "z"), (1, 0, 1, "z"), (5, 1, None, None), (None, 1, 1, None), (7, None, 1, "s"), (99, 1, 1, "s")]
    got = A.audit(A.filtered(edge_docs, spark.createDataFrame(labels, LABELS)))
    assert as_dict(got) == plain(failing([(i, t, s) for i, t, _, s, *_ in edge_rows()], labels))
    none = spark.createDataFrame([], LABELS)
    assert as_dict(A.audit(A.filtered(edge_docs, none))) == plain(failing([(i, t, s) for i, t, _, s, *_ in edge_rows()], []))
    assert A.audit(A.filtered(no_docs, none)).collect() == []


def test_hot_text(spark, monkeypatch):
    """A text that a third of all rows share goes the broadcast way, the others the shuffled one."""
    rows = [(i, "same" if i % 3 == 0 else f"text {i // 4}", None, f"s{i % 2}", 1, "", "", "", "") for i in range(600)]
    docs = spark.createDataFrame(rows, doc_schema())
    want = plain(failing([(i, t, s) for i, t, _, s, *_ in rows], []))
    none = spark.createDataFrame([], LABELS)
    for heavy in (1000, 10, 1):
        monkeypatch.setattr(A, "HEAVY", heavy)
        assert as_dict(A.audit(A.filtered(docs, none))) == want
