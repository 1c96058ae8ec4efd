import random

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from .conftest import SF, edge_rows
from tracefold.llm import simhash as S


def plain_simhash(text, n=4):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ")
             .replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs):
    """``[(id, fingerprint)]`` to component ids by full comparison."""
    ids, fps = [i for i, _ in pairs], np.array([f for _, f in pairs], dtype=np.uint64)
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[k]) <= 4).tolist():
            parent[find(k)] = find(j)
    low = {}
    for k, i in enumerate(ids):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return [low.get(find(k)) for k in range(len(ids))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_whole_table(spark, docs):
    rows = docs.collect()
    fps = [plain_simhash(r["text"]) for r in rows]
    want = {r["doc_id"]: (f"{f:016x}", c) for r, f, c in
            zip(rows, fps, plain_components([(r["doc_id"], f) for r, f in zip(rows, fps)]))}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.op3_simhash(spark, SF).collect()}
    assert got == want


def test_edges(edge_docs, no_docs):
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"])
                  for r in S.near_duplicates(edge_docs).collect()))
    rows = [(i, plain_simhash(t)) for i, t, *_ in edge_rows()]
    want = sorted((i is None, i or 0, f"{f:016x}", c) for (i, f), c in zip(rows, plain_components(rows)))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == [w[3] for w in want]
    assert S.near_duplicates(no_docs).collect() == []


def random_fingerprints(n_centres, around, seed):
    """Centres with clusters of up to six flipped bits around each: links, chains and near misses."""
    r = random.Random(seed)
    out = set()
    for _ in range(n_centres):
        c = r.getrandbits(64)
        out.add(c)
        for _ in range(around):
            x = c
            for b in r.sample(range(64), r.randint(1, 6)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


def groups_of(spark, fps, **how):
    df = spark.createDataFrame([(i, signed(f)) for i, f in enumerate(fps)], "_id long, _fp long")
    return {r["_fp"]: r["component_id"] for r in S.near_groups(df, **how).collect()}


def test_links_lose_nothing(spark):
    for seed in (1, 2):
        fps = random_fingerprints(60, 12, seed)
        want = plain_components(list(enumerate(fps)))
        got = groups_of(spark, fps)
        assert [got[signed(f)] for f in fps] == want


def test_large_cells_in_blocks(spark):
    """One large cluster and low limits: the block path gives the same groups with few links."""
    fps = random_fingerprints(3, 250, 5)
    want = plain_components(list(enumerate(fps)))
    got = groups_of(spark, fps, cell_rows=8, block=32)
    assert [got[signed(f)] for f in fps] == want


def test_block_forest_is_a_forest():
    base = 0x0123456789ABCDEF
    near = [signed(base ^ (1 << b)) for b in range(40)]
    pdf = pd.DataFrame({"_fp": near + near, "_side": [0] * 40 + [1] * 40})
    links = S.block_forest(pdf)
    assert len(links) <= 80
    assert set(links["a"]) | set(links["b"]) == set(near)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100)] + [(200, k) for k in range(201, 230)]
    got = {r["node"]: r["root"] for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in (100, 101, 102)}, **{i: 200 for i in range(200, 230)}}


def test_keep_one(spark, docs, edge_docs, no_docs):
    rows = docs.collect()
    comp = plain_components([(r["doc_id"], plain_simhash(r["text"])) for r in rows])
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(comp))
    left = S.keep_one(edge_docs)
    assert left.columns == edge_docs.columns and left.dtypes == edge_docs.dtypes
    ids = [r["doc_id"] for r in left.collect()]
    assert sorted(x for x in ids if x is not None) == [1, 2, 4, 7, 8, 9, 10, 11, 12] and ids.count(None) == 1
    assert S.keep_one(no_docs).collect() == []


def test_documents_without_ids(spark):
    df = spark.createDataFrame([(None, "alpha beta gamma delta epsilon"), (None, "one two three four five"),
                                (None, "one two three four five")], "doc_id long, text string")
    assert sorted(r["text"] for r in S.keep_one(df).collect()) == ["alpha beta gamma delta epsilon", "one two three four five"]


def test_fingerprint_matches_spark_hash(spark):
    """The seed-42 XXH64 of a shingle is Spark's own function."""
    row = spark.range(1).select(F.xxhash64(F.lit("a b c d")).alias("h")).first()
    assert row["h"] == signed(xxhash.xxh64_intdigest(b"a b c d", 42))
