from fractions import Fraction

import duckdb
import numpy as np

from .conftest import SF
from tracefold.llm import neighbours as N


def plain(rows, queries, k=10):
    out = {}
    for q, x in queries:
        near = sorted((float(np.sqrt(np.cumsum((np.array(x) - np.array(y)) ** 2)[-1])), i) for i, y in rows
                      if i != q and len(y) == len(x))
        out[q] = [(r + 1, i, s) for r, (s, i) in enumerate(near[:k])]
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_against_brute_force_and_sql(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = by_query(N.op8_nearest(spark, SF))
    assert got == plain(rows, [r for r in rows if r[0] % 100 == 0])
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{SF}/embeddings.parquet')")
    sql = {}
    for q, r, i, s in sorted(con.execute(N.OP8_SQL).fetchall()):
        sql.setdefault(q, []).append((r, i, s))
    assert got == sql


def test_any_finite_vector(spark):
    """Components whose squares overflow or vanish, beside ordinary ones, in one tile and in many."""
    rng = np.random.default_rng(5)
    scale = [1e200, 1e-200, 1.0, 1e-310, 1e307, 1e150]
    rows = [(i, (rng.normal(size=6).clip(-1, 1) * scale[i % 6]).tolist()) for i in range(240)]

    tiny = Fraction(1, 10**600)

    def exact(x, y):
        return sum((Fraction(a) - Fraction(b)) ** 2 for a, b in zip(x, y))

    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = {}
    for q, x in rows:
        if q % 20 < 6:
            want[q] = [exact(x, y) for i, y in rows if i != q]
            want[q].sort()
    for tile, held in ((4096, N.HELD), (16, 1)):
        N.HELD = held
        got = by_query(N.nearest(df, df.filter("vec_id % 20 < 6"), tile=tile, query_block=7))
        N.HELD = 64 << 20
        vec = dict(rows)
        assert set(got) == set(want)
        for q, near in got.items():
            assert [r for r, *_ in near] == list(range(1, 11))
            for (_, i, s), w in zip(near, want[q]):
                d = exact(vec[q], vec[i])
                # the rounding of doubles may swap what differs less
                assert abs(d - w) <= w / 10**12 and abs(Fraction(s) ** 2 - d) <= d / 10**12 or w < tiny


def test_small_tiles_ties_and_scales(spark):
    """Many tiles and blocks, one vector held by a third of the rows, huge and tiny lengths."""
    rng = np.random.default_rng(3)
    common = rng.normal(size=8).tolist()
    rows = [(i, common if i % 3 == 0 else (rng.normal(size=8) * 10.0 ** rng.integers(-3, 4)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = by_query(N.nearest(df, df.filter("vec_id % 20 = 0"), tile=32, query_block=8))
    assert got == plain(rows, [r for r in rows if r[0] % 20 == 0])


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []),
            (7, [1.0, 2.0, 3.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (None, [1.0, 1.0]), (20, [5.0, 5.0]), (20, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows],
                               "vec_id long, embedding array<double>, rank string, _id string")
    got = by_query(N.nearest(df, df.filter("vec_id % 20 = 0")))
    sound = [(0, [1.0, 0.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (20, [5.0, 5.0]), (20, [1.0, 1.0])]
    assert got == plain(sound, [(0, [1.0, 0.0]), (20, [1.0, 1.0])])
    none = df.limit(0)
    assert N.nearest(none, none).collect() == []
    assert N.nearest(df, none).collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(9)
    q, c = rng.normal(size=(20, 1500)), rng.normal(size=(300, 1500))     # more dimensions than one exact chunk
    a, b = N.Side(np.arange(20), q), N.Side(np.arange(100, 400), c)
    rows, ids, found = N.tile_nearest(a, b, 5, np.full(20, np.inf))
    full = np.sqrt(((q[:, None] - c[None]) ** 2).sum(-1))
    for r in range(20):
        assert ids[rows == r].tolist() == (np.argsort(full[r])[:5] + 100).tolist()
