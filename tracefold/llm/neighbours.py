"""Exact nearest neighbours by a block matrix join on int8 codes (operator 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed

K = 10
TILE = 4096           # candidates in a tile
QUERY_BLOCK = 1024    # queries in a block
LEVELS = 127          # of the int8 codes
EXACT_DIMS = 1024     # float32 sums of this many code products are whole numbers below 2^24
PAIRS_AT_ONCE = 1 << 16
HEAP_QUERIES = 100_000  # whose heaps a task holds before it hands them on
HELD = 64 << 20         # bytes of candidates that a task holds, in tiles


def usable(vec):
    """Finite, non-null, non-zero vectors; the others take no part."""
    v = vec.cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return sound & F.exists(v, lambda x: x != 0)


def quantise(x):
    """int8 codes (as float32), scales and the length of what rounding lost, per row."""
    import numpy as np

    top = np.abs(x).max(axis=1)
    scale = np.where(top / LEVELS > 0, top / LEVELS, 1.0)
    codes = np.rint(x / scale[:, None])
    with np.errstate(over="ignore"):    # a bound beyond all numbers excludes nothing
        return codes.astype(np.float32), scale, np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))


class Side:
    """A block of vectors with what the bounds need."""

    def __init__(self, ids, x):
        import numpy as np

        self.ids, self.x = ids, x
        self.codes, self.scale, self.lost = quantise(x)
        with np.errstate(over="ignore"):
            self.norm2 = (x * x).sum(axis=1)
            self.kept = np.sqrt(((self.codes.astype(np.float64) * self.scale[:, None]) ** 2).sum(axis=1))


def code_products(a, b):
    """Products of the code tiles: exact whole numbers, dimension chunk by chunk."""
    import numpy as np

    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT_DIMS):
        out += a[:, at:at + EXACT_DIMS] @ b[:, at:at + EXACT_DIMS].T
    return out


def distances(q, c):
    """Euclidean distances of paired rows, summed dimension by dimension in double precision.

    Where a sum of squares leaves the range of doubles on either side, it is
    formed again of components divided by a power of two, which is exact.
    """
    import numpy as np

    def root(a, b):
        total = np.zeros(len(a))
        for k in range(a.shape[1]):
            d = a[:, k] - b[:, k]
            total += d * d
        return np.sqrt(total)

    with np.errstate(over="ignore", invalid="ignore"):
        out = root(q, c)
    odd = np.flatnonzero(~(out < 1e150) | (out < 1e-140))
    if len(odd):
        top = np.maximum(np.abs(q[odd]).max(axis=1), np.abs(c[odd]).max(axis=1))
        shift = np.frexp(top)[1][:, None]
        with np.errstate(over="ignore"):
            out[odd] = np.ldexp(root(np.ldexp(q[odd], -shift), np.ldexp(c[odd], -shift)), shift[:, 0])
    return out


def tile_nearest(queries: Side, tile: Side, k: int, limit):
    """Up to ``k`` nearest of the tile per query: ``(query row, id, distance)`` lists.

    The int8 product and the two rounding losses bound each squared distance
    from both sides (Cauchy-Schwarz). A pair survives if its lower bound is
    not above the k-th upper bound of its query nor above ``limit``, the
    k-th distance found in earlier tiles; survivors are measured on the
    original vectors. Bounds are widened by the rounding of the sums, also
    of the smallest numbers; where a bound leaves the range of doubles it
    excludes nothing.
    """
    import numpy as np

    own = queries.ids[:, None] == tile.ids[None, :]
    with np.errstate(over="ignore", invalid="ignore"):
        dot = code_products(queries.codes, tile.codes) * (queries.scale[:, None] * tile.scale[None, :])
        slack = (queries.lost[:, None] * tile.kept[None, :] + queries.kept[:, None] * tile.lost[None, :]
                 + queries.lost[:, None] * tile.lost[None, :])
        square = queries.norm2[:, None] + tile.norm2[None, :]
        slack = 2 * slack + 1e-12 * square + 1e-290
        middle = square - 2 * dot
        upper = np.where(own | np.isnan(middle + slack), np.inf, middle + slack)
        cut = np.partition(upper, k - 1, axis=1)[:, k - 1] if upper.shape[1] > k else np.full(len(upper), np.inf)
        cut = np.minimum(cut, limit * limit * (1 + 1e-12))
        rows, cols = np.nonzero(~(middle - slack > cut[:, None]) & ~own)
    found = np.empty(len(rows))
    for at in range(0, len(rows), PAIRS_AT_ONCE):
        s = slice(at, at + PAIRS_AT_ONCE)
        found[s] = distances(queries.x[rows[s]], tile.x[cols[s]])
    order = np.lexsort((tile.ids[cols], found, rows))
    rows, ids, found = rows[order], tile.ids[cols[order]], found[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    near = rank < k
    return rows[near], ids[near], found[near]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding",
            tile: int = TILE, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The exact ``k`` nearest candidates of each query by Euclidean distance.

    Candidates are dealt into tasks of a few tiles, as many as ``HELD`` bytes
    hold, queries into blocks; every query block is sent once to every task
    as one bounded row group (queries against all rows in blocks, no cross
    join). A task holds its tiles and one query block: it multiplies int8
    codes, drops the pairs that the error bounds exclude, measures the rest
    in double precision and keeps a heap of ``k`` per query over its tiles;
    a window merges the heaps of the tasks. Any finite vector has its place,
    also where its square leaves the range of doubles.

    Returns ``query_id``, ``rank``, ``vec_id``, ``score``; ties go to the
    smaller id; fewer candidates than ``k`` give fewer rows. Vectors that are
    null, zero or hold null or non-finite components take no part, nor do
    rows without an id; vectors of another length are no candidates. Rows
    with the query's id are its own; other repeated rows are candidates
    each; of repeated queries the smallest vector asks. Empty tables give no
    rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    pick = lambda df: df.filter(F.col(id_col).isNotNull() & usable(F.col(vec_col))).select(
        F.col(id_col).cast("long").alias("_id"), F.col(vec_col).cast("array<double>").alias("_v"))
    asks = checkpointed(pick(queries).groupBy("_id").agg(F.min("_v").alias("_v")))
    rows = pick(vectors)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_v")).alias("d")).first()
    if not size["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    held = max(tile, HELD // (12 * size["d"]) // tile * tile)     # a component and its code are twelve bytes
    n_tasks, n_blocks = -(-size["n"] // held), max(1, -(-asks.count() // query_block))
    dealt = lambda parts: F.pmod(F.xxhash64("_id", "_v"), parts).cast("int")
    candidates = rows.select(dealt(n_tasks).alias("_task"), F.lit(0).alias("_block"), "_id", "_v")
    blocks = (asks.withColumn("_block", 1 + dealt(n_blocks))
              .select(F.explode(F.sequence(F.lit(0), F.lit(n_tasks - 1))).alias("_task"), "_block", "_id", "_v"))
    # a task's candidates come first in its partition, then the query blocks, one after the other
    sent = (candidates.unionByName(blocks).repartitionById(n_tasks, "_task").sortWithinPartitions("_block"))
    found = sent.mapInArrow(search(k, tile), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def search(k: int, tile: int):
    """Task code: holds its candidates in tiles, one query block at a time, and heaps of a bounded number of queries."""
    def run(batches):
        import heapq

        import numpy as np
        import pyarrow as pa

        heaps: dict[int, list] = {}

        def by_length(chunks, most):
            ids, flat, lengths = (np.concatenate(x) for x in zip(*chunks))
            ends = np.cumsum(lengths)
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                for lo in range(0, len(at), most):
                    some = at[lo:lo + most]
                    yield Side(ids[some], flat[(ends[some] - d)[:, None] + np.arange(d)])

        def drained():
            rows = [(q, -i, -s) for q, heap in heaps.items() for s, i in heap]
            heaps.clear()
            q, i, s = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()),
                                               pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

        def measure(chunks, tiles):
            for block in by_length(chunks, tile):
                for part in (t for t in tiles if t.x.shape[1] == block.x.shape[1]):
                    limit = np.array([-heaps[q][0][0] if len(heaps.get(q, ())) == k else np.inf
                                      for q in block.ids.tolist()])
                    for r, i, s in zip(*(x.tolist() for x in tile_nearest(block, part, k, limit))):
                        heap = heaps.setdefault(int(block.ids[r]), [])
                        item = (-s, -i)
                        if len(heap) < k:
                            heapq.heappush(heap, item)
                        elif item > heap[0]:
                            heapq.heapreplace(heap, item)

        key, waiting, tiles = None, [], []

        def finished():
            if key == 0:
                tiles.extend(by_length(waiting, tile))
            elif key:
                measure(waiting, tiles)

        for b in batches:
            blocks = b.column("_block").to_numpy()
            edges = np.flatnonzero(np.diff(blocks) != 0) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(blocks)]):
                if lo == hi:
                    continue
                if blocks[lo] != key:
                    finished()
                    if len(heaps) > HEAP_QUERIES:
                        yield drained()
                    key, waiting = int(blocks[lo]), []
                part = b.slice(lo, hi - lo)
                vec = part.column("_v")
                waiting.append((part.column("_id").to_numpy(), vec.flatten().to_numpy(zero_copy_only=False),
                                np.diff(vec.offsets.to_numpy())))
        finished()
        if heaps:
            yield drained()

    return run


def op8_nearest(spark, sf_dir: str) -> DataFrame:
    """Ten nearest neighbours of every hundredth vector."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


OP8_SQL = """
with v as (select vec_id, embedding::double[] as e from embeddings
           where embedding is not null and vec_id is not null
             and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
             and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as (select q.vec_id as query_id, c.vec_id,
                 sqrt(list_reduce(list_transform(range(1, len(q.e) + 1),
                      lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) as score
          from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e)
          where q.vec_id % 100 = 0),
ranked as (select query_id, row_number() over (partition by query_id order by score, vec_id) as r, vec_id, score
           from pairs)
select query_id, r::int as rank, vec_id, score from ranked where r <= 10
"""
