"""SimHash near-dedup with pigeonring filtering (operator 3)."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed

SHINGLE = 4      # words
MAX_BITS = 4     # differing bits of a link
SEED = 42
# A ring of five segments of the 64 bits: (shift, width).
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
# Cells that hold more fingerprints than this are compared in blocks of BLOCK.
CELL_ROWS = 1000
BLOCK = 2048
HASHES_AT_ONCE = 1 << 16

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a whole text; zero without words."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    last = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    first = np.concatenate(([0], ends[:len(last) - 1] + 1))
    ones, n = np.zeros(64, dtype=np.int64), len(last)
    for at in range(0, n, HASHES_AT_ONCE):
        part = np.array([digest(joined[a:z], SEED) for a, z in
                         zip(first[at:at + HASHES_AT_ONCE].tolist(), last[at:at + HASHES_AT_ONCE].tolist())],
                        dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, shingle) for t in texts], dtype="int64")

    return each(text)


def _mask(shift: int, width: int) -> int:
    m = ((1 << width) - 1) << shift
    return m - (1 << 64) if m >= 1 << 63 else m


def _ring(start: int, n: int) -> int:
    """Mask of ``n`` consecutive segments from ``start``, as a signed 64-bit number."""
    m = reduce(lambda a, k: a | _mask(*SEGMENTS[(start + k) % len(SEGMENTS)]) % (1 << 64), range(n), 0)
    return m - (1 << 64) if m >= 1 << 63 else m


def _cell(fp: Column, start: int) -> Column:
    """The two segments from ``start`` and the start itself as one key."""
    (s1, w1), (s2, w2) = SEGMENTS[start], SEGMENTS[(start + 1) % len(SEGMENTS)]
    part = lambda s, w: F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1).cast("long"))
    return (part(s1, w1) * (1 << (w2 + 3)) + part(s2, w2) * 8 + start).cast("long")


def _budget(length: int) -> int:
    return MAX_BITS * length // len(SEGMENTS)


def candidates(fps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index rows and probe rows ``(_cell, _fp)`` of distinct fingerprints.

    Pigeonring: of two fingerprints within the budget, some chain of
    consecutive segments of the ring keeps every prefix within its
    proportional share of the budget. With four bits over five segments the
    first segment must be equal and the first two may differ in one bit. The
    index holds each fingerprint under its own two segments, from each start;
    a probe looks there and under each cell that has one more bit set in the
    second segment. A one-bit difference is thus met from the side with the
    zero bit only: every pair once per chain.
    """
    fp = F.col("_fp")
    own = [_cell(fp, k) for k in range(len(SEGMENTS))]
    probes = []
    for k in range(len(SEGMENTS)):
        shift, width = SEGMENTS[(k + 1) % len(SEGMENTS)]
        probes += [F.when(fp.bitwiseAND(F.lit(_mask(shift + bit, 1))) == 0, own[k] + (8 << bit)) for bit in range(width)]
    index = fps.select("_fp", F.explode(F.array(*own)).alias("_cell"))
    probe = fps.select("_fp", F.explode(F.filter(F.array(*own, *probes), lambda c: c.isNotNull())).alias("_cell"))
    return index, probe


def chain_holds(a: Column, b: Column, cell: Column) -> Column:
    """The longer prefixes of the chain, then the full distance; equal cells meet once."""
    diff = a.bitwiseXOR(b)
    start = cell.bitwiseAND(F.lit(7).cast("long"))
    ok = F.lit(False)
    for k in range(len(SEGMENTS)):
        prefixes = [F.bit_count(diff.bitwiseAND(F.lit(_ring(k, n)))) <= _budget(n) for n in range(2, len(SEGMENTS))]
        ok = F.when(start == k, reduce(lambda x, y: x & y, prefixes)).otherwise(ok)
    second = F.lit(0).cast("long")
    for k in range(len(SEGMENTS)):
        second = F.when(start == k, diff.bitwiseAND(F.lit(_mask(*SEGMENTS[(k + 1) % len(SEGMENTS)])))).otherwise(second)
    return ok & (F.bit_count(diff) <= MAX_BITS) & ((second != 0) | (a < b))


def links(fps: DataFrame, cell_rows: int = CELL_ROWS, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` that connect exactly the fingerprints a full comparison connects.

    Ordinary cells are joined and return all their links. A cell that holds
    more than ``cell_rows`` fingerprints is cut on both sides into blocks of
    about ``block``; each pair of blocks is one bounded task, which returns
    only a spanning forest of the links it finds, so a large group of near
    copies never becomes all its pairs.
    """
    index, probe = candidates(fps)
    large = checkpointed(index.groupBy("_cell").agg(F.count(F.lit(1)).alias("_i")).filter(F.col("_i") > cell_rows))
    any_heavy = large.limit(1).count() > 0
    if any_heavy:
        probes = probe.join(large.select("_cell"), "_cell", "left_semi").groupBy("_cell").agg(
            F.count(F.lit(1)).alias("_p"))
        heavy = checkpointed(large.join(probes, "_cell").select(
            "_cell", F.ceil(F.col("_i") / block).cast("int").alias("_ib"),
            F.ceil(F.col("_p") / block).cast("int").alias("_pb")))
    a, b = F.col("a._fp"), F.col("b._fp")
    if any_heavy:
        index_light, probe_light = (x.join(heavy.select("_cell"), "_cell", "left_anti") for x in (index, probe))
    else:
        index_light, probe_light = index, probe
    found = (probe_light.alias("a").join(index_light.alias("b"), (F.col("a._cell") == F.col("b._cell"))
                                         & chain_holds(a, b, F.col("a._cell")))
             .select(a.alias("a"), b.alias("b")))
    if any_heavy:
        blocks = lambda n, me: F.pmod(F.xxhash64("_fp", F.lit(me)), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        left = (probe.join(heavy, "_cell").withColumn("_x", blocks(F.col("_pb"), 1))
                .select("_cell", "_fp", "_x", every(F.col("_ib")).alias("_y"), F.lit(0).alias("_side")))
        right = (index.join(heavy, "_cell").withColumn("_y", blocks(F.col("_ib"), 2))
                 .select("_cell", "_fp", every(F.col("_pb")).alias("_x"), "_y", F.lit(1).alias("_side")))
        found = found.unionByName(left.unionByName(right).groupBy("_cell", "_x", "_y").applyInPandas(
            block_forest, "a long, b long"))
    return found.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def block_forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Spanning forest of the links between the two blocks of one group."""
    import numpy as np

    left = pdf.loc[pdf["_side"] == 0, "_fp"].to_numpy()
    right = pdf.loc[pdf["_side"] == 1, "_fp"].to_numpy()
    new_left, new_right = np.ones(len(left), bool), np.ones(len(right), bool)
    a, b = [], []
    near = lambda x, many: np.bitwise_count((many ^ x).view(np.uint64)) <= MAX_BITS
    for root in range(len(left)):
        if not new_left[root]:
            continue
        new_left[root], todo = False, [(0, root)]
        while todo:
            side, at = todo.pop()
            x, many, new = (left[at], right, new_right) if side == 0 else (right[at], left, new_left)
            rest = np.flatnonzero(new)
            if not len(rest):
                continue
            hit = rest[near(x, many[rest])]
            new[hit] = False
            a += [x] * len(hit)
            b += many[hit].tolist()
            todo += [(1 - side, k) for k in hit.tolist()]
    return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every linked node, root the smallest node of its component.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): in
    each, a node's neighbours are hung on its smallest one, by grouped
    minimum and join; each round is checkpointed. Ends when a round changes
    nothing, compared by count and a hash sum of the edges.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = (e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large
                else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("_m"))
        hung = both.join(low, "a")
        if large:
            out = hung.filter("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        else:
            out = hung.select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(
                low.select("a", F.col("_m").alias("b")))
        return out.filter("a <> b").distinct()

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    seen = state(now)
    while seen[0]:
        now = checkpointed(star(star(now, True), False))
        new = state(now)
        if new == seen:
            break
        seen = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def near_groups(hashed: DataFrame, **how) -> DataFrame:
    """``(_fp, _group, component_id)`` of every distinct fingerprint in rows ``(_id, _fp)``."""
    fps = checkpointed(hashed.groupBy("_fp").agg(F.min("_id").alias("_first")))
    roots = components(links(fps.select("_fp"), **how))
    # linked fingerprints only: one row each, grouped by root, then carried back
    linked = fps.join(roots, fps["_fp"] == roots["node"]).select("_fp", "root", "_first")
    lowest = linked.groupBy("root").agg(F.min("_first").alias("_low"))
    named = linked.join(lowest, "root").select(F.col("_fp").alias("_k"), "root", "_low")
    return fps.join(named, fps["_fp"] == named["_k"], "left").select(
        "_fp", F.coalesce("root", "_fp").alias("_group"), F.coalesce("_low", "_first").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, **how) -> DataFrame:
    """Fingerprint and group of every document.

    Texts are fingerprinted once; from there only distinct fingerprints are
    compared, so exact copies cost nothing. Links are all pairs of
    fingerprints at most four bits apart, found by the pigeonring chains;
    groups are their connected components.

    Returns id, ``fingerprint`` (16 lowercase hex digits) and
    ``component_id``, the smallest id reachable (null only where every id of
    the group is null). Null and wordless texts have fingerprint zero and
    link like any other; a repeated row is a row of its own in the same
    group; an empty table gives no rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    hashed = checkpointed(docs.select(F.col(id_col).alias("_id"),
                                      fingerprint(F.col(text_col), shingle).alias("_fp")))
    groups = near_groups(hashed, **how)
    return hashed.join(groups, "_fp").select(
        F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = SHINGLE, **how) -> DataFrame:
    """The documents without near copies: of each group the row with the smallest id stays.

    Ties (a repeated id) go to the smallest hash of the text; of rows equal
    in both, one stays. Null ids come last. Columns are those of ``docs``;
    an empty table stays empty.
    """
    bounded_batches(docs.sparkSession)
    keys = {"_tf_none": F.col(id_col).isNull(), "_tf_id": F.coalesce(F.col(id_col).cast("string"), F.lit("")),
            "_tf_hash": F.xxhash64(text_col)}
    slim = checkpointed(docs.select(F.col(id_col).alias("_id"), fingerprint(F.col(text_col), shingle).alias("_fp"),
                                    *[c.alias(n) for n, c in keys.items()]))
    row = F.struct("_tf_none", "_id", "_tf_hash", "_tf_id")
    best = (slim.join(near_groups(slim, **how), "_fp").groupBy("_group").agg(F.min(row).alias("_best"))
            .select(*[F.col("_best")[n].alias(n) for n in keys]))
    # one exchange of the texts: the join's keys also single out repeated rows
    return (docs.withColumns(keys).join(best, list(keys), "left_semi")
            .dropDuplicates(list(keys)).drop(*keys))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate group of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
