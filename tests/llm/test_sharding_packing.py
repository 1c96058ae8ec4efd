import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from .conftest import SF, edge_rows
from tracefold.llm import packing, sharding


def check_shards(rows, expect, n):
    total = sum(r["size"] for r in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted(expect)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) <= set(range(n))
    for k, members in by.items():
        assert sorted(m["slot"] for m in members) == list(range(len(members)))
        biggest = max(r["size"] for r in rows)
        assert abs(sum(m["size"] for m in members) - total / n) <= biggest


def test_shards_of_equal_bytes(spark, docs):
    rows = sharding.op9_shards(spark, SF).collect()
    expect = [(str(r["doc_id"]), len(r["text"].encode()) + 8, zlib.crc32(r["text"].encode())) for r in docs.collect()]
    check_shards(rows, expect, 24)
    assert {r["law"] for r in rows} == {"bytes"}


def test_shards_edges(edge_docs, no_docs):
    rows = sharding.balanced_shards(edge_docs, 3).collect()
    expect = [(str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in edge_rows()]
    check_shards(rows, expect, 3)
    assert sharding.balanced_shards(no_docs, 3).collect() == []
    assert {r["shard"] for r in sharding.balanced_shards(edge_docs, 1).collect()} == {0}


def test_copies_stand_together(spark):
    df = spark.createDataFrame([(i, "copy" if i % 3 else f"text {i}") for i in range(300)], "doc_id long, text string")
    rows = sorted(sharding.balanced_shards(df, 4).collect(), key=lambda r: (r["shard"], r["slot"]))
    copies = [k for k, r in enumerate(rows) if r["doc_id"] % 3]
    assert copies == list(range(copies[0], copies[0] + 200))


def test_written_shards(spark, docs, tmp_path):
    shards = sharding.balanced_shards(docs, 5)
    sharding.write_shards(docs, shards, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 5


def check_pieces(rows, tokens, length):
    """Every id in one piece, sequences gapless, only the last one short."""
    seen, by = {}, {}
    for r in rows:
        seen.setdefault(str(r["doc_id"]), []).append(r)
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, ids in tokens.items():
        pieces = sorted(seen.pop(i), key=lambda r: r["start"])
        copies = len([p for p in pieces if p["start"] == 0])
        assert sum(p["length"] for p in pieces) == copies * len(ids)
        for p in pieces:
            part = np.array(ids[p["start"]:p["start"] + p["length"]], dtype="<u4").tobytes()
            assert p["ids"] == part and p["doc_tokens"] == len(ids)
    assert not seen
    for k, parts in by.items():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at == length or k == max(by)
    assert sorted(by) == list(range(len(by)))


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.tokenizer_file())


def test_packed_ids(spark, docs, tokenizer):
    rows = packing.pack_along_curve(docs, packing.tokenizer_file()).collect()
    tokens = {str(r["doc_id"]): tokenizer.encode(r["text"], add_special_tokens=False).ids + [1] for r in docs.collect()}
    check_pieces(rows, tokens, 2048)
    digest = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in packing.op2_pack(spark, SF).collect()}
    assert digest == {(r["doc_id"], r["start"]): zlib.crc32(r["ids"]) for r in rows}


def test_packing_edges(edge_docs, no_docs, tokenizer):
    rows = packing.pack_along_curve(edge_docs, packing.tokenizer_file(), length=64).collect()
    tokens = {str(i): tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t, *_ in edge_rows()}
    check_pieces(rows, tokens, 64)
    assert packing.pack_along_curve(no_docs, packing.tokenizer_file()).collect() == []


def test_sequences_round_trip(docs, tokenizer):
    pieces = packing.pack_along_curve(docs, packing.tokenizer_file())
    whole = packing.sequences(pieces).collect()
    n = sum(len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert sum(len(r["ids"]) // 4 for r in whole) == n
    assert all(len(r["ids"]) == 4 * 2048 for r in whole if r["sequence_id"] < len(whole) - 1)


def test_word_encoder_against_tokenizer(tokenizer):
    import random

    r, encoder = random.Random(4), packing.WordEncoder(packing.tokenizer_file())
    signs = "aBcÉéßſKİiΣσς.,'s-_ 12²½ª́e​\xa0 　\x1c\n\t你好🙂'll 'S İİ<|endoftext|>"
    for _ in range(4000):
        t = "".join(r.choice(signs) for _ in range(r.randint(0, 30)))
        got = np.frombuffer(encoder.text(t), "<u2").tolist()
        assert got == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_word_encoder_remembers_within_bounds(tokenizer, monkeypatch):
    """What a worker remembers is bounded in bytes as well as in pieces; forgetting costs no id."""
    import random
    import tracemalloc

    import pyarrow as pa
    import tokenizers

    monkeypatch.setattr(tokenizers, "_tracefold_memory", {}, raising=False)
    r, encoder = random.Random(7), packing.WordEncoder(packing.tokenizer_file())
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(120_000)]
    texts = [" ".join(words[k:k + 20_000]) for k in range(0, len(words), 20_000)]
    encoder.text(texts[0])
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    for t in texts[1:]:
        encoder.text(t)
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert held < 10_000_000
    monkeypatch.setattr(packing, "CACHE_PIECES", 1_000)
    for t in texts[::-2]:
        assert np.frombuffer(encoder.text(t + " one, Two!"), "<u2").tolist() == tokenizer.encode(
            t + " one, Two!", add_special_tokens=False).ids
        assert len(encoder.pieces.known) <= 1_000


def test_word_encoder_on_arrow_arrays(tokenizer):
    """Slices, long strings, arrays without a word and marks behind words."""
    import pyarrow as pa

    encoder = packing.WordEncoder(packing.tokenizer_file())
    texts = ["cut off", None, "", "Stop!!! it's. dogs', ÄÖ***, (a) $$$ x_ ¿qué? 3.5%, ½. ²!", "  ", "你好!! <|endoftext|>"]
    expect = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for kind in (pa.string(), pa.large_string()):
        got = encoder.texts(pa.array(texts, kind)[1:])
        assert [np.frombuffer(g, "<u2").tolist() for g in got] == expect[1:]
    assert encoder.texts(pa.array([None, ""], pa.string())) == [b"", b""]
    assert encoder.text("") == encoder.text(" \n") == b""


def test_hilbert_neighbours():
    """Consecutive keys are neighbouring cells: the defining property of the curve."""
    bits, dims = packing.BITS, packing.DIMS
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << bits, (400, dims))
    cells = np.concatenate([base] + [base + np.eye(dims, dtype=int)[k] for k in range(dims)])
    cells = cells[(cells < 1 << bits).all(axis=1)]
    keys = packing.hilbert_key(cells)
    assert len(set(keys.tolist())) == len({tuple(c) for c in cells.tolist()})
    # all cells of the smallest corner: keys 0 .. 2^dims - 1 form a path of unit steps
    corner = np.array(np.meshgrid(*[[0, 1]] * dims, indexing="ij")).reshape(dims, -1).T
    order = corner[np.argsort(packing.hilbert_key(corner))]
    assert sorted(packing.hilbert_key(corner).tolist()) == list(range(2 ** dims))
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_neighbours_share_sequences(docs):
    """Languages are mixed less inside sequences than by chance."""
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = packing.pack_along_curve(docs, packing.tokenizer_file()).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], set()).add(lang[r["doc_id"]])
    assert np.mean([len(x) for x in by.values()]) < 1.6
