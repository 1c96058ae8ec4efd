import random

import pytest
import tokenizers

from .conftest import LONG, edge_rows
from tracefold.llm import token_counts as C


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(C.tokenizer_file())


def length(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_whole_table(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = C.op13_tokens(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(texts) == len({r["doc_id"] for r in got})
    for r in got:
        n = length(library, texts[r["doc_id"]])
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((texts[r["doc_id"]] or "").encode()), n, n > 2048)


def test_odd_texts(library):
    """Case, composition, odd white space, contractions, marks after letters that change, added tokens."""
    r = random.Random(13)
    bits = [*"abcdefghiABCzéÉßſKÅΣςİıǅŉ0123456789²Ⅷ٣.,;:!?'\"-_/\\()[]<|>", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>",
            "'s", "'ll", "'RE", " ", "  ", "\n", "\x85", "\xa0", "\x1c", "\x0b", "́", "̇", "​", " ", "　",
            "你", "好", "🙂", "👩‍👧", "ﬁ", "가", "ᄀ", "ᅡ", "﻿", "\x00", "a" * 50, "the", "running"]
    words = C.Words(C.tokenizer_file())
    for _ in range(20_000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 25)))
        assert words.count(text.encode()) == length(library, text), text


def test_merges_in_rank_order():
    """Against the textbook loop: merge the lowest-ranked pair, the leftmost first, until none is left."""
    r = random.Random(5)
    for _ in range(300):
        grown = ["a", "b", "c"]
        ranks = {}
        for _ in range(r.randint(1, 8)):
            pair = (r.choice(grown), r.choice(grown))
            ranks.setdefault(pair, len(ranks))
            grown.append("".join(pair))
        symbols = [r.choice("abc") for _ in range(r.randint(1, 30))]
        plain = list(symbols)
        while found := [(ranks[p], i) for i, p in enumerate(zip(plain, plain[1:])) if p in ranks]:
            _, i = min(found)
            plain[i:i + 2] = [plain[i] + plain[i + 1]]
        assert len(symbols) - C.merges_made(symbols, ranks) == len(plain)


def test_one_long_word(library):
    """A word of 300,000 letters without a space: n log n, not n squared."""
    r = random.Random(8)
    word = "".join(r.choice("etaoinshrdlu") for _ in range(300_000))
    words = C.Words(C.tokenizer_file())
    assert words.count(word.encode()) == length(library, word)
    assert len(words) == 0      # not remembered


def test_forgetting_costs_no_results(monkeypatch, library):
    monkeypatch.setattr(C, "REMEMBERED", 50)
    words = C.Words(C.tokenizer_file())
    assert words.count(LONG.encode()) == length(library, LONG) and len(words) <= 50


def test_edges(spark, library, edge_docs, no_docs):
    got = C.token_counts(edge_docs, C.tokenizer_file(), limit=6).collect()
    want = [(i, len((t or "").encode()), length(library, t), length(library, t) > 6) for i, t, *_ in edge_rows()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert C.token_counts(no_docs, C.tokenizer_file()).collect() == []
