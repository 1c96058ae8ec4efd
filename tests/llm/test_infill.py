import hashlib
import random
import re

import pytest

from .conftest import edge_rows
from tracefold.llm import infill as I


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(doc_id, text):
    """The contract, unit by unit."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digits = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digits[k:k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if text == "" or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, sha(text), sha(text)
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return n, form, len(p), len(m), sha(out), sha(text)


def test_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = I.op11_infill(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[1:] == plain(r["doc_id"], texts[r["doc_id"]])


@pytest.mark.parametrize("block", [1, 2, 3, 7, 4096])
def test_every_cut_of_random_texts(block):
    """Descent and boundary at every unit, with runs of letters over many blocks."""
    r = random.Random(block)
    for _ in range(60):
        text = "".join(r.choice(["abc", "Z" * 9, " ", "é", "🙂", "7", "\n", "ſ", "K", "<"]) for _ in range(r.randint(0, 12)))
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        tree = I.BlockTree(text, block)
        assert tree.n == len(units)
        assert [tree.offset(k) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]


def test_output_and_way_back(spark):
    """Texts made of halves of the signs come back whole; texts with a sign stay plain."""
    r = random.Random(3)
    rows = [(i, "".join(r.choice(["<", "P", ">", "<S", "M>", "a", " ", "<<", "é"]) for _ in range(r.randint(0, 30))))
            for i in range(500)]
    made = I.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))
    got = made.withColumn("back", I.restored(made["output"], made["form"])).collect()
    for g in got:
        text = dict(rows)[g["doc_id"]]
        assert g["back"] == text
        assert (g["n"], g["form"], g["prefix_chars"], g["middle_chars"], sha(g["output"]), sha(text)) == plain(g["doc_id"], text)
    assert {g["form"] for g in got} == {"plain", "psm", "spm"}


def test_edges(spark, edge_docs, no_docs):
    got = I.fill_in_middle(edge_docs).collect()
    key = lambda x: (str(x[0]), str(x[1:]))
    want = [(i, *plain(i, t)[:5]) for i, t, *_ in edge_rows()]
    assert sorted(((g["doc_id"], g["n"], g["form"], g["prefix_chars"], g["middle_chars"], sha(g["output"])) for g in got),
                  key=key) == sorted(want, key=key)
    assert I.fill_in_middle(no_docs).collect() == []


def test_very_long_text(spark):
    """One word of a million letters among a million signs: two numbers per block, one block looked into."""
    text = "x" * 1_000_000 + "".join(f" {i}" for i in range(150_000))
    rows = [(i, text) for i in range(4)]
    for g in I.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert (g["n"], g["form"], g["prefix_chars"], g["middle_chars"], sha(g["output"])) == plain(g["doc_id"], text)[:5]


def test_other_seed_other_cuts(spark, docs):
    a, b = ({r["doc_id"]: r["output"] for r in I.fill_in_middle(docs, seed=s).collect()} for s in (1, 2))
    assert sum(a[k] != b[k] for k in a) > len(a) / 2
    assert a == {r["doc_id"]: r["output"] for r in I.fill_in_middle(docs.repartition(3)).collect()}
