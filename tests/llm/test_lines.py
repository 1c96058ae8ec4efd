import re
from collections import Counter

import duckdb

from .conftest import SF, edge_rows
from tracefold.llm import lines as R

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered |= {i, i + 1, i + 2}
    own = [x for x in text.split("\n") if WORD.search(x)]
    n, rep = len(words), len(covered)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(own) - len(set(own)), rep,
            n < 50 or 100 * rep > 50 * n)


def normal(line):
    return re.sub("[0-9]+", "0", " ".join(WORD.findall(line)).lower())


def plain_removed(rows, least=R.LINE_DOCS, share=R.LINE_SHARE):
    """``[(id, text, host)]`` to words in frequent lines."""
    texts, by = {}, {}
    for _, t, h in rows:
        texts.setdefault(h, set()).add(t)
    for h, ts in texts.items():
        for t in ts:
            for x in {normal(x) for x in (t or "").split("\n") if WORD.search(x)}:
                by[h, x] = by.get((h, x), 0) + 1
    return [sum(len(WORD.findall(x)) for x in (t or "").split("\n")
                if by.get((h, normal(x)), 0) > max(least, share * len(texts[h]))) for _, t, h in rows]


def verdict(r):
    return not r["base_failed"] and r["removed_words"] < 0.5 * r["n_words"] and r["n_words"] - r["removed_words"] >= 50


def figures(r):
    return tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    removed = dict(zip((r[0] for r in rows), plain_removed(rows)))
    text = {i: t for i, t, _ in rows}
    got = R.op10_lines(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        assert figures(r) == plain(text[r["doc_id"]])
        assert r["removed_words"] == removed[r["doc_id"]]
        assert r["kept"] == verdict(r)


def test_edges(edge_docs, no_docs):
    rows = edge_rows()
    got = sorted((str(r["doc_id"]), *figures(r)) for r in R.line_rules(edge_docs).collect())
    assert got == sorted((str(i), *plain(t)) for i, t, *_ in rows)
    assert R.line_rules(no_docs).collect() == []
    assert R.clean_documents(no_docs).collect() == []
    assert R.clean_documents(edge_docs).columns == edge_docs.columns


def word(*at):
    """A word without digits, its own for each place."""
    return "".join(chr(97 + x % 26) + chr(97 + x // 26) for x in at)


def site(n, host):
    """Documents with their own words, one shared line; every fourth is hardly more than shared lines."""
    own = lambda i, k: "\n".join(" ".join(f"{host}{word(i, j, m)}" for m in range(12)) for j in range(k))
    shared = f"Subscribe to our  letter 20{{y}} and read more stories every day at {host}"
    return [(f"{host}{i}", "\n".join([shared.format(y=10 + i)] * (1 if i % 4 else 40) + [own(i, 6 if i % 4 else 5)]), host)
            for i in range(n)]


def test_frequent_lines_and_depletion(spark):
    rows = site(40, "a") + site(40, None) + site(8, "small")
    df = spark.createDataFrame(rows, "doc_id string, text string, source string")
    removed = dict(zip((r[0] for r in rows), plain_removed(rows)))
    for r in R.line_rules(df).collect():
        assert r["removed_words"] == removed[r["doc_id"]]
        assert r["kept"] == verdict(r)
    cleaned = {r["doc_id"]: r["text"] for r in R.clean_documents(df).collect()}
    assert "Subscribe" not in cleaned["a1"] and cleaned["a1"] == rows[1][1].split("\n", 1)[1]
    assert "Subscribe" in cleaned["small1"]


def test_copies_do_not_make_their_lines_frequent(spark):
    text = "\n".join(" ".join(f"{word(j)}x{word(m)}" for m in range(12)) for j in range(6))
    df = spark.createDataFrame([(i, text, "a") for i in range(50)] + [(100 + i, text.replace("x", f"k{word(i)}z"), "a") for i in range(20)],
                               "doc_id long, text string, source string")
    assert all(r["kept"] and r["removed_words"] == 0 for r in R.line_rules(df).collect())


def test_repeats_against_brute_force(spark):
    import random
    r = random.Random(8)
    rows = [(i, " ".join(r.choice("abc") for _ in range(r.randint(0, 60)))) for i in range(300)]
    df = spark.createDataFrame([(i, t, "h") for i, t in rows], "doc_id long, text string, source string")
    text = dict(rows)
    for x in R.line_rules(df).collect():
        assert figures(x) == plain(text[x["doc_id"]]), text[x["doc_id"]]


def test_sql_twin(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"]
    want = sorted(con.execute(f"select {', '.join(names)} from ({R.OP10_SQL})").fetchall())
    assert sorted(tuple(r[n] for n in names) for r in R.op10_lines(spark, SF).collect()) == want


def test_sql_twin_on_a_large_host_and_short_leftovers(spark):
    """3,000 documents of one host, a line in 150 of them; what is left of some is too short, though most of it stays."""
    import pandas as pd
    line = "Read more of our stories and share them with all your friends every day"
    own = lambda i, k: " ".join(f"{word(i, i // 26, i // 676)}{word(m)}" for m in range(k))
    rows = [(i, f"{line}\n{own(i, 45 + i % 10)}" if i < 150 else own(i, 55), "hot") for i in range(3000)]
    rows += [(5000 + i, f"{line}\n{own(i, 45)}", None) for i in range(9)]
    want = {i: (14 if i < 150 else 0, i >= 150 or i % 10 >= 5) for i, *_ in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r["doc_id"]: (r["removed_words"], r["kept"]) for r in R.line_rules(df).collect()} == want
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]))
    assert {i: (n, k) for i, n, k in con.execute(f"select doc_id, removed_words, kept from ({R.OP10_SQL})").fetchall()} == want
    assert {r["doc_id"] for r in R.clean_documents(df).collect()} == {i for i, (_, k) in want.items() if k}


def test_many_documents_suffice_in_a_large_host(spark):
    """2% of a hot source share a line; a share alone would let it stand, and the documents made of it pass."""
    line, short, rare = "Read more of our stories and share them with all", "Share", "This line stands in a hundred documents only"
    own = lambda i, k: " ".join(f"{word(i, i // 26, i // 676)}{word(m)}" for m in range(k))

    def text(i):
        if i < 122:
            return "\n".join([short, *[f"{line} {k}" for k in range(6 if i % 2 else 1)], own(i, 55)])
        return "\n".join([own(i, 55), *[rare] * (i < 222)])

    rows = [(i, text(i), "hot") for i in range(6000)] + [(10_000 + i, f"{line} 1\n{own(i, 55)}", "small") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in R.line_rules(df).collect()}
    for i, *_ in rows:
        lines = (6 if i % 2 else 1) if i < 122 else 0
        assert got[i]["removed_words"] == 11 * lines, i
        assert got[i]["kept"] == (lines < 6), i
    cleaned = {r["doc_id"]: r["text"] for r in R.clean_documents(df).collect()}
    assert cleaned[0] == f"{short}\n{own(0, 55)}" and cleaned[200] == text(200) and cleaned[10_001] == rows[6001][1]
