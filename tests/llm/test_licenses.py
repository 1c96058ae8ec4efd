import random
import re

from .conftest import SF, edge_rows
from tracefold.llm import licenses as L

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BASE = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}


def plain(text):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for label, phrase in BASE.items() for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))


def figures(r):
    return r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]


def test_whole_table(spark, docs):
    want = {r["doc_id"]: plain(r["text"]) for r in docs.collect()}
    for r in L.op4_licenses(spark, SF).collect():
        assert figures(r) == want[r["doc_id"]]
        base = set(filter(None, r["base_labels"].split(",")))
        labels = list(filter(None, r["labels"].split(",")))
        assert labels == sorted(set(labels)) and base <= set(labels) and 0 <= r["score"] <= 1
        assert (r["score"] > 0) == bool(labels)


def test_edges(edge_docs, no_docs):
    got = sorted((str(r["doc_id"]), *map(str, figures(r))) for r in L.scan_licenses(edge_docs).collect())
    assert got == sorted((str(i), *map(str, plain(t))) for i, t, *_ in edge_rows())
    assert L.scan_licenses(no_docs).collect() == []


def test_templates_are_found(spark):
    r = random.Random(2)
    noise = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "of", "the", "and"]) for _ in range(n))
    rows = [(k, f"{noise(30)} {text.title()}. {noise(50)}", label) for k, (label, text, _) in enumerate(L.TEMPLATES)]
    rows += [(100 + k, noise(200), None) for k in range(40)]
    # a key phrase is missing, or rare words stand in another order: no match
    rows += [(200, noise(20) + " unencumbered free software released into domain public the " + noise(9), None),
             (201, " ".join(reversed(L.TEMPLATES[1][1].split())), None)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = {x["doc_id"]: x for x in L.scan_licenses(df).collect()}
    for i, _, label in rows:
        found = {m["label"] for m in got[i]["matches"]}
        assert (label in found) if label else not found, (i, label, found)
        if label:
            m = max((m for m in got[i]["matches"] if m["label"] == label), key=lambda m: m["score"])
            assert m["start"] == 30 and m["score"] == 1.0


def test_repeated_and_long_notices(spark):
    df = spark.createDataFrame([(1, "x released under the mit license " * 20_000)], "doc_id long, text string")
    row = L.scan_licenses(df).first()
    assert row["n_base"] == 20_000 and row["first_word"] == 4 and row["last_word"] == 6 * 19_999 + 4
    assert len([m for m in row["matches"] if m["score"] == 1.0]) == 20_000


def brute(words, label, text, phrases):
    """Starts at which a template holds, trying every start."""
    tokens = text.split()
    slack = L.SLACK + len(tokens) // L.SLACK_EACH
    out = {}
    for s in range(-slack - len(tokens), len(words) + slack):
        def stands(p):
            q = p.split()
            return any(words[i:i + len(q)] == q for i in range(max(0, s - slack), s + len(tokens) + slack - len(q) + 1))
        n = sum(w in words[max(0, s + i - slack):max(0, s + i + slack + 1)] for i, w in enumerate(tokens))
        if n >= L.LEAST * len(tokens) and all(stands(p) for p in phrases):
            out[s] = n
    return out


def test_matches_against_every_start(spark):
    """Notices with words lost, swapped and put in: labels, score and starts as when every start is tried."""
    r = random.Random(5)
    rows = []
    for k in range(150):
        _, text, _ = L.TEMPLATES[k % len(L.TEMPLATES)]
        words = text.split()
        for _ in range(r.randrange(1 + len(words) // 2)):
            at = r.randrange(len(words))
            how = r.randrange(3)
            words[at:at + 1] = [] if how == 0 and len(words) > 2 else ["other"] if how == 1 else [words[at], "extra"]
        rows.append((k, " ".join(["before"] * r.randrange(4) + words + ["after"] * r.randrange(4) + words[:r.randrange(9)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x for x in L.scan_licenses(df).collect()}
    hits = 0
    for k, text in rows:
        found, best = set(plain(text)[4].split(",")) - {""}, 0.5 * bool(plain(text)[4])
        for label, words, phrases in L.TEMPLATES:
            starts = brute(text.split(), label, words, phrases)
            if starts:
                found.add(label)
                best = max(best, max(starts.values()) / len(words.split()))
                at = [m for m in got[k]["matches"] if m["label"] == label and m["words"] == len(words.split())]
                assert at and all(m["start"] in {max(0, s) for s in starts} for m in at)
                hits += 1
        assert (got[k]["labels"], got[k]["score"]) == (",".join(sorted(found)), best), text
    assert hits > 60


def test_words_of_a_template_that_no_document_has(spark):
    """The rarest words of a template need not stand anywhere: the file's own rare words find the notice."""
    bsd = "redistribution and use in source and binary forms with or without modification are permitted"
    df = spark.createDataFrame([(k, f"x {bsd} y") for k in range(5)], "doc_id long, text string")
    assert {r["labels"] for r in L.scan_licenses(df).collect()} == {"bsd"}


def test_frequency_counts_documents(spark, docs):
    found, n = L.document_frequency(docs)
    rows = [set(WORDS.findall(r["text"].lower())) for r in docs.collect()]
    assert n == len(rows)
    for w in ("license", "of", "and", "permission"):
        assert found.get(w.encode(), 0) == sum(w in x for x in rows)
