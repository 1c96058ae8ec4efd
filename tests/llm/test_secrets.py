import hashlib
import random
import re
import string

import pytest

from .conftest import SF, edge_rows
from tracefold.llm import secrets as S

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain(text):
    text = text or ""
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, z) for a, _, k, z in sorted(spans)]


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in spans).encode()).hexdigest()


def check(rows, texts):
    for r in rows:
        want = plain(texts[str(r["doc_id"])])
        assert r["base_sha256"] == digest(want), (r, want)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[0] == k for x in want) for k in ("assign", "access", "hex")]
        listed = [tuple(x.split(":")) for x in r["spans"].split(",") if x]
        assert {(k, str(a), str(z)) for k, a, z in want} <= set(listed)
        assert [int(x[1]) for x in listed] == sorted(int(x[1]) for x in listed)


def test_whole_table(spark, docs):
    check(S.op7_secrets(spark, "/root/testdata/sf0.01").collect(),
          {str(r["doc_id"]): r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()})


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(6)
    bits = ["password", "PASSWD", "token", "api_key", "apikey", "secret", "=", ":", " ", '"', "'", "abc", "abcdef1", "AKIA",
            "AKIA" + "Z9" * 8, "AKIA" + "Q" * 15, "0123456789abcdef" * 2, "deadbeef", "é", "🙂", "\n", "ſecret", "K"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(1, 25)))) for i in range(600)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_random_texts(odd):
    rows, df = odd
    check(S.scan_secrets(df).collect(), {str(i): t for i, t in rows})


def test_redaction(odd):
    rows, df = odd
    for r in S.redacted(df).collect():
        text, out, at = dict(rows)[r["doc_id"]], "", 0
        for _, a, z in plain(text):
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, z)
        out += text[at:]
        if "[SECRET]" in r["text"] or plain(text):
            # random spans may be masked besides
            assert r["text"] == out or r["text"].count("[SECRET]") > out.count("[SECRET]")


def test_edges(edge_docs, no_docs):
    rows = edge_rows()
    got = S.scan_secrets(edge_docs).collect()
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in got) == sorted((str(i), digest(plain(t))) for i, t, *_ in rows)
    assert S.scan_secrets(no_docs).collect() == []
    clean = S.redacted(edge_docs)
    assert clean.columns == edge_docs.columns and clean.count() == len(rows)
    masked = [r for r in clean.collect() if r["text"] and "[SECRET]" in r["text"]]
    assert [r["doc_id"] for r in masked] == [10] and masked[0]["n_chars"] == len(masked[0]["text"])


def tokens(seed, alphabet, n, size):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(size)) for _ in range(n)]


def test_battery_tells_random_from_text(spark):
    """Random tokens of several encodings are reported, names, slugs and patterns are not."""
    b62 = string.ascii_letters + string.digits
    good = tokens(1, b62, 40, 40) + tokens(2, b62 + "+/", 30, 64) + tokens(3, string.ascii_uppercase + "234567", 30, 56)
    bad = ["some-long-slug-name-for-the-page-about-this-2", "theaverageofthesevalues1", "abcdefghijklmnopqrstuvwxyz0123456789",
           "ABABABABABABABABABABABAB12", "section-four-the-rest-of-the-story-7", "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz1",
           "ananasandbananasandananas12"]
    rows = [(i, f"text {t} end", t) for i, t in enumerate(good)] + [(1000 + i, f"text {bad[i % len(bad)]} end", None) for i in range(200)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in S.scan_secrets(df).collect()}
    caught = sum(found[i] == f"random:5:{5 + len(t)}" for i, _, t in rows if t)
    assert caught >= 0.95 * len(good)
    assert not [bad[(i - 1000) % len(bad)] for i, _, t in rows if not t and "random" in found[i]]


def test_short_tokens_need_more_evidence(spark):
    from pyspark.sql import functions as F
    b62 = string.ascii_letters + string.digits
    rows = [(n, t) for n in (20, 40, 80) for t in tokens(n, b62, 60, n)]
    df = spark.createDataFrame(rows, "n int, t string").select("n", S.battery(F.col("t")).alias("b"))
    p = {r["n"]: r["p"] for r in df.groupBy("n").agg(F.avg("b.p").alias("p")).collect()}
    assert p[20] > 10 * p[40] > 1000 * p[80]


def test_secrets_behind_paths_and_names(spark):
    """A random segment is found and masked whatever is glued to it; the path alone is not."""
    b62 = string.ascii_letters + string.digits
    heads = ["com/account/settings/reset/", "com/account/settings/profiles/members/reset/", "next=/account/settings/members/", "the_name_of_the_session_"]
    rows = [(f"{k} {n} {i}", f"see {h}", t) for n in (32, 40) for k, h in enumerate(heads) for i, t in enumerate(tokens(100 * k + n, b62, 40, n))]
    plain_rows = [(f"path {i}", f"see {heads[i % 4]}page{i}", "") for i in range(160)]
    df = spark.createDataFrame([(i, h + t + " end") for i, h, t in rows + plain_rows], "doc_id string, text string")
    found = {r["doc_id"]: [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x] for r in S.scan_secrets(df).collect()}
    masked = {r["doc_id"]: r["text"] for r in S.redacted(df).collect()}
    for k in range(len(heads)):
        for n in (32, 40):
            mine = [(i, h, t) for i, h, t in rows if i.startswith(f"{k} {n} ")]
            hit = [(i, t) for i, h, t in mine if any(a <= len(h) and len(h + t) <= z for a, z in found[i])]
            assert len(hit) >= 0.95 * len(mine), (k, n, len(hit))
            assert not [i for i, t in hit if t in masked[i]]
    assert not [i for i, *_ in plain_rows if found[i]]


def test_letters_alone_are_left_to_the_battery(spark):
    good = tokens(5, string.ascii_letters, 40, 40)
    bad = ["-" * 30, "=" * 30, "_" * 25, "1" + "=" * 30, "/" * 21, "thisisjustanotherlongword", "a-slug-of-words-and-no-digits"]
    rows = [(i, f"text {t} end") for i, t in enumerate(good)] + [(1000 + i, f"text {bad[i % len(bad)]} end") for i in range(140)]
    found = {r["doc_id"]: r["spans"] for r in S.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found[i] == "random:5:45" for i in range(len(good))) >= 0.95 * len(good)
    assert not [i for i in found if i >= 1000 and found[i]]


def test_running_join(spark):
    from pyspark.sql import functions as F
    from tracefold.llm.common import SHORT, running_join
    r = random.Random(2)
    rows = [([r.randint(-9, 9) for _ in range(n)],) for n in (0, 1, SHORT - 1, SHORT, SHORT + 1, 5 * SHORT + 3)]
    df = spark.createDataFrame(rows, "a array<long>").select(
        "a", running_join(F.col("a"), lambda x, y: x + y).alias("s"), running_join(F.col("a"), F.greatest).alias("m"))
    for x in df.collect():
        assert x["s"] == [sum(x["a"][:k + 1]) for k in range(min(len(x["a"]), 50))] + x["s"][50:]
        assert all(x["s"][k] == x["s"][k - 1] + x["a"][k] for k in range(1, len(x["a"])))
        assert all(x["m"][k] == max(x["m"][k - 1], x["a"][k]) for k in range(1, len(x["a"]))) and len(x["m"]) == len(x["a"])


def long_text(n, seed):
    """Random tokens, base patterns over and beside them, paths; a text of some 50 n signs."""
    r, b62 = random.Random(seed), string.ascii_letters + string.digits
    token = lambda k, a=b62: "".join(r.choice(a) for _ in range(k))
    kinds = [lambda: token(40), lambda: f"password={token(12)}", lambda: "com/account/reset/" + token(40), lambda: token(30, "0123456789abcdef"),
             lambda: f"token: {token(24)}/{token(40)}", lambda: "AKIA" + token(16, string.ascii_uppercase), lambda: "ordinary words né 🙂"]
    return " ".join(r.choice(kinds)() for _ in range(n))


def masked_plain(text, spans):
    out, at = "", 0
    for a, z in spans:
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, z)
    return out + text[at:]


def test_very_long_texts_take_time_by_their_length(spark):
    """Spans by brute force (none lies in another or on a base one), and four times the text takes no sixteen times the time."""
    import time
    took = []
    scan = lambda df: {r["doc_id"]: r for r in S.scan_secrets(df).collect()}
    for n in (3_000, 3_000, 12_000):
        text = long_text(n, 7)
        df = spark.createDataFrame([(1, text, 0), (2, long_text(50, 8), 0)], "doc_id long, text string, n_chars long").coalesce(1)
        at = time.perf_counter()
        got = scan(df)
        took.append(time.perf_counter() - at)
        masked = {r["doc_id"]: r for r in S.redacted(df).collect()}
        for i, t in ((1, text), (2, long_text(50, 8))):
            listed = [x.split(":") for x in got[i]["spans"].split(",") if x]
            spans = [(int(a), int(z)) for _, a, z in listed]
            base = plain(t)
            assert [(k, int(a), int(z)) for k, a, z in listed if k != "random"] == base
            own = [(int(a), int(z)) for k, a, z in listed if k == "random"]
            assert all(z <= b for (_, z), (b, _) in zip(own, own[1:])) and i == 2 or own
            assert not {p for a, z in own for p in range(a, z)} & {p for _, a, z in base for p in range(a, z)}
            assert masked[i]["text"] == masked_plain(t, spans) and masked[i]["n_chars"] == len(masked[i]["text"])
    assert took[2] < 8 * took[1] + 5
