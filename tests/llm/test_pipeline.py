from collections import Counter

import corpus_pipeline as C
from .conftest import SF, edge_rows
from .test_simhash import plain_components, plain_simhash
from tracefold.llm import mixing, packing, quality, secrets


def staged(spark, docs, sf, folder):
    out = [docs]
    for name, stage in C.STAGES:
        stage(spark, out[-1], sf).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def test_each_stage_decides(spark, docs, tmp_path):
    start, good, single, masked, mixed, pieces = staged(spark, docs, SF, str(tmp_path))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r["doc_id"]: r["predicted"] for r in quality.score_quality(start, labels).collect()}
    ids = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())
    assert ids(good) == Counter(i for i, p in scores.items() if p == 1)
    rows = good.collect()
    assert ids(single) == Counter(set(plain_components([(r["doc_id"], plain_simhash(r["text"])) for r in rows])))
    assert ids(masked) == ids(single)
    text = {r["doc_id"]: r["text"] for r in single.collect()}
    spans = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(single).collect()}
    for r in masked.collect():
        assert ("[SECRET]" in r["text"]) == bool(spans[r["doc_id"]])
        assert r["n_chars"] == len(r["text"]) or not spans[r["doc_id"]]
        assert spans[r["doc_id"]] or r["text"] == text[r["doc_id"]]
    assert ids(mixed) == Counter({r["doc_id"]: r["copies"] for r in mixing.mix_report(masked).collect() if r["copies"]})
    for df in (good, single, masked, mixed):
        assert df.columns == docs.columns and df.dtypes == docs.dtypes
    assert Counter(r["doc_id"] for r in pieces.filter("start = 0").collect()) == ids(mixed)
    assert pieces.agg({"length": "sum"}).first()[0] == sum(
        r["_n"] for r in packing.tokenised(mixed, packing.tokenizer_file(), "doc_id", "text").collect())


def test_run_is_the_stages(spark, docs, tmp_path):
    key = lambda df: sorted((r["doc_id"], r["start"], r["length"], bytes(r["ids"])) for r in df.collect())
    pieces = staged(spark, docs, SF, str(tmp_path))[-1]
    got = C.run(spark, SF)
    assert got.select("doc_id").distinct().count() == pieces.select("doc_id").distinct().count()
    assert sum(r["length"] for r in got.collect()) == sum(r["length"] for r in pieces.collect())


def test_edge_rows_pass_through(spark, edge_docs, no_docs, tmp_path):
    """Nulls, empty texts, repeated rows and extra columns in every stage."""
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, edge_docs, SF)
        assert out.columns == edge_docs.columns, name
        out.collect()
        assert stage(spark, no_docs, SF).collect() == [], name
    assert C.pack_sequences(spark, edge_docs, SF).select("doc_id").distinct().count() == len({i for i, *_ in edge_rows()})
    assert C.pack_sequences(spark, no_docs, SF).collect() == []
