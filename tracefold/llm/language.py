"""Language identification by Bayesian fusion of evidence (operator 5)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed
from .quality import held_out

LEAST_SHARE = 0.001     # of the labelled documents that a language must have to be learnt (so 1,000 at most)
OTHER = "other"         # a language that was not learnt
BUCKETS = 1 << 14       # of hashed byte trigrams
SMOOTH = 0.5            # added to every trigram count
PRIOR_ROWS = 20.0       # weight of the wider level when host shares are smoothed
CLUE_ROWS = 1.0         # added to counts of declared languages and suffixes
MILLION = 1e6
TEMPER = 0.5            # power of the text length that its evidence grows with

MARKUP = re.compile(rb"<script\b.*?(?:</script\s*>|\Z)|<style\b.*?(?:</style\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^<>]*>", re.S | re.I)
# Bytes a trigram is made of: letters lower-cased, everything beyond ASCII kept, the rest a blank.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def trigram_counts(text: str | None, markup: bool):
    """Bucket counts of the hashed byte trigrams of a whole text."""
    import numpy as np

    b = (text or "").encode("utf-8", "surrogatepass")
    if markup:
        b = MARKUP.sub(b" ", b)
    b = b" " + b" ".join(b.translate(LETTERS).split()) + b" "
    a = np.frombuffer(b, np.uint8).astype(np.uint32)
    if len(a) < 4:      # no letter
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = (a[:-2] * 2654435 + a[1:-1] * 40503 + a[2:] * 97) * np.uint32(2654435761)
    return np.unique((mixed >> np.uint32(18)).astype(np.int64) & (BUCKETS - 1), return_counts=True)


def learnt_languages(docs: DataFrame, lang_col: str = "lang") -> list[str]:
    """Languages with at least ``LEAST_SHARE`` of the labelled documents, by a grouped count of the labels.

    Shares add up to one, so the list has at most 1 / ``LEAST_SHARE`` names.
    """
    counts = docs.filter(F.col(lang_col).isNotNull()).groupBy(lang_col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_all"))
    rows = (counts.join(F.broadcast(total), F.col("n") >= F.col("_all") * LEAST_SHARE)
            .filter(F.col(lang_col) != OTHER).select(lang_col).collect())
    return sorted(r[0] for r in rows)


def train_text_model(docs: DataFrame, languages, text_col: str = "text", lang_col: str = "lang"):
    """Log shares ``[bucket, language]`` of trigrams, counted over all given documents.

    Counted inside each task first; what is gathered is at most ``BUCKETS``
    counts per language of the given list. The last column is no language:
    every bucket alike, the likelihood of a text whose trigrams none of the
    languages accounts for.
    """
    import numpy as np

    index = {x: k for k, x in enumerate(languages)}

    def count(batches):
        import pyarrow as pa

        total = np.zeros((len(languages), BUCKETS), np.int64)
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if lang in index:
                    bucket, n = trigram_counts(text, False)
                    total[index[lang], bucket] += n
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(bucket), pa.array(total[lang, bucket])],
                                         names=["l", "b", "n"])

    bounded_batches(docs.sparkSession)
    rows = (docs.select(text_col, lang_col).mapInArrow(count, "l long, b long, n long")
            .groupBy("l", "b").agg(F.sum("n").alias("n")).collect())
    total = np.full((BUCKETS, len(languages)), SMOOTH)
    for r in rows:
        total[r["b"], r["l"]] += r["n"]
    shares = np.column_stack([total / total.sum(axis=0), np.full(BUCKETS, 1 / BUCKETS)])
    return np.log(shares).astype(np.float32)


def text_evidence(text: Column, model, markup: bool) -> Column:
    """Tempered log likelihood per language; equal for a text without letters.

    Neighbouring trigrams are far from independent, so the evidence grows
    with the ``TEMPER`` power of their number.
    """
    @F.pandas_udf("array<double>")
    def each(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            bucket, n = trigram_counts(t, markup)
            total = int(n.sum())
            out.append((n @ model[bucket] * total ** (TEMPER - 1)).astype(float).tolist() if total
                       else [0.0] * model.shape[1])
        return pd.Series(out)

    return each(text)


def normalised(logs: Column) -> Column:
    """Shares from log weights."""
    top = F.array_max(logs)
    raw = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raw, lambda x: x / total)


def page_clues(url: Column, html: Column) -> dict[str, Column]:
    """Declared markup language, host, wider host and address suffix of a page."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    labels = F.split(host, r"\.")
    declared = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z]+)", 1))
    blank = lambda c: F.when(F.length(c) > 0, c)
    return {"_declared": blank(declared), "_host": blank(host),
            "_wide": blank(F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")),
            "_suffix": blank(F.element_at(labels, -1))}


def fuse(evidence: DataFrame, languages) -> DataFrame:
    """Posterior of every row from its text evidence, clues and host prior.

    ``evidence``: ``_text`` (log likelihoods), ``_declared``, ``_suffix``,
    ``_host``, ``_wide`` (null where unknown), ``doc_id``, ``page_id`` and columns to keep. All priors
    are grouped sums of the text posteriors over all rows: shares of the
    languages overall, in a wider host smoothed towards overall, in a host
    smoothed towards its wider host; and for each declared language and
    suffix how often it goes with each language. Rows join these by key; a
    host with a third of all rows is one summed row on its side of the join,
    and the large side is left to adaptive skew splitting.
    """
    n = len(languages)
    rows = checkpointed(evidence.withColumn("_p", normalised(F.col("_text"))))
    sums = [F.sum(F.col("_p")[k]).alias(f"s{k}") for k in range(n)]
    shares = F.array(*[F.coalesce(F.col(f"s{k}"), F.lit(0.0)) for k in range(n)])
    weight = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)

    def level(key: str | None) -> DataFrame:
        return rows.groupBy(*([key] if key else [])).agg(*sums).select(
            *([key] if key else []), shares.alias("_s"))

    def smoothed(counts: Column, wider: Column) -> Column:
        return F.zip_with(counts, wider, lambda c, w: (c + PRIOR_ROWS * w) / (weight(counts) + PRIOR_ROWS))

    overall = level(None).first()
    counts = [float(x) for x in (overall["_s"] if overall else [0.0] * n)]
    base = [(c + 1.0) / (sum(counts) + n) for c in counts]
    base_col = F.array(*[F.lit(b) for b in base])
    # one row per host: its own sums and those of its wider host
    wide = level("_wide").filter(F.col("_wide").isNotNull()).select("_wide", smoothed(F.col("_s"), base_col).alias("_w"))
    hosts = (rows.filter("_host is not null").groupBy("_host", "_wide").agg(*sums)
             .select("_host", "_wide", shares.alias("_s")).join(wide, "_wide", "left")
             .select(F.col("_host").alias("_h"),
                     smoothed(F.col("_s"), F.coalesce("_w", base_col)).alias("_prior")))

    def clue(key: str) -> DataFrame:
        """log P(value | language) for each value of a clue."""
        per = [F.log((F.col("_s")[k] + CLUE_ROWS * base[k]) / (counts[k] + CLUE_ROWS)) for k in range(n)]
        return level(key).filter(F.col(key).isNotNull()).select(F.col(key).alias(f"{key}_k"),
                                                                F.array(*per).alias(f"{key}_ll"))

    # a missing clue meets nothing; its rows are spread, not hashed to one place
    spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64("_text", "doc_id", "page_id"), 4096).cast("string"))
    at = lambda key: F.coalesce(F.col(key), spread)
    out = rows.join(hosts, at("_host") == F.col("_h"), "left")
    for key in ("_declared", "_suffix"):
        out = out.join(clue(key), at(key) == F.col(f"{key}_k"), "left")
    none = F.array(*[F.lit(0.0)] * n)
    logs = F.transform(F.coalesce("_prior", base_col), lambda x: F.log(x))
    for part in ("_text", "_declared_ll", "_suffix_ll"):
        logs = F.zip_with(logs, F.coalesce(part, none), lambda a, b: a + b)
    best = F.array_max("_post")
    return (out.withColumn("_post", normalised(logs))
            .withColumn("lang", F.element_at(F.array(*[F.lit(x) for x in languages]),
                                             F.array_position("_post", best).cast("int")))
            .withColumn("score", best))


def identify(docs: DataFrame, pages: DataFrame, languages=None) -> DataFrame:
    """Language of every document and every page.

    The text model is learnt from the documents' own language labels (a
    fifth of the ids is held out); which languages there are, if not given,
    from a count of the labels. Pages bring a declared language, an
    address suffix and a host, documents their source as host. Returns
    ``doc_id`` or ``page_id`` (the other null), ``lang``, ``score`` (its
    posterior) and ``held_out``. A row without any evidence gets the most
    frequent language and its share as score; null and empty texts and
    addresses are such missing evidence; a text that no learnt language
    accounts for better than chance gets ``other``, and so does every text
    where none is learnt; repeated rows are rows of their own; empty
    tables give no rows; other columns are ignored.
    """
    learning = docs.filter(~held_out(F.col("doc_id")))
    languages = learnt_languages(learning) if languages is None else list(languages)
    model = train_text_model(learning, languages)
    languages = [*languages, OTHER]
    nothing = F.lit(None).cast("string")
    from_docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"),
                            held_out(F.col("doc_id")).alias("held_out"),
                            text_evidence(F.col("text"), model, False).alias("_text"),
                            nothing.alias("_declared"), nothing.alias("_suffix"),
                            F.concat(F.lit("source "), "source").alias("_host"), nothing.alias("_wide"))
    clues = page_clues(F.col("url"), F.col("html"))
    from_pages = pages.select(F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"),
                              F.lit(True).alias("held_out"), text_evidence(F.col("html"), model, True).alias("_text"),
                              *[c.alias(k) for k, c in clues.items()])
    return fuse(from_docs.unionByName(from_pages), languages).select("doc_id", "page_id", "lang", "score", "held_out")


def op5_language(spark, sf_dir: str) -> DataFrame:
    """Language of all documents and pages."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/pages.parquet"))
