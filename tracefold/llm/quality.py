"""Quality classifier as a sparse rule ensemble (operator 6)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed

TRAIN_ROWS = 100_000     # labelled rows the rules and weights are fitted on, about
TREES, DEPTH, BINS, SEED = 24, 3, 64, 11
LASSO = 0.001
ACCEPT = 0.3

STATS = ("log_words", "word_length", "symbols", "marks", "upper", "digits", "distinct_words", "adjacent_repeats",
         "top_word", "distinct_trigrams", "repeated_lines", "line_words", "closed_sentences", "long_words")


def statistics_of(text: str | None) -> tuple:
    """Statistics of a whole text, in the order of ``STATS``; all zero without words."""
    from collections import Counter
    from itertools import islice
    from operator import eq

    b = (text or "").encode("utf-8", "surrogatepass")
    words = b.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATS)
    chars = sum(map(len, words))
    share = lambda drop: (len(b) - len(b.translate(None, drop))) / chars
    lines = [x for x in b.split(b"\n") if x.strip()]
    counts = Counter(words)
    trigrams = n - 2
    import math

    return (math.log1p(n), chars / n, share(b"#*$%&|<>~^{}[]@_=+\\"), share(b"!?"),
            share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share(b"0123456789"), len(counts) / n,
            sum(map(eq, words, islice(words, 1, None))) / n, max(counts.values()) / n,
            len(set(zip(words, islice(words, 1, None), islice(words, 2, None)))) / trigrams if trigrams > 0 else 1.0,
            (len(lines) - len(set(lines))) / max(1, len(lines)), math.log1p(n / max(1, len(lines))),
            share(b".") * chars / n, sum(len(w) > 20 for w in words) / n)


def statistics(text: Column) -> Column:
    @F.pandas_udf(", ".join(f"{s} double" for s in STATS))
    def each(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics_of(t) for t in texts], columns=list(STATS), dtype="float64")

    return each(text)


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string")) % 5 == 0, F.lit(False))


class Rules:
    """Conjunctive rules with logistic weights; compiles to one column expression."""

    def __init__(self, rules, weights, intercept):
        self.rules, self.weights, self.intercept = rules, weights, intercept

    @staticmethod
    def holds(rule, stat) -> Column:
        """``rule``: sorted ``(statistic, '<=' or '>', bound)``."""
        out = F.lit(True)
        for name, op, bound in rule:
            out = out & (stat(name) <= bound if op == "<=" else stat(name) > bound)
        return out

    def score(self, stat) -> Column:
        margin = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights):
            margin = margin + F.when(self.holds(rule, stat), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))


def tree_rules(debug: str) -> set:
    """Paths to every node of a printed tree, each feature reduced to its tightest bounds."""
    found, path = set(), []
    for line in debug.splitlines():
        m = re.match(r"(\s*)(If|Else) \(feature (\d+) (<=|>) ([-+0-9.eE]+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth] + [(depth, STATS[int(m[3])], m[4], float(m[5]))]
        tight: dict = {}
        for _, name, op, bound in path:
            now = tight.get((name, op))
            tight[name, op] = bound if now is None else (min if op == "<=" else max)(now, bound)
        found.add(tuple(sorted((name, op, bound) for (name, op), bound in tight.items())))
    return found


def fit(labelled: DataFrame) -> Rules:
    """Rule ensemble from rows ``(label, <STATS>)``.

    Shallow trees of a random forest give the rules (the path to every
    node), a lasso logistic regression over their 0/1 columns the weights;
    rules with weight zero are left out. Both fits run on Spark. With fewer
    than two labels the score is the smoothed share of label 1.
    """
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    counts = {int(r["label"]): r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        import math

        return Rules([], [], math.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)))
    vectors = VectorAssembler(inputCols=list(STATS), outputCol="features").transform(labelled)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=BINS, seed=SEED,
                                    featureSubsetStrategy="0.5").fit(vectors.select("label", "features"))
    rules = sorted(set().union(*[tree_rules(t.toDebugString) for t in forest.trees]))
    if not rules:
        import math

        return Rules([], [], math.log((counts[1] + 1) / (counts[0] + 1)))
    hits = F.array(*[Rules.holds(r, F.col).cast("double") for r in rules])
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=60).fit(
        checkpointed(labelled.select("label", array_to_vector(hits).alias("features"))))
    kept = [(r, w) for r, w in zip(rules, lasso.coefficients.toArray().tolist()) if w]
    return Rules([r for r, _ in kept], [w for _, w in kept], lasso.intercept)


def train(stats: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Rules:
    """Fits on labelled rows that are not held out, at most about ``train_rows`` of them by id hash.

    ``stats``: ``_id`` and the statistics. Repeated labels of an id count
    once, the higher one; null and other labels are left out.
    """
    sound = (labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").cast("double").alias("label")))
    n = sound.count()
    if n > train_rows:
        sound = sound.filter(F.pmod(F.xxhash64("_id"), 1_000_000) < int(1_000_000 * train_rows / n))
    return fit(checkpointed(stats.join(sound, "_id").select("label", *STATS)))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Quality score of every document by the fitted rules.

    Statistics of the whole text are the only inputs of a score. Returns id,
    ``held_out``, ``score`` and ``predicted`` (1 from 0.3). Null and empty
    texts have zero statistics and are scored like any other; repeated rows
    are scored each; rows without an id are never learnt from and not held
    out; an empty table gives no rows, without labels the score is one half;
    other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    stats = checkpointed(docs.select(F.col(id_col).alias("_id"), statistics(F.col(text_col)).alias("_s"))
                         .select("_id", "_s.*"))
    rules = train(stats, labels, train_rows)
    return stats.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"),
                        rules.score(F.col).alias("score")).withColumn(
        "predicted", (F.col("score") >= ACCEPT).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents whose score reaches the threshold, with their own columns."""
    bounded_batches(docs.sparkSession)
    stats = docs.select(F.col(id_col).alias("_id"), statistics(F.col(text_col)).alias("_s")).select("_id", "_s.*")
    rules = train(stats, labels, train_rows)
    scored = docs.select("*", statistics(F.col(text_col)).alias("_tf_s"))
    return scored.filter(rules.score(lambda s: F.col(f"_tf_s.{s}")) >= ACCEPT).drop("_tf_s")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                         spark.read.parquet(f"{sf_dir}/labels.parquet"))
