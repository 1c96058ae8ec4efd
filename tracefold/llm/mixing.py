"""Mixing sources to target weights by entropy balancing (operator 1, native)."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranking import global_rank_sum
from .common import WORD, checkpointed

WEIGHTS = (5, 2, 1)     # of the sources in code point order, repeating
BUDGET = (3, 2)         # words of the mix over words of the corpus: 150 percent
MOST = 2                # copies of a document
SALT = 256              # parts of the documents of one source and size
UNIT = 1 << 20          # parts of a copy in which rates are added up
NEWTON_ROUNDS = 60      # then the brackets are halved; about ten are used
CLOSE = 1e-6            # of a target, where Newton stops
SEED = 17


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Sorts as the sources' code points, null last; never null."""
    return F.when(source.isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), source.cast("string")))


def exact(x: Column) -> Column:
    """Whole thousandths: their sums do not depend on the order of adding."""
    return F.round(x * 1000).cast("decimal(38,0)")


def targets(groups: DataFrame, weights=WEIGHTS, budget=BUDGET, most=MOST) -> DataFrame:
    """``(_k, source_size, target)`` from ``(_k, _size, _n)``: shares by weight up to ``most`` times the source.

    The words per weight unit rise from round to round as capped sources
    hand on their excess; a source is capped when its share is above its
    limit, so one number describes a round, until none is new. Sources are
    numbered by a distributed rank.
    """
    sizes = groups.groupBy("_k").agg(F.sum(F.col("_size") * F.col("_n")).alias("source_size"))
    ranked = global_rank_sum(sizes, [F.col("_k")], rank_name="_rank")
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod("_rank", F.lit(len(weights))).cast("int"))
    src = checkpointed(ranked.select("_k", "source_size", weight.cast("long").alias("_w")))
    total = int(src.agg(F.sum("source_size")).first()[0] or 0) * budget[0] / budget[1]
    unit, seen = 0.0, -1
    while True:
        over = F.col("_w") * F.lit(unit) > most * F.col("source_size")
        row = src.agg(F.sum(F.when(over, most * F.col("source_size"))).alias("full"),
                      F.sum(F.when(~over, F.col("_w"))).alias("open"),
                      F.sum(over.cast("long")).alias("n")).first()
        if not row["open"] or row["n"] == seen:
            break
        seen, unit = row["n"], (total - int(row["full"] or 0)) / int(row["open"])
    return src.select("_k", "source_size", F.least(F.col("_w") * F.lit(unit), most * F.col("source_size").cast("double"))
                      .alias("target"))


def rate(tilt: Column, most: int = MOST) -> Column:
    """Entropy-balanced rate between none and ``most`` copies; one copy at no tilt for ``most`` = 2."""
    return most / (1 + F.exp(-F.greatest(F.least(tilt, F.lit(700.0)), F.lit(-700.0))))


def balance(groups: DataFrame, goals: DataFrame, most: int = MOST) -> DataFrame:
    """Rates ``_r`` of the groups ``(_k, _size, _n)``.

    Among all rates between 0 and ``most`` that meet the sources' word
    targets, those of least relative entropy to one copy each are
    exponential tilts of the odds: r = most / (1 + exp(-l u)), where u are
    the document's words over its source's mean. The dual in l is convex and
    has one number per source; Newton steps for all sources together, each a
    grouped sum over (source, size) groups and a join, kept inside a
    bracket. Rounds go on until every source is close or its bracket holds
    no other number; after ``NEWTON_ROUNDS`` each round halves the brackets,
    so they end. Sums are over whole thousandths, so reruns agree bit for bit.
    Sources at their limit take ``most`` of everything.
    """
    mean = F.col("source_size") / F.col("_docs")
    base = groups.groupBy("_k").agg(F.sum("_n").alias("_docs")).join(goals, "_k").filter("source_size > 0")
    now = checkpointed(base.select("_k", "source_size", "target", mean.alias("_mean"), F.lit(0.0).alias("_l"),
                                   F.lit(-1e9).alias("_lo"), F.lit(1e9).alias("_hi"),
                                   (F.col("target") >= most * F.col("source_size")).alias("_done")))
    for turn in count():
        u = F.col("_size") / F.col("_mean")
        r = rate(F.col("_l") * u, most)
        words = F.col("_n") * F.col("_size")
        sums = (groups.filter("_size > 0").join(now.filter("not _done"), "_k").groupBy("_k")
                .agg(F.sum(exact(words * r)).alias("_g"), F.sum(exact(words * u * r * (1 - r / most))).alias("_h")))
        gap = F.col("_g").cast("double") / 1000 - F.col("target")
        slope = F.col("_h").cast("double") / 1000
        lo = F.when(gap < 0, F.col("_l")).otherwise(F.col("_lo"))
        hi = F.when(gap > 0, F.col("_l")).otherwise(F.col("_hi"))
        trust = 1 + 2 * F.abs("_l")     # steps at most triple a multiplier
        step = F.when(slope > 0, F.greatest(F.least(-gap / slope, trust), -trust)).otherwise(
            F.when(gap > 0, -trust).otherwise(trust))
        new = F.col("_l") + step
        inside = (new > lo) & (new < hi) & F.lit(turn < NEWTON_ROUNDS)
        middle = (lo + hi) / 2
        moved = now.join(sums, "_k", "left").select(
            "_k", "source_size", "target", "_mean",
            F.when(F.col("_done") | gap.isNull(), F.col("_l")).when(inside, new).otherwise(middle).alias("_l"),
            F.coalesce(lo, "_lo").alias("_lo"), F.coalesce(hi, "_hi").alias("_hi"),
            (F.col("_done") | F.coalesce((F.abs(gap) <= CLOSE * F.col("target")) | (middle <= lo) | (middle >= hi),
                                         F.lit(True))).alias("_ready"),
            "_done")
        # a source that is close enough keeps the multiplier it was measured with
        now = checkpointed(now.select("_k", F.col("_l").alias("_was")).join(moved, "_k").select(
            "_k", "source_size", "target", "_mean",
            F.when(F.col("_ready"), F.col("_was")).otherwise(F.col("_l")).alias("_l"), "_lo", "_hi",
            F.col("_ready").alias("_done")))
        if not now.filter("not _done").limit(1).count():
            break
    tilt = F.col("_l") * F.col("_size") / F.col("_mean")
    full = F.col("target") >= most * F.col("source_size")
    return (groups.join(now.select("_k", "source_size", "target", "_mean", "_l"), "_k", "left")
            .select("_k", "_size", "_n", F.when(F.col("_l").isNull(), F.lit(1.0)).when(full, F.lit(float(most)))
                    .otherwise(rate(tilt, most)).alias("_r"),
                    F.coalesce("target", F.lit(0.0)).alias("target"),
                    F.coalesce("source_size", F.lit(0)).alias("source_size")))


def whole_copies(rated: DataFrame, most: int = MOST) -> DataFrame:
    """Copies ``_c`` of each (source, size) group, near the target to the word.

    Rates are added up from the smallest size on and a copy is given at each
    whole number passed; neighbours differ little in size, so the error is
    at most one longest document. Then it is taken back: each round changes
    copies of the largest size that still fits the error, which shrinks each
    time, until no size does. Windows are over the distinct sizes of a source, not its documents.
    """
    order = Window.partitionBy("_k").orderBy("_size")
    run = F.sum(F.round(F.col("_n") * F.col("_r") * UNIT).cast("decimal(38,0)")).over(
        order.rowsBetween(Window.unboundedPreceding, 0))
    passed = F.floor((F.col("_run") + UNIT // 2) / UNIT).cast("long")
    now = checkpointed(rated.withColumn("_run", run).withColumn("_passed", passed).withColumn(
        "_c", F.least(F.greatest(F.col("_passed") - F.lag("_passed", 1, 0).over(order), F.lit(0)), most * F.col("_n")))
        .drop("_run", "_passed"))
    while True:
        gap = now.groupBy("_k").agg((F.first("target") - F.sum(F.col("_c") * F.col("_size"))).alias("_gap"))
        fit = F.floor(F.abs("_gap") / F.col("_size")).cast("long")
        room = F.when(F.col("_gap") > 0, most * F.col("_n") - F.col("_c")).otherwise(F.col("_c"))
        change = F.least(fit, room) * F.when(F.col("_gap") > 0, 1).otherwise(-1)
        best = (now.filter("_size > 0").join(gap, "_k").filter((fit > 0) & (room > 0)).groupBy("_k")
                .agg(F.max(F.struct("_size", change.alias("_d"))).alias("_b"))
                .select("_k", F.col("_b._size").alias("_size"), F.col("_b._d").alias("_d")))
        best = checkpointed(best)
        if not best.limit(1).count():
            break
        now = checkpointed(now.join(best, ["_k", "_size"], "left").withColumn("_c", F.col("_c") + F.coalesce("_d", F.lit(0)))
                           .drop("_d"))
    return now


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        size_col: str | None = None, weights=WEIGHTS, budget=BUDGET, most: int = MOST) -> DataFrame:
    """``docs`` with ``_tf_size``, ``_tf_source_size``, ``_tf_target`` and ``_tf_copies``.

    Documents are counted by (source, size, part by id hash); everything
    iterative runs on (source, size) groups. The copies of a group are dealt
    to its documents by hash order: counts of the parts give each part's
    first place, a window inside the part the rest, so a source or a size
    that holds a third of all rows is ranked in many parts.
    """
    sized = docs.withColumns({
        "_tf_k": source_key(F.col(source_col)),
        "_tf_size": F.col(size_col).cast("long") if size_col else n_words(F.col(text_col)),
        "_tf_hash": F.xxhash64(F.col(id_col), F.lit(SEED))}).withColumn(
        "_tf_part", F.pmod("_tf_hash", F.lit(SALT)).cast("int"))
    cells = checkpointed(sized.groupBy(F.col("_tf_k").alias("_k"), F.col("_tf_size").alias("_size"),
                                       F.col("_tf_part").alias("_part")).agg(F.count(F.lit(1)).alias("_n")))
    groups = checkpointed(cells.groupBy("_k", "_size").agg(F.sum("_n").alias("_n")))
    goals = checkpointed(targets(groups, weights, budget, most))
    dealt = whole_copies(balance(groups, goals, most), most)
    before = F.sum("_n").over(Window.partitionBy("_k", "_size").orderBy("_part")
                              .rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    plan = (cells.withColumn("_before", before).drop("_n").join(dealt, ["_k", "_size"])
            .select(F.col("_k").alias("_tf_k"), F.col("_size").alias("_tf_size"), F.col("_part").alias("_tf_part"),
                    "_before", F.floor(F.col("_c") / F.col("_n")).cast("long").alias("_each"),
                    (F.col("_c") % F.col("_n")).alias("_more"), F.col("target").alias("_tf_target"),
                    F.col("source_size").cast("long").alias("_tf_source_size")))
    keys = ["_tf_k", "_tf_size", "_tf_part"]
    tie = [F.xxhash64(F.col(text_col))] if text_col else []     # repeated ids with other texts
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_tf_hash", id_col, *tie)) - 1 + F.col("_before")
    return (sized.join(plan, keys).withColumn("_tf_copies", F.col("_each") + (rank < F.col("_more")).cast("long"))
            .select(*docs.columns, "_tf_size", "_tf_source_size", "_tf_target", "_tf_copies"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every document as many times as it is taken, with its own columns.

    Documents without words take no part in targets and follow their group;
    repeated rows are documents each, and which of the rows of one id and
    size is taken does not change between reruns; an empty table gives no rows.
    """
    taken = mix(docs, id_col, text_col, source_col).filter("_tf_copies > 0")
    return taken.withColumn("_tf_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_tf_copies"))).select(*docs.columns)


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Size, target and taken words of every document.

    Returns id, ``size``, ``source_size``, ``target`` (of its source),
    ``copies`` and ``taken`` (copies times size). Null and wordless texts
    have size zero and take no words; documents without a source form the
    last source; repeated rows are mixed each; an empty table gives no rows;
    other columns are ignored.
    """
    slim = checkpointed(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"),
                                    n_words(F.col(text_col)).alias("_words")))
    taken = mix(slim, "_id", "", "_source", size_col="_words")
    return taken.select(F.col("_id").alias(id_col), F.col("_tf_size").alias("size"),
                        F.col("_tf_source_size").alias("source_size"), F.col("_tf_target").alias("target"),
                        F.col("_tf_copies").alias("copies"),
                        (F.col("_tf_copies") * F.col("_tf_size")).alias("taken"))


def op1_mix(spark, sf_dir: str) -> DataFrame:
    """All documents mixed to the sources' targets."""
    return mix_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
