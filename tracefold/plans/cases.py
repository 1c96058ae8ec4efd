"""Case-level tables and the "find case ids, keep their events" pattern.

Case aggregates are plain ``groupBy(case).agg`` with partial (map-side)
aggregation, so a hot case costs one row per map task in the shuffle.
Keeping the events of qualifying cases is a ``left_semi`` join; AQE's
skew-join handling splits a hot case on the event side.

The text of a variant is unambiguous: a separator or backslash inside an
activity name is escaped by a backslash, so equal texts are equal traces.

Counting and filtering variants needs no text. A trace is known by its
*signature*: its length and two 64-bit sums (exclusive or) over hashes of
(activity, place in the case). Places make it sensitive to order, and the
sums merge in any grouping, so the slices of a long case are added up like
any partial aggregate and no task ever holds a case. Two different traces
share a signature with a chance of 2^-128.

Texts are made for shown variants only, from one case of each, in two
levels: the activities of each (case, chunk) are joined in order, then the
chunk texts of a case in chunk order, so a long case is never sorted as one
group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..log import EventLog, VARIANT_SEP, micros
from ..session import ensure_checkpoint_dir
from .ranking import global_rank_sum
from .sequence import sequenced, with_chunks

# Columns of a trace's signature.
SIGNATURE = ["variant_len", "_v1", "_v2"]


def case_table(log: EventLog, *aggs: Column) -> DataFrame:
    """One row per case: size, first / last order value, plus ``aggs``."""
    o = F.struct(*[F.col(c) for c in log.order_cols])
    base = [F.count(F.lit(1)).alias("case_size"),
            F.min_by(F.col(log.activity), o).alias("first_activity"),
            F.max_by(F.col(log.activity), o).alias("last_activity")]
    if "ts" in log.df.columns:
        base += [F.min("ts").alias("case_start"), F.max("ts").alias("case_end")]
    return log.df.groupBy(log.case).agg(*base, *aggs)


def keep_cases(log: EventLog, case_ids: DataFrame, negate: bool = False) -> EventLog:
    """Events of the cases in ``case_ids`` (or of the others)."""
    how = "left_anti" if negate else "left_semi"
    ids = case_ids.select(log.case)
    return log.with_df(log.df.join(ids, log.case, how))


def duration_us(start: Column, end: Column) -> Column:
    return micros(end) - micros(start)


def escaped(name: Column, sep: str = VARIANT_SEP) -> Column:
    """Activity name as it stands in a variant text (the separator's first sign escaped)."""
    return F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit(sep[0]), F.lit("\\" + sep[0]))


def variant_text(activities, sep: str = VARIANT_SEP) -> str:
    """Variant text of a Python sequence of activity names."""
    return sep.join(a.replace("\\", "\\\\").replace(sep[0], "\\" + sep[0]) for a in activities)


def case_variants(log: EventLog, sep: str = VARIANT_SEP, name: str = "variant",
                  value: str | None = None) -> DataFrame:
    """(case_id, variant, variant_len): the case's activities joined by ``sep``.

    Only hot (cut) cases take the second step that joins slice texts; all
    other cases are finished by the first aggregation.
    """
    df, cut = with_chunks(log, flag=True)
    keys = [log.case, "_chunk", "_hot"] if cut else [log.case]
    ordered = F.sort_array(F.collect_list(
        F.struct(*[F.col(c) for c in log.order_cols], escaped(F.col(value or log.activity), sep).alias("_a"))))
    per = df.groupBy(*keys).agg(
        F.array_join(ordered["_a"], sep).alias("_txt"),
        F.count(F.lit(1)).alias("_len"))
    if not cut:
        return per.select(log.case, F.col("_txt").alias(name),
                          F.col("_len").alias(f"{name}_len"))
    cold = per.where(~F.col("_hot")).select(log.case, F.col("_txt").alias(name),
                                            F.col("_len").alias(f"{name}_len"))
    texts = F.sort_array(F.collect_list(F.struct("_chunk", "_txt")))
    hot = per.where(F.col("_hot")).groupBy(log.case).agg(
        F.array_join(texts["_txt"], sep).alias(name),
        F.sum("_len").alias(f"{name}_len"))
    return cold.unionByName(hot)


def case_arrays(log: EventLog, cols) -> DataFrame:
    """(case_id, events ARRAY<STRUCT>) in case order; chunk arrays are concatenated.

    By definition one row holds a whole case; the sort happens per chunk,
    so no task sorts a hot case on its own.
    """
    df, cut = with_chunks(log, flag=True)
    keys = [log.case, "_chunk", "_hot"] if cut else [log.case]
    st = F.struct(*[F.col(c) for c in log.order_cols],
                  *[F.col(c).alias(f"v_{c}") for c in cols])
    per = df.groupBy(*keys).agg(F.sort_array(F.collect_list(st)).alias("_arr"))
    if cut:
        hot = per.where(F.col("_hot")).groupBy(log.case).agg(
            F.flatten(F.sort_array(F.collect_list(F.struct("_chunk", "_arr")))["_arr"]).alias("_arr"))
        per = per.where(~F.col("_hot")).select(log.case, "_arr").unionByName(hot)
    proj = F.transform("_arr", lambda x: F.struct(*[x[f"v_{c}"].alias(c) for c in cols]))
    return per.select(log.case, proj.alias("events"))


def _signature(activity: Column, pos: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("variant_len"), F.bit_xor(F.xxhash64(activity, pos)).alias("_v1"),
            F.bit_xor(F.xxhash64(pos, activity, F.lit("second"))).alias("_v2")]


def case_signatures(log: EventLog) -> DataFrame:
    """(case, ``SIGNATURE``): one slim row per case, from places and a mergeable sum."""
    return sequenced(log, carry=()).groupBy(log.case).agg(*_signature(F.col(log.activity), F.col("pos")))


def trace_signatures(spark: SparkSession, traces) -> DataFrame:
    """Signatures of given traces (lists of activity names; the empty trace has none)."""
    rows = [(k, pos, a) for k, t in enumerate(traces) for pos, a in enumerate(t)]
    df = spark.createDataFrame(rows, "_k long, pos long, activity string")
    return df.groupBy("_k").agg(*_signature(F.col("activity"), F.col("pos"))).select(*SIGNATURE).distinct()


def variant_activities(text: str, sep: str = VARIANT_SEP) -> list[str]:
    """Activity names of a variant text: the way back of ``variant_text``."""
    out, name, at = [], "", 0
    while at < len(text):
        if text[at] == "\\":
            name, at = name + text[at + 1:at + 2], at + 2
        elif text.startswith(sep, at):
            out, name, at = [*out, name], "", at + len(sep)
        else:
            name, at = name + text[at], at + 1
    return [*out, name]


def kept_once(df: DataFrame) -> DataFrame:
    """Reliable copy of a table that several jobs read, one slim row per case or variant."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def variant_table(log: EventLog, signatures: DataFrame) -> DataFrame:
    """(``SIGNATURE``, n_cases, ``_rep``): one row per variant, with its smallest case id to show it by."""
    return signatures.groupBy(*SIGNATURE).agg(F.count(F.lit(1)).alias("n_cases"), F.min(log.case).alias("_rep"))


def with_variant_text(log: EventLog, variants: DataFrame, sep: str = VARIANT_SEP, name: str = "variant") -> DataFrame:
    """Rows of a variant table with the text of their ``_rep`` case; other cases' events are not gathered."""
    reps = keep_cases(log, variants.select(F.col("_rep").alias(log.case)))
    text = case_variants(reps, sep, name).select(F.col(log.case).alias("_rep"), name)
    return variants.join(text, "_rep")


def level_at(variants: DataFrame, amount: Column, limit) -> Row | None:
    """The first level of equal ``n_cases``, from the most frequent down, whose running ``amount`` exceeds ``limit``.

    ``k``: its variants, ``run``: amount up to and with it. None if no level
    does. N cases have at most sqrt(2 N) different frequencies, so the
    levels are few and one window orders them.
    """
    down = Window.orderBy(F.col("n_cases").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = variants.groupBy("n_cases").agg(F.count(F.lit(1)).alias("k"))
    run = F.sum(amount).over(down)
    return levels.select("n_cases", "k", run.alias("run")).where(F.col("run") > F.lit(limit)).orderBy(
        F.col("n_cases").desc()).limit(1).first()


def first_of_level(log: EventLog, variants: DataFrame, n_cases: int, first: int, many: int) -> DataFrame:
    """Variants of one frequency with ranks ``first`` to ``first + many - 1`` in text order (``rank0`` added)."""
    level = with_variant_text(log, variants.where(F.col("n_cases") == n_cases))
    ranked = global_rank_sum(level, [F.col("variant").asc()], {}, "rank0")
    return ranked.where((F.col("rank0") >= first) & (F.col("rank0") < first + many))


def variant_counts(log: EventLog) -> DataFrame:
    """(variant, n_cases) over the whole log."""
    return with_variant_text(log, kept_once(variant_table(log, case_signatures(log)))).select("variant", "n_cases")
