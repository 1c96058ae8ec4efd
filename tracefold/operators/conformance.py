"""Conformance checking against models given as tables (inventory group J, D6).

Models are small tables: a Petri net as ``places(place, m0, mf)`` and
``arcs(activity, place, phase, delta)`` (phase 0 / delta -1 consumes,
phase 1 / delta +1 produces), a directly-follows model as
``edges(a, b)``, an alignment reference as an ordered list of
activities. Model tables are joined without a hint (adaptive execution
broadcasts them when they are small); the log side stays distributed.

Token replay (S13) is a running sum, not a loop: every (event, arc) row is
a +1 / -1 on a (case, place) balance that starts with the initial marking
and ends by consuming the final marking. A consume from an empty place
creates a missing token, so missing = max(0, -lowest balance) and
remaining = produced + missing - consumed. The running sums use the
chunked case windows of ``plans.sequence``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import r6
from ..log import EventLog
from ..plans.sequence import running, sequenced

# Fixed model used by the registered queries (a visible net with unique
# labels): signup consumes i and produces p1, p2; view p1 -> q1; click
# p2 -> q2; purchase q1, q2 -> o; error p1, p2 -> o. One token in i at the
# start, one in o at the end.
FIXED_NET_PLACES = [("i", 1, 0), ("p1", 0, 0), ("p2", 0, 0), ("q1", 0, 0), ("q2", 0, 0), ("o", 0, 1)]
FIXED_NET_ARCS = [("signup", "i", 0, -1), ("signup", "p1", 1, 1), ("signup", "p2", 1, 1),
                  ("view", "p1", 0, -1), ("view", "q1", 1, 1),
                  ("click", "p2", 0, -1), ("click", "q2", 1, 1),
                  ("purchase", "q1", 0, -1), ("purchase", "q2", 0, -1), ("purchase", "o", 1, 1),
                  ("error", "p1", 0, -1), ("error", "p2", 0, -1), ("error", "o", 1, 1)]
# A second, sequential candidate net (signup, view, click,
# purchase in a row; error right after signup).
SEQUENTIAL_NET_PLACES = [("i", 1, 0), ("s1", 0, 0), ("s2", 0, 0), ("s3", 0, 0), ("o", 0, 1)]
SEQUENTIAL_NET_ARCS = [("signup", "i", 0, -1), ("signup", "s1", 1, 1),
                       ("view", "s1", 0, -1), ("view", "s2", 1, 1),
                       ("click", "s2", 0, -1), ("click", "s3", 1, 1),
                       ("purchase", "s3", 0, -1), ("purchase", "o", 1, 1),
                       ("error", "s1", 0, -1), ("error", "o", 1, 1)]
# Directly-follows edges allowed by the fixed net, with the
# artificial start and end symbols.
FIXED_EDGES = [("▶", "signup"), ("signup", "view"), ("signup", "click"), ("view", "click"),
               ("click", "view"), ("view", "purchase"), ("click", "purchase"), ("signup", "error"),
               ("purchase", "■"), ("error", "■")]
# Fixed reference sequence of the alignment stand-in.
REFERENCE_TRACE = ["signup", "view", "click", "purchase"]


def net_tables(spark: SparkSession, places=FIXED_NET_PLACES, arcs=FIXED_NET_ARCS) -> tuple[DataFrame, DataFrame]:
    p = spark.createDataFrame(places, "place string, m0 int, mf int")
    a = spark.createDataFrame(arcs, "activity string, place string, phase int, delta int")
    return p, a


def _check_net(arcs: DataFrame) -> None:
    """Replay needs visible, uniquely labelled transitions; refuse anything else."""
    bad = arcs.where(F.col("activity").isNull() | (F.col("activity") == "")).limit(1).count()
    if bad:
        raise ValueError("token replay needs visible transitions (no silent / empty labels)")
    if "transition" in arcs.columns:
        shared = arcs.groupBy("activity").agg(F.count_distinct("transition").alias("n")).where("n > 1")
        if shared.limit(1).count():
            raise ValueError("token replay needs uniquely labelled transitions")


def replay_moves(log: EventLog, places: DataFrame, arcs: DataFrame) -> tuple[DataFrame, EventLog]:
    """(case, place, delta, ...) rows with initial / final marking rows, as a log to scan."""
    _check_net(arcs)
    case = log.case
    ev = log.df.select(case, log.activity, *log.order_cols)
    moves = ev.join(arcs, log.activity).withColumn("_o", F.lit(1))
    first = log.order[0]
    span = log.df.groupBy(case).agg(F.min(first).alias("_t0"), F.max(first).alias("_t1"))
    marks = [r for r in places.collect() if (r["m0"] or 0) > 0 or (r["mf"] or 0) > 0]  # model-sized
    ends = []
    for r in marks:
        if r["m0"]:
            ends.append(F.struct(F.lit(r["place"]).alias("place"), F.lit(0).alias("_o"),
                                 F.lit(1).alias("phase"), F.lit(int(r["m0"])).alias("delta"),
                                 F.col("_t0").alias(first)))
        if r["mf"]:
            ends.append(F.struct(F.lit(r["place"]).alias("place"), F.lit(2).alias("_o"),
                                 F.lit(0).alias("phase"), F.lit(-int(r["mf"])).alias("delta"),
                                 F.col("_t1").alias(first)))
    if not ends:    # a net without markings: a row without place or tokens keeps every case
        ends = [F.struct(F.lit(None).cast("string").alias("place"), F.lit(0).alias("_o"), F.lit(1).alias("phase"),
                         F.lit(0).alias("delta"), F.col("_t0").alias(first))]
    init = span.select(case, F.inline(F.array(*ends)))
    for c in [*log.order[1:], *log.tie]:
        init = init.withColumn(c, F.lit(None).cast(dict(log.df.dtypes)[c]))
    init = init.withColumn(log.activity, F.lit(None).cast("string"))
    rows = moves.select(case, log.activity, "place", "phase", "delta", "_o", *log.order_cols) \
        .unionByName(init.select(case, log.activity, "place", "phase", "delta", "_o", *log.order_cols))
    rlog = EventLog(rows, order=(first,), tie=("_o", *log.order[1:], *log.tie, "phase"), case=case,
                    activity=log.activity, split_rows=log.split_rows, extra=log.extra)
    return rows, rlog


def replay_balances(log: EventLog, places: DataFrame, arcs: DataFrame) -> DataFrame:
    """Every replay row with the running balance of its (case, place)."""
    _, rlog = replay_moves(log, places, arcs)
    return running(rlog, None, [log.case, "place"], {"_bal": ("sum", F.col("delta"))})


def replay_lows(log: EventLog, places: DataFrame, arcs: DataFrame) -> DataFrame:
    """Balance rows with ``_created``: tokens a consuming row had to make up for (0 for the others)."""
    _, rlog = replay_moves(log, places, arcs)
    key = [log.case, "place"]
    b = running(rlog, None, key, {"_bal": ("sum", F.col("delta"))})
    low = running(rlog, b, key, {"_low": ("min", F.col("_bal"))}, inclusive=False)
    short = F.least(F.coalesce(F.col("_low"), F.lit(0)), F.lit(0)) - F.col("_bal")
    return low.withColumn("_created", F.when(F.col("delta") < 0, F.greatest(short, F.lit(0))).otherwise(F.lit(0)))


def replay_places(log: EventLog, places: DataFrame, arcs: DataFrame) -> DataFrame:
    """Per (case, place): produced, consumed, missing, remaining tokens."""
    b = replay_balances(log, places, arcs)
    return b.groupBy(log.case, "place").agg(
        F.sum(F.when(F.col("delta") > 0, F.col("delta")).otherwise(0)).alias("p"),
        F.sum(F.when(F.col("delta") < 0, -F.col("delta")).otherwise(0)).alias("c"),
        F.greatest(F.lit(0), -F.min("_bal")).alias("m")) \
        .withColumn("r", F.col("p") + F.col("m") - F.col("c"))


def replay_fitness_of(produced: Column, consumed: Column, missing: Column, remaining: Column) -> Column:
    """Mean of the two token shares; a side without tokens has nothing wrong."""
    part = lambda bad, all_: F.when(all_ == 0, F.lit(1.0)).otherwise(1 - F.try_divide(bad, all_))
    return 0.5 * part(remaining, produced) + 0.5 * part(missing, consumed)


def token_replay(log: EventLog, places: DataFrame, arcs: DataFrame) -> DataFrame:
    """J1 (S13): per case produced, consumed, missing, remaining, fitness, fit flag, skipped events."""
    pl = replay_places(log, places, arcs)
    per = pl.groupBy(log.case).agg(*[F.sum(x).cast("long").alias(n) for x, n in
                                     (("p", "produced"), ("c", "consumed"), ("m", "missing"), ("r", "remaining"))])
    acts = arcs.select(F.col("activity").alias(log.activity)).distinct()
    skipped = (log.df.join(acts, log.activity, "left_anti")
               .groupBy(log.case).agg(F.count(F.lit(1)).alias("skipped")))
    fit = replay_fitness_of(F.col("produced"), F.col("consumed"), F.col("missing"), F.col("remaining"))
    return (per.join(skipped, log.case, "left")
            .select(log.case, "produced", "consumed", "missing", "remaining",
                    r6(fit).alias("fitness"),
                    ((F.col("missing") == 0) & (F.col("remaining") == 0)).alias("is_fit"),
                    F.coalesce("skipped", F.lit(0)).cast("long").alias("skipped")))


def replay_problems(log: EventLog, places: DataFrame, arcs: DataFrame) -> DataFrame:
    """The consume rows that create missing tokens (case, transition, place, tokens)."""
    return (replay_lows(log, places, arcs).where(F.col("_created") > 0)
            .select(log.case, F.coalesce(F.col(log.activity), F.lit("(final marking)")).alias("transition"),
                    "place", *log.order_cols, F.col("_created").cast("long").alias("missing_tokens")))


def unfit_case_signatures(log: EventLog, places: DataFrame, arcs: DataFrame) -> DataFrame:
    """J3 (ids): every unfit case with its problem signature and token counts.

    Signature = sorted distinct tags 'missing:<transition>@<place>' and
    'remaining:<place>'; one row per case, so no id list is gathered into a row.
    """
    tag = F.concat(F.lit("missing:"), F.coalesce(F.col(log.activity), F.lit("(final marking)")), F.lit("@"), "place")
    # one balance table feeds the tokens and the tags of every place
    per_place = replay_lows(log, places, arcs).groupBy(log.case, "place").agg(
        F.sum("delta").alias("_left"), F.greatest(F.lit(0), -F.min("_bal")).alias("m"),
        F.collect_set(F.when(F.col("_created") > 0, tag)).alias("_tags")).withColumn("r", F.col("_left") + F.col("m"))
    left_over = F.when(F.col("r") > 0, F.array(F.concat(F.lit("remaining:"), "place"))).otherwise(
        F.array().cast("array<string>"))
    return (per_place.groupBy(log.case).agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat("_tags", left_over))))), ";")
        .alias("signature"), F.sum("m").cast("long").alias("missing"), F.sum("r").cast("long").alias("remaining"))
        .where((F.col("missing") > 0) | (F.col("remaining") > 0)))


def anomalous_cases(log: EventLog, places: DataFrame, arcs: DataFrame) -> DataFrame:
    """Unfit cases grouped by problem signature: count, share, tokens, one example case.

    The ids themselves are ``unfit_case_signatures`` (one row per case).
    """
    j = unfit_case_signatures(log, places, arcs)
    n_all = log.df.select(F.count_distinct(log.case)).scalar()
    return j.groupBy("signature").agg(
        F.count(F.lit(1)).alias("n_cases"), F.sum("missing").alias("missing_tokens"),
        F.sum("remaining").alias("remaining_tokens"), F.min(log.case).alias("example_case")
    ).withColumn("pct_cases", r6(F.col("n_cases") * 100.0 / n_all))


def replay_diagnostics_places(log: EventLog, places: DataFrame, arcs: DataFrame) -> DataFrame:
    """J4 (places): cases under-fed (missing tokens) and over-fed (remaining) per place."""
    pl = replay_places(log, places, arcs)
    return pl.groupBy("place").agg(F.count_if(F.col("m") > 0).alias("underfed_cases"),
                                   F.count_if(F.col("r") > 0).alias("overfed_cases"),
                                   F.sum("m").cast("long").alias("missing_tokens"),
                                   F.sum("r").cast("long").alias("remaining_tokens"))


def replay_outside(log: EventLog, arcs: DataFrame) -> DataFrame:
    """J4 (outside): events and cases of every activity the model does not have."""
    known = arcs.select(F.col("activity").alias(log.activity)).distinct()
    return log.df.join(known, log.activity, "left_anti").groupBy(F.col(log.activity).alias("activity")).agg(
        F.count(F.lit(1)).alias("n_events"), F.count_distinct(log.case).alias("n_cases"))


def replay_diagnostics_transitions(log: EventLog, places: DataFrame, arcs: DataFrame) -> DataFrame:
    """J4 (transitions): fit / unfit cases containing each transition and their median duration."""
    from .timing import case_durations, group_median
    tr = token_replay(log, places, arcs).select(log.case, "is_fit")
    dur = case_durations(log).select(log.case, "duration_us")
    has = log.df.select(log.case, F.col(log.activity).alias("transition")).distinct()
    x = has.join(tr, log.case).join(dur, log.case)
    counts = x.groupBy("transition").agg(F.count_if("is_fit").alias("fit_cases"),
                                         F.count_if(~F.col("is_fit")).alias("unfit_cases"))
    med = group_median(x, ["transition", "is_fit"], "duration_us")
    pv = med.groupBy("transition").agg(
        F.max(F.when(F.col("is_fit"), F.col("median"))).alias("_mf"),
        F.max(F.when(~F.col("is_fit"), F.col("median"))).alias("_mu"))
    return counts.join(pv, "transition", "left").select(
        "transition", "fit_cases", "unfit_cases",
        (F.col("_mf") / 1e6).alias("median_fit_s"), (F.col("_mu") / 1e6).alias("median_unfit_s"))


def edge_conformance(log: EventLog, edges: DataFrame) -> DataFrame:
    """Each case's directly-follows steps (with ▶ / ■ ends) checked against allowed edges."""
    from .discovery import START_SYMBOL, END_SYMBOL
    s = sequenced(log, carry=("activity",))
    inner = s.select(log.case, F.coalesce("prev_activity", F.lit(START_SYMBOL)).alias("a"),
                     F.col("activity").alias("b"))
    ends = s.where(F.col("next_activity").isNull()).select(log.case, F.col("activity").alias("a"),
                                                           F.lit(END_SYMBOL).alias("b"))
    steps = inner.unionByName(ends)
    ok = edges.select("a", "b").distinct().withColumn("_ok", F.lit(True))
    j = steps.join(ok, ["a", "b"], "left")
    per = j.groupBy(log.case).agg(F.count(F.lit(1)).alias("n_steps"), F.count("_ok").alias("n_allowed"))
    return per.select(log.case, "n_steps", "n_allowed", (F.col("n_steps") - F.col("n_allowed")).alias("n_deviations"),
                      r6(F.col("n_allowed") / F.col("n_steps")).alias("fitness"))


# ------------------------------------------------------------------ alignment tables

def positional_moves(log: EventLog, reference: Sequence[str] = REFERENCE_TRACE) -> DataFrame:
    """Alignment stand-in: each case against ``reference`` position by position.

    Equal activities are a synchronous move; otherwise a log move (model
    side NULL) and a model move (log side NULL). Rows: (case, pos,
    log_act, model_act).
    """
    s = sequenced(log, carry=()).select(log.case, "pos", F.col(log.activity).alias("log_act"))
    ref = F.array(*[F.struct(F.lit(i).cast("long").alias("pos"), F.lit(a).alias("model_act"))
                    for i, a in enumerate(reference)])
    model = log.df.select(log.case).distinct().select(log.case, F.inline(ref))
    j = s.join(model, [log.case, "pos"], "full_outer")
    sync = F.col("log_act") == F.col("model_act")
    mv = F.when(sync, F.array(F.struct(F.col("log_act").alias("l"), F.col("model_act").alias("m")))) \
        .otherwise(F.filter(F.array(F.struct(F.col("log_act").alias("l"), F.lit(None).cast("string").alias("m")),
                                    F.struct(F.lit(None).cast("string").alias("l"), F.col("model_act").alias("m"))),
                            lambda x: x["l"].isNotNull() | x["m"].isNotNull()))
    return j.select(log.case, "pos", F.inline(mv)).select(
        log.case, "pos", F.col("l").alias("log_act"), F.col("m").alias("model_act"))


def alignment_costs(moves: DataFrame, case: str = "case_id") -> DataFrame:
    """Per case: cost (non-synchronous moves), log and model length, fitness 1 - cost / worst."""
    per = moves.groupBy(case).agg(
        F.count_if(F.col("log_act").isNull() | F.col("model_act").isNull()).alias("cost"),
        F.count("log_act").alias("log_len"), F.count("model_act").alias("model_len"))
    return per.withColumn("fitness", r6(1 - F.col("cost") / (F.col("log_len") + F.col("model_len"))))


def alignment_summary(costs: DataFrame, case: str = "case_id") -> DataFrame:
    """Fitting vs not: count, share, mean / min / max cost, min / max fitness with case ids."""
    n_all = costs.select(F.count(F.lit(1))).scalar()
    key = F.struct("fitness", case)
    return costs.groupBy((F.col("cost") == 0).alias("is_fit")).agg(
        F.count(F.lit(1)).alias("n_cases"), r6(F.avg("cost")).alias("mean_cost"),
        F.min("cost").alias("min_cost"), F.max("cost").alias("max_cost"),
        F.min("fitness").alias("min_fitness"), F.min_by(case, key).alias("min_fitness_case"),
        F.max("fitness").alias("max_fitness"), F.max_by(case, key).alias("max_fitness_case"),
    ).withColumn("share", r6(F.col("n_cases") / n_all))


def anomaly_odds(costs: DataFrame) -> DataFrame:
    """Unfit share and odds unfit / fit."""
    return costs.agg(F.count_if(F.col("cost") > 0).alias("n_unfit"), F.count_if(F.col("cost") == 0).alias("n_fit")) \
        .select("n_unfit", "n_fit", r6(F.try_divide(F.col("n_unfit").cast("double"), F.col("n_unfit") + F.col("n_fit"))).alias("unfit_share"),
                r6(F.try_divide(F.col("n_unfit").cast("double"), F.col("n_fit"))).alias("odds_unfit_fit"))


def model_move_pairs(moves: DataFrame, case: str = "case_id") -> DataFrame:
    """Log moves paired with model moves of the same activity in the same case."""
    lm = moves.where(F.col("model_act").isNull()).select(case, F.col("log_act").alias("activity"), F.col("pos").alias("log_pos"))
    mm = moves.where(F.col("log_act").isNull()).select(case, F.col("model_act").alias("activity"), F.col("pos").alias("model_pos"))
    return lm.join(mm, [case, "activity"])


def anomaly_classes(moves: DataFrame, case: str = "case_id") -> DataFrame:
    """Skip / Insert / Early / Late per case and activity (distinct rows).

    One row per (case, activity) with the first and last place on each side
    decides all classes: some model place before some log place is Late,
    some model place at or behind some log place is Early.
    """
    log_side, model_side = F.col("model_act").isNull(), F.col("log_act").isNull()
    per = (moves.where(log_side | model_side).groupBy(case, F.coalesce("log_act", "model_act").alias("activity"))
           .agg(F.min(F.when(log_side, F.col("pos"))).alias("l0"), F.max(F.when(log_side, F.col("pos"))).alias("l1"),
                F.min(F.when(model_side, F.col("pos"))).alias("m0"), F.max(F.when(model_side, F.col("pos"))).alias("m1")))
    kinds = F.array_compact(F.array(
        F.when(F.col("l0").isNull(), F.lit("Skip")), F.when(F.col("m0").isNull(), F.lit("Insert")),
        F.when(F.col("m0") < F.col("l1"), F.lit("Late")), F.when(F.col("m1") >= F.col("l0"), F.lit("Early"))))
    return per.select(case, "activity", F.explode(kinds).alias("class"))


def consensus_sequence(log: EventLog, groups: DataFrame | None = None) -> DataFrame:
    """Per position the most frequent activity (ties: name asc), its count and share.

    ``groups`` (case_id, grp) splits the traces (e.g. regular / irregular);
    the share's denominator is the number of traces in the group.
    """
    s = sequenced(log, carry=()).select(log.case, "pos", F.col(log.activity).alias("activity"))
    if groups is None:
        groups = log.df.select(log.case).distinct().withColumn("grp", F.lit("all"))
    s = s.join(groups, log.case)
    n = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n_traces"))
    c = s.groupBy("grp", "pos", "activity").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("grp", "pos").orderBy(F.col("n").desc(), F.col("activity").asc())
    top = c.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return top.join(n, "grp").select("grp", "pos", F.col("activity").alias("mode"), F.col("n").alias("count"),
                                     r6(F.col("n") / F.col("n_traces")).alias("share"))


# ------------------------------------------------------------------ alignments to model traces

# The language of the fixed net (its complete firing sequences).
FIXED_NET_TRACES = [["signup", "error"], ["signup", "view", "click", "purchase"],
                    ["signup", "click", "view", "purchase"]]


def nearest_trace_alignment(log: EventLog, traces=FIXED_NET_TRACES) -> DataFrame:
    """See ``operators.alignment``; by default against the language of the fixed net."""
    from . import alignment
    return alignment.nearest_trace_alignment(log, traces)


def alignment_moves(log: EventLog, traces=FIXED_NET_TRACES) -> DataFrame:
    """See ``operators.alignment``; by default against the language of the fixed net."""
    from . import alignment
    return alignment.alignment_moves(log, traces)
