"""Model evaluation: fitness, precision, generalization, simplicity, score (group K).

All metrics are aggregates over the log joined with small model tables;
the only per-event work is the replay of ``conformance`` and, for ETC
precision, two chunked running passes over the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import r6
from ..log import EventLog
from ..plans.sequence import running
from .conformance import replay_fitness_of, token_replay


def replay_fitness(log: EventLog, places: DataFrame, arcs: DataFrame) -> DataFrame:
    """K1: percentage of fitting cases, mean case fitness, log fitness (null for a log without cases)."""
    tr = token_replay(log, places, arcs)
    raw = replay_fitness_of(F.col("produced"), F.col("consumed"), F.col("missing"), F.col("remaining"))
    whole = replay_fitness_of(*[F.sum(c) for c in ("produced", "consumed", "missing", "remaining")])
    return tr.agg(
        r6(F.try_divide(F.count_if("is_fit") * 100.0, F.count(F.lit(1)))).alias("perc_fit_traces"),
        r6(F.avg(raw)).alias("average_trace_fitness"),
        r6(whole).alias("log_fitness"))


def _net(places: DataFrame, arcs: DataFrame):
    """Model-sized lists: places with markings, transitions with input places (driver side)."""
    P = [(r["place"], int(r["m0"] or 0)) for r in places.collect()]
    A = [(r["activity"], r["place"], int(r["phase"]), int(r["delta"])) for r in arcs.collect()]
    T = sorted({a for a, _, _, _ in A})
    inputs = {t: sorted({p for a, p, ph, d in A if a == t and d < 0}) for t in T}
    return P, A, T, inputs


def etc_precision(log: EventLog, places: DataFrame, arcs: DataFrame) -> DataFrame:
    """K2 (S14): ETC precision over fitting log prefixes weighted by the cases having them.

    Prefix identity: (length, two position-salted 64-bit hash sums), so no
    prefix text is built; the marking before each event comes from running
    sums of the per-place token deltas. Null for an empty log and for a net
    that never has a transition enabled.
    """
    P, A, T, inputs = _net(places, arcs)
    act = F.col(log.activity)
    deltas = {}
    for p, _ in P:
        e = F.lit(0)
        for a, pl, ph, d in A:
            if pl == p:
                e = e + F.when(act == a, F.lit(d)).otherwise(0)
        deltas[p] = e
    base = log.with_df(log.df.select(log.case, log.activity, *log.order_cols))
    r1 = running(base, None, [log.case],
                 {"_pos": ("sum", F.lit(1)), **{f"_d_{i}": ("sum", deltas[p]) for i, (p, _) in enumerate(P)}},
                 inclusive=False)
    mark = {p: F.col(f"_d_{i}") + F.lit(m0) for i, (p, m0) in enumerate(P)}
    pidx = {p: i for i, (p, _) in enumerate(P)}

    def enabled_cond(t):
        c = F.lit(True)
        for p in inputs[t]:
            c = c & (mark[p] >= 1)
        return c
    ok = F.lit(False)
    for t in T:
        ok = ok | ((act == t) & enabled_cond(t))
    enabled = F.array_compact(F.array(*[F.when(enabled_cond(t), F.lit(t)) for t in T]))
    r1 = r1.select(log.case, log.activity, *log.order_cols, "_pos", enabled.alias("_en"),
                   ok.cast("int").alias("_ok"))
    h1 = F.xxhash64(F.col("_pos"), act).cast("decimal(38,0)")
    h2 = F.xxhash64(F.lit("etc"), act, F.col("_pos")).cast("decimal(38,0)")
    r2 = running(base, r1, [log.case], {"_h1": ("sum", h1), "_h2": ("sum", h2), "_fit": ("min", F.col("_ok"))},
                 inclusive=False)
    fitting = r2.where(F.col("_fit").isNull() | (F.col("_fit") == 1))
    g = fitting.groupBy("_pos", "_h1", "_h2").agg(
        F.count(F.lit(1)).alias("w"), F.collect_set(log.activity).alias("obs"), F.first("_en").alias("en"))
    esc = F.size(F.array_except("en", "obs"))
    return g.agg(r6(1 - F.try_divide(F.sum(F.col("w") * esc), F.sum(F.col("w") * F.size("en")))).alias("precision"))


def generalization(log: EventLog, arcs: DataFrame) -> DataFrame:
    """K3 (S15): 1 - mean over transitions of 1 / sqrt(times fired); never fired counts 1."""
    t = arcs.select("activity").distinct()
    fired = log.df.groupBy(F.col(log.activity).alias("activity")).agg(F.count(F.lit(1)).alias("n"))
    j = t.join(fired, "activity", "left")
    term = F.when(F.coalesce("n", F.lit(0)) == 0, F.lit(1.0)).otherwise(1 / F.sqrt("n"))
    return j.agg(r6(1 - F.avg(term)).alias("generalization"))


def simplicity(places: DataFrame, arcs: DataFrame) -> DataFrame:
    """K4 (S16): 1 / (1 + max(0, mean arc degree of places and transitions - 2))."""
    n_nodes = places.select("place").distinct().count() + arcs.select("activity").distinct().count()
    d = arcs.agg(F.coalesce(F.try_divide(2.0 * F.count(F.lit(1)), F.lit(n_nodes).cast("double")), F.lit(0.0)).alias("d"))
    return d.select(r6(1 / (1 + F.greatest(F.lit(0.0), F.col("d") - 2))).alias("simplicity"))


def edge_precision(log: EventLog, edges: DataFrame) -> DataFrame:
    """K5: share of allowed successors seen after each activity, weighted by its steps."""
    from .discovery import dfg_frequency
    dfg = dfg_frequency(log)
    allowed = edges.select("a", "b").distinct()
    seen = allowed.join(dfg, ["a", "b"], "left").groupBy("a").agg(
        F.count(F.lit(1)).alias("n_allowed"), F.count("n").alias("n_seen"))
    w = dfg.groupBy("a").agg(F.sum("n").alias("w"))
    j = seen.join(w, "a")
    return j.agg(r6(F.sum(F.col("w") * F.col("n_seen") / F.col("n_allowed")) / F.sum("w")).alias("edge_precision"))


def _compat(c: Column) -> Column:
    return F.when(c < 1, c).otherwise(c / 100)


def model_score(fitness: DataFrame, precision: DataFrame, gen: DataFrame, simp: DataFrame,
                model: str = "model", focus: str = "all") -> DataFrame:
    """K6: score = fitness quarter-sum + precision + generalization + simplicity.

    The fitness quarter-sum uses perc_fit_traces twice (the reference's
    fitness record carries it under two names). ``score`` uses proper
    ratios; ``score_compat`` divides any value >= 1 by 100, as the
    reference does, so a perfect ratio 1.0 counts 0.01 there. ``focus``
    keeps one metric in the score ('fitness', 'precision', ...).
    """
    row = fitness.select(F.lit(model).alias("model"), "*",
                         precision.select(F.first("precision")).scalar().alias("precision"),
                         gen.select(F.first("generalization")).scalar().alias("generalization"),
                         simp.select(F.first("simplicity")).scalar().alias("simplicity"))
    return _scored(row, focus)


def _scored(row: DataFrame, focus: str = "all") -> DataFrame:
    pf, avg, lf = F.col("perc_fit_traces"), F.col("average_trace_fitness"), F.col("log_fitness")
    fit = (pf / 100 + avg + lf + pf / 100) / 4
    fit_c = (_compat(pf) + _compat(avg) + _compat(lf) + _compat(pf)) / 4
    parts = {"fitness": (fit, fit_c), "precision": (F.col("precision"),) * 2,
             "generalization": (F.col("generalization"),) * 2, "simplicity": (F.col("simplicity"),) * 2}
    keep = [k for k in parts if focus == "all" or k == focus]
    score = sum((parts[k][0] for k in keep), F.lit(0.0))
    score_c = sum((parts[k][1] for k in keep), F.lit(0.0))
    return row.select("*", r6(score).alias("score"), r6(score_c).alias("score_compat"))


def rate_net(log: EventLog, places: DataFrame, arcs: DataFrame, name: str) -> DataFrame:
    """K1-K4 and K6 for one net."""
    return model_score(replay_fitness(log, places, arcs), etc_precision(log, places, arcs),
                       generalization(log, arcs), simplicity(places, arcs), model=name)


def rating_table(log: EventLog, nets: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Every candidate net scored; rank 1 = best score (ties: name; nets without a score last).

    All nets are rated in one reading of the log (``operators.rating``).
    """
    from pyspark.sql import Window
    from .rating import rate_nets
    rows = _scored(rate_nets(log, nets).select(
        "model", "perc_fit_traces", "average_trace_fitness", "log_fitness", "precision", "generalization", "simplicity"))
    w = Window.orderBy(F.col("score").desc(), F.col("model").asc())   # one row per model
    return rows.withColumn("rank", F.row_number().over(w).cast("long"))
