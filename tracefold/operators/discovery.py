"""Process discovery from logs: relations and graphs (inventory group I).

The event-level work is one chunked case-ordered pass (``sequenced``) and
a partially aggregated ``groupBy(a, b)``; everything after that runs on
edge tables whose size is bounded by the square of the activity alphabet,
never by the log. Model tables produced here (``edges``) feed conformance.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import exact_mean_std, mean_std_of_sums, r6, us_between
from ..log import END_SYMBOL, START_SYMBOL, EventLog
from ..plans.cases import escaped, kept_once
from ..plans.sequence import running, sequenced


def _steps(log: EventLog, extra: Sequence[str] = ()) -> DataFrame:
    s = sequenced(log, carry=("activity", "ts", *extra))
    return s.where(F.col("next_activity").isNotNull())


def dfg_frequency(log: EventLog) -> DataFrame:
    """Directly-follows counts (a, b, n)."""
    return _steps(log).groupBy(F.col("activity").alias("a"), F.col("next_activity").alias("b")) \
        .agg(F.count(F.lit(1)).alias("n"))


def _step_times(log: EventLog) -> DataFrame:
    return _steps(log).select(F.col("activity").alias("a"), F.col("next_activity").alias("b"),
                              us_between(F.col("ts"), F.col("next_ts")).alias("d"))


def dfg_performance(log: EventLog) -> DataFrame:
    """Directly-follows time statistics in seconds: mean, min, max, median, sample std.

    One histogram of the steps holds the exact sums of all statistics but
    the median, which is selected from it and one more pass.
    """
    from .timing import binned, group_median
    s, key = _step_times(log), ["a", "b"]
    x = F.col("d").cast("decimal(38,0)")
    hist = kept_once(binned(s, key, "d", F.sum(x).alias("_s1"), F.sum(x * x).alias("_s2")))
    mean, std = mean_std_of_sums(F.col("n"), F.col("_s1"), F.col("_s2"))
    stats = hist.groupBy(*key).agg(F.sum("_c").alias("n"), F.sum("_s1").alias("_s1"), F.sum("_s2").alias("_s2"),
                                   F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")).select(
        *key, "n", mean.alias("mean_s"), (F.col("_lo") / 1e6).alias("min_s"), (F.col("_hi") / 1e6).alias("max_s"),
        std.alias("std_s"))
    middle = group_median(s, key, "d", hist.select(*key, "_bin", "_c", "_lo", "_hi"))
    return stats.join(middle, key).select(*stats.columns, (F.col("median") / 1e6).alias("median_s"))


def edge_times(log: EventLog) -> DataFrame:
    """Count and mean time (seconds) of every step, in one pass."""
    mean, _ = exact_mean_std(F.col("d"))
    return _step_times(log).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), mean.alias("mean_s"))


def dfg_triples(log: EventLog) -> DataFrame:
    """(a, b, c) -> count of three directly-following events."""
    s = sequenced(log, carry=("activity",))
    s2 = sequenced(log.with_df(s.select(*log.df.columns, "next_activity")), carry=("next_activity",))
    t = s2.where(F.col("next_next_activity").isNotNull())
    return t.groupBy(F.col("activity").alias("a"), F.col("next_activity").alias("b"),
                     F.col("next_next_activity").alias("c")).agg(F.count(F.lit(1)).alias("n"))


def dfg_case_attribute(log: EventLog, attr: str) -> DataFrame:
    """I4: directly-follows counts split by a case attribute."""
    return _steps(log, (attr,)).groupBy(F.col(attr), F.col("activity").alias("a"),
                                        F.col("next_activity").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def dfg_with_ends(log: EventLog) -> DataFrame:
    """I1 plus start (▶ -> first) and end (last -> ■) edges."""
    s = sequenced(log, carry=("activity",))
    a = F.coalesce(F.col("prev_activity"), F.lit(START_SYMBOL))
    inner = s.select(a.alias("a"), F.col("activity").alias("b"))
    ends = s.where(F.col("next_activity").isNull()).select(F.col("activity").alias("a"),
                                                           F.lit(END_SYMBOL).alias("b"))
    return inner.unionByName(ends).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def dfg_clean_noise(dfg: DataFrame, noise: float = 0.05) -> DataFrame:
    """I7 (S11): drop (a, b) when n < noise * min(largest edge at a, largest edge at b).

    "Largest edge at x" is the largest count among edges that start or end
    at x. The edge table is small (alphabet squared).
    """
    node = dfg.select(F.col("a").alias("x"), "n").unionByName(dfg.select(F.col("b").alias("x"), "n")) \
        .groupBy("x").agg(F.max("n").alias("mx"))
    j = (dfg.join(node.withColumnRenamed("x", "a").withColumnRenamed("mx", "ma"), "a")
         .join(node.withColumnRenamed("x", "b").withColumnRenamed("mx", "mb"), "b"))
    return j.where(F.col("n") >= F.lit(noise) * F.least("ma", "mb")).select("a", "b", "n")


def _alphabet_pairs(log: EventLog) -> DataFrame:
    """All ordered activity pairs, built from the (bounded) alphabet in one row."""
    acts = log.df.agg(F.array_sort(F.collect_set(log.activity)).alias("acts"))
    return acts.select(F.explode("acts").alias("a"), "acts").select("a", F.explode("acts").alias("b"))


def footprint(log: EventLog, dfg: DataFrame | None = None) -> DataFrame:
    """I8 (S12): relation of every activity pair: '->', '<-', '||' or '#'."""
    d = dfg if dfg is not None else dfg_frequency(log)
    fw = d.select("a", "b", F.col("n").alias("n_ab"))
    bw = d.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("n_ba"))
    p = _alphabet_pairs(log).join(fw, ["a", "b"], "left").join(bw, ["a", "b"], "left")
    ab, ba = F.coalesce("n_ab", F.lit(0)) > 0, F.coalesce("n_ba", F.lit(0)) > 0
    rel = (F.when(ab & ba, "||").when(ab, "->").when(ba, "<-").otherwise("#"))
    return p.select("a", "b", rel.alias("relation"))


def alpha_plus_relations(log: EventLog) -> DataFrame:
    """Footprint with length-1 and length-2 loops separated (alpha+).

    ``loop1`` marks a -> a. a and b are in a length-2 loop when a b a or
    b a b occurs; such pairs are causal both ways instead of parallel.
    """
    d = dfg_frequency(log)
    fp = footprint(log, d)
    t = dfg_triples(log).where((F.col("a") == F.col("c")) & (F.col("a") != F.col("b")))
    l2 = t.select("a", "b").unionByName(t.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct() \
        .withColumn("loop2", F.lit(True))
    l1 = d.where(F.col("a") == F.col("b")).select("a", F.lit(True).alias("loop1"))
    j = fp.join(l2, ["a", "b"], "left").join(l1, "a", "left")
    rel = F.when((F.col("relation") == "||") & F.col("loop2").isNotNull(), F.lit("<->")) \
        .otherwise(F.col("relation"))
    return j.select("a", "b", rel.alias("relation"),
                    F.coalesce("loop1", F.lit(False)).alias("a_loop1"),
                    F.coalesce("loop2", F.lit(False)).alias("loop2"))


# ------------------------------------------------------------------ heuristics

def dependency_graph(log: EventLog, dependency: float = 0.5, min_act: int = 1, min_edge: int = 1,
                     loop2: float = 0.5) -> DataFrame:
    """I11 (S10): dependency of every edge and the edges kept by the thresholds.

    Kept: n_ab >= min_edge, both activities occur >= min_act times, and
    dependency >= ``dependency``; or a length-2 loop (a b a / b a b) whose
    dependency >= ``loop2`` (flag ``loop2``).
    """
    d = dfg_frequency(log)
    counts = log.df.groupBy(F.col(log.activity).alias("x")).agg(F.count(F.lit(1)).alias("cnt"))
    rev = d.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("n_ba"))
    t = dfg_triples(log).where((F.col("a") == F.col("c")) & (F.col("a") != F.col("b")))
    l2 = t.select("a", "b", F.col("n").alias("n_aba"))
    l2r = t.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("n_bab"))
    j = (d.join(rev, ["a", "b"], "left").join(l2, ["a", "b"], "left").join(l2r, ["a", "b"], "left")
         .join(counts.withColumnRenamed("x", "a").withColumnRenamed("cnt", "cnt_a"), "a")
         .join(counts.withColumnRenamed("x", "b").withColumnRenamed("cnt", "cnt_b"), "b"))
    nab, nba = F.col("n"), F.coalesce("n_ba", F.lit(0))
    dep = F.when(F.col("a") == F.col("b"), nab / (nab + 1)).otherwise((nab - nba) / (nab + nba + 1))
    l2n = F.coalesce("n_aba", F.lit(0)) + F.coalesce("n_bab", F.lit(0))
    dep2 = l2n / (l2n + 1)
    base_ok = (nab >= min_edge) & (F.col("cnt_a") >= min_act) & (F.col("cnt_b") >= min_act)
    is_l2 = (l2n > 0) & (dep2 >= loop2)
    keep = base_ok & ((dep >= dependency) | is_l2)
    return j.where(keep).select("a", "b", nab.alias("n"), r6(dep).alias("dependency"),
                                r6(dep2).alias("loop2_dependency"), is_l2.alias("loop2"))


def and_splits(edges: DataFrame, dfg: DataFrame, and_threshold: float = 0.65) -> DataFrame:
    """AND / XOR label for each pair of successors (b < c) of a in the model edges."""
    out = edges.select("a", "b", F.col("n").alias("n_ab"))
    pairs = out.join(out.select("a", F.col("b").alias("c"), F.col("n_ab").alias("n_ac")), "a") \
        .where(F.col("b") < F.col("c"))
    bc = dfg.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("n_bc"))
    cb = dfg.select(F.col("a").alias("c"), F.col("b").alias("b"), F.col("n").alias("n_cb"))
    j = pairs.join(bc, ["b", "c"], "left").join(cb, ["b", "c"], "left")
    m = (F.coalesce("n_bc", F.lit(0)) + F.coalesce("n_cb", F.lit(0))) / (F.col("n_ab") + F.col("n_ac") + 1)
    return j.select("a", "b", "c", r6(m).alias("and_measure"),
                    F.when(m >= and_threshold, "AND").otherwise("XOR").alias("kind"))


# The four heuristics settings the reference sweeps
# (dependency threshold, minimum activity count, minimum edge count).
SWEEP_SETTINGS = [(0.6, 3, 3), (0.9, 30, 30), (0.9, 300, 300), (0.99, 3000, 3000)]


def parameter_sweep(log: EventLog, settings: Sequence[tuple[float, int, int]] = SWEEP_SETTINGS) -> DataFrame:
    """Model size and score for every (dependency, min act, min edge) setting.

    The edge table is computed once; each edge row meets every setting of
    the grid and counts where it is kept, so a setting that keeps nothing
    has a row of zeros. ``fitness``: share of the log's steps on kept edges;
    ``simplicity``: K4 of the edge graph; ``score``: their sum.
    """
    d = dependency_graph(log, dependency=-1.0, min_act=0, min_edge=0, loop2=2.0)
    counts = log.df.groupBy(F.col(log.activity).alias("x")).agg(F.count(F.lit(1)).alias("cnt"))
    e = (d.join(counts.withColumnRenamed("x", "a").withColumnRenamed("cnt", "cnt_a"), "a")
         .join(counts.withColumnRenamed("x", "b").withColumnRenamed("cnt", "cnt_b"), "b"))
    grid = F.array(*[F.struct(F.lit(float(t)).alias("dep_t"), F.lit(int(a)).alias("act_t"),
                              F.lit(int(m)).alias("edge_t")) for t, a, m in settings])
    x = e.select("*", F.explode(grid).alias("g")).select("*", "g.*")
    kept = ((F.col("dependency") >= F.col("dep_t")) & (F.col("n") >= F.col("edge_t"))
            & (F.col("cnt_a") >= F.col("act_t")) & (F.col("cnt_b") >= F.col("act_t")))
    key = ["dep_t", "act_t", "edge_t"]
    ends = x.select(*key, kept.alias("kept"), F.explode(F.array("a", "b")).alias("act"))
    acts = ends.groupBy(*key).agg(F.count_distinct(F.when(F.col("kept"), F.col("act"))).alias("n_activities"))
    size = x.groupBy(*key).agg(F.count_if(kept).alias("n_edges"), F.sum("n").alias("_steps"),
                               F.sum(F.when(kept, F.col("n")).otherwise(0)).cast("long").alias("covered_steps"))
    fit = F.coalesce(F.try_divide(F.col("covered_steps").cast("double"), F.col("_steps").cast("double")), F.lit(0.0))
    simple = edge_simplicity(F.col("n_edges"), F.col("n_activities"))
    table = log.spark.createDataFrame([(float(t), int(a), int(m)) for t, a, m in settings], size.select(*key).schema)
    out = table.join(size, key, "left").join(acts, key, "left").fillna(0, ["n_edges", "n_activities", "covered_steps"])
    return out.select(*key, "n_edges", "n_activities", "covered_steps", r6(fit).alias("fitness"),
                                       r6(simple).alias("simplicity"), r6(fit + simple).alias("score"))


def edge_simplicity(n_edges: Column, n_activities: Column) -> Column:
    """K4 (S16) for an edge graph: 1 / (1 + max(0, mean degree - 2)); 1 without nodes."""
    degree = F.coalesce(F.try_divide(2.0 * n_edges, n_activities.cast("double")), F.lit(0.0))
    return 1 / (1 + F.greatest(F.lit(0.0), degree - 2))


def sweep_bounds(log: EventLog) -> DataFrame:
    """I16: smallest / largest variant count and the count at rank floor(0.1 * n_variants)."""
    from .stats import frequency_ranks
    at = F.floor(F.col("n_variants") * F.lit(0.1))
    here = (F.col("first") <= at) & (at <= F.col("last"))
    return frequency_ranks(log).agg(F.min("n_cases").alias("min_count"), F.max("n_cases").alias("max_count"),
                                    F.max(F.when(here, F.col("n_cases"))).alias("count_at_10pct"))


def model_decoration(log: EventLog, edges: DataFrame) -> DataFrame:
    """Frequency and mean time of each model edge, and frequency of its activities."""
    perf = edge_times(log).withColumnRenamed("n", "freq")
    counts = log.df.groupBy(F.col(log.activity).alias("a")).agg(F.count(F.lit(1)).alias("act_freq"))
    return (edges.select("a", "b").join(perf, ["a", "b"], "left").join(counts, "a", "left")
            .select("a", "b", F.coalesce("freq", F.lit(0)).alias("freq"), "mean_s", "act_freq"))


# ------------------------------------------------------------------ iterative model construction
# These run on alphabet-sized tables (footprint, DFG). Each round is a small
# Spark job; its result is checkpointed (reliable, in the session's
# checkpoint folder) so the lineage of the driver loop stays short.

_SEP = "\x1f"


def _checkpoint(df: DataFrame) -> DataFrame:
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _choices(fp: DataFrame) -> DataFrame:
    """Per activity that is no loop of its own: ``loose`` (never beside it), ``after`` and ``before`` (caused, causing).

    One row per activity with sorted arrays, from the footprint's rows.
    """
    fits = fp.where((F.col("a") == F.col("b")) & (F.col("relation") == "#")).select("a")
    pairs = fp.join(fits, "a", "left_semi").join(fits.withColumnRenamed("a", "b"), "b", "left_semi")
    every = lambda cond, other: F.array_sort(F.collect_set(F.when(cond, F.col(other))))
    ahead = pairs.groupBy(F.col("a").alias("x")).agg(
        every((F.col("relation") == "#") & (F.col("a") != F.col("b")), "b").alias("loose"),
        every(F.col("relation") == "->", "b").alias("after"))
    back = pairs.groupBy(F.col("b").alias("x")).agg(every(F.col("relation") == "->", "a").alias("before"))
    return _checkpoint(ahead.join(back, "x"))


def alpha_place_sets(log: EventLog) -> DataFrame:
    """Places of the alpha algorithm: maximal (A, B) with A -> B causal, A and B choice-free.

    Valid pairs are closed under taking subsets, so they grow level by
    level from single causal pairs, distinct per level. Every pair carries
    what can still be added to either side; that shrinks by an intersection
    with the arrays of the added activity, met by a join. Activities that
    exclude no other candidate are added all at once, so a choice between
    hundreds takes one level; only true alternatives branch. A pair is
    maximal when nothing is left to add. Plus the start
    place (-> first activities) and end place. Rows: ``inputs``,
    ``outputs`` (arrays), ``kind``, ``place``.
    """
    from ..plans.cases import case_table
    fp = _checkpoint(footprint(log))
    known = _choices(fp)
    both = lambda p, q: F.array_sort(F.array_intersect(p, q))
    side = lambda df, n: df.select(*[F.col(c).alias(f"{n}_{c}") for c in known.columns])
    seeds = (fp.where(F.col("relation") == "->").join(side(known, "a"), F.col("a") == F.col("a_x"))
             .join(side(known, "b"), F.col("b") == F.col("b_x")))
    level = _checkpoint(seeds.select(F.array("a").alias("A"), F.array("b").alias("B"),
                                     both("a_loose", "b_before").alias("more_a"), both("b_loose", "a_after").alias("more_b")))
    maximal = level.where("false")
    while not level.isEmpty():      # a pair only grows, so some level is empty
        none_left = (F.size("more_a") == 0) & (F.size("more_b") == 0)
        maximal = maximal.unionByName(level.where(none_left))
        each = level.select("*", F.explode(F.concat(
            F.transform("more_a", lambda x: F.struct(x.alias("x"), F.lit(True).alias("to_a"))),
            F.transform("more_b", lambda x: F.struct(x.alias("x"), F.lit(False).alias("to_a"))))).alias("_e"))
        each = each.select("A", "B", "more_a", "more_b", "_e.*").join(known, "x").select(
            "*", both("more_a", F.when(F.col("to_a"), F.col("loose")).otherwise(F.col("before"))).alias("next_a"),
            both("more_b", F.when(F.col("to_a"), F.col("after")).otherwise(F.col("loose"))).alias("next_b"))
        # what excludes no other candidate belongs to every maximal pair above: all of it is added at once
        free = (F.size("next_a") + F.size("next_b")) == (F.size("more_a") + F.size("more_b") - 1)
        state = Window.partitionBy("A", "B")
        each = each.withColumn("free", free).withColumn("any_free", F.max("free").over(state))
        at_once = lambda to_a: F.array_sort(F.collect_set(F.when(F.col("to_a") == F.lit(to_a), F.col("x"))))
        jumps = each.where("free").groupBy("A", "B", "more_a", "more_b").agg(at_once(True).alias("ua"), at_once(False).alias("ub"))
        grown = lambda s, more: F.array_sort(F.array_union(s, more))
        jumped = jumps.select(grown("A", "ua").alias("A"), grown("B", "ub").alias("B"),
                              F.array_except("more_a", "ua").alias("more_a"), F.array_except("more_b", "ub").alias("more_b"))
        new = F.array("x")
        branched = each.where("not any_free").select(
            F.when(F.col("to_a"), grown("A", new)).otherwise(F.col("A")).alias("A"),
            F.when(F.col("to_a"), F.col("B")).otherwise(grown("B", new)).alias("B"),
            F.col("next_a").alias("more_a"), F.col("next_b").alias("more_b"))
        level = _checkpoint(jumped.unionByName(branched).distinct())
    maximal = maximal.select("A", "B").distinct()
    ends = case_table(log).agg(F.array_sort(F.collect_set("first_activity")).alias("_s"),
                               F.array_sort(F.collect_set("last_activity")).alias("_e"))
    none = F.array().cast("array<string>")
    return (maximal.select(F.col("A").alias("inputs"), F.col("B").alias("outputs"), F.lit("inner").alias("kind"))
            .unionByName(ends.select(none.alias("inputs"), F.col("_s").alias("outputs"), F.lit("start").alias("kind")))
            .unionByName(ends.select(F.col("_e").alias("inputs"), none.alias("outputs"), F.lit("end").alias("kind")))
            .where(F.size("inputs") + F.size("outputs") > 0)     # an empty log has no ends
            .withColumn("place", _place_name(F.col("inputs"), F.col("outputs"))))


def _names(activities: Column) -> Column:
    return F.array_join(F.transform(activities, lambda a: F.replace(escaped(a, ","), F.lit("|"), F.lit("\\|"))), ",")


def _place_name(inputs: Column, outputs: Column) -> Column:
    """``p(a,b|c)``; separators in activity names are escaped, so different places have different names."""
    return F.concat(F.lit("p("), _names(inputs), F.lit("|"), _names(outputs), F.lit(")"))


def alpha_places(log: EventLog) -> DataFrame:
    """The places of ``alpha_place_sets`` with their activities as text."""
    return alpha_place_sets(log).select("place", _names(F.col("inputs")).alias("inputs"),
                                        _names(F.col("outputs")).alias("outputs"))


def alpha_net(log: EventLog) -> tuple[DataFrame, DataFrame]:
    """The alpha algorithm's net as ``(places, arcs)`` tables, ready for replay and rating (K7)."""
    sets = _checkpoint(alpha_place_sets(log))
    places = sets.select("place", (F.col("kind") == "start").cast("int").alias("m0"),
                         (F.col("kind") == "end").cast("int").alias("mf"))
    put = sets.select(F.explode("inputs").alias("activity"), "place", F.lit(1).alias("phase"), F.lit(1).alias("delta"))
    take = sets.select(F.explode("outputs").alias("activity"), "place", F.lit(0).alias("phase"), F.lit(-1).alias("delta"))
    return places, put.unionByName(take)


def _closure(edges: DataFrame) -> DataFrame:
    """Transitive closure (a reaches b in >= 1 step) by squaring until stable."""
    r = _checkpoint(edges.select("a", "b").distinct())
    n = r.count()
    while True:
        step = r.alias("x").join(r.alias("y"), F.col("x.b") == F.col("y.a")) \
            .select(F.col("x.a").alias("a"), F.col("y.b").alias("b"))
        nxt = _checkpoint(r.unionByName(step).distinct())
        m = nxt.count()
        if m == n:
            return nxt
        r, n = nxt, m


def _components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(x, grp): connected components of an undirected graph; label = smallest member."""
    und = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    selfs = nodes.select(F.col("x").alias("a"), F.col("x").alias("b"))
    c = _closure(und.unionByName(selfs))
    return c.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("grp"))


def activity_cut(log: EventLog, noise: float = 0.0) -> DataFrame:
    """Inductive-miner cut of the activity set from the DFG (IMd style).

    Tried in order: exclusive (components of the undirected DFG),
    sequence (groups of activities that reach each other both ways or not
    at all, totally ordered by reachability), parallel (components of
    "not connected both ways", every group with a start and an end
    activity), loop (do part = what start activities reach without the
    end -> start edges; the rest is the redo part). ``noise`` > 0 first drops
    edges below noise x the largest out-edge of their source (IMf).
    Rows: (activity, cut, grp, grp_order); cut 'none' when no cut is found.
    """
    d = dfg_frequency(log)
    if noise > 0:
        mo = d.groupBy("a").agg(F.max("n").alias("_mo"))
        d = d.join(mo, "a").where(F.col("n") >= F.lit(noise) * F.col("_mo")).drop("_mo")
    d = _checkpoint(d)
    nodes = _checkpoint(log.df.select(F.col(log.activity).alias("x")).distinct())
    n_nodes = nodes.count()
    from ..plans.cases import case_table
    ct = case_table(log)
    starts = ct.select(F.col("first_activity").alias("x")).distinct()
    ends = ct.select(F.col("last_activity").alias("x")).distinct()

    def result(groups: DataFrame, cut: str, order: DataFrame | None = None) -> DataFrame:
        g = groups.withColumn("cut", F.lit(cut))
        if order is None:
            g = g.withColumn("grp_order", F.dense_rank().over(Window.orderBy("grp")) - 1)
        else:
            g = g.join(order, "grp")
        return g.select(F.col("x").alias("activity"), "cut", "grp", F.col("grp_order").cast("int"))

    xor = _components(nodes, d.where(F.col("a") != F.col("b")))
    if xor.select("grp").distinct().count() > 1:
        return result(xor, "xor")

    reach = _closure(d)
    rr = reach.select("a", "b", F.lit(True).alias("f"))
    rv = reach.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("r"))
    alph = nodes.agg(F.collect_set("x").alias("acts"))
    allp = alph.select(F.explode("acts").alias("a"), "acts").select("a", F.explode("acts").alias("b")) \
        .where(F.col("a") < F.col("b"))
    pr = allp.join(rr, ["a", "b"], "left").join(rv, ["a", "b"], "left")
    same = pr.where(F.col("f").isNull() == F.col("r").isNull())
    seq = _checkpoint(_components(nodes, same))
    if seq.select("grp").distinct().count() > 1:
        ga = seq.withColumnRenamed("x", "a").withColumnRenamed("grp", "ga")
        gb = seq.withColumnRenamed("x", "b").withColumnRenamed("grp", "gb")
        cross = pr.join(ga, "a").join(gb, "b").where(F.col("ga") != F.col("gb"))
        bad = cross.where(F.col("f").isNull() == F.col("r").isNull()).limit(1).count()
        if not bad:
            # order: groups reached by fewer groups come first
            before = cross.select(F.when(F.col("f").isNotNull(), F.col("ga")).otherwise(F.col("gb")).alias("g_from"),
                                  F.when(F.col("f").isNotNull(), F.col("gb")).otherwise(F.col("ga")).alias("grp")) \
                .distinct().groupBy("grp").agg(F.count(F.lit(1)).alias("grp_order"))
            order = seq.select("grp").distinct().join(before, "grp", "left") \
                .select("grp", F.coalesce("grp_order", F.lit(0)).alias("grp_order"))
            return result(seq, "sequence", order)

    fwd = d.select("a", "b", F.lit(True).alias("f"))
    bwd = d.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("r"))
    not_both = allp.join(fwd, ["a", "b"], "left").join(bwd, ["a", "b"], "left") \
        .where(F.col("f").isNull() | F.col("r").isNull())
    par = _checkpoint(_components(nodes, not_both))
    n_groups = par.select("grp").distinct().count()
    if n_groups > 1:
        has = par.join(starts.withColumn("s", F.lit(1)), "x", "left").join(ends.withColumn("e", F.lit(1)), "x", "left") \
            .groupBy("grp").agg(F.max("s").alias("s"), F.max("e").alias("e"))
        if has.where(F.col("s").isNull() | F.col("e").isNull()).limit(1).count() == 0:
            return result(par, "parallel")

    core = starts.unionByName(ends).distinct()
    rest = nodes.join(core, "x", "left_anti")
    if rest.limit(1).count() > 0:
        rest_edges = d.join(rest.select(F.col("x").alias("a")), "a", "left_semi") \
            .join(rest.select(F.col("x").alias("b")), "b", "left_semi").where(F.col("a") != F.col("b"))
        comp = _checkpoint(_components(rest, rest_edges))
        ca = comp.select(F.col("x").alias("a"), F.col("grp").alias("ga"))
        cb = comp.select(F.col("x").alias("b"), F.col("grp").alias("gb"))
        e = d.join(ca, "a", "left").join(cb, "b", "left")
        into = e.where(F.col("gb").isNotNull() & (F.col("ga").isNull() | (F.col("ga") != F.col("gb")))) \
            .join(ends.withColumnRenamed("x", "a").withColumn("_end", F.lit(True)), "a", "left") \
            .where(F.col("_end").isNull()).select(F.col("gb").alias("grp"))
        out_ = e.where(F.col("ga").isNotNull() & (F.col("gb").isNull() | (F.col("ga") != F.col("gb")))) \
            .join(starts.withColumnRenamed("x", "b").withColumn("_st", F.lit(True)), "b", "left") \
            .where(F.col("_st").isNull()).select(F.col("ga").alias("grp"))
        bad = into.unionByName(out_).distinct()
        redo = comp.join(bad, "grp", "left_anti")
        if redo.limit(1).count() > 0:
            loop = nodes.join(redo.select("x", F.lit("redo").alias("grp")), "x", "left") \
                .select("x", F.coalesce("grp", F.lit("do")).alias("grp"))
            order = loop.select("grp").distinct().select(
                "grp", F.when(F.col("grp") == "do", 0).otherwise(1).alias("grp_order"))
            return result(loop, "loop", order)
    if n_nodes == 1:
        return result(nodes.withColumn("grp", F.col("x")), "activity")
    return result(nodes.withColumn("grp", F.lit("all")), "none")


def log_split_by_cut(log: EventLog, cut: DataFrame) -> DataFrame:
    """Project the log on a cut (one level of the inductive recursion).

    xor: every case goes to the group holding most of its events (ties:
    smallest group name); sequence / parallel: each event goes to its
    activity's group, the sub-case is (case, group); loop: the case is cut
    into pieces at every switch between do and redo part. Rows: events with
    ``grp`` and ``sub_case``.
    """
    c = cut.select(F.col("activity").alias(log.activity), "cut", "grp")
    ev = log.df.join(c, log.activity)
    kind = cut.select(F.first("cut")).collect()[0][0]
    if kind == "xor":
        per = ev.groupBy(log.case, "grp").agg(F.count(F.lit(1)).alias("_n"))
        best = per.groupBy(log.case).agg(F.min_by("grp", F.struct(-F.col("_n"), F.col("grp"))).alias("_g"))
        out = ev.join(best, log.case).where(F.col("grp") == F.col("_g")).drop("_g")
        return out.withColumn("sub_case", F.concat_ws("#", log.case, "grp"))
    if kind == "loop":
        s = sequenced(log.with_df(ev), carry=("grp",))
        chg = (F.col("prev_grp").isNull() | (F.col("prev_grp") != F.col("grp"))).cast("long")
        r = running(log.with_df(s.select(*ev.columns, chg.alias("_chg"))), None, [log.case],
                    {"_piece": ("sum", F.col("_chg"))})
        return r.withColumn("sub_case", F.concat_ws("#", log.case, F.col("_piece").cast("string"))).drop("_chg", "_piece")
    return ev.withColumn("sub_case", F.concat_ws("#", log.case, "grp"))


def inductive_tree(log: EventLog, noise: float = 0.0) -> DataFrame:
    """I13 + I14 repeated: process tree rows (node, parent, depth, op, activity).

    Each node's sub-log is cut (``activity_cut``) and projected
    (``log_split_by_cut``); the children are the groups of the cut in order.
    A group that some case of its parent does without becomes
    xor(tau, group); a single activity that a sub-case repeats becomes
    loop(activity, tau). A sub-log without a cut becomes a flower (any
    sequence of its activities, which are its leaves). With ``noise`` 0
    every trace of the log is in the tree's language. Each cut splits its
    activities, so the loop ends; it runs over tree nodes, every node's work
    is a Spark job over its sub-log, whose split is checkpointed. Only cut
    tables and one count per group come to the driver.
    """
    cols = log.df.columns
    rows: list[tuple] = []

    def optional(node, parent, depth, skipped: bool) -> tuple:
        if not skipped:
            return node, parent, depth
        rows.append((node, parent, depth, "xor", None))
        rows.append((f"{node}.0", node, depth + 1, "tau", None))
        return f"{node}.1", node, depth + 1

    def leaf(node, parent, depth, activity: str, repeats: bool) -> None:
        if repeats:
            rows.append((node, parent, depth, "loop", None))
            rows.append((f"{node}.0", node, depth + 1, "activity", activity))
            rows.append((f"{node}.1", node, depth + 1, "tau", None))
        else:
            rows.append((node, parent, depth, "activity", activity))

    queue = [("0", None, 0, log)]
    while queue:
        node, parent, depth, sub = queue.pop(0)
        cut_df = _checkpoint(activity_cut(sub, noise))
        cut = cut_df.collect()
        if not cut:
            rows.append((node, parent, depth, "tau", None))
            continue
        kind = cut[0]["cut"]
        if kind == "activity":      # the whole log has one activity
            most = sub.df.groupBy(sub.case).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
            leaf(node, parent, depth, cut[0]["activity"], most > 1)
            continue
        if kind == "none":
            rows.append((node, parent, depth, "flower", None))
            for i, a in enumerate(sorted(r["activity"] for r in cut)):
                rows.append((f"{node}.{i}", node, depth + 1, "activity", a))
            continue
        rows.append((node, parent, depth, kind, None))
        groups = sorted({(r["grp_order"], r["grp"]) for r in cut})
        members = {g: sorted(r["activity"] for r in cut if r["grp"] == g) for _, g in groups}
        split = _checkpoint(log_split_by_cut(sub, cut_df))
        per = split.groupBy("grp", "sub_case").agg(F.count(F.lit(1)).alias("n"))
        stats = {r["grp"]: r for r in per.groupBy("grp").agg(F.count(F.lit(1)).alias("cases"),
                                                             F.max("n").alias("most")).collect()}
        n_cases = (sub.df.select(F.count_distinct(sub.case)).first()[0]
                   if kind in ("sequence", "parallel") else None)
        for i, (_, g) in enumerate(groups):
            skipped = n_cases is not None and stats[g]["cases"] < n_cases
            at = optional(f"{node}.{i}", node, depth + 1, skipped)
            if len(members[g]) == 1:
                leaf(*at, members[g][0], stats[g]["most"] > 1)
                continue
            child = split.where(F.col("grp") == g).select(
                *[F.col("sub_case").alias(c) if c == log.case else F.col(c) for c in cols])
            queue.append((*at, sub.with_cases(child)))
    return log.spark.createDataFrame(rows, "node string, parent string, depth int, op string, activity string")
