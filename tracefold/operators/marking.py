"""Marking graph of a bounded net, and alignments of traces against the net itself (J6, J7 on a net).

A net is ``places(place, m0, mf)`` and ``arcs(activity, place, phase,
delta)`` as in ``conformance``; a column ``transition`` may name the
transitions, so that several can carry one label, and a transition whose
activity is null or empty is silent.

The graph grows by frontiers: the tokens of new markings are joined with the
input arcs by place, a transition with all its inputs covered fires, and
markings not met before are the next frontier. The graph is as large as the
model, not the log, and is refused beyond ``most_markings``; up to that it
stays one partition, so a round shuffles nothing.

An alignment is a cheapest path through the product of trace and graph: log
moves and visible model moves cost 1, synchronous and silent moves nothing.
Work is per distinct variant, in Arrow batches: one row of costs per event,
shared by variants of one batch that begin alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import r6
from ..log import EventLog
from ..plans.cases import kept_once
from .alignment import STEP, _batches, _text, variant_arrays

MOST_TOKENS = 64            # in one place; a net that goes beyond counts as unbounded
MOST_MARKINGS = 20_000     # of a graph that alignments send to the tasks
SHARED = 256                # events from the start of a trace whose cost rows are kept for the next one

# Costs are pairs (moves that cost, log moves among them) in one whole number, compared in this order.
MODEL = 1 << 31
LOG = MODEL + 1
FAR = 1 << 62


def _transitions(arcs: DataFrame) -> DataFrame:
    """Per transition: label (null if silent), input places with tokens, change of tokens per place."""
    named = arcs if "transition" in arcs.columns else arcs.withColumn("transition", F.col("activity"))
    per = named.groupBy("transition", "place").agg(
        F.max(F.when(F.col("activity") != "", F.col("activity"))).alias("activity"),
        F.sum(F.when(F.col("delta") < 0, -F.col("delta")).otherwise(0)).cast("int").alias("need"),
        F.sum("delta").cast("int").alias("tokens"))
    out = per.groupBy("transition").agg(
        F.max("activity").alias("activity"),
        F.collect_list(F.when(F.col("need") > 0, F.struct("place", "need"))).alias("inputs"),
        F.collect_list(F.struct("place", "tokens")).alias("change"))
    return kept_once(out.coalesce(1))


def _fired(marking, change):
    """The marking (sorted tokens per place, no empty place) after a change."""
    both = F.concat(marking, change)
    names = F.array_distinct(F.transform(both, lambda x: x["place"]))
    tokens = lambda p: F.aggregate(F.filter(both, lambda x: x["place"] == p), F.lit(0),
                                   lambda a, x: a + x["tokens"])
    left = F.transform(names, lambda p: F.struct(p.alias("place"), tokens(p).alias("tokens")))
    return F.array_sort(F.filter(left, lambda x: x["tokens"] > 0))


def marking_graph(places: DataFrame, arcs: DataFrame, most_tokens: int = MOST_TOKENS,
                  most_markings: int = MOST_MARKINGS) -> tuple[DataFrame, DataFrame]:
    """Reachable markings ``(marking, is_start, is_final)`` and steps ``(src, transition, activity, dst)``.

    A marking is the sorted array of its (place, tokens). Without a final
    marking in the net every marking is final. Raises for a net with more
    than ``most_tokens`` in a place or ``most_markings`` markings; an
    unbounded net always gets there. A transition without input places
    makes a net unbounded and is refused at once; arcs without a transition
    are refused, too.
    """
    moves = _transitions(arcs)
    if moves.where((F.size("inputs") == 0) | F.col("transition").isNull()).limit(1).count():
        raise ValueError("a transition needs a name and input places")
    inputs = moves.select("transition", F.inline("inputs"))
    spark = places.sparkSession
    kind = "array<struct<place:string,tokens:int>>"

    rows = places.collect()     # model-sized

    def marking_of(column: str):
        return sorted((r["place"], int(r[column])) for r in rows if r[column])

    start, final = marking_of("m0"), marking_of("mf")
    def fired(markings: DataFrame) -> DataFrame:
        ready = (markings.select("marking", F.inline("marking")).join(inputs, "place").where("tokens >= need")
                 .groupBy("marking", "transition").agg(F.count(F.lit(1)).alias("_n")))
        return ready.join(moves, "transition").where(F.col("_n") == F.size("inputs")).select(
            F.col("marking").alias("src"), "transition", "activity", _fired(F.col("marking"), F.col("change")).alias("dst"))

    frontier = spark.createDataFrame([(start,)], f"marking {kind}").coalesce(1)
    reached, n, rounds = frontier, 1, 0
    too_many = F.count_if(F.exists("marking", lambda x: x["tokens"] > most_tokens))
    while True:
        frontier = kept_once(fired(frontier).select(F.col("dst").alias("marking")).distinct()
                             .join(reached, "marking", "left_anti"))
        size, beyond = frontier.agg(F.count(F.lit(1)), too_many).first()
        if beyond:
            raise ValueError(f"the net is not bounded by {most_tokens} tokens in a place")
        if not size:
            break
        n, rounds = n + size, rounds + 1
        if n > most_markings:
            raise ValueError(f"the net has more than {most_markings} markings")
        reached = reached.unionByName(frontier).coalesce(1)
        if rounds % 16 == 0:        # plans stay short on deep nets
            reached = kept_once(reached)
    reached = kept_once(reached)
    text = F.transform("marking", lambda x: F.concat(x["place"], F.lit("\0"), x["tokens"].cast("string")))
    same = lambda m: text == F.array(*[F.lit(f"{p}\0{t}") for p, t in m]).cast("array<string>")
    return (reached.select("marking", same(start).alias("is_start"),
                           (same(final) if final else F.lit(True)).alias("is_final")), fired(reached))


class Graph:
    """A marking graph as arrays: what a task needs to align traces."""

    def __init__(self, states, steps):
        import numpy as np

        states = sorted(states, key=lambda r: r["marking"])
        number = {tuple(map(tuple, r["marking"])): k for k, r in enumerate(states)}
        at = lambda m: number[tuple(map(tuple, m))]
        self.n = len(states)
        self.start = next(k for k, r in enumerate(states) if r["is_start"])
        self.final = np.array([k for k, r in enumerate(states) if r["is_final"]], np.int64)
        self.steps = sorted((at(r["dst"]), at(r["src"]), r["transition"], r["activity"]) for r in
                            (dict(s.asDict(), activity=s["activity"] or "") for s in steps))
        self.into: dict[int, list] = {}
        for dst, src, name, label in self.steps:
            self.into.setdefault(dst, []).append((name, src, label))
        self.free = self._edges([(d, s, 0 if label == "" else MODEL) for d, s, _, label in self.steps])
        by_label: dict[str, list] = {}
        for d, s, _, label in self.steps:
            if label:
                by_label.setdefault(label, []).append((d, s, 0))
        self.sync = {label: self._edges(e) for label, e in by_label.items()}
        first = np.full(self.n, FAR, np.int64)
        first[self.start] = 0
        self.first = self.closed(first)
        if not len(self.final) or self.first[self.final].min() >= FAR:
            raise ValueError("no final marking can be reached")

    @staticmethod
    def _edges(edges):
        """Sources and costs sorted by target, where each target begins, the targets."""
        import numpy as np

        dst, src, cost = (np.array(c, np.int64) for c in zip(*edges)) if edges else (np.zeros(0, np.int64),) * 3
        heads, begin = np.unique(dst, return_index=True)
        return src, cost, begin, heads

    @staticmethod
    def stepped(row, out, edges) -> None:
        """``out`` lowered to what the edges reach from ``row``."""
        import numpy as np

        src, cost, begin, heads = edges
        if len(src):
            out[heads] = np.minimum(out[heads], np.minimum.reduceat(row[src] + cost, begin))

    def closed(self, row):
        """Costs when any number of model moves may follow."""
        while True:
            out = row.copy()
            self.stepped(row, out, self.free)
            if (out == row).all():
                return out
            row = out

    def after(self, row, activity: str | None):
        """Costs after one more event of the trace."""
        import numpy as np

        out = np.minimum(row + LOG, FAR)
        if activity in self.sync:
            self.stepped(row, out, self.sync[activity])
        return self.closed(out)

    def costs(self, traces):
        """``(cost, log moves)`` of each trace; traces that follow each other share rows of a common beginning."""
        order = sorted(range(len(traces)), key=lambda k: [a or "" for a in traces[k]])
        out, rows, last = [None] * len(traces), [self.first], []
        for k in order:
            trace, shared = traces[k], 0
            while shared < min(len(last), len(trace), len(rows) - 1) and last[shared] == trace[shared]:
                shared += 1
            del rows[shared + 1:]
            row = rows[-1]
            for i, a in enumerate(trace[shared:], shared):
                row = self.after(row, a)
                if i < SHARED:
                    rows.append(row)
            last, best = trace, int(row[self.final].min())
            out[k] = divmod(best, MODEL)
        return out

    def moves(self, trace, step: int = STEP):
        """A cheapest alignment, first move to last: ``(log activity, model activity, transition)``.

        Walked from the end, a synchronous move before a log move before a
        model move, transitions by name. One cost row in ``step`` is kept
        and the rows between are made again.
        """
        row, kept = self.first, []
        for i, a in enumerate(trace):
            if i % step == 0:
                kept.append(row)
            row = self.after(row, a)
        s = min((int(f) for f in self.final), key=lambda f: (row[f], f))
        out, i = [], len(trace)
        for block in range(len(kept) - 1, -1, -1):
            begin, table = block * step, [kept.pop()]
            for a in trace[begin:i]:
                table.append(self.after(table[-1], a))
            while i > begin:
                found, s, i = self._back(trace, table[i - begin], table[i - begin - 1], s, i)
                out += found
        while i == 0:
            found, s, i = self._back(trace, self.first, None, s, i)
            out += found
        return out[::-1]

    def _back(self, trace, here, before, s, i):
        """The moves back to a marking of less cost or of the event before, last move first; i = -1 at the start."""
        queue, seen = [(s, [])], {s}
        for state, silent in queue:
            if before is not None:
                a = trace[i - 1]
                for name, src, label in self.into.get(state, ()):
                    if label and label == a and before[src] == here[state]:
                        return [*silent, (a, label, name)], src, i - 1
                if before[state] + LOG == here[state]:
                    return [*silent, (a, None, None)], state, i - 1
            elif state == self.start and here[state] == 0:
                return silent, state, -1
            for name, src, label in self.into.get(state, ()):
                if label and here[src] + MODEL == here[state]:
                    return [*silent, (None, label, name)], src, i
            for name, src, label in self.into.get(state, ()):
                if not label and src not in seen and here[src] == here[state]:
                    seen.add(src)
                    queue.append((src, [*silent, (None, None, name)]))
        raise AssertionError("a reachable marking has a predecessor")


def _graph(places: DataFrame, arcs: DataFrame) -> Graph:
    states, steps = marking_graph(places, arcs)
    return Graph(states.collect(), steps.collect())     # bounded by MOST_MARKINGS


def net_alignment(log: EventLog, places: DataFrame, arcs: DataFrame) -> DataFrame:
    """J6 on a net: cheapest alignment of each distinct variant with any run of the net.

    Rows: variant, n_cases, cost, log_moves (fewest among the cheapest),
    model_moves, sync_moves, fitness = 1 - cost / (events + shortest run).
    Events without an activity or with one that the net lacks are log moves.
    An empty log gives no rows; a net that is not bounded or cannot reach its
    final marking raises.
    """
    _batches(log)
    graph = _graph(places, arcs)
    least = int(graph.first[graph.final].min()) // MODEL
    variants = variant_arrays(log).select("trace", "n_cases")
    schema = T.StructType([*variants.schema.fields, T.StructField("cost", T.LongType()),
                           T.StructField("log_moves", T.LongType())])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = graph.costs(b.column("trace").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *[pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)]], names=schema.fieldNames())

    n = F.size("trace")
    worst = F.try_divide(F.col("cost").cast("double"), n + F.lit(least))
    return variants.mapInArrow(run, schema).select(
        _text(F.col("trace")).alias("variant"), "n_cases", "cost", "log_moves",
        (F.col("cost") - F.col("log_moves")).alias("model_moves"),
        (n - F.col("log_moves")).cast("long").alias("sync_moves"), r6(1 - F.coalesce(worst, F.lit(0.0))).alias("fitness"))


def net_alignment_moves(log: EventLog, places: DataFrame, arcs: DataFrame) -> DataFrame:
    """J7 on a net: the moves of such an alignment, one row per move.

    Rows: (variant, n_cases, pos, log_act, model_act, transition); NULL
    activities for '>>', a silent step has only its transition. Null and
    empty cases as in ``net_alignment``.
    """
    _batches(log)
    graph = _graph(places, arcs)
    variants = variant_arrays(log).select(_text(F.col("trace")).alias("variant"), "n_cases", "trace")
    schema = "variant string, n_cases long, pos long, log_act string, model_act string, transition string"

    def walked(batches):
        import pyarrow as pa

        names = ["variant", "n_cases", "pos", "log_act", "model_act", "transition"]
        for b in batches:
            for variant, n, trace in zip(*(b.column(c).to_pylist() for c in ("variant", "n_cases", "trace"))):
                found = graph.moves(trace)
                if found:
                    k = len(found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([variant] * k), pa.array([n] * k, pa.int64()), pa.array(range(k), pa.int64()),
                         *[pa.array(list(c), pa.string()) for c in zip(*found)]], names=names)

    return variants.mapInArrow(walked, schema)
