"""Alignments of traces to model traces.

Without silent transitions a log or model move costs 1 and a synchronous
move 0, so the cost of variant v against model trace m is
|v| + |m| - 2 LCS(v, m). Work is per distinct variant, in Arrow batches of
bounded rows.

The model is a table. Its distinct traces are sorted and dealt into blocks
whose size in bytes is bounded; a block goes to the tasks that hold
variants, one pass per block, and the best of the blocks is kept by a
grouped minimum. In a block the sorted traces are walked like a prefix
tree: the row of the dynamic programme that belongs to a prefix is shared
by all traces that begin with it.

The moves of the chosen trace are walked back over a table that is kept as
one row in ``STEP`` only; the rows between are made again, block by block
from the end, so a trace of n events against m takes memory of
(n / STEP + STEP) m and not n m.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import r6
from ..log import EventLog
from ..plans.cases import SIGNATURE, case_arrays, case_signatures, escaped, kept_once, variant_table
from ..plans.ranking import global_rank_sum

BLOCK_BYTES = 16 << 20      # of model traces that are sent along with a task
STEP = 512                  # rows of the table of which one is kept
BATCH_ROWS = 512            # variants in an Arrow batch

Model = DataFrame | Sequence[Sequence[str]]


def model_traces(log: EventLog, traces: Model) -> DataFrame:
    """Distinct model traces as a table with the array column ``trace``."""
    if not isinstance(traces, DataFrame):
        traces = log.spark.createDataFrame([(list(t),) for t in traces], "trace array<string>")
    return traces.select("trace").where(F.col("trace").isNotNull()).distinct()


def trace_table(log: EventLog) -> DataFrame:
    """The distinct traces of a log as model traces."""
    return variant_arrays(log).select("trace")


def variant_arrays(log: EventLog) -> DataFrame:
    """Distinct activity sequences (ARRAY<STRING>) with their number of cases.

    Cases are told apart by signature; the array is built for one case of
    each variant.
    """
    variants = kept_once(variant_table(log, case_signatures(log)))
    reps = log.with_df(log.df.join(variants.select(F.col("_rep").alias(log.case)), log.case, "left_semi"))
    arrays = case_arrays(reps, [log.activity]).select(
        F.col(log.case).alias("_rep"), F.col("events")[log.activity].alias("trace"))
    return variants.join(arrays, "_rep").select(*SIGNATURE, "trace", "n_cases")


def _blocks(model: DataFrame) -> list[list[list[str]]]:
    """Sorted model traces in blocks of at most ``BLOCK_BYTES`` (a longer trace is a block of its own)."""
    size = 16 + F.aggregate("trace", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 8)
    total = model.agg(F.sum(size)).first()[0]
    if total is None:
        return []
    if total <= BLOCK_BYTES:
        return [sorted(r["trace"] for r in model.collect())]      # bounded by the check above
    ranked = kept_once(global_rank_sum(model, [F.col("trace").asc()], {"_run": size}, "_rank")
                       .withColumn("_block", F.floor(F.col("_run") / BLOCK_BYTES)))
    numbers = sorted(r[0] for r in ranked.select("_block").distinct().collect())
    return (sorted(r["trace"] for r in ranked.where(F.col("_block") == b).select("trace").collect()) for b in numbers)


def nearest_in(trace: Sequence[str], block: Sequence[Sequence[str]]):
    """``(cost, text, model trace)`` of the nearest of the sorted traces; ties by text.

    ``rows[d]`` is the row of the prefix of length d of the trace at hand:
    longest common subsequences with every prefix of ``trace``.
    """
    import numpy as np

    number = {a: k for k, a in enumerate(dict.fromkeys(trace))}
    symbols = np.array([number[a] for a in trace], np.int64)
    places = {}     # where an activity stands in the trace
    rows, last, best = [np.zeros(len(trace) + 1, np.int32)], [], None
    for model in block:
        shared = 0
        while shared < min(len(last), len(model)) and last[shared] == model[shared]:
            shared += 1
        del rows[shared + 1:]
        for a in model[shared:]:
            if a not in places:
                places[a] = np.flatnonzero(symbols == number.get(a, -1)) + 1
            row = rows[-1].copy()
            at = places[a]
            row[at] = np.maximum(row[at], rows[-1][at - 1] + 1)
            rows.append(np.maximum.accumulate(row))
        last = model
        found = (len(trace) + len(model) - 2 * int(rows[-1][-1]), ",".join(model), list(model))
        best = found if best is None else min(best, found)
    return best


def moves(trace: Sequence[str], model: Sequence[str], step: int = STEP):
    """Moves of an optimal alignment, first to last: ``(log activity, model activity)``, None for none.

    Walked from the ends: a synchronous move first, then a log move, then a
    model move.
    """
    import numpy as np

    number = {a: k for k, a in enumerate(dict.fromkeys([*trace, *model]))}
    v = np.array([number[a] for a in trace], np.int64)
    m = np.array([number[a] for a in model], np.int64)

    def following(row, symbol):
        at = np.flatnonzero(m == symbol) + 1
        new = row.copy()
        new[at] = np.maximum(new[at], row[at - 1] + 1)
        return np.maximum.accumulate(new)

    row, kept = np.zeros(len(m) + 1, np.int32), []
    for i, symbol in enumerate(v):
        if i % step == 0:
            kept.append(row)
        row = following(row, symbol)
    out, i, j = [], len(v), len(m)
    for block in range(len(kept) - 1, -1, -1):
        first, table = block * step, [kept[block]]
        for symbol in v[first:i]:
            table.append(following(table[-1], symbol))
        while i > first:
            if j and v[i - 1] == m[j - 1]:
                out.append((trace[i - 1], model[j - 1]))
                i, j = i - 1, j - 1
            elif table[i - first][j] == table[i - first - 1][j]:
                out.append((trace[i - 1], None))
                i -= 1
            else:
                out.append((None, model[j - 1]))
                j -= 1
        kept.pop()
    out += [(None, a) for a in reversed(model[:j])]
    return out[::-1]


def _batches(log: EventLog) -> None:
    """Whole traces are rows: the Arrow batch limit of the session is lowered, never raised."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = str(log.spark.conf.get(key, "0"))
    if not now.isdigit() or not 0 < int(now) <= BATCH_ROWS:
        log.spark.conf.set(key, str(BATCH_ROWS))


def nearest(log: EventLog, traces: Model) -> DataFrame:
    """Distinct variants with their nearest model trace: ``trace``, ``n_cases``, ``cost``, ``m``."""
    _batches(log)
    variants = kept_once(variant_arrays(log))
    schema = T.StructType([*variants.schema.fields, T.StructField("_best", T.StructType([
        T.StructField("cost", T.LongType()), T.StructField("text", T.StringType()),
        T.StructField("m", T.ArrayType(T.StringType()))]))])

    def scored(block):
        def run(batches):
            import pyarrow as pa

            kind = pa.struct([("cost", pa.int64()), ("text", pa.string()), ("m", pa.list_(pa.string()))])
            for b in batches:
                best = [nearest_in(t, block) for t in b.column("trace").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array([dict(zip(("cost", "text", "m"), x)) for x in best], kind)],
                    names=schema.fieldNames())
        return run

    parts = [variants.mapInArrow(scored(block), schema) for block in _blocks(model_traces(log, traces))]
    if not parts:
        raise ValueError("no model trace given")
    if len(parts) == 1:
        out = parts[0]
    else:
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        best = every.groupBy(*SIGNATURE).agg(F.min("_best").alias("_best"))
        out = variants.join(best, SIGNATURE)
    return out.select("trace", "n_cases", F.col("_best.cost").alias("cost"), F.col("_best.m").alias("m"))


def _text(trace: Column) -> Column:
    return F.array_join(F.transform(trace, lambda a: escaped(a)), ",")


def nearest_trace_alignment(log: EventLog, traces: Model) -> DataFrame:
    """Optimal alignment cost of each distinct variant against the nearest model trace.

    ``traces``: a table with the array column ``trace``, of any size, or
    Python lists. The worst case of the fitness is |v| + the shortest model
    trace (S17). Traces are compared as arrays; texts (separators in names
    escaped) are for display. An empty log gives no rows.
    """
    least = F.broadcast(model_traces(log, traces).agg(F.min(F.size("trace")).alias("_least")).withColumn("_one", F.lit(1)))
    return nearest(log, traces).withColumn("_one", F.lit(1)).join(least, "_one").select(
        _text(F.col("trace")).alias("variant"), "n_cases", F.col("cost").cast("int").alias("cost"),
        _text(F.col("m")).alias("model_trace"), r6(1 - F.col("cost") / (F.size("trace") + F.col("_least"))).alias("fitness"))


def alignment_moves(log: EventLog, traces: Model) -> DataFrame:
    """The move list of J6's optimal alignment, one row per move.

    Rows: (variant, n_cases, pos, log_act, model_act), NULL for '>>'.
    """
    near = nearest(log, traces).select(_text(F.col("trace")).alias("variant"), "n_cases", "trace", "m")
    schema = "variant string, n_cases long, pos long, log_act string, model_act string"

    def walked(batches):
        import pyarrow as pa

        names = ["variant", "n_cases", "pos", "log_act", "model_act"]
        for b in batches:
            for variant, n, trace, model in zip(*(b.column(c).to_pylist() for c in ("variant", "n_cases", "trace", "m"))):
                pairs = moves(trace, model)
                if pairs:
                    left, right = zip(*pairs)
                    k = len(pairs)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([variant] * k), pa.array([n] * k, pa.int64()), pa.array(range(k), pa.int64()),
                         pa.array(left, pa.string()), pa.array(right, pa.string())], names=names)

    return near.mapInArrow(walked, schema)
