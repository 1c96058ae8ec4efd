"""Rating of many nets in one reading of the log.

A net is model-sized, the log is not: all nets are read as lists, and one
running pass over the events carries the tokens of every place of every net
as a column of its own. The same pass gives token replay (lowest balance,
tokens put and taken per case) and the marking before each event, of which
a second running pass makes ETC precision per prefix. No event is copied per
net, arc or place; the events are shuffled once by case, whatever the number
of nets. Nets with more than ``PASS_PLACES`` places in sum are read in
several passes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import r6
from ..log import EventLog
from ..plans.sequence import running
from .conformance import _check_net, replay_fitness_of

# Places of all nets read in one pass (columns of one plan); more take another pass.
PASS_PLACES = 100


@dataclass
class Net:
    """A net as lists: per place its markings and the tokens each activity takes and puts."""
    name: str
    n_arcs: int = 0
    marks: dict[str, list[int]] = field(default_factory=dict)           # place -> [initial, final]
    takes: dict[str, dict[str, int]] = field(default_factory=dict)      # place -> activity -> tokens
    puts: dict[str, dict[str, int]] = field(default_factory=dict)
    inputs: dict[str, set[str]] = field(default_factory=dict)           # activity -> places it takes from


def read_net(name: str, places: DataFrame, arcs: DataFrame) -> Net:
    """The lists of one net (model-sized); silent and shared labels are refused as in token replay."""
    _check_net(arcs)
    net = Net(name)
    for r in places.collect():
        m = net.marks.setdefault(r["place"], [0, 0])
        m[0] += int(r["m0"] or 0)
        m[1] += int(r["mf"] or 0)
    for r in arcs.collect():
        net.n_arcs += 1
        net.marks.setdefault(r["place"], [0, 0])
        delta = int(r["delta"])
        side = (net.takes if delta < 0 else net.puts).setdefault(r["place"], {})
        side[r["activity"]] = side.get(r["activity"], 0) + abs(delta)
        here = net.inputs.setdefault(r["activity"], set())
        if delta < 0:
            here.add(r["place"])
    return net


def _passes(nets: list[Net]) -> list[list[Net]]:
    out: list[list[Net]] = []
    room = 0
    for net in nets:
        if not out or len(net.marks) > room:
            out.append([])
            room = PASS_PLACES
        out[-1].append(net)
        room -= len(net.marks)
    return out


def _tokens(act: Column, by_activity: dict[str, int]) -> Column:
    """Tokens of this event's activity on one side of a place (0 if it has no arc there)."""
    c = F.lit(0)
    for tokens in sorted(set(by_activity.values())):
        here = act.isin(sorted(a for a, n in by_activity.items() if n == tokens))
        c = F.when(here, F.lit(tokens)).otherwise(c)
    return c


def _marked(log: EventLog, nets: list[Net]) -> DataFrame:
    """Events with their place in the case and the tokens of every place before them (``_m_<net>_<place>``)."""
    act = F.col(log.activity)
    base = log.with_df(log.df.select(log.case, log.activity, *log.order_cols))
    sums = {f"_m_{i}_{j}": ("sum", _tokens(act, net.puts.get(p, {})) - _tokens(act, net.takes.get(p, {})))
            for i, net in enumerate(nets) for j, p in enumerate(net.marks)}
    r = running(base, None, [log.case], {"_pos": ("sum", F.lit(1)), **sums}, inclusive=False)
    return r.withColumns({f"_m_{i}_{j}": F.col(f"_m_{i}_{j}") + F.lit(m0)
                          for i, net in enumerate(nets) for j, (m0, _) in enumerate(net.marks.values())})


def _fitness(log: EventLog, marked: DataFrame, nets: list[Net]) -> DataFrame:
    """K1 of every net: one row per case, then one row per net."""
    act = F.col(log.activity)
    aggs = []
    for i, net in enumerate(nets):
        for j, p in enumerate(net.marks):
            take, put = _tokens(act, net.takes.get(p, {})), _tokens(act, net.puts.get(p, {}))
            aggs += [F.min(F.col(f"_m_{i}_{j}") - take).alias(f"_low_{i}_{j}"),
                     F.sum(take).alias(f"_take_{i}_{j}"), F.sum(put).alias(f"_put_{i}_{j}")]
    per_case = marked.groupBy(log.case).agg(F.count(F.lit(1)).alias("_n"), *aggs)
    tokens = []
    for i, net in enumerate(nets):
        total = {k: F.lit(0).cast("long") for k in "pcmr"}
        for j, (m0, mf) in enumerate(net.marks.values()):
            p, c = F.col(f"_put_{i}_{j}") + m0, F.col(f"_take_{i}_{j}") + mf
            m = F.greatest(F.lit(0), -F.least(F.col(f"_low_{i}_{j}"), p - c))
            for k, v in zip("pcmr", (p, c, m, p + m - c)):
                total[k] = total[k] + v
        tokens += [v.alias(f"_{k}_{i}") for k, v in total.items()]
    x = per_case.select(*tokens)
    n = F.count(F.lit(1))
    rows = []
    for i, net in enumerate(nets):
        side = [F.col(f"_{k}_{i}") for k in "pcmr"]
        fits = F.count_if((side[2] == 0) & (side[3] == 0))
        rows.append(F.struct(F.lit(net.name).alias("model"),
                             r6(F.try_divide(fits * 100.0, n)).alias("perc_fit_traces"),
                             r6(F.avg(replay_fitness_of(*side))).alias("average_trace_fitness"),
                             r6(replay_fitness_of(*[F.sum(c) for c in side])).alias("log_fitness")))
    return x.agg(F.array(*rows).alias("_rows")).select(F.inline("_rows"))


def _precision(log: EventLog, marked: DataFrame, nets: list[Net]) -> DataFrame:
    """K2 of every net: one row per prefix (length and two hash sums), then one row per net."""
    act = F.col(log.activity)
    cols = []
    for i, net in enumerate(nets):
        mark = {p: F.col(f"_m_{i}_{j}") for j, p in enumerate(net.marks)}
        enabled, ok = [], F.lit(False)
        for t, needs in sorted(net.inputs.items()):
            can = F.lit(True)
            for p in sorted(needs):
                can = can & (mark[p] >= 1)
            enabled.append(F.when(can, F.lit(t)))
            ok = ok | ((act == t) & can)
        names = F.array_compact(F.array(*enabled)) if enabled else F.array().cast("array<string>")
        cols += [names.alias(f"_en_{i}"), F.coalesce(ok, F.lit(False)).cast("int").alias(f"_ok_{i}")]
    slim = marked.select(log.case, log.activity, *log.order_cols, "_pos", *cols)
    h1 = F.xxhash64(F.col("_pos"), act).cast("decimal(38,0)")
    h2 = F.xxhash64(F.lit("etc"), act, F.col("_pos")).cast("decimal(38,0)")
    r = running(log, slim, [log.case], {"_h1": ("sum", h1), "_h2": ("sum", h2),
                                        **{f"_fit_{i}": ("min", F.col(f"_ok_{i}")) for i in range(len(nets))}},
                inclusive=False)
    # what is enabled and whether the net fitted so far depend on the prefix alone
    g = r.groupBy("_pos", "_h1", "_h2").agg(
        F.count(F.lit(1)).alias("w"), F.collect_set(log.activity).alias("obs"),
        *[F.first(f"_en_{i}").alias(f"_en_{i}") for i in range(len(nets))],
        *[F.coalesce(F.first(f"_fit_{i}"), F.lit(1)).alias(f"_fit_{i}") for i in range(len(nets))])
    rows = []
    for i, net in enumerate(nets):
        fit, en = F.col(f"_fit_{i}") == 1, F.col(f"_en_{i}")
        escaping = F.sum(F.when(fit, F.col("w") * F.size(F.array_except(en, "obs"))))
        allowed = F.sum(F.when(fit, F.col("w") * F.size(en)))
        rows.append(F.struct(F.lit(net.name).alias("model"), r6(1 - F.try_divide(escaping, allowed)).alias("precision")))
    return g.agg(F.array(*rows).alias("_rows")).select(F.inline("_rows"))


def _generalization(log: EventLog, nets: list[Net]) -> DataFrame:
    """K3 of every net from one count of the activities."""
    pairs = [(net.name, t) for net in nets for t in sorted(net.inputs)]
    t = log.spark.createDataFrame(pairs, "model string, activity string")
    fired = log.df.groupBy(F.col(log.activity).alias("activity")).agg(F.count(F.lit(1)).alias("n"))
    term = F.when(F.coalesce("n", F.lit(0)) == 0, F.lit(1.0)).otherwise(1 / F.sqrt("n"))
    return t.join(fired, "activity", "left").groupBy("model").agg(r6(1 - F.avg(term)).alias("generalization"))


def _simplicity(net: Net) -> float:
    nodes = len(net.marks) + len(net.inputs)
    return round(1 / (1 + max(0.0, (2.0 * net.n_arcs / nodes if nodes else 0.0) - 2)), 6)


def rate_nets(log: EventLog, nets: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """One row per net: fitness (K1), precision (K2), generalization (K3), simplicity (K4).

    The values are those of the operators for one net. A net that never has a
    transition enabled has no precision (null); on a log without cases every
    figure but simplicity, and generalization of a net with transitions, is null.
    """
    lists = [read_net(name, places, arcs) for name, (places, arcs) in nets.items()]
    out = None
    for some in _passes(lists):
        marked = _marked(log, some)
        rows = _fitness(log, marked, some).join(_precision(log, marked, some), "model")
        out = rows if out is None else out.unionByName(rows)
    simple = log.spark.createDataFrame([(n.name, _simplicity(n)) for n in lists], "model string, simplicity double")
    return out.join(_generalization(log, lists), "model", "left").join(simple, "model")
