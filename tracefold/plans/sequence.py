"""Case order at scale: chunked windows with boundary stitching.

Most process-mining operators need each event's place in its case: its
position, the next and previous event, the case's first and last event,
running sums and maxima. The plain form is one window
``PARTITION BY case ORDER BY ts, tie``. That window cannot be split by AQE:
a case holding a third of all rows (a bot user, a catch-all order) lands
in one task.

So a case is cut into ordered *chunks* when it holds more than
``split_rows`` events:

1. ``hot`` = cases with more than ``split_rows`` events, found by a
   partially aggregated ``groupBy(case).count`` (map-side combine, skew
   safe). Its size is bounded by ``total_events / split_rows`` and it is
   counted before use; no hot case means no join at all.
2. ``_chunk`` = equal-depth slice of a hot case: its order range is cut
   into ``16 * ceil(n / split_rows)`` fine equal-width buckets, the events
   per bucket are counted, and buckets are packed into slices of about
   ``split_rows`` events by a running count (0 for all other cases). The
   slice number never decreases along the case order, so chunk order is
   case order, whatever the case's time distribution.
3. Windows run on ``(case, _chunk)``; a per-chunk summary (count, first
   and last event, totals) is one row per chunk, and a window over that
   small table gives every chunk its offset, its neighbours and its carry.
4. The summary is joined back on ``(case, _chunk)``; the event side keeps
   the window's hash partitioning, so only the small side is shuffled.

With no hot case the plan is exactly one exchange on ``case_id`` and one
sort, as with the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..log import EventLog, order_number
from ..session import ensure_checkpoint_dir

# Hot-case tables up to this many rows are broadcast; beyond, they are
# joined (AQE splits the hot keys on the event side).
BROADCAST_HOT_ROWS = 500_000
# Slice plans (fine buckets of all hot cases) above this many rows are
# joined on (case, bucket) instead of broadcast.
BROADCAST_PLAN_ROWS = 2_000_000


def hot_cases(log: EventLog) -> DataFrame:
    """Cases above the chunk size with their event count and order range."""
    o = log.order_number()
    split = log.chunk_rows()
    return (log.df.groupBy(log.case)
            .agg(F.count(F.lit(1)).alias("_n"), F.min(o).alias("_lo"), F.max(o).alias("_hi"))
            .where(F.col("_n") > F.lit(split))
            .select(log.case, "_n", "_lo", "_hi",
                    (F.ceil(F.col("_n") / F.lit(split)) * FINE).cast("long").alias("_fine")))


# Fine buckets per slice of a hot case: slices are built from buckets of
# 1/FINE of the even-width slice; a bucket that still holds more than
# ``split_rows`` events is cut once more.
FINE = 16


def _share(x: Column, lo: Column, hi: Column, parts: Column) -> Column:
    """Equal-width part of [lo, hi] that x lies in (clipped, never decreasing)."""
    frac = (x - lo) / (hi - lo + F.lit(1))
    return F.greatest(F.lit(0), F.least(F.floor(frac * parts), parts - 1)).cast("long")


def _bucket(o: Column) -> Column:
    """Fine equal-width bucket of the case's order range."""
    return _share(o, F.col("_lo"), F.col("_hi"), F.col("_fine"))


def _tie_number(log: EventLog) -> Column:
    """Numeric image of the order column behind the first (0 if it has none)."""
    rest = log.order_cols[1:2]
    if not rest or not isinstance(log.df.schema[rest[0]].dataType, (T.NumericType, T.DateType, T.TimestampType,
                                                                     T.TimestampNTZType)):
        return F.lit(0).cast("long")
    return order_number(log.df, rest[0])


def _sub_bucket(o: Column, t: Column) -> Column:
    """Part of an overfull bucket: by its own range, or by the tie where the whole bucket has one time."""
    by_tie = F.col("_olo") == F.col("_ohi")
    part = F.when(by_tie, _share(t, F.col("_tlo"), F.col("_thi"), F.col("_sub"))).otherwise(
        _share(o, F.col("_olo"), F.col("_ohi"), F.col("_sub")))
    return F.coalesce(part, F.lit(0).cast("long"))


def _full_buckets(log: EventLog, hot: DataFrame, small: bool) -> DataFrame:
    """(case, _fb, ranges, _sub): fine buckets with more than ``split_rows`` events (a burst, a coarse clock)."""
    split = log.chunk_rows()
    side = F.broadcast(hot) if small else hot
    o, t = log.order_number(), _tie_number(log)
    return (log.df.join(side, log.case).groupBy(log.case, _bucket(o).alias("_fb"))
            .agg(F.count(F.lit(1)).alias("_c"), F.min(o).alias("_olo"), F.max(o).alias("_ohi"),
                 F.min(t).alias("_tlo"), F.max(t).alias("_thi"))
            .where(F.col("_c") > F.lit(split))
            .select(log.case, "_fb", "_olo", "_ohi", "_tlo", "_thi",
                    (F.ceil(F.col("_c") / F.lit(split)) * FINE).cast("long").alias("_sub")))


def _located(log: EventLog, df: DataFrame, full: DataFrame | None) -> DataFrame:
    """Rows (of hot cases) with their bucket ``_fb`` and part ``_sb``."""
    out = df.withColumn("_fb", F.when(F.col("_fine").isNotNull(), _bucket(log.order_number())))
    if full is None:
        return out.withColumn("_sb", F.lit(0).cast("long"))
    j = out.join(full, [log.case, "_fb"], "left")
    return j.withColumn("_sb", _sub_bucket(log.order_number(), _tie_number(log))).drop(
        "_olo", "_ohi", "_tlo", "_thi", "_sub")


def _slice_plan(log: EventLog, hot: DataFrame, full: DataFrame | None, small: bool) -> DataFrame:
    """(case, _fb, _sb, _chunk): every bucket of every hot case mapped to its slice.

    Buckets are counted (partial aggregation, tiny output), then a running
    count per case packs them into slices of about ``split_rows`` events:
    equal-depth slices, whatever the case's time distribution. Logs derived
    from this one may hold events in buckets that were empty here, so every
    bucket is listed; slice numbers never decrease along the case.
    """
    split = log.chunk_rows()
    side = F.broadcast(hot) if small else hot
    counts = (_located(log, log.df.join(side, log.case), full)
              .groupBy(log.case, "_fb", "_sb").agg(F.count(F.lit(1)).alias("_c")))
    every = hot.select(log.case, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_fine") - 1)).alias("_fb"))
    if full is None:
        every = every.withColumn("_sb", F.lit(0).cast("long"))
    else:
        every = (every.join(full.select(log.case, "_fb", "_sub"), [log.case, "_fb"], "left")
                 .withColumn("_sb", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_sub", F.lit(1)) - 1)))
                 .drop("_sub"))
    keys = [log.case, "_fb", "_sb"]
    w = Window.partitionBy(log.case).orderBy("_fb", "_sb").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_c").over(w), F.lit(0))
    return every.join(counts, keys, "left").fillna(0, subset=["_c"]).select(
        *keys, F.floor(before / F.lit(split)).cast("long").alias("_chunk"))


def with_chunks(log: EventLog, flag: bool = False) -> tuple[DataFrame, bool]:
    """Events with ``_chunk``; second value tells whether any case was cut.

    ``flag=True`` also keeps ``_hot`` (the case was cut), so callers can
    finish the other cases in one step.
    """
    # The plan (hot cases and their slices) is remembered on the log and
    # shared with logs derived by ``with_df`` (same or sub-cases, at most a
    # constant factor more rows), so a chain of ordered operators builds it
    # once. Slicing only balances work, it never changes a result; a log
    # that gains rows later only risks balance, so build a new EventLog.
    memo_key = ("hot", log.order[0], log.chunk_rows())
    if memo_key in log.extra:
        hot, n_hot, full, plan, n_plan = log.extra[memo_key]
    else:
        hot = hot_cases(log)
        n_hot = hot.count()  # size check, one job; most logs have no hot case
        full = plan = None
        n_plan = 0
        if n_hot:
            # small tables, read by every ordered operator on the log: written once
            ensure_checkpoint_dir(log.spark)
            small = n_hot <= BROADCAST_HOT_ROWS
            hot = hot.checkpoint(eager=True)
            full = _full_buckets(log, hot, small).checkpoint(eager=True)
            full = full if full.limit(1).count() else None
            plan = _slice_plan(log, hot, full, small).checkpoint(eager=True)
            n_plan = plan.count()
        log.extra[memo_key] = (hot, n_hot, full, plan, n_plan)
    if n_hot == 0:
        out = log.df.withColumn("_chunk", F.lit(0).cast("long"))
        return (out.withColumn("_hot", F.lit(False)) if flag else out), False
    hs = hot.select(log.case, "_lo", "_hi", "_fine")
    j = log.df.join(F.broadcast(hs) if n_hot <= BROADCAST_HOT_ROWS else hs, log.case, "left")
    j = _located(log, j, full)
    pl = F.broadcast(plan) if n_plan <= BROADCAST_PLAN_ROWS else plan
    j = j.join(pl, [log.case, "_fb", "_sb"], "left").withColumn("_chunk", F.coalesce("_chunk", F.lit(0).cast("long")))
    if flag:
        j = j.withColumn("_hot", F.col("_fine").isNotNull())
    return j.drop("_lo", "_hi", "_fine", "_fb", "_sb"), True


def _order(log: EventLog) -> list[Column]:
    return [F.col(c).asc() for c in log.order_cols]


def sequenced(log: EventLog, carry: Sequence[str] = ("activity", "ts")) -> DataFrame:
    """Every event with its place in the case.

    Adds ``pos`` (0-based), ``case_size``, and for each carried column ``c``:
    ``next_c``, ``prev_c`` (NULL at the case ends), ``first_c``, ``last_c``
    (the case's first / last event).
    """
    carry = [c for c in carry if c in log.df.columns]
    df, cut = with_chunks(log)
    case = log.case
    order = _order(log)
    if not cut:
        w = Window.partitionBy(case).orderBy(*order)
        wall = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        cols = [(F.row_number().over(w) - 1).cast("long").alias("pos"),
                F.count(F.lit(1)).over(wall).alias("case_size")]
        for c in carry:
            cols += [F.lead(c).over(w).alias(f"next_{c}"),
                     F.lag(c).over(w).alias(f"prev_{c}"),
                     F.first(c).over(wall).alias(f"first_{c}"),
                     F.last(c).over(wall).alias(f"last_{c}")]
        return df.select(*[x for x in df.columns if x != "_chunk"], *cols)

    keys = [case, "_chunk"]
    w = Window.partitionBy(*keys).orderBy(*order)
    local = df.select("*",
                      (F.row_number().over(w) - 1).cast("long").alias("_lpos"),
                      *[F.lead(c).over(w).alias(f"_ln_{c}") for c in carry],
                      *[F.lag(c).over(w).alias(f"_lp_{c}") for c in carry])
    ord_struct = F.struct(*[F.col(c) for c in log.order_cols])
    ev_struct = F.struct(*[F.col(c) for c in carry])
    summary = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_cn"),
        F.min_by(ev_struct, ord_struct).alias("_cf"),
        F.max_by(ev_struct, ord_struct).alias("_cl"))
    wc = Window.partitionBy(case).orderBy("_chunk")
    wcall = wc.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summary = summary.select(
        *keys, "_cn",
        F.coalesce(F.sum("_cn").over(wc.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"),
        F.sum("_cn").over(wcall).alias("case_size"),
        F.lead("_cf").over(wc).alias("_nf"),
        F.lag("_cl").over(wc).alias("_pl"),
        F.first("_cf").over(wcall).alias("_ff"),
        F.last("_cl").over(wcall).alias("_ll"))
    j = local.join(summary, keys, "inner")
    last_in_chunk = F.col("_lpos") == F.col("_cn") - 1
    first_in_chunk = F.col("_lpos") == 0
    cols = [(F.col("_lpos") + F.col("_off")).cast("long").alias("pos"),
            F.col("case_size").cast("long").alias("case_size")]
    for c in carry:
        cols += [F.when(last_in_chunk, F.col("_nf")[c]).otherwise(F.col(f"_ln_{c}")).alias(f"next_{c}"),
                 F.when(first_in_chunk, F.col("_pl")[c]).otherwise(F.col(f"_lp_{c}")).alias(f"prev_{c}"),
                 F.col("_ff")[c].alias(f"first_{c}"),
                 F.col("_ll")[c].alias(f"last_{c}")]
    base = [x for x in log.df.columns]
    return j.select(*base, *cols)


_KINDS = {"sum": F.sum, "max": F.max, "min": F.min}


def running(log: EventLog, df: DataFrame | None, keys: Sequence[str],
            aggs: dict[str, tuple[str, Column]], inclusive: bool = True,
            order: Sequence[Column] | None = None) -> DataFrame:
    """Running sum / max / min per ``keys`` (case first) in case order.

    ``aggs`` maps output name to (kind, expression). ``inclusive=False``
    excludes the current row (NULL for max/min at the first row, 0 for sum).
    Works on chunked cases by adding each chunk's carry from the chunks
    before it.
    """
    base = log.with_df(df) if df is not None else log
    cdf, cut = with_chunks(base)
    order = list(order) if order is not None else _order(base)
    hi = 0 if inclusive else -1
    keys = list(keys)
    if not cut:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, hi)
        cols = []
        for name, (kind, expr) in aggs.items():
            v = _KINDS[kind](expr).over(w)
            cols.append((F.coalesce(v, F.lit(0)) if kind == "sum" else v).alias(name))
        return cdf.select(*[c for c in cdf.columns if c != "_chunk"], *cols)

    w = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, hi)
    local = cdf.select("*", *[_KINDS[k](e).over(w).alias(f"_l_{n}") for n, (k, e) in aggs.items()])
    tot = cdf.groupBy(*keys, "_chunk").agg(*[_KINDS[k](e).alias(f"_t_{n}") for n, (k, e) in aggs.items()])
    wc = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*keys, "_chunk", *[_KINDS[k](F.col(f"_t_{n}")).over(wc).alias(f"_c_{n}")
                                         for n, (k, e) in aggs.items()])
    j = local.join(tot, [*keys, "_chunk"], "inner")
    cols = []
    for n, (k, e) in aggs.items():
        l, c = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        if k == "sum":
            v = F.coalesce(l, F.lit(0)) + F.coalesce(c, F.lit(0))
        elif k == "max":
            v = F.greatest(l, c)
        else:
            v = F.least(l, c)
        cols.append(v.alias(n))
    return j.select(*[c for c in cdf.columns if c != "_chunk"], *cols)
