"""Time performance (inventory group H, eventually-follows D4).

Case durations come from partially aggregated ``groupBy``; the telescoping
mean of gaps (H3/H4) needs no sort at all; the exact median ranks values
with the distributed ``global_rank_sum`` instead of one task holding all
values. Lead / cycle time (S18) runs on chunked case windows with carries.

The temporal profile (S19) never emits event pairs: with per-activity
running counts C_a, sums S_a and sums of squares Q_a of earlier event
times, the pairs (a, b) ending in event j contribute
``n = C_a``, ``sum d = C_a t_j - S_a``, ``sum d^2 = C_a t_j^2 - 2 t_j S_a + Q_a``.
An event meets each activity of its own case once, whatever the alphabet.
Times are exact integers (DECIMAL(38,0) microseconds from the case's first
timestamp), so the result does not depend on summation order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import exact_mean_std, mean_std_of_sums, r6, seconds_between, us_between
from ..log import EventLog, micros
from ..plans.cases import kept_once
from ..plans.sequence import running, sequenced


def case_durations(log: EventLog) -> DataFrame:
    """H1: duration of every case (seconds, from exact microseconds)."""
    return log.df.groupBy(log.case).agg(us_between(F.min("ts"), F.max("ts")).alias("duration_us")) \
        .select(log.case, (F.col("duration_us") / 1e6).alias("duration_s"), "duration_us")


# Parts of a range in a round of selection, and how many values of a range are listed with their counts.
SELECT_PARTS = 4096
SELECT_LISTED = 1_000_000


def value_bin(x: Column) -> Column:
    """Bin of a whole number, rising with it: 256 to a power of two on either side of zero."""
    return (F.signum(x) * F.floor(F.log2(F.abs(x.cast("double")) + 1) * 256)).cast("int")


def binned(df: DataFrame, keys: Sequence[str], col: str, *aggs: Column) -> DataFrame:
    """(keys, ``_bin``, ``_c``, ``_lo``, ``_hi``, aggs): the first histogram, one partial aggregate."""
    return df.where(F.col(col).isNotNull()).groupBy(*keys, value_bin(F.col(col)).alias("_bin")).agg(
        F.count(F.lit(1)).alias("_c"), F.min(col).alias("_lo"), F.max(col).alias("_hi"), *aggs)


def _ranges_of(hist: DataFrame, keys: Sequence[str], order: str, rank: Column) -> DataFrame:
    """Of each ``keys`` the bin that holds the rank: ``_at`` (the rank in the bin), ``_c``, ``_lo``, ``_hi``."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = hist.withColumn("_before", F.sum("_c").over(w) - F.col("_c"))
    return run.where((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_c"))).select(
        *keys, (rank - F.col("_before")).alias("_at"), "_c", "_lo", "_hi")


def group_median(df: DataFrame, keys: Sequence[str], col: str, hist: DataFrame | None = None) -> DataFrame:
    """(keys, median): exact median of a whole-number column per group, by distributed selection.

    No sort and no copy of the rows. A histogram per group (counts only)
    tells which bin holds the two middle ranks; a range that is still large
    is parted again, with a pass over the rows that lie in it, until the
    values left can be counted one by one. Ranges shrink by a factor of
    ``SELECT_PARTS``, so a handful of rounds ends whatever the values are;
    usually the first histogram and the final count are all. Nulls do not
    count. ``hist``: a table from ``binned``, if the caller has one.
    """
    keys = list(keys)
    hist = kept_once(hist if hist is not None else binned(df, keys, col))
    n = hist.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    ranks = F.array_distinct(F.array(F.floor((F.col("_n") - 1) / 2), F.ceil((F.col("_n") - 1) / 2)))
    asked = n.select(*keys, F.explode(ranks).alias("_rank"))
    each = [*keys, "_rank"]
    ranges = kept_once(_ranges_of(hist.join(asked, keys), each, "_bin", F.col("_rank")))
    while True:
        most = ranges.where("_lo < _hi").agg(F.max("_c")).first()[0]
        if most is None or most <= SELECT_LISTED:
            break
        inside = df.select(*keys, F.col(col).alias("_x")).join(ranges.where("_lo < _hi"), keys).where(
            (F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi")))
        width = F.col("_hi").cast("double") - F.col("_lo") + 1
        part = F.floor((F.col("_x").cast("double") - F.col("_lo")) / width * SELECT_PARTS)
        finer = inside.groupBy(*each, "_at", part.alias("_part")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        parted = _ranges_of(finer.withColumnRenamed("_at", "_goal"), [*each, "_goal"], "_part", F.col("_goal")).drop("_goal")
        ranges = kept_once(ranges.where("_lo = _hi").unionByName(parted))
    left = ranges.where("_lo < _hi")
    counts = (df.select(*keys, F.col(col).alias("_x")).join(left, keys)
              .where((F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi")))
              .groupBy(*each, "_at", "_x").agg(F.count(F.lit(1)).alias("_c")))
    w = Window.partitionBy(*each).orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = counts.withColumn("_before", F.sum("_c").over(w) - F.col("_c")).where(
        (F.col("_before") <= F.col("_at")) & (F.col("_at") < F.col("_before") + F.col("_c"))).select(*keys, "_x")
    sure = ranges.where("_lo = _hi").select(*keys, F.col("_lo").alias("_x"))
    return sure.unionByName(found).groupBy(*keys).agg(F.avg("_x").alias("median"))


def exact_median(df: DataFrame, col: str) -> DataFrame:
    """Exact median of a whole-number column (one row; null if there is no value)."""
    one = group_median(df.select(F.lit(0).alias("_one"), col), ["_one"], col)
    return one.agg(F.max("median").alias("median"))


def median_case_duration(log: EventLog) -> DataFrame:
    """H2: exact median case duration in seconds."""
    m = exact_median(case_durations(log), "duration_us")
    return m.select((F.col("median") / 1e6).alias("median_s"))


def case_arrival_avg(log: EventLog, which: str = "start") -> DataFrame:
    """H3 / H4: mean gap between consecutive case starts (or ends), in seconds.

    The gaps telescope: (last - first) / (n - 1), so no global sort is needed.
    0 when there is at most one case.
    """
    agg = F.min("ts") if which == "start" else F.max("ts")
    ct = log.df.groupBy(log.case).agg(agg.alias("_t"))
    out = ct.agg(us_between(F.min("_t"), F.max("_t")).alias("_span"), F.count(F.lit(1)).alias("_n"))
    v = F.coalesce(F.try_divide(F.col("_span").cast("double"), (F.col("_n") - 1).cast("double")), F.lit(0.0))
    name = "case_arrival_avg_s" if which == "start" else "case_dispersion_avg_s"
    return out.select((v / 1e6).alias(name))


# ------------------------------------------------------------------ business hours (H5)

_DAY_US = 86_400_000_000


def business_us_before(t: Column, work: tuple[int, int] = (8, 16),
                       weekends: Sequence[int] = (6, 7)) -> Column:
    """Working microseconds from the epoch to ``t`` (closed form, no per-day rows).

    Working time: hours ``work[0]``..``work[1]`` on ISO weekdays not in
    ``weekends``. Whole weeks are counted arithmetically, the remaining
    days of the week through a 7-element array.
    """
    us = micros(t)
    days = F.floor(us / F.lit(_DAY_US))
    sod = us - days * F.lit(_DAY_US)
    shifted = days + F.lit(3)                       # 1970-01-01 is a Thursday
    weeks = F.floor(shifted / 7)
    rem = (shifted - weeks * 7).cast("int")         # 0 = Monday
    workdays = [d for d in range(1, 8) if d not in set(weekends)]
    per_day = F.lit((work[1] - work[0]) * 3_600_000_000)
    elapsed = F.slice(F.array(*[F.lit(d) for d in range(1, 8)]), 1, rem)  # Monday .. yesterday
    full_days = weeks * len(workdays) + F.size(F.filter(elapsed, lambda x: ~x.isin(list(weekends))))
    is_work = ~(rem + 1).isin(list(weekends))
    lo, hi = F.lit(work[0] * 3_600_000_000), F.lit(work[1] * 3_600_000_000)
    part = F.when(is_work, F.least(F.greatest(sod, lo), hi) - lo).otherwise(F.lit(0))
    return full_days * per_day + part


def business_seconds(a: Column, b: Column, work=(8, 16), weekends=(6, 7)) -> Column:
    """H5: working seconds in [a, b] (0 when b <= a)."""
    d = business_us_before(b, work, weekends) - business_us_before(a, work, weekends)
    return F.when(b > a, d / 1e6).otherwise(F.lit(0.0))


def business_hours(log: EventLog, start: str = "start_ts", end: str = "ts",
                   work=(8, 16), weekends=(6, 7)) -> DataFrame:
    """H5 per event: plain and working seconds of the [start, end] interval."""
    return log.df.select(log.case, *log.tie, seconds_between(F.col(start), F.col(end)).alias("plain_s"),
                         r6(business_seconds(F.col(start), F.col(end), work, weekends)).alias("business_s"))


# ------------------------------------------------------------------ lead / cycle time (H7, H9)

def lead_cycle_time(log: EventLog, start: str = "start_ts", end: str = "ts",
                    business: dict | None = None) -> DataFrame:
    """H7 (S18) / H9: partial cycle, lead, waste and ratio per interval event.

    Events are ordered by start. M = max end of the earlier events;
    worked = max(0, end - max(start, M)); idle = max(0, start - M); cycle
    and lead are running sums. ``business`` = {"work": (8, 16),
    "weekends": (6, 7)} measures every difference in working time.
    """
    ordered = EventLog(log.df, order=(start,), tie=log.tie, case=log.case,
                       activity=log.activity, split_rows=log.split_rows, extra=log.extra)
    m = running(ordered, None, [log.case], {"_m": ("max", F.col(end))}, inclusive=False)
    s, e, M = F.col(start), F.col(end), F.col("_m")
    if business:
        def meas(a, b):
            w, we = business.get("work", (8, 16)), business.get("weekends", (6, 7))
            return (business_us_before(b, w, we) - business_us_before(a, w, we)).cast("double")
    else:
        def meas(a, b):
            return (micros(b) - micros(a)).cast("double")
    from_ = F.when(M.isNull(), s).otherwise(F.greatest(s, M))
    worked = F.when(e > from_, meas(from_, e)).otherwise(F.lit(0.0))
    idle = F.when(M.isNotNull() & (s > M), meas(M, s)).otherwise(F.lit(0.0))
    m = m.withColumn("_w", worked).withColumn("_i", idle)
    r = running(ordered, m, [log.case], {"_cyc": ("sum", F.col("_w")), "_idl": ("sum", F.col("_i"))})
    cyc, lead = F.col("_cyc"), F.col("_cyc") + F.col("_idl")
    return r.select(log.case, log.activity, *log.tie, start, end,
                    r6(cyc / 1e6).alias("partial_cycle_s"), r6(lead / 1e6).alias("partial_lead_s"),
                    r6((lead - cyc) / 1e6).alias("overall_waste_s"), r6(F.col("_i") / 1e6).alias("this_waste_s"),
                    r6(F.when(lead == 0, F.lit(1.0)).otherwise(cyc / lead)).alias("ratio_cycle_lead"))


def case_profile_times(log: EventLog, start: str = "start_ts", end: str = "ts") -> DataFrame:
    """E5: case profile (E4) with the final cycle, lead and waste of each case."""
    from .stats import case_profile
    lc = lead_cycle_time(log, start, end)
    per = lc.groupBy(log.case).agg(
        F.max("partial_cycle_s").alias("cycle_s"), F.max("partial_lead_s").alias("lead_s"),
        F.count_distinct("activity").alias("n_activities"))
    return case_profile(log).join(per, log.case).select(
        log.case, "n_events", "activity_list", "n_activities", "n_resources", "duration_s", "cycle_s", "lead_s",
        r6(F.col("lead_s") - F.col("cycle_s")).alias("waste_s"))


def sojourn_time(log: EventLog, start: str = "start_ts", end: str = "ts") -> DataFrame:
    """H8: mean (end - start) per activity, seconds."""
    mean, _ = exact_mean_std(us_between(F.col(start), F.col(end)))
    return log.df.groupBy(log.activity).agg(mean.alias("sojourn_s"), F.count(F.lit(1)).alias("n_events"))


def performance_spectrum(log: EventLog, acts: Sequence[str]) -> DataFrame:
    """Consecutive segments (a_i -> a_i+1 of ``acts``) of each case projected on ``acts``."""
    proj = log.with_df(log.df.where(F.col(log.activity).isin(list(acts))))
    s = sequenced(proj, carry=("activity", "ts"))
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in zip(acts, acts[1:])]
    ok = F.lit(False)
    for a, b in zip(acts, acts[1:]):
        ok = ok | ((F.col("activity") == a) & (F.col("next_activity") == b))
    return s.where(ok).select(log.case, F.col("activity").alias("from_activity"),
                              F.col("next_activity").alias("to_activity"),
                              F.col("ts").alias("start_ts"), F.col("next_ts").alias("end_ts"),
                              seconds_between(F.col("ts"), F.col("next_ts")).alias("duration_s"))


# ------------------------------------------------------------------ eventually follows

def _pair_sums(log: EventLog) -> DataFrame:
    """(a, b, n, s1, s2): pairs i<j in a case with act_i=a, act_j=b; sums of d and d^2 (us).

    Each event is repeated once per distinct activity of its case; running
    sums per (case, activity) then carry count, time and squared time of the
    earlier events of that activity. Nothing depends on the whole alphabet
    and nothing is gathered on the driver.
    """
    per = log.df.groupBy(log.case).agg(F.min(micros(F.col("ts"))).alias("_t0"),
                                       F.collect_set(log.activity).alias("_acts"))
    x = (log.df.select(log.case, log.activity, *log.order_cols).join(per, log.case)
         .withColumn("_t", (micros(F.col("ts")) - F.col("_t0")).cast("decimal(38,0)"))
         .withColumn("_a", F.explode("_acts")).drop("_t0", "_acts"))
    is_a, zero = F.col(log.activity) == F.col("_a"), F.lit(0).cast("decimal(38,0)")
    r = running(log, x, [log.case, "_a"], {
        "_c": ("sum", is_a.cast("long")), "_s": ("sum", F.when(is_a, F.col("_t")).otherwise(zero)),
        "_q": ("sum", F.when(is_a, F.col("_t") * F.col("_t")).otherwise(zero))}, inclusive=False)
    big = lambda c: F.col(c).cast("decimal(38,0)")
    c, t, s, q = (big(k) for k in ("_c", "_t", "_s", "_q"))
    return (r.where(F.col("_c") > 0).groupBy(F.col("_a").alias("a"), F.col(log.activity).alias("b"))
            .agg(F.sum(c).alias("n"), F.sum(c * t - s).alias("s1"),
                 F.sum(t * (c * t - s) - (t * s - q)).alias("s2")))


def eventually_follows(log: EventLog) -> DataFrame:
    """(a, b) -> number of event pairs in a case with a before b."""
    return _pair_sums(log).select("a", "b", F.col("n").cast("long").alias("n_pairs"))


def temporal_profile(log: EventLog) -> DataFrame:
    """H11 (S19): mean and sample std of the time from a to every later b, in seconds."""
    p = _pair_sums(log)
    mean, std = mean_std_of_sums(F.col("n"), F.col("s1"), F.col("s2"))
    return p.select("a", "b", F.col("n").cast("long").alias("n_pairs"), mean.alias("mean_s"), std.alias("std_s"))
