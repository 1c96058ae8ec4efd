"""A case holding a third of the log is cut into many slices and still gives exact results."""

from pyspark.sql import functions as F

from helpers import make_log
from tracefold.operators import discovery as I
from tracefold.operators import stats as S
from tracefold.operators import timing as H
from tracefold.plans.sequence import with_chunks


def _skewed(spark, split=None):
    rows, k = [], 0
    acts = "abcde"
    for i in range(1200):                      # the hot case: a third of all events
        k += 1
        rows.append(("hot", acts[(i * 7) % 5], i * 0.5, k))
    for c in range(400):                       # 400 ordinary cases of 6 events
        for i in range(6):
            k += 1
            rows.append((f"c{c}", acts[(c + i * 3) % 5], c + i, k))
    return make_log(spark, rows, split_rows=split)


def test_hot_case_is_sliced(spark):
    df, cut = with_chunks(_skewed(spark, split=50))
    assert cut
    per = {r["case_id"]: r["n"] for r in df.groupBy("case_id").agg(F.count_distinct("_chunk").alias("n")).collect()}
    assert per["hot"] >= 24                      # equal-depth slices of about 50 events
    assert max(v for c, v in per.items() if c != "hot") == 1
    biggest = df.where("case_id = 'hot'").groupBy("_chunk").count().agg(F.max("count")).collect()[0][0]
    assert biggest <= 50 + 4                     # split_rows plus at most one fine bucket


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_sliced_results_equal_plain(spark):
    plain, sliced = _skewed(spark), _skewed(spark, split=50)
    for fn, cols in [(I.dfg_frequency, ["a", "b", "n"]),
                     (H.temporal_profile, ["a", "b", "n_pairs", "mean_s", "std_s"]),
                     (S.variant_stats, ["variant", "n_cases"]),
                     (S.case_profile, ["case_id", "n_events", "activity_list"])]:
        assert _rows(fn(plain), cols) == _rows(fn(sliced), cols), fn.__name__


def test_case_statistics_follow_case_ids(spark):
    log = _skewed(spark, split=50)
    with_chunks(log)                                     # counts once and remembers
    derived = log.with_df(log.df.where("activity <> 'e'"))
    assert derived.extra is log.extra                    # same cases: shared
    _, cut = with_chunks(derived)
    assert cut
    renamed = log.with_cases(log.df.withColumn("case_id", F.concat("case_id", F.lit("#0"))))
    assert renamed.extra == {}                           # new case ids: counted afresh
    df, cut = with_chunks(renamed)
    assert cut and df.where("case_id = 'hot#0'").select("_chunk").distinct().count() >= 24


def test_bursty_hot_case_gets_equal_depth_slices(spark):
    # half of the hot case's events fall into the first 5 % of its time span
    rows, k = [], 0
    for i in range(600):
        k += 1
        rows.append(("hot", "abcde"[i % 5], i * 0.05, k))
    for i in range(600):
        k += 1
        rows.append(("hot", "abcde"[(i * 3) % 5], 30 + i, k))
    for c in range(300):
        for i in range(4):
            k += 1
            rows.append((f"c{c}", "abcde"[(c + i) % 5], c + i, k))
    log = make_log(spark, rows, split_rows=50)
    df, cut = with_chunks(log)
    sizes = [r["count"] for r in df.where("case_id = 'hot'").groupBy("_chunk").count().collect()]
    assert cut and max(sizes) <= 2 * 50 and sum(sizes) == 1200
    plain = make_log(spark, rows)
    cols = ["a", "b", "n"]
    rows_of = lambda d: sorted(tuple(r[c] for c in cols) for r in d.collect())
    assert rows_of(I.dfg_frequency(log)) == rows_of(I.dfg_frequency(plain))


def test_one_time_and_coarse_clocks_are_sliced(spark):
    """A hot case at one single time, or on a clock of days, is cut by the tie column behind it."""
    for minutes in (lambda i: 5, lambda i: 1440 * (i // 300), lambda i: 0 if i < 1000 else 10_000 + i):
        rows = [("hot", "abc"[i % 3], minutes(i), i) for i in range(1200)] + [(f"c{i}", "a", i, 5000 + i) for i in range(50)]
        log = make_log(spark, rows, split_rows=50)
        df, cut = with_chunks(log)
        assert cut
        biggest = df.where("case_id = 'hot'").groupBy("_chunk").count().agg(F.max("count")).collect()[0][0]
        assert biggest <= 50 + 8
        order = [r["_chunk"] for r in df.where("case_id = 'hot'").orderBy("ts", "tie").collect()]
        assert order == sorted(order)
        assert _rows(I.dfg_frequency(make_log(spark, rows)), ["a", "b", "n"]) == _rows(I.dfg_frequency(log), ["a", "b", "n"])
