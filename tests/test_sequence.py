"""Chunked (hot-case) plans give the same answers as plain case windows."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import make_log
from tracefold.plans.cases import case_variants
from tracefold.plans.sequence import running, sequenced


def _rows(n_cases=5, seed=1):
    rnd = random.Random(seed)
    rows, tie = [], 0
    for c in range(n_cases):
        n = rnd.choice([1, 2, 7, 40])
        for _ in range(n):
            tie += 1
            # few distinct minutes -> many equal timestamps, tie decides
            rows.append((f"c{c}", rnd.choice("abcd"), rnd.randint(0, 5), tie))
    return rows


def _key(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("split", [None, 1, 3])
def test_sequenced_matches_plain_loop(spark, split):
    rows = _rows()
    log = make_log(spark, rows, split_rows=split)
    got = _key(sequenced(log, carry=("activity",)),
               ["case_id", "tie", "pos", "case_size", "next_activity", "prev_activity",
                "first_activity", "last_activity"])
    want = []
    for c in sorted({r[0] for r in rows}):
        ev = sorted([r for r in rows if r[0] == c], key=lambda r: (r[2], r[3]))
        for i, r in enumerate(ev):
            want.append((c, r[3], i, len(ev), ev[i + 1][1] if i + 1 < len(ev) else None,
                         ev[i - 1][1] if i else None, ev[0][1], ev[-1][1]))
    assert got == sorted(want)


@pytest.mark.parametrize("split", [None, 2])
def test_running_sum_and_max(spark, split):
    rows = _rows(seed=3)
    log = make_log(spark, rows, split_rows=split)
    r = running(log, None, ["case_id"], {"s": ("sum", F.col("tie")), "m": ("max", F.col("tie"))},
                inclusive=False)
    got = _key(r, ["case_id", "tie", "s", "m"])
    want = []
    for c in sorted({r[0] for r in rows}):
        ev = sorted([r for r in rows if r[0] == c], key=lambda r: (r[2], r[3]))
        for i, r in enumerate(ev):
            prev = [e[3] for e in ev[:i]]
            want.append((c, r[3], sum(prev), max(prev) if prev else None))
    assert got == sorted(want)


def test_variants_chunked_equal_plain(spark):
    rows = _rows(seed=5)
    a = _key(case_variants(make_log(spark, rows)), ["case_id", "variant"])
    b = _key(case_variants(make_log(spark, rows, split_rows=2)), ["case_id", "variant"])
    assert a == b


def test_ties_decide_order(spark):
    log = make_log(spark, [("c", "x", 0, 2), ("c", "y", 0, 1)])
    v = case_variants(log).collect()[0]
    assert v["variant"] == "y,x"


def test_comma_in_activity_name(spark):
    log = make_log(spark, [("c", "a,b", 0, 1), ("c", "d", 1, 2)])
    assert case_variants(log).collect()[0]["variant"] == "a\\,b,d"
