"""Filter interaction audit over sorted posting lists (operator 12)."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, checkpointed

RANGE = 1 << 16         # row ids in a range
HEAVY = 1000            # a text of more than this part of all rows is heavy: fewer than so many can be
# Fixed values of the contract.
MIN_WORDS = 200
MIN_DISTINCT = 50       # percent of the words
MAX_CAPITALS = 2        # percent of the code points
SIGNS = b"#$%&*|"
FILTERS = ("A", "B", "C", "D", "E")

_CAPITALS = bytes(range(65, 91))
_FOLLOWING = bytes(range(128, 192))     # bytes of UTF-8 that start no code point


def text_failures(text: bytes) -> tuple[bool, bool, bool, bool]:
    """A to D: few words, few distinct words, many capitals, a sign."""
    words = text.split()        # on the contract's white space exactly
    points = len(text.translate(None, _FOLLOWING))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (len(words) < MIN_WORDS, 100 * len(set(words)) < MIN_DISTINCT * len(words),
            100 * capitals > MAX_CAPITALS * points, len(text.translate(None, SIGNS)) < len(text))


def filtered(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             part_col: str = "source") -> DataFrame:
    """``(part, A, B, C, D, E, good, toxic)``: one row per document, true where it fails.

    One pass over the texts leaves ids, four flags and a SHA-256. The first
    id of each repeated text is a grouped minimum and comes back by a join;
    texts that more than a thousandth of all rows share are fewer than a
    thousand and broadcast, so no key of the shuffled join is hot. A row
    without an id is never a copy; a document is good or toxic if any of its
    labels says so.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("part", T.StringType()),
                           *[T.StructField(f, T.BooleanType()) for f in FILTERS[:4]],
                           T.StructField("_text", T.BinaryType())])

    def scan(batches):
        import hashlib

        import pyarrow as pa

        for b in batches:
            texts = [t or b"" for t in b.column(2).to_pylist()]
            fails = list(zip(*map(text_failures, texts))) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *[pa.array(list(f), pa.bool_()) for f in fails],
                 pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], names=schema.fieldNames())

    rows = checkpointed(docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.col(text_col).cast("binary").alias("_text")).mapInArrow(scan, schema))
    firsts = checkpointed(rows.filter("_id is not null").groupBy("_text").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    heavy = F.col("_n") > F.lit(rows.count() / HEAVY)
    known = rows.join(F.broadcast(firsts.filter(heavy).drop("_n")), "_text", "left")
    rest = known.filter("_first is null").drop("_first").join(firsts.filter(~heavy).drop("_n"), "_text", "left")
    copies = known.filter("_first is not null").unionByName(rest).withColumn(
        "E", F.coalesce(F.col("_id") > F.col("_first"), F.lit(False)))
    marks = labels.groupBy(F.col("doc_id").alias("_lid")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")).filter("good or toxic")
    return copies.join(marks, F.col("_id") == F.col("_lid"), "left").select(
        "part", *FILTERS, F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def posting_lists(rows: DataFrame, filters: Sequence[str], marks: Sequence[str], part_col: str = "part",
                  span: int = RANGE) -> DataFrame:
    """``(part, first, n, <filter>..., <mark>...)``: sorted row ids that fail, or bear a mark, per part and id range.

    Row ids are given where the rows lie and rise inside a partition, so
    lists come out sorted and in ranges of at most ``span`` ids without a
    shuffle. ``n`` counts the part's rows in the range, failing or not.
    """
    names = [*filters, *marks]
    schema = T.StructType([T.StructField(part_col, T.StringType()), T.StructField("first", T.LongType()),
                           T.StructField("n", T.LongType()),
                           *[T.StructField(f, T.ArrayType(T.LongType())) for f in names]])

    def lists(batches):
        import numpy as np
        import pyarrow as pa

        def flushed(chunks):
            table = pa.Table.from_batches(chunks)
            ids = table.column("_row").to_numpy()
            parts = table.column(part_col).combine_chunks().dictionary_encode()
            code = parts.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            edges = np.searchsorted(code[order], np.arange(len(parts.dictionary) + 1))
            set_ = {f: table.column(f).to_numpy()[order].astype(bool) for f in names}
            ids = ids[order]
            cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
            return pa.RecordBatch.from_arrays(
                [parts.dictionary, pa.array([int(ids[a]) for a, _ in cuts], pa.int64()),
                 pa.array([b - a for a, b in cuts], pa.int64()),
                 *[pa.array([ids[a:b][set_[f][a:b]] for a, b in cuts], pa.list_(pa.int64())) for f in names]],
                names=schema.fieldNames())

        waiting, held = [], 0
        for b in batches:
            while b.num_rows:
                take = b.slice(0, span - held)
                b = b.slice(take.num_rows)
                waiting.append(take)
                held += take.num_rows
                if held == span:
                    yield flushed(waiting)
                    waiting, held = [], 0
        if held:
            yield flushed(waiting)

    numbered = rows.select(F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias(part_col),
                           *[F.coalesce(F.col(f), F.lit(False)).alias(f) for f in names],
                           F.monotonically_increasing_id().alias("_row"))
    return numbered.mapInArrow(lists, schema)


def gallop(ids, among):
    """For ascending ``ids``: whether each is in the ascending list, and where it would stand.

    numpy keeps the lower bound of the search from key to key, so runs of
    one list are leapt over in a logarithm of steps.
    """
    import numpy as np

    at = np.searchsorted(among, ids)
    if not len(among):
        return np.zeros(len(ids), bool), at
    return among[np.minimum(at, len(among) - 1)] == ids, at


def union(lists):
    """Merge of sorted lists, each id once: the shorter ones gallop through the longest so far."""
    import numpy as np

    out, *others = sorted(lists, key=len, reverse=True)
    for ids in others:
        there, at = gallop(ids, out)
        out = np.insert(out, at[~there], ids[~there])
    return out


def interactions(fails, marks, n: int):
    """Counts for every filter and every set of filters before it, from one range's lists.

    Yields ``(seen, filter, kept, removed, redundant, lost...)``; ``seen`` is
    the set as bits. The union of a set extends the union of the set without
    its last filter.
    """
    import numpy as np

    size = len(fails)
    gone = [np.zeros(0, np.int64)]
    for seen in range(1, 1 << size):
        last = seen.bit_length() - 1
        gone.append(union([gone[seen & ~(1 << last)], fails[last]]))
    marked = [[ids[gallop(ids, m)[0]] for m in marks] for ids in fails]
    for f, ids in enumerate(fails):
        for seen in range(1 << size):
            if not seen >> f & 1:
                redundant = int(gallop(ids, gone[seen])[0].sum())
                lost = [len(m) - int(gallop(m, gone[seen])[0].sum()) for m in marked[f]]
                removed = len(ids) - redundant
                yield seen, f, n - len(gone[seen]) - removed, removed, redundant, *lost


def range_counts(postings: DataFrame, filters: Sequence[str], marks: Sequence[str], part_col: str = "part") -> DataFrame:
    """``(part, seen, filter, kept, removed, redundant, <mark>_lost...)``, summed over the ranges."""
    sums = ["kept", "removed", "redundant", *[f"{m}_lost" for m in marks]]
    schema = T.StructType([T.StructField(part_col, T.StringType()), T.StructField("seen", T.IntegerType()),
                           T.StructField("filter", T.IntegerType()), *[T.StructField(s, T.LongType()) for s in sums]])

    def merge(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for r in range(b.num_rows):
                ids = {f: b.column(f)[r].values.to_numpy() for f in [*filters, *marks]}
                part = b.column(part_col)[r].as_py()
                rows += [(part, *x) for x in interactions([ids[f] for f in filters], [ids[m] for m in marks],
                                                          b.column("n")[r].as_py())]
            cols = list(zip(*rows)) if rows else [()] * len(schema)
            kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * len(sums)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=schema.fieldNames())

    return postings.mapInArrow(merge, schema).groupBy(part_col, "seen", "filter").agg(*[F.sum(s).alias(s) for s in sums])


def audit(rows: DataFrame, filters: Sequence[str] = FILTERS, marks: Sequence[str] = ("good", "toxic"),
          part_col: str = "part") -> DataFrame:
    """What each filter does in every order of the filters, per part.

    ``rows`` has a boolean column per filter (true: the row fails) and per
    mark. Posting lists of failing rows are merged range by range; the sizes
    of unions and differences add up over the ranges, in counts per set of
    filters before a filter, not per order. The orders (all permutations; up
    to six filters) are then a small table joined to them.

    Returns part, ``filter_order``, ``step``, ``kept``, ``removed``,
    ``redundant``, ``unique_fails``, ``<mark>_lost``, ``shapley`` (the
    filter's removed summed over all orders): a row for every part, order
    and step, zeros included. Null flags are false, a null part is the empty
    string; repeated rows count each; an empty table gives no rows; other
    columns are ignored.
    """
    if not 1 <= len(filters) <= 6:
        raise ValueError("one to six filters")
    k, all_ = len(filters), (1 << len(filters)) - 1
    counts = range_counts(posting_lists(rows, filters, marks, part_col), filters, marks, part_col)
    before = F.bit_count("seen")
    orders = F.element_at(F.array(*[F.lit(factorial(b) * factorial(k - 1 - b)) for b in range(k)]), before.cast("int") + 1)
    same = Window.partitionBy(part_col, "filter")
    alone = F.col("seen") == F.lit(all_) - F.expr("shiftleft(1, filter)")
    counts = counts.withColumns({"unique_fails": F.max(F.when(alone, F.col("removed"))).over(same),
                                 "shapley": F.sum(orders.cast("long") * F.col("removed")).over(same)})
    steps = [("".join(filters[f] for f in p), s + 1, sum(1 << f for f in p[:s]), p[s])
             for p in permutations(range(k)) for s in range(k)]
    table = rows.sparkSession.createDataFrame(steps, "filter_order string, step int, seen int, filter int")
    return counts.join(F.broadcast(table), ["seen", "filter"]).select(
        part_col, "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
        *[f"{m}_lost" for m in marks], "shapley")


def op12_audit(spark, sf_dir: str) -> DataFrame:
    """Interaction of the five filters over all documents, per source."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(filtered(docs, labels))


OP12_SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
f as (select r, doc_id, part, len(w) < 200 as a, 100 * len(list_distinct(w)) < 50 * len(w) as b,
             100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) as c,
             regexp_matches(t, '[#$%&*|]') as d,
             coalesce(doc_id > min(doc_id) over (partition by t), false) as e from d),
g as (select f.*, coalesce(l.good, false) as good, coalesce(l.toxic, false) as toxic from f
      left join (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id) l
      using (doc_id)),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (select a.x || b.x || c.x || d.x || e.x as o from letters a, letters b, letters c, letters d, letters e
           where a.x not in (b.x, c.x, d.x, e.x) and b.x not in (c.x, d.x, e.x) and c.x not in (d.x, e.x) and d.x <> e.x),
steps as (select o, unnest(range(1, 6)) as step from orders),
fails as (select r, part, good, toxic, case when a then 'A' else '' end || case when b then 'B' else '' end ||
                 case when c then 'C' else '' end || case when d then 'D' else '' end ||
                 case when e then 'E' else '' end as bad from g),
kinds as (select part, bad, count(*) as n, sum(good::int) as good, sum(toxic::int) as toxic from fails group by part, bad),
each as (select part, o, step, o[step:step] as letter, bad, n, good, toxic, contains(bad, o[step:step]) as fails_it,
                translate(bad, o[1:step - 1], '') <> bad as before from kinds, steps),
sums as (select part, o as filter_order, step, any_value(letter) as letter,
                sum(case when not before and not fails_it then n else 0 end) as kept,
                sum(case when not before and fails_it then n else 0 end) as removed,
                sum(case when before and fails_it then n else 0 end) as redundant,
                sum(case when bad = letter then n else 0 end) as unique_fails,
                sum(case when not before and fails_it then good else 0 end) as good_lost,
                sum(case when not before and fails_it then toxic else 0 end) as toxic_lost
         from each group by part, o, step)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed,
       redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost,
       toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, letter))::bigint as shapley
from sums
"""
