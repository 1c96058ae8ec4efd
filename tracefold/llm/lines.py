"""Quality rules with cross-document line frequency (operator 10, native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, checkpointed, let, when_small

MIN_WORDS = 50              # fixed by the contract
MAX_REPEATED = 50           # percent of words in repeated windows, fixed by the contract
WINDOW = 3                  # words
LINE_DOCS = 10              # a line in more distinct documents of its host than this ...
LINE_SHARE = 0.10           # ... and than this share of them is above the limit,
LINE_MANY = 100             # and so is one in more distinct documents than this, whatever the share, ...
LINE_WORDS = 3              # ... if it has as many words as this or more
DEPLETED = 0.5              # removed share of words from which a document is depleted; so is one left with under MIN_WORDS
BROADCAST_ROWS = 50_000     # frequent lines that may be broadcast (two keys each, some MB)


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the text.

    Windows are hashed and packed with their place into one number each, so
    one sort of plain numbers brings equal windows together; places whose
    packed hash meets another are checked again on the full 64-bit hash.
    Grows as n log n with the text.
    """
    place = lambda x, n: F.pmod(x, n)

    def same_beside(a: Column, key) -> Column:
        """Elements of a sorted array whose key equals a neighbour's."""
        return F.filter(a, lambda x, i: ((i > 0) & (key(F.get(a, i - 1)) == key(x)))
                        | ((i < F.size(a) - 1) & (key(F.get(a, i + 1)) == key(x))))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-10).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(places, start, lambda acc, p: F.struct(
            p.alias("last"), (acc["n"] + F.least(p - acc["last"], F.lit(WINDOW).cast("long"))).alias("n")),
            lambda acc: acc["n"])

    def of_hashes(h: Column) -> Column:
        n = F.size(h).cast("long")
        room = F.floor(F.lit(float(2**62)) / n).cast("long")
        packed = F.array_sort(F.transform(h, lambda x, i: F.pmod(x, room) * n + i))
        low = let(packed, lambda a: same_beside(a, lambda x: x - place(x, n)))
        full = F.array_sort(F.transform(low, lambda x: F.struct(
            F.get(h, place(x, n).cast("int")).alias("h"), place(x, n).alias("p"))))
        sure = let(full, lambda a: same_beside(a, lambda x: x["h"]))
        return covered(F.array_sort(F.transform(sure, lambda x: x["p"])))

    def of_words(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW),
                             lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, of_hashes))

    return of_words(words)


def normal_line(line: Column) -> Column:
    """Lower case, single blanks, digits as one sign: what counts as the same line."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(line, SPACE, " "))), "[0-9]+", "0")


def base_metrics(text: Column) -> Column:
    """The per-document figures and its lines (hash and words), from one array of words and one of lines."""
    text = F.coalesce(text, F.lit(""))

    def of(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))

    def of_lines(ls: Column) -> Column:
        return F.struct((F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                        F.transform(ls, lambda x: F.xxhash64(normal_line(x))).alias("lines"),
                        F.transform(ls, lambda x: F.regexp_count(x, F.lit(WORD))).alias("line_words"))

    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of).alias("w"),
                    let(lines, of_lines).alias("l"),
                    F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
                    (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"))


def frequent_lines(rows: DataFrame) -> DataFrame:
    """``(_host, _line)`` above the limits, from rows ``(_host, _hash, lines, line_words)``.

    In a small host the share decides; in a large one ``LINE_MANY``
    documents suffice, for a share grows with the host and lets its
    boilerplate stand. Documents count once per distinct text, so exact
    copies do not make their own lines frequent. The distinct count first
    spreads by line and text, so a line that a third of all documents share
    is counted in parts.
    """
    long = F.transform("line_words", lambda n: n >= LINE_WORDS)
    each = (rows.select("_host", "_hash", F.explode(F.array_distinct(F.arrays_zip(F.col("lines"), long.alias("long")))).alias("_l"))
            .select("_host", "_hash", F.col("_l.lines").alias("_line"), F.col("_l.long").alias("_long")))
    counts = (each.groupBy("_host", "_line", "_long").agg(F.count_distinct("_hash").alias("_n"))
              .filter(F.col("_n") > LINE_DOCS))
    hosts = rows.groupBy("_host").agg(F.count_distinct("_hash").alias("_docs"))
    return (counts.join(hosts, counts["_host"].eqNullSafe(hosts["_host"]))
            .filter((F.col("_n") > LINE_SHARE * F.col("_docs")) | (F.col("_long") & (F.col("_n") > LINE_MANY)))
            .select(counts["_host"], "_line"))


def line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               host_col: str = "source") -> DataFrame:
    """Base figures, words in frequent lines and the verdict of every document.

    A first pass over the texts keeps figures and line hashes only. Lines in
    more than ten distinct documents and a tenth of their host's distinct
    documents are removed, and so are lines of three or more words in over
    a hundred of them; a document that loses half of its words or more, or
    keeps fewer than the base rules ask for, is depleted and rejected, as is
    one that fails the base rules.

    Returns id, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``kept``, ``removed_words``. Null
    and empty texts have no words and fail; documents without a host form
    one host; repeated rows are judged each and count as one document; an
    empty table gives no rows; other columns are ignored.
    """
    rows = checkpointed(_figures(docs, id_col, text_col, host_col))
    return _judged(rows, frequent_lines(rows)).select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "removed_words")


def _figures(docs, id_col, text_col, host_col) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.col(host_col).cast("string").alias("_host"),
                       F.xxhash64(text_col).alias("_hash"), base_metrics(F.col(text_col)).alias("_m")).select(
        F.monotonically_increasing_id().alias("_row"), "_id", "_host", "_hash", "_m.w.*", "_m.word_chars",
        "_m.n_symbols", "_m.l.*")


def _judged(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    each = rows.select("_row", "_host", F.explode(F.arrays_zip("lines", "line_words")).alias("_l")).select(
        "_row", "_host", F.col("_l.lines").alias("_line"), F.col("_l.line_words").alias("_w"))
    frequent = when_small(checkpointed(frequent.select(F.col("_host").alias("_fh"), F.col("_line").alias("_fl"))),
                          BROADCAST_ROWS)
    removed = (each.join(frequent, (F.col("_line") == F.col("_fl")) & F.col("_host").eqNullSafe(F.col("_fh")), "left_semi")
               .groupBy("_row").agg(F.sum("_w").cast("long").alias("_removed"),
                                    F.collect_set("_line").alias("removed_lines")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return (rows.join(removed, "_row", "left").withColumn("removed_words", F.coalesce("_removed", F.lit(0).cast("long")))
            .withColumn("base_failed", failed)
            .withColumn("kept", ~failed & (F.col("removed_words") < DEPLETED * F.col("n_words"))
                        & (F.col("n_words") - F.col("removed_words") >= MIN_WORDS)))


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    host_col: str = "source") -> DataFrame:
    """The kept documents without their frequent lines; columns as they were.

    The lines to remove come back by id and text hash; nulls compare equal.
    Repeated rows are kept or rejected together; null and empty texts are
    rejected; an empty table gives no rows.
    """
    rows = checkpointed(_figures(docs, id_col, text_col, host_col))
    verdict = (_judged(rows, frequent_lines(rows)).filter("kept")
               .select(F.col("_id").alias("_tf_id"), F.col("_hash").alias("_tf_hash"),
                       F.coalesce("removed_lines", F.array().cast("array<bigint>")).alias("_tf_drop"))
               .dropDuplicates(["_tf_id", "_tf_hash"]))
    kept = F.filter(F.split(F.col(text_col), "\n", -1),
                    lambda x: ~F.array_contains(F.col("_tf_drop"), F.xxhash64(normal_line(x))))
    return (docs.join(verdict, F.col(id_col).eqNullSafe(F.col("_tf_id")) & (F.xxhash64(text_col) == F.col("_tf_hash")))
            .withColumn(text_col, F.when(F.size("_tf_drop") > 0, F.array_join(kept, "\n")).otherwise(F.col(text_col)))
            .select(*docs.columns))


def op10_lines(spark, sf_dir: str) -> DataFrame:
    """Quality rules over all documents; sources are the hosts."""
    return line_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
words as (select r, unnest(w) as word, unnest(range(len(w))) as i from d),
triples as (select r, i, word as a, lead(word) over p as b, lead(word, 2) over p as c from words
            window p as (partition by r order by i)),
again as (select r, i, (c is not null and count(*) over (partition by r, a, b, c) > 1)::int as hit from triples),
covered as (select r, greatest(hit, coalesce(lag(hit) over p, 0), coalesce(lag(hit, 2) over p, 0)) as hit from again
            window p as (partition by r order by i)),
repeats as (select r, sum(hit) as n from covered group by r),
ls as (select r, source, t, unnest(string_split(t, chr(10))) as line from d),
l as (select r, source, t, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as words,
             regexp_replace(lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))), '[0-9]+', '0', 'g') as norm
      from ls where regexp_matches(line, '[^\x20\x09-\x0D]')),
dups as (select r, count(*) - count(distinct line) as n from l group by r),
hosts as (select source, count(distinct t) as docs from d group by source),
often as (select l.source, l.norm from (select source, norm, any_value(words) as words, count(distinct t) as n from l
                                        group by source, norm) l
          join hosts h on l.source is not distinct from h.source
          where l.n > 10 and (l.n > 0.10::double * h.docs or (l.words >= 3 and l.n > 100))),
removed as (select l.r, sum(l.words) as n from l join often o on l.source is not distinct from o.source and l.norm = o.norm
            group by l.r),
m as (select d.doc_id, len(d.w)::bigint as n_words, length(regexp_replace(d.t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
             (length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
             coalesce(dups.n, 0)::bigint as n_dup_lines, coalesce(repeats.n, 0)::bigint as n_repeat_words,
             coalesce(removed.n, 0)::bigint as removed_words
      from d left join dups using (r) left join repeats using (r) left join removed using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
       (not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and removed_words < 0.5::double * n_words
        and n_words - removed_words >= 50) as kept,
       removed_words
from m
"""
