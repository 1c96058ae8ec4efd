"""Fill-in-middle transformation over a Fenwick tree of text blocks (operator 11)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches

BLOCK = 4096            # code points in a block
SEED = 1
PLAIN_FROM = 90         # of a hundred: documents from here on stay plain
SPM_BELOW = 20          # of a hundred: suffix first
# Fixed values of the contract: signs before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FORMS = ("plain", "psm", "spm")


def unit_starts(block: str, after_letter: bool):
    """Places in a block where a unit (a run of A-Z and a-z, or one other sign) starts."""
    import numpy as np

    signs = np.frombuffer(block.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = ((signs | 32) - np.uint32(97)) < 26
    goes_on = np.empty(len(letter), bool)
    goes_on[:1] = after_letter
    goes_on[1:] = letter[:-1]
    return np.flatnonzero(~(letter & goes_on))


class BlockTree:
    """Fenwick tree over the blocks of a text: units that start in them and their code points.

    A run of letters over a block's end counts where it starts. The tree
    holds two numbers per block; finding a unit takes a logarithm of steps
    and a look into one block.
    """

    def __init__(self, text: str, block: int = BLOCK):
        self.text, self.block = text, block
        self.units, self.points = [0], [0]
        for at in range(0, len(text), block):
            self.units.append(len(self._starts(at)))
            self.points.append(min(block, len(text) - at))
        self.n = sum(self.units)
        self.blocks = len(self.units) - 1
        for i in range(1, self.blocks + 1):
            above = i + (i & -i)
            if above <= self.blocks:
                self.units[above] += self.units[i]
                self.points[above] += self.points[i]

    def _starts(self, at: int):
        before = self.text[at - 1:at] if at else ""
        return unit_starts(self.text[at:at + self.block], before.isascii() and before.isalpha())

    def offset(self, units: int) -> int:
        """Code points before the unit with this number (all of them for ``n``)."""
        at, left, points = 0, units, 0
        step = 1 << self.blocks.bit_length() >> 1
        while step:
            to = at + step
            if to <= self.blocks and self.units[to] <= left:
                at, left, points = to, left - self.units[to], points + self.points[to]
            step >>= 1
        return points if at == self.blocks else points + int(self._starts(points)[left])


def draws(doc_id, seed: int = SEED) -> list[int]:
    """Four 32-bit numbers from the seed and the id (a null id as no digits)."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[8 * k:8 * k + 8], 16) for k in range(4)]


def transformed(text: str | None, doc_id, seed: int = SEED, block: int = BLOCK):
    """``(units, form, prefix length, middle length, output)`` of one document."""
    text = text or ""
    tree = BlockTree(text, block)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= PLAIN_FROM or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return tree.n, "plain", None, None, text
    a, b = (tree.offset(k) for k in sorted((h1 % (tree.n + 1), h2 % (tree.n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM_BELOW:
        return tree.n, "spm", a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return tree.n, "psm", a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form alone.

    A sign has its ``<`` only at its start, so it can't begin in a part and
    end in the sign behind it: the first sign found is the one put there.
    """
    part = lambda k: F.get(F.split(output, "<[PSM]>", -1), k)
    return (F.when(form == "psm", F.concat(part(1), part(3), part(2)))
            .when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
                   block: int = BLOCK) -> DataFrame:
    """Every document with prefix, middle and suffix set apart at unit boundaries.

    A unit is a run of ASCII letters or one other code point. Both cuts and
    the form are drawn from a hash of seed and id, so reruns agree. Blocks of
    ``block`` code points are counted one after the other and a cut is found
    by descent in a Fenwick tree, so a text of any length takes its own size
    and a few numbers per block; nothing is shuffled.

    Returns id, ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars``
    (code points; null if plain) and ``output``. Null texts count as empty;
    empty texts and texts that hold a sign stay plain; a null id draws as no
    digits; rows of one id are cut at the same numbers, each in its own text;
    an empty table gives no rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n", T.LongType()),
                           T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
                           T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])

    def cut(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for b in batches:
            rows = [transformed(t, i, seed, block) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            cols = zip(*rows) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(list(c), k) for c, k in zip(cols, kinds)]],
                                             names=schema.fieldNames())

    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def op11_infill(spark, sf_dir: str) -> DataFrame:
    """All documents cut, with checksums of the output and of the text rebuilt from it."""
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP11_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as h,
                  regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u from documents),
draws as (select *, len(u)::bigint as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
                 ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
cuts as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
                case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90
                     then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from draws),
parts as (select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m,
                 array_to_string(u[b + 1:n], '') as s from cuts)
select doc_id, n, form, case when form <> 'plain' then length(p)::bigint end as prefix_chars,
       case when form <> 'plain' then length(m)::bigint end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
              else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(t) as restored_sha256
from parts
"""
