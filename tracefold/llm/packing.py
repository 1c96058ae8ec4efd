"""Sequence packing along a space-filling curve (operator 2)."""

from __future__ import annotations

import re
from array import array

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, running_totals, scratch_table

SEQUENCE = 2048     # ids in a sequence
END_ID = 1          # closes every document
DIMS = 4            # coordinates on the curve
BITS = 12           # of each coordinate
FEATURES = 512      # buckets of the hashed document vector
CACHE_PIECES = 500_000      # pieces whose ids a Python worker remembers
SLICE_BYTES = 8 * 1024 * 1024   # text that is looked up at once
CALL_PIECES = 16_384        # new pieces in one call of the tokenizer

# Texts with a special token's string, or with a character that Python takes for white space and the tokenizer does not.
WHOLE = "<\\||[\x1c-\x1f]"
# Words whose lower case is the same letter by letter here and in the tokenizer.
LATIN = "^[\x21-\x7e\xa1-\u012f\u0131-\u024f]+$"
# Lower-case letters alone: one piece, nothing to normalise.
LETTERS = "^[a-z\xdf-\xf6\xf8-\xff]+$"
# A run of these after a letter or digit is a piece of its own.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Pieces:
    """Ids of pieces of text, remembered in Arrow arrays; the half seen last stays when they are full."""

    def __init__(self, path: str):
        import numpy as np
        import pyarrow as pa
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        level = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0x61, 0x100)
                         if re.match(LETTERS, chr(c))}
        self.letters = tokenizers.Tokenizer(self.tokenizer.model)    # normalised and split already
        self.letters.pre_tokenizer = tokenizers.pre_tokenizers.WhitespaceSplit()
        self.closes = np.zeros(1 << 16, dtype=bool)     # ids that end a piece
        suffix = self.tokenizer.model.end_of_word_suffix
        self.closes[[i for t, i in self.tokenizer.get_vocab().items() if suffix and t.endswith(suffix)]] = True
        self.known, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())
        self.seen, self.calls = np.zeros(0, dtype=np.int64), 0

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def add(self, new) -> None:
        """Encodes pieces that are not known yet."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        plain = pc.match_substring_regex(new, LETTERS)
        new = pa.concat_arrays([new.filter(plain), new.filter(pc.invert(plain))])
        n_plain, ids, sizes = pc.sum(plain).as_py() or 0, [], []
        for at in range(0, n_plain, CALL_PIECES):
            some = new[at:min(at + CALL_PIECES, n_plain)].to_pylist()
            found = self.letters.encode_batch_fast([" ".join(some).translate(self.as_bytes)],
                                                   add_special_tokens=False)[0]
            ids.append(np.array(found.ids, dtype="<u2"))
            last = np.flatnonzero(self.closes[ids[-1]])
            if len(last) != len(some) or last[-1] + 1 != len(ids[-1]):
                raise ValueError("a tokenizer whose words do not end in ids of their own")
            sizes.append(np.diff(last, prepend=-1))
        for piece in new[n_plain:].to_pylist():
            ids.append(np.array(self.encode(piece), dtype="<u2"))
            sizes.append([len(ids[-1])])
        ends = np.cumsum(np.concatenate([[0], *sizes]).astype(np.int64)) * 2
        data = np.concatenate([np.zeros(0, dtype="<u2"), *ids])
        self.known = pa.concat_arrays([self.known, new])
        self.ids = pa.concat_arrays([self.ids, binary(ends, pa.py_buffer(data))])
        self.seen = np.concatenate([self.seen, np.zeros(len(new), dtype=np.int64)])

    def of(self, pieces):
        """Ids of distinct pieces, as little-endian 16-bit bytes."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        at = pc.index_in(pieces, value_set=self.known)
        if at.null_count:
            missing = at.is_null()
            self.add(pieces.filter(missing))
            fresh = pc.index_in(pieces.filter(missing), value_set=self.known[len(self.known) - at.null_count:])
            at = pc.replace_with_mask(at, missing, pc.add(fresh, pa.scalar(len(self.known) - at.null_count, pa.int32())))
        ids = self.ids.take(at)
        self.calls += 1
        self.seen[at.to_numpy()] = self.calls
        if len(self.known) > CACHE_PIECES:
            keep = pa.array(np.argsort(self.seen, kind="stable")[-(CACHE_PIECES // 2):])
            self.known, self.ids = self.known.take(keep), self.ids.take(keep)
            self.seen = self.seen[keep.to_numpy()]
        return ids


def binary(ends, data):
    """Binary array of the stretches of ``data`` between successive ``ends``."""
    import numpy as np
    import pyarrow as pa

    ends = np.ascontiguousarray(ends, dtype=np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), data])


def offsets(array):
    """Offsets of a string, binary or list array that is no slice."""
    import numpy as np

    wide = str(array.type).startswith("large")
    return np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32)[:len(array) + 1]


class WordEncoder:
    """Token ids of texts as little-endian 16-bit bytes.

    The tokenizer drops white space and never joins across it, so a text is
    encoded as its words. It lower-cases, and ASCII marks behind a letter or
    digit are a piece of their own, so a word is looked up by its
    lower-cased core and its closing marks. Each distinct word of a slice of
    texts is looked up once. Pieces are remembered as long as the Python
    worker lives (up to a number; what is forgotten costs time, not
    results). Texts that hold a special token's string or an odd control
    character are encoded whole.
    """

    def __init__(self, path: str):
        import tokenizers

        # a worker runs many tasks: the memory hangs on a module, not on this task's copy of the class
        memory = tokenizers.__dict__.setdefault("_tracefold_memory", {})
        if path not in memory:
            memory[path] = Pieces(path)
        self.pieces = memory[path]

    def words(self, words):
        """Ids of distinct words."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        latin = pc.match_substring_regex(words, LATIN)
        words = pc.if_else(latin, pc.utf8_lower(words), words)
        core = pc.utf8_rtrim(words, MARKS)
        cut = pc.and_(latin, pc.match_substring_regex(core, r"[\p{L}\p{N}]$"))
        at = offsets(words)
        cuts = np.empty(2 * len(words) + 1, dtype=np.int32)     # core, marks, core, marks ...
        cuts[::2] = at
        cuts[1::2] = at[:-1] + pc.binary_length(pc.if_else(cut, core, words)).to_numpy()
        parts = pa.StringArray.from_buffers(2 * len(words), pa.py_buffer(cuts), words.buffers()[2]).dictionary_encode()
        ids = self.pieces.of(parts.dictionary).take(parts.indices)
        return binary(offsets(ids)[::2], ids.buffers()[2])

    def texts(self, texts) -> list[bytes]:
        """Ids of each text of an Arrow array; none for a null text."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.string()), "")
        whole = pc.match_substring_regex(texts, WHOLE)
        lists = pc.utf8_split_whitespace(pc.if_else(whole, "", texts))
        found = lists.values.dictionary_encode()
        ids = self.words(found.dictionary).take(found.indices)
        data, ends = ids.buffers()[2], offsets(ids)[offsets(lists)]
        rows = [data[a:b].to_pybytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        for k in pc.indices_nonzero(whole).to_pylist():
            rows[k] = array("H", self.pieces.encode(texts[k].as_py())).tobytes()
        return rows

    def text(self, text: str) -> bytes:
        import pyarrow as pa

        return self.texts(pa.array([text], pa.string()))[0]


def slices(batch, column: int):
    """Consecutive rows of an Arrow batch, ``SLICE_BYTES`` of text and one text more at most."""
    import numpy as np
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
    slot = np.cumsum(size) // SLICE_BYTES
    starts = np.flatnonzero(np.diff(slot, prepend=-1)).tolist()
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(a, b - a)


def projection():
    """Fixed signs and directions: hashed token counts to ``DIMS`` coordinates, per token id."""
    import numpy as np

    rng = np.random.default_rng(2048)
    bucket = rng.integers(0, FEATURES, 1 << 16)
    sign = rng.choice([-1.0, 1.0], 1 << 16)
    return bucket, sign, rng.standard_normal((FEATURES, DIMS))


def hilbert_key(cells):
    """Hilbert index of integer points (rows of ``DIMS`` cells of ``BITS`` bits).

    Skilling's transform (AIP Conf. Proc. 707, 2004), on all rows at once.
    """
    import numpy as np

    x = [cells[:, k].astype(np.int64).copy() for k in range(DIMS)]
    q = 1 << (BITS - 1)
    while q > 1:
        p = q - 1
        for k in range(DIMS):
            high = (x[k] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[k]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[k] = x[k] ^ swap if k else x[k]
        q >>= 1
    for k in range(1, DIMS):
        x[k] ^= x[k - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (BITS - 1)
    while q > 1:
        flip ^= np.where((x[DIMS - 1] & q) != 0, q - 1, 0)
        q >>= 1
    key = np.zeros_like(x[0])
    for bit in range(BITS - 1, -1, -1):
        for k in range(DIMS):
            key = (key << 1) | (((x[k] ^ flip) >> bit) & 1)
    return key


def tokenised(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str) -> DataFrame:
    """Scratch table: row number, id, ids with the closing id, curve coordinates."""
    fields = [T.StructField("_id", docs.schema[id_col].dataType), T.StructField("_n", T.LongType()),
              T.StructField("_ids", T.BinaryType()),
              *[T.StructField(f"_c{k}", T.DoubleType()) for k in range(DIMS)]]

    def encode(batches):
        import numpy as np
        import pyarrow as pa

        encoder, (bucket, sign, directions) = WordEncoder(tokenizer_path), projection()
        end = END_ID.to_bytes(2, "little")
        for b in (part for whole in batches for part in slices(whole, 1)):
            ids = [raw + end for raw in encoder.texts(b.column(1))]
            hashed = np.zeros((len(ids), FEATURES))
            for r, raw in enumerate(ids):
                tokens = np.frombuffer(raw, "<u2")[:-1]
                hashed[r] = np.bincount(bucket[tokens], sign[tokens], FEATURES)
            hashed = np.sign(hashed) * np.log1p(np.abs(hashed))
            length = np.sqrt((hashed * hashed).sum(axis=1, keepdims=True))
            at = hashed / np.where(length > 0, length, 1) @ directions
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                 *[pa.array(at[:, k]) for k in range(DIMS)]], names=[f.name for f in fields])

    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return scratch_table(slim.mapInArrow(encode, T.StructType(fields))
                         .withColumn("_row", F.monotonically_increasing_id()))


def curve_keys(table: DataFrame) -> DataFrame:
    """Rows with their place on the curve; coordinates are spread by their own mean and deviation."""
    spread = table.agg(*[f(f"_c{k}").alias(f"{n}{k}") for k in range(DIMS)
                         for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = [round(spread[f"m{k}"] or 0.0, 6) for k in range(DIMS)]
    dev = [round(spread[f"s{k}"] or 0.0, 6) or 1.0 for k in range(DIMS)]

    @F.pandas_udf("long")
    def key(c: pd.DataFrame) -> pd.Series:
        import numpy as np

        z = (c.to_numpy() - mean) / dev
        share = 1 / (1 + np.exp(-1.702 * np.clip(z, -8, 8)))     # close to the normal distribution function
        return pd.Series(hilbert_key(np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)))

    return table.select("_row", "_n", key(F.struct(*[f"_c{k}" for k in range(DIMS)])).alias("_key"))


def pack_along_curve(docs: DataFrame, tokenizer_path: str, length: int = SEQUENCE,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs documents into sequences of ``length`` ids, neighbours on a Hilbert curve together.

    Documents become ids once (a compressed table in the shared folder);
    their hashed count vectors are projected to a few dimensions and the
    documents are sorted by range along the Hilbert curve through them, ties
    by row number. Running totals give each document's place in the one long
    row of ids, which is cut every ``length`` ids: only the very last
    sequence needs padding. Only slim rows are sorted; the ids are joined
    back by row number.

    Returns a row per piece: id, ``start``, ``length``, ``ids`` (little-endian
    unsigned 32-bit), ``doc_tokens``, ``sequence_id``, ``offset``. A null or
    empty text is its closing id alone; documents longer than a sequence
    become several pieces; repeated rows and rows without an id are documents
    of their own; an empty table gives no rows; other columns are ignored.
    """
    table = tokenised(docs, tokenizer_path, id_col, text_col)
    placed, _ = running_totals(curve_keys(table), ["_key", "_row"], ["_n"])
    joined = table.select("_row", "_id", "_ids").join(placed.select("_row", "_start__n"), "_row")
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("start", T.LongType()),
              T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
              T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
              T.StructField("offset", T.LongType())]

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            ids, rows = b.column("_ids"), []
            for r, place in enumerate(b.column("_start__n").to_pylist()):
                tokens = np.frombuffer(ids[r].as_py(), "<u2").astype("<u4")
                at, n = 0, len(tokens)
                while at < n:
                    sequence, offset = divmod(place + at, length)
                    size = min(length - offset, n - at)
                    rows.append((r, at, size, tokens[at:at + size].tobytes(), n, sequence, offset))
                    at += size
            if rows:
                which, *rest = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column("_id").take(pa.array(which)),
                     *[pa.array(c, pa.binary() if k == 2 else pa.int64()) for k, c in enumerate(rest)]],
                    names=[f.name for f in fields])

    return joined.select("_id", "_ids", "_start__n").mapInArrow(cut, T.StructType(fields))


def sequences(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per sequence: its ids in order (a sequence is bounded by its length) and its documents."""
    part = F.struct("offset", "length", "ids", id_col)
    ordered = F.sort_array(F.collect_list(part))
    return pieces.groupBy("sequence_id").agg(ordered.alias("_p")).select(
        "sequence_id", F.aggregate("_p", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
        F.transform("_p", lambda p: F.struct(p[id_col].alias(id_col), p["offset"].alias("offset"),
                                             p["length"].alias("length"))).alias("documents"))


def tokenizer_file() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op2_pack(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids; the ids as a checksum."""
    pieces = pack_along_curve(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")
