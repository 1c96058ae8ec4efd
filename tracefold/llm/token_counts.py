"""Token counts by heap-and-list byte-pair merging (operator 13)."""

from __future__ import annotations

import heapq
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches

LIMIT = 2048                # tokens of a training sequence
REMEMBERED = 400_000        # words whose counts a Python worker remembers ...
REMEMBERED_BYTES = 80       # ... and the longest of them

# A word of ASCII letters and closing marks is one piece of letters and one of marks.
SIMPLE = re.compile(rb"([A-Za-z]*)([.,;:!?]*)")
# Before closing marks: what is and stays a letter or digit (the dotted capital i becomes two signs).
CLOSED = re.compile("[0-9A-Za-zÀ-ÖØ-öø-įı-ɏ]$")


def merges_made(symbols: list[str], ranks: dict) -> int:
    """How many merges byte-pair encoding makes in these symbols.

    The symbols are a linked list, the adjacent pairs that have a rank a
    heap of (rank, place): the lowest is popped, its right symbol leaves the
    list, and the two pairs beside the merged symbol are pushed. An entry
    whose symbols have changed since is passed over. Time n log n.
    """
    n = len(symbols)
    symbols, before, after = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(ranks[p], i, p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
    heapq.heapify(heap)
    made = 0
    while heap:
        _, at, pair = heapq.heappop(heap)
        right = after[at]
        if symbols[at] != pair[0] or right >= n or symbols[right] != pair[1]:
            continue
        made += 1
        symbols[at], symbols[right] = pair[0] + pair[1], None
        after[at] = beyond = after[right]
        if beyond < n:
            before[beyond] = at
            follows = (symbols[at], symbols[beyond])
            if follows in ranks:
                heapq.heappush(heap, (ranks[follows], at, follows))
        left = before[at]
        if left >= 0:
            leads = (symbols[left], symbols[at])
            if leads in ranks:
                heapq.heappush(heap, (ranks[leads], left, leads))
    return made


class Pieces(dict):
    """Tokens per piece (letters of the byte-level alphabet): initial symbols minus merges."""

    def __init__(self, model: dict):
        super().__init__()
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ", 1)): k for k, m in enumerate(model["merges"])}
        self.end = model.get("end_of_word_suffix") or ""

    def __missing__(self, piece: str) -> int:
        symbols = [*piece[:-1], piece[-1] + self.end]
        count = len(symbols) - merges_made(symbols, self.ranks)
        if len(piece) <= REMEMBERED_BYTES:
            self[piece] = count
        return count


class Words(dict):
    """Tokens per word (bytes without ASCII white space)."""

    def __init__(self, path: str):
        import tokenizers

        super().__init__()
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        model, added = described["model"], described["added_tokens"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix",
                                                                "byte_fallback", "ignore_merges")):
            raise ValueError("counts are defined for plain byte-pair models")
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added):
            raise ValueError("added tokens have to be matched as they stand")
        library = tokenizers.Tokenizer.from_file(path)
        self.normal, self.split = library.normalizer, library.pre_tokenizer
        self.pieces = Pieces(model)
        strings = sorted((a["content"].encode() for a in added), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, strings))) if strings else None

    def any(self, text: str) -> int:
        """Tokens of a text without added tokens, by the tokenizer's own normaliser and splits."""
        return sum(self.pieces[p] for p, _ in self.split.pre_tokenize_str(self.normal.normalize_str(text)))

    def __missing__(self, word: bytes) -> int:
        simple = SIMPLE.fullmatch(word)
        if simple:
            count = sum(self.pieces[p.decode().lower()] for p in simple.groups() if p)
        else:
            core = word.rstrip(b".,;:!?")
            text = core.decode("utf-8", "surrogatepass")
            if len(core) < len(word) and CLOSED.search(text):
                count = self[core] + self.pieces[word[len(core):].decode()]
            else:
                count = self.any(word.decode("utf-8", "surrogatepass"))
        if len(word) <= REMEMBERED_BYTES:
            if len(self) >= REMEMBERED:     # costs time, not results
                self.clear()
                self.pieces.clear()
            self[word] = count
        return count

    def count(self, text: bytes) -> int:
        """Tokens of a whole text; an added token's string is one token."""
        if self.added is None or not self.added.search(text):
            return sum(map(self.__getitem__, text.split()))
        between = self.added.split(text)
        return len(between) - 1 + sum(sum(map(self.__getitem__, part.split())) for part in between)


def counter(path: str) -> Words:
    """The worker's counter: a worker runs many tasks, so it hangs on a module."""
    import tokenizers

    memory = tokenizers.__dict__.setdefault("_tracefold_counts", {})
    if path not in memory:
        memory[path] = Words(path)
    return memory[path]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Number of tokens of every whole text, without making the tokens.

    The tokenizer (a byte-pair model whose splits never join across ASCII
    white space) normalises and splits a word that was not met before; its
    pieces are merged by rank in a heap over a linked list, and the count is
    the symbols minus the merges. Words are remembered by the Python worker.
    One pass, nothing is shuffled.

    Returns id, ``n_bytes`` (UTF-8), ``n_tokens`` (no begin, end or added
    tokens; the string of an added token in a text is one token, as in the
    library) and ``over_limit`` (more than ``limit``). Null texts count as
    empty: no bytes, no tokens; repeated rows are counted each; an empty
    table gives no rows; other columns are ignored. ``tokenizer_path`` has to
    be readable on every executor.
    """
    bounded_batches(docs.sparkSession)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def count(batches):
        import pyarrow as pa

        words = counter(tokenizer_path)
        for b in batches:
            texts = [t or b"" for t in b.column(1).to_pylist()]
            n = [words.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()),
                 pa.array([k > limit for k in n], pa.bool_())], names=schema.fieldNames())

    return docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(count, schema)


def tokenizer_file() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op13_tokens(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file())
