"""Contiguous balanced shards by global byte-size prefix sums (operator 9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running_totals


def content_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus eight for the id."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(8)


def balanced_shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Cuts the documents into contiguous shards of equal bytes.

    The documents stand in one global order: content hash, id. Equal texts
    are therefore neighbours, and a group of copies is parted only where a
    cut falls inside it. Bytes before a document come from per-partition
    totals plus the running sum inside its partition; a document goes to the
    shard in whose range its middle byte lies, so a shard's size is within
    one document of the target. Texts themselves are read once and never
    shuffled.

    Returns id, ``size``, ``text_crc32``, ``shard`` (0 to n-1) and ``slot``
    (gapless from 0 in a shard). Null text counts no bytes and has the
    checksum of the empty text; null ids sort first; repeated rows are rows
    of their own; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash"),
                       content_size(F.col(text_col)).alias("_size"),
                       F.crc32(text.cast("binary")).alias("_crc"))
    placed, total = running_totals(slim, ["_hash", "_id", "_size", "_crc"], ["_size"])
    # twice the cut points, in whole numbers: the middle of a document is (2 start + size) / 2
    cuts = [2 * total["_size"] * k // n_shards for k in range(1, n_shards)]
    middle = 2 * F.col("_start__size") + F.col("_size")
    shard = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= middle)) if cuts else F.lit(0)
    cut = placed.select("_id", "_size", "_crc", "_index", shard.cast("int").alias("_shard"))
    first = {r["_shard"]: r["_first"]
             for r in cut.groupBy("_shard").agg(F.min("_index").alias("_first")).collect()}  # n_shards rows
    start = F.lit(0).cast("long")
    for k, v in first.items():
        start = F.when(F.col("_shard") == k, F.lit(v).cast("long")).otherwise(start)
    return cut.select(F.col("_id").alias(id_col), F.col("_size").alias("size"),
                      F.col("_crc").alias("text_crc32"), F.col("_shard").alias("shard"),
                      (F.col("_index") - start).alias("slot"))


def write_shards(docs: DataFrame, shards: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Writes the documents as ``shard=k`` folders, in slot order inside a shard.

    Joined on the id, so ids have to be unique here; each shard may be
    written by several tasks, each holding a contiguous range of slots.
    """
    (docs.join(shards.select(id_col, "shard", "slot"), id_col)
     .repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))


N_SHARDS = 24


def op9_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return balanced_shards(docs, N_SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
