"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

# White space of the contracts: space and the controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

# Arrow batches hold whole texts: bounded by bytes, not only by rows, so a
# batch of very long documents does not fill a Python worker.
BATCH_BYTES = 16 * 1024 * 1024
BATCH_ROWS = 2048


def bounded_batches(spark: SparkSession) -> None:
    """Lowers (never raises) the Arrow batch limits of the session."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
                      ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(key, str(2**31 - 1)) or 0)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable copy in the shared checkpoint folder; keeps partitions and their order."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_table(df: DataFrame) -> DataFrame:
    """Compressed copy as a table in the shared checkpoint folder, gone when the session ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


SHORT = 1024            # elements that are joined one by one


def running_join(values: Column, join) -> Column:
    """Inclusive running ``join`` (sum, greatest) of an array of longs, in time close to its length.

    An array that grows element by element is copied each time, so only
    blocks of ``SHORT`` elements are built so; their last values are joined
    the same way and carried into the blocks behind.
    """
    last = lambda a: F.get(a, F.size(a) - 1)

    def one_by_one(a: Column) -> Column:
        return F.aggregate(a, F.array().cast("array<bigint>"), lambda done, x: F.array_append(
            done, F.when(F.size(done) == 0, x).otherwise(join(last(done), x))))

    def carried(blocks: Column) -> Column:
        return let(one_by_one(F.transform(blocks, last)), lambda upto: F.flatten(F.transform(
            blocks, lambda b, k: F.when(k == 0, b).otherwise(F.transform(b, lambda x: join(F.get(upto, k - 1), x))))))

    def by_size(a: Column) -> Column:
        n_blocks = F.greatest(F.ceil(F.size(a) / SHORT).cast("int"), F.lit(1))
        blocks = F.transform(F.sequence(F.lit(0), n_blocks - 1),
                             lambda k: one_by_one(F.slice(a, k * SHORT + 1, F.lit(SHORT))))
        return let(blocks, carried)

    return let(values, by_size)


def running_totals(df: DataFrame, order: Sequence[str], sums: Sequence[str]) -> tuple[DataFrame, dict]:
    """Global position and exclusive running sums of whole columns in ``order``.

    Rows are dealt by range (the order should end in a column that splits
    ties, so that no range is forced into one task), sorted inside their
    partition and checkpointed once. The only thing the driver sees is one
    row of totals per partition. Adds ``_index`` and ``_start_<sum>``; the
    second result holds the grand totals by name.
    """
    import numpy as np
    import pyarrow as pa

    spark = df.sparkSession
    bounded_batches(spark)
    dealt = checkpointed(df.repartitionByRange(shuffle_partitions(spark), *order)
                         .sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id()))
    totals = sorted(dealt.groupBy("_pid").agg(F.count(F.lit(1)).alias("_index"),
                                              *[F.sum(c).alias(c) for c in sums]).collect())
    names, grand, before = ["_index", *sums], dict.fromkeys(["_index", *sums], 0), {}
    for row in totals:
        before[row["_pid"]] = [grand[n] for n in names]
        for n in names:
            grand[n] += int(row[n] or 0)
    fields = [*df.schema.fields, T.StructField("_index", T.LongType()),
              *[T.StructField(f"_start_{c}", T.LongType()) for c in sums]]

    def place(batches):
        run = None
        for b in batches:
            if not b.num_rows:
                continue
            if run is None:
                run = list(before[b.column("_pid")[0].as_py()])
            cols = [b.column(f.name) for f in fields[:-len(names)]]
            for k, name in enumerate(names):
                size = (np.ones(b.num_rows, dtype=np.int64) if k == 0 else
                        b.column(name).to_numpy(zero_copy_only=False).astype(np.int64))
                ends = np.cumsum(size)
                cols.append(pa.array(run[k] + ends - size))
                run[k] += int(ends[-1])
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return dealt.mapInArrow(place, T.StructType(fields)), grand


def when_small(df: DataFrame, rows: int) -> DataFrame:
    """A checkpointed table of slim rows, marked for broadcast only if it was counted to be small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
