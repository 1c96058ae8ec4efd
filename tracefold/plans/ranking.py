"""Global rank and running sum without a single-partition window.

``row_number() OVER (ORDER BY ...)`` and running sums over a whole table
put every row in one task. Variant tables can be as large as the case
table (every order its own variant), so ranks here are computed the
distributed way:

1. range-partition the table on the order (sampled boundaries, so equal
   work per task), sort each partition and tag each row with its partition
   id and its place in the partition;
2. sum inside each partition, if running sums are asked for; ranks alone
   need no second shuffle, the place in the sorted partition is the rank;
3. per-partition totals are one row per partition: a window over that
   tiny table gives each partition its offset; it is broadcast (its size is
   the partition count, fixed by configuration) and added back.

Steps 2 and 3 must see the same partition of every row. The range bounds
come from sampling, and the sample depends on the order rows arrive from
the previous shuffle, so the partitioned table is materialised once with a
reliable ``checkpoint()`` (in the session's checkpoint folder) and both
steps read that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Fixed value: the lower 33 bits of monotonically_increasing_id count the rows of a partition.
ROWS_OF_PARTITION = (1 << 33) - 1


def global_rank_sum(df: DataFrame, order: Sequence[Column], sums: dict[str, Column] | None = None,
                    rank_name: str = "rank0", num_partitions: int | None = None,
                    totals: bool = False) -> DataFrame:
    """Adds 0-based ``rank_name`` in ``order`` and inclusive running sums.

    ``order`` must be total (ties broken) for the rank to be deterministic.
    ``totals=True`` also adds ``n_total`` (row count) and ``<sum>_total``
    (grand totals), read from the per-partition table instead of a second
    pass over the input.
    """
    sums = sums or {}
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ensure_checkpoint_dir(df.sparkSession)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(ROWS_OF_PARTITION))
    r = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
         .select("*", F.spark_partition_id().alias("_pid"), place.alias("_lrank")).checkpoint(eager=True))
    wrun = Window.partitionBy("_pid").orderBy("_lrank").rowsBetween(Window.unboundedPreceding, 0)
    local = r.select("*", *[F.sum(e).over(wrun).alias(f"_ls_{k}") for k, e in sums.items()])
    tot = r.groupBy("_pid").agg(F.count(F.lit(1)).alias("_pc"),
                                *[F.sum(e).alias(f"_ps_{k}") for k, e in sums.items()])
    wp = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    wall = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    off = tot.select("_pid", F.coalesce(F.sum("_pc").over(wp), F.lit(0)).alias("_pco"),
                     *[F.coalesce(F.sum(f"_ps_{k}").over(wp), F.lit(0)).alias(f"_pso_{k}")
                       for k in sums],
                     F.sum("_pc").over(wall).alias("n_total"),
                     *[F.sum(f"_ps_{k}").over(wall).alias(f"{k}_total") for k in sums])
    j = local.join(F.broadcast(off), "_pid")
    extra = (["n_total"] + [f"{k}_total" for k in sums]) if totals else []
    return j.select(*df.columns, (F.col("_lrank") + F.col("_pco")).cast("long").alias(rank_name),
                    *[(F.col(f"_ls_{k}") + F.col(f"_pso_{k}")).alias(k) for k in sums], *extra)
