"""Spark session settings the engine relies on.

Operators need two things from a session: the UTC time zone (test parquet is
TIMESTAMP_NTZ and some functions convert to zoned time) and a checkpoint
folder. Adaptive execution with skew-join splitting, Spark's default, is
assumed; sessions built here for tests and local runs set it.
On a cluster the checkpoint folder comes from ``spark.checkpoint.dir``; only
when that is unset (tests, local runs) a scratch folder is created.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# The one setting results depend on; it is set on any session.
RESULT_CONF = {"spark.sql.session.timeZone": "UTC"}
# Settings of sessions that ``build_session`` makes; a caller's own session keeps its tuning.
ENGINE_CONF = {
    **RESULT_CONF,
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "tracefold") -> SparkSession:
    """Session for tests, bench and local runs (UI off, UTC, AQE on)."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", os.environ.get("TRACEFOLD_DRIVER_MEMORY", "16g"))
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus))))
    for k, v in ENGINE_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_engine_conf(spark)
    return spark


def apply_engine_conf(spark: SparkSession) -> None:
    """Set what results depend on (the time zone) on an existing session; tuning stays the caller's."""
    for k, v in RESULT_CONF.items():
        spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder; it is read
    from the session and never replaced. Tests and local runs get a fresh
    scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not (sc.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder: checkpoints must "
                               "survive the loss of an executor")
        conf_dir = tempfile.mkdtemp(prefix="tracefold-ckpt-")   # local runs and tests only
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir
