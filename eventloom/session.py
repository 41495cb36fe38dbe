"""Session contract: UTC clock, adaptive execution, shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings every job relies on; anything the cluster already sets wins.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str = "local[8]", partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benches; on a cluster pass the cluster's own session instead."""
    b = SparkSession.builder.master(master).appName("eventloom")
    for k, v in {**DEFAULTS, "spark.sql.shuffle.partitions": str(partitions), **extra}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediates.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset (tests, a laptop)
    a folder on this machine is made; a cluster without the setting is refused, since no executor
    could read another machine's temporary folder.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", "") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="eventloom-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{os.urandom(8).hex()}")


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Removes a folder made under scratch_path once nothing reads it any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows as a table under the shared folder, and its path: computed once, and kept when an executor is lost."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
