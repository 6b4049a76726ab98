"""Session helpers: shared scratch space, lineage cuts, size checks."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables: the session's spark.checkpoint.dir.

    Only a session whose driver is its one executor gets a folder of its own
    when the setting is missing.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="spark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, label: str) -> str:
    return os.path.join(scratch_root(spark), f"{label}-{uuid.uuid4().hex}")


def exists(spark: SparkSession, path: str) -> bool:
    """Is there such a file or folder, on whatever file system the path names?"""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared scratch folder and go on from the table.

    Drops the lineage, survives lost executors, and gives the optimiser the
    true size, which a checkpointed plan with its old estimates would not.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Rebalance a scan that has fewer partitions than the session has cores.

    For CPU-heavy steps on a small input. A scan of any size worth a cluster
    has more partitions than cores and is left as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitions that adaptive execution does not merge.

    For CPU-heavy steps after a shuffle: small partitions would be merged by
    size into one task. A grouping on the same keys needs no further shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
