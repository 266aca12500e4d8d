"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only on one machine (a local master) a temporary folder is set where the session names none; on a cluster every
    executor would write a folder of its own, so there a missing setting raises ``ValueError``.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not (sc.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="marginalia-"))
    return sc.getCheckpointDir()


#: Tables written by :func:`saved` in this process and not yet discarded.
_written: list[str] = []


def saved(df: DataFrame, label: str = "stage") -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage and survives a lost executor.

    The table stays until :func:`discard_saved`, as results that were not yet computed still read it.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard_saved(spark: SparkSession) -> int:
    """Deletes the tables :func:`saved` wrote; to be called when all results that read them are stored. How many there were."""
    done = 0
    while _written:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        done += where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return int(done)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Over at least as many partitions as there are cores; a scan that already has them stays as it is.

    A small file holds one row group and so gives one task, which would leave the other cores idle in
    front of a costly Python step. Large inputs have more partitions than cores and are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= min(cores, 4):
        return df
    return df.repartition(cores, *keys)


def null_to_empty(col: str):
    return F.coalesce(F.col(col), F.lit(""))
