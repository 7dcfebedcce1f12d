"""Reading the tables of a collection and cutting lineage safely."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_CUTS: list[str] = []


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``root`` (one file or a folder of parts)."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: spark.checkpoint.dir, else the checkpoint folder that was set.

    Where neither is there, a local master gets a temporary folder of its own; a
    cluster is refused, as its nodes would each write to their own disk.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not where:
        found = sc._jsc.sc().getCheckpointDir()
        if not found.isDefined() and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir names no folder that all nodes share")
        where = found.get() if found.isDefined() else os.path.join(tempfile.gettempdir(), f"tabularium-{os.getpid()}")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from what was written.

    Survives lost executors, ends the lineage, and lets several consumers read
    one computation. Column order and types stay as they are. The files stay
    until ``clear_cuts`` or until the shared folder is emptied.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(at)
    _CUTS.append(at)
    return spark.read.schema(df.schema).parquet(at)


def clear_cuts(spark: SparkSession) -> int:
    """Delete what ``cut`` has written in this process; returns how many tables. Results not yet written may need them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    while _CUTS:
        path = jvm.org.apache.hadoop.fs.Path(_CUTS.pop())
        done += bool(path.getFileSystem(conf).delete(path, True))
    return done


def spread(spark: SparkSession, factor: int = 1) -> int:
    """Number of partitions for CPU-bound Python stages: the session's shuffle width."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism) * factor


def balanced(df: DataFrame, *keys: str, factor: int = 1) -> DataFrame:
    """Spread rows evenly before a costly stage, without relying on file layout."""
    n = spread(df.sparkSession, factor)
    return df.repartition(n, *[F.col(k) for k in keys]) if keys else df.repartition(n)
