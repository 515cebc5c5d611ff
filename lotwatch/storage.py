"""Scratch tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset, a single-machine session (tests) gets a folder of its own; a cluster is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = getattr(spark, "_lotwatch_shared", None) or tempfile.mkdtemp(prefix="lotwatch-")
        spark._lotwatch_shared = path
    return path.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application's scratch tables."""
    return f"{shared_dir(spark)}/lotwatch/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lotwatch_path = path
    return out


def numbered(df: DataFrame, column: str) -> DataFrame:
    """``df`` with dense numbers from 0 in ``column``: it is written, and rows are counted for each task that wrote them."""
    spark = df.sparkSession
    kept = written(df.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    before, total = [], 0
    for part, n in kept.groupBy(F.shiftright("_at", 33).alias("part")).count().orderBy("part").collect():  # a row for each task
        before.append((part, total))
        total += n
    starts = F.broadcast(spark.createDataFrame(before, "_part long, _before long"))
    out = kept.join(starts, F.shiftright("_at", 33) == F.col("_part")).select(*df.columns, (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias(column))
    out._lotwatch_path = kept._lotwatch_path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`written` that no later step reads: what came of them has been written."""
    for df in tables:
        path = getattr(df, "_lotwatch_path", None)
        if path:
            _remove(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; call it when its results have been written."""
    _remove(spark, scratch_root(spark))
