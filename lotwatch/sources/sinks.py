"""Sinks: snapshots behind a pointer, append-only histories, the review queue."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def replace_file(spark: SparkSession, path: str, text: str) -> None:
    """A small file with a new content, in one step: a reader finds the old content or the new one."""
    (new, fs), (final, _) = _path(spark, f"{path}.new"), _path(spark, path)
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(new, final, options)


def write_snapshot(df: DataFrame, root: str, version: str) -> None:
    """A new version beside the old ones; readers see it once the pointer names it."""
    df.write.mode("overwrite").parquet(f"{root}/v={version}")
    replace_file(df.sparkSession, f"{root}/current", version)


def current_version(spark: SparkSession, root: str) -> str | None:
    p, fs = _path(spark, f"{root}/current")
    return spark.read.text(f"{root}/current").first()[0] if fs.exists(p) else None


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/v={current_version(spark, root)}")


def append_history(df: DataFrame, root: str, run_date: date) -> None:
    """Versions, fetch log or events: appended, partitioned by the day of the run."""
    df.withColumn("run_date", F.lit(run_date)).write.mode("append").partitionBy("run_date").parquet(root)


REVIEW = "raw_name string, candidate_canonical string, score double, confidence double, reviewed_at string"


def write_review(results: DataFrame, path: str, reviewed_at: str) -> None:
    """Names of the review band, as JSON lines."""
    rows = results.where("action = 'review'").select(F.col("raw").alias("raw_name"), F.col("canonical").alias("candidate_canonical"), (F.col("confidence") * 100).alias("score"), "confidence", F.lit(reviewed_at).alias("reviewed_at"))
    rows.write.mode("append").json(path)


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """Newest first."""
    return spark.read.schema(REVIEW).json(path).orderBy(F.desc("reviewed_at"), "raw_name")
