"""The corpus pipeline: five stages from raw documents to shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller writes it as Parquet
and reads it again as the next stage's ``docs``. All but the last return the columns of documents,
whatever other columns there are. Empty tables give empty results. Rows that repeat are documents
like others, but for near-duplicates, where equal ids are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwatch.llm import common, decontaminate, langid, mixing, neardup, sharding


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier knows. It rejects null texts and texts without a letter, and everything where nothing is labelled."""
    model = langid.learnt(docs, ~common.held_out(F.col("doc_id")))
    said, score = common.fresh("lang_pred", docs.columns), common.fresh("lang_score", docs.columns)
    return langid.identify(docs, model, said, score).where(F.col(said) != langid.UNKNOWN).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id. Rows that share an id are one document and stay together; rows without one stay."""
    gone_id = common.fresh("gone_id", docs.columns)
    gone = common.written(neardup.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias(gone_id)).distinct(), "gone")
    return docs.join(gone, F.col("doc_id") == F.col(gone_id), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; null and empty texts have none."""
    return decontaminate.decontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards the target weights of their sources, in shuffled order; a null source is one of its own."""
    made = ("rate", "replica", "shuffle_key")
    held = {c: common.fresh(f"own_{c}", [*docs.columns, *made]) for c in docs.columns if c.lower() in made}
    back = [F.col(held[c]).alias(c) if c in held else F.col(c) for c in docs.columns]
    return mixing.mix(docs.withColumnsRenamed(held)).select(*back)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot; the input's columns of the result's names get an underscore in front."""
    return sharding.shard(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("shards", shards)]

#: Trained and iterative stages have no SQL form; the tests compare each stage of run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through(spark, common.table(spark, sf_dir, "documents"), sf_dir)


def through(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` after all stages; the result of a stage is deleted when the next one's has been written."""
    before = None
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            common.release(before)
        before = docs
    return docs
