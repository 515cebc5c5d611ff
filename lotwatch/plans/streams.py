"""Streaming operators over the events table, run until all of it is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import scratch_path
from ..streaming import jobs

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SEVERITY = {"error": "class_1", "purchase": "class_2", "click": "class_3"}


def events(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream of files. A pattern is given because a stream's plain path must be a folder."""
    stream = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/[e]vents.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows of the stream as a batch table. In complete mode each batch replaces the one before."""
    spark = stream.sparkSession
    root = scratch_path(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        # Numbered folders: a batch that is repeated after a failure replaces itself.
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number if mode == 'append' else 0}")

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out").select(*stream.columns)


def stream_recall_counts(spark, sf):
    severity = F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), F.col("event_type"))
    rows = events(spark, sf).select("ts", (F.col("user_id") % 20).cast("string").alias("manufacturer_id"), severity.alias("severity"))
    out = drained(jobs.stream_recall_counts(rows, window="1 day"), "complete")
    return out.withColumns({n: F.col(n).cast("timestamp_ntz") for n in ("start", "end")})


def stream_recall_bursts(spark, sf):
    """Sessions that a gap of an hour ends, read to the end of the stream: those still open when the watermark stops are left."""
    rows = events(spark, sf).select("ts", (F.col("user_id") % 20).cast("string").alias("manufacturer_id"))
    out = drained(jobs.stream_recall_bursts(rows, gap="1 hour"), "complete")
    return out.withColumns({n: F.col(n).cast("timestamp_ntz") for n in ("start", "end")})


def stream_dedup(spark, sf):
    rows = events(spark, sf).select(F.col("event_type").alias("source_id"), F.col("user_id").cast("string").alias("source_url"), F.col("ts").alias("fetched_at"))
    return drained(jobs.stream_dedup(rows, delay="1000 days")).select("source_id", "source_url")


def stream_versions(spark, sf):
    own = spark.newSession()  # the state store of this operator is a setting of the session
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    rows = events(own, sf).select(F.col("user_id").cast("string").alias("source_url"), F.col("event_id").alias("seq"), F.col("event_type").alias("normalized_hash"))
    return drained(jobs.stream_versions(rows))


def stream_version_chain(spark, sf):
    """Changes in event-time order with a time to live of nine hours, up to the last watermark."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    rows = events(own, sf).select("ts", F.col("user_id").cast("string").alias("source_url"), F.col("event_id").alias("seq"), F.col("event_type").alias("normalized_hash"))
    return drained(jobs.stream_version_chain(rows, delay="1 day", keep="9 hours"))


def event_properties(spark, sf):
    """Open-ended JSON read as a variant."""
    rows = spark.read.parquet(f"{sf}/events.parquet").withColumn("v", F.try_parse_json("props"))
    return rows.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"))


PLANS = {
    "stream_recall_counts": (stream_recall_counts, """SELECT CAST(user_id % 20 AS VARCHAR) AS manufacturer_id, CAST(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS TIMESTAMP) AS start, CAST(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') + INTERVAL 1 DAY AS TIMESTAMP) AS "end",
  CAST(count(*) AS BIGINT) AS recall_count, CAST(sum(CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END) AS BIGINT) AS weighted_score FROM events GROUP BY ALL"""),
    "stream_recall_bursts": (stream_recall_bursts, """WITH e AS (SELECT CAST(user_id % 20 AS VARCHAR) AS manufacturer_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id % 20 ORDER BY ts, event_id)),
n AS (SELECT *, sum(opens) OVER (PARTITION BY manufacturer_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM e)
SELECT manufacturer_id, CAST(min(ts) AS TIMESTAMP) AS start, CAST(max(ts) + INTERVAL 1 HOUR AS TIMESTAMP) AS "end", CAST(count(*) AS BIGINT) AS recall_count FROM n GROUP BY manufacturer_id, burst"""),
    "stream_dedup": (stream_dedup, "SELECT DISTINCT event_type AS source_id, CAST(user_id AS VARCHAR) AS source_url FROM events"),
    "stream_versions": (stream_versions, "WITH c AS (SELECT CAST(user_id AS VARCHAR) AS source_url, event_id AS seq, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS previous_hash, event_type AS normalized_hash FROM events) SELECT * FROM c WHERE previous_hash <> normalized_hash"),
    "stream_version_chain": (stream_version_chain, """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS source_url, event_id AS seq, epoch_us(ts) AS us, event_type AS normalized_hash FROM events),
c AS (SELECT *, lag(normalized_hash) OVER w AS previous_hash, lag(us) OVER w AS previous_us FROM e WINDOW w AS (PARTITION BY source_url ORDER BY us, seq))
SELECT source_url, seq, previous_hash, normalized_hash FROM c WHERE previous_hash <> normalized_hash AND us - previous_us <= 32400000000 AND us <= ((SELECT max(us) FROM e) // 1000 - 86400000) * 1000"""),
    "event_properties": (event_properties, "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events"),
}
