"""Structured Streaming forms of ingestion, deduplication, versions and counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import RepeatViolator
from ..functions.severity import weight


def stream_ingest(spark: SparkSession, landing: str, schema: str, apply_batch: Callable[[DataFrame, int], None], checkpoint: str, files_per_batch: int = 100):
    """Landed Parquet files through ``apply_batch`` (for example an upsert and its sinks), once each; ends when all are read."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    return stream.writeStream.foreachBatch(apply_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_dedup(stream: DataFrame, keys: tuple[str, ...] = ("source_id", "source_url"), time_col: str = "fetched_at", delay: str = "7 days") -> DataFrame:
    """The first observation of each key within the delay; state older than the watermark is dropped."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(list(keys))


class VersionTracker(StatefulProcessor):
    """Emits an observation whose hash differs from the last one of its address."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "hash string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        # Rows of a key come in any order, so their numbers and hashes (nothing else of them) are sorted first.
        seen = sorted((seq, now) for frame in rows for seq, now in zip(frame["seq"], frame["normalized_hash"]))
        before = self.last.get()[0] if self.last.exists() else None
        out = []
        for seq, now in seen:
            if now != before:
                if before:
                    out.append((key[0], seq, before, now))
                before = now
        self.last.update((before,))
        yield pd.DataFrame(out, columns=["source_url", "seq", "previous_hash", "normalized_hash"])

    def close(self) -> None:
        pass


def stream_versions(stream: DataFrame) -> DataFrame:
    """(source_url, seq, previous_hash, normalized_hash) of changes; columns source_url, seq, normalized_hash are needed. Needs the RocksDB state store."""
    schema = "source_url string, seq long, previous_hash string, normalized_hash string"
    return stream.select("source_url", "seq", "normalized_hash").groupBy("source_url").transformWithStateInPandas(VersionTracker(), schema, "Append", "none")


class ChainTracker(StatefulProcessor):
    """Orders an address's observations by event time before it compares them, and forgets addresses that are no longer seen.

    An observation waits in the state until the watermark passes it: from then on nothing earlier is let
    in. A timer stands at the earliest one that waits, or else where the last one's time to live ends.
    """

    def __init__(self, keep_micros: int):
        self.keep = keep_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, hash string")
        # A batch's observations of an address are one value of three lists: the state is asked once for them, not for each.
        self.waiting = handle.getListState("waiting", "at array<long>, seq array<long>, hash array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        seen = [row for frame in rows for row in zip(frame["at"].tolist(), frame["seq"].tolist(), frame["normalized_hash"].tolist())]
        if seen:
            self._wait(seen)
            self._wake(min(at for at, _, _ in seen))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(row for held in self.waiting.get() for row in zip(*held))
        last_at, last = self.last.get() if self.last.exists() else (None, None)
        out = []
        for at, seq, now in (r for r in waiting if r[0] <= passed):
            if last and at - last_at <= self.keep and now != last:
                out.append((key[0], seq, last, now))
            last_at, last = at, now
        later = [r for r in waiting if r[0] > passed]
        if len(later) < len(waiting):
            self.waiting.clear()
            if later:
                self._wait(later)
        if last_at is not None and last_at + self.keep <= passed:
            self.last.clear()
        elif len(later) < len(waiting):
            self.last.update((last_at, last))
            self._wake(last_at + self.keep)
        if later:
            self._wake(later[0][0])
        if out:
            yield pd.DataFrame(out, columns=["source_url", "seq", "previous_hash", "normalized_hash"])

    def _wait(self, seen: list[tuple[int, int, str]]) -> None:
        self.waiting.appendValue(tuple(list(c) for c in zip(*seen)))

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def close(self) -> None:
        pass


def stream_version_chain(stream: DataFrame, time_col: str = "ts", delay: str = "1 day", keep: str = "365 days") -> DataFrame:
    """(source_url, seq, previous_hash, normalized_hash) of changes in the order of event time, then seq, whatever order the rows come in within ``delay``.

    Columns source_url, seq, normalized_hash and the time are needed; rows without an address, a number or a time take no part. A change
    comes out when the watermark has passed it. An address that isn't seen for ``keep`` leaves the state; its
    next observation has no predecessor. An empty or null predecessor counts as none, as in :func:`documents.version_chain`.
    Needs the RocksDB state store.
    """
    schema = "source_url string, seq long, previous_hash string, normalized_hash string"
    span = stream.sparkSession.sql(f"select unix_micros(timestamp'1970-01-01 00:00:00Z' + interval {keep}) as n").first()["n"]
    rows = stream.where(f"source_url is not null and seq is not null and {time_col} is not null").withWatermark(time_col, delay)
    rows = rows.select("source_url", time_col, F.unix_micros(time_col).alias("at"), "seq", F.coalesce("normalized_hash", F.lit("")).alias("normalized_hash"))
    return rows.groupBy("source_url").transformWithStateInPandas(ChainTracker(span), schema, "Append", "EventTime")


def stream_recall_counts(stream: DataFrame, time_col: str = "ts", key: str = "manufacturer_id", window: str = "30 days", slide: str | None = None, delay: str = "1 day", cfg: RepeatViolator | None = None) -> DataFrame:
    """(key, start, end, recall_count, weighted_score) of each window; rows later than the delay are dropped."""
    cfg = cfg or RepeatViolator()
    span = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    counts = stream.withWatermark(time_col, delay).groupBy(span.alias("w"), key).agg(F.count("*").alias("recall_count"), F.sum(weight(F.col("severity"), cfg.severity_weights)).alias("weighted_score"))
    return counts.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "recall_count", "weighted_score")


def stream_recall_bursts(stream: DataFrame, time_col: str = "ts", key: str = "manufacturer_id", gap: str = "7 days", delay: str = "1 day") -> DataFrame:
    """(key, start, end, recall_count) of bursts that a gap ends."""
    counts = stream.withWatermark(time_col, delay).groupBy(F.session_window(time_col, gap).alias("w"), key).agg(F.count("*").alias("recall_count"))
    return counts.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "recall_count")
