"""A document table in hash buckets with one commit point for all its sinks.

Layout under a root, ``c`` the number of a commit:

    state/c=<c>/b=<bucket>      documents, by the hash of their address
    contents/c=<c>/b=<bucket>   (source_hash, n): documents that each commit gave (1) or took (-1) these bytes, by the hash of the bytes
    versions/c=<c>, log/c=<c>, events/c=<c>   what each commit replaced, decided and counted
    head                        JSON: the last commit, each query's last batch, the commit that holds each bucket, and those that hold each bucket of bytes

A batch reads and rewrites only the buckets of its own addresses, beside the old ones, and reads those of its bytes; what it gives and
takes of these is written beside them, and a bucket of bytes is summed up after MOST commits. Everything
of a commit becomes visible in one step, when ``head`` is replaced. What a failed attempt left has a number
above the head's, is never read, and is overwritten by the next attempt. A batch that the head already names
changes nothing. One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.documents import URL, ingest_counts, upsert
from ..storage import release, written
from .sinks import _path, replace_file

BUCKETS = 64
#: Commits that a bucket of bytes may be spread over.
MOST = 16
EMPTY = {"commit": 0, "batches": {}, "state": {}, "contents": {}}


def bucket_of(buckets: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def read_head(spark: SparkSession, root: str) -> dict:
    path, fs = _path(spark, f"{root}/head")
    return json.loads(spark.read.text(f"{root}/head", wholetext=True).first()[0]) if fs.exists(path) else {**EMPTY}


def _buckets(spark: SparkSession, root: str, name: str, head: dict, schema, wanted: list[int] | None = None) -> DataFrame:
    """The current rows of a bucketed part: of all buckets, or of those ``wanted``."""
    held = {int(b): c for b, c in head[name].items()}
    paths = [f"{root}/{name}/c={held[b]}/b={b}" for b in (sorted(held) if wanted is None else sorted(set(wanted) & set(held)))]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_documents(spark: SparkSession, root: str, buckets: list[int] | None = None) -> DataFrame:
    head = read_head(spark, root)
    return _buckets(spark, root, "state", head, head["schema"], buckets)


def read_appended(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The versions, log or events of all commits; ``c`` is the commit."""
    return spark.read.parquet(f"{root}/{name}").where(F.col("c") <= read_head(spark, root)["commit"])


def _write_buckets(df: DataFrame, root: str, name: str, commit: int) -> dict[str, int]:
    """Write ``df`` (column b) for a commit and return the buckets that it holds now."""
    # Tasks write the buckets of the rows they hold: documents aren't shuffled for it, which takes more and smaller files.
    path = f"{root}/{name}/c={commit}"
    df.write.mode("overwrite").option("compression", "zstd").partitionBy("b").parquet(path)
    where, fs = _path(df.sparkSession, path)
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return {n.removeprefix("b="): commit for n in names if n.startswith("b=")}


def _publish(spark: SparkSession, root: str, head: dict) -> None:
    replace_file(spark, f"{root}/head", json.dumps(head, sort_keys=True))


CONTENTS = "source_hash string, n long"


def _contents(spark: SparkSession, root: str, head: dict, wanted: list[int]) -> DataFrame:
    """What all commits gave and took of the bytes in these buckets."""
    paths = [f"{root}/contents/c={c}/b={b}" for b in sorted(set(wanted)) for c in head["contents"].get(str(b), ())]
    return spark.read.schema(CONTENTS).parquet(*paths) if paths else spark.createDataFrame([], CONTENTS)


def load(docs: DataFrame, root: str, buckets: int = BUCKETS) -> None:
    """A new table with ``docs`` (one row for each address)."""
    spark = docs.sparkSession
    head = {**EMPTY, "commit": 1, "buckets": buckets, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)}
    head["state"] = _write_buckets(docs.withColumn("b", bucket_of(buckets, *URL)), root, "state", 1)
    held = _buckets(spark, root, "state", head, docs.schema)
    bytes_ = held.where("source_hash is not null").select("source_hash", F.lit(1).cast("long").alias("n"), bucket_of(buckets, "source_hash").alias("b"))
    head["contents"] = {b: [c] for b, c in _write_buckets(bytes_, root, "contents", 1).items()}
    _publish(spark, root, head)


def merge_batch(
    incoming: DataFrame, root: str, query: str = "", batch: int | None = None, check_for_updates: bool = True, now: datetime | None = None, after: Callable[[str], None] | None = None, landed: bool = False
) -> dict | None:
    """Upsert a batch of observations into the table; the new head, or None if the head has the batch already.

    The result is that of :func:`upsert` over the whole table. Only buckets of the batch's addresses, and of
    the bytes that it brings or replaces, are read and written. ``after`` is called with the name of each sink
    when it is written (tests let it fail). A batch is written before it is read several times, unless it comes of files that stay and gives the same rows
    each time (``landed``).
    """
    spark, head = incoming.sparkSession, read_head(spark=incoming.sparkSession, root=root)
    if batch is not None and head["batches"].get(query, -1) >= batch:
        return None
    n, commit, done = head["buckets"], head["commit"] + 1, after or (lambda name: None)
    rows = incoming if landed else written(incoming, "ledger-batch")
    at = rows.select(F.collect_set(bucket_of(n, *URL)).alias("state"), F.collect_set(F.when(F.col("source_hash").isNotNull(), bucket_of(n, "source_hash"))).alias("contents")).first()  # at most ``n`` numbers each
    stored = _buckets(spark, root, "state", head, head["schema"], at["state"])
    kept: list[DataFrame] = []

    def hold(df: DataFrame) -> DataFrame:
        kept.append(_outcomes(df, stored.columns))
        return kept[0]

    after_, versions, log, _ = upsert(stored, rows, check_for_updates, now, _contents(spark, root, head, at["contents"]), hold)
    state = _write_buckets(after_.withColumn("b", bucket_of(n, *URL)), root, "state", commit)
    done("state")
    # Addresses that were inserted or updated give up their old bytes and hold their new ones; what stays as it was says nothing.
    held, size = kept[0], F.when(F.col("stands"), 1).otherwise(-1).cast("long")
    moved = held.where("source_hash is not null and (action is not null) = stands").select("source_hash", size.alias("n"), bucket_of(n, "source_hash").alias("b"))
    spread = [int(b) for b, commits in head["contents"].items() if len(commits) >= MOST]
    if spread:
        moved = moved.unionByName(_contents(spark, root, head, spread).withColumn("b", bucket_of(n, "source_hash"))).groupBy("source_hash", "b").agg(F.sum("n").alias("n")).where("n != 0")
    before = {b: commits for b, commits in head["contents"].items() if int(b) not in spread}
    contents = before | {b: [*before.get(b, ()), commit] for b in _write_buckets(moved, root, "contents", commit)}
    done("contents")
    for name, rows_out in (("versions", versions), ("log", log.select("id", *URL, "seq", "action")), ("events", ingest_counts(log))):
        rows_out.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{name}/c={commit}")
        done(name)
    head = head | {"commit": commit, "state": head["state"] | state, "contents": contents}
    if batch is not None:
        head["batches"] = head["batches"] | {query: batch}
    _publish(spark, root, head)
    release(rows, held)
    return head


def _outcomes(df: DataFrame, columns: list[str]) -> DataFrame:
    """The outcomes written once, with the texts of what stands and the bytes of what is replaced."""
    needed = {c: F.when(F.col("stands"), F.col(c)).alias(c) for c in {*columns, "kept_id"} - {"id", *URL, "source_hash"}}
    bytes_ = F.when(F.col("stands") | F.col("action").isNull(), F.col("source_hash")).alias("source_hash")
    return written(df.select("id", *URL, "seq", "action", "stands", "before", bytes_, *needed.values()), "ledger-log")


def _named(commits: int | list[int] | None) -> list[int]:
    return commits if isinstance(commits, list) else [commits]


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete buckets that the head no longer names, and what failed attempts left. No reader may hold an older head. The number of folders deleted."""
    head, gone = read_head(spark, root), 0
    for name in ("state", "contents", "versions", "log", "events"):
        where, fs = _path(spark, f"{root}/{name}")
        for commit in fs.listStatus(where) if fs.exists(where) else ():
            number = int(commit.getPath().getName().removeprefix("c="))
            if name in ("state", "contents") and number <= head["commit"]:
                old = [b.getPath() for b in fs.listStatus(commit.getPath()) if b.getPath().getName().startswith("b=") and number not in _named(head[name].get(b.getPath().getName()[2:]))]
            else:
                old = [commit.getPath()] if number > head["commit"] else []
            for path in old:
                fs.delete(path, True)
                gone += 1
    return gone
