"""Helpers shared by the training-data operators: folds, text packing, byte hashing.

Scratch tables go to the folder that the cluster names in ``spark.checkpoint.dir``: every
executor and the driver can read it, and a lost executor loses nothing that was written there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import release, scratch_path, shared_dir, written  # noqa: F401

PRIME = np.uint64(0x9E3779B97F4A7C15)
MIX1 = np.uint64(0xFF51AFD7ED558CCD)
MIX2 = np.uint64(0xC4CEB9FE1A85EC53)
#: Texts are handled in packs of about this many bytes, so that a task's memory doesn't follow the batch.
PACK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """The fold of a row: true where crc32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def hash_order(*cols: Column) -> Column:
    """A pseudo-random order that depends on the values alone."""
    return F.xxhash64(*cols, F.lit(20240229))


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores in front until no column of the input has it."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name = "_" + name
    return name


def set_aside(df: DataFrame, *made: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with its columns of the names ``made`` under other names (underscores in front), so that a result may use these."""
    names, taken = {}, {*df.columns, *made}
    for c in df.columns:
        if c.lower() in {m.lower() for m in made} and c.lower() not in {k.lower() for k in keep}:
            names[c] = fresh(c, taken)
            taken.add(names[c])
    return df.withColumnsRenamed(names)


#: Ids that several rows share are broadcast up to this number, and shuffled beyond.
BROADCAST_REPEATED = 20_000


def row_names(df: DataFrame, name: str, id_col: str, text_col: str) -> DataFrame:
    """``df`` with a column ``name``: a text of its own for each row, the same whatever the partitions.

    It is the id where no other row has it. Rows that share an id (or have none) are told apart by
    their texts, and those equal in both by an occurrence number, counted within partitions and
    added up over them, so that no task needs all rows of an id.
    """
    spark, ident = df.sparkSession, F.col(id_col).cast("string")
    ids, twin = fresh("row_id", df.columns), fresh("row_text", df.columns)
    part, nth, before = fresh("row_part", df.columns), fresh("row_nth", df.columns), fresh("row_before", df.columns)
    shared = written(df.select(ident.alias(ids)).groupBy(ids).agg(F.count("*").alias("n")).where(f"n > 1 or {ids} is null").select(ids), "shared-ids")
    n = shared.count()
    if not n:
        return df.withColumn(name, ident)
    small = F.broadcast(shared) if n <= BROADCAST_REPEATED else shared
    match = ident.eqNullSafe(F.col(ids))
    alone = df.join(small, match, "left_anti").withColumn(name, ident)
    some = df.join(small, match, "left_semi").withColumns({twin: F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")), ids: F.coalesce(ident, F.lit("")), part: F.spark_partition_id()})
    some = written(some, "shared-rows")
    key = [ids, twin]
    counts = some.groupBy(*key, part).agg(F.count("*").alias("n")).selectExpr(*key, part, f"sum(n) over (partition by {ids}, {twin} order by {part}) - n as {before}")
    counts = written(counts, "shared-counts")
    numbered = some.withColumn(nth, F.expr(f"row_number() over (partition by {ids}, {twin}, {part} order by {twin})")).join(counts, [*key, part])
    made = F.concat_ws("|", ids, twin, (F.col(nth) + F.col(before)).cast("string"))
    return alone.unionByName(numbered.withColumn(name, made).drop(*key, part, nth, before))


def packs(texts: Iterable[bytes], limit: int = PACK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts in packs of about ``limit`` bytes, each with the number of its first text."""
    first, held, size = 0, [], 0
    for n, text in enumerate(texts):
        if held and size + len(text) > limit:
            yield first, held
            first, held, size = n, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def utf8(values: Iterable) -> list[bytes]:
    """UTF-8 bytes of each text; a missing text is empty."""
    return [v.encode("utf-8", "surrogatepass") if isinstance(v, str) else b"" for v in values]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * MIX1
    x ^= x >> np.uint64(29)
    x *= MIX2
    x ^= x >> np.uint64(32)
    return x


def space_mask(data: np.ndarray) -> np.ndarray:
    """Where the byte is one of x20, x09 to x0D."""
    return (data == 32) | ((data >= 9) & (data <= 13))


class WordHasher:
    """64-bit hashes of all words in a byte array, from one running sum of keyed bytes."""

    def __init__(self, seed: int = 1):
        self.byte_key = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.power = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            with np.errstate(over="ignore"):
                inv = np.uint64(pow(int(PRIME), -1, 1 << 64))
                self.power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, PRIME)]))
                self.inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, inv)]))

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, hash) of each maximal run of bytes that aren't white space."""
        self._grow(max(len(data) + 1, 64))  # callers use the first powers whatever the length
        space = space_mask(data)
        edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        with np.errstate(over="ignore"):
            keyed = self.byte_key[data] * self.power[: len(data)]
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(keyed)])
            return start, end, mixed((total[end] - total[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes with a line end after each, and where each text begins (one more entry: the end)."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), np.concatenate([[0], np.cumsum(sizes)])
