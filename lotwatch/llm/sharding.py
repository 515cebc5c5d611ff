"""Sharding by histogram sort, with DataFrame functions only.

Rows are ordered by a hash of the text, then a hash of the id. Splitters between shards are found
by counting the exact bytes below candidate keys (probes) over all partitions, and probing again
inside the interval that holds the target, until the count is within tolerance or the interval is
one key. Only then are the rows exchanged, once. Equal texts have equal first keys, so they stay
in one shard unless their group is wider than the tolerance; only then is a group cut by id, and
rows equal in both, which no key tells apart, by their number within the group.

A shard is numbered in parts, each a range of keys. A text with more rows than a part has parts of
its own by ranges of the second key, behind the shard's other rows; a group of rows equal in both
keys has parts by ranges of its numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SHARDS = 16
#: Probes of one round inside each interval, and bytes that a splitter may miss its target by, as a share of a shard.
PROBES, TOLERANCE = 256, 0.001
#: A group of equal texts is cut only if keeping it whole would miss the target by more than this share.
KEEP_TOLERANCE = 0.01
KEY_BITS = 63
#: Rows and bytes numbered by one task, about.
SLOT_ROWS, SLOT_BYTES = 250_000, 64 << 20
#: Tables with a row for each text of over SLOT_ROWS rows or SLOT_BYTES, or for each part, are broadcast up to this number.
BROADCAST_ROWS = 100_000


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[str, Column]:
    """The measures of a row: size in bytes plus 1, and its two sort keys (non-negative longs)."""
    text = F.col(text_col).cast("string")
    return {
        "size": (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long"),
        "key": F.shiftrightunsigned(F.xxhash64(text), 1),
        "key2": F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(2)), 1),
    }


def _histogram(rows: DataFrame, key: str, intervals: list[tuple[int, int]]) -> dict[tuple[int, int], dict[int, int]]:
    """Exact bytes between consecutive probes of each interval [lo, hi): interval -> probe number -> bytes.

    One aggregation; at most PROBES rows for each interval come back, whatever the input.
    """
    which, bin_ = F.lit(None).cast("int"), F.lit(None).cast("long")
    for n, (lo, hi) in reversed(list(enumerate(intervals))):
        inside = (F.col(key) >= F.lit(lo)) & (F.col(key) < F.lit(hi)) if hi < 1 << KEY_BITS else F.col(key) >= F.lit(lo)
        which = F.when(inside, F.lit(n)).otherwise(which)
        bin_ = F.when(inside, F.expr(f"({key} - {lo}L) div {_step(lo, hi)}L")).otherwise(bin_)
    counted = rows.select(which.alias("i"), bin_.alias("bin"), "size").where("i is not null").groupBy("i", "bin").agg(F.sum("size").alias("bytes"))
    out: dict = {x: {} for x in intervals}
    for r in counted.collect():
        out[intervals[r["i"]]][r["bin"]] = r["bytes"]
    return out


def _step(lo: int, hi: int) -> int:
    return max(1, -(-(hi - lo) // PROBES))


def _boundaries(rows: DataFrame, key: str, targets: list[int], slack: float) -> list[tuple[int, int, int]]:
    """For each target of bytes: (boundary, bytes below it, bytes of the key at its left end, if one key holds the target).

    A boundary b sends keys below b to the left. Where no boundary is within ``slack``, the last
    interval is a single key: then the third number is its bytes, and the boundary is that key.
    """
    state = {t: (0, 1 << KEY_BITS, 0) for t in targets}
    done: dict[int, tuple[int, int, int]] = {}
    while state:
        ivals = sorted({(lo, hi) for lo, hi, _ in state.values()})
        hist = _histogram(rows, key, ivals)
        for t, (lo, hi, below) in list(state.items()):
            step, at = _step(lo, hi), below
            best, cell = (abs(below - t), lo, below), None
            for b in sorted(hist[(lo, hi)]):
                n = hist[(lo, hi)][b]
                if at <= t <= at + n and cell is None:
                    cell = (lo + b * step, min(hi, lo + (b + 1) * step), at, n)
                at += n
                best = min(best, (abs(at - t), min(hi, lo + (b + 1) * step), at))
            if best[0] <= slack or cell is None:
                done[t] = (best[1], best[2], 0)
            elif cell[1] - cell[0] <= 1:
                done[t] = (cell[0], cell[2], cell[3])
            else:
                state[t] = (cell[0], cell[1], cell[2])
            if t in done:
                del state[t]
    return [done[t] for t in targets]


def splitters(rows: DataFrame, shards: int, keep_together: float = KEEP_TOLERANCE) -> list[tuple[int, int, int]]:
    """shards - 1 ascending keys (key, key2, number): a row belongs to the shard numbered by how many don't exceed it.

    The number counts the rows of a group of equal keys; it is 0 where the group isn't cut.
    """
    total, largest = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    if not total:
        return [(0, 0, 0)] * (shards - 1)
    targets = [total * k // shards for k in range(1, shards)]
    out: list[tuple[int, int, int]] = []
    keep = max(total / shards * keep_together, largest / 2)
    cut: dict[int, list[int]] = {}
    for t, (b, below, held) in zip(targets, _boundaries(rows, "key", targets, total / shards * TOLERANCE)):
        if not held:
            out.append((b, 0, 0))
        elif min(t - below, below + held - t) <= keep:
            out.append((b, 0, 0) if t - below <= below + held - t else (b + 1, 0, 0))
        else:  # the group is wider than the tolerance: cut it by the second key
            cut.setdefault(b, []).append(t - below)
    for key, inner in cut.items():
        group = rows.where(F.col("key") == F.lit(key))
        for t, (b, below, held) in zip(inner, _boundaries(group, "key2", inner, total / shards * TOLERANCE)):
            if not held:
                out.append((key, b, 0))
            elif min(t - below, below + held - t) <= largest:
                out.append((key, b + 1 if t - below > below + held - t else b, 0))
            else:  # rows equal in both keys: all have one size, so their number says where to cut
                n = group.where(F.col("key2") == F.lit(b)).count()
                out.append((key, b, round((t - below) * n / held)))
    return sorted(out)


def shard_of(bounds: list[tuple[int, int, int]], key_col: str = "key", key2_col: str = "key2", number_col: str | None = None) -> Column:
    """The number of splitters that don't exceed the row's keys, by halving the list in nested conditions."""

    def pick(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        key, key2, nth = bounds[mid]
        first, second = F.col(key_col), F.col(key2_col)
        over = second >= F.lit(key2)
        if nth:
            number = F.col(number_col) if number_col else F.lit(0)
            over = (second > F.lit(key2)) | ((second == F.lit(key2)) & (number >= F.lit(nth)))
        over = first >= F.lit(key) if (key2, nth) == (0, 0) else (first > F.lit(key)) | ((first == F.lit(key)) & over)
        return F.when(over, pick(mid + 1, hi)).otherwise(pick(lo, mid))

    return pick(0, len(bounds))


def _numbered(rows: DataFrame, twins: DataFrame, key: str, key2: str, number: str) -> DataFrame:
    """``rows`` with a column ``number``: 0, but from 0 upwards in the groups of equal keys that ``twins`` (t1, t2) names.

    The groups' rows are written with their partition, counted in each, and numbered within it, so no task needs a whole group.
    """
    match = (F.col(key) == F.col("t1")) & (F.col(key2) == F.col("t2"))
    part, before = common.fresh("shard_of_part", rows.columns), common.fresh("shard_rows_before", rows.columns)
    few = F.broadcast(twins) if twins.count() <= BROADCAST_ROWS else twins
    alone = rows.join(few, match, "left_anti").withColumn(number, F.lit(0).cast("long"))
    some = common.written(rows.join(few, match, "left_semi").withColumn(part, F.spark_partition_id()), "shard-twins")
    counts = some.groupBy(key, key2, part).agg(F.count("*").alias("n")).selectExpr(key, key2, part, f"sum(n) over (partition by {key}, {key2} order by {part}) - n as {before}")
    nth = F.expr(f"row_number() over (partition by {key}, {key2}, {part} order by {part})")
    some = some.withColumn(number, nth).join(common.written(counts, "shard-twin-counts"), [key, key2, part])
    return alone.unionByName(some.withColumn(number, (F.col(number) - 1 + F.col(before)).cast("long")).drop(part, before))


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", keep_together: float = KEEP_TOLERANCE) -> DataFrame:
    """``docs`` with size, text_crc32, law, shard, slot and grown_shard; sizes of shards are near equal (law ``bytes``).

    A shard misses total/shards by at most the tolerance or half the largest row at each end; a
    group of equal texts is kept whole while that misses it by at most ``keep_together`` of a shard.
    Slots number a shard's rows from 0 without gaps, in the order of the keys; texts with very many
    rows come last. Defined cases: a null text has size 1 and the checksum of the empty text; null
    ids are ordinary values; rows equal in id and text stay together unless a splitter must cut
    them, and then any of them may lie on either side; an empty table gives an empty result; the
    input's columns of the result's names stay, with an underscore in front.
    """
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    base = common.set_aside(docs, *made, keep=(id_col, text_col))
    own = base.columns
    key, key2, number, part, before, size = (common.fresh(n, [*own, *made]) for n in ("shard_key", "shard_key2", "shard_number", "shard_part", "shard_before", "shard_size"))
    measures = keyed(base, id_col, text_col)
    rows = common.written(base.select(*[measures[n].alias(n) for n in ("size", "key", "key2")]), "shard-keys")
    bounds = splitters(rows, shards, keep_together)
    n_rows, n_bytes = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    # Hashes are even, so equal ranges of keys have about equal numbers of texts; texts and groups of many rows are split on their own.
    parts = max(8, -(-n_rows // (shards * SLOT_ROWS)), -(-n_bytes // (shards * SLOT_BYTES)))
    needs = F.greatest(F.ceil(F.count("*") / SLOT_ROWS), F.ceil(F.sum("size") / SLOT_BYTES)).cast("int").alias("w_parts")
    wide = common.written(rows.groupBy(F.col("key").alias("w")).agg(needs).where("w_parts > 1"), "shard-wide")
    groups = rows.join(F.broadcast(wide) if wide.count() <= BROADCAST_ROWS else wide, rows.key == wide.w).groupBy("key", "key2").agg(needs).where("w_parts > 1")
    cut = [(a, b) for a, b, n in bounds if n]
    twins = groups.selectExpr("key as t1", "key2 as t2").union(docs.sparkSession.createDataFrame(cut, "t1 long, t2 long")).distinct()
    twins = common.written(twins, "shard-groups")
    span = (1 << KEY_BITS) // (shards * parts) + 1
    wide = F.broadcast(wide) if wide.count() <= BROADCAST_ROWS else wide

    def place(df: DataFrame) -> DataFrame:
        """``df`` with the shard and the part of each row."""
        slice_ = F.expr(f"{key} div {span}L")
        inner = F.when(F.col("w").isNull(), F.lit(0)).otherwise(F.floor(F.col(key2) / F.lit(float(1 << KEY_BITS)) * F.col("w_parts"))).cast("long")
        at = F.struct(F.col("w").isNotNull().alias("wide"), slice_.alias("a"), F.coalesce("w", F.lit(0)).alias("w"), inner.alias("b"), F.expr(f"{number} div greatest(1L, least({SLOT_ROWS}L, {SLOT_BYTES}L div {size}))").alias("c"))
        return df.join(wide, F.col(key) == F.col("w"), "left").withColumns({"shard": shard_of(bounds, key, key2, number), part: at}).drop("w", "w_parts")

    placed = base.select(*own, measures["size"].alias(size), measures["key"].alias(key), measures["key2"].alias(key2))
    if twins.isEmpty():
        slim = rows.select(F.col("key").alias(key), F.col("key2").alias(key2), F.col("size").alias(size), F.lit(0).cast("long").alias(number))
        placed = placed.withColumn(number, F.lit(0).cast("long"))
    else:
        slim = placed = _numbered(placed, twins, key, key2, number)
    # Offsets of a shard's parts: one small row for each part.
    counts = place(slim).groupBy("shard", part).agg(F.count("*").alias("n")).selectExpr("shard", part, f"sum(n) over (partition by shard order by {part}) - n as {before}")
    counts = common.written(counts, "shard-offsets")
    slot = F.expr(f"row_number() over (partition by shard, {part} order by {key}, {key2}, {number})")
    numbered = place(placed).withColumn("slot", slot).join(F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts, ["shard", part])
    return numbered.select(
        *own, F.col(size).alias("size"), F.crc32(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("slot") - 1 + F.col(before)).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
