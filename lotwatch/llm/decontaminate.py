"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

A seed is a fixed mask over consecutive tokens; the tokens at its zeros are ignored, so a
passage still shares seeds with its copy after some tokens were substituted. Seeds of all
documents are joined to the benchmark's. A hit names a diagonal, a document and an item laid over
each other at one shift; the diagonal's aligned tokens are compared, and its longest stretch in
which enough tokens agree decides.

The benchmark's seeds are broadcast when their measured number allows it; then each hit is judged
on its document's row and nothing of the documents moves. Beyond that bound seeds are shuffled
without tokens, and tokens are joined back for the documents that were hit.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: A stretch counts if this percentage of it is equal and it has so many equal tokens, or this percentage of its item's tokens if those are fewer.
PERCENT, LEAST_EQUAL = 75, 10
#: Masks (1: the token counts) of items of at least 13 tokens: every stretch with LEAST_EQUAL equal tokens that are PERCENT of it has all tokens of one.
SEEDS = ("111011", "11001011", "11111", "101111")
#: Masks of shorter items, by the least number of tokens: they hit every placement of the unequal tokens that PERCENT allows. Below 4 it allows none.
SHORT_SEEDS = {1: ("1",), 2: ("11",), 3: ("111",), 4: ("111", "1101", "1011"), 6: ("1111", "11011"), 8: ("1111", "11101", "1010011"), 10: ("1111", "11101"), 12: ("1111", "11011")}
LONG_ITEM = 13
#: Every stretch that counts holds one of at most this many tokens (of a longer one, a half counts), so a broadcast seed is judged that far around.
REACH = 25
#: Benchmark seeds are broadcast up to this number (about 100 bytes each with their share of the item).
BROADCAST_SEEDS = 200_000


def token_hashes(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits, in order."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def mask_offsets(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def masks_of(n: int) -> tuple[str, ...]:
    """The masks of an item of ``n`` tokens."""
    return SEEDS if n >= LONG_ITEM else SHORT_SEEDS[max(k for k in SHORT_SEEDS if k <= n)]


def least_equal(n: Column) -> Column:
    """Equal tokens that a stretch of an item of ``n`` tokens needs."""
    return F.least(F.lit(LEAST_EQUAL), F.ceil(n * F.lit(PERCENT) / 100).cast("int"))


def seeded(rows: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """``rows`` (with a column ``tokens``) once for each mask and place ``pos`` where it fits, with its ``seed``.

    The places are exploded first and the seeds hashed afterwards, so that both run in generated code.
    """
    n = F.size("tokens")
    least = min(map(len, masks))
    places = rows.withColumn("pos", F.explode(F.when(n >= least, F.sequence(F.lit(0), n - least))))
    seed = lambda mask: F.when(F.col("pos") + len(mask) <= n, F.xxhash64(F.lit(mask), *[F.get("tokens", F.col("pos") + o) for o in mask_offsets(mask)]))
    return places.withColumn("seed", F.explode(F.array(*map(seed, masks)))).where("seed is not null")


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, tokens): one row for items of equal tokens, with the smallest id; items without a token are left out."""
    items = benchmark.select("item_id", token_hashes(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    return items.groupBy("tokens").agg(F.min("item_id").alias("item_id")).select(F.xxhash64("tokens").alias("item"), "item_id", "tokens")


def longest(same: Column, percent: int) -> Column:
    """(i, n): the first of the longest stretches of a boolean array in which at least ``percent`` are true."""
    up, down = (100 - percent) // math.gcd(percent, 100), percent // math.gcd(percent, 100)

    # s: running sum; f: for each depth d the first place where the sum was at most -d.
    def step(a: Column, x: Column) -> Column:
        s, j = a["s"] + F.when(x, F.lit(up)).otherwise(F.lit(-down)), a["j"] + 1
        start = F.when(s >= 0, F.lit(0)).when(-s < F.size(a["f"]), F.get(a["f"], -s)).otherwise(j)
        return F.struct(
            j.alias("j"), s.alias("s"), F.when(-s >= F.size(a["f"]), F.concat(a["f"], F.array_repeat(j, 1 - s - F.size(a["f"])))).otherwise(a["f"]).alias("f"),
            F.when(j - start > a["n"], start).otherwise(a["i"]).alias("i"), F.greatest(a["n"], j - start).alias("n"),
        )

    zero = F.struct(F.lit(0).alias("j"), F.lit(0).alias("s"), F.array(F.lit(0)).alias("f"), F.lit(0).alias("i"), F.lit(0).alias("n"))
    return F.aggregate(same, zero, step, lambda a: F.struct(a["i"].alias("i"), a["n"].alias("n")))


def equal_in(same: Column) -> Column:
    return F.size(F.filter(same, lambda x: x))


def stretch(same: Column, least: Column) -> Column:
    """(i, n) of the longest stretch with PERCENT equal; if that has fewer than ``least`` equal tokens, of the first short one that has them; else null."""
    return bound(longest(same, PERCENT), lambda found: _stretch(same, least, found))


def bound(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _stretch(same: Column, least: Column, found: Column) -> Column:
    size = F.floor(least * 100 / PERCENT).cast("int")
    start = F.get(F.filter(F.sequence(F.lit(0), F.size(same)), lambda i: equal_in(F.slice(same, i + 1, size)) >= least), F.lit(0))
    short = F.when(start.isNotNull(), F.struct(start.alias("i"), F.least(size, F.size(same) - start).alias("n")))
    return F.when(equal_in(same) >= least, F.when(equal_in(F.slice(same, found["i"] + 1, found["n"])) >= least, found).otherwise(short))


def row_keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """The hash pair that names a document's row by its id and text."""
    return F.xxhash64(F.col(id_col), F.col(text_col)), F.xxhash64(F.lit(1), F.col(text_col))


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    k1, k2 = row_keys(id_col, text_col)
    return docs.select(F.col(id_col).alias("id"), k1.alias("k1"), k2.alias("k2"), token_hashes(F.col(text_col)).alias("tokens"))


def _near_hits(base: DataFrame, probe: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """(id, k1, k2, item, shift) of the diagonals on which a stretch near a seed counts, with broadcast seeds."""
    before = REACH - min(map(len, masks))
    probe = probe.withColumn("lo", F.greatest(F.lit(0), F.col("item_pos") - before))
    probe = probe.select("seed", "item", "item_pos", least_equal(F.size("tokens")).alias("least"), "lo", F.slice("tokens", F.col("lo") + 1, F.col("item_pos") + REACH + LEAST_EQUAL - F.col("lo")).alias("part"))
    hits = seeded(base, masks).join(F.broadcast(probe), "seed")
    # A hit is passed over where as many tokens as the widest mask spans are equal from the place before it on: the same
    # mask hits there too. A run of LEAST_EQUAL such places is a stretch that counts, and what a shorter one belongs to
    # lies within LEAST_EQUAL more tokens of its first. So the work on a text of repeated tokens grows with its
    # diagonals, not with its pairs of places. The test is short on purpose: it runs in the join's generated code.
    span = max(map(len, masks))
    again = F.slice("tokens", F.greatest(F.col("pos"), F.lit(1)), F.lit(span)) == F.slice("part", F.greatest(F.col("item_pos") - F.col("lo"), F.lit(1)), F.lit(span))
    first = (F.col("pos") == 0) | (F.col("item_pos") == 0) | ~again
    # Align the item with the document at the hit; what hangs over either end of the document is cut.
    hits = hits.withColumn("shift", F.col("pos") - F.col("item_pos")).withColumn("cut", F.greatest(F.lit(0), -(F.col("lo") + F.col("shift"))))
    own = F.slice("tokens", F.col("lo") + F.col("shift") + F.col("cut") + 1, F.size("part") - F.col("cut"))
    # The slices are cut in generated code, where no row with all tokens is built. As ``same`` reads them twice, Spark
    # keeps them in a step of their own before the functions on arrays, which run outside of it.
    hits = hits.where(first).select("id", "k1", "k2", "item", "shift", "least", own.alias("own"), F.slice("part", F.col("cut") + 1, F.size("part")).alias("theirs"), (F.col("item_pos") - F.col("lo") - F.col("cut") + 1).alias("hit"))
    same = F.when(F.size("own") + F.size("theirs") > 0, F.zip_with("own", "theirs", lambda a, b: F.coalesce(a == b, F.lit(False))))
    ahead = [F.slice(c, F.col("hit"), F.col("least")) for c in ("own", "theirs")]  # equal tokens from the hit on settle it at once
    hits = hits.select("id", "k1", "k2", "item", "shift", "least", same.alias("same"), ((ahead[0] == ahead[1]) & (F.size(ahead[0]) == F.col("least"))).alias("clear"))
    # Chance hits have too few equal tokens in all and aren't searched.
    sure = F.when(F.col("clear"), F.lit(True)).otherwise(stretch(F.col("same"), F.col("least")).isNotNull())
    # The test blanks the shift, and blanks are dropped by an aggregate's result: a filter on a key would move into the
    # join's condition, and rows with all of a document's tokens would be built before it, one for each place.
    hits = hits.select("id", "k1", "k2", "item", F.when(sure, F.col("shift")).alias("at"))
    return hits.groupBy("id", "k1", "k2", "item", "at").agg(F.max("at").alias("shift")).where("shift is not null").drop("at")


def _far_hits(base: DataFrame, probe: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """(id, k1, k2, item, shift) of all diagonals with a seed in common, with shuffled seeds; no tokens are shuffled."""
    seeds = seeded(base, masks).select("seed", "id", "k1", "k2", "pos")
    met = seeds.join(probe.select("seed", "item", "item_pos"), "seed")
    return met.select("id", "k1", "k2", "item", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()


def _judged(diagonals: DataFrame, base: DataFrame, items: DataFrame) -> DataFrame:
    """(id, k1, k2, item_id, b) for each document and item with a stretch that counts: the best over all their diagonals.

    Unequal tokens at a stretch's ends are cut off. ``b`` orders stretches: (n_equal, -n_overlap, -doc_start,
    -item_start). A document's tokens meet an item once, with a list of their diagonals.
    """
    slim = diagonals.groupBy("k1", "k2", "item").agg(F.collect_set("shift").alias("shifts"))
    items = items.select("item", "item_id", F.col("tokens").alias("theirs"))
    both = base.join(slim, ["k1", "k2"]).join(items, "item").withColumn("least", least_equal(F.size("theirs")))

    def judged(shift: Column) -> Column:
        start, item_start = F.greatest(F.lit(0), shift), F.greatest(F.lit(0), -shift)
        n = F.greatest(F.lit(0), F.least(F.size("tokens") - start, F.size("theirs") - item_start))
        same = F.zip_with(F.slice("tokens", start + 1, n), F.slice("theirs", item_start + 1, n), lambda a, b: a == b)
        return bound(same, lambda s: bound(stretch(s, F.col("least")), lambda f: F.when(f.isNotNull(), bound(F.slice(s, f["i"] + 1, f["n"]), lambda part: cut(part, start + f["i"], item_start + f["i"])))))

    def cut(part: Column, start: Column, item_start: Column) -> Column:
        lead, back = F.array_position(part, True).cast("int") - 1, F.array_position(F.reverse(part), True).cast("int") - 1
        return F.struct(F.size(F.filter(part, lambda x: x)).alias("n_equal"), (lead + back - F.size(part)).alias("o"), (-(start + lead)).alias("d"), (-(item_start + lead)).alias("i"))

    return both.select("id", "k1", "k2", "item_id", F.array_max(F.transform("shifts", judged)).alias("b")).where("b is not null")


def _search(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """(diagonals, documents' tokens, items, whether the diagonals are confirmed)."""
    items = common.written(benchmark_items(benchmark), "items")
    size = F.least(F.size("tokens"), F.lit(LONG_ITEM))
    sizes = [r[0] for r in items.select(size.alias("n")).distinct().collect()]  # at most LONG_ITEM values
    base = _documents(docs, id_col, text_col)
    if not sizes:
        return base.limit(0).select("id", "k1", "k2", F.lit(0).cast("long").alias("item"), F.lit(0).alias("shift")), base, items, True
    classes = sorted({masks_of(n) for n in sizes})
    own = [seeded(items.where(size.isin([n for n in sizes if masks_of(n) == c])), c) for c in classes]
    probe = common.written(reduce(DataFrame.unionByName, own).withColumnRenamed("pos", "item_pos"), "seeds")
    masks = tuple(sorted({m for c in classes for m in c}))
    near = probe.count() <= BROADCAST_SEEDS
    return common.written((_near_hits if near else _far_hits)(base, probe, masks), "diagonals"), base, items, near


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_key, id, item_id, doc_start, item_start, n_overlap, n_equal): the longest overlap of each document and item that share one.

    An overlap is a stretch of one diagonal in which PERCENT of the tokens are equal and at least
    LEAST_EQUAL, or PERCENT of the item's tokens where those are fewer; so an item of up to three
    tokens must occur whole and unchanged. ``row_key`` is the hash pair of id and text. Defined
    cases: null or empty texts and items have no tokens and never match; equal items are reported
    under the smallest id (null if they have none); rows that repeat give one result; texts of any
    length are read whole; of equally long overlaps the first in the document is reported; other
    columns are ignored.
    """
    diagonals, base, items, _ = _search(docs, benchmark, id_col, text_col)
    out = _judged(diagonals, base, items).groupBy("id", "k1", "k2", "item_id").agg(F.max("b").alias("b"))
    return out.select(
        F.struct("k1", "k2").alias("row_key"), F.col("id").alias(id_col), "item_id", (-F.col("b.d")).alias("doc_start"),
        (-F.col("b.i")).alias("item_start"), (-F.col("b.o")).alias("n_overlap"), F.col("b.n_equal").alias("n_equal"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that share an overlap with an item, as :func:`overlaps` defines it; all columns kept."""
    k1, k2 = common.fresh("k1", docs.columns), common.fresh("k2", docs.columns)
    diagonals, base, items, sure = _search(docs, benchmark, id_col, text_col)
    found = diagonals if sure else _judged(diagonals, base, items)
    dirty = common.written(found.select(F.col("k1").alias(k1), F.col("k2").alias(k2)).distinct(), "contaminated")
    keyed = docs.withColumns(dict(zip((k1, k2), row_keys(id_col, text_col))))
    return keyed.join(dirty, [k1, k2], "left_anti").drop(k1, k2)
