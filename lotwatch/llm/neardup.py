"""MinHash near-duplicate groups with min-max hashing.

Each permutation of the shingle hashes gives two values, its minimum and its maximum, so a
signature costs half the hash evaluations of plain MinHash. Bands of the signature propose
pairs; every pair is confirmed on the full shingle sets; confirmed links are joined to
components by star contraction. Texts with equal shingle sets become one class first, so a
group of exact copies costs one row per map task however large it is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from . import common

#: Bands of signature values. A pair of large sets at similarity 0.75 is missed with probability (1 - 0.75**6)**50 = 5e-5.
BANDS, ROWS = 50, 6
#: In small sets minimum and maximum aren't independent and more pairs would be missed (1.3e-3 at 3 of 4 shingles, 1.1e-4 at
#: 15 of 20). Sets of up to SHORT shingles have bands of 4 values (3e-10 at 3 of 4), and those of over SHORT * 0.75 the others,
#: so that any two sets that may be linked share one kind.
SHORT, SHORT_BANDS, SHORT_ROWS = 20, 75, 4
WIDTH = 5
#: Candidate ids are broadcast up to this many (8 bytes each), and shuffled beyond.
BROADCAST_IDS = 500_000
#: Leftover pairs of a bucket of up to this many classes are listed; larger ones are compared block by block.
BUCKET, BLOCK = 64, 128
#: Shingles that a block comparison lays out at a time.
CHUNK = 4096
_HASHER: common.WordHasher | None = None


def _hasher() -> common.WordHasher:
    global _HASHER
    _HASHER = _HASHER or common.WordHasher()
    return _HASHER


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles.

    Only A-Z is lower-cased and words are runs of bytes other than x20 and x09-x0D. A text of
    fewer than ``width`` words has its whole sequence as one shingle; one without words has none.
    """
    data, begin = common.joined([t.lower() for t in texts])
    start, _, word = _hasher().words(data)
    at = np.searchsorted(start, begin)
    coef = _hasher().inverse[1 : width + 1]
    with np.errstate(over="ignore"):
        n = max(0, len(word) - width + 1)
        run = np.zeros(n, np.uint64)
        for j in range(width):
            run += word[j : j + n] * coef[j]
        run = common.mixed(run)
        sets = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= width:
                sets.append(np.unique(run[a : b - width + 1]))
            elif b > a:
                whole = (word[a:b] * coef[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                sets.append(common.mixed(np.array([whole], np.uint64)))
            else:
                sets.append(np.zeros(0, np.uint64))
    return sets


def signatures(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS, seed: int = 7) -> np.ndarray:
    """One 64-bit key for each set and band, from the minima and maxima under bands*rows/2 permutations."""
    rng = np.random.default_rng(seed)
    perms = bands * rows // 2
    a = rng.integers(0, 2**31, perms, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    keys = np.zeros((len(sets), bands), np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return keys
    x = np.concatenate([sets[i] for i in full])
    x = (x >> np.uint64(32)).astype(np.uint32)
    start = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
    out = np.zeros((len(full), bands), np.uint64)
    with np.errstate(over="ignore"):
        v = np.empty_like(x)
        for p in range(perms):
            np.multiply(x, a[p], out=v)
            v ^= v >> np.uint32(15)
            band = out[:, p * 2 // rows]
            for part in (np.minimum, np.maximum):
                band[:] = common.mixed(band * common.PRIME + part.reduceat(v, start).astype(np.uint64) + np.uint64(1))
        out += np.arange(bands, dtype=np.uint64) * common.MIX2
    keys[full] = common.mixed(out)
    return keys


def band_keys(sets: list[np.ndarray], percent: int = 75) -> list[np.ndarray]:
    """The keys under which each set looks for others: by its size those of the short bands, of the long ones, or both."""
    n = np.array([len(s) for s in sets])
    short, long = np.flatnonzero((n > 0) & (n <= SHORT)), np.flatnonzero(100 * n > percent * SHORT)
    out = [np.zeros(0, np.uint64)] * len(sets)
    for which, keys in ((long, signatures([sets[i] for i in long])), (short, signatures([sets[i] for i in short], SHORT_BANDS, SHORT_ROWS, seed=8))):
        for i, k in zip(which, keys):
            out[i] = np.concatenate([out[i], k])
    return out


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """(ids, shingle sets) for a pack of texts at a time."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.binary()).fill_null(b"").to_pylist()
        for first, pack in common.packs(texts):
            yield ids.slice(first, len(pack)), shingle_sets(pack)


def _signed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = np.random.default_rng(3).integers(0, 2**63, 2, dtype=np.uint64)
        for ids, sets in _pieces(batches):
            with np.errstate(over="ignore"):
                digest = [np.array([common.mixed(s ^ k).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for k in key]
            columns = [ids, pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, digest), _lists(band_keys(sets, percent))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "n_shingles", "d1", "d2", "bands"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, sets in _pieces(batches):
        yield pa.RecordBatch.from_arrays([ids, _lists(sets)], ["node", "shingles"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets overlap enough."""
    both = (
        pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
        .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
        .select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("k"))
    )
    return both.where(F.lit(100) * F.col("k") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("k"))).select("a", "b")


def _block_links(percent: int):
    def links(rows: pd.DataFrame) -> pd.DataFrame:
        """A spanning set of the confirmed links between components among the rows of one pair of blocks."""
        rows = rows.drop_duplicates("node").sort_values("node")
        sets = [np.asarray(s) for s in rows["shingles"]]
        nodes, root = rows["node"].to_numpy(), rows["root"].to_numpy().copy()
        n = np.array([len(s) for s in sets])
        _, word = np.unique(np.concatenate(sets), return_inverse=True)
        owner, k = np.repeat(np.arange(len(sets)), n), np.zeros((len(sets), len(sets)))
        order = np.argsort(word, kind="stable")
        word, owner = word[order], owner[order]
        # Some thousand shingles at a time, so that memory doesn't grow with the sets.
        edge = np.searchsorted(word, np.arange(0, word[-1] + CHUNK + 1, CHUNK))
        for c, (lo, hi) in enumerate(zip(edge[:-1], edge[1:])):
            hold = np.zeros((len(sets), CHUNK), np.float32)
            hold[owner[lo:hi], word[lo:hi] - c * CHUNK] = 1
            k += hold @ hold.T
        k = np.rint(k)
        out = []
        for i, j in zip(*np.nonzero(np.triu(100 * k >= percent * (n[:, None] + n[None, :] - k), 1))):
            if root[i] != root[j]:
                out.append((nodes[i], nodes[j]))
                root[root == root[j]] = root[i]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return links


def _leftover(members: DataFrame, hot: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) between components of large buckets.

    Buckets that share a class form a cluster; a cluster's classes are dealt into size classes,
    a factor of 100/percent each (only equal and adjacent ones can hold a link), and blocks.
    Pairs of blocks are compared inside tasks: no pair is ever a row, no task holds more than two blocks.
    """
    cluster = components(hot.select(F.col("center").alias("a"), F.col("node").alias("b")))
    nodes = members.join(cluster.withColumnRenamed("root", "cluster"), "node", "left")
    inside = hot.select("node").union(hot.select(F.col("center"))).distinct()
    nodes = nodes.join(inside, "node", "left_semi").withColumn("cluster", F.coalesce("cluster", "node"))
    nodes = nodes.withColumn("grade", F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int"))
    nodes = common.written(nodes, "hot-nodes")
    mixed = nodes.groupBy("cluster").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("cluster")
    count = nodes.groupBy("cluster", "grade").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    side = lambda d, name: count.select("cluster", (F.col("grade") - d).alias("grade"), F.col("blocks").alias(name))
    nodes = (
        nodes.join(mixed, "cluster", "left_semi").join(count, ["cluster", "grade"])
        .join(side(1, "above"), ["cluster", "grade"], "left").join(side(-1, "below"), ["cluster", "grade"], "left")
        .withColumn("p", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    )
    none = F.expr("array_remove(array(named_struct('g', 0, 'up', 0, 'x', 0, 'y', 0)), named_struct('g', 0, 'up', 0, 'x', 0, 'y', 0))")
    cell = lambda g, up, x, y: F.struct(g.alias("g"), F.lit(up).alias("up"), x.alias("x"), y.alias("y"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    cells = F.concat(
        F.transform(upto("blocks"), lambda q: cell(F.col("grade"), 0, F.least(F.col("p"), q), F.greatest(F.col("p"), q))),
        F.when(F.col("above") > 0, F.transform(upto("above"), lambda q: cell(F.col("grade"), 1, F.col("p"), q))).otherwise(none),
        F.when(F.col("below") > 0, F.transform(upto("below"), lambda q: cell(F.col("grade") - 1, 1, q, F.col("p")))).otherwise(none),
    )
    dealt = nodes.select("node", "root", "cluster", F.explode(cells).alias("cell")).join(sets, "node")
    return dealt.groupBy("cluster", "cell").applyInPandas(_block_links(percent), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of ``docs``.

    Links are pairs with 100 * intersection >= percent * union of their 5-word shingle sets.
    Defined cases: a null or wordless text has an empty set and no link. Rows that share an id
    are one document with the links of all of them. A row without an id takes no part: its
    component is null and it is kept. Ties can't occur: the smallest id of a component is kept.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text"))
    signed = common.written(base.mapInArrow(_signed(percent), "node long, n_shingles long, d1 long, d2 long, bands array<long>"), "signed")
    known = signed.where("node is not null and n_shingles > 0")
    classes = common.written(known.groupBy("d1", "d2").agg(F.min("node").alias("rep")), "classes")
    rows = (
        known.join(classes.withColumnRenamed("rep", "node"), ["d1", "d2", "node"], "left_semi")
        .select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    )
    buckets = rows.groupBy("band").agg(F.min("node").alias("center"), F.count("*").alias("m"), F.min("n").alias("n_min"), F.max("n").alias("n_max")).where("m > 1")
    full = common.written(rows.join(buckets, "band").select("band", "node", "n", "center", "m"), "buckets")
    members = common.written(full.select("node", "n").distinct(), "members")
    ids = members.select("node").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    sets = common.written(base.join(ids, "node", "left_semi").mapInArrow(_sets, "node long, shingles array<long>"), "sets")
    sized = members.select(F.col("node").alias("center"), F.col("n").alias("n_center"))
    fits = lambda x, y: F.lit(100) * F.least(x, y) >= F.lit(percent) * F.greatest(x, y)
    star = (
        full.where("node != center").select(F.col("center"), "node", "n").distinct().join(sized, "center").where(fits(F.col("n"), F.col("n_center")))
        .select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    )
    links = common.written(_confirmed(star, sets, percent), "links")
    root = components(links)
    at = common.written(members.join(root, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root")), "rooted")
    placed = full.join(at.select("node", "root"), "node")
    open_ = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band")
    left = common.written(placed.join(open_, "band", "left_semi"), "open")
    few = left.where(F.col("m") <= BUCKET).select("band", "node", "n", "root")
    other = few.select("band", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))
    cross = (
        few.join(other, "band").where((F.col("node") < F.col("b")) & (F.col("root") != F.col("rb")) & fits(F.col("n"), F.col("nb")))
        .select(F.col("node").alias("a"), "b").distinct().join(star, ["a", "b"], "left_anti")
    )
    more = _confirmed(cross, sets, percent)
    hot = left.where(F.col("m") > BUCKET).select("node", "center").distinct()
    if not hot.isEmpty():
        more = more.unionByName(_leftover(at, hot, sets, percent))
    more = common.written(more, "more-links")
    if not more.isEmpty():
        older, root = root, components(links.unionByName(more))
        common.release(older)
    common.release(full, members, sets, links, at, left, more)
    named = classes.join(root, classes.rep == root.node, "left").select("d1", "d2", F.coalesce("root", "rep").alias("component_id"))
    # An id with several texts is one node: what its texts reach is one component, so the least of them is the answer.
    out = signed.where("n_shingles > 0 and node is not null").select("node", "n_shingles", "d1", "d2").join(named, ["d1", "d2"])
    rest = signed.where("n_shingles = 0 or node is null").select("node", "n_shingles", F.col("node").alias("component_id"))
    return (
        out.select("node", "n_shingles", "component_id").unionByName(rest)
        .select(F.col("node").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("node") == F.col("component_id"), F.lit(True)).alias("kept"))
    )
