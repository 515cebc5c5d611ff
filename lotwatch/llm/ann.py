"""Approximate nearest neighbours by multiprobe p-stable hashing.

Every vector has a bucket in each of several tables: ``floor((a.x + b) / w)`` for a few Gaussian
directions ``a``. A query visits its own bucket and, in the order of their estimated chance of
success, buckets that differ by one step in some coordinates. Vectors met in any table are
candidates; they are compared by their exact distance on the original vectors.

Equal vectors are one class with its smallest ids, so copies are searched once. Vectors are hashed
once; the index holds each with its codes. Vectors and queries are then dealt by bucket to groups
of a bounded size, in one plan for all queries: a crowded bucket is dealt in blocks of vectors and
of queries, and within a group distances are computed block by block, so that no pair becomes a
row. A group returns no more than k + 1 classes for each query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Tables, directions in each, bucket width in units of the sample's typical nearest distance, probes in each table.
TABLES, DIRECTIONS, WIDTH, PROBES = 4, 12, 2.6, 600
#: Rows of the sample that sets the width, at most.
SAMPLE = 2000
#: Vectors and queries of one block of a crowded bucket, and index rows of one group, about.
VECTORS, QUERIES, GROUP_ROWS = 2048, 512, 8192
#: Vectors whose probes are made at a time.
PACK = 16


class Index:
    """The hash functions. Every vector has a code in each table; only the bucket width is fitted, on a sample."""

    def __init__(self, dim: int, width: float, tables: int = TABLES, directions: int = DIRECTIONS, probes: int = PROBES, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.tables, self.directions, self.probes, self.width = tables, directions, probes, width
        self.a = rng.normal(size=(dim, tables * directions))
        self.b = rng.uniform(0, width, tables * directions)
        self.mix = rng.integers(1, 2**62, directions, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = common.mixed(np.arange(tables, dtype=np.uint64) * common.PRIME + np.uint64(dim))
        self.order = probe_order(directions, probes)

    def _cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = ((x @ self.a + self.b) / self.width).reshape(len(x), self.tables, self.directions)
        cell = np.floor(y)
        return cell.astype(np.int64), y - cell

    def _fold(self, cell: np.ndarray) -> np.ndarray:
        """One number for each cell of (rows, tables, directions): another one in another table or dimension."""
        with np.errstate(over="ignore"):
            return common.mixed((cell.astype(np.uint64) * self.mix).sum(axis=-1, dtype=np.uint64) + self.salt)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables) bucket codes."""
        return self._fold(self._cells(x)[0])

    def probe_codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables, probes) codes of the buckets to visit, likeliest first."""
        cell, part = self._cells(x)
        m = self.directions
        gap = np.concatenate([part, 1 - part], axis=-1)  # to the lower, to the upper neighbour
        rank = np.argsort(gap, axis=-1)
        coordinate, delta = rank % m, np.where(rank < m, -1, 1)
        out = np.empty((*cell.shape[:2], len(self.order)), np.uint64)
        for n, chosen in enumerate(self.order):
            moved = cell.copy()
            for z in chosen:
                at = coordinate[..., z][..., None]
                np.put_along_axis(moved, at, np.take_along_axis(moved, at, -1) + delta[..., z][..., None], -1)
            out[..., n] = self._fold(moved)
        return out


def probe_order(m: int, count: int) -> list[tuple[int, ...]]:
    """The first ``count`` sets of steps by expected score: a step is named by the rank of its gap among all 2m.

    The expected squared gap of rank j is j(j+1) / (4(m+1)(m+2)) for the lower half of the ranks and its mirror
    image for the upper. Sets that would step both ways in one coordinate are left out.
    """
    e = np.array([j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, 2 * m + 1)])
    heap, out = [(e[0], (0,))], [()]
    while heap and len(out) < count:
        score, chosen = heapq.heappop(heap)
        if all(2 * m - 1 - z not in chosen for z in chosen):
            out.append(chosen)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (score + e[last + 1] - e[last], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (score + e[last + 1], (*chosen, last + 1)))
    return out


def usable(vector: Column) -> Column:
    """Not null, not empty, not all zero, every component a finite number."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(good, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def fit(vectors: DataFrame, dim: int, sample: int = SAMPLE) -> Index:
    """Bucket width from the median distance to the 10th nearest in a sample of up to ``sample`` distinct vectors."""
    rows = vectors.where(F.size("vector") == dim).orderBy("c1", "c2").limit(sample).select("vector").collect()
    x = np.array([r[0] for r in rows], np.float64)
    y = x[: min(200, len(x))]
    near = np.sqrt(np.maximum(0, np.sort((y**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * y @ x.T, axis=1)[:, min(10, len(x) - 1)]))
    positive = near[near > 0]
    return Index(dim, WIDTH * float(np.median(positive)) if len(positive) else 1.0)


def _coder(indexes: dict[int, Index], probe: bool):
    """The codes of each vector's buckets, or of all buckets that a query visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = PACK if probe else len(batch) or 1
            for first in range(0, len(batch), step):
                part = batch.slice(first, step)
                vectors = part.column(2).to_pylist()
                codes: list = [None] * len(part)
                for dim in {len(v) for v in vectors}:
                    which = [i for i, v in enumerate(vectors) if len(v) == dim]
                    x = np.array([vectors[i] for i in which], np.float64)
                    found = indexes[dim].probe_codes(x) if probe else indexes[dim].codes(x)
                    for i, c in zip(which, found.reshape(len(which), -1).view(np.int64)):
                        codes[i] = np.unique(c)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(codes, pa.list_(pa.int64()))], ["c1", "c2", "codes"])

    return run


def _matcher(k: int):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """The k + 1 nearest classes of each query among those that share a unit with it; ties go to the smaller id."""
        out = []
        if len(vectors) and len(queries):
            held, first = vectors["vector"].to_numpy(), vectors["first"].to_numpy()
            c1, c2 = vectors["c1"].to_numpy(), vectors["c2"].to_numpy()
            unit, row = np.concatenate(vectors["units"].to_numpy()), np.repeat(np.arange(len(vectors)), vectors["units"].map(len))
            order = np.argsort(unit, kind="stable")
            unit, row = unit[order], row[order]
            size = np.array([len(v) for v in held])
            stacked = {d: np.array(held[size == d].tolist(), np.float64) for d in set(size.tolist())}
            place = np.zeros(len(size), np.int64)
            for d in stacked:
                place[size == d] = np.arange((size == d).sum())
            for q1, q2, q, units in zip(queries["q1"], queries["q2"], queries["goal"], queries["units"]):
                units = np.sort(units)
                lo, hi = np.searchsorted(unit, units, "left"), np.searchsorted(unit, units, "right")
                n = hi - lo
                if not n.any():
                    continue
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                at = np.unique(row[at])
                at = at[size[at] == len(q)]
                d = np.sqrt(((stacked[len(q)][place[at]] - np.asarray(q, np.float64)) ** 2).sum(axis=1)) if len(at) else np.zeros(0)
                if len(d) > k + 1:
                    bound = np.partition(d, k)[k]
                    at, d = at[d <= bound], d[d <= bound]
                for i in np.lexsort((first[at], d))[: k + 1]:
                    out.append((q1, q2, c1[at[i]], c2[at[i]], first[at[i]], d[i]))
        return pd.DataFrame(out, columns=["q1", "q2", "c1", "c2", "first", "score"]).astype({"q1": "int64", "q2": "int64", "c1": "int64", "c2": "int64", "first": "int64", "score": "float64"})

    return run


def _met_by(vectors: DataFrame, queries: DataFrame, classes: DataFrame, groups: int, k: int) -> DataFrame:
    """(q1, q2, c1, c2, first, score) for vectors (unit, c1, c2) and queries (unit, q1, q2) that share a unit; both are in ``classes``.

    Units are dealt to groups; a vector goes once to each group that holds one of its units.
    """
    group = F.pmod(F.xxhash64("unit"), F.lit(groups)).cast("int").alias("g")
    asked = queries.select(group, "q1", "q2", "unit").groupBy("g", "q1", "q2").agg(F.collect_list("unit").alias("units"))
    dealt = vectors.select(group, "c1", "c2", "unit").groupBy("g", "c1", "c2").agg(F.collect_list("unit").alias("units")).join(classes.select("c1", "c2", "first", "vector"), ["c1", "c2"])
    whole = classes.select(F.col("c1").alias("q1"), F.col("c2").alias("q2"), F.col("vector").alias("goal"))
    asked = asked.join(whole, ["q1", "q2"])
    return dealt.groupBy("g").cogroup(asked.groupBy("g")).applyInPandas(_matcher(k), "q1 long, q2 long, c1 long, c2 long, first long, score double")


def _best(found: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(q1, q2, score, vec_id): the k + 1 nearest ids for each query vector."""
    top = found.distinct().withColumn("r", F.expr("row_number() over (partition by q1, q2 order by score, first)")).where(F.col("r") <= k + 1)
    ids = top.join(classes.select("c1", "c2", "ids"), ["c1", "c2"]).select("q1", "q2", "score", F.explode("ids").alias("vec_id"))
    return ids.withColumn("r", F.expr("row_number() over (partition by q1, q2 order by score, vec_id)")).where(F.col("r") <= k + 1).drop("r")


def search(embeddings: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", indexes: dict[int, Index] | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row among all other rows.

    A query that finds fewer than k candidates is answered again exactly, against all rows.
    Defined cases: rows with a null id, and vectors that are null, empty, zero or hold null or
    non-finite components, take no part; a query's candidates are the vectors of its own length;
    an id with several vectors counts once, at the nearest of them, as a candidate, and as a query
    is answered from the nearest of its own; no id is its own neighbour; ties go to the smaller id;
    an empty table gives an empty result; other columns are ignored. ``indexes`` gives the hash
    functions by length of the vectors; by default they are fitted.
    """
    spark = embeddings.sparkSession
    rows = embeddings.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.xxhash64(vector_col).alias("c1"), F.xxhash64(F.lit(1), F.col(vector_col)).alias("c2")
    )
    # A class keeps its k + 1 smallest ids: no query needs more of it. Ids are ranked without their vectors.
    slim = rows.select("c1", "c2", "vec_id").distinct().withColumn("r", F.expr("row_number() over (partition by c1, c2 order by vec_id)")).where(F.col("r") <= k + 1)
    ids = slim.groupBy("c1", "c2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("first", F.col("ids")[0])
    asking = common.written(rows.where("asks").select(F.col("vec_id").alias("query_id"), F.col("c1").alias("q1"), F.col("c2").alias("q2"), F.size("vector").alias("dim")).distinct(), "asking")
    dims = [r[0] for r in asking.select("dim").distinct().orderBy("dim").collect()]  # one for each length of vectors
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    own = rows.where(F.size("vector").isin(dims)).select("c1", "c2", F.col("vec_id").alias("first"), "vector").join(ids, ["c1", "c2", "first"]).dropDuplicates(["c1", "c2", "first"])
    classes = common.written(own.select("c1", "c2", "first", "ids", "vector"), "classes")
    indexes = indexes or {d: fit(classes, d) for d in dims}
    coded = classes.select("c1", "c2", "vector").mapInArrow(_coder(indexes, False), "c1 long, c2 long, codes array<long>")
    index = common.written(coded.select("c1", "c2", F.explode("codes").alias("code")), "index")
    heads = asking.select("q1", "q2").distinct()
    quests = classes.join(heads, (F.col("c1") == F.col("q1")) & (F.col("c2") == F.col("q2")), "left_semi").select("c1", "c2", "vector")
    probes = quests.mapInArrow(_coder(indexes, True), "c1 long, c2 long, codes array<long>").select(F.col("c1").alias("q1"), F.col("c2").alias("q2"), F.explode("codes").alias("code"))
    # Only buckets that exist are visited. A crowded one is dealt in blocks of vectors by blocks of queries.
    buckets = index.groupBy("code").agg(F.count("*").alias("n"))
    probes = common.written(probes.join(buckets, "code"), "probes")
    blocks = probes.groupBy("code").agg(F.ceil(F.max("n") / VECTORS).cast("int").alias("v"), F.ceil(F.count("*") / F.lit(QUERIES)).cast("int").alias("q"))
    blocks = common.written(blocks.withColumn("q", F.when(F.col("v") > 1, F.col("q")).otherwise(1)), "blocks")
    share = lambda c, n: F.pmod(F.xxhash64(F.col(c), F.lit(9)), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    unit = F.xxhash64("code", "vb", "qb").alias("unit")
    vectors = index.join(blocks, "code").withColumn("vb", share("c1", "v")).withColumn("qb", upto("q")).select(unit, "c1", "c2")
    wanted = probes.join(blocks, "code").withColumn("qb", share("q1", "q")).withColumn("vb", upto("v")).select(unit, "q1", "q2")
    n_index = index.count()
    found = _met_by(vectors, wanted, classes, max(8, n_index // GROUP_ROWS), k)
    best = common.written(_best(found, classes, k), "nearest")
    n_ids = classes.groupBy(F.size("vector").alias("dim")).agg(F.sum(F.size("ids")).alias("all"))
    have = asking.select("q1", "q2", "dim").distinct().join(best.groupBy("q1", "q2").agg(F.count("*").alias("n")), ["q1", "q2"], "left").join(F.broadcast(n_ids), "dim")
    short = common.written(have.where(F.coalesce("n", F.lit(0)) < F.least(F.lit(k + 1).cast("long"), F.col("all"))).select("q1", "q2", "dim"), "short")
    n_short = short.count()
    if n_short:
        vbs, qbs = -(-classes.count() // VECTORS), -(-n_short // QUERIES)
        unit = F.xxhash64("dim", "vb", "qb").alias("unit")
        sized = lambda d, n, c: d.withColumns({"vbs": F.lit(vbs), "qbs": F.lit(qbs)}).withColumn(n, share(c, f"{n}s"))
        vectors = sized(classes.withColumn("dim", F.size("vector")), "vb", "c1").withColumn("qb", upto("qbs")).select(unit, "c1", "c2")
        wanted = sized(short, "qb", "q1").withColumn("vb", upto("vbs")).select(unit, "q1", "q2")
        again = _best(_met_by(vectors, wanted, classes, max(8, vbs * qbs), k), classes, k)
        best = best.join(short, ["q1", "q2"], "left_anti").unionByName(again)
    # An id is met once, and not by itself.
    pairs = asking.select("query_id", "q1", "q2").join(best, ["q1", "q2"]).where("query_id != vec_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = pairs.withColumn("rank", F.expr("row_number() over (partition by query_id order by score, vec_id)")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
