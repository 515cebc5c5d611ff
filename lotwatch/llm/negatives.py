"""Hard negatives by bounds along spanning trees of anchors.

Scores are integer inner products. Anchors are dealt by the signs of random projections to groups
of a bounded size, and each group gets a minimum spanning tree by Euclidean distance. Candidates
are dealt in blocks. Where a group meets a block, the root's scores are computed; every other
anchor takes its parent's scores, or the bounds on them, and widens them by the length of the edge
times the candidate's norm (the inequality of Cauchy and Schwarz). Only candidates whose bounds
reach into the wanted window are scored again: those that may be among the best of the anchor's
label, then those that may be among the first below a positive. What no bound can exclude is
scored, so the result is exact whatever the bounds are worth.

Every group meets every block once in each of the two passes: all rows are candidates of all
anchors. Each meeting returns a few rows for each anchor, never its pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Anchors of a group, candidates of a block, at most (a block ends with its partition too).
GROUP, BLOCK = 512, 4096
#: Signs of projections by which anchors are dealt.
SIGNS = 62
#: Relative slack of bounds in double precision.
SLACK = 1e-9
#: Sums below this are exact in double precision.
EXACT = float(1 << 53)


def usable(vector: Column) -> Column:
    """Not null and every component a finite number."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def _floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components as floor(256 x), and the signs of random projections as a number."""
    planes: dict[int, np.ndarray] = {}
    for batch in batches:
        column = batch.column(2)
        with np.errstate(over="ignore"):  # what overflows takes no part
            at, x = column.offsets.to_numpy(), np.floor(256 * np.asarray(column.values.to_numpy(zero_copy_only=False), np.float64))
        sizes, code = np.diff(at), np.zeros(len(batch), np.int64)
        for dim in set(sizes.tolist()):
            if dim not in planes:
                planes[dim] = np.random.default_rng(dim).normal(size=(dim, SIGNS))
            rows = np.flatnonzero(sizes == dim)
            unit = np.array([x[at[r] : at[r + 1]] for r in rows], np.float64).reshape(len(rows), dim)
            unit = np.nan_to_num(unit, posinf=0, neginf=0)
            code[rows] = (unit / max(1.0, np.abs(unit).max(initial=0)) @ planes[dim] > 0) @ (np.int64(1) << np.arange(SIGNS - 1, -1, -1, dtype=np.int64))
        vectors = pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), pa.array(x[at[0] : at[-1]]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), vectors, pa.array(code)], ["vec_id", "label", "vector", "code"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of one length, up to BLOCK, in one row, numbered within the task."""
    held: dict[int, list] = {}
    part, made = TaskContext.get().partitionId(), itertools.count()

    def row(dim: int) -> pa.RecordBatch:
        ids, labels, vectors = zip(*held.pop(dim))
        data = [np.array(ids, np.int64), np.array(labels, np.int64), np.array(vectors, np.float64).reshape(len(ids), dim)]
        numbers = [pa.array([part], pa.int32()), pa.array([next(made)], pa.int32()), pa.array([dim], pa.int32()), pa.array([len(ids)])]
        return pa.RecordBatch.from_arrays([*numbers, *(pa.array([d.tobytes()]) for d in data)], ["part", "nth", "dim", "n", "ids", "labels", "vectors"])

    for batch in batches:
        at, x = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy()
        for k, (name, label) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            own = held.setdefault(int(at[k + 1] - at[k]), [])
            own.append((name, label, x[at[k] : at[k + 1]]))
            if len(own) == BLOCK:
                yield row(int(at[k + 1] - at[k]))
    for dim in list(held):
        yield row(dim)


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge): rows in the order in which the tree reaches them, each one's parent (-1: the root) and distance to it."""
    n = len(x)
    order, parent, edge = np.zeros(n, np.int64), np.full(n, -1), np.full(n, np.inf)
    open_, at = np.ones(n, bool), 0
    edge[0] = 0
    for k in range(n):
        order[k], open_[at] = at, False
        d = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        nearer = open_ & (d < edge)
        edge[nearer], parent[nearer] = d[nearer], at
        at = int(np.argmin(np.where(open_, edge, np.inf)))
    return order, parent, edge


def _tree(rows: pd.DataFrame) -> pd.DataFrame:
    """The group's anchors in tree order: ``step``, their parent's step, the edge."""
    rows = rows.sort_values(["anchor", "anchor_id"]).reset_index(drop=True)  # the same tree whenever the task is repeated
    x = np.array(rows["vector"].tolist(), np.float64).reshape(len(rows), -1)
    order, parent, edge = spanning_tree(x)
    step = np.empty(len(order), np.int64)
    step[order] = np.arange(len(order))
    return rows.assign(step=step, parent=np.where(parent < 0, -1, step[parent]), edge=edge)


class _Meeting:
    """A group's anchors against a block's candidates: bounds on all scores, in tree order, and exact scores of those asked for."""

    def __init__(self, block: pd.Series, anchors: pd.DataFrame):
        dim, n = int(block["dim"]), int(block["n"])
        self.ids, self.labels = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["labels"], np.int64)
        self.x = np.frombuffer(block["vectors"], np.float64).reshape(n, dim)
        self.norm = np.sqrt((self.x**2).sum(axis=1)) * (1 + SLACK)
        self.largest = np.abs(self.x).max(initial=0)
        anchors = anchors.sort_values("step")
        self.anchors, self.parents, self.edges = anchors, anchors["parent"].to_numpy(), anchors["edge"].to_numpy()
        self.vectors = np.array(anchors["vector"].tolist(), np.float64).reshape(len(anchors), dim)
        self.bounds: list = []

    def score(self, step: int, rows: np.ndarray) -> np.ndarray:
        """Exact scores: doubles where no sum can pass 53 bits, Python's integers otherwise."""
        a = self.vectors[step]
        if self.largest * np.abs(a).max(initial=0) * max(1, len(a)) < EXACT:
            return self.x[rows] @ a if len(rows) < len(self.x) else self.x @ a
        whole = [int(v) for v in a]
        return np.array([sum(int(v) * w for v, w in zip(self.x[r], whole)) for r in rows], object)

    def walk(self):
        """(step, anchor, lower, upper): bounds from the parent, to be tightened by the caller through ``tighten``."""
        every = np.arange(len(self.x))
        for step, anchor in enumerate(self.anchors.itertuples()):
            if self.parents[step] < 0:
                exact = self.score(step, every)
                self.bounds.append((exact, exact))
            else:
                lower, upper = self.bounds[self.parents[step]]
                wide = self.edges[step] * (1 + SLACK) * self.norm
                slack = SLACK * (np.abs(lower.astype(np.float64)) + np.abs(upper.astype(np.float64))) + SLACK
                down, up = lower.astype(np.float64) - wide - slack, upper.astype(np.float64) + wide + slack
                self.bounds.append((np.where(np.isnan(down), -np.inf, down), np.where(np.isnan(up), np.inf, up)))
            yield step, anchor, *self.bounds[step]

    def tighten(self, step: int, rows: np.ndarray) -> np.ndarray:
        """Score ``rows`` exactly; their bounds become the score. The exact scores are returned."""
        if self.parents[step] < 0:
            return self.bounds[step][0][rows]
        found = self.score(step, rows)
        lower, upper = self.bounds[step]
        near = found.astype(np.float64)
        room = SLACK * np.abs(near) if found.dtype == object else 0
        lower[rows], upper[rows] = near - room, near + room
        return found


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The first k by score, then by id."""
    if scores.dtype != object and len(scores) > k:
        bound = np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[scores >= bound], scores[scores >= bound]
    return sorted(zip(ids.tolist(), map(int, scores.tolist())), key=lambda p: (-p[1], p[0]))[:k]


def _long(score: int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, score))


def _positives(k: int):
    def run(blocks: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        """Each anchor's first k of its own label in the blocks."""
        out = []
        for _, block in blocks.iterrows() if len(anchors) else ():
            met = _Meeting(block, anchors)
            of = {label: np.flatnonzero(met.labels == label) for label in set(anchors["label"])}
            for step, anchor, lower, upper in met.walk():
                rows = of[anchor.label]
                rows = rows[met.ids[rows] != anchor.anchor_id]
                if len(rows) > k:  # the k-th largest lower bound is reached by k rows: what stays below it is out
                    least = np.partition(lower[rows], len(rows) - k)[len(rows) - k]
                    rows = rows[upper[rows] >= least]
                out += [(anchor.anchor, anchor.anchor_id, i, _long(s)) for i, s in _best(met.ids[rows], met.tighten(step, rows), k)]
        return pd.DataFrame(out, columns=["anchor", "anchor_id", "positive_id", "positive_score"]).astype({"anchor": "int64", "anchor_id": "int64", "positive_id": "int64", "positive_score": "int64"})

    return run


def _negatives(k: int, low: int, high: int):
    def run(blocks: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        """For each anchor and positive, the first k of another label in the blocks whose score lies in the positive's window."""
        out = []
        for _, block in blocks.iterrows() if len(anchors) else ():
            met = _Meeting(block, anchors)
            for step, anchor, lower, upper in met.walk():
                windows, wanted = [], np.zeros(len(met.x), bool)
                other = (met.labels != anchor.label) & (met.ids != anchor.anchor_id)
                for positive, score in zip(anchor.positive_ids, anchor.positive_scores):
                    least, most = -(-low * int(score) // 100), high * int(score) // 100
                    windows.append((positive, int(score), least, most))
                    sure = lower[other & (lower >= least) & (upper <= most)]
                    at_least = max(least, np.partition(sure, len(sure) - k)[len(sure) - k]) if len(sure) >= k else least
                    wanted |= (upper >= at_least) & (lower <= most)
                rows = np.flatnonzero(wanted & other)
                scores = met.tighten(step, rows)
                for positive, score, least, most in windows:
                    inside = (scores >= least) & (scores <= most)
                    out += [(anchor.anchor, anchor.anchor_id, positive, score, i, _long(s)) for i, s in _best(met.ids[rows[inside]], scores[inside], k)]
        names = ["anchor", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        return pd.DataFrame(out, columns=names).astype(dict.fromkeys(names, "int64"))

    return run


def _meet(blocks: DataFrame, n_blocks: int, anchors: DataFrame, n_groups: int, run, schema: str) -> DataFrame:
    """Every group of ``anchors`` (grp) with every block (b) of its length."""
    ranks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = blocks.withColumn("grp", ranks(n_groups))
    right = anchors.withColumn("b", ranks(n_blocks))
    return left.groupBy("grp", "b").cogroup(right.groupBy("grp", "b")).applyInPandas(_only_equal_lengths(run), schema)


def _only_equal_lengths(run):
    def meet(blocks: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        return run(blocks, anchors[anchors["dim"] == blocks["dim"].iloc[0]] if len(blocks) and len(anchors) else anchors.iloc[:0])

    return meet


def mine(
    embeddings: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of hard negatives.

    A row's score is the integer inner product of its components, as floor(256 x), with the
    anchor's. Positives are the anchor's first ``positives`` rows of its own label by score, ties by
    smaller id; for each, the first ``negatives`` rows of another label with low % <= score / positive
    score <= high % are ranked. Defined cases: rows with a null id, label or vector, or with a null
    or non-finite component (after scaling too), take no part; exact repeats of a row count once; rows that share an id
    are rows of their own, but no row is a positive or negative of an anchor with its id, and results
    of anchors of one id are told apart by nothing but their columns; only vectors of the anchor's
    own length are its candidates (length 0: all scores 0); scores are exact at any size, and one
    beyond 64 bits is given as the end of the range; an empty table gives an empty result; other
    columns are ignored.
    """
    spark = embeddings.sparkSession
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    given = embeddings.where(F.col(id_col).isNotNull() & label.isNotNull() & usable(F.col(vector_col)))
    rows = given.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    floors = rows.drop("asks").mapInArrow(_floors, "vec_id long, label long, vector array<double>, code long").where(usable(F.col("vector")))
    floors = common.written(floors.dropDuplicates(["vec_id", "label", "vector"]), "floors")
    asks = rows.where("asks").select("vec_id", "label").distinct()
    anchors = floors.join(asks, ["vec_id", "label"], "left_semi").withColumns({"dim": F.size("vector"), "anchor": F.xxhash64("vec_id", "label", "vector")})
    anchors = common.written(anchors.withColumnRenamed("vec_id", "anchor_id"), "anchors")
    n = anchors.count()
    if not n:
        return spark.createDataFrame([], result)
    # The first signs choose a cell; cells over the bound are cut by hash. Groups are numbered densely, one row of each cell.
    bits = max(0, int(np.ceil(np.log2(max(1, n / GROUP)))))
    cell = F.shiftright("code", SIGNS - bits).alias("cell") if bits else F.lit(0).cast("long").alias("cell")
    cells = anchors.groupBy("dim", cell).agg(F.ceil(F.count("*") / F.lit(GROUP)).cast("int").alias("parts"))
    before, n_groups = {}, 0
    for dim, number, parts in cells.orderBy("dim", "cell").collect():  # a row for each cell: n / GROUP of them
        before[dim, number] = n_groups
        n_groups += parts
    numbered = spark.createDataFrame([(d, c, b) for (d, c), b in before.items()], "dim int, cell long, first int").join(cells, ["dim", "cell"])
    share = F.pmod(F.xxhash64("anchor", F.lit(3)), F.col("parts")).cast("int")
    grouped = anchors.withColumn("cell", cell).join(numbered, ["dim", "cell"]).withColumn("grp", F.col("first") + share)
    grouped = grouped.select("grp", "anchor", "anchor_id", "label", "dim", "vector")
    trees = common.written(grouped.groupBy("grp").applyInPandas(_tree, "grp int, anchor long, anchor_id long, label long, dim int, vector array<double>, step long, parent long, edge double"), "trees")
    packed = common.written(floors.select("vec_id", "label", "vector").mapInArrow(_blocks, "part int, nth int, dim int, n long, ids binary, labels binary, vectors binary"), "blocks")
    starts, n_blocks = [], 0
    for part, count in packed.groupBy("part").count().orderBy("part").collect():  # a row for each task
        starts.append((part, n_blocks))
        n_blocks += count
    blocks = packed.join(F.broadcast(spark.createDataFrame(starts, "part int, before int")), "part").withColumn("b", F.col("before") + F.col("nth")).drop("part", "before", "nth")
    near = _meet(blocks, n_blocks, trees, n_groups, _positives(positives), "anchor long, anchor_id long, positive_id long, positive_score long")
    chosen = near.withColumn("r", F.expr("row_number() over (partition by anchor, anchor_id order by positive_score desc, positive_id)")).where(F.col("r") <= positives)
    lists = chosen.groupBy("anchor", "anchor_id").agg(F.collect_list("positive_id").alias("positive_ids"), F.collect_list("positive_score").alias("positive_scores"))
    asking = common.written(trees.join(lists, ["anchor", "anchor_id"], "left"), "asking")
    common.release(floors, anchors, trees)
    asking = asking.withColumns({c: F.coalesce(c, F.array().cast("array<long>")) for c in ("positive_ids", "positive_scores")})
    found = _meet(blocks, n_blocks, asking, n_groups, _negatives(negatives, low, high), "anchor long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by anchor, anchor_id, positive_id order by negative_score desc, negative_id)")).where(F.col("rank") <= negatives)
    out = common.written(ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    common.release(packed, asking)
    return out
