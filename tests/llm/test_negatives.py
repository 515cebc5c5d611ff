"""Operator 12 against SQL and a brute-force version, with trees of few and of many anchors, and its defined cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from lotwatch.llm import negatives, queries


def brute(rows, every, positives=5, negatives_=3, low=50, high=95):
    """(anchor, positive, rank, negative, scores) from (id, label, vector) by sorting all scores."""
    import math

    floors = {(i, lab, tuple(math.floor(256 * x) for x in v)) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in v)}
    out = []
    for a, lab, v in (r for r in floors if r[0] % every == 0):
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in floors if i != a and len(v) == len(w))
        for s, p, _ in [x for x in scored if x[2] == lab][:positives]:
            fit = [(n, t) for t, n, other in scored if other != lab and low * -s <= 100 * -t <= high * -s]
            out += [(a, p, k + 1, n, -s, -t) for k, (n, t) in enumerate(fit[:negatives_])]
    return sorted(out)


def mined(spark, rows, every=5, **kw):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    return sorted(map(tuple, negatives.mine(df, F.col("vec_id") % every == 0, F.col("label"), **kw).collect()))


def test_query_by_sql(spark, sf_dir):
    got = oracle.rows_of(queries.op12_hard_negatives(spark, sf_dir))
    assert got == oracle.rows_of_sql(oracle.duck(sf_dir), queries.HARD_NEGATIVES_SQL) and len(got[1]) > 50


@pytest.mark.parametrize(("group", "block"), [(512, 4096), (7, 20)])
def test_clusters_by_brute_force(spark, monkeypatch, group, block):
    """Close clusters, where bounds exclude most candidates; a third of all rows under one label, copies and ties."""
    monkeypatch.setattr(negatives, "GROUP", group)
    monkeypatch.setattr(negatives, "BLOCK", block)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8)) * 3
    rows = [(k, int(k % 3 and k % 6), [float(x) for x in centres[k % 6] * (1 + k % 4 / 5) + rng.normal(size=8) / 20]) for k in range(240)]
    rows += [(300 + k, 0, rows[5 * k][2]) for k in range(30)]
    assert mined(spark, rows) == brute(rows, 5) != []


def test_bounds_skip_candidates():
    """On clusters, most scores are never computed; every bound holds."""
    import pandas as pd

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16)) * 300
    x = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(size=(2000, 16)))
    block = pd.DataFrame({"dim": [16], "n": [2000], "ids": [np.arange(2000).tobytes()], "labels": [(np.arange(2000) % 4).tobytes()], "vectors": [x.tobytes()]})
    anchors = negatives._tree(pd.DataFrame({"anchor": range(100), "anchor_id": range(0, 2000, 20), "label": [k % 4 for k in range(0, 2000, 20)], "vector": list(x[::20])}))
    met = negatives._Meeting(block.iloc[0], anchors)
    asked = 0
    for step, anchor, lower, upper in met.walk():
        truth = x @ np.array(anchor.vector)
        assert (lower <= truth).all() and (truth <= upper).all()
        rows = np.flatnonzero(upper >= np.partition(lower, 1990)[1990])
        asked += len(rows) if met.parents[step] >= 0 else 2000
        assert set(np.argsort(-truth)[:10]) <= set(rows.tolist())
        met.tighten(step, rows)
    assert asked < 0.4 * 100 * 2000


def test_spanning_tree_is_minimal():
    x = np.random.default_rng(1).normal(size=(40, 3))
    order, parent, edge = negatives.spanning_tree(x)
    assert sorted(order) == list(range(40)) and parent[order[0]] == -1
    pairs = sorted((float(np.linalg.norm(x[i] - x[j])), i, j) for i in range(40) for j in range(i))
    root, total = list(range(40)), 0.0
    for d, i, j in pairs:
        if root[i] != root[j]:
            total += d
            root = [root[i] if r == root[j] else r for r in root]
    assert abs(edge.sum() - total) < 1e-9


def test_cases(spark):
    rng = random.Random(2)
    vector = lambda n=4: [rng.uniform(-1, 2) for _ in range(n)]
    rows = [(k, rng.randrange(3), vector()) for k in range(60)]
    rows += [(70, None, vector()), (None, 1, vector()), (75, 1, None), (80, 1, [1.0, None, 2.0, 3.0]), (85, 1, [float("nan"), 1.0, 1.0, 1.0]), (90, 1, [float("inf")] * 4), (95, 1, [1e308] * 4)]
    rows += [(100 + k, k % 2, vector(3)) for k in range(12)] + [(200, 1, []), (201, 1, []), (202, 0, [])] + [rows[0], rows[7], (5, 2, vector()), (10, 1, vector())]
    got = mined(spark, rows)
    assert got == brute(rows, 5)
    assert (200, 201, 1, 202, 0, 0) in got
    assert mined(spark, []) == []
    huge = [(k, k % 2, [float(2 ** (20 + k % 3)), float(3**k % 1000) * 2.0**12]) for k in range(20)]  # sums of 54 bits and more
    assert mined(spark, huge) == brute(huge, 5) != []
    extra = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, label int, embedding array<double>, rank int, dim int, b int")
    assert sorted(map(tuple, negatives.mine(extra, F.col("vec_id") % 5 == 0, F.col("label")).collect())) == got
