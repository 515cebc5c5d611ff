import random
import re

import numpy as np
import pytest

from lotwatch.llm import neardup


def words(text):
    lower = re.sub("[A-Z]", lambda c: c[0].lower(), text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]


def shingles(text):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    """id -> (set size, component) by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, s) in enumerate(sets):
        for j, u in sets[:n]:
            if s and u and 100 * len(s & u) >= 75 * len(s | u):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets}


def edited(text, n, rng):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus(prose):
    rng = random.Random(5)
    base = [prose(rng.randrange(3, 200), k) for k in range(60)]
    rows = list(base)
    for t in base[:30]:
        rows += [t] * rng.randrange(3) + [edited(t, rng.randrange(1, 4), rng) for _ in range(3)]
    hot = prose(150, 777)
    rows += [hot] * 40 + [edited(hot, rng.randrange(2, 7), rng) for _ in range(180)]  # buckets beyond the listed size
    shared = prose(60, 888)
    rows += [shared + " " + prose(40, 5000 + k) for k in range(90)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_equals_brute_force(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}
    assert got == brute(corpus)


def test_blocks_alone_find_all_links(spark, corpus, monkeypatch):
    monkeypatch.setattr(neardup, "BUCKET", 1)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    df = spark.createDataFrame(corpus[:250], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()}
    assert got == {k: v[1] for k, v in brute(corpus[:250]).items()}


def test_defined_cases(spark, hard_docs, no_docs):
    got = neardup.near_duplicates(hard_docs).collect()
    assert len(got) == hard_docs.count()
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got}
    assert by[1][1] == 0 and by[2][1] == 0 and by[7] == (1, 6, False) and by[6] == (1, 6, True)
    assert by[3] == (0, 3, True) and by[4] == (0, 4, True) and by[5] == (0, 5, True) and by[None][1] is None and by[None][2]
    assert [r["kept"] for r in got if r["doc_id"] == 0] == [True, True]
    assert neardup.near_duplicates(no_docs).count() == 0


def test_short_texts_lose_no_link(spark, prose):
    """Pairs at exactly 0.75 of very few shingles, and pairs on both sides of the sizes where the bands change."""
    rng, rows = random.Random(8), []
    for k in range(300):
        a = prose(7, 2 * k).split()
        rows += [a, [*a, "more"]]
    for k, n in enumerate([18, 19, 20, 22, 24, 25, 26, 27, 28, 40] * 6):
        a = prose(n, 9000 + k).split()
        rows += [a, [*a, *prose(n // 4 - 1, 5000 + k).split()], edited(" ".join(a), 1, rng).split()]
    rows = list(enumerate(map(" ".join, rows)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and sum(k != v[1] for k, v in got.items()) > 350


def test_block_comparison_lays_out_few_shingles(monkeypatch):
    import pandas as pd

    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 2**62, 3000))
    sets = [base, base[100:], base[:2000], np.unique(rng.integers(0, 2**62, 5000)), base[900:]]
    rows = pd.DataFrame({"node": range(5), "root": range(5), "shingles": sets})
    expect = neardup._block_links(75)(rows)
    monkeypatch.setattr(neardup, "CHUNK", 7)
    assert neardup._block_links(75)(rows).equals(expect) and sorted(map(tuple, expect.itertuples(index=False))) == [(0, 1)]


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    a, b = np.unique(base[:1800]), np.unique(base[200:])
    both = neardup.signatures([a, b], bands=400, rows=2)
    true = 1600 / 2000
    assert abs((both[0] == both[1]).mean() - true**2) < 0.08


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (5, 5)]
    got = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}
