"""Every query over the driver tables against its SQL."""

import pytest

import oracle
from lotwatch import plans

SQL = plans.oracle_sql()


def column(got, name):
    return [r[got[0].index(name)] for r in got[1]]


#: What has no SQL: a test of its own, or what must hold of the rows.
CHECKED = {
    "cluster_names": lambda got: len(got[1]) > 100 and set(column(got, "canonical")) < set(column(got, "raw")),  # and test_cluster_names_by_greedy_loop
}


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.duck(sf_dir)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_plan(spark, sf_dir, con, name):
    found = plans.queries()[name](spark, sf_dir)
    got = oracle.rows_of(found)
    if name in SQL:
        assert got == oracle.rows_of_sql(con, SQL[name])
    else:
        assert name in CHECKED and CHECKED[name](got)


def test_match_fuzzy_by_brute_force(spark, sf_dir):
    from lotwatch.operators import manufacturers as m
    from lotwatch.plans import names

    raw = {r["raw"]: r["key"] for r in names.normalized_names(spark, sf_dir).collect()}
    known = [(r["ordinal"], r["id"], r["canonical_name"]) for r in names.dimension(spark, sf_dir).collect()]
    key = {r["raw"]: r["key"] for r in spark.createDataFrame([(c,) for _, _, c in known], "raw string").select("raw", names.text.normalize_name(names.F.col("raw")).alias("key")).collect()}
    scored = {r: min((-m.token_set_ratio(k, key[c]), n, i, c) for n, i, c in known) for r, k in raw.items()}
    expect = sorted((r, i, c, round(-score, 6)) for r, (score, _, i, c) in scored.items() if -score >= m.THRESHOLD)
    assert sorted(map(tuple, names.match_fuzzy(spark, sf_dir).collect())) == expect
    # Every supplier with an even number is in the dimension.
    assert sum(score == 100 for *_, score in expect) >= len(known)


def test_cluster_names_by_greedy_loop(spark, sf_dir):
    """The query's rows against one pass over the names in input order."""
    from lotwatch.operators import manufacturers as m
    from lotwatch.plans import names

    F = names.F
    got = {r["raw"]: r["canonical"] for r in names.cluster_names(spark, sf_dir).collect()}
    over = m.overrides_table(spark, names.OVERRIDES)
    rows = names.part_names(spark, sf_dir)
    settled = {r["raw"]: r["canonical"] for r in m.match_override(rows, over).collect()}
    key = lambda c: names.text.normalize_name(F.col(c))
    listed = [(r["raw"], r["key"]) for r in rows.orderBy("ordinal").select("raw", key("raw").alias("key")).collect()]
    own = {r["c"]: r["key"] for r in over.select(F.col("canonical").alias("c")).select("c", key("c").alias("key")).collect()}
    canon, expect = [], {}
    for raw, k in listed:
        target = settled.get(raw) or next((c for c, x in canon if x == k), None)
        if target is None and canon:
            scores = [m.token_set_ratio(k, x) for _, x in canon]
            best = max(range(len(scores)), key=scores.__getitem__)
            target = canon[best][0] if scores[best] >= m.THRESHOLD else None
        expect[raw] = target = target or raw
        if all(c != target for c, _ in canon):
            canon.append((target, k if target == raw else own[target]))
    assert got == expect


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_kept_index_joins_new_names_only(spark, tmp_path):
    import functools
    import random

    from lotwatch.operators import manufacturers as m
    from lotwatch.operators import nameindex

    words = "alpha beta gamma delta omega pharma labs health care global east west".split()
    draw = random.Random(7)
    name = lambda: " ".join(draw.choices(words, k=draw.randint(1, 4))) + draw.choice(["", "s", " ltd", "x"])
    names, known = [name() for _ in range(300)] + [None, ""], [name() for _ in range(120)] + [""]
    left = lambda rows: spark.createDataFrame([(r,) for r in rows], "a string")
    right = lambda rows: spark.createDataFrame([(r,) for r in rows], "b string")
    found = lambda df: sorted((r["a"], r["b"], round(r["score"], 6)) for r in df.collect())
    root = f"{tmp_path}/index"
    for n, (a, b) in enumerate([(200, 90), (203, 90), (203, 100), (302, 121)], 1):
        assert nameindex.extend(left(names[:a]), right(known[:b]), root) == n
        assert found(nameindex.read_pairs(spark, root)) == found(m.similar_pairs(left(names[:a]), right(known[:b])))
    assert nameindex.extend(left(names[:50]), right(known), root) == 4  # nothing new, nothing written
    new = {n for n in names[200:203]} - set(names[:200])
    step = nameindex.read_pairs(spark, root).where("g = 2")
    assert {r["a"] for r in step.collect()} <= new
    assert {r["key"] for r in spark.read.parquet(f"{root}/postings/g=2").collect()} == new
    # An attempt that failed before the head is read by nobody; names that are gone give no pairs.
    spark.createDataFrame([("x", "y", 99.0)], "a string, b string, score double").write.parquet(f"{root}/pairs/g=5")
    assert found(nameindex.kept_pairs(left(names[:40]), right(known[:30]), root=root)) == found(m.similar_pairs(left(names[:40]), right(known[:30])))
    assert nameindex.rebuild(spark, root, f"{tmp_path}/again") == 1
    assert found(nameindex.read_pairs(spark, f"{tmp_path}/again")) == found(nameindex.read_pairs(spark, root))
    with pytest.raises(ValueError):
        nameindex.extend(left(names), right(known), root, 80.0)
    # A reconciliation through the index, with names that it hasn't seen.
    dim = spark.createDataFrame([(str(n), k, [], [], 1.0, n) for n, k in enumerate(dict.fromkeys(known[:120]))], "id string, canonical_name string, aliases array<string>, countries array<string>, confidence double, ordinal int")
    raw = spark.createDataFrame([(n,) for n in {*names[:300], "alpha betas gamma"}], "raw string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    none = m.overrides_table(spark, {})
    assert rows(m.resolve_names(raw, dim, none, pairs=functools.partial(nameindex.kept_pairs, root=root))) == rows(m.resolve_names(raw, dim, none))


def test_lines_are_dealt_once_for_recalls_and_their_parts(spark, sf_dir):
    """Without broadcasts: lines and parts meet where the lines were numbered, and a brand comes with the part."""
    from lotwatch.plans import bindings

    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = bindings.brand_recalls(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert plan.count("Exchange hashpartitioning") == 6  # lines, parts; suppliers and nations, each with what they meet
