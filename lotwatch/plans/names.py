"""Manufacturer and ingredient names over the derived tables."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..functions import text
from ..operators import manufacturers as m
from ..operators import nameindex, procurement
from ..storage import scratch_path
from . import bindings as b

OVERRIDES = {"Supplier Works": ["Supplier 00001 Ltd", "Supplier 00002"], "Customer House": ["CUSTOMER  00003", "Supplier 00001"]}
OVERRIDE_ROWS = ", ".join(f"('{c}', '{a}', {n})" for n, (c, aliases) in enumerate(OVERRIDES.items()) for a in [c, *aliases])
KEY = b.normalized_sql("raw")


def dimension(spark, sf):
    """Every second supplier as a known manufacturer, with one alias."""
    s = b.t(spark, sf, "supplier").where("s_suppkey % 2 = 0")
    return s.select(
        F.col("s_suppkey").cast("string").alias("id"), F.replace("s_name", F.lit("#0000"), F.lit(" ")).alias("canonical_name"), F.array(F.concat(F.lit("Alias "), F.col("s_suppkey").cast("string"))).alias("aliases"),
        F.array().cast("array<string>").alias("countries"), F.lit(1.0).alias("confidence"), F.col("s_suppkey").cast("int").alias("ordinal"),
    )


def normalized_names(spark, sf):
    return b.raw_names(spark, sf).select("raw", text.normalize_name(F.col("raw")).alias("key"))


def distinct_names(spark, sf):
    docs = b.raw_names(spark, sf).select(F.array("raw", F.lit(" "), "raw").alias("manufacturers"))
    return m.distinct_names(docs)


def match_override(spark, sf):
    return m.match_override(b.raw_names(spark, sf), m.overrides_table(spark, OVERRIDES))


def match_exact(spark, sf):
    return m.match_exact(b.raw_names(spark, sf), dimension(spark, sf)).select("raw", "id")


def first_in_group(spark, sf):
    """Without a dimension every name is new: the first of each key names the group."""
    found = m.resolve_names(b.raw_names(spark, sf), dimension(spark, sf).limit(0), m.overrides_table(spark, {}))
    return found.select("raw", F.col("canonical").alias("first"))


def resolved_names(spark, sf):
    """How each name is settled: override, exact, fuzzy or new."""
    return m.resolve_names(b.raw_names(spark, sf), dimension(spark, sf), m.overrides_table(spark, OVERRIDES)).select("raw", "action", "canonical", F.round(F.col("confidence"), 6).alias("confidence"))


def reconcile_counts(spark, sf):
    return m.reconcile_counts(m.resolve_names(b.raw_names(spark, sf), dimension(spark, sf), m.overrides_table(spark, OVERRIDES)))


def match_fuzzy(spark, sf):
    return m.match_fuzzy(b.raw_names(spark, sf), dimension(spark, sf)).withColumn("score", F.round("score", 6))


def match_fuzzy_kept(spark, sf):
    """As match_fuzzy through a kept index that is built in two steps; ``extension`` is the one that found the pair."""
    root, raw, dim = scratch_path(spark, "name-index"), b.raw_names(spark, sf), dimension(spark, sf)
    key = lambda c: text.normalize_name(F.col(c))
    nameindex.extend(raw.where("right(raw, 1) <> '7'").select(key("raw").alias("a")), dim.where("ordinal % 10 <> 4").select(key("canonical_name").alias("b")), root)
    best = m.match_fuzzy(raw, dim, pairs=functools.partial(nameindex.kept_pairs, root=root))
    found = nameindex.read_pairs(spark, root).select("a", "b", F.col("g").alias("extension"))
    return best.withColumns({"a": key("raw"), "b": key("canonical_name")}).join(found, ["a", "b"]).select("raw", "id", "canonical_name", F.round("score", 6).alias("score"), "extension")


def part_names(spark, sf):
    """Part names and types in several written forms, in the order of their first part."""
    end = F.element_at(F.array(F.lit(" Ltd"), F.lit(" LIMITED"), F.lit("s"), F.lit("")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return b.t(spark, sf, "part").select(F.concat("p_name", F.lit(" "), "p_type", end).alias("raw"), "p_partkey").groupBy("raw").agg(F.min("p_partkey").alias("ordinal"))


def cluster_names(spark, sf):
    return m.cluster_names(part_names(spark, sf), m.overrides_table(spark, OVERRIDES))


def documents(spark, sf):
    """Two manufacturers for each order: the suppliers of its number and of half of it."""
    return b.t(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.array((F.col("o_orderkey") % 97).cast("string"), (F.col("o_orderkey") % 10).cast("string")).alias("canonical_manufacturer_ids"))


def repointed(spark, sf):
    pairs = b.t(spark, sf, "supplier").where("s_suppkey < 10 and s_suppkey % 2 = 1").select(F.col("s_suppkey").cast("string").alias("source"), F.lit("0").alias("target"))
    return m.repoint(documents(spark, sf), pairs).select("id", F.array_join("canonical_manufacturer_ids", ",").alias("ids"))


def fully_displaced(spark, sf):
    before = documents(spark, sf)
    after = before.withColumn("canonical_manufacturer_ids", F.filter("canonical_manufacturer_ids", lambda x: ~x.isin("3", "14", "40")))
    return m.fully_displaced(before, after)


def normalized_ingredients(spark, sf):
    ends = ["", " Sodium", "  HYDROCHLORIDE", " citrate ", " sodium sulfate"]
    raw = F.concat(F.lit(" "), F.initcap("p_name"), F.element_at(F.array(*map(F.lit, ends)), (F.col("p_partkey") % 5 + 1).cast("int")))
    return b.t(spark, sf, "part").select("p_partkey", text.normalize_ingredient(raw).alias("key"))


def ingredient_cells(spark, sf):
    cell = F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit("mg tablets; and\nParacetamol "), F.lit("; "), "p_type")
    inn, raw = text.parse_ingredient_cell(cell)
    return b.t(spark, sf, "part").select("p_partkey", F.array_join(inn, "|").alias("inn"), F.array_join(raw, "|").alias("raw"))


def inferred_severity(spark, sf):
    said = F.concat("p_name", F.lit(" Class "), F.element_at(F.array(F.lit("I"), F.lit("ii"), F.lit("3"), F.lit("IV"), F.lit("x")), (F.col("p_partkey") % 5 + 1).cast("int")), F.lit(" Type C"))
    return b.t(spark, sf, "part").select("p_partkey", text.infer_severity(said).alias("severity"))


def parsed_titles(spark, sf):
    name, parts = text.parse_title(F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" ("), "p_brand", F.lit(", "), "p_type", F.lit(") "))).otherwise(F.col("p_name")))
    return b.t(spark, sf, "part").select("p_partkey", name.alias("name"), F.array_join(parts, "|").alias("parts"))


def trailing_country(spark, sf):
    cell = F.concat("s_name", F.element_at(F.array(F.lit(", Kenya"), F.lit(", Atlantis"), F.lit(""), F.lit(", India ")), (F.col("s_suppkey") % 4 + 1).cast("int")))
    return b.t(spark, sf, "supplier").select("s_suppkey", F.array_join(text.trailing_country(cell), "|").alias("country"))


def supplier_manufacturer(spark, sf):
    rows = b.t(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.replace("s_name", F.lit("#0000"), F.lit(" ")).alias("name"), F.when(F.col("s_suppkey") % 3 == 0, "distributor").otherwise("manufacturer").alias("role"))
    return procurement.resolve_supplier_manufacturer(rows, dimension(spark, sf)).select("id", "manufacturer_id")


def new_counties(spark, sf):
    nation = b.t(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    return procurement.new_counties(nation, nation.where("cast(id as int) < 20")).select("id", "name")


PART = "SELECT p_partkey, "
KEYS_SQL = f"{b.NAMES_SQL}, keyed AS (SELECT raw, {KEY} AS key FROM raw_names)"
DIM_NAME = "replace(s_name, '#0000', ' ')"
DIM_SQL = f"dim AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_suppkey AS ordinal, {b.normalized_sql(DIM_NAME)} AS key FROM supplier WHERE s_suppkey % 2 = 0)"
#: Token-set similarity of every key to every canonical's: the length of the longest common subsequence by rows of bits.
FUZZY_SQL = f"""{KEYS_SQL},
canon AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, {DIM_NAME} AS canonical_name, s_suppkey AS ordinal, {b.normalized_sql(DIM_NAME)} AS b FROM supplier WHERE s_suppkey % 2 = 0),
sides AS (SELECT DISTINCT list_sort(list_distinct(string_split(key, ' '))) AS x, key AS a FROM keyed WHERE key <> ''),
others AS (SELECT DISTINCT list_sort(list_distinct(string_split(b, ' '))) AS y, b FROM canon WHERE b <> ''),
split AS (SELECT a, b, list_sort(list_intersect(x, y)) AS same, list_sort(list_filter(x, lambda w: NOT list_contains(y, w))) AS only_a, list_sort(list_filter(y, lambda w: NOT list_contains(x, w))) AS only_b FROM sides, others),
lines_ AS (SELECT a, b, len(same) AS n, len(only_a) = 0 OR len(only_b) = 0 AS part, array_to_string(same, ' ') AS s, array_to_string(list_concat(same, only_a), ' ') AS l, array_to_string(list_concat(same, only_b), ' ') AS r FROM split),
close AS (SELECT * FROM lines_ WHERE (n > 0 AND part) OR 200 * least(length(l), length(r)) >= 92 * (length(l) + length(r)) OR 200 * length(s) >= 92 * (length(s) + least(length(l), length(r)))),
common AS (
  SELECT *, length(l) - bit_count(list_reduce(list_concat([(CAST(1 AS HUGEINT) << length(l)) - 1], list_transform(string_split(r, ''), lambda c: list_reduce(list_concat([CAST(0 AS HUGEINT)], list_transform(range(1, length(l) + 1), lambda i: CASE WHEN substr(l, CAST(i AS INTEGER), 1) = c THEN CAST(1 AS HUGEINT) << CAST(i - 1 AS INTEGER) ELSE CAST(0 AS HUGEINT) END)), lambda p, q: p + q))),
    lambda v, h: ((v + (v & h)) | (v - (v & h))) & ((CAST(1 AS HUGEINT) << length(l)) - 1))) AS lcs FROM close),
scores AS (SELECT a, b, CASE WHEN n > 0 AND part THEN 100.0 ELSE greatest(200.0 * lcs / (length(l) + length(r)), CASE WHEN n > 0 THEN greatest(200.0 * length(s) / (length(s) + length(l)), 200.0 * length(s) / (length(s) + length(r))) ELSE 0 END) END AS score FROM common),
best_match AS (SELECT a, id, canonical_name, score FROM scores JOIN canon USING (b) WHERE score >= 92 QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, ordinal) = 1)"""
OVER_SQL = f"over_ AS (SELECT canonical, ordinal, {b.normalized_sql('alias')} AS key FROM (VALUES {OVERRIDE_ROWS}) v(canonical, alias, ordinal))"

RESOLVED_SQL = f"""{FUZZY_SQL}, {DIM_SQL}, {OVER_SQL},
by_over AS (SELECT raw, arg_min(canonical, ordinal) AS canonical FROM keyed JOIN over_ USING (key) GROUP BY raw),
by_key AS (SELECT raw, arg_max(id, ordinal) AS id FROM keyed JOIN dim USING (key) GROUP BY raw),
settled AS (
  SELECT DISTINCT k.raw, k.key, o.canonical AS o, c.canonical_name AS e, f.canonical_name AS f, f.score,
    CASE WHEN o.canonical IS NOT NULL THEN 'override' WHEN e.id IS NOT NULL THEN 'exact' WHEN f.id IS NOT NULL THEN 'fuzzy' ELSE 'new' END AS kind
  FROM keyed k LEFT JOIN by_over o USING (raw) LEFT JOIN by_key e USING (raw) LEFT JOIN canon c ON c.id = e.id LEFT JOIN best_match f ON f.a = k.key),
named AS (SELECT *, min(CASE WHEN kind = 'new' THEN raw END) OVER (PARTITION BY key) AS lead FROM settled),
results AS (
  SELECT raw, CASE WHEN kind = 'new' AND raw <> lead THEN 'exact' ELSE kind END AS action, CASE kind WHEN 'override' THEN o WHEN 'exact' THEN e WHEN 'fuzzy' THEN f ELSE lead END AS canonical,
    round(CASE kind WHEN 'fuzzy' THEN score / 100 ELSE 1.0 END, 6) AS confidence FROM named)"""

PLANS = {
    "normalized_names": (normalized_names, f"WITH {KEYS_SQL} SELECT raw, key FROM keyed"),
    "distinct_names": (distinct_names, f"WITH {b.NAMES_SQL} SELECT DISTINCT raw FROM raw_names WHERE trim(raw) <> ''"),
    "match_override": (match_override, f"WITH {KEYS_SQL}, {OVER_SQL} SELECT raw, arg_min(canonical, ordinal) AS canonical FROM keyed JOIN over_ USING (key) GROUP BY raw"),
    "match_exact": (match_exact, f"WITH {KEYS_SQL}, {DIM_SQL} SELECT raw, arg_max(id, ordinal) AS id FROM keyed JOIN dim USING (key) GROUP BY raw"),
    "first_in_group": (first_in_group, f"WITH {KEYS_SQL} SELECT raw, min(raw) OVER (PARTITION BY key) AS first FROM keyed"),
    "resolved_names": (resolved_names, f"WITH {RESOLVED_SQL} SELECT raw, action, canonical, confidence FROM results"),
    "reconcile_counts": (reconcile_counts, f"WITH {RESOLVED_SQL} SELECT action, CAST(count(*) AS BIGINT) AS n FROM results GROUP BY 1"),
    "match_fuzzy": (match_fuzzy, f"WITH {FUZZY_SQL} SELECT raw, id, canonical_name, round(score, 6) AS score FROM keyed JOIN best_match ON a = key"),
    "match_fuzzy_kept": (match_fuzzy_kept, f"""WITH {FUZZY_SQL},
entered AS (SELECT key, min(CASE WHEN right(raw, 1) <> '7' THEN 1 ELSE 2 END) AS g FROM keyed GROUP BY key), canon_entered AS (SELECT b, min(CASE WHEN ordinal % 10 <> 4 THEN 1 ELSE 2 END) AS g FROM canon GROUP BY b)
SELECT raw, k.id, k.canonical_name, round(score, 6) AS score, CAST(greatest(e.g, c.g) AS INTEGER) AS extension FROM keyed JOIN best_match k ON k.a = key JOIN canon ON canon.id = k.id JOIN entered e USING (key) JOIN canon_entered c ON c.b = canon.b"""),
    "cluster_names": (cluster_names, None),
    "repointed_documents": (repointed, """WITH d AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey % 97 AS a, o_orderkey % 10 AS z FROM orders),
f AS (SELECT id, a, z, CASE WHEN a < 10 AND a % 2 = 1 THEN 0 ELSE a END AS fa, CASE WHEN z % 2 = 1 THEN 0 ELSE z END AS fz FROM d)
SELECT id, CASE WHEN (fa <> a OR fz <> z) AND fa = fz THEN CAST(fa AS VARCHAR) ELSE fa || ',' || fz END AS ids FROM f"""),
    "fully_displaced": (fully_displaced, "SELECT v AS manufacturer_id FROM (VALUES ('3'), ('14'), ('40')) t(v) WHERE EXISTS (SELECT 1 FROM orders WHERE CAST(o_orderkey % 97 AS VARCHAR) = v OR CAST(o_orderkey % 10 AS VARCHAR) = v)"),
    "normalized_ingredients": (normalized_ingredients, "SELECT p_partkey, p_name || CASE p_partkey % 5 WHEN 4 THEN ' sodium' ELSE '' END AS key FROM part"),
    "ingredient_cells": (ingredient_cells, PART + "p_name || '|acetaminophen|' || p_type AS inn, p_name || ' ' || p_size || 'mg tablets|Paracetamol|' || p_type AS raw FROM part"),
    "inferred_severity": (inferred_severity, PART + "CASE p_partkey % 5 WHEN 0 THEN 'class_1' WHEN 1 THEN 'class_2' WHEN 2 THEN 'class_3' ELSE 'unclassified' END AS severity FROM part"),
    "parsed_titles": (parsed_titles, PART + "p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN p_brand || '|' || p_type ELSE '' END AS parts FROM part"),
    "trailing_country": (trailing_country, "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Kenya' WHEN 3 THEN 'India' ELSE '' END AS country FROM supplier"),
    "supplier_manufacturer": (supplier_manufacturer, "SELECT CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_suppkey % 3 <> 0 AND s_suppkey % 2 = 0 THEN CAST(s_suppkey AS VARCHAR) END AS manufacturer_id FROM supplier"),
    "new_counties": (new_counties, "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation WHERE n_nationkey >= 20"),
}
