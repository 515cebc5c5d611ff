"""Smaller operators of the inventory over the derived tables, one query each."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..config import RiskConfig
from ..functions import text
from ..operators import documents as docs
from ..operators import manufacturers as m
from ..operators import reports, rules, signals
from ..storage import written
from . import bindings as b
from . import names, risk


def manufacturer_names(spark, sf):
    """Ids with the name of the dimension, or themselves where it has none."""
    rows = b.t(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("manufacturer_id")).distinct()
    return rules.with_name(rows, b.makers(spark, sf).where("cast(id as int) % 2 = 0"))


def alternative_suppliers(spark, sf):
    """For every supply fact as an exposed county: the other suppliers of the brand there."""
    facts = written(b.supply(spark, sf), "supply")  # read for the exposures and for the offers
    exposed = facts.select(F.col("supplier_id").alias("manufacturer_id"), "active_ingredient", F.col("active_ingredient").alias("ingredient_key"), "county_id")
    return rules.alternative_suppliers(exposed, b.suppliers(spark, sf), facts)


def foreign_key_cascade(spark, sf):
    child = b.t(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("c"))
    parent = b.t(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("id"))
    return docs.enforce_reference(child, parent, "c").select("o_orderkey", "c")


def inn_lists(spark, sf):
    raw = F.array(F.concat(F.lit(" "), "p_name"), F.lit(""), F.lit("PARACETAMOL "), F.lit("Amoxycillin"))
    inn, kept = text.normalize_inn_list(raw)
    return b.t(spark, sf, "part").select("p_partkey", F.array_join(inn, "|").alias("inn"), F.array_join(kept, "|").alias("raw"))


def split_lists(spark, sf):
    cell = F.concat("p_brand", F.lit(" ;; "), "p_type", F.lit(";  "), F.col("p_size").cast("string"))
    return b.t(spark, sf, "part").select("p_partkey", F.array_join(text.split_list(cell), "|").alias("parts"), F.size(text.split_list(F.replace(cell, F.lit(";"), F.lit("\n")), "[\n,]")).alias("n"))


def mapped_severity(spark, sf):
    said = F.element_at(F.array(F.lit("Class I"), F.lit("Class II"), F.lit("Class III"), F.lit(""), F.lit("class i")), (F.col("p_partkey") % 5 + 1).cast("int"))
    said = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), said, F.lit("\t"))).otherwise(said)
    return b.t(spark, sf, "part").select("p_partkey", text.map_severity(said).alias("severity"))


def signal_texts(spark, sf):
    """Keys and actions; the disclaimer comes once."""
    kind = F.when(F.col("s_suppkey") % 2 == 0, "supply_chain_exposure").otherwise("repeat_violator")
    action = F.when(F.col("s_suppkey") % 4 == 0, F.concat("s_name", F.lit(signals.SYNTHETIC_SUFFIX))).otherwise(F.concat("s_name", F.lit("  ")))
    some = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name"))
    return b.t(spark, sf, "supplier").select("s_suppkey", signals.signal_key(kind, F.col("s_suppkey").cast("string"), some).alias("key"), signals.with_disclaimer(kind, action).alias("action"))


def changed_evidence(spark, sf):
    """The evidence of two runs: the time of computing doesn't count, the date of the run does."""
    found = risk.violators(spark, sf)
    one = signals.build_evidence(RiskConfig(), b.AS_OF, datetime(2001, 1, 1))
    same, other = signals.build_evidence(RiskConfig(), b.AS_OF, datetime(2001, 1, 2)), signals.build_evidence(RiskConfig(), b.AS_OF.replace(day=30), datetime(2001, 1, 1))
    return found.select("manufacturer_id", signals.evidence_changed(one, same).alias("by_time"), signals.evidence_changed(one, other).alias("by_date"))


def merged_signals(spark, sf):
    """Signals of merged manufacturers are resolved; the others stay active."""
    gone = b.makers(spark, sf).where("cast(id as int) % 5 = 0").select(F.col("id").alias("manufacturer_id"))
    out, _ = signals.resolve_for_merge(risk.stored(spark, sf), gone, risk.NOW)
    return out.select("manufacturer_id", "status")


def found_signals(spark, sf):
    """Point lookups: which ids exist."""
    kept = risk.stored(spark, sf).select("id", "manufacturer_id")
    ids = kept.select("id").unionByName(b.makers(spark, sf).select("id"))
    good, missing = signals.get_signals(ids, kept)
    return good.agg(F.count("*").alias("n")).withColumn("found", F.lit(True)).unionByName(missing.agg(F.count("*").alias("n")).withColumn("found", F.lit(False)))


def grown_aliases(spark, sf):
    """Aliases that a reconciliation without similarity adds to the known manufacturers."""
    dim = names.dimension(spark, sf)
    met = m.match_exact(b.raw_names(spark, sf), dim).select("raw", F.lit("exact").alias("action"), F.col("canonical_name").alias("canonical"), F.col("id").alias("manufacturer_id"))
    return m.grown(dim, met).select("id", "canonical_name", F.array_join(F.array_sort("aliases"), "|").alias("aliases"))


def backfilled(spark, sf):
    rows = b.t(spark, sf, "part").select(
        F.lit("s").alias("source_id"), F.col("p_partkey").cast("string").alias("source_url"), F.lit(None).cast("string").alias("document_id"), F.col("p_name").alias("title"),
        F.array(F.concat(F.upper("p_name"), F.lit(" SODIUM"))).alias("active_ingredients"), F.array("p_brand", "p_type").alias("manufacturers"), F.array().cast("array<string>").alias("product_names"), F.lit("class_1").alias("severity"), F.lit(b.AS_OF).alias("date_published"),
        F.when(F.col("p_partkey") % 2 == 0, F.lit(b.AS_OF.replace(day=1))).alias("date_effective"), F.struct(F.col("p_size").cast("string").alias("size"), F.col("p_type").alias("batch")).alias("raw_metadata"),
    )
    return docs.backfill(rows).select("source_url", "normalized_hash", F.array_join("active_ingredients_normalized", "|").alias("keys"))


def ingredient_dictionary(spark, sf):
    rows = b.t(spark, sf, "part").select("p_partkey", F.col("p_name").alias("raw_text"))
    return reports.dictionary_ingredients(rows, ["ring", "widget", "red", "anvil"]).select("p_partkey", F.array_join("found_ingredients", "|").alias("found"))


def dictionary_phrases(spark, sf):
    """First words and first three words of the English texts as a dictionary, found in all texts."""
    rows = b.t(spark, sf, "documents")
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    opening = rows.where("lang = 'en'").select(words.alias("w")).where("size(w) >= 3")
    entries = opening.select(F.explode(F.array(F.get("w", F.lit(0)), F.array_join(F.slice("w", 1, 3), "-"))).alias("entry"))
    found = reports.dictionary_matches(rows, entries, "doc_id", "text")
    return found.groupBy("doc_id").agg(F.count("*").alias("entries"), F.sum("n").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("entry")), "|")).alias("digest"))


def dictionary_names(spark, sf):
    """Names of parts, every other one an alias of its first part's number, in lists of two with a blank."""
    part = b.t(spark, sf, "part")
    table = part.where("p_partkey % 2 = 0").select(F.concat(F.lit(" "), F.upper("p_name")).alias("alias"), F.concat(F.lit("inn-"), F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("inn"))
    lists = part.select("p_partkey", F.array(F.concat("p_name", F.lit(" ")), F.lit(" "), F.col("p_type")).alias("names"))
    out = reports.normalized_by_table(lists, table, "p_partkey", "names")
    return out.select("p_partkey", F.array_join("normalized", "|").alias("inn"), F.array_join("raw", "|").alias("raw"))


PLANS = {
    "dictionary_phrases": (dictionary_phrases, r"""WITH w AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
opening AS (SELECT w FROM w WHERE lang = 'en' AND len(w) >= 3), entries AS (SELECT DISTINCT w[1] AS entry, w[1] AS phrase FROM opening UNION SELECT DISTINCT array_to_string(w[1:3], '-'), array_to_string(w[1:3], ' ') FROM opening),
said AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) AS phrase FROM w),
hits AS (SELECT doc_id, entry, count(*) AS n FROM said JOIN entries USING (phrase) GROUP BY ALL)
SELECT doc_id, CAST(count(*) AS BIGINT) AS entries, CAST(sum(n) AS BIGINT) AS n, md5(string_agg(entry, '|' ORDER BY entry)) AS digest FROM hits GROUP BY doc_id"""),
    "dictionary_names": (dictionary_names, """WITH a AS (SELECT lower(trim(p_name)) AS alias, min('inn-' || lpad(CAST(p_partkey AS VARCHAR), 12, '0')) AS inn FROM part WHERE p_partkey % 2 = 0 GROUP BY 1)
SELECT p_partkey, coalesce(x.inn, trim(p_name)) || '|' || coalesce(y.inn, trim(p_type)) AS inn, trim(p_name) || '|' || trim(p_type) AS raw
FROM part LEFT JOIN a x ON x.alias = lower(trim(p_name)) LEFT JOIN a y ON y.alias = lower(trim(p_type))"""),
    "manufacturer_names": (manufacturer_names, "SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS manufacturer_id, CASE WHEN l_suppkey % 2 = 0 THEN coalesce(s_name, CAST(l_suppkey AS VARCHAR)) ELSE CAST(l_suppkey AS VARCHAR) END AS canonical_name FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey"),
    "alternative_suppliers": (alternative_suppliers, f"WITH {b.SUPPLY_SQL} SELECT e.supplier_id AS manufacturer_id, e.active_ingredient, CAST(count(DISTINCT f.supplier_id) AS BIGINT) AS alternative_supplier_count FROM facts e JOIN facts f ON f.county_id = e.county_id AND f.active_ingredient = e.active_ingredient AND f.supplier_id <> e.supplier_id GROUP BY ALL"),
    "foreign_key_cascade": (foreign_key_cascade, "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS c FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')"),
    "inn_lists": (inn_lists, "SELECT p_partkey, p_name || '|acetaminophen|amoxicillin' AS inn, p_name || '|PARACETAMOL|Amoxycillin' AS raw FROM part"),
    "split_lists": (split_lists, "SELECT p_partkey, p_brand || '|' || p_type || '|' || p_size AS parts, 3 AS n FROM part"),
    "mapped_severity": (mapped_severity, "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'class_1' WHEN 1 THEN 'class_2' WHEN 2 THEN 'class_3' WHEN 4 THEN 'unclassified' WHEN 3 THEN CASE WHEN p_partkey % 3 = 0 THEN 'unclassified' END END AS severity FROM part"),
    "signal_texts": (signal_texts, f"""WITH k AS (SELECT *, CASE WHEN s_suppkey % 2 = 0 THEN 'supply_chain_exposure' ELSE 'repeat_violator' END AS kind FROM supplier)
SELECT s_suppkey, kind || '|' || s_suppkey || '|' || CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE '' END AS key, CASE WHEN s_suppkey % 2 = 0 THEN s_name || '{signals.SYNTHETIC_SUFFIX}' ELSE s_name || '  ' END AS action FROM k"""),
    "changed_evidence": (changed_evidence, f"SELECT manufacturer_id, false AS by_time, true AS by_date FROM ({risk.REPEAT_VIOLATORS})"),
    "merged_signals": (merged_signals, f"WITH {risk.OLD_SQL} SELECT manufacturer_id, CASE WHEN CAST(manufacturer_id AS INTEGER) % 5 = 0 THEN 'resolved' ELSE 'active' END AS status FROM old"),
    "found_signals": (found_signals, f"WITH {risk.OLD_SQL} SELECT CAST(count(*) AS BIGINT) AS n, true AS found FROM old UNION ALL SELECT CAST(count(*) AS BIGINT), false FROM supplier"),
    "grown_aliases": (grown_aliases, f"""WITH {names.KEYS_SQL}, {names.DIM_SQL}, met AS (SELECT raw, arg_max(id, ordinal) AS id FROM keyed JOIN dim USING (key) GROUP BY raw),
n AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, {names.DIM_NAME} AS canonical_name FROM supplier WHERE s_suppkey % 2 = 0)
SELECT n.id, n.canonical_name, array_to_string(list_sort(list_distinct(['Alias ' || n.id] || coalesce((SELECT list(raw) FROM met WHERE met.id = n.id AND raw <> n.canonical_name), []))), '|') AS aliases FROM n"""),
    "backfilled_documents": (backfilled, """SELECT CAST(p_partkey AS VARCHAR) AS source_url, sha256(array_to_string(['s', CAST(p_partkey AS VARCHAR), '', p_name, '', upper(p_name) || ' SODIUM', array_to_string(list_sort([p_brand, p_type]), ','), 'class_1', '2000-12-31', CASE WHEN p_partkey % 2 = 0 THEN '2000-12-01' ELSE '' END, '{"batch":"' || p_type || '","size":"' || p_size || '"}'], chr(31))) AS normalized_hash, p_name AS keys FROM part"""),
    "ingredient_dictionary": (ingredient_dictionary, r"SELECT p_partkey, array_to_string(list_filter(['anvil', 'red', 'ring', 'widget'], lambda w: regexp_matches(lower(p_name), '(^|[^a-z0-9])' || w || '([^a-z0-9]|$)')), '|') AS found FROM part"),
}
