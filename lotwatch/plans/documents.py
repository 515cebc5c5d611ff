"""Document tables, dates, hashes and links over the derived tables."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import documents as docs
from ..operators import procurement, reports
from ..sources import landed, ledger
from ..storage import scratch_path
from . import bindings as b


def latest_per_url(spark, sf):
    return docs.latest_per_url(b.observed(spark, sf)).select("id", "source_id", "source_url", "created_at")


def dedup_documents(spark, sf):
    """The kept documents, and the versions that stand for the others, with the text they had."""
    kept, versions = docs.dedup(b.observed(spark, sf), now=datetime(2001, 1, 1))
    out = versions.select("document_id", "replaced_id", "normalized_hash", F.md5("raw_text").alias("text"), F.col("superseded_at").cast("timestamp_ntz").alias("superseded_at"))
    return out.unionByName(kept.select(F.col("id").alias("document_id")), allowMissingColumns=True)


def duplicate_groups(spark, sf):
    return docs.duplicate_groups(b.observed(spark, sf))


def dedup_summary(spark, sf):
    return docs.dedup_summary(b.observed(spark, sf)).select(F.coalesce("source_id", F.lit("all")).alias("source_id"), "groups", F.col("surplus").cast("long").alias("surplus"))


def version_chain(spark, sf):
    return docs.version_chain(b.observed(spark, sf), "created_at, id").select("id", "previous_hash", "normalized_hash")


def unknown_urls(spark, sf):
    rows = b.observed(spark, sf)
    return docs.unknown_urls(rows.where(F.col("created_at") >= F.lit(date(2000, 1, 1))), rows.where(F.col("created_at") < F.lit(date(2000, 1, 1)))).select("id")


def unknown_content(spark, sf):
    rows = b.t(spark, sf, "documents").select("doc_id", text.source_hash(F.col("text")).alias("source_hash"))
    return docs.unknown_content(rows.where("doc_id % 2 = 1"), rows.where("doc_id % 2 = 0")).select("doc_id", "source_hash")


def _batch(spark, sf):
    """The later observations against the state that the earlier ones left; every 11th of an address can't be parsed, and some have no hash of their bytes."""
    known = F.when(F.length("id") % 5 > 0, F.sha2(F.concat_ws("|", "source_url", "normalized_hash").cast("binary"), 256))
    rows = b.observed(spark, sf).withColumn("source_hash", known)
    stored = docs.latest_per_url(rows.where(F.col("created_at") < F.lit(date(2000, 1, 1))))
    later = rows.where(F.col("created_at") >= F.lit(date(2000, 1, 1)))
    batch = later.withColumn("seq", F.expr("row_number() over (partition by source_url order by created_at, id)").cast("long")).withColumn("error", F.when(F.col("seq") % 11 == 3, "unreadable"))
    return stored, batch


def _upsert(spark, sf):
    return docs.upsert(*_batch(spark, sf), now=datetime(2001, 1, 1))


def upsert_documents(spark, sf):
    return _upsert(spark, sf)[3]


def upsert_log(spark, sf):
    """The outcome of each observation."""
    return _upsert(spark, sf)[2].select("id", "action")


def upsert_versions(spark, sf):
    """What updates replaced."""
    return _upsert(spark, sf)[1].select("source_id", "source_url", "normalized_hash", F.md5("raw_text").alias("text"), "seq")


def upserted_state(spark, sf):
    """The document table afterwards."""
    return _upsert(spark, sf)[0].select("id", "source_id", "source_url", "normalized_hash", F.md5("raw_text").alias("text"))


def bucketed_merge(spark, sf):
    """The same batch merged into a table in buckets; versions and log are those of its one commit."""
    root = scratch_path(spark, "ledger")
    stored, batch = _batch(spark, sf)
    ledger.load(stored, root, 16)
    ledger.merge_batch(batch, root, "q", 0, now=datetime(2001, 1, 1), landed=True)
    assert ledger.merge_batch(batch, root, "q", 0) is None  # the same batch again changes nothing
    out = ledger.read_documents(spark, root).select(F.lit("state").alias("kind"), "id", "source_id", "source_url", "normalized_hash", F.md5("raw_text").alias("text"))
    old = ledger.read_appended(spark, root, "versions").select(F.lit("version").alias("kind"), "source_id", "source_url", "normalized_hash", F.md5("raw_text").alias("text"))
    log = ledger.read_appended(spark, root, "log").select(F.lit("log").alias("kind"), "id", F.col("action").alias("text"))
    return out.unionByName(old, allowMissingColumns=True).unionByName(log, allowMissingColumns=True)


def ingest_counts(spark, sf):
    rows = b.observed(spark, sf).withColumn("action", F.when(F.expr("lag(id) over (partition by source_id, source_url order by created_at, id)").isNull(), "insert").otherwise("skip_known"))
    return docs.ingest_counts(rows)


def since_filter(spark, sf):
    since = dates.parse_since("30d", datetime(2000, 12, 31)).date()
    return docs.since_filter(b.observed(spark, sf), "created_at", since).select("id", "created_at")


def validated(spark, sf):
    rows = b.t(spark, sf, "documents").select("doc_id", F.upper("lang").alias("language"), F.when(F.col("doc_id") % 7 == 0, "global").when(F.col("doc_id") % 7 == 1, "K3").otherwise(F.col("lang")).alias("jurisdiction"),
        F.when(F.col("doc_id") % 5 == 0, "memo").otherwise("recall").alias("document_type"), F.when(F.col("doc_id") % 3 == 0, "class_2").alias("severity"))
    good, bad = docs.validate(rows)
    return good.select("doc_id", "jurisdiction", "language", F.lit("").alias("faults")).unionByName(bad.select("doc_id", "jurisdiction", "language", F.array_join("faults", ",").alias("faults")))


def content_hash(spark, sf):
    rows = b.t(spark, sf, "documents")
    return rows.select("doc_id", text.content_hash(F.col("source"), F.col("lang"), text.sorted_list(F.array("source", "lang")), F.col("n_chars")).alias("content_hash"), text.source_hash(F.col("text")).alias("source_hash"))


def duplicate_content(spark, sf):
    return docs.duplicate_content(b.t(spark, sf, "documents").select(F.col("doc_id").alias("id"), text.source_hash(F.col("text")).alias("source_hash")))


def extract_links(spark, sf):
    return landed.extract_links(b.t(spark, sf, "pages")).select("page_id", "pos", "text", "is_pdf", "is_download")


def link_categories(spark, sf):
    return docs.category_summary(docs.categorize_links(landed.extract_links(b.t(spark, sf, "pages")), compat=False)).select(F.coalesce("category", F.lit("all")).alias("category"), "n")


def safe_names(spark, sf):
    rows = b.t(spark, sf, "pages").select("page_id", F.col("url"))
    return rows.select("page_id", text.safe_name(F.col("url")).alias("name"))


def written_dates(spark, sf):
    """Dates of orders in several written forms, read back."""
    forms = ("yyyyMMdd", "d MMMM yyyy", "MMMM d, yyyy", "d/M/yyyy", "d.MMM yyyy")
    rows = b.t(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate"))
    shown = F.when(F.col("o_orderkey") % 6 == 5, F.lit("not a date"))
    for n, f in enumerate(forms):
        shown = shown.when(F.col("o_orderkey") % 6 == n, F.date_format("o_orderdate", f))
    rows = rows.withColumn("shown", shown)
    return rows.select("o_orderkey", F.coalesce(dates.parse_date(F.col("shown"), dates.COMPACT), dates.parse_date(F.col("shown"), dates.LISTING), dates.parse_detail_date(F.col("shown"))).alias("parsed"))


def keep_last(spark, sf):
    rows = b.t(spark, sf, "pages").select("url", F.col("page_id").alias("pos"))
    return docs.keep_last(rows.where("pos % 2 = 0"), rows.where("pos % 2 = 1").withColumn("url", F.regexp_replace("url", "[?#].*$", "")).unionByName(rows.where("pos % 4 = 0"))).select("url", "pos")


def orphan_children(spark, sf):
    child = b.t(spark, sf, "orders").select(F.col("o_orderkey"), F.col("o_custkey").cast("string").alias("c"))
    parent = b.t(spark, sf, "customer").where("c_mktsegment = 'BUILDING' or c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("id"))
    return docs.enforce_reference(child, parent, "c", "set null").select("o_orderkey", "c")


def missing_ingredients(spark, sf):
    rows = b.t(spark, sf, "documents").select(F.col("source").alias("source_id"), F.when(F.col("doc_id") % 3 == 0, F.array("lang")).otherwise(F.array().cast("array<string>")).alias("active_ingredients"))
    return reports.missing_ingredients(rows).select("source_id", "documents", "without")


def share_range(spark, sf):
    rows = b.t(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 50).alias("share_pct"))
    return procurement.check_shares(rows).select("c_custkey")


PAGE_LINKS = r"""tags AS (SELECT page_id, url AS page_url, regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>') AS found FROM pages),
links AS (SELECT page_id, page_url, generate_subscripts(found, 1) - 1 AS pos, unnest(found) AS tag FROM tags),
parts AS (SELECT page_id, pos, page_url, trim(regexp_extract(tag, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS href,
  trim(regexp_replace(regexp_replace(regexp_extract(tag, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS text FROM links)"""

UPSERT_SQL = f"""{b.OBSERVED_SQL},
stored AS (SELECT * FROM observed WHERE created_at < DATE '2000-01-01' QUALIFY row_number() OVER (PARTITION BY source_id, source_url ORDER BY created_at DESC, id) = 1),
later AS (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY created_at, id) AS seq FROM observed WHERE created_at >= DATE '2000-01-01'),
parsed AS (
  SELECT l.*, s.id AS stored_id, s.normalized_hash AS stored_hash, s.raw_text AS stored_text,
    s.id IS NULL AND (length(l.id) % 5 = 0 OR NOT EXISTS (SELECT 1 FROM stored k WHERE k.source_url = l.source_url AND k.normalized_hash = l.normalized_hash AND length(k.id) % 5 > 0)
      AND row_number() OVER (PARTITION BY l.source_url, l.normalized_hash, length(l.id) % 5 = 0 ORDER BY seq) = 1) AS opens,
    lag(l.normalized_hash) OVER w AS last_hash, lag(l.raw_text) OVER w AS last_text
  FROM later l LEFT JOIN stored s ON s.source_id = l.source_id AND s.source_url = l.source_url WHERE seq % 11 <> 3 WINDOW w AS (PARTITION BY l.source_id, l.source_url ORDER BY seq)),
opened AS (SELECT *, min(CASE WHEN opens THEN seq END) OVER (PARTITION BY source_id, source_url) AS opened, arg_min(CASE WHEN opens THEN id END, CASE WHEN opens THEN seq END) OVER (PARTITION BY source_id, source_url) AS opened_id FROM parsed),
against AS (SELECT *, CASE WHEN seq > coalesce(opened, -1) AND last_hash IS NOT NULL THEN last_hash ELSE stored_hash END AS old_hash, CASE WHEN seq > coalesce(opened, -1) AND last_hash IS NOT NULL THEN last_text ELSE stored_text END AS old_text FROM opened),
outcomes AS (
  SELECT id, source_id, source_url, seq, normalized_hash, raw_text, coalesce(stored_id, opened_id) AS stored_id, old_hash, old_text,
    CASE WHEN against.stored_id IS NOT NULL OR seq > opened THEN CASE WHEN normalized_hash = old_hash THEN 'skip_unchanged' ELSE 'update' END WHEN seq = opened THEN 'insert' ELSE 'skip_same_bytes' END AS action FROM against
  UNION ALL SELECT id, source_id, source_url, seq, normalized_hash, raw_text, NULL, NULL, NULL, 'error' FROM later WHERE seq % 11 = 3)"""

PLANS = {
    "latest_per_url": (latest_per_url, f"WITH {b.OBSERVED_SQL} SELECT id, source_id, source_url, created_at FROM observed QUALIFY row_number() OVER (PARTITION BY source_id, source_url ORDER BY created_at DESC, id) = 1"),
    "dedup_documents": (dedup_documents, f"""WITH {b.OBSERVED_SQL}, ranked AS (SELECT *, row_number() OVER w AS k, first_value(id) OVER w AS keeper FROM observed WINDOW w AS (PARTITION BY source_id, source_url ORDER BY created_at DESC, id))
SELECT keeper AS document_id, id AS replaced_id, normalized_hash, md5(raw_text) AS text, TIMESTAMP '2001-01-01' AS superseded_at FROM ranked WHERE k > 1
UNION ALL SELECT id, NULL, NULL, NULL, NULL FROM ranked WHERE k = 1"""),
    "duplicate_groups": (duplicate_groups, f"WITH {b.OBSERVED_SQL} SELECT source_id, source_url, CAST(count(*) AS BIGINT) AS n FROM observed GROUP BY ALL HAVING count(*) > 1"),
    "dedup_summary": (dedup_summary, f"WITH {b.OBSERVED_SQL}, g AS (SELECT source_id, source_url, count(*) AS n FROM observed GROUP BY ALL HAVING count(*) > 1) SELECT coalesce(source_id, 'all') AS source_id, CAST(count(*) AS BIGINT) AS groups, CAST(sum(n - 1) AS BIGINT) AS surplus FROM g GROUP BY ROLLUP (source_id)"),
    "version_chain": (version_chain, f"WITH {b.OBSERVED_SQL}, c AS (SELECT *, lag(normalized_hash) OVER (PARTITION BY source_id, source_url ORDER BY created_at, id) AS previous_hash FROM observed) SELECT id, previous_hash, normalized_hash FROM c WHERE previous_hash <> normalized_hash"),
    "unknown_urls": (unknown_urls, f"WITH {b.OBSERVED_SQL} SELECT id FROM observed o WHERE created_at >= DATE '2000-01-01' AND NOT EXISTS (SELECT 1 FROM observed p WHERE p.source_id = o.source_id AND p.source_url = o.source_url AND p.created_at < DATE '2000-01-01')"),
    "unknown_content": (unknown_content, "SELECT doc_id, sha256(text) AS source_hash FROM documents d WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id % 2 = 0 AND e.text = d.text)"),
    "upsert_documents": (upsert_documents, f"""WITH {UPSERT_SQL} SELECT source_id, CAST(count(*) FILTER (WHERE action = 'insert') AS BIGINT) AS added, CAST(count(*) FILTER (WHERE action = 'update') AS BIGINT) AS updated,
  CAST(count(*) FILTER (WHERE starts_with(action, 'skip')) AS BIGINT) AS skipped, CAST(count(*) FILTER (WHERE action = 'error') AS BIGINT) AS failed FROM outcomes GROUP BY 1"""),
    "upsert_log": (upsert_log, f"WITH {UPSERT_SQL} SELECT id, action FROM outcomes"),
    "upsert_versions": (upsert_versions, f"WITH {UPSERT_SQL} SELECT source_id, source_url, old_hash AS normalized_hash, md5(old_text) AS text, seq FROM outcomes WHERE action = 'update'"),
    "upserted_state": (upserted_state, f"""WITH {UPSERT_SQL}, changed AS (SELECT * FROM outcomes WHERE action IN ('insert', 'update') QUALIFY row_number() OVER (PARTITION BY source_id, source_url ORDER BY seq DESC) = 1)
SELECT coalesce(stored_id, id) AS id, source_id, source_url, normalized_hash, md5(raw_text) AS text FROM changed
UNION ALL SELECT id, source_id, source_url, normalized_hash, md5(raw_text) FROM stored s WHERE NOT EXISTS (SELECT 1 FROM changed c WHERE c.source_id = s.source_id AND c.source_url = s.source_url)"""),
    "bucketed_merge": (bucketed_merge, f"""WITH {UPSERT_SQL}, changed AS (SELECT * FROM outcomes WHERE action IN ('insert', 'update') QUALIFY row_number() OVER (PARTITION BY source_id, source_url ORDER BY seq DESC) = 1)
SELECT 'state' AS kind, coalesce(stored_id, id) AS id, source_id, source_url, normalized_hash, md5(raw_text) AS text FROM changed
UNION ALL SELECT 'state', id, source_id, source_url, normalized_hash, md5(raw_text) FROM stored s WHERE NOT EXISTS (SELECT 1 FROM changed c WHERE c.source_id = s.source_id AND c.source_url = s.source_url)
UNION ALL SELECT 'version', NULL, source_id, source_url, old_hash, md5(old_text) FROM outcomes WHERE action = 'update' UNION ALL SELECT 'log', id, NULL, NULL, NULL, action FROM outcomes"""),
    "ingest_counts": (ingest_counts, f"WITH {b.OBSERVED_SQL} SELECT source_id, CAST(count(DISTINCT source_url) AS BIGINT) AS added, CAST(0 AS BIGINT) AS updated, CAST(count(*) - count(DISTINCT source_url) AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS failed FROM observed GROUP BY 1"),
    "since_filter": (since_filter, f"WITH {b.OBSERVED_SQL} SELECT id, created_at FROM observed WHERE created_at > DATE '2000-12-01'"),
    "validated_documents": (validated, """WITH r AS (SELECT doc_id, upper(lang) AS language, upper(CASE doc_id % 7 WHEN 0 THEN 'global' WHEN 1 THEN 'K3' ELSE lang END) AS jurisdiction, doc_id % 5 = 0 AS memo FROM documents)
SELECT doc_id, jurisdiction, lower(language) AS language, concat_ws(',', CASE WHEN jurisdiction = 'K3' THEN 'jurisdiction' END, CASE WHEN memo THEN 'document_type' END) AS faults FROM r"""),
    "content_hash": (content_hash, "SELECT doc_id, sha256(concat_ws(chr(31), source, lang, array_to_string(list_sort([source, lang]), ','), n_chars)) AS content_hash, sha256(text) AS source_hash FROM documents"),
    "duplicate_content": (duplicate_content, "SELECT sha256(text) AS source_hash, min(doc_id) AS first_id, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1 HAVING count(*) > 1"),
    "extract_links": (extract_links, f"WITH {PAGE_LINKS} SELECT page_id, CAST(pos AS INTEGER) AS pos, text, regexp_matches(lower(href), '\\.pdf($|\\?)') AS is_pdf, contains(lower(href), '/download/') AS is_download FROM parts"),
    "link_categories": (link_categories, f"""WITH {PAGE_LINKS}, c AS (SELECT CASE
  WHEN contains(lower(href), 'guideline') OR contains(lower(text), 'guidelines') THEN 'GUIDELINES' WHEN contains(lower(href), 'policy') OR contains(lower(text), 'framework') THEN 'POLICIES'
  WHEN contains(lower(href), 'product') OR contains(lower(text), 'registration') THEN 'REGISTRATION' WHEN contains(lower(href), 'form') OR contains(lower(text), 'application') THEN 'APPLICATIONS'
  WHEN contains(lower(href), 'training') OR contains(lower(text), 'manual') THEN 'TRAINING' WHEN contains(lower(href), 'report') OR contains(lower(text), 'survey') THEN 'REPORTS'
  WHEN contains(lower(href), 'inspection') OR contains(lower(text), 'audit') THEN 'INSPECTION' ELSE 'OTHER' END AS category FROM parts)
SELECT coalesce(category, 'all') AS category, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY ROLLUP (category)"""),
    "safe_names": (safe_names, r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages), n AS (SELECT *, string_split(path, '/')[-1] AS base FROM p)
SELECT page_id, CASE WHEN regexp_matches(lower(base), '\.pdf$') AND NOT starts_with(lower(base), 'download') THEN base ELSE 'doc_' || substr(md5(url), 1, 8) || '.pdf' END AS name FROM n"""),
    "written_dates": (written_dates, "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS parsed FROM orders"),
    "keep_last": (keep_last, """WITH r AS (SELECT url, page_id AS pos FROM pages), a AS (SELECT url, pos, 0 AS batch FROM r WHERE pos % 2 = 0 UNION ALL SELECT regexp_replace(url, '[?#].*$', ''), pos, 1 FROM r WHERE pos % 2 = 1 UNION ALL SELECT url, pos, 1 FROM r WHERE pos % 4 = 0)
SELECT url, pos FROM a QUALIFY row_number() OVER (PARTITION BY url ORDER BY batch DESC, pos DESC) = 1"""),
    "orphan_children": (orphan_children, "SELECT o_orderkey, (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey = o_custkey AND (c_mktsegment = 'BUILDING' OR c_custkey % 2 = 0)) AS c FROM orders"),
    "missing_ingredients": (missing_ingredients, "SELECT source AS source_id, CAST(count(*) AS BIGINT) AS documents, CAST(count(*) FILTER (WHERE doc_id % 3 <> 0) AS BIGINT) AS without FROM documents GROUP BY 1"),
    "share_range": (share_range, "SELECT c_custkey FROM customer WHERE NOT (c_acctbal / 50 BETWEEN 0 AND 100)"),
}
