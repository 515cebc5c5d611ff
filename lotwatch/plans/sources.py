"""Sources, sinks and jobs over files and tables derived from the driver tables."""

from __future__ import annotations

from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import document_hash
from ..operators import documents as docs
from ..operators import manufacturers as m
from ..operators import procurement, reports
from ..sources import formats, landed, ledger, sinks
from ..storage import scratch_path, written
from ..streaming import jobs
from . import bindings as b
from . import names, risk
from .documents import PAGE_LINKS as LINKS_SQL

LISTED = "|"


def flat(column: str):
    return F.array_join(F.coalesce(column, F.array().cast("array<string>")), LISTED)


def landed_enforcement(spark: SparkSession, sf: str) -> str:
    """The folder of parts as enforcement records, landed JSON pages of a hundred and an empty one."""
    part = b.t(spark, sf, "part")
    record = F.to_json(F.struct(
        F.concat(F.lit("R-"), "p_partkey").alias("recall_number"), F.when(F.col("p_partkey") % 4 > 0, F.concat("p_name", F.lit(" impure"))).alias("reason_for_recall"), F.col("p_type").alias("product_description"),
        F.concat(F.lit(" "), "p_brand", F.lit(" ")).alias("recalling_firm"), F.element_at(F.array(F.lit("Class I"), F.lit("Class II "), F.lit("Other")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("classification"),
        F.when(F.col("p_partkey") % 5 > 0, F.date_format(F.date_add(F.lit(date(2000, 1, 1)), (F.col("p_partkey") % 300).cast("int")), "yyyyMMdd")).alias("report_date"),
        F.concat(F.lit("Kenya; "), "p_brand", F.lit(" ;")).alias("distribution_pattern"), F.struct(F.array(F.col("p_name"), F.lit(" "), F.lit("Paracetamol ")).alias("generic_name")).alias("openfda"),
    ))
    pages = part.select((F.col("p_partkey") / 100).cast("long").alias("page"), record.alias("r")).groupBy("page").agg(F.concat(F.lit('{"meta":{"results":{"total":1}},"results":['), F.array_join(F.collect_list("r"), ","), F.lit("]}")).alias("value"))
    empty = spark.range(1).select(F.lit(-1).cast("long").alias("page"), F.lit('{"meta":{"results":{"total":0}},"results":[]}').alias("value"))
    path = scratch_path(spark, "landed-json")
    pages.withColumn("page", F.col("page").cast("long")).unionByName(empty).repartition("page").write.partitionBy("page").text(path)
    return path


def enforcement(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return landed.read_enforcement_json(spark, landed_enforcement(spark, sf), b.AS_OF)


def enforcement_documents(spark, sf):
    found, errors = enforcement(spark, sf)
    out = found.select("source_url", "document_id", "title", flat("product_names").alias("products"), flat("active_ingredients").alias("ingredients"), flat("manufacturers").alias("firms"), "severity", "date_published", flat("regions_affected").alias("regions"))
    return out.unionByName(errors.select(F.col("error").alias("source_url")), allowMissingColumns=True)


def listing_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as rows of listing pages, a hundred to a page, each page with another table in front."""
    cell = lambda *parts: F.concat(F.lit("<td>"), *parts, F.lit("</td>"))
    o = b.t(spark, sf, "orders").where("o_orderkey is not null")
    day = F.when(F.col("o_orderkey") % 9 == 0, F.lit("soon")).when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "d MMMM yyyy")).otherwise(F.date_format("o_orderdate", "d/M/yyyy"))
    key = F.col("o_orderkey").cast("string")
    product = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('<a href="/recall/'), key, F.lit('">Product '), key, F.lit("</a>"))).otherwise(F.concat(F.lit("Product "), key))
    row = F.concat(F.lit("<tr>"), cell(F.lit("1")), cell(day), cell(F.lit("REF/"), key), cell(product), cell(F.lit("Paracetamol 500mg<br>and<br>Zinc")), cell(F.lit("B1, B2<br>B"), key), cell(F.lit("Maker &amp; Co, Kenya")), cell("o_orderpriority"), cell("o_orderstatus"), F.lit("</tr>"))
    rows = o.select((F.col("o_orderkey") / 100).cast("long").alias("page"), "o_orderkey", row.alias("row"))
    table = F.concat(F.lit("<table><tr><th>Menu</th></tr></table><table><tr><th>S/N</th><th>Date</th><th>Recall ref</th></tr><tr><td>short row</td></tr>"), F.array_join(F.col("x.row"), ""), F.lit("</table>"))
    pages = rows.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "row"))).alias("x"))
    return pages.select(F.concat(F.lit("http://listing.example/"), F.col("page").cast("string")).alias("url"), table.alias("html"))


def listing_rows(spark, sf):
    found = landed.extract_recall_rows(listing_pages(spark, sf))
    return found.select("page_url", "recall_ref", "product_name", "detail_url", "inn_text", "batch_text", "manufacturer_text", "reason_text", "status_text")


def listing_documents(spark, sf):
    found = landed.normalize_listing_rows(landed.extract_recall_rows(listing_pages(spark, sf)))
    return found.select("source_url", "document_id", "title", flat("active_ingredients").alias("ingredients"), flat("manufacturers").alias("firms"), "date_published", flat("regions_affected").alias("regions"), F.array_join("raw_metadata.batch_numbers", LISTED).alias("batches"))


def listing_cards(spark, sf):
    """Parts as cards of archive pages; the date stands some lines above the description, or nowhere."""
    p = b.t(spark, sf, "part")
    day = F.date_format(F.date_add(F.lit(date(2001, 2, 1)), (F.col("p_partkey") % 500).cast("int")), "d MMMM yyyy")
    lines = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("Recall<br>"), day, F.lit("<br>Class I<br>Brief Description<br>"), F.lit("1 January 1999"))).when(F.col("p_partkey") % 4 == 1, F.concat(day, F.lit("<br>a<br>b<br>c<br>d<br>e<br>f<br>brief description"))).otherwise(F.concat(day, F.lit("<br>no such line")))
    key = F.col("p_partkey").cast("string")
    card = F.concat(F.lit('<article class="dlp_document x"><h2 class="entry_title"><a href="http://d.example/'), key, F.lit('">'), "p_name", F.lit('</a></h2><p class="post_excerpt">'), lines, F.lit("</p></article><article><h2>other</h2></article>"))
    pages = p.select((F.col("p_partkey") / 100).cast("long").cast("string").alias("n"), card.alias("card")).groupBy("n").agg(F.array_join(F.collect_list("card"), "").alias("html"))
    found = landed.extract_listing_cards(pages.select(F.concat(F.lit("http://archive.example/"), "n").alias("url"), "html"))
    return found.select("detail_url", "title", "card_date")


def detail_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as detail pages: two orders of columns, headers in several spellings, sections beside and below their labels."""
    s = b.t(spark, sf, "supplier")
    key = F.col("s_suppkey")
    text = key.cast("string")
    day = F.when(key % 7 == 0, F.lit("unknown")).otherwise(F.date_format(F.date_add(F.lit(date(2002, 3, 1)), (key % 400).cast("int")), "d.MMMM yyyy"))
    head = lambda t: F.concat(F.lit("<td><strong>"), F.lit(t), F.lit("</strong></td>"))
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    firm, batch, kind = F.concat("s_name", F.lit("<br>1 Road<br>Town")), F.concat(F.lit("B"), text, F.lit("<br>C"), text), F.concat(F.lit("Class "), F.element_at(F.array(F.lit("I"), F.lit("II"), F.lit("x")), (key % 3 + 1).cast("int")))
    reg = F.when(key % 2 == 0, F.concat(F.lit("A/"), text)).otherwise(F.lit("N/A"))
    one = F.concat(F.lit("<tr>"), head("Company name"), head("Batch number(s)"), head("Recall Date"), head("Re-call classification"), head("Registration-number"), F.lit("</tr><tr>"), cell(firm), cell(batch), cell(day), cell(kind), cell(reg), F.lit("</tr>"))
    two = F.concat(F.lit("<tr>"), head("Registration number"), head("RECALL DATE"), head("Recall classification"), head("Company Name &amp; address"), head("Batch Number"), F.lit("</tr><tr>"), cell(reg), cell(day), cell(kind), cell(firm), cell(batch), F.lit("</tr>"))
    below = F.concat(F.lit("<p>see the <b>brief description</b> of the plant</p></div><p>between</p><div><p><strong>Brief Description</strong></p><p>first of "), text, F.lit("</p><p>second</p><p><b>Advice for healthcare professionals:</b> keep "), text, F.lit("</p><p>stray</p><p><strong>Reporting side effects</strong></p><p>elsewhere</p>"))
    beside = F.concat(F.lit("<p><strong>Brief description:</strong> all of "), text, F.lit("</p><p>stray</p><div><p><span><strong>Proposed action</strong></span></p><p>act "), text, F.lit("</p><ul><li>a list</li></ul></div><p>Copyright 2024</p>"))
    title = F.concat("s_name", F.when(key % 2 == 0, F.lit(" (Paracetamol, Zinc)")).otherwise(""))
    html = F.concat(F.lit("<h1><span>"), title, F.lit("</span></h1><table>"), F.when(key % 2 == 0, one).otherwise(two), F.lit("</table><div>"), F.when(key % 3 == 0, below).otherwise(beside), F.lit('</div><a class="document-library-pro-button" href="http://f.example/'), text, F.lit('.pdf">PDF</a>'))
    return s.select(F.concat(F.lit("http://d.example/s-"), text, F.lit("/")).alias("url"), html.alias("html"))


def details(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return landed.extract_recall_details(detail_pages(spark, sf))


def detail_documents(spark, sf):
    found, errors = details(spark, sf)
    out = found.select(
        "source_url", "document_id", "title", flat("active_ingredients").alias("ingredients"), flat("manufacturers").alias("firms"), "severity", "date_published", F.array_join("raw_metadata.batch_numbers", LISTED).alias("batches"),
        F.col("raw_metadata.manufacturer_address").alias("address"), F.col("raw_metadata.recall_reason").alias("reason"), F.col("raw_metadata.advice").alias("advice"), F.col("raw_metadata.pdf_url").alias("pdf_url"),
    )
    return out.unionByName(errors.select("source_url", F.col("error").alias("title")), allowMissingColumns=True)


def landed_documents(spark, sf):
    """All pages of the three sources in one document table: as they landed, then again (a third with another title), then from other addresses."""
    found, _ = enforcement(spark, sf)
    detail, errors = details(spark, sf)
    rows = landed.normalize_listing_rows(landed.extract_recall_rows(listing_pages(spark, sf)))
    seen = landed.observations(found).unionByName(landed.observations(rows)).unionByName(landed.observations(detail, errors, "detail"))
    # Ingredients are normalized once; only what is changed below is hashed again.
    parsed = written(docs.to_document(seen), "observations")
    hashed = lambda df: df.withColumn("normalized_hash", document_hash(df.schema))
    valid, _ = docs.validate(parsed.where("error is null"))
    again = valid.withColumns({"title": F.when(F.length("title") % 3 == 0, F.concat("title", F.lit(" again"))).otherwise(F.col("title")), "source_hash": F.sha2(F.concat("source_hash", F.lit("again")).cast("binary"), 256)})
    moved = valid.withColumn("source_url", F.concat("source_url", F.lit("?moved")))
    failed = parsed.where("error is not null")
    every = [df.withColumn("seq", F.lit(n).cast("long")) for n, df in enumerate((valid, hashed(again), hashed(moved), failed), 1)]
    incoming = every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3])
    incoming = incoming.withColumn("id", F.sha2(F.concat_ws("|", "source_id", "source_url").cast("binary"), 256))
    # The outcomes are written once, with what is read of them below; nothing else of the documents is shuffled.
    hold = lambda log: written(log.select("source_id", "source_url", "seq", "action", "stands", "before", "title", "date_published", "active_ingredients_normalized"), "outcomes")
    table, versions, log, _ = docs.upsert(incoming.drop("seq", "error").limit(0), incoming, hold=hold)
    state = table.select(F.lit("state").alias("kind"), "source_id", "source_url", "title", "date_published", F.get("active_ingredients_normalized", F.lit(0)).alias("note"))
    old = versions.select(F.lit("version").alias("kind"), "source_id", "source_url", F.coalesce(F.try_variant_get("raw_metadata", "$.batch_numbers[0]", "string"), F.try_variant_get("raw_metadata", "$.recall_number", "string")).alias("note"))
    acts = log.select(F.lit("log").alias("kind"), "source_id", "source_url", F.col("action").alias("note"))
    return state.unionByName(old, allowMissingColumns=True).unionByName(acts, allowMissingColumns=True)


def format_documents(spark, sf):
    """The landed files of three sources read as data sources, in small splits, on to documents and errors."""
    formats.register(spark)
    path = scratch_path(spark, "landed-pages")
    listing_pages(spark, sf).write.json(f"{path}/listing")
    detail_pages(spark, sf).write.json(f"{path}/detail")
    read = lambda name, folder: spark.read.format(f"lotwatch_{name}").option("splitbytes", 1 << 18).load(folder)
    # Documents and errors come of the same rows, so these are parsed once.
    records = written(read("enforcement", landed_enforcement(spark, sf)).select("record", "error"), "records")
    found, failed = landed.detail_documents(written(read("detail", f"{path}/detail").where("error is null"), "details"))
    every = [landed.enforcement_documents(records.where("error is null").select(F.parse_json("record").alias("record")), b.AS_OF), landed.normalize_listing_rows(read("listing", f"{path}/listing").where("error is null")), found]
    out = [df.select("source_id", "source_url", "title", "date_published", flat("active_ingredients").alias("ingredients")) for df in every]
    out.append(records.where("error is not null").select(F.lit("enforcement").alias("source_id"), F.col("error").alias("title")))
    out.append(failed.select(F.lit("detail").alias("source_id"), "source_url", F.col("error").alias("title")))
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), out)


def page_parts(spark, sf):
    """What the table function finds on listing and detail pages, from SQL: each page is parsed once."""
    formats.register(spark)
    pages = listing_pages(spark, sf).unionByName(detail_pages(spark, sf))
    value = "coalesce(get_json_object(x.fields, '$.recall_ref'), get_json_object(x.fields, '$.title'), get_json_object(x.fields, '$.url'))"
    return spark.sql(f"SELECT p.url, x.part, x.at, {value} AS value FROM {{pages}} p, LATERAL page_parts(p.url, p.html) x", pages=pages)


def procurement_files(spark: SparkSession, sf: str) -> str:
    """The procurement tables as CSV files."""
    path = scratch_path(spark, "procurement")
    b.counties(spark, sf).select("id", "name", F.lit("r").alias("region"), "population", F.lit(1).alias("health_facilities")).write.csv(f"{path}/counties.csv", header=True)
    s = b.t(spark, sf, "supplier")
    s.select(F.col("s_suppkey").cast("string").alias("id"), F.replace("s_name", F.lit("#0000"), F.lit(" ")).alias("name"), F.when(F.col("s_suppkey") % 3 == 0, "distributor").otherwise("manufacturer").alias("role"), F.concat(F.lit("Kenya, ,"), F.col("s_nationkey").cast("string")).alias("countries_served")).write.csv(f"{path}/suppliers.csv", header=True)
    f = b.supply(spark, sf).withColumns({"contract_start": F.when(F.length("supplier_id") > 1, "2000-01-05").otherwise("5 Jan"), "contract_end": F.lit("2001-02-30")})
    f.withColumn("share_pct", F.col("share_pct").cast("decimal(5,2)")).write.csv(f"{path}/county_supply.csv", header=True)
    return path


def csv_facts(spark, sf):
    got = landed.read_procurement_csv(spark, procurement_files(spark, sf))
    facts = got["county_supply"].select("id", "county_id", "supplier_id", F.col("share_pct").cast("double").alias("share_pct"), "contract_start", F.col("contract_end").isNull().alias("open"), F.lit("").alias("countries"))
    return facts.unionByName(got["suppliers"].select("id", flat("countries_served").alias("countries")), allowMissingColumns=True)


def loaded_procurement(spark, sf):
    """Half of the counties and of the suppliers are stored already, the counties under other ids."""
    raw = landed.read_procurement_csv(spark, procurement_files(spark, sf))
    known = raw["counties"].where("cast(id as int) < 12").withColumn("id", F.concat(F.lit("stored-"), "id"))
    suppliers = raw["suppliers"].where("cast(id as int) % 2 = 0").withColumn("manufacturer_id", F.lit("kept"))
    facts = raw["county_supply"].limit(0).withColumn("data_source", F.lit(""))
    out = procurement.load(raw, {"counties": known, "suppliers": suppliers, "county_supply": facts}, names.dimension(spark, sf), "v2")
    rows = out["county_supply"].select(F.lit("fact").alias("kind"), "id", F.col("county_id").alias("value"), F.col("data_source").alias("note"))
    rows = rows.unionByName(out["counties"].select(F.lit("county").alias("kind"), "id", F.col("name").alias("value"), F.lit("").alias("note")))
    return rows.unionByName(out["suppliers"].select(F.lit("supplier").alias("kind"), "id", F.col("manufacturer_id").alias("value"), F.lit("").alias("note")))


def provenance(spark, sf):
    rows = b.supply(spark, sf).withColumn("data_source", F.when(F.length("supplier_id") > 1, "v2").otherwise("v1"))
    return reports.provenance(rows)


def text_corpus(spark, sf):
    """Documents as text files, two hundred to a file, read back whole."""
    path = scratch_path(spark, "texts")
    rows = b.t(spark, sf, "documents").select((F.col("doc_id") / 200).cast("long").alias("file"), "doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]", " ").alias("value"))
    rows.repartition("file").sortWithinPartitions("file", "doc_id").select("file", "value").write.partitionBy("file").text(path)
    found = landed.read_text_corpus(spark, f"{path}/file=*")
    return found.select(F.md5("text").alias("digest"), F.length("text").cast("long").alias("characters"))


def snapshot(spark, sf):
    """Two versions of a table behind a pointer: readers see the second."""
    root = scratch_path(spark, "snapshot")
    rows = b.observed(spark, sf).select("id", "source_id", "created_at")
    sinks.write_snapshot(rows.limit(5), root, "1")
    sinks.write_snapshot(docs.since_filter(rows, "created_at", date(2000, 6, 30)), root, "2")
    return sinks.read_snapshot(spark, root).select("id", "source_id", "created_at", F.lit(sinks.current_version(spark, root)).alias("version"))


def history(spark, sf):
    """Events of two runs appended to one history."""
    root = scratch_path(spark, "history")
    rows = b.t(spark, sf, "events").select("event_id", "event_type")
    sinks.append_history(rows.where("event_id % 2 = 0"), root, date(2000, 1, 1))
    sinks.append_history(rows.where("event_id % 2 = 1"), root, date(2000, 1, 2))
    return spark.read.parquet(root).select("event_id", "event_type", F.col("run_date").cast("date").alias("run_date"))


def review_queue(spark, sf):
    """Names of the review band, written twice and read newest first."""
    path = scratch_path(spark, "review")
    found = written(m.resolve_names(b.raw_names(spark, sf), names.dimension(spark, sf), m.overrides_table(spark, names.OVERRIDES), 95.0, (80.0, 95.0)), "resolved")
    sinks.write_review(found, path, "2000-01-01")
    sinks.write_review(found, path, "2000-01-02")
    return sinks.read_review(spark, path).select("raw_name", "candidate_canonical", F.round("score", 6).alias("score"), "reviewed_at")


def ingested(spark, sf):
    """All observations as landed files, in two runs of a stream of several batches, into one table with its versions and log.

    An address is in one file of each run, so the batches may take the files in any order.
    """
    landing, root = scratch_path(spark, "landing"), scratch_path(spark, "ingested")
    rows = b.observed(spark, sf, 64).withColumn("source_hash", F.sha2(F.concat_ws("|", "source_id", "source_url", "normalized_hash").cast("binary"), 256))
    # Lines are dealt by address, so they are numbered and land without another shuffle: four files of a run, each of whole parts of that deal.
    rows = rows.withColumn("seq", F.expr("row_number() over (partition by source_url order by created_at, id)").cast("long"))
    ledger.load(rows.limit(0).drop("seq"), root, 16)

    def apply(batch: DataFrame, number: int) -> None:
        ledger.merge_batch(batch, root, "ingest", number, now=datetime(2001, 1, 1), landed=True)
        ledger.vacuum(spark, root)

    for part in (F.col("created_at") < F.lit(date(2000, 1, 1)), F.col("created_at") >= F.lit(date(2000, 1, 1))):
        rows.where(part).coalesce(4).write.mode("append").option("compression", "zstd").parquet(landing)
        jobs.stream_ingest(spark, landing, rows.schema.simpleString()[7:-1].replace(":", " "), apply, f"{root}-checkpoint", files_per_batch=2).awaitTermination()
    out = ledger.read_documents(spark, root).select(F.lit("state").alias("kind"), "id", "source_id", "source_url", "normalized_hash")
    old = ledger.read_appended(spark, root, "versions").select(F.lit("version").alias("kind"), F.col("seq").cast("string").alias("id"), "source_id", "source_url", "normalized_hash")
    log = ledger.read_appended(spark, root, "log").groupBy("source_id", "action").agg(F.count("*").cast("string").alias("id"))
    return out.unionByName(old).unionByName(log.select(F.lit("log").alias("kind"), "id", "source_id", F.col("action").alias("source_url"), F.lit("").alias("normalized_hash")))


def merged_manufacturers(spark, sf):
    """Two manufacturers of every six folded into a third, one of them by way of the other; an unknown id, an id with itself, a second target and a cycle are errors."""
    dim = names.dimension(spark, sf)
    pairs = dim.where("try_cast(id as int) % 6 > 0").select(F.col("id").alias("source"), (F.col("id").cast("int") - 2).cast("string").alias("target"))
    pairs = pairs.unionByName(spark.createDataFrame([("nobody", "0"), ("0", "0"), ("2", "4"), ("6", "8")], "source string, target string"))
    out = m.merge(dim, names.documents(spark, sf), risk.stored(spark, sf), pairs, risk.NOW)
    rows = out["manufacturers"].select(F.lit("manufacturer").alias("kind"), "id", flat("aliases").alias("value"))
    rows = rows.unionByName(out["documents"].select(F.lit("document").alias("kind"), "id", flat("canonical_manufacturer_ids").alias("value")))
    rows = rows.unionByName(out["signals"].groupBy("status").agg(F.count("*").cast("string").alias("value")).select(F.lit("signal").alias("kind"), F.col("status").alias("id"), "value"))
    return rows.unionByName(out["errors"].select(F.lit("error").alias("kind"), F.col("source").alias("id"), F.col("target").alias("value")))


def link_categories_compat(spark, sf):
    """With the slip in precedence: what isn't matched before is TRAINING."""
    return docs.category_summary(docs.categorize_links(landed.extract_links(b.t(spark, sf, "pages")), compat=True)).select(F.coalesce("category", F.lit("all")).alias("category"), "n")


ORDER_KEY = "CAST(o_orderkey AS VARCHAR)"
PLANS = {
    "enforcement_documents": (enforcement_documents, """SELECT 'enforcement:R-' || p_partkey AS source_url, 'R-' || p_partkey AS document_id, CASE WHEN p_partkey % 4 > 0 THEN p_name || ' impure' ELSE 'R-' || p_partkey END AS title, p_type AS products,
  p_name || '|acetaminophen' AS ingredients, p_brand AS firms, CASE p_partkey % 3 WHEN 0 THEN 'class_1' WHEN 1 THEN 'class_2' ELSE 'unclassified' END AS severity,
  CASE WHEN p_partkey % 5 > 0 THEN DATE '2000-01-01' + CAST(p_partkey % 300 AS INTEGER) ELSE DATE '2000-12-31' END AS date_published, 'Kenya|' || p_brand AS regions FROM part
UNION ALL SELECT 'no results', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL"""),
    "listing_rows": (listing_rows, f"""SELECT 'http://listing.example/' || (o_orderkey // 100) AS page_url, 'REF/' || o_orderkey AS recall_ref, 'Product ' || o_orderkey AS product_name, CASE WHEN o_orderkey % 3 = 0 THEN 'http://listing.example/recall/' || o_orderkey END AS detail_url,
  'Paracetamol 500mg' || chr(10) || 'and' || chr(10) || 'Zinc' AS inn_text, 'B1, B2' || chr(10) || 'B' || o_orderkey AS batch_text, 'Maker & Co, Kenya' AS manufacturer_text, o_orderpriority AS reason_text, o_orderstatus AS status_text FROM orders"""),
    "listing_documents": (listing_documents, f"""SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'http://listing.example/recall/' || o_orderkey ELSE 'http://listing.example/' || (o_orderkey // 100) || '#REF-' || o_orderkey END AS source_url, 'REF/' || o_orderkey AS document_id,
  'Product ' || o_orderkey || ' recall (REF/' || o_orderkey || ')' AS title, 'acetaminophen|Zinc' AS ingredients, 'Maker & Co, Kenya' AS firms, CAST(o_orderdate AS DATE) AS date_published, 'Kenya' AS regions, 'B1|B2|B' || o_orderkey AS batches FROM orders WHERE o_orderkey % 9 <> 0"""),
    "listing_cards": (listing_cards, "SELECT 'http://d.example/' || p_partkey AS detail_url, p_name AS title, CASE WHEN p_partkey % 4 = 0 THEN DATE '2001-02-01' + CAST(p_partkey % 500 AS INTEGER) END AS card_date FROM part"),
    "detail_documents": (detail_documents, """WITH s AS (SELECT *, s_suppkey AS k, CAST(s_suppkey AS VARCHAR) AS t, 'http://d.example/s-' || s_suppkey || '/' AS url FROM supplier)
SELECT url AS source_url, CASE WHEN k % 2 = 0 THEN 'A/' || t ELSE 'sahpra-s-' || t END AS document_id, s_name || CASE WHEN k % 2 = 0 THEN ' (Paracetamol, Zinc)' ELSE '' END AS title, CASE WHEN k % 2 = 0 THEN 'acetaminophen|Zinc' ELSE '' END AS ingredients, s_name AS firms,
  CASE k % 3 WHEN 0 THEN 'class_1' WHEN 1 THEN 'class_2' ELSE 'unclassified' END AS severity, DATE '2002-03-01' + CAST(k % 400 AS INTEGER) AS date_published, 'B' || t || '|C' || t AS batches, '1 Road' || chr(10) || 'Town' AS address,
  CASE WHEN k % 3 = 0 THEN 'first of ' || t || chr(10) || 'second' ELSE 'all of ' || t END AS reason, CASE WHEN k % 3 = 0 THEN 'keep ' || t ELSE 'act ' || t END AS advice, 'http://f.example/' || t || '.pdf' AS pdf_url FROM s WHERE k % 7 <> 0
UNION ALL SELECT url, NULL, 'cannot read the recall date unknown', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM s WHERE k % 7 = 0"""),
    "csv_facts": (csv_facts, f"""WITH {b.SUPPLY_SQL} SELECT id, county_id, supplier_id, CAST(share_pct AS DOUBLE) AS share_pct, CASE WHEN length(supplier_id) > 1 THEN DATE '2000-01-05' END AS contract_start, true AS open, '' AS countries FROM facts
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), NULL, NULL, NULL, NULL, NULL, 'Kenya|' || s_nationkey FROM supplier"""),
    "loaded_procurement": (loaded_procurement, f"""WITH {b.SUPPLY_SQL} SELECT 'fact' AS kind, id, CASE WHEN CAST(county_id AS INTEGER) < 12 THEN 'stored-' ELSE '' END || county_id AS value, 'v2' AS note FROM facts
UNION ALL SELECT 'county', CASE WHEN n_nationkey < 12 THEN 'stored-' ELSE '' END || n_nationkey, n_name, '' FROM nation
UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), CASE WHEN s_suppkey % 2 = 0 THEN 'kept' END, '' FROM supplier"""),
    "provenance": (provenance, f"WITH {b.SUPPLY_SQL} SELECT CASE WHEN length(supplier_id) > 1 THEN 'v2' ELSE 'v1' END AS data_source, CAST(count(*) AS BIGINT) AS n FROM facts GROUP BY 1"),
    "text_corpus": (text_corpus, r"""WITH f AS (SELECT string_agg(regexp_replace(coalesce(text, ''), '[\r\n]', ' ', 'g') || chr(10), '' ORDER BY doc_id) AS whole FROM documents GROUP BY doc_id // 200)
SELECT md5(whole) AS digest, CAST(length(whole) AS BIGINT) AS characters FROM f"""),
    "snapshot": (snapshot, f"WITH {b.OBSERVED_SQL} SELECT id, source_id, created_at, '2' AS version FROM observed WHERE created_at > DATE '2000-06-30'"),
    "history": (history, "SELECT event_id, event_type, CASE WHEN event_id % 2 = 0 THEN DATE '2000-01-01' ELSE DATE '2000-01-02' END AS run_date FROM events"),
    "review_queue": (review_queue, "WITH " + names.RESOLVED_SQL.replace("92 *", "80 *").replace(">= 92", ">= 80") + """
SELECT raw AS raw_name, f AS candidate_canonical, round(score, 6) AS score, day AS reviewed_at FROM settled, (VALUES ('2000-01-01'), ('2000-01-02')) d(day) WHERE kind = 'fuzzy' AND score < 95"""),
    "ingested": (ingested, f"""WITH {b.OBSERVED_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY created_at, id) AS seq FROM observed),
w AS (SELECT *, lag(normalized_hash) OVER a AS old_hash, first_value(id) OVER a AS first_id, row_number() OVER a AS k, count(*) OVER (PARTITION BY source_id, source_url) AS n FROM o WINDOW a AS (PARTITION BY source_id, source_url ORDER BY seq)),
acts AS (SELECT *, CASE WHEN k = 1 THEN 'insert' WHEN normalized_hash = old_hash THEN 'skip_unchanged' ELSE 'update' END AS action FROM w)
SELECT 'state' AS kind, first_id AS id, source_id, source_url, normalized_hash FROM acts WHERE k = n
UNION ALL SELECT 'version', CAST(seq AS VARCHAR), source_id, source_url, old_hash FROM acts WHERE action = 'update'
UNION ALL SELECT 'log', CAST(count(*) AS VARCHAR), source_id, action, '' FROM acts GROUP BY source_id, action"""),
    "merged_manufacturers": (merged_manufacturers, f"""WITH {risk.OLD_LEVELS}, dim AS (SELECT s_suppkey AS k, replace(s_name, '#0000', ' ') AS name FROM supplier WHERE s_suppkey % 2 = 0),
gone AS (SELECT k, name, k - k % 6 AS t FROM dim WHERE k % 6 > 0 AND k NOT IN (8, 10)), d AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey % 97 AS a, o_orderkey % 10 AS z FROM orders),
f AS (SELECT id, a, z, CASE WHEN a IN (SELECT k FROM gone) THEN a - a % 6 ELSE a END AS fa, CASE WHEN z IN (SELECT k FROM gone) THEN z - z % 6 ELSE z END AS fz FROM d)
SELECT 'manufacturer' AS kind, CAST(dim.k AS VARCHAR) AS id, 'Alias ' || dim.k || coalesce((SELECT string_agg('|' || name || '|Alias ' || k, '' ORDER BY CAST(k AS VARCHAR)) FROM gone WHERE t = dim.k), '') AS value FROM dim WHERE dim.k NOT IN (SELECT k FROM gone)
UNION ALL SELECT 'document', id, CASE WHEN (fa <> a OR fz <> z) AND fa = fz THEN CAST(fa AS VARCHAR) ELSE fa || ',' || fz END FROM (SELECT * FROM f)
UNION ALL SELECT 'signal', CASE WHEN CAST(manufacturer_id AS BIGINT) IN (SELECT k FROM gone) THEN 'resolved' ELSE 'active' END AS status, CAST(count(*) AS VARCHAR) FROM levels GROUP BY status
UNION ALL SELECT 'error', * FROM (VALUES ('nobody', '0'), ('0', '0'), ('2', '4'), ('6', '8'), ('8', '6')) UNION ALL SELECT 'error', '10', '8' FROM dim WHERE k = 10""".replace("|| ',' ||", "|| '|' ||")),
    "link_categories_compat": (link_categories_compat, f"""WITH {LINKS_SQL}, c AS (SELECT CASE
  WHEN contains(lower(href), 'guideline') OR contains(lower(text), 'guidelines') THEN 'GUIDELINES' WHEN contains(lower(href), 'policy') OR contains(lower(text), 'framework') THEN 'POLICIES'
  WHEN contains(lower(href), 'product') OR contains(lower(text), 'registration') THEN 'REGISTRATION' WHEN contains(lower(href), 'form') OR contains(lower(text), 'application') THEN 'APPLICATIONS' ELSE 'TRAINING' END AS category FROM parts)
SELECT coalesce(category, 'all') AS category, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY ROLLUP (category)"""),
}

_OF = {name: PLANS[f"{name}_documents"][1] for name in ("enforcement", "listing", "detail")}
PLANS["landed_documents"] = (landed_documents, f"""WITH e AS ({_OF["enforcement"]}), l AS ({_OF["listing"]}), d AS ({_OF["detail"]}),
s AS (SELECT 'enforcement' AS source_id, source_url, title, date_published, string_split(ingredients, '|')[1] AS ingredient, document_id AS batch FROM e WHERE document_id IS NOT NULL
  UNION ALL SELECT 'listing', source_url, title, date_published, string_split(ingredients, '|')[1], string_split(batches, '|')[1] FROM l
  UNION ALL SELECT 'detail', source_url, title, date_published, nullif(string_split(ingredients, '|')[1], ''), string_split(batches, '|')[1] FROM d WHERE date_published IS NOT NULL),
x AS (SELECT *, length(title) % 3 = 0 AS changed FROM s)
SELECT 'state' AS kind, source_id, source_url, CASE WHEN changed THEN title || ' again' ELSE title END AS title, date_published, lower(ingredient) AS note FROM x
UNION ALL SELECT 'version', source_id, source_url, NULL, NULL, batch FROM x WHERE changed
UNION ALL SELECT 'log', source_id, source_url, NULL, NULL, 'insert' FROM x
UNION ALL SELECT 'log', source_id, source_url, NULL, NULL, CASE WHEN changed THEN 'update' ELSE 'skip_unchanged' END FROM x
UNION ALL SELECT 'log', source_id, source_url || '?moved', NULL, NULL, 'skip_same_bytes' FROM x
UNION ALL SELECT 'log', 'detail', source_url, NULL, NULL, 'error' FROM d WHERE date_published IS NULL""")

PLANS["format_documents"] = (format_documents, f"""WITH e AS ({_OF["enforcement"]}), l AS ({_OF["listing"]}), d AS ({_OF["detail"]})
SELECT 'enforcement' AS source_id, CASE WHEN document_id IS NOT NULL THEN source_url END AS source_url, coalesce(title, source_url) AS title, date_published, ingredients FROM e
UNION ALL SELECT 'listing', source_url, title, date_published, ingredients FROM l UNION ALL SELECT 'detail', source_url, title, date_published, ingredients FROM d""")
PLANS["page_parts"] = (page_parts, """WITH l AS (SELECT o_orderkey AS k, 'http://listing.example/' || (o_orderkey // 100) AS url FROM orders),
d AS (SELECT s_suppkey AS k, 'http://d.example/s-' || s_suppkey || '/' AS url, s_name || CASE WHEN s_suppkey % 2 = 0 THEN ' (Paracetamol, Zinc)' ELSE '' END AS title FROM supplier)
SELECT url, 'listing' AS part, CAST(row_number() OVER (PARTITION BY url ORDER BY k) - 1 AS INTEGER) AS at, 'REF/' || k AS value FROM l
UNION ALL SELECT url, 'link', CAST(row_number() OVER (PARTITION BY url ORDER BY k) - 1 AS INTEGER), 'http://listing.example/recall/' || k FROM l WHERE k % 3 = 0
UNION ALL SELECT url, 'detail', 0, title FROM d UNION ALL SELECT url, 'link', 0, 'http://f.example/' || k || '.pdf' FROM d""")
