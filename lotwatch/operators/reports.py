"""Reports over documents, manufacturers and signals."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..storage import written
from .rules import top_ingredient


def document_manufacturers(docs: DataFrame) -> DataFrame:
    """The bridge (id, manufacturer_id, ...): joins on array membership go through it, never through a test on the array."""
    return docs.withColumn("manufacturer_id", F.explode(F.array_distinct("canonical_manufacturer_ids"))).drop("canonical_manufacturer_ids")


def linked_documents(manufacturers: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, documents): every manufacturer, also those without a document."""
    counts = document_manufacturers(docs.select("id", "canonical_manufacturer_ids")).groupBy("manufacturer_id").agg(F.count("*").alias("n"))
    return manufacturers.select("id").join(counts, F.col("id") == F.col("manufacturer_id"), "left").select("id", F.coalesce("n", F.lit(0)).alias("documents"))


def manufacturer_report(manufacturers: DataFrame, docs: DataFrame, signals: DataFrame) -> DataFrame:
    """(id, canonical_name, recalls, sources, severity): documents, distinct sources, and the severity of the active repeat-violator signal."""
    bridge = document_manufacturers(docs.select("id", "source_id", "canonical_manufacturer_ids"))
    counts = bridge.groupBy("manufacturer_id").agg(F.count("*").alias("recalls"), F.countDistinct("source_id").alias("sources"))
    active = signals.where("status = 'active' and kind = 'repeat_violator'").groupBy("manufacturer_id").agg(F.min("severity").alias("severity"))
    named = manufacturers.select("canonical_name", F.col("id").alias("manufacturer_id"))
    out = named.join(counts, "manufacturer_id", "left").join(active, "manufacturer_id", "left")
    return out.select(F.col("manufacturer_id").alias("id"), "canonical_name", F.coalesce("recalls", F.lit(0)).alias("recalls"), F.coalesce("sources", F.lit(0)).alias("sources"), "severity")


def orphan_signals(signals: DataFrame, manufacturers: DataFrame) -> DataFrame:
    """Signals whose manufacturer isn't in the dimension."""
    return signals.where("manufacturer_id is not null").join(manufacturers.select(F.col("id").alias("manufacturer_id")), "manufacturer_id", "left_anti")


def top_manufacturers(docs: DataFrame, manufacturers: DataFrame, as_of: date, n: int = 25) -> DataFrame:
    """The named manufacturers with most recalls in 24 calendar months."""
    recent = docs.where((F.col("document_type") == "recall") & (F.col("date_published") >= F.add_months(F.lit(as_of), -24)))
    counts = document_manufacturers(recent.select("id", "canonical_manufacturer_ids")).groupBy("manufacturer_id").agg(F.count("*").alias("recalls"))
    named = counts.join(manufacturers.select(F.col("id").alias("manufacturer_id"), "canonical_name"), "manufacturer_id")
    return named.orderBy(F.desc("recalls"), "manufacturer_id").limit(n)


def top_ingredients(docs: DataFrame) -> DataFrame:
    """(manufacturer_id, active_ingredient) over all documents; manufacturers without an ingredient are left out."""
    return top_ingredient(document_manufacturers(docs.select("active_ingredients", "canonical_manufacturer_ids")))


def missing_ingredients(docs: DataFrame) -> DataFrame:
    """(source_id, documents, without, pct): documents without an ingredient by source."""
    none = F.coalesce(F.size("active_ingredients"), F.lit(0)) <= 0
    return docs.groupBy("source_id").agg(F.count("*").alias("documents"), F.count_if(none).alias("without")).withColumn("pct", F.round(F.col("without") * 100 / F.col("documents"), 1))


def severity_distribution(docs: DataFrame) -> DataFrame:
    return docs.groupBy(F.coalesce("severity", F.lit("(none)")).alias("severity")).agg(F.count("*").alias("n"))


def signal_inventory(signals: DataFrame) -> DataFrame:
    """Signals by kind and status with all totals (null: any)."""
    return signals.cube("kind", "status").agg(F.count("*").alias("n"))


def provenance(supply: DataFrame) -> DataFrame:
    return supply.groupBy("data_source").agg(F.count("*").alias("n"))


def recall_events(docs: DataFrame, gap_days: int = 30) -> DataFrame:
    """(firm, severity, event, first, last, n): recalls of a firm and class that follow each other within ``gap_days``."""
    key = "partition by firm, severity order by date_published, id"
    marked = docs.selectExpr("*", f"case when datediff(date_published, lag(date_published) over ({key})) <= {gap_days} then 0 else 1 end as starts")
    numbered = marked.selectExpr("*", f"sum(starts) over ({key} rows between unbounded preceding and current row) as event")
    return numbered.groupBy("firm", "severity", "event").agg(F.min("date_published").alias("first"), F.max("date_published").alias("last"), F.count("*").alias("n"))


def dictionary_ingredients(docs: DataFrame, dictionary: list[str], text_col: str = "raw_text") -> DataFrame:
    """``docs`` with the dictionary's ingredients that occur as words of the text."""
    text = F.lower(F.coalesce(text_col, F.lit("")))
    found = F.filter(F.array(*map(F.lit, sorted(dictionary))), lambda w: F.regexp_like(text, F.concat(F.lit(r"(^|[^a-z0-9])\Q"), w, F.lit(r"\E([^a-z0-9]|$)"))))
    return docs.withColumn("found_ingredients", found)


#: Entries of one length are broadcast if they are at most so many (counted first); more of them meet the texts in a shuffle of the phrases that may be entries.
BROADCAST_ENTRIES = 200_000
WORD = "[a-z0-9]+"
#: Rows of 64 bits in which entries are marked by hash: as many at most are broadcast, however long the dictionary is.
MARKS = 1 << 19


def _small(table: DataFrame, rows: int = BROADCAST_ENTRIES) -> DataFrame:
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def _phrases(docs: DataFrame, key: str, text_col: str, lengths: list[int]) -> DataFrame:
    """(key, _phrase, n): the phrases of so many words in each text and how often; they are sorted and counted in the row, so nothing is shuffled."""
    words = docs.where(F.col(key).isNotNull() & F.col(text_col).isNotNull()).select(key, F.regexp_extract_all(F.lower(text_col), F.lit(WORD), F.lit(0)).alias("_words"))
    phrase = lambda n: F.when(F.size("_words") >= n, F.transform(F.sequence(F.lit(1), F.size("_words") - n + 1), lambda i: F.array_join(F.slice("_words", i, n), " "))).otherwise(F.array().cast("array<string>"))
    said = words.select(key, F.sort_array(F.concat(*[F.col("_words") if n == 1 else phrase(n) for n in lengths])).alias("_said"))
    first = said.select(key, "_said", F.expr("filter(sequence(0, size(_said) - 1), i -> i = 0 or get(_said, i) <> get(_said, i - 1))").alias("_first"))
    # Outer, as a filter on what is unfolded would sort a text's phrases once for each; a text without a phrase gives a null, which meets no entry.
    return first.select(key, F.expr("inline_outer(transform(_first, (at, i) -> struct(get(_said, at) as _phrase, coalesce(get(_first, i + 1), size(_said)) - at as n)))"))


def _marked(phrases: DataFrame, entries: DataFrame) -> DataFrame:
    """``phrases`` without most of those that no entry has: a phrase stays if the bit of its hash is set. None that an entry has is lost."""
    marks = lambda df: df.withColumn("_hash", F.xxhash64("_phrase")).withColumn("_row", F.pmod(F.shiftright("_hash", 6), F.lit(MARKS)))
    bits = marks(entries).groupBy("_row").agg(F.bit_or(F.expr("shiftleft(1L, cast(_hash & 63 as int))")).alias("_bits"))
    kept = marks(phrases).join(F.broadcast(bits), "_row").where("getbit(_bits, cast(_hash & 63 as int)) = 1")
    return kept.select(*phrases.columns)


def dictionary_matches(docs: DataFrame, dictionary: DataFrame, key: str = "id", text_col: str = "raw_text", broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """(key, entry, n): the entries of a table ``dictionary`` (entry) whose words follow each other in a text, and how often.

    Words are runs of a-z and 0-9 in the lower-cased text, whatever lies between them. Entries without a
    word, null texts and rows with a null key match nothing; entries of the same words are all found. Each text is split
    into phrases of the lengths that entries have, counted within the text, and joined by equality. The dictionary is written once.
    """
    entries = dictionary.select("entry").where("entry is not null").distinct().withColumn("_words", F.regexp_extract_all(F.lower("entry"), F.lit(WORD), F.lit(0))).where("size(_words) > 0")
    entries = written(entries.select("entry", F.array_join("_words", " ").alias("_phrase"), F.size("_words").alias("_length")), "dictionary")
    counts = {r["_length"]: r["count"] for r in entries.groupBy("_length").count().collect()}  # as many numbers as entries have lengths
    if not counts:
        return docs.select(key, F.lit(None).cast("string").alias("entry"), F.lit(0).cast("long").alias("n")).limit(0)
    few = sorted(n for n in counts if counts[n] <= broadcast_entries)
    many = sorted(n for n in counts if counts[n] > broadcast_entries)
    of = lambda lengths: entries.where(F.col("_length").isin(lengths)).select("entry", "_phrase")
    hits = []
    if few:
        hits.append(_phrases(docs, key, text_col, few).join(F.broadcast(of(few)), "_phrase"))
    if many:
        hits.append(_marked(_phrases(docs, key, text_col, many), of(many)).join(of(many), "_phrase"))
    # A text's hits are counted and whatever is made of them next is grouped where they lie.
    found = reduce(DataFrame.unionByName, hits).select(key, "entry", "n").repartition(key)
    return found.groupBy(key, "entry").agg(F.sum("n").alias("n"))


def normalized_by_table(docs: DataFrame, dictionary: DataFrame, key: str = "id", column: str = "active_ingredients_raw") -> DataFrame:
    """(key, normalized, raw): the list ``column`` with each name replaced by the dictionary's (alias, inn), blanks left out, order kept.

    As ``text.normalize_inn_list``, but the aliases are a table of any length: names join it by their trimmed
    lower case. Of several entries of one alias the least name counts; a null list gives empty lists.
    """
    table = dictionary.where("alias is not null and inn is not null").groupBy(F.lower(strip(F.col("alias"))).alias("_alias")).agg(F.min("inn").alias("_inn"))
    names = docs.select(key, F.posexplode_outer(column).alias("_pos", "_raw")).withColumn("_raw", strip(F.col("_raw")))
    found = names.join(_small(table), F.lower("_raw") == F.col("_alias"), "left")
    item = F.when(F.coalesce("_raw", F.lit("")) != "", F.struct("_pos", F.coalesce("_inn", "_raw").alias("inn"), F.col("_raw").alias("raw")))
    return found.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("x")).select(key, F.col("x.inn").alias("normalized"), F.col("x.raw").alias("raw"))
