"""The document table: validation, deduplication, versions, upserts."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import document_hash, normalize_ingredient

# Fixed values of the document schema.
DOCUMENT_TYPES = ("recall", "alert", "enforcement", "trial", "guideline", "shortage", "referral")
SEVERITIES = ("class_1", "class_2", "class_3", "unclassified")
REGIONS = ("EU", "GLOBAL", "EAC", "ECOWAS", "AU")
URL = ("source_id", "source_url")


def since_filter(df: DataFrame, column: str, since, inclusive: bool = False, keep_unknown: bool = False) -> DataFrame:
    """Rows after a time (or from it on); rows without a date on request."""
    if since is None:
        return df
    test = F.col(column) >= F.lit(since) if inclusive else F.col(column) > F.lit(since)
    return df.where(test | F.col(column).isNull() if keep_unknown else test)


def validate(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): jurisdiction upper case, language lower case; rejected rows list their faults."""
    j = F.upper("jurisdiction")
    good = j.rlike(r"(?U)^\p{Alpha}{2}$") | j.isin(*REGIONS)
    fault = lambda bad, name: F.when(F.coalesce(bad, F.lit(True)), F.lit(name))
    faults = F.array_compact(F.array(
        fault(~good, "jurisdiction"), fault(~F.col("document_type").isin(*DOCUMENT_TYPES), "document_type"),
        F.when(F.col("severity").isNotNull() & ~F.col("severity").isin(*SEVERITIES), F.lit("severity")),
    ))
    seen = docs.withColumns({"jurisdiction": j, "language": F.lower("language"), "faults": faults})
    return seen.where(F.size("faults") == 0).drop("faults"), seen.where(F.size("faults") > 0)


def to_document(docs: DataFrame) -> DataFrame:
    """Stored form: with the content hash and the ingredients' comparison keys."""
    return docs.withColumns({"normalized_hash": document_hash(docs.schema), "active_ingredients_normalized": F.transform("active_ingredients", normalize_ingredient)})


def _newest(key: tuple[str, ...], *order: str) -> Column:
    return F.expr(f"row_number() over (partition by {', '.join(key)} order by {', '.join(order)})")


def latest_per_url(docs: DataFrame, order: tuple[str, ...] = ("created_at desc", "id")) -> DataFrame:
    return docs.withColumn("_rank", _newest(URL, *order)).where("_rank = 1").drop("_rank")


#: What a version keeps of the document that it archives, where the table has it.
ARCHIVED = ("raw_text", "raw_metadata")


def dedup(docs: DataFrame, order: tuple[str, ...] = ("created_at desc", "id"), now: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, versions): the newest of each address stays, the others become versions of it with their text and metadata, superseded at ``now``."""
    window = f"(partition by {', '.join(URL)} order by {', '.join(order)})"
    ranked = docs.selectExpr("*", f"row_number() over {window} as _rank", f"first_value(id) over {window} as _keeper")
    held = [c for c in ARCHIVED if c in docs.columns]
    versions = ranked.where("_rank > 1").select(
        F.col("_keeper").alias("document_id"), F.coalesce("normalized_hash", F.lit("")).alias("normalized_hash"), *held, F.col("id").alias("replaced_id"), F.col("created_at"), F.lit(now).cast("timestamp").alias("superseded_at")
    )
    return ranked.where("_rank = 1").drop("_rank", "_keeper"), versions


def duplicate_groups(docs: DataFrame, source: str | None = None) -> DataFrame:
    rows = docs if source is None else docs.where(F.col("source_id") == source)
    return rows.groupBy(*URL).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_content(docs: DataFrame) -> DataFrame:
    """(source_hash, first_id, n): contents that several documents have."""
    return docs.groupBy("source_hash").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


def dedup_summary(docs: DataFrame) -> DataFrame:
    """Groups and surplus rows of each source, and in all (source_id null)."""
    groups = duplicate_groups(docs)
    return groups.rollup("source_id").agg(F.count("*").alias("groups"), F.sum(F.col("n") - 1).alias("surplus"))


def unknown_urls(incoming: DataFrame, docs: DataFrame) -> DataFrame:
    return incoming.join(docs.select(*URL).distinct(), list(URL), "left_anti")


def unknown_content(incoming: DataFrame, docs: DataFrame) -> DataFrame:
    return incoming.join(docs.select("source_hash").distinct(), "source_hash", "left_anti")


def version_chain(observed: DataFrame, order: str = "seq") -> DataFrame:
    """Observations whose hash differs from the one before of the same address, with that one as ``previous_hash``."""
    lagged = observed.withColumn("previous_hash", F.expr(f"lag(normalized_hash) over (partition by {', '.join(URL)} order by {order})"))
    return lagged.where("not (normalized_hash <=> previous_hash) and coalesce(previous_hash, '') != ''")


def packed(text: Column) -> Column:
    """Text as short bytes for shuffles: hex digits take half their length, and a first byte tells them from other text."""
    digits = text.rlike(r"^[0-9a-f]+\z") & (F.length(text) % 2 == 0)
    return F.when(digits, F.concat(F.unhex(F.lit("01")), F.unhex(text))).otherwise(F.concat(F.unhex(F.lit("00")), text.cast("binary")))


def unpacked(column: str) -> Column:
    """The text that :func:`packed` was given."""
    return F.expr(f"case when substring({column}, 1, 1) = X'01' then lower(hex(substring({column}, 2))) else cast(substring({column}, 2) as string) end")


def upsert(
    docs: DataFrame, incoming: DataFrame, check_for_updates: bool = True, now: datetime | None = None, known: DataFrame | None = None, hold: Callable[[DataFrame], DataFrame] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents', versions, log, counts) after a batch of observations (columns of docs, seq, and ``error`` where parsing can fail).

    Each observation has one outcome. Without update checks a known address is ``skip_known``. With
    them an equal hash is ``skip_unchanged``, another one an ``update`` that archives the hash, text
    and metadata it replaces, superseded at ``now``. A new address whose bytes are stored is
    ``skip_same_bytes``, else ``insert``. An observation that couldn't be parsed is an ``error`` and
    changes nothing. A null source_hash is unknown bytes, equal to none. Within a batch the observations of an address follow each other by seq, and
    bytes belong to the first address that brought them; a document keeps the id that it was inserted with. ``known`` holds the stored bytes (source_hash,
    and ``n`` where a row stands for more or less than one document that has them) where ``docs`` is only the part of the table with the batch's addresses.
    ``hold`` (such as :func:`storage.written`) is given the outcomes with the rows of docs (which have no action, and stand unless they
    are replaced), from which all results follow: a caller that reads several of them lets it write these once. It may leave
    out columns of docs that the caller doesn't read; they are null in the documents.
    """
    url, held = ", ".join(URL), [c for c in ARCHIVED if c in docs.columns]
    hashes = {c: packed(F.col(c)) for c in ("normalized_hash", "source_hash") if c in incoming.columns}
    failed = F.col("error").isNotNull() if "error" in incoming.columns else F.lit(False)
    seen = incoming.withColumn("failed", failed).withColumns(hashes)
    # Who brings bytes first that nobody has: short rows, neither texts nor ids are shuffled for it. Unknown bytes are like no others.
    brought = seen.where("not failed and source_hash is not null").select("source_hash", F.struct("seq", *URL).alias("by"), F.lit(0).alias("n"))
    had = docs.select("source_hash", F.lit(1).alias("n")) if known is None else known.select("source_hash", F.col("n") if "n" in known.columns else F.lit(1).alias("n"))
    had = had.where("source_hash is not null").withColumn("source_hash", hashes["source_hash"])
    firsts = brought.unionByName(had, allowMissingColumns=True).groupBy("source_hash").agg(F.min("by").alias("by"), F.sum("n").alias("n")).where("n <= 0 and by is not null")
    # Documents, observations and openings of an address meet in one deal by its text: windows say the rest, and nothing is joined.
    every = docs.withColumns({c: hashes[c] for c in hashes if c in docs.columns}).withColumns({"failed": F.lit(False), "_part": F.lit(0)}).repartition("source_url")
    every = every.unionByName(seen.withColumns({"_part": F.lit(1), "_bare": ~F.col("failed") & F.col("source_hash").isNull()}).repartition("source_url"), allowMissingColumns=True)
    every = every.unionByName(firsts.select("by.*", F.lit(2).alias("_part")).repartition("source_url"), allowMissingColumns=True)
    of_url = lambda value: F.expr(f"{value} over (partition by {url})")
    texts = f"struct({', '.join(['normalized_hash', *held])})"
    # A new address opens at its first observation whose bytes nobody has; what comes before is skipped.
    opening = "min(case when _part = 2 or _bare then seq end)"
    every = every.withColumns({"known": of_url("max(_part = 0)"), "stored": of_url(f"first(case when _part = 0 then {texts} end, true)"), "opened": of_url(opening)})
    every = every.withColumn("opened", F.when(~F.col("known"), F.col("opened")))
    kept_id = F.coalesce(of_url("max(case when _part = 0 then id end)"), of_url("min(case when _part = 1 and seq = opened and not failed then id end)"))
    live = F.coalesce(F.col("known") | (F.col("seq") > F.col("opened")), F.lit(False))
    before = F.expr(f"lag({texts}) over (partition by {url}, _part, failed order by seq)")
    every = every.withColumns({"kept_id": kept_id, "before": F.when(F.col("seq") > F.coalesce("opened", F.lit(-1)), before)}).withColumn("before", F.coalesce("before", "stored"))
    action = (
        F.when(F.col("_part") != 1, None).when(live & F.lit(not check_for_updates), "skip_known").when(F.col("failed"), "error")
        .when(live, F.when(F.col("normalized_hash").eqNullSafe(F.col("before.normalized_hash")), "skip_unchanged").otherwise("update"))
        .when(F.col("seq") == F.col("opened"), "insert").otherwise("skip_same_bytes")
    )
    every = every.withColumn("action", action).withColumn("stands", F.coalesce(F.col("action").isin("insert", "update"), F.lit(False)))
    # What stands at the end is marked while the address's rows are together: nothing is shuffled for it again.
    last = F.expr(f"row_number() over (partition by {url}, stands order by seq desc)") == 1
    every = every.withColumn("stands", F.when(F.col("_part") == 0, ~of_url("max(stands)")).otherwise(F.col("stands") & last)).where("_part < 2")
    old = F.struct(unpacked("before.normalized_hash").alias("normalized_hash"), *[F.col(f"before.{c}").alias(c) for c in held])
    every = every.withColumn("before", F.when(F.col("action") == "update", old)).withColumns({c: unpacked(c) for c in hashes}).drop("stored", "known", "failed", "opened", "_part", "_bare")
    every = hold(every) if hold else every
    of = {c: "kept_id" if c == "id" else c for c in docs.columns}
    state = every.where("stands").select(*[(F.col(of[c]) if of[c] in every.columns else F.lit(None).cast(docs.schema[c].dataType)).alias(c) for c in docs.columns])
    log = every.where("action is not null")
    versions = log.where("action = 'update' and coalesce(before.normalized_hash, '') != ''").select(*URL, "before.*", "seq", F.lit(now).cast("timestamp").alias("superseded_at"))
    return state, versions, log, ingest_counts(log)


def ingest_counts(log: DataFrame) -> DataFrame:
    """added, updated, skipped and failed of each source."""
    one = lambda *a: F.count_if(F.col("action").isin(*a))
    return log.groupBy("source_id").agg(one("insert").alias("added"), one("update").alias("updated"), one("skip_known", "skip_unchanged", "skip_same_bytes").alias("skipped"), one("error").alias("failed"))


def enforce_reference(child: DataFrame, parent: DataFrame, column: str, on_missing: str = "cascade") -> DataFrame:
    """Children whose parent (column id) is gone are dropped, or keep a null reference ("set null")."""
    ids = parent.select(F.col("id").alias("_parent")).distinct()
    if on_missing == "cascade":
        return child.join(ids, F.col(column) == F.col("_parent"), "left_semi")
    return child.join(ids, F.col(column) == F.col("_parent"), "left").withColumn(column, F.col("_parent")).drop("_parent")


def keep_last(old: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    """Both indexes as one; of each key the last row of the newer batch (column pos orders a batch)."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    return both.withColumn("_rank", F.expr(f"row_number() over (partition by {key} order by _batch desc, pos desc)")).where("_rank = 1").drop("_rank", "_batch")


# Category, word of the URL, word of the link text; in order of precedence.
LINK_CATEGORIES = (
    ("GUIDELINES", "guideline", "guidelines"), ("POLICIES", "policy", "framework"), ("REGISTRATION", "product", "registration"), ("APPLICATIONS", "form", "application"),
    ("TRAINING", "training", "manual"), ("REPORTS", "report", "survey"), ("INSPECTION", "inspection", "audit"),
)


def categorize_links(links: DataFrame, compat: bool = False) -> DataFrame:
    """``links`` (text, url) with the first category whose word occurs. ``compat``: everything not matched before TRAINING is TRAINING."""
    url, text = F.lower(F.coalesce("url", F.lit(""))), F.lower(F.coalesce("text", F.lit("")))
    out: Column | None = None
    for name, in_url, in_text in LINK_CATEGORIES:
        test = F.lit(True) if compat and name == "TRAINING" else F.contains(url, F.lit(in_url)) | F.contains(text, F.lit(in_text))
        out = F.when(test, name) if out is None else out.when(test, name)
    return links.withColumn("category", out.otherwise("OTHER"))


def category_summary(links: DataFrame) -> DataFrame:
    return links.rollup("category").agg(F.count("*").alias("n"))


def backfill(docs: DataFrame) -> DataFrame:
    """Derived columns of stored rows computed anew."""
    return to_document(docs.drop("normalized_hash", "active_ingredients_normalized"))


def with_publication_date(docs: DataFrame, as_of: date) -> DataFrame:
    return docs.withColumn("date_published", F.coalesce("date_published", F.lit(as_of)))
