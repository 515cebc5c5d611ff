"""The three risk rules. Each takes tables and settings and returns candidates of one schema.

documents: id, canonical_manufacturer_ids, active_ingredients, severity, date_published, document_type, jurisdiction.
"""

from __future__ import annotations

from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Corroboration, RepeatViolator, RiskConfig, SupplyChain
from ..functions import severity as sev
from ..functions.text import normalize_ingredient
from ..storage import written

RECALL_TYPES = ("recall", "alert", "enforcement")

CANDIDATE = (
    "kind string, severity string, manufacturer_id string, active_ingredient string, regions_affected array<string>, exposure_pct decimal(5,2), "
    "alternative_supplier_count long, recommended_action string, time_to_expiry_days long, evidence_document_ids array<string>, "
    "evidence_supply_ids array<string>, recall_count long, weighted_score long"
)


def candidates(df: DataFrame) -> DataFrame:
    """``df`` with exactly the columns of a candidate; absent ones are null."""
    fields = [f.strip().split(" ", 1) for f in CANDIDATE.replace("decimal(5,2)", "decimal(5;2)").split(",")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t.replace(";", ",")).alias(n) for n, t in fields])


def recall_window(docs: DataFrame, as_of: date, months: int = 24) -> DataFrame:
    """Recalls, alerts and enforcements of the last months of 30 days, both ends included."""
    return docs.where(F.col("document_type").isin(*RECALL_TYPES) & F.col("date_published").between(F.date_sub(F.lit(as_of), 30 * months), F.lit(as_of)))


def by_manufacturer(docs: DataFrame, *columns: str) -> DataFrame:
    """A row for each document and canonical manufacturer."""
    return docs.select("id", *columns, F.explode(F.array_distinct("canonical_manufacturer_ids")).alias("manufacturer_id"))


def top_ingredient(exploded: DataFrame, key: str = "manufacturer_id", ingredient_col: str = "active_ingredients") -> DataFrame:
    """(key, active_ingredient): the most frequent one, ties by name. Two aggregations, no ranking of whole groups."""
    counts = exploded.select(key, F.explode(ingredient_col).alias("active_ingredient")).groupBy(key, "active_ingredient").count()
    best = counts.groupBy(key).agg(F.min(F.struct((-F.col("count")).alias("n"), F.col("active_ingredient").alias("x"))).alias("b"))
    return best.select(key, F.col("b.x").alias("active_ingredient"))


def with_name(df: DataFrame, manufacturers: DataFrame) -> DataFrame:
    """The manufacturer's name, its id where there is none."""
    names = manufacturers.select(F.col("id").alias("manufacturer_id"), "canonical_name")
    return df.join(names, "manufacturer_id", "left").withColumn("canonical_name", F.coalesce("canonical_name", "manufacturer_id"))


def with_ingredient_keys(docs: DataFrame, ingredient_col: str | None) -> tuple[DataFrame, str]:
    """``docs`` and the column of its ingredients: the one given, else the stored comparison keys, else keys made from the names."""
    name = ingredient_col or "active_ingredients_normalized"
    if name in docs.columns:
        return docs, name
    return docs.withColumn(name, F.transform("active_ingredients", normalize_ingredient)), name


def repeat_violators(docs: DataFrame, manufacturers: DataFrame, as_of: date, cfg: RepeatViolator | None = None, ingredient_col: str | None = None) -> DataFrame:
    """Manufacturers over a threshold of recalls and weighted score, with the most frequent ingredient key (ties by name).

    Recalls are first counted by manufacturer and list of ingredients, and totals and the top ingredient come from these
    counts; ids are gathered for the manufacturers over a threshold alone. A null in a list of ingredients is no ingredient.
    """
    cfg = cfg or RepeatViolator()
    docs, ingredient_col = with_ingredient_keys(docs, ingredient_col)
    rows = written(by_manufacturer(recall_window(docs, as_of, cfg.window_months), "severity", ingredient_col), "window-recalls")
    parts = rows.groupBy("manufacturer_id", F.col(ingredient_col).alias("names")).agg(
        F.count("*").alias("n"), F.sum(sev.weight(F.col("severity"), cfg.severity_weights)).alias("score")
    )
    # One row stands for the part itself (whole), the others count its ingredients.
    mark = lambda whole, name: F.struct(F.lit(whole).alias("whole"), name.alias("name"))
    listed = F.transform(F.array_compact(F.coalesce("names", F.array().cast("array<string>"))), lambda x: mark(False, x))
    each = parts.withColumn("e", F.explode(F.concat(F.array(mark(True, F.lit(None).cast("string"))), listed))).select("manufacturer_id", "n", "score", "e.*")
    by_name = each.groupBy("manufacturer_id", "whole", "name").agg(F.sum("n").alias("n"), F.sum("score").alias("score"))
    totals = by_name.groupBy("manufacturer_id").agg(
        F.sum(F.when(F.col("whole"), F.col("n"))).alias("recall_count"), F.sum(F.when(F.col("whole"), F.col("score"))).alias("weighted_score"),
        F.min(F.when(~F.col("whole"), F.struct((-F.col("n")).alias("n"), F.col("name").alias("x")))).alias("top"),
    )
    crossed = totals.withColumn("severity", sev.recall_level(F.col("recall_count"), F.col("weighted_score"), cfg)).where("severity is not null")
    evidence = rows.join(crossed.select("manufacturer_id"), "manufacturer_id", "left_semi").groupBy("manufacturer_id").agg(F.sort_array(F.collect_list("id")).alias("evidence_document_ids"))
    crossed = crossed.join(evidence, "manufacturer_id")
    named = with_name(crossed.withColumn("active_ingredient", F.col("top.x")).drop("top"), manufacturers)
    action = F.format_string(f"Review procurement from %s: %d recall events (score %d) in {cfg.window_months} months.", "canonical_name", "recall_count", "weighted_score")
    return candidates(named.withColumns({"kind": F.lit("repeat_violator"), "recommended_action": action}))


def present(col: Column) -> Column:
    return col.isNotNull() & (col != "")


def county_exposure(signals: DataFrame, suppliers: DataFrame, supply: DataFrame) -> DataFrame:
    """(manufacturer_id, active_ingredient, ingredient_key, county_id, share, lead, supply_ids): what the supply facts of each signal add up to in each county."""
    keyed = signals.where(present(F.col("manufacturer_id")) & present(F.col("active_ingredient"))).select(
        "manufacturer_id", F.col("active_ingredient"), normalize_ingredient(F.col("active_ingredient")).alias("ingredient_key")
    )
    linked = keyed.join(suppliers.select(F.col("id").alias("supplier_id"), "manufacturer_id"), "manufacturer_id")
    facts = supply.select(F.col("id").alias("supply_id"), "county_id", "supplier_id", F.col("active_ingredient").alias("ingredient_key"), "share_pct", "lead_time_days")
    matched = linked.join(facts, ["supplier_id", "ingredient_key"])
    return matched.groupBy("manufacturer_id", "active_ingredient", "ingredient_key", "county_id").agg(F.sum("share_pct").alias("share"), F.max("lead_time_days").alias("lead"), F.collect_set("supply_id").alias("supply_ids"))


#: 64-bit words of a bitmap of 32,768 numbers.
BITMAP_WORDS = 512
#: Exposures that one task unites against the bitmaps of an ingredient.
UNITED = 8192


def _united(key: tuple, sets: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """(manufacturer_id, active_ingredient, n) of one slice of an ingredient's exposures: how many suppliers their counties have together."""
    at = {c: k for k, c in enumerate(held["county_id"].unique(), 1)}
    parts = {p: k for k, p in enumerate(sorted(held["part"].unique()))}
    bits = np.zeros((len(at) + 1, len(parts) * BITMAP_WORDS), np.uint64)  # row 0: a county without offers
    for county, part, bitmap in zip(held["county_id"], held["part"], held["bits"]):
        bits[at[county], parts[part] * BITMAP_WORDS :][:BITMAP_WORDS] = np.frombuffer(bitmap, np.uint64)
    bits = np.ascontiguousarray(bits[:, bits.any(0)]) if len(held) else bits
    asked = [tuple(sorted(at[c] for c in counties if c in at)) for counties in sets["counties"]]
    distinct = list(dict.fromkeys(asked))
    counts: dict[tuple, int] = {}
    for start in range(0, len(distinct), 128):
        some = distinct[start : start + 128]
        padded = np.zeros((len(some), max(map(len, some), default=0)), np.int64)
        for row, counties in zip(padded, some):
            row[: len(counties)] = counties
        union = np.zeros((len(some), bits.shape[1]), np.uint64)
        for column in padded.T:
            union |= bits[column]
        counts |= zip(some, np.bitwise_count(union).sum(1, dtype=np.int64).tolist())
    return pd.DataFrame({"manufacturer_id": sets["manufacturer_id"], "active_ingredient": sets["active_ingredient"], "n": [counts[a] for a in asked]})


def alternative_suppliers(exposed: DataFrame, suppliers: DataFrame, supply: DataFrame) -> DataFrame:
    """(manufacturer_id, active_ingredient, alternative_supplier_count): other suppliers of the ingredient in the exposed counties, not linked to the manufacturer.

    An ingredient's suppliers get dense numbers, and each of its counties bitmaps of them (one for every 32,768
    numbers). Only counties' bitmaps are shuffled, once for each slice of up to UNITED exposures of the ingredient, which a
    task unites there; no exposure is joined with bitmaps in rows. The others are the union's suppliers less the linked
    ones among them, which a join counts. An ingredient has one key.
    """
    key = ["manufacturer_id", "active_ingredient"]
    offered = supply.where("supplier_id is not null and county_id is not null and active_ingredient is not null").groupBy(F.col("active_ingredient").alias("ingredient_key"), "supplier_id").agg(F.collect_set("county_id").alias("offered"))
    offered = written(offered.withColumn("n", F.expr("row_number() over (partition by ingredient_key order by supplier_id) - 1").cast("long")), "offers")
    sets = written(exposed.groupBy(*key, "ingredient_key").agg(F.collect_set("county_id").alias("counties")), "exposed-counties")
    widest = sets.groupBy("ingredient_key").count().agg(F.max("count")).first()[0] or 0
    slices = -(-widest // UNITED) or 1
    held = offered.withColumn("county_id", F.explode("offered")).groupBy("ingredient_key", "county_id", F.bitmap_bucket_number("n").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits"))
    held = held.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    sliced = sets.where("ingredient_key is not null").withColumn("slice", F.pmod(F.xxhash64(*key), F.lit(slices)).cast("int"))
    deal = ["ingredient_key", "slice"]
    united = sliced.groupBy(*deal).cogroup(held.groupBy(*deal)).applyInPandas(_united, "manufacturer_id string, active_ingredient string, n long")
    linked = suppliers.select("manufacturer_id", F.col("id").alias("supplier_id")).where("manufacturer_id is not null").distinct()
    own = sets.join(linked.join(offered, "supplier_id"), ["manufacturer_id", "ingredient_key"]).where(F.arrays_overlap("counties", "offered")).groupBy(*key).agg(F.count("*").alias("own"))
    counts = united.join(own, key, "left").select(*key, (F.col("n") - F.coalesce("own", F.lit(0))).alias("alternative_supplier_count"))
    return counts.where("alternative_supplier_count > 0")


def supply_chain_exposure(
    signals: DataFrame, suppliers: DataFrame, supply: DataFrame, counties: DataFrame, manufacturers: DataFrame, cfg: SupplyChain | None = None,
    as_of: date | None = None, contracts_valid: bool = False,
) -> DataFrame:
    """Counties that depend on flagged manufacturers' suppliers, one candidate for each manufacturer and ingredient.

    The sums by signal and county, a small table, are written once; everything else is read from them.
    """
    cfg = cfg or SupplyChain()
    key = ["manufacturer_id", "active_ingredient"]
    if contracts_valid:
        supply = supply.where((F.col("contract_start").isNull() | (F.col("contract_start") <= F.lit(as_of))) & (F.col("contract_end").isNull() | (F.col("contract_end") >= F.lit(as_of))))
    # Several signals of one key (a stored one and a candidate) are one, with the evidence of all.
    one = signals.groupBy(*key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_document_ids")))).alias("evidence_document_ids"))
    one = written(one, "exposed-signals")
    county = written(county_exposure(one, suppliers, supply), "county-exposure")
    exposed = county.where(F.col("share") >= F.lit(cfg.min_county_share_pct))
    places = counties.select(F.col("id").alias("county_id"), F.col("name"), F.col("population"))
    placed = exposed.join(places, "county_id", "left").withColumns({"name": F.coalesce("name", "county_id"), "population": F.coalesce("population", F.lit(0)).cast("long")})
    alternatives = alternative_suppliers(exposed, suppliers, supply)
    population = F.sum("population")
    total = placed.groupBy(*key).agg(
        (F.sum(F.col("share").cast("decimal(18,4)") * F.col("population")) / F.greatest(population, F.lit(1))).cast("decimal(18,6)").alias("mean_share"),
        F.greatest(F.max("lead").cast("long"), F.lit(cfg.time_to_expiry_floor_days).cast("long")).alias("time_to_expiry_days"), F.sort_array(F.collect_set("name")).alias("regions_affected"),
    )
    # Evidence counts the facts of all counties, also of those below the threshold.
    evidence = county.groupBy(*key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("supply_ids")))).alias("evidence_supply_ids"))
    out = total.join(alternatives, key, "left").join(evidence, key).join(one, key)
    out = with_name(out, manufacturers).withColumns({"alternative_supplier_count": F.coalesce("alternative_supplier_count", F.lit(0)), "exposure_pct": F.round("mean_share", 2).cast("decimal(5,2)"), "kind": F.lit("supply_chain_exposure")})
    regions = F.concat(F.array_join(F.slice("regions_affected", 1, 3), ", "), F.when(F.size("regions_affected") > 3, "...").otherwise(""))
    action = F.concat(
        F.lit("Diversify "), "active_ingredient", F.lit(" sourcing away from "), "canonical_name", F.lit(" within "), F.col("time_to_expiry_days").cast("string"), F.lit(" days. Covers ~"),
        F.round("mean_share", 0).cast("long").cast("string"), F.lit("% of "), regions, F.lit(". Alternative suppliers: "), F.col("alternative_supplier_count").cast("string"), F.lit("."),
    )
    return candidates(out.withColumns({"severity": sev.exposure_level(F.col("mean_share"), F.col("alternative_supplier_count"), cfg), "recommended_action": action}))


def corroboration(docs: DataFrame, as_of: date, cfg: Corroboration | None = None, window_months: int = 24, ingredient_col: str = "active_ingredients") -> DataFrame:
    """Ingredients recalled in enough jurisdictions."""
    cfg = cfg or Corroboration()
    rows = recall_window(docs, as_of, window_months).select("id", "jurisdiction", F.explode(ingredient_col).alias("active_ingredient")).where(present(F.col("active_ingredient")))
    found = rows.groupBy("active_ingredient").agg(F.sort_array(F.collect_set("jurisdiction")).alias("regions_affected"), F.sort_array(F.collect_set("id")).alias("evidence_document_ids"))
    found = found.where((F.size("regions_affected") >= cfg.jurisdiction_count_for_boost) & F.lit(cfg.enable))
    action = F.format_string(f"%d jurisdictions have recalled products containing %s in the past {window_months} months. Verify supply alternatives and monitor closely.", F.size("regions_affected"), "active_ingredient")
    return candidates(found.withColumns({"kind": F.lit("cross_source_corroboration"), "severity": F.lit("medium"), "recommended_action": action}))


#: Rules by name: each takes (tables, as_of, config) and returns candidates. Add a rule with :func:`register`.
RULES: dict = {}


def register(name: str):
    def add(rule):
        if name in RULES:
            raise ValueError(f"rule {name!r} is already registered")
        RULES[name] = rule
        return rule

    return add


@register("repeat_violator")
def _repeat(tables: dict[str, DataFrame], as_of: date, cfg: RiskConfig) -> DataFrame:
    return repeat_violators(tables["documents"], tables["manufacturers"], as_of, cfg.repeat_violator)


@register("supply_chain_exposure")
def _supply(tables: dict[str, DataFrame], as_of: date, cfg: RiskConfig) -> DataFrame:
    found = tables.get("repeat_violator")
    found = found if found is not None else _repeat(tables, as_of, cfg)
    return supply_chain_exposure(found, tables["suppliers"], tables["county_supply"], tables["counties"], tables["manufacturers"], cfg.supply_chain_exposure)


@register("cross_source_corroboration")
def _corroboration(tables: dict[str, DataFrame], as_of: date, cfg: RiskConfig) -> DataFrame:
    return corroboration(tables["documents"], as_of, cfg.cross_source_corroboration, cfg.repeat_violator.window_months)


def all_candidates(tables: dict[str, DataFrame], as_of: date, cfg: RiskConfig) -> DataFrame:
    """The union of all registered rules. What a rule found is written once, so that later rules and the caller read it."""
    out, tables = None, dict(tables)
    for name, rule in RULES.items():
        found = tables[name] = written(rule(tables, as_of, cfg), f"rule-{name}")
        out = found if out is None else out.unionByName(found)
    return out


#: Days of a period by which recalls and dates are joined.
PERIOD_DAYS = 30


def as_of_backfill(docs: DataFrame, dates: list[date] | DataFrame, months: int = 24) -> DataFrame:
    """(as_of, id, ...): the recalls that counted at each of some dates, given as a list or as a table with a column ``as_of``.

    With a list each row is repeated for the dates that see it; nothing is joined. With a table a recall is
    repeated for the periods of PERIOD_DAYS that see it and meets the dates of each; the exact bounds follow.
    Null and repeated dates are left out.
    """
    recalls = docs.where(F.col("document_type").isin(*RECALL_TYPES))
    if isinstance(dates, DataFrame):
        period = lambda d: F.floor(F.unix_date(d) / F.lit(PERIOD_DAYS))
        days = dates.select(F.col("as_of").cast("date").alias("as_of")).where("as_of is not null").distinct().withColumn("_period", period(F.col("as_of")))
        last = F.date_add("date_published", 30 * months)
        spread = recalls.where("date_published is not null").withColumn("_period", F.explode(F.sequence(period(F.col("date_published")), period(last))))
        return spread.join(days, "_period").where(F.col("as_of").between(F.col("date_published"), last)).drop("_period")
    seen = F.filter(F.array(*map(F.lit, dates)), lambda d: F.col("date_published").between(F.date_sub(d, 30 * months), d))
    return recalls.withColumn("as_of", F.explode(seen))


def as_of_counts(docs: DataFrame, dates: DataFrame, months: int = 24) -> DataFrame:
    """(as_of, severity, n, ids): how many recalls, and how many ids, counted at each date of a table with a column ``as_of``.

    The rows of :func:`as_of_backfill`, counted without making them: recalls are first counted by the stretch of days that they
    count in, an id by stretches that don't overlap. Only these counts are repeated for periods and dates.
    """
    recalls = docs.where(F.col("document_type").isin(*RECALL_TYPES) & F.col("date_published").isNotNull())
    end = lambda d: F.date_add(d, 30 * months)
    zero, one = F.lit(0).cast("long"), F.count("*")
    rows = recalls.groupBy("severity", F.col("date_published").alias("first")).agg(one.alias("n")).select("severity", "first", end("first").alias("last"), "n", zero.alias("ids"))
    held = recalls.where("id is not null").groupBy("severity", "id").agg(F.array_sort(F.collect_set("date_published")).alias("days"))
    until = lambda d, i: F.least(end(d), F.date_sub(F.get("days", i + 1), 1))  # noqa: E731  up to the id's next recall
    each = held.select("severity", F.explode(F.transform("days", lambda d, i: F.struct(d.alias("first"), until(d, i).alias("last")))).alias("s"))
    ids = each.groupBy("severity", "s.first", "s.last").agg(one.alias("ids")).select("severity", "first", "last", zero.alias("n"), "ids")
    period = lambda d: F.floor(F.unix_date(d) / F.lit(PERIOD_DAYS))
    days = dates.select(F.col("as_of").cast("date").alias("as_of")).where("as_of is not null").distinct().withColumn("_period", period(F.col("as_of")))
    spread = rows.unionByName(ids).withColumn("_period", F.explode(F.sequence(period(F.col("first")), period(F.col("last")))))
    met = spread.join(days, "_period").where(F.col("as_of").between(F.col("first"), F.col("last")))
    return met.groupBy("as_of", "severity").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"))
