"""Procurement tables: loading, resolving, checking.

counties: id, name, region, population, health_facilities. suppliers: id, manufacturer_id, name, role, countries_served.
county_supply: id, county_id, supplier_id, active_ingredient, share_pct, lead_time_days, contract_start, contract_end, data_source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_ingredient


def resolve_supplier_manufacturer(suppliers: DataFrame, manufacturers: DataFrame) -> DataFrame:
    """The manufacturer's id by exact name, for suppliers that are manufacturers."""
    names = manufacturers.groupBy(F.col("canonical_name").alias("_name")).agg(F.min("id").alias("_id"))
    hit = suppliers.join(names, (F.col("name") == F.col("_name")) & (F.col("role") == "manufacturer"), "left")
    return hit.withColumn("manufacturer_id", F.col("_id")).drop("_name", "_id")


def new_counties(incoming: DataFrame, counties: DataFrame) -> DataFrame:
    """Counties whose name isn't known yet."""
    return incoming.join(counties.select("name").distinct(), "name", "left_anti").select(*incoming.columns)


def county_ids(incoming: DataFrame, counties: DataFrame) -> DataFrame:
    """(id, county_id): what each id of the file is in the stored table, by name; itself if new."""
    known = counties.groupBy("name").agg(F.min("id").alias("known"))
    return incoming.join(known, "name", "left").select("id", F.coalesce("known", "id").alias("county_id"))


def check_shares(supply: DataFrame) -> DataFrame:
    """Facts whose share is outside 0 to 100, or missing."""
    return supply.where(~F.coalesce(F.col("share_pct").between(0, 100), F.lit(False)))


def share_sums(supply: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """(county_id, active_ingredient, total) whose shares don't add up to 100 within the tolerance."""
    sums = supply.groupBy("county_id", "active_ingredient").agg(F.sum("share_pct").alias("total"))
    return sums.where(F.abs(F.col("total") - 100) > F.lit(tolerance))


def load(raw: dict[str, DataFrame], stored: dict[str, DataFrame], manufacturers: DataFrame, data_source: str) -> dict[str, DataFrame]:
    """The stored tables after a load: known ids and names aren't added again, facts use stored county ids. ``warnings``: shares that don't add up."""
    ids = county_ids(raw["counties"], stored["counties"])
    fresh = lambda name, rows: stored[name].unionByName(rows.join(stored[name].select("id"), "id", "left_anti").select(*stored[name].columns))
    facts = raw["county_supply"].withColumn("_county", F.col("county_id")).drop("county_id").join(ids.withColumnRenamed("id", "_county"), "_county", "left")
    facts = facts.withColumns({"county_id": F.coalesce("county_id", "_county"), "active_ingredient": normalize_ingredient(F.col("active_ingredient")), "data_source": F.lit(data_source)}).drop("_county")
    out = {"counties": stored["counties"].unionByName(new_counties(raw["counties"], stored["counties"]).select(*stored["counties"].columns))}
    out["suppliers"] = fresh("suppliers", resolve_supplier_manufacturer(raw["suppliers"], manufacturers))
    out["county_supply"] = fresh("county_supply", facts)
    return out | {"warnings": share_sums(facts)}
