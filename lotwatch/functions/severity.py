"""Severity classes and levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import RepeatViolator, SupplyChain

LADDER = ("low", "medium", "high", "critical")


def weight(severity: Column, weights: dict[str, int]) -> Column:
    """Points of a class: a missing class counts as unclassified, an unknown one 1."""
    pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(int(v)))]
    found = F.try_element_at(F.create_map(*pairs), F.coalesce(severity, F.lit("unclassified")))
    return F.coalesce(found, F.lit(1)).cast("long")


def recall_level(count: Column, score: Column, cfg: RepeatViolator) -> Column:
    """The highest level whose two minimums both hold, else null."""
    out = F.lit(None).cast("string")
    for level in ("medium", "high", "critical"):
        if level in cfg.thresholds:
            t = cfg.thresholds[level]
            out = F.when((count >= t.min_recalls) & (score >= t.min_weighted_score), level).otherwise(out)
    return out


def exposure_level(pct: Column, alternatives: Column, cfg: SupplyChain) -> Column:
    """Low if enough other suppliers exist, else by the share."""
    by_share = F.when(pct >= 70, "critical").when(pct >= 50, "high").when(pct >= 25, "medium").otherwise("low")
    return F.when(alternatives >= cfg.min_alternative_suppliers_for_low, "low").otherwise(by_share)


def boost(level: Column, steps: int) -> Column:
    """Some steps up the ladder, at most to its top; an unknown level stays."""
    ladder = F.array(*map(F.lit, LADDER))
    at = F.array_position(ladder, level)
    return F.when(at > 0, F.element_at(ladder, F.least(at + steps, F.lit(len(LADDER))).cast("int"))).otherwise(level)
