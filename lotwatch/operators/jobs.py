"""Compositions that a user calls: a whole risk run."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame

from ..config import RiskConfig
from . import rules, signals


def run_risk(tables: dict[str, DataFrame], as_of: date, now: datetime, cfg: RiskConfig | None = None, actor: str = "system") -> dict[str, DataFrame]:
    """All rules at ``as_of`` merged into the signal table.

    tables: documents, manufacturers, suppliers, county_supply, counties, signals, events. Returns
    candidates, merged (with the action of each), signals and events. Candidates and merged rows are
    written once; signals and events are read from them.
    """
    cfg = cfg or RiskConfig()
    found = rules.all_candidates(tables, as_of, cfg)
    new, events, merged = signals.persist_signals(found, tables["signals"], tables["events"], cfg, as_of, now, actor)
    return {"candidates": found, "signals": new, "events": events, "merged": merged}
