"""The signal table: merging candidates, transitions, audit events, listing and explaining.

stored signal: id, kind, severity, status, manufacturer_id, active_ingredient, regions_affected, exposure_pct, alternative_supplier_count,
recommended_action, time_to_expiry_days, evidence, first_seen, last_updated, resolved_at.
event: id, signal_id, event_type, old_state, new_state, actor, reason, occurred_at.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RiskConfig
from ..functions.severity import boost
from ..storage import written

KEY = ("kind", "manufacturer_id", "active_ingredient")
#: A signal resolved by a merge of manufacturers hands its first_seen on for this long.
CARRY_DAYS = 7
MERGED = "manufacturer_merged"
#: What the evidence of supply signals says of their source.
SUPPLY_SOURCE, SUPPLY_CAVEAT = "synthetic_v2", "Supply-chain figures derived from synthetic procurement data. Real KEMSA/county procurement integration pending."
SYNTHETIC_SUFFIX = " (based on synthetic supply data)"
EVIDENCE = (
    "struct<document_ids: array<string>, supply_ids: array<string>, rule_version: string, config_hash: string, computed_at: timestamp, as_of: date, inputs: struct<manufacturer_id: string, active_ingredient: string, kind: string>, "
    "recall_count: bigint, weighted_score: bigint, jurisdictions: array<string>, data_provenance: struct<supply_chain_source: string, caveat: string>>"
)
SIGNAL = (
    "id string, kind string, severity string, status string, manufacturer_id string, active_ingredient string, regions_affected array<string>, exposure_pct decimal(5,2), alternative_supplier_count long, "
    f"recommended_action string, time_to_expiry_days long, evidence {EVIDENCE}, first_seen timestamp, last_updated timestamp, resolved_at timestamp"
)
EVENT = "id string, signal_id string, event_type string, old_state string, new_state string, actor string, reason string, occurred_at timestamp"


def signal_key(kind: Column, manufacturer: Column, ingredient: Column) -> Column:
    return F.concat_ws("|", kind, F.coalesce(manufacturer, F.lit("")), F.coalesce(ingredient, F.lit("")))


def stable_id(*parts: Column) -> Column:
    """An id in UUID form from what identifies the row: reruns give the same one."""
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def with_disclaimer(kind: Column, action: Column) -> Column:
    """The suffix about synthetic data, once, on supply signals."""
    needs = (kind == "supply_chain_exposure") & ~F.endswith(action, F.lit(SYNTHETIC_SUFFIX))
    return F.when(needs, F.concat(F.rtrim(action), F.lit(SYNTHETIC_SUFFIX))).otherwise(action)


def build_evidence(cfg: RiskConfig, as_of: date, now: datetime, data_source: Column | None = None) -> Column:
    """The evidence of a candidate as a typed struct; rule-specific parts are null for other rules."""
    c, kind = F.col, F.col("kind")
    none = F.array().cast("array<string>")
    return F.struct(
        F.array_distinct(F.coalesce(c("evidence_document_ids"), none)).alias("document_ids"), F.coalesce(c("evidence_supply_ids"), none).alias("supply_ids"),
        F.lit(cfg.version).alias("rule_version"), F.lit(cfg.config_hash).alias("config_hash"), F.lit(now).alias("computed_at"), F.lit(as_of).alias("as_of"),
        F.struct(c("manufacturer_id"), c("active_ingredient"), kind).alias("inputs"),
        F.when(kind == "repeat_violator", c("recall_count")).alias("recall_count"), F.when(kind == "repeat_violator", c("weighted_score")).alias("weighted_score"),
        F.when(kind == "cross_source_corroboration", F.sort_array("regions_affected")).alias("jurisdictions"),
        F.when(
            kind == "supply_chain_exposure",
            F.struct((F.lit(SUPPLY_SOURCE) if data_source is None else data_source).alias("supply_chain_source"), F.lit(SUPPLY_CAVEAT).alias("caveat")),
        ).alias("data_provenance"),
    )


def without_time(evidence: Column) -> Column:
    return evidence.dropFields("computed_at")


def evidence_changed(old: Column, new: Column) -> Column:
    return ~without_time(old).eqNullSafe(without_time(new))


def state(prefix: str = "") -> Column:
    """A signal's mutable fields as JSON for the audit trail: missing ones are null, the evidence holds what its rule has."""
    c = lambda n: F.col(prefix + n)
    names = ["kind", "severity", "status", "manufacturer_id", "active_ingredient"]
    return F.to_json(
        F.struct(
            *[c(n).alias(n) for n in names], F.coalesce(c("regions_affected"), F.array().cast("array<string>")).alias("regions_affected"), c("exposure_pct").cast("string").alias("exposure_pct"),
            c("alternative_supplier_count").alias("alternative_supplier_count"), c("recommended_action").alias("recommended_action"),
            F.coalesce(F.parse_json(F.to_json(c("evidence"))), F.parse_json(F.lit("{}"))).alias("evidence"), iso_time(c("last_updated")).alias("last_updated"),
        ),
        {"ignoreNullFields": "false"},
    )


def boosted(candidates: DataFrame, steps: int = 1) -> DataFrame:
    """Candidates with a corroborated ingredient move up; corroborations themselves stay."""
    sure = candidates.where("kind = 'cross_source_corroboration'").select(F.col("active_ingredient").alias("sure")).distinct()
    joined = candidates.join(sure, F.col("active_ingredient") == F.col("sure"), "left")
    up = F.col("sure").isNotNull() & (F.col("kind") != "cross_source_corroboration")
    return joined.withColumn("severity", F.when(up, boost(F.col("severity"), steps)).otherwise(F.col("severity"))).drop("sure")


def carried_first_seen(signals: DataFrame, events: DataFrame, now: datetime) -> DataFrame:
    """(kind, active_ingredient, carried): earliest first_seen of signals that a merge resolved in the last days."""
    merged = events.where((F.col("event_type") == "resolved") & (F.col("reason") == MERGED)).select(F.col("signal_id").alias("id"))
    recent = signals.where((F.col("status") == "resolved") & (F.col("resolved_at") >= F.lit(now) - F.expr(f"interval {CARRY_DAYS} days")))
    return recent.join(merged, "id", "left_semi").groupBy("kind", "active_ingredient").agg(F.min("first_seen").alias("carried"))


def merged(candidates: DataFrame, signals: DataFrame, respect_suppressed: bool = False) -> DataFrame:
    """Full outer join of candidates (c_*) and active signals (s_*) with an ``action``: created, updated, unchanged, resolved.

    A missing manufacturer or ingredient is equal to an empty one. The key is three columns without nulls, so the join is a
    plain hash-partitioned one.
    """
    key = [F.coalesce(F.col(n), F.lit("")).alias(f"key_{n}") for n in KEY]
    names = [f"key_{n}" for n in KEY]
    c = candidates.select(*[F.col(n).alias(f"c_{n}") for n in candidates.columns], *key)
    s = signals.where("status = 'active'").select(*[F.col(n).alias(f"s_{n}") for n in signals.columns], *key)
    if respect_suppressed:
        c = c.join(signals.where("status = 'suppressed'").select(*key), names, "left_anti")
    both = c.join(s, names, "full_outer")
    changed = ~(F.col("c_severity").eqNullSafe(F.col("s_severity")) & F.col("c_regions_affected").eqNullSafe(F.col("s_regions_affected"))) | evidence_changed(F.col("s_evidence"), F.col("c_evidence"))
    action = F.when(F.col("s_id").isNull(), "created").when(F.col("c_kind").isNull(), "resolved").when(changed, "updated").otherwise("unchanged")
    return both.withColumn("action", action)


def merge_counts(merged_rows: DataFrame) -> DataFrame:
    return merged_rows.groupBy("action").agg(F.count("*").alias("n"))


def persist_signals(
    candidates: DataFrame, signals: DataFrame, events: DataFrame, cfg: RiskConfig, as_of: date, now: datetime, actor: str = "system", respect_suppressed: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signals', new events, merged rows) of one run; candidates and merged rows are written once, and both tables are read from them.

    Keys of candidates must be unique. Without writing the results this is a dry run: count the merged rows.
    """
    candidates = written(candidates, "candidates")
    ready = boosted(candidates, cfg.cross_source_corroboration.boost_levels)
    ready = ready.withColumns({"evidence": build_evidence(cfg, as_of, now), "recommended_action": with_disclaimer(F.col("kind"), F.col("recommended_action"))})
    old = carried_first_seen(signals, events, now)
    # A candidate's own first_seen_override goes before what a predecessor hands on.
    own = F.try_to_timestamp("first_seen_override") if "first_seen_override" in ready.columns else F.lit(None).cast("timestamp")
    ready = ready.withColumn("own_first_seen", own)
    ready = ready.join(old, ready.kind.eqNullSafe(old.kind) & ready.active_ingredient.eqNullSafe(old.active_ingredient), "left").select(*[ready[n] for n in ready.columns], F.coalesce(ready.own_first_seen, old.carried).alias("carried"))
    rows = written(merged(ready, signals, respect_suppressed), "merged")
    fresh, live, gone = F.col("action") == "created", F.col("action").isin("created", "updated"), F.col("action") == "resolved"
    take = lambda n: F.when(live, F.col(f"c_{n}")).otherwise(F.col(f"s_{n}")).alias(n)
    time = F.lit(now)
    new_id = stable_id(*[F.col(f"key_{n}") for n in KEY], time)
    new = rows.select(
        F.coalesce("s_id", new_id).alias("id"), F.coalesce("c_kind", "s_kind").alias("kind"), take("severity"), F.when(gone, "resolved").otherwise("active").alias("status"),
        F.coalesce("c_manufacturer_id", "s_manufacturer_id").alias("manufacturer_id"), F.coalesce("c_active_ingredient", "s_active_ingredient").alias("active_ingredient"),
        take("regions_affected"), take("exposure_pct"), take("alternative_supplier_count"), take("recommended_action"), take("time_to_expiry_days"), take("evidence"),
        F.when(fresh, F.coalesce("c_carried", time)).otherwise(F.col("s_first_seen")).alias("first_seen"), F.when(live | gone, time).otherwise(F.col("s_last_updated")).alias("last_updated"),
        F.when(gone, time).alias("resolved_at"), "action", F.when(~fresh, state("s_")).alias("old_state"),
    )
    events_new = new.where("action != 'unchanged'").select(
        stable_id(F.col("id"), F.col("action"), time).alias("id"), F.col("id").alias("signal_id"), F.col("action").alias("event_type"), "old_state", state().alias("new_state"),
        F.lit(actor).alias("actor"), F.when(F.col("action") == "resolved", "rule_no_longer_fires").alias("reason"), time.alias("occurred_at"),
    )
    rest = signals.where("status != 'active'")
    return rest.unionByName(new.select(*rest.columns)), events_new, rows


def transition(signals: DataFrame, requests: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signals', events, rejected) for requests (signal_id, to: resolved or suppressed, actor, reason, and seq where their order counts).

    Of several requests for a signal the last by seq is carried out (the least by its fields without
    seq); the others are rejected with the fault ``repeated``, those for an unknown signal with ``unknown``.
    """
    asked = requests.select(F.col("signal_id").alias("id"), "to", "actor", "reason", *(["seq"] if "seq" in requests.columns else []))
    order = "seq desc, to, actor, reason" if "seq" in requests.columns else "to, actor, reason"
    asked = asked.withColumn("nth", F.expr(f"row_number() over (partition by id order by {order})"))
    one = asked.where("nth = 1").drop("nth", "seq")
    hit = signals.join(one, "id")
    changed = hit.withColumns({"new_status": F.col("to"), "old_state": state()})
    time = F.lit(now)
    out = signals.join(one.select("id", "to"), "id", "left").withColumns({
        "status": F.coalesce("to", "status"), "last_updated": F.when(F.col("to").isNotNull(), time).otherwise(F.col("last_updated")),
        "resolved_at": F.when(F.col("to").isin("resolved", "suppressed"), time).otherwise(F.col("resolved_at")),
    })
    events = changed.withColumns({"status": F.col("new_status"), "last_updated": time}).select(
        stable_id(F.col("id"), F.col("to"), time).alias("id"), F.col("id").alias("signal_id"), F.col("to").alias("event_type"), "old_state", state().alias("new_state"), "actor", "reason", time.alias("occurred_at")
    )
    known = asked.join(signals.select("id").withColumn("known", F.lit(True)), "id", "left")
    fault = F.when(F.col("known").isNull(), "unknown").when(F.col("nth") > 1, "repeated")
    rejected = known.withColumn("fault", fault).where("fault is not null").select("id", "to", "actor", "reason", "fault")
    return out.select(*signals.columns), events, rejected


def resolve_for_merge(signals: DataFrame, merged_ids: DataFrame, now: datetime, actor: str = "reconcile") -> tuple[DataFrame, DataFrame]:
    """(signals', events): active signals of merged manufacturers (column manufacturer_id) are resolved."""
    requests = signals.where("status = 'active'").join(merged_ids.select("manufacturer_id").distinct(), "manufacturer_id", "left_semi")
    requests = requests.select(F.col("id").alias("signal_id"), F.lit("resolved").alias("to"), F.lit(actor).alias("actor"), F.lit(MERGED).alias("reason"))
    out, events, _ = transition(signals, requests, now)
    return out, events


def list_signals(signals: DataFrame, current_hash: str, kind: str | None = None, status: str | None = "active") -> DataFrame:
    """Signals of a kind and status, with a flag where the settings have changed since."""
    if kind is not None:
        signals = signals.where(F.col("kind") == kind)
    if status is not None:
        signals = signals.where(F.col("status") == status)
    return signals.withColumn("stale", ~F.col("evidence.config_hash").eqNullSafe(F.lit(current_hash)))


def get_signals(ids: DataFrame, signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, missing) for a column ``id``."""
    return ids.select("id").join(signals, "id"), ids.select("id").join(signals, "id", "left_anti")


def iso_time(col: Column) -> Column:
    """A timestamp as ISO text in UTC, whatever the session's zone; a fraction only where there is one."""
    utc = F.to_utc_timestamp(col, F.current_timezone())
    fraction = F.date_format(utc, "SSSSSS")
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)), F.lit("+00:00"))


def explain(signals: DataFrame) -> DataFrame:
    """(id, explanation): the trace of each signal in fixed order. The labels are fixed values."""
    e = lambda n, other="(unknown)": F.coalesce(F.col(f"evidence.{n}").cast("string"), F.lit(other))
    line = lambda label, value: F.concat(F.lit(label), value)
    ids = lambda label, n: F.transform(F.sort_array(F.coalesce(F.col(f"evidence.{n}"), F.array().cast("array<string>"))), lambda x: F.concat(F.lit(label), x))
    regions = F.array_join(F.coalesce("regions_affected", F.array().cast("array<string>")), ", ")
    lines = F.concat(
        F.array(
            line("Signal ID : ", F.col("id")), line("Kind      : ", F.col("kind")), line("Severity  : ", F.col("severity")), line("Status    : ", F.col("status")),
            line("Ingredient: ", F.coalesce("active_ingredient", F.lit("(none)"))), line("Regions   : ", F.when(regions == "", "(none)").otherwise(regions)),
            line("First seen: ", F.coalesce(iso_time(F.col("first_seen")), F.lit("(unknown)"))), line("Updated   : ", F.coalesce(iso_time(F.col("last_updated")), F.lit("(unknown)"))),
            F.lit(""), F.lit("Rule"), line("  Version    : ", e("rule_version")), F.concat(F.lit("  Config hash: "), F.substring(e("config_hash", ""), 1, 16), F.lit("...")),
            line("  Computed at: ", F.coalesce(iso_time(F.col("evidence.computed_at")), F.lit("(unknown)"))), line("  As of      : ", e("as_of")), F.lit(""), F.lit("Evidence"),
        ),
        ids("  Document: ", "document_ids"), ids("  Supply  : ", "supply_ids"),
        F.when(F.coalesce("recommended_action", F.lit("")) != "", F.array(F.lit(""), F.lit("Recommendation"), line("  ", F.col("recommended_action")))).otherwise(F.array().cast("array<string>")),
    )
    return signals.select("id", F.array_join(lines, "\n").alias("explanation"))
