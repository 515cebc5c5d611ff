"""The rules on small tables with known results."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lotwatch.config import Corroboration, RiskConfig, SupplyChain, load_config
from lotwatch.operators import jobs, rules, signals
from lotwatch.plans.risk import EMPTY_SIGNALS

AS_OF = date(2026, 5, 1)
DOC = "id string, canonical_manufacturer_ids array<string>, active_ingredients array<string>, severity string, date_published date, document_type string, jurisdiction string"


def docs(spark, rows):
    """rows: (manufacturer, severity, days before AS_OF, jurisdiction, ingredient)"""
    return spark.createDataFrame([(f"d{n}", [m], [i] if i is not None else [], s, AS_OF - timedelta(days=d), "recall", j) for n, (m, s, d, j, i) in enumerate(rows)], DOC)


def makers(spark):
    return spark.createDataFrame([("m", "Maker")], "id string, canonical_name string")


@pytest.mark.parametrize(
    "severities, level",
    [(["class_2"] * 2, None), (["class_2"] * 3, "medium"), (["class_1"] * 4, "high"), (["unclassified"] * 5, "medium"), ([None] * 5, "medium"), (["class_1"] * 6, "critical"), (["odd"] * 4, "medium")],
)
def test_levels(spark, severities, level):
    out = rules.repeat_violators(docs(spark, [("m", s, 10, "KE", "a") for s in severities]), makers(spark), AS_OF).collect()
    assert [r["severity"] for r in out] == ([level] if level else [])
    if level:
        assert len(out[0]["evidence_document_ids"]) == len(severities) and "Maker" in out[0]["recommended_action"]


def test_window_edges(spark):
    rows = docs(spark, [("m", "class_1", 720, "KE", "a"), ("m", "class_1", -1, "KE", "a"), ("m", "class_1", 721, "KE", "a"), ("m", "class_1", 0, "KE", "a")])
    assert [r["id"] for r in rules.recall_window(rows, AS_OF).orderBy("id").collect()] == ["d0", "d3"]


def test_top_ingredient_ties_by_name(spark):
    rows = docs(spark, [("m", "class_1", 1, "KE", x) for x in "bbaac"])
    assert rules.repeat_violators(rows, makers(spark), AS_OF).first()["active_ingredient"] == "a"


def test_nulls_in_ingredients_count_nothing(spark):
    rows = docs(spark, [("m", "class_3", n, "KE", "a") for n in range(3)]).withColumn("active_ingredients", F.array(F.lit(None).cast("string"), F.lit("a"), F.lit(None).cast("string")))
    assert rules.repeat_violators(rows, makers(spark), AS_OF).isEmpty()
    out = rules.repeat_violators(rows.unionByName(rows.withColumn("id", F.concat("id", F.lit("b")))), makers(spark), AS_OF).first()
    assert (out["recall_count"], out["weighted_score"], len(out["evidence_document_ids"]), out["active_ingredient"]) == (6, 6, 6, "a")


def test_states_hold_evidence_and_nulls(spark):
    import json

    kept, events, _ = run(spark, FIVE)
    new = json.loads(events.first()["new_state"])
    assert new["evidence"]["document_ids"] == [f"d{n}" for n in range(5)] and new["evidence"]["recall_count"] == 5 and "jurisdictions" not in new["evidence"]
    assert new["exposure_pct"] is None and new["alternative_supplier_count"] is None and new["regions_affected"] == [] and new["last_updated"] == "2026-05-02T00:00:00+00:00"
    _, events, _ = run(spark, FIVE + FIVE[:1], fixed(spark, kept), now=datetime(2026, 5, 3))
    states = [json.loads(events.first()[c]) for c in ("old_state", "new_state")]
    assert [len(s["evidence"]["document_ids"]) for s in states] == [5, 6] and states[0] != states[1]


def test_corroboration(spark):
    rows = docs(spark, [("m", "class_1", 1, "US", "a"), ("n", "class_1", 1, "ZA", "a"), ("n", "class_1", 1, "ZA", "b"), ("n", "class_1", 1, "US", "")])
    out = rules.corroboration(rows, AS_OF).collect()
    assert [(r["active_ingredient"], r["severity"], r["regions_affected"]) for r in out] == [("a", "medium", ["US", "ZA"])]
    assert rules.corroboration(rows, AS_OF, Corroboration(enable=False)).isEmpty()


def supply_case(spark, facts, ingredient="Drug Sodium", others=()):
    found = rules.candidates(spark.createDataFrame([("m", ingredient, ["d1"])], "manufacturer_id string, active_ingredient string, evidence_document_ids array<string>"))
    suppliers = spark.createDataFrame([("s", "m"), *[(o, "else") for o in others]], "id string, manufacturer_id string")
    rows = [(f"f{n}", c, s, "drug", share, lead) for n, (c, s, share, lead) in enumerate(facts)]
    supply = spark.createDataFrame(rows, "id string, county_id string, supplier_id string, active_ingredient string, share_pct double, lead_time_days int").withColumn("share_pct", F.col("share_pct").cast("decimal(5,2)"))
    counties = spark.createDataFrame([("c1", "One", 100), ("c2", "Two", 300)], "id string, name string, population int")
    return rules.supply_chain_exposure(found, suppliers, supply, counties, makers(spark), SupplyChain()).collect()


def test_supply(spark):
    assert supply_case(spark, [("c1", "s", 20.0, 10)]) == []
    one = supply_case(spark, [("c1", "s", 40.0, 45)])[0]
    assert (float(one["exposure_pct"]), one["regions_affected"], one["time_to_expiry_days"], one["severity"], one["alternative_supplier_count"]) == (40.0, ["One"], 60, "medium", 0)
    two = supply_case(spark, [("c1", "s", 40.0, 90), ("c1", "o1", 30.0, 1), ("c1", "o2", 30.0, 1), ("c2", "o3", 30.0, 1)], others=("o1", "o2", "o3"))[0]
    assert (two["alternative_supplier_count"], two["time_to_expiry_days"]) == (2, 90)
    both = supply_case(spark, [("c1", "s", 30.0, 1), ("c2", "s", 70.0, 1)])
    assert len(both) == 1 and both[0]["regions_affected"] == ["One", "Two"] and float(both[0]["exposure_pct"]) == 60.0
    assert supply_case(spark, [("c1", "s", 80.0, 1)], ingredient=None) == []


NOW = datetime(2026, 5, 2)


def run(spark, rows, stored=None, events=None, now=NOW, as_of=AS_OF):
    found = rules.repeat_violators(docs(spark, rows), makers(spark), as_of)
    stored = stored if stored is not None else spark.createDataFrame([], EMPTY_SIGNALS)
    events = events if events is not None else spark.createDataFrame([], signals.EVENT)
    return signals.persist_signals(found, stored, events, RiskConfig(), as_of, now)


def fixed(spark, df):
    return spark.createDataFrame(df.collect(), df.schema)


FIVE = [("m", "class_2", n, "KE", "a") for n in range(5)]


def test_signal_states(spark):
    kept, events, rows = run(spark, FIVE)
    assert [r["event_type"] for r in events.collect()] == ["created"] and kept.count() == 1
    kept = fixed(spark, kept)
    _, events, rows = run(spark, FIVE, kept, now=datetime(2026, 5, 3))
    assert [r["action"] for r in rows.collect()] == ["unchanged"] and events.isEmpty()
    new, events, _ = run(spark, FIVE + FIVE[:1], kept, now=datetime(2026, 5, 3))
    assert [r["event_type"] for r in events.collect()] == ["updated"] and new.first()["first_seen"] == NOW
    new, events, rows = run(spark, FIVE[:1], kept, now=datetime(2026, 5, 3))
    assert [r["action"] for r in rows.collect()] == ["resolved"] and new.first()["status"] == "resolved" and new.first()["resolved_at"] == datetime(2026, 5, 3)
    text = signals.explain(kept).first()["explanation"]
    assert "Document: d0" in text and text.startswith("Signal ID : ")


def test_merge_carries_first_seen(spark):
    kept = fixed(spark, run(spark, FIVE)[0])
    gone, events = signals.resolve_for_merge(kept, spark.createDataFrame([("m",)], "manufacturer_id string"), datetime(2026, 5, 4))
    gone, events = fixed(spark, gone), fixed(spark, events)
    assert events.first()["reason"] == signals.MERGED
    moved = [("n", *r[1:]) for r in FIVE]
    new, _, _ = run(spark, moved, gone, events, now=datetime(2026, 5, 5))
    assert new.where("status = 'active'").first()["first_seen"] == NOW
    late, _, _ = run(spark, moved, gone, events, now=datetime(2026, 6, 5))
    assert late.where("status = 'active'").first()["first_seen"] == datetime(2026, 6, 5)


def test_transitions(spark):
    kept = fixed(spark, run(spark, FIVE)[0])
    asked = spark.createDataFrame([(kept.first()["id"], "suppressed", "me", "why"), ("nobody", "resolved", "me", "why")], "signal_id string, to string, actor string, reason string")
    out, events, unknown = signals.transition(kept, asked, NOW)
    assert out.first()["status"] == "suppressed" and events.first()["actor"] == "me" and unknown.first()["id"] == "nobody"
    assert run(spark, FIVE, fixed(spark, out))[0].where("status = 'active'").count() == 1
    found = rules.repeat_violators(docs(spark, FIVE), makers(spark), AS_OF)
    muted = signals.persist_signals(found, fixed(spark, out), spark.createDataFrame([], signals.EVENT), RiskConfig(), AS_OF, NOW, respect_suppressed=True)
    assert muted[0].where("status = 'active'").isEmpty()
    assert signals.get_signals(spark.createDataFrame([("x",)], "id string"), kept)[1].count() == 1
    assert signals.list_signals(kept, RiskConfig().config_hash).first()["stale"] is False


def test_repeated_requests(spark):
    """One request for a signal is carried out, the last by seq; suppressed signals have a time of resolution too."""
    kept = fixed(spark, run(spark, FIVE)[0])
    one = kept.first()["id"]
    asked = spark.createDataFrame([(one, "suppressed", "me", "a", 1), (one, "resolved", "me", "b", 2), ("nobody", "resolved", "me", "c", 3)], "signal_id string, to string, actor string, reason string, seq int")
    out, events, rejected = signals.transition(kept, asked, NOW)
    assert out.count() == kept.count() and events.count() == 1 and events.first()["event_type"] == "resolved"
    assert {(r["id"], r["fault"], r["reason"]) for r in rejected.collect()} == {(one, "repeated", "a"), ("nobody", "unknown", "c")}
    muted = signals.transition(kept, asked.where("seq = 1"), NOW)[0].where("status = 'suppressed'").collect()
    assert len(muted) == 1 and muted[0]["resolved_at"] is not None


def test_keys_with_separators(spark):
    """The parts of a key don't run together."""
    columns = "kind string, severity string, manufacturer_id string, active_ingredient string, regions_affected array<string>, evidence struct<as_of: date, computed_at: timestamp>"
    one = spark.createDataFrame([("k", "low", "x|y", "z", [], None)], columns)
    two = spark.createDataFrame([("k", "low", "x", "y|z", [], None)], columns).selectExpr("*", "'1' as id", "'active' as status")
    assert sorted(r["action"] for r in signals.merged(one, two).collect()) == ["created", "resolved"]


def test_normalized_ingredients_count_together(spark):
    table = docs(spark, [("m", "class_1", 1, "US", i) for i in ("Atorvastatin Calcium", "atorvastatin", "b", "b", "ATORVASTATIN")])
    assert rules.repeat_violators(table, makers(spark), AS_OF).first()["active_ingredient"] == "atorvastatin"


def test_whole_run(spark):
    tables = {
        "documents": docs(spark, FIVE + [("n", "class_2", 1, "ZA", "a")]), "manufacturers": makers(spark), "suppliers": spark.createDataFrame([("s", "m")], "id string, manufacturer_id string"),
        "county_supply": spark.createDataFrame([("f", "c1", "s", "a", 60, 5)], "id string, county_id string, supplier_id string, active_ingredient string, share_pct int, lead_time_days int"),
        "counties": spark.createDataFrame([("c1", "One", 10)], "id string, name string, population int"), "signals": spark.createDataFrame([], EMPTY_SIGNALS), "events": spark.createDataFrame([], signals.EVENT),
    }
    out = jobs.run_risk(tables, AS_OF, NOW)["signals"].collect()
    got = {r["kind"]: (r["severity"], r["recommended_action"]) for r in out}
    assert got["repeat_violator"][0] == "critical" and got["supply_chain_exposure"][0] == "critical" and got["cross_source_corroboration"][0] == "medium"
    assert got["supply_chain_exposure"][1].endswith(signals.SYNTHETIC_SUFFIX)


def test_settings(tmp_path):
    path = tmp_path / "rules.yaml"
    path.write_text("""version: "2"
repeat_violator:
  window_months: 12
  severity_weights:
    class_1: 5
  thresholds:
    medium:
      min_recalls: 1
      min_weighted_score: 2
supply_chain_exposure:
  min_county_share_pct: 10.5
  min_alternative_suppliers_for_low: 2
  time_to_expiry_floor_days: 30
cross_source_corroboration:
  enable: false
  jurisdiction_count_for_boost: 3
  boost_levels: 2
""")
    cfg = load_config(str(path))
    assert cfg.version == "2" and cfg.repeat_violator.thresholds["medium"].min_weighted_score == 2 and cfg.supply_chain_exposure.min_county_share_pct == 10.5
    assert cfg.cross_source_corroboration.enable is False and cfg.config_hash != RiskConfig().config_hash
    with pytest.raises(ValueError):
        rules.register("repeat_violator")(None)


def test_backfill_over_a_table_of_dates(spark):
    """Ten thousand dates: the rows of the list form, joined by periods and not by a nested loop."""
    rows = docs(spark, [("m", "class_1", d, "KE", "a") for d in (0, 1, 29, 30, 719, 720, 721, 5000, 9999)])
    days = [AS_OF - timedelta(days=n) for n in range(-10, 9990)]
    table = spark.createDataFrame([(d,) for d in days + days[:5]] + [(None,)], "as_of date")
    out = rules.as_of_backfill(rows, table)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = sorted((r["as_of"], r["id"]) for r in out.select("as_of", "id").collect())
    published = {r["id"]: r["date_published"] for r in rows.collect()}
    assert got == sorted((d, k) for d in days for k, p in published.items() if d - timedelta(days=720) <= p <= d)
    some = days[::997]
    few = spark.createDataFrame([(d,) for d in some], "as_of date")
    assert sorted((r["as_of"], r["id"]) for r in rules.as_of_backfill(rows, few).collect()) == sorted((r["as_of"], r["id"]) for r in rules.as_of_backfill(rows, some).collect())


def test_alternatives_by_bitmaps(spark):
    """More suppliers than one bitmap holds; the linked ones don't count, whether they offer or not; counties aren't multiplied by offers."""
    import random

    rng = random.Random(1)
    facts = spark.range(70_000).selectExpr("concat('c', id % 3) as county_id", "concat('s', id % 40000) as supplier_id", "if(id % 2 = 0, 'x', 'y') as active_ingredient")
    exposed = [(m, "X", "x", f"c{c}") for m in ("m1", "m2", "m3") for c in range(3) if rng.random() < 0.7] + [("m4", "Y", "y", "c1"), ("m5", "Z", "z", "c1")]
    links = [("m1", f"s{k}") for k in range(0, 39_000, 7)] + [("m2", "none"), ("m4", "s1"), (None, "s2")]
    exposed_df = spark.createDataFrame(exposed, "manufacturer_id string, active_ingredient string, ingredient_key string, county_id string")
    got = rules.alternative_suppliers(exposed_df, spark.createDataFrame(links, "manufacturer_id string, id string"), facts)
    offers, expect = {}, {}
    for r in facts.collect():
        offers.setdefault((r["county_id"], r["active_ingredient"]), set()).add(r["supplier_id"])
    for m, name, key, county in exposed:
        expect.setdefault((m, name), set()).update(offers.get((county, key), set()) - {s for o, s in links if o == m})
    assert {(r["manufacturer_id"], r["active_ingredient"]): r["alternative_supplier_count"] for r in got.collect()} == {k: len(v) for k, v in expect.items() if v}
