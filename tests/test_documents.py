"""Document states, names, procurement, pages, sinks and streams on small tables."""

import json
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lotwatch.operators import documents as docs
from lotwatch.operators import manufacturers as m
from lotwatch.operators import procurement, reports
from lotwatch.sources import dims, landed, sinks
from lotwatch.streaming import jobs

STATE = "id string, source_id string, source_url string, source_hash string, normalized_hash string"


def upsert(spark, stored, batch, **kw):
    a = spark.createDataFrame(stored, STATE)
    b = spark.createDataFrame([(f"new{n}", "s", u, h, x, n) for n, (u, h, x) in enumerate(batch)], STATE + ", seq long")
    new, versions, log, counts = docs.upsert(a, b, **kw)
    return {r["source_url"]: (r["id"], r["normalized_hash"]) for r in new.collect()}, sorted((r["source_url"], r["normalized_hash"]) for r in versions.collect()), [r["action"] for r in log.orderBy("seq").collect()], counts.collect()


def test_upsert_outcomes(spark):
    stored = [("1", "s", "u1", "h1", "x1"), ("2", "s", "u2", "h2", "x2")]
    batch = [("u1", "h1", "x1"), ("u2", "h9", "x9"), ("u3", "h1", "x1"), ("u4", "h4", "x4")]
    state, versions, actions, counts = upsert(spark, stored, batch)
    assert actions == ["skip_unchanged", "update", "skip_same_bytes", "insert"]
    assert state == {"u1": ("1", "x1"), "u2": ("2", "x9"), "u4": ("new3", "x4")} and versions == [("u2", "x2")]
    assert (counts[0]["added"], counts[0]["updated"], counts[0]["skipped"]) == (1, 1, 2)
    assert upsert(spark, stored, batch, check_for_updates=False)[2] == ["skip_known", "skip_known", "skip_same_bytes", "insert"]


def test_upsert_within_a_batch(spark):
    state, versions, actions, _ = upsert(spark, [], [("u1", "h1", "x1"), ("u1", "h2", "x2"), ("u1", "h2", "x2"), ("u2", "h1", "x1"), ("u1", "h3", "x1")])
    assert actions == ["insert", "update", "skip_unchanged", "skip_same_bytes", "update"]
    assert state == {"u1": ("new0", "x1")}  # the id of the insert and versions == [("u1", "x1"), ("u1", "x2")]
    again, versions, actions, _ = upsert(spark, [("9", "s", "u1", "h3", "x1")], [("u1", "h3", "x1")])
    assert actions == ["skip_unchanged"] and versions == []


def test_dedup_and_reference(spark):
    rows = spark.createDataFrame([("a", "s", "u", 1, None), ("b", "s", "u", 3, "h"), ("c", "s", "u", 2, "g"), ("d", "s", "v", 1, "k")], "id string, source_id string, source_url string, created_at int, normalized_hash string")
    kept, versions = docs.dedup(rows)
    assert {r["id"] for r in kept.collect()} == {"b", "d"} and {(r["document_id"], r["normalized_hash"]) for r in versions.collect()} == {("b", ""), ("b", "g")}
    child, parent = spark.createDataFrame([(1, "x"), (2, "y")], "n int, p string"), spark.createDataFrame([("x",)], "id string")
    assert [r["n"] for r in docs.enforce_reference(child, parent, "p").collect()] == [1]
    assert {(r["n"], r["p"]) for r in docs.enforce_reference(child, parent, "p", "set null").collect()} == {(1, "x"), (2, None)}


def brute_token_set(a, b):
    def lcs(x, y):
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, c in enumerate(x):
            for j, d in enumerate(y):
                t[i + 1][j + 1] = t[i][j] + 1 if c == d else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    ratio = lambda x, y: 200 * lcs(x, y) / (len(x) + len(y)) if x or y else 100
    s, u = set(a.split()), set(b.split())
    if not s or not u:
        return 0
    both, p, q = " ".join(sorted(s & u)), " ".join(sorted(s - u)), " ".join(sorted(u - s))
    if both and (not p or not q):
        return 100
    x, y = (both + " " + p).strip(), (both + " " + q).strip()
    return max(ratio(x, y), ratio(both, x) if both else 0, ratio(both, y) if both else 0)


def test_blocking_loses_nothing(spark):
    rng = random.Random(3)
    base = ["aspen care", "cipla medpro africa", "sun", "sunrise", "roche basel products", "bayer", "bayer consumer", "novo nordisk", "dr reddys laboratories"]
    names = set(base)
    for b in base * 12:
        t = list(b)
        for _ in range(rng.randint(1, 2)):
            k = rng.randrange(len(t))
            t[k] = rng.choice("abcdefgh ")
        names.add(" ".join("".join(t).split()))
    names = sorted(n for n in names if n)
    expect = {(a, b) for a in names for b in names if brute_token_set(a, b) >= 92}
    left = spark.createDataFrame([(n,) for n in names], "a string")
    got = {(r["a"], r["b"]): r["score"] for r in m.similar_pairs(left, left.withColumnRenamed("a", "b")).collect()}
    assert set(got) == expect
    assert all(abs(s - brute_token_set(a, b)) < 1e-9 for (a, b), s in got.items())


DIM = "id string, canonical_name string, aliases array<string>, countries array<string>, confidence double, ordinal int"


def test_reconcile(spark):
    dim = spark.createDataFrame([("1", "Cipla", ["Cipla Medpro"], [], 1.0, 0), ("2", "Bayer AG", [], [], 1.0, 1)], DIM)
    over = m.overrides_table(spark, {"Zeta Works": ["Special Name"]})
    rows = spark.createDataFrame([("d1", ["CIPLA LTD", "Bayer Consumer"], ["2"]), ("d2", ["Special Name", "Cipla Medpro"], []), ("d3", ["Fresh Co", "FRESH LIMITED", " "], []), ("d4", [], ["9"])], "id string, manufacturers array<string>, canonical_manufacturer_ids array<string>")
    out = m.reconcile(rows, dim, over)
    got = {r["raw"]: (r["action"], r["canonical"]) for r in out["results"].collect()}
    assert got == {"CIPLA LTD": ("exact", "Cipla"), "Bayer Consumer": ("fuzzy", "Bayer AG"), "Special Name": ("override", "Zeta Works"), "Cipla Medpro": ("exact", "Cipla"), "FRESH LIMITED": ("new", "FRESH LIMITED"), "Fresh Co": ("exact", "FRESH LIMITED")}
    linked = {r["id"]: r["canonical_manufacturer_ids"] for r in out["documents"].collect()}
    assert linked["d1"] == ["1", "2"] and linked["d2"][1:] == ["1"] and len(linked["d3"]) == 1 and linked["d4"] == []
    grown = {r["canonical_name"]: r["aliases"] for r in out["manufacturers"].collect()}
    assert grown["Cipla"] == ["Cipla Medpro", "CIPLA LTD"] and grown["Zeta Works"] == ["Special Name"] and grown["FRESH LIMITED"] == ["Fresh Co"]
    assert [r[0] for r in m.fully_displaced(rows, out["documents"]).collect()] == ["9"]
    again = m.reconcile(rows, spark.createDataFrame(out["manufacturers"].collect(), DIM), over)["results"]
    assert {r["action"] for r in again.collect()} == {"override", "exact"}


def test_clusters(spark):
    def clusters(names, over=None):
        rows = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "raw string, ordinal int")
        table = m.overrides_table(spark, over or {"Nobody": []})
        return {r["raw"]: r["canonical"] for r in m.cluster_names(rows, table).collect()}

    assert len(set(clusters(["Cipla Ltd", "CIPLA LIMITED"]).values())) == 1
    assert len(set(clusters(["Sun Pharma", "Sunrise Pharma"]).values())) == 2
    assert clusters(["Bayer AG", "Bayer Consumer", "Other"]) == {"Bayer AG": "Bayer AG", "Bayer Consumer": "Bayer AG", "Other": "Other"}
    assert clusters(["GSK", "GlaxoSmithKline plc"], {"GlaxoSmithKline": ["GSK"]}) == {"GSK": "GlaxoSmithKline", "GlaxoSmithKline plc": "GlaxoSmithKline"}


def test_merge(spark):
    from lotwatch.plans.risk import EMPTY_SIGNALS

    dim = spark.createDataFrame([("1", "A", ["a1"], [], 1.0, 0), ("2", "B", ["b1", "A"], [], 1.0, 1)], DIM)
    rows = spark.createDataFrame([("d1", ["2", "1"]), ("d2", ["3"])], "id string, canonical_manufacturer_ids array<string>")
    pairs = spark.createDataFrame([("2", "1"), ("7", "1")], "source string, target string")
    out = m.merge(dim, rows, spark.createDataFrame([], EMPTY_SIGNALS), pairs, datetime(2026, 1, 1))
    assert [(r["canonical_name"], r["aliases"]) for r in out["manufacturers"].collect()] == [("A", ["a1", "B", "b1"])]
    assert {r["id"]: r["canonical_manufacturer_ids"] for r in out["documents"].collect()} == {"d1": ["1"], "d2": ["3"]}
    assert [r["source"] for r in out["errors"].collect()] == ["7"]


def test_merge_of_pair_sets(spark):
    """Chains end at the last survivor; a pair of one id, cycles and second targets are errors and change nothing."""
    from lotwatch.plans.risk import EMPTY_SIGNALS

    dim = spark.createDataFrame([(k, k.upper(), [f"{k}1"], [], 1.0, n) for n, k in enumerate("abcdefgh")], DIM)
    rows = spark.createDataFrame([("d1", ["a", "b"]), ("d2", ["d", "a"]), ("d3", ["e", "g"])], "id string, canonical_manufacturer_ids array<string>")
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "d"), ("e", "f"), ("f", "g"), ("g", "e"), ("h", "c"), ("h", "d"), ("a", "b")], "source string, target string")
    out = m.merge(dim, rows, spark.createDataFrame([], EMPTY_SIGNALS), pairs, datetime(2026, 1, 1))
    assert {r["id"]: r["aliases"] for r in out["manufacturers"].collect()} == {"c": ["c1", "A", "a1", "B", "b1", "H", "h1"], "d": ["d1"], "e": ["e1"], "f": ["f1"], "g": ["g1"]}
    assert {r["id"]: r["canonical_manufacturer_ids"] for r in out["documents"].collect()} == {"d1": ["c"], "d2": ["d", "c"], "d3": ["e", "g"]}
    assert sorted((r["source"], r["target"], r["fault"]) for r in out["errors"].collect()) == [("d", "d", "same"), ("e", "f", "cycle"), ("f", "g", "cycle"), ("g", "e", "cycle"), ("h", "d", "second target")]
    chain = spark.createDataFrame([(f"{k:03d}", f"{k + 1:03d}") for k in range(100)], "source string, target string")
    assert {r["target"] for r in m.survivors(chain)[0].collect()} == {"100"}


def test_sections_end_with_what_holds_them():
    page = "<div><p>see the <b>brief description</b> of it</p><p>x</p></div><div><p><strong>Proposed action</strong></p><p>act</p><p></p><p>more</p></div><div><p>Copyright</p></div><div><strong>Brief description</strong><p>in one</p></div>"
    assert landed._sections(landed.tree(page)) == {"proposed": "act\nmore", "reason": "in one"}
    address = "<h1>N</h1><table><tr><td>Company name</td><td>Recall date</td></tr><tr><td>" + "<br>".join(f"l{n}" for n in range(1200)) + "</td><td>4 May 2026</td></tr></table>"
    assert landed._detail("u", address)[0]["company"].count("\n") == 1199


def test_unknown_bytes_are_like_no_others(spark):
    state, _, actions, _ = upsert(spark, [("1", "s", "u0", None, "x")], [("u1", None, "x1"), ("u2", None, "x1"), ("u1", None, "x1"), ("u0", None, "x")])
    assert actions == ["insert", "insert", "skip_unchanged", "skip_unchanged"] and set(state) == {"u0", "u1", "u2"}


def test_procurement(spark, tmp_path):
    (tmp_path / "counties.csv").write_text("id,name,region,population,health_facilities\nk1,Nairobi,C,100,5\nk2,Kisumu,W,50,2\n")
    (tmp_path / "suppliers.csv").write_text('id,name,role,countries_served\ns1,Maker,manufacturer,"KE, ,UG"\ns2,Maker,distributor,KE\n')
    (tmp_path / "county_supply.csv").write_text("id,county_id,supplier_id,active_ingredient,share_pct,lead_time_days,contract_start,contract_end\nf1,k1,s1,Drug Sodium,60,10,2024-01-01,bad\nf2,k1,s2,drug,30,10,,\n")
    raw = landed.read_procurement_csv(spark, str(tmp_path))
    assert raw["suppliers"].where("id = 's1'").first()["countries_served"] == ["KE", "UG"] and raw["county_supply"].where("id = 'f1'").first()["contract_end"] is None
    dim = spark.createDataFrame([("m1", "Maker", [], [], 1.0, 0)], DIM)
    empty = {
        "counties": spark.createDataFrame([("old", "Nairobi", "C", 90, 4)], landed.COUNTIES), "suppliers": spark.createDataFrame([], "id string, name string, role string, countries_served array<string>, manufacturer_id string"),
        "county_supply": spark.createDataFrame([], "id string, county_id string, supplier_id string, active_ingredient string, share_pct decimal(5,2), lead_time_days int, contract_start date, contract_end date, data_source string"),
    }
    out = procurement.load(raw, empty, dim, "v1")
    assert {r["name"]: r["id"] for r in out["counties"].collect()} == {"Nairobi": "old", "Kisumu": "k2"}
    assert {r["id"]: r["manufacturer_id"] for r in out["suppliers"].collect()} == {"s1": "m1", "s2": None}
    assert {(r["id"], r["county_id"], r["active_ingredient"]) for r in out["county_supply"].collect()} == {("f1", "old", "drug"), ("f2", "old", "drug")}
    assert out["warnings"].count() == 1
    stored = {k: spark.createDataFrame(out[k].collect(), out[k].schema) for k in empty}
    assert procurement.load(raw, stored, dim, "v1")["county_supply"].count() == 2


LISTING = """<html><body><table><tr><td>x</td></tr></table><table><thead><tr><th>S/N</th><th>Date recall was initiated</th><th>Ref</th><th>Product</th><th>INN</th><th>Batch Number(s)</th><th>Manufacturer</th><th>Reason</th><th>Status</th></tr></thead>
<tr><td>1.</td><td>29/12/2025</td><td>REC/2025/045</td><td><a href="/med/">Medopress</a></td><td>Methyldopa 250mg</td><td>B1<br>B2, B3</td><td>Cosmos Limited, Kenya</td><td>Spots</td><td>Done</td></tr>
<tr><td>2.</td><td>soon</td><td>R2</td><td>X</td><td></td><td></td><td></td><td></td><td></td></tr><tr><td>3.</td><td>1 May 2025</td><td>R/3</td><td>Plain</td><td>Paracetamol</td><td></td><td>Firm</td><td></td><td>Open</td></tr></table></body></html>"""
DETAIL = """<html><body><article class="dlp_document"><h1><span>Halaven (Eribulin)</span></h1><table><tr><td><strong>Company name &amp; Address:</strong></td><td><strong>Product strength</strong></td><td><strong>registration number</strong></td><td><strong>Batch number(s)</strong></td><td><strong>Re-call Classification</strong></td><td><strong>Recall date</strong></td></tr>
<tr><td>Eisai Africa (Pty) Ltd<p>2nd Floor</p><p>Bryanston</p></td><td>1 mg</td><td>&nbsp;<p>48/26/0047</p></td><td><p>148482</p><p>148483</p></td><td><p>Class II Type C</p></td><td>&nbsp;<p>%s</p></td></tr></table>
<p><strong><u>Brief description of the problem</u></strong></p><p>Out of specification.</p><p>Low assay.</p><p><strong>Advice for health professionals:</strong></p><p>Stop.</p><p><em>Proposed action taken:</em> A letter was sent.</p><p><strong>Reporting side effects</strong></p>
<a class="document-library-pro-button x" href="https://x/p.pdf">Download</a></article></body></html>"""
CARDS = """<article class="post dlp_document"><h2 class="entry_title"><a href="https://x/a/">A (B)</a></h2><p class="post_excerpt">Recall date
06 December 2024
04 May 2026

Brief description of the problem</p></article><article class="dlp_document"><h2 class="entry_title">no link</h2></article><article class="dlp_document"><h2 class="entry_title"><a href="https://x/b/">C</a></h2></article>"""


def test_pages(spark):
    pages = spark.createDataFrame([("http://x/2025/", LISTING), ("http://x/none", "<p>nothing</p>"), ("http://x/null", None)], "url string, html string")
    rows = landed.extract_recall_rows(pages)
    assert rows.count() == 3
    out = {r["document_id"]: r for r in landed.normalize_listing_rows(rows).collect()}
    one = out["REC/2025/045"]
    assert set(out) == {"REC/2025/045", "R/3"} and one["source_url"] == "http://x/med/" and one["active_ingredients"] == ["Methyldopa"] and one["regions_affected"] == ["Kenya"]
    assert one["title"] == "Medopress recall (REC/2025/045)" and one["raw_metadata"]["batch_numbers"] == ["B1", "B2", "B3"] and one["date_published"] == date(2025, 12, 29)
    assert out["R/3"]["source_url"] == "http://x/2025/#R-3" and out["R/3"]["active_ingredients"] == ["acetaminophen"]
    details = spark.createDataFrame([("http://x/halaven/", DETAIL % "04 May 2026"), ("http://x/bad/", DETAIL % "unknown")], "url string, html string")
    good, bad = landed.extract_recall_details(details)
    d = good.first()
    assert (d["document_id"], d["product_names"], d["active_ingredients"], d["manufacturers"], d["severity"], d["date_published"]) == ("48/26/0047", ["Halaven"], ["Eribulin"], ["Eisai Africa (Pty) Ltd"], "class_2", date(2026, 5, 4))
    meta = d["raw_metadata"]
    assert meta["batch_numbers"] == ["148482", "148483"] and meta["manufacturer_address"] == "2nd Floor\nBryanston" and meta["recall_reason"] == "Out of specification.\nLow assay."
    assert meta["advice"] == "Stop.\n\nA letter was sent." and meta["pdf_url"] == "https://x/p.pdf" and bad.count() == 1
    cards = {r["detail_url"]: r["card_date"] for r in landed.extract_listing_cards(spark.createDataFrame([("http://x", CARDS)], "url string, html string")).collect()}
    assert cards == {"https://x/a/": date(2026, 5, 4), "https://x/b/": None}


def test_enforcement(spark, tmp_path):
    record = {"recall_number": "D-1", "reason_for_recall": "Bad", "product_description": "Pill", "recalling_firm": "Firm", "classification": "Class II", "report_date": "20240105", "distribution_pattern": "KE; UG;", "openfda": {"generic_name": ["PARACETAMOL", " "]}}
    (tmp_path / "a.json").write_text(json.dumps({"meta": {"results": {"total": 2}}, "results": [record, record | {"recall_number": "D-2", "openfda": {"generic_name": "A; B"}, "reason_for_recall": None, "report_date": "x", "recalling_firm": None}]}))
    (tmp_path / "b.json").write_text(json.dumps({"meta": {"results": {"total": 0}}, "results": []}))
    out, errors = landed.read_enforcement_json(spark, str(tmp_path), date(2024, 2, 1))
    got = {r["document_id"]: r for r in out.collect()}
    assert errors.count() == 1 and got["D-1"]["active_ingredients"] == ["acetaminophen"] and got["D-1"]["severity"] == "class_2" and got["D-1"]["regions_affected"] == ["KE", "UG"]
    assert got["D-2"]["active_ingredients"] == ["A", "B"] and got["D-2"]["title"] == "D-2" and got["D-2"]["date_published"] == date(2024, 2, 1) and got["D-2"]["manufacturers"] == []
    with pytest.raises(ValueError):
        landed.register("listing")(None)


def test_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "one.txt").write_text("a\nb")
    assert [(r["name"], r["text"]) for r in landed.read_text_corpus(spark, str(tmp_path / "t")).collect()] == [("one", "a\nb")]
    (tmp_path / "o.yaml").write_text("# note\nCipla Limited:\n  - Cipla Ltd\n  - Cipla Medpro\n\nJohnson & Johnson:\n  - J&J\n")
    assert dims.load_overrides(str(tmp_path / "o.yaml")) == {"Cipla Limited": ["Cipla Ltd", "Cipla Medpro"], "Johnson & Johnson": ["J&J"]}
    (tmp_path / "i.json").write_text(json.dumps({"_note": "x", "Paracetamol ": "acetaminophen"}))
    assert dims.load_inn(str(tmp_path / "i.json")) == {"paracetamol": "acetaminophen"} and len(dims.ESSENTIAL_MEDICINES) == 15
    root = str(tmp_path / "snap")
    for v in ("1", "2"):
        sinks.write_snapshot(spark.range(int(v)).toDF("n"), root, v)
    assert sinks.current_version(spark, root) == "2" and sinks.read_snapshot(spark, root).count() == 2
    for d in (1, 2):
        sinks.append_history(spark.range(3).toDF("n"), str(tmp_path / "hist"), date(2024, 1, d))
    assert spark.read.parquet(str(tmp_path / "hist")).count() == 6
    results = spark.createDataFrame([("a", "review", "b", "1", 0.9), ("c", "new", "c", "2", 1.0)], "raw string, action string, canonical string, manufacturer_id string, confidence double")
    for t in ("2024-01-01", "2024-01-02"):
        sinks.write_review(results, str(tmp_path / "review"), t)
    assert [r["reviewed_at"] for r in sinks.read_review(spark, str(tmp_path / "review")).collect()] == ["2024-01-02", "2024-01-01"]


def test_reports(spark):
    rows = spark.createDataFrame([("1", "Take ibuprofen now", "f", "class_1", date(2024, 1, 1)), ("2", "metforminx", "f", "class_1", date(2024, 1, 20)), ("3", None, "f", "class_1", date(2024, 6, 1))], "id string, raw_text string, firm string, severity string, date_published date")
    found = {r["id"]: r["found_ingredients"] for r in reports.dictionary_ingredients(rows, list(dims.ESSENTIAL_MEDICINES)).collect()}
    assert found == {"1": ["ibuprofen"], "2": [], "3": []}
    assert sorted(r["n"] for r in reports.recall_events(rows).collect()) == [1, 2]


def test_streams(spark, tmp_path):
    def drain(stream, name, mode="append"):
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
        q.awaitTermination()
        return [r.asDict() for r in spark.table(name).collect()]

    schema = "source_id string, source_url string, normalized_hash string, seq long, fetched_at timestamp, manufacturer_id string, severity string"
    rows = [("s", "u1", "a", 1), ("s", "u1", "a", 2), ("s", "u1", "b", 3), ("s", "u2", "c", 4), ("s", "u1", "a", 5)]
    data = spark.createDataFrame([(*r, datetime(2024, 1, r[3]), "m", "class_1") for r in rows], schema)
    data.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    assert sorted(r["source_url"] for r in drain(jobs.stream_dedup(stream()), "dedup")) == ["u1", "u2"]
    counts = drain(jobs.stream_recall_counts(stream(), "fetched_at", window="2 days"), "counts")
    assert sum(r["recall_count"] for r in counts) <= 5 and all(r["weighted_score"] == 3 * r["recall_count"] for r in counts)
    bursts = drain(jobs.stream_recall_bursts(stream(), "fetched_at", gap="1 hour"), "bursts")
    assert all(r["recall_count"] == 1 for r in bursts)
    seen = []
    jobs.stream_ingest(spark, str(tmp_path / "in"), schema, lambda df, n: seen.append(df.count()), str(tmp_path / "cp-ingest")).awaitTermination()
    jobs.stream_ingest(spark, str(tmp_path / "in"), schema, lambda df, n: seen.append(df.count()), str(tmp_path / "cp-ingest")).awaitTermination()
    assert sum(seen) == 5
    changes = drain(jobs.stream_versions(stream().select("source_url", "seq", "normalized_hash")), "versions")
    assert sorted((r["seq"], r["previous_hash"], r["normalized_hash"]) for r in changes) == [(3, "a", "b"), (5, "b", "a")]


def test_clusters_by_greedy_loop(spark):
    """Chains of similar names, equal keys and overrides in random order."""
    rng = random.Random(6)
    base = ["alpha beta gamma delta", "alpha beta gamma delto", "alpha beta gammo delto", "alpho beta gammo delto", "zeta works", "zeta work", "omega"]
    over = {"Zeta Works": ["zeto works"], "Alpha": ["alpha beta gamma delta inc"]}
    for _ in range(2):
        listed = list(dict.fromkeys(rng.choice(base) + rng.choice(["", " ltd", " Inc", " extra", " LIMITED"]) for _ in range(25)))
        rows = spark.createDataFrame(list(zip(listed, range(len(listed)))), "raw string, ordinal int")
        table = m.overrides_table(spark, over)
        got = {r["raw"]: r["canonical"] for r in m.cluster_names(rows, table).collect()}
        settled = {r["raw"]: r["canonical"] for r in m.match_override(rows, table).collect()}
        both = spark.createDataFrame([(x,) for x in [*listed, *over]], "v string").select("v", m.normalize_name(F.col("v")).alias("k")).collect()
        key, canon = {r["v"]: r["k"] for r in both}, []
        for raw in listed:
            target = settled.get(raw) or next((c for c, k in canon if k == key[raw]), None)
            scores = [m.token_set_ratio(key[raw], k) for _, k in canon] if target is None else []
            if scores and max(scores) >= m.THRESHOLD:
                target = canon[scores.index(max(scores))][0]
            target = target or raw
            assert got[raw] == target, (raw, listed)
            if all(c != target for c, _ in canon):
                canon.append((target, key[target]))


def test_components_of_a_long_chain(spark):
    from lotwatch.operators.graph import components

    edges = spark.createDataFrame([(f"n{i:04d}", f"n{i + 1:04d}") for i in range(300)] + [("x", "y"), ("z", "z")], "a string, b string")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {f"n{i:04d}": "n0000" for i in range(1, 301)} | {"y": "x"}


def test_deeply_nested_pages():
    html = "<div>" * 5000 + "<p>deep</p>" + "</div>" * 5000
    assert landed.tree(html).first("p").text() == "deep" and landed.tree(html).text() == "deep"


def test_failed_observations(spark):
    """A failed parse is an error and changes nothing; a known address without update checks isn't even looked at."""
    columns = "id string, source_id string, source_url string, source_hash string, normalized_hash string, raw_text string"
    kept = spark.createDataFrame([("1", "s", "a", "h1", "n1", "old")], columns)
    rows = [("x1", "s", "a", "h2", "n2", "new", 1, None), ("x2", "s", "a", "h3", "n1", "bad", 2, "boom"), ("x3", "s", "b", "h4", "n4", "b", 1, "boom"), ("x4", "s", "b", "h4", "n4", "b", 2, None), ("x5", "s", "a", "h5", "n1", "third", 3, None)]
    batch = spark.createDataFrame(rows, columns + ", seq long, error string")
    after, versions, log, counts = docs.upsert(kept, batch, now=datetime(2024, 1, 1))
    assert {r["id"]: r["action"] for r in log.collect()} == {"x1": "update", "x2": "error", "x3": "error", "x4": "insert", "x5": "update"}
    assert sorted((r["normalized_hash"], r["raw_text"], r["superseded_at"]) for r in versions.collect()) == [("n1", "old", datetime(2024, 1, 1)), ("n2", "new", datetime(2024, 1, 1))]
    assert {r["source_url"]: r["raw_text"] for r in after.collect()} == {"a": "third", "b": "b"} and counts.first()["failed"] == 2
    fast = {r["id"]: r["action"] for r in docs.upsert(kept, batch, check_for_updates=False)[2].collect()}
    assert fast == {"x1": "skip_known", "x2": "skip_known", "x3": "error", "x4": "insert", "x5": "skip_known"}


def ledger_rows(spark, n, start=0):
    return [(f"d{k}", "s", f"u{k}", f"h{k}", f"x{k}") for k in range(start, start + n)]


def ledger_files(root, name):
    import glob

    return {p for p in glob.glob(f"{root}/{name}/c=*/b=*/*.parquet")}


def test_ledger_rewrites_only_its_buckets(spark, tmp_path):
    """A batch of a few addresses: other buckets keep their files, and the rows are those of the full upsert, over several batches."""
    from lotwatch.sources import ledger

    root, stored = str(tmp_path / "t"), spark.createDataFrame(ledger_rows(spark, 400), STATE)
    ledger.load(stored, root, 32)
    before = ledger.read_head(spark, root)
    batches = [
        [("n0", "s", "u7", "h7b", "x7b", 1), ("n1", "s", "u8", "h8", "x8", 2), ("n2", "s", "new1", "h7", "x7", 3), ("n3", "s", "new2", "hn", "xn", 4)],
        [("m0", "s", "new1", "h7", "x7", 1), ("m1", "s", "new3", "hn", "xn", 2), ("m2", "s", "u9", None, "x9", 3), ("m3", "s", "u7", "h7c", "x7c", 4), ("m4", "s", "new4", None, "x", 5)],
    ]
    state = stored
    for k, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, STATE + ", seq long")
        old = ledger_files(root, "state")
        ledger.merge_batch(batch, root, "q", k)
        state, _, log, counts = docs.upsert(spark.createDataFrame(state.collect(), STATE), batch)
        state = state.select(*stored.columns)
        got = ledger.read_documents(spark, root)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, state.collect()))
        assert sorted(map(tuple, ledger.read_appended(spark, root, "log").where(f"c = {k + 2}").select("id", "action").collect())) == sorted(map(tuple, log.select("id", "action").collect()))
        assert sorted(map(tuple, ledger.read_appended(spark, root, "events").where(f"c = {k + 2}").drop("c").collect())) == sorted(map(tuple, counts.collect()))
        new = {int(p.split("/b=")[1].split("/")[0]) for p in ledger_files(root, "state") - old}
        assert new == {r[0] for r in batch.select(ledger.bucket_of(32, "source_id", "source_url")).distinct().collect()} and len(new) <= 5
    head = ledger.read_head(spark, root)
    assert sum(before["state"][b] == head["state"].get(b) for b in before["state"]) >= 24
    assert ledger.vacuum(spark, root) > 0 and sorted(map(tuple, ledger.read_documents(spark, root).collect())) == sorted(map(tuple, state.collect()))


@pytest.mark.parametrize("sink", ["state", "contents", "versions", "log", "events"])
def test_ledger_is_exactly_once(spark, tmp_path, sink):
    """The job dies after each sink in turn; nothing is visible, and the replay leaves each row once."""
    from lotwatch.sources import ledger

    root = str(tmp_path / "t")
    ledger.load(spark.createDataFrame(ledger_rows(spark, 20), STATE), root, 4)
    batch = spark.createDataFrame([("n0", "s", "u3", "h3b", "x3b", 1), ("n1", "s", "new", "hn", "xn", 2)], STATE + ", seq long")

    def dies(name):
        if name == sink:
            raise RuntimeError(name)

    with pytest.raises(RuntimeError):
        ledger.merge_batch(batch, root, "q", 0, after=dies)
    assert sorted(map(tuple, ledger.read_documents(spark, root).collect())) == sorted(ledger_rows(spark, 20)) and ledger.read_head(spark, root)["commit"] == 1
    assert ledger.merge_batch(batch, root, "q", 0)["commit"] == 2
    assert ledger.merge_batch(batch, root, "q", 0) is None
    state = {r["source_url"]: r["normalized_hash"] for r in ledger.read_documents(spark, root).collect()}
    assert len(state) == 21 == ledger.read_documents(spark, root).count() and (state["u3"], state["new"]) == ("x3b", "xn")
    assert [r["normalized_hash"] for r in ledger.read_appended(spark, root, "versions").collect()] == ["x3"] and ledger.read_appended(spark, root, "log").count() == 2
    assert [(r["added"], r["updated"]) for r in ledger.read_appended(spark, root, "events").collect()] == [(1, 1)]


def test_founding_decides_a_long_chain_and_wide_components_alike(spark):
    """A chain of 2,000 names, a star around a fixed name and a name on its own, in one task for each component or in rounds."""
    chain = [(n, n - 1) for n in range(1, 2000)]
    star = [(3000 + n, 3000) for n in range(1, 20)]
    edges = spark.createDataFrame(chain + star, "at int, b_at int")
    nodes = spark.createDataFrame([(n, False) for n in range(2000)] + [(3000, True)] + [(3000 + n, False) for n in range(1, 20)] + [(5000, False)], "at int, fixed boolean")
    expect = list(range(0, 2000, 2)) + [3000, 5000]
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("founding", "founding")
    got = sorted(r[0] for r in m._founding(nodes, edges).collect())
    ran = len(jobs.getJobIdsForGroup("founding"))
    spark.sparkContext.setJobGroup("tests", "tests")
    assert got == expect and ran < 400, ran
    # The same rule in rounds: links of two, so that a few rounds settle all.
    few = [(n, n - 1) for n in range(1, 60) if n % 3]
    nodes = spark.createDataFrame([(n, False) for n in range(60)], "at int, fixed boolean")
    edges = spark.createDataFrame(few, "at int, b_at int")
    want = sorted(r[0] for r in m._founding(nodes, edges).collect())
    assert sorted(r[0] for r in m._founding(nodes, edges, settled_pairs=1).collect()) == want
    none = edges.limit(0)
    assert sorted(r[0] for r in m._founding(nodes, none).collect()) == list(range(60))
    assert m._founding(nodes.limit(0), none).collect() == []


def test_dictionary_matches_by_hand(spark):
    docs = spark.createDataFrame([("a", "Zinc, zinc-oxide and Amoxicillin / clavulanic ACID"), ("b", None), ("c", ""), (None, "zinc"), ("d", "zincs oxide")], "id string, raw_text string")
    entries = spark.createDataFrame([("Zinc",), ("zinc oxide",), ("Zinc-Oxide",), ("amoxicillin/clavulanic acid",), ("!",), (None,), ("zinc",), ("oxide and amoxicillin clavulanic acid x",)], "entry string")
    expect = [("a", "Zinc", 2), ("a", "Zinc-Oxide", 1), ("a", "amoxicillin/clavulanic acid", 1), ("a", "zinc", 2), ("a", "zinc oxide", 1)]
    for limit in (1000, 0):  # broadcast, or shuffled
        assert sorted(map(tuple, reports.dictionary_matches(docs, entries, broadcast_entries=limit).collect())) == expect
    assert reports.dictionary_matches(docs, entries.limit(0)).collect() == []
    assert reports.dictionary_matches(docs.limit(0), entries).collect() == []


def test_dictionary_of_twenty_thousand_names(spark):
    table = spark.range(20_000).selectExpr("concat('Alias ', id) as alias", "concat('inn ', id) as inn").union(spark.createDataFrame([(" alias 7 ", "earlier"), (None, "x"), ("y", None)], "alias string, inn string"))
    rows = spark.createDataFrame([("a", ["ALIAS 3 ", " ", None, "alias 7", "other"]), ("b", None), ("c", [])], "id string, active_ingredients_raw array<string>")
    found = reports.normalized_by_table(rows, table)
    assert sorted((r["id"], r["normalized"], r["raw"]) for r in found.collect()) == [("a", ["inn 3", "earlier", "other"], ["ALIAS 3", "alias 7", "other"]), ("b", [], []), ("c", [], [])]
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()


def test_sources_share_one_schema(spark):
    """Rows of a listing and a detail page in one table; bytes are hashed as they lie, a row's by its own markup."""
    row = "<tr><td>1</td><td>3 May 2020</td><td>R/1</td><td>Thing</td><td>Zinc</td><td>B</td><td>Maker, Kenya</td><td>why</td><td>open</td></tr>"
    pages = spark.createDataFrame([("http://l", "<table><tr><th>Recall</th></tr>" + row + row.replace("R/1", "R/2") + "</table>")], "url string, html string")
    listed = landed.normalize_listing_rows(landed.extract_recall_rows(pages))
    detail = spark.createDataFrame([("http://d/x", "<h1>T</h1><table><tr><th>Recall date</th></tr><tr><td>1 May 2020</td></tr></table>"), ("http://d/y", None)], "url string, html string")
    found, errors = landed.extract_recall_details(detail)
    every = landed.observations(listed).unionByName(landed.observations(found, errors, "detail"))
    assert every.columns == [*landed.DOCUMENT, "error"]
    rows = {r["source_url"]: r for r in every.withColumn("meta", F.to_json("raw_metadata")).collect()}
    assert set(rows) == {"http://l#R-1", "http://l#R-2", "http://d/x", "http://d/y"}
    assert len({r["source_hash"] for r in rows.values()}) == 4 and rows["http://d/y"]["error"] and rows["http://d/y"]["source_hash"] is None
    assert '"status":"open"' in rows["http://l#R-1"]["meta"]
    table, _, log, _ = docs.upsert(*[d(docs.to_document(every).withColumn("id", F.col("source_url"))) for d in (lambda x: x.drop("error").limit(0), lambda x: x.withColumn("seq", F.lit(1)))])
    assert table.count() == 3 and sorted(r["action"] for r in log.collect()) == ["error", "insert", "insert", "insert"]


def test_version_chain_waits_for_late_rows_and_forgets(spark, tmp_path):
    """Files out of order give the chain of the sorted rows; a key without observations for the time to live is gone from the state."""
    minute = lambda n: datetime.fromtimestamp(1_000_000_000 + 60 * n)
    rng = random.Random(5)
    rows = [(f"u{rng.randrange(4)}", minute(n), n, rng.choice("ab")) for n in range(120)] + [("old", minute(0), 1000, "a"), ("old", minute(2), 1001, "b"), ("end", minute(5000), 2000, "z")]
    shuffled = sorted(rows[:-1], key=lambda r: r[2] // 20 * 20 + rng.randrange(30) if r[2] < 1000 else 0) + rows[-1:]
    for n in range(0, len(shuffled), 12):
        frame = spark.createDataFrame(shuffled[n : n + 12], "source_url string, ts timestamp, seq long, normalized_hash string").coalesce(1)
        frame.write.mode("append").parquet(f"{tmp_path}/in")
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.shuffle.partitions", "2")
    stream = own.readStream.schema("source_url string, ts timestamp, seq long, normalized_hash string").option("maxFilesPerTrigger", 3).parquet(f"{tmp_path}/in")
    out = []
    chain = jobs.stream_version_chain(stream, delay="60 minutes", keep="1000 minutes")
    chain.writeStream.foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    expect, last = [], {}
    for url, _, seq, now in sorted(rows, key=lambda r: (r[1], r[2])):
        if url in last and last[url] != now:
            expect.append((url, seq, last[url], now))
        last[url] = now
    assert sorted(out) == sorted(expect)
    left = own.read.format("statestore").option("path", f"{tmp_path}/checkpoint").option("stateVarName", "last").load()
    assert left.count() == 0  # the last watermark is more than the time to live after all keys but "end", which still waits
