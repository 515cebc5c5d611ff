"""Golden pairs of the column functions."""

from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwatch.functions import dates, text


def apply(spark, values, f):
    rows = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, v string")
    return [r[0] for r in rows.orderBy("n").select(f(F.col("v"))).collect()]


NAMES = {
    "Cipla Ltd": "cipla", "CIPLA LIMITED": "cipla", "Sun Pharmaceutical Industries Ltd": "sun", "Aspen Pharmacare (Pty) Ltd": "aspen pharmacare", "Pfizer Inc.": "pfizer",
    "GlaxoSmithKline plc": "glaxosmithkline", "Novartis AG": "novartis", "Roche GmbH": "roche", "Sanofi S.A.": "sanofi", "Generic Pharma Co": "generic", "Laboratoires Théraplix": "laboratoires theraplix",
}
INGREDIENTS = {
    "ATORVASTATIN CALCIUM": "atorvastatin", "Ciprofloxacin Hydrochloride": "ciprofloxacin", "DICLOFENAC SODIUM": "diclofenac", "metformin HCl": "metformin", "artemether-lumefantrine": "artemether-lumefantrine",
    "amoxicillin/clavulanic acid": "amoxicillin/clavulanic acid", "insulin (regular human)": "insulin (regular human)", "Metoprolol Succinate": "metoprolol", "": "", "   ": "", "BENZALKONIUM  CHLORIDE": "benzalkonium chloride", "ZINC SULFATE": "zinc",
}


def test_names(spark):
    assert apply(spark, NAMES, text.normalize_name) == list(NAMES.values())


def test_ingredients(spark):
    assert apply(spark, INGREDIENTS, text.normalize_ingredient) == list(INGREDIENTS.values())
    assert apply(spark, INGREDIENTS.values(), text.normalize_ingredient) == list(INGREDIENTS.values())
    assert apply(spark, [None], text.normalize_ingredient) == [None]


def test_ingredient_cells(spark):
    cells = ["Paracetamol 500mg", "Ibuprofen and Paracetamol", "Ferrous Sulphate + Folic Acid 200/0.4mg", "Paracetamol 250mg\nand\nParacetamol 125mg Suppository", "Amoxicillin 500mg;Clavulanate 125mg", "", "   \n  \n  "]
    inn = apply(spark, cells, lambda c: text.parse_ingredient_cell(c)[0])
    raw = apply(spark, cells, lambda c: text.parse_ingredient_cell(c)[1])
    assert raw == [["Paracetamol 500mg"], ["Ibuprofen and Paracetamol"], ["Ferrous Sulphate + Folic Acid 200/0.4mg"], ["Paracetamol 250mg", "Paracetamol 125mg Suppository"], ["Amoxicillin 500mg", "Clavulanate 125mg"], [], []]
    assert inn[0] == ["acetaminophen"] and inn[3] == ["acetaminophen", "acetaminophen"] and inn[4] == ["Amoxicillin", "Clavulanate"]


def test_severity(spark):
    said = ["Class I Type B", "Class II Type C", "class iii", "Class 2 Type A", "Voluntary Recall", "", "Class IV"]
    assert apply(spark, said, text.infer_severity) == ["class_1", "class_2", "class_3", "class_2", "unclassified", "unclassified", "unclassified"]
    assert apply(spark, said[4:5], lambda c: text.infer_severity(c, None)) == [None]
    assert apply(spark, ["Class I", "Class III", "", None, "x"], text.map_severity) == ["class_1", "class_3", None, None, "unclassified"]


def test_titles_and_countries(spark):
    titles = ["Halaven (Eribulin)", "Citro-Soda (A, B, C)", "Kiwi System", "Apixaban 2,5 DRL (Apixaban)"]
    assert apply(spark, titles, lambda c: text.parse_title(c)[0]) == ["Halaven", "Citro-Soda", "Kiwi System", "Apixaban 2,5 DRL"]
    assert apply(spark, titles, lambda c: text.parse_title(c)[1]) == [["Eribulin"], ["A", "B", "C"], [], ["Apixaban"]]
    assert apply(spark, ["Cosmos Limited, Kenya", "X, Atlantis", "Kenya"], text.trailing_country) == [["Kenya"], [], []]


def test_dates(spark):
    day = lambda *a: date(*a)
    assert apply(spark, ["04 May 2026", "17.April.2026", "29.Sept 2022", "26.November 2024", "Not available", ""], dates.parse_detail_date) == [day(2026, 5, 4), day(2026, 4, 17), day(2022, 9, 29), day(2024, 11, 26), None, None]
    assert apply(spark, ["29/12/2025", "5 May 2024", "May 5, 2024", "2024-05-05", "31-1-2024", "x"], lambda c: dates.parse_date(c, dates.LISTING)) == [day(2025, 12, 29), day(2024, 5, 5), day(2024, 5, 5), day(2024, 5, 5), day(2024, 1, 31), None]
    now = datetime(2024, 5, 1, tzinfo=timezone.utc)
    assert dates.parse_since("30d", now) == now - timedelta(days=30) and dates.parse_since(None, now) is None
    assert dates.parse_since("2024-01-02", now) == datetime(2024, 1, 2, tzinfo=timezone.utc)
    with pytest.raises(ValueError):
        dates.parse_since("soon", now)


def test_hash_cases(spark):
    base = dict(source_id="s", source_url="u", jurisdiction="KE", document_type="recall", document_id="1", title="t", active_ingredients=["b", "a"], manufacturers=["x", "y"], product_names=["p"], severity="class_1", date_published=date(2024, 1, 1), raw_text="r")
    schema = "source_id string, source_url string, jurisdiction string, document_type string, document_id string, title string, active_ingredients array<string>, manufacturers array<string>, product_names array<string>, severity string, date_published date, raw_text string"
    rows = [base, base | {"raw_text": "other"}, base | {"manufacturers": ["y", "x"]}, base | {"severity": "class_2"}, base | {"manufacturers": ["x"]}, base | {"title": None}]
    h = [r[0] for r in spark.createDataFrame(rows, schema).select(text.document_hash(T.StructType.fromDDL(schema))).collect()]
    assert h[0] == h[1] == h[2] and len({h[0], h[3], h[4], h[5]}) == 4


def test_hash_covers_dates_and_metadata(spark):
    """Batch numbers and the effective date make another document; the order of metadata's keys and its form don't."""
    schema = "source_id string, source_url string, title string, date_published date, date_effective date, raw_metadata map<string,string>"
    base = dict(source_id="s", source_url="u", title="t", date_published=date(2024, 1, 1), date_effective=None, raw_metadata={"batch": "1", "reason": "x"})
    rows = [base, base | {"raw_metadata": {"reason": "x", "batch": "1"}}, base | {"date_effective": date(2024, 2, 1)}, base | {"raw_metadata": {"batch": "2", "reason": "x"}}, base | {"raw_metadata": {}}, base | {"raw_metadata": None}]
    df = spark.createDataFrame(rows, schema)
    h = [r[0] for r in df.select(text.document_hash(df.schema)).collect()]
    assert h[0] == h[1] and h[4] == h[5] and len(set(h)) == 4
    forms = [df.withColumn("raw_metadata", F.to_json("raw_metadata")), df.withColumn("raw_metadata", F.parse_json(F.to_json("raw_metadata")))]
    for form in forms:
        assert [r[0] for r in form.select(text.document_hash(form.schema)).collect()] == h
    other = spark.createDataFrame([({"reason": "x", "batch": "1"},)], "raw_metadata struct<reason: string, batch: string>").withColumns({n: F.lit(v) for n, v in base.items() if n in ("source_id", "source_url", "title", "date_published")})
    assert other.select(text.document_hash(other.schema)).first()[0] == h[0]


def test_padded_class_and_ligatures(spark):
    assert apply(spark, ["Class I ", " Class III", "  ", "", None, "class i"], text.map_severity) == ["class_1", "class_3", "unclassified", None, None, "unclassified"]
    assert apply(spark, ["ﬁne ½ Ltd", "ＡＢＣ™ ﬂow", "№ 5 Æ"], text.normalize_name) == ["fine 1 2", "abctm flow", "no 5 æ"]
