"""Data sources over landed files and the table function of pages."""

import json

import pytest

from lotwatch.sources import formats, landed

LISTING = '<a href="http://[">x</a><table><tr><th>Recall</th></tr><tr>' + "".join(f"<td>{n}</td>" for n in range(9)) + "</tr></table>"
CARD = '<article class="dlp_document"><h2 class="entry_title"><a href="/c">Card</a></h2></article>'
DETAIL = "<h1>Title</h1><table><tr><td>Recall date</td></tr><tr><td>1 May 2024</td></tr></table>"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_splits_lose_and_repeat_no_page(spark, tmp_path):
    formats.register(spark)
    pages = [{"url": f"u{n}", "html": LISTING + "é" * (n * 37 % 400)} for n in range(60)]
    (tmp_path / "in").mkdir()
    text = "\n".join(json.dumps(p, ensure_ascii=False) for p in pages)
    (tmp_path / "in" / "a.json").write_text(text + "\nno json\n\n[1]\n")
    (tmp_path / "in" / "b.json").write_text(json.dumps({"url": None, "html": None}) + "\n" + json.dumps({"url": "last", "html": LISTING}))
    (tmp_path / "in" / "_SUCCESS").write_text("not a page")
    (tmp_path / "in" / "empty.json").write_text("")
    for size in (1, 97, 1000, 1 << 30):
        kind = formats.FORMATS["listing"]
        reader = formats.LandedReader(kind, {"path": str(tmp_path / "in"), "splitbytes": str(size)}, "file:///")
        got = [r for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]
        assert sorted(r["page_url"] for r in got if not r["error"]) == sorted([p["url"] for p in pages] + ["last"])
        assert len([r for r in got if r["error"]]) == 2
    got = spark.read.format("lotwatch_listing").option("splitbytes", 500).load(str(tmp_path / "in"))
    assert got.rdd.getNumPartitions() > 10 and got.where("error is null").count() == 61
    assert rows(got.where("error is null and page_url like 'u%'").drop("landed", "error")) == rows(landed.extract_recall_rows(spark.createDataFrame(pages, "url string, html string")))
    assert spark.read.format("lotwatch_listing").load(f"file:{tmp_path}/in").count() == 63


def test_whole_files(spark, tmp_path):
    formats.register(spark)
    (tmp_path / "x.v1.txt").write_bytes("é\n\nb".encode() + b"\xff")
    assert rows(spark.read.format("lotwatch_text").load(str(tmp_path)).select("name", "text", "error")) == [("x.v1", "é\n\nb�", None)]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "p.json").write_text('{"results": [{"a": 1}, {"a": "é"}]}')
    (tmp_path / "sub" / "q.json").write_text('{"results": []}')
    (tmp_path / "sub" / "r.json").write_text("{")
    found = spark.read.format("lotwatch_enforcement").load(f"{tmp_path}/sub")
    assert [r["record"] for r in found.where("error is null").orderBy("record").collect()] == ['{"a": "é"}', '{"a": 1}']
    assert found.where("error is not null").count() == 2
    (tmp_path / "none").mkdir()
    assert spark.read.format("lotwatch_text").load(f"{tmp_path}/none").isEmpty()


def test_names_of_formats():
    with pytest.raises(ValueError):
        formats.data_format("", "a string")(lambda u, h: [])
    with pytest.raises(ValueError):
        formats.data_format("listing", "a string")(lambda u, h: [])
    with pytest.raises(ValueError):
        formats.LandedReader(formats.FORMATS["text"], {}, "file:///")


def test_paths_lie_where_spark_looks():
    system, path = formats._open("/a/b", "file:///")
    assert (system.type_name, path) == ("local", "/a/b")
    assert formats._open("file:/a/b", "file:///")[1] == formats._open("file:///a/b", "hdfs://n:1/")[1] == "/a/b"
    with pytest.raises(Exception):  # noqa: B017
        formats._open("/a/b", "nosuch://host:1/")


def test_a_page_is_parsed_once(spark, monkeypatch):
    real, calls = landed.tree, []
    monkeypatch.setattr(landed, "tree", lambda html: calls.append(1) or real(html))
    got = [(part, at) for part, at, _ in landed.page_parts("http://h/p", LISTING + CARD + DETAIL)]
    assert got == [("listing", 0), ("card", 0), ("detail", 0), ("link", 0), ("link", 1)] and len(calls) == 1
    monkeypatch.undo()
    pages = spark.createDataFrame([("http://h/p", LISTING + CARD + DETAIL), ("http://h/q", None), (None, CARD), ("http://h/l", LISTING), ("http://h/d", DETAIL)], "url string, html string")
    parsed = landed.parsed_pages(pages).cache()
    assert rows(landed.part_rows(parsed, "listing")) == rows(landed.extract_recall_rows(pages))
    assert rows(landed.dated_cards(landed.part_rows(parsed, "card"))) == rows(landed.extract_listing_cards(pages))
    assert rows(landed.detail_documents(landed.part_rows(parsed, "detail"))[0].drop("raw_metadata")) == rows(landed.extract_recall_details(pages)[0].drop("raw_metadata"))
    assert {r["url"] for r in landed.part_rows(parsed, "link").collect()} == {"http://[", "http://h/c", "/c"}
    formats.register(spark)
    pages.createOrReplaceTempView("few_pages")
    assert rows(spark.sql("SELECT p.url, x.* FROM few_pages p, LATERAL page_parts(p.url, p.html) x WHERE p.url IS NOT NULL")) == rows(parsed.where("url is not null"))
    parsed.unpersist()


def test_a_task_holds_a_bounded_batch_whatever_comes_in():
    """Rows are made as batches are asked for: no more than one batch of them is held."""
    made = []

    def rows():
        for n in range(10_000):
            made.append(n)
            yield {"a": "x" * 9000, "b": n}

    batches = landed.batches_of(rows(), landed.arrow_schema("a string, b int, c string"))
    first = next(batches)
    assert first.num_rows == len(made) <= landed.BATCH_CHARS // 9000 + 1 and first["c"].null_count == first.num_rows
    assert first.num_rows + sum(b.num_rows for b in batches) == 10_000
    assert max(b.num_rows for b in landed.batches_of(({"b": n} for n in range(2500)), landed.arrow_schema("b int"))) == landed.BATCH_ROWS


def test_a_large_folder_has_larger_splits(tmp_path):
    """The number of splits is bounded; all bytes are in one of them."""
    (tmp_path / "a.json").write_bytes(b"{}\n" * 20_000)
    splits = formats.LandedReader(formats.FORMATS["listing"], {"path": str(tmp_path), "splitbytes": "7"}, "file:///").partitions()
    assert len(splits) <= formats.MOST_SPLITS + 1 and sum(end - start for s in splits for _, start, end in s.splits) == 60_000


def test_what_lies_below_an_element_is_a_slice_of_its_page():
    """Elements left open, closed out of order or by another element, scripts inside: texts and elements in document order."""
    root = landed.tree("<table><tr><td>a<b>b<td>c<script>no<i>no</i></script>d</tr><p>e</table>f<br>g<div>h</nothing>i")
    assert root.text("|") == "a|b|c|d|e|f|g|h|i" and root.first("script").text() == "no<i>no</i>" and root.first("br").below() == []
    assert [n.name for n in root.first("tr").below() if not isinstance(n, str)] == ["td", "b", "td", "script"]
    assert root.first("td").text("|") == "a|b|c|d" and root.first("p").text() == "e" and root.first("div").text("|") == "h|i"
