"""What keeps the size of shuffles and groups in proportion to the input."""

from __future__ import annotations

from lotwatch.operators import rules
from lotwatch.plans import bindings as b
from lotwatch.plans import documents, extra


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    return plan_of(df).count("Exchange hashpartitioning")


def test_exposures_meet_no_bitmaps_in_rows(spark, sf_dir, monkeypatch):
    """bitmaps are united inside tasks, and slices of an ingredient's exposures give what one task gives."""
    rows = lambda: sorted(map(tuple, extra.alternative_suppliers(spark, sf_dir).collect()))
    assert "bitmap_or_agg" not in plan_of(extra.alternative_suppliers(spark, sf_dir))
    whole = rows()
    monkeypatch.setattr(rules, "UNITED", 1)
    assert rows() == whole


def test_an_address_is_shuffled_once(spark, sf_dir):
    """the numbering of lines and what groups by address share one shuffle."""
    assert exchanges(documents.latest_per_url(spark, sf_dir)) == 1
    assert exchanges(documents.duplicate_groups(spark, sf_dir)) == 1


def test_only_the_window_is_numbered(spark, sf_dir):
    """the rules' window of dates and states is a filter on the lines before they are shuffled."""
    plan = plan_of(rules.recall_window(b.recalls(spark, sf_dir), b.AS_OF))
    below = plan[plan.index("Exchange hashpartitioning(order_text") :]
    assert "l_linestatus" in below and "Filter" in below and "l_shipdate" in below[below.index("Filter") :].split("\n")[0]


def test_counts_of_dates_are_those_of_the_rows(spark):
    """recalls aren't repeated for each date; ids that come again are counted once at each date."""
    import random
    from datetime import date, timedelta

    from pyspark.sql import functions as F

    draw = random.Random(3)
    day = lambda: date(1999, 1, 1) + timedelta(days=draw.randrange(1600))
    rows = [(draw.choice(["a", "b", "c", "d", None]), draw.choice(["class_1", "class_2", None]), draw.choice(["recall", "alert", "guideline"]), draw.choice([day(), day(), None])) for _ in range(200)]
    docs = spark.createDataFrame(rows, "id string, severity string, document_type string, date_published date")
    ends = spark.createDataFrame([(day(),) for _ in range(60)] + [(None,)], "as_of date")
    expect = rules.as_of_backfill(docs, ends).groupBy("as_of", "severity").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))
    listed = lambda df: sorted(map(tuple, df.select("as_of", "severity", "n", "ids").collect()), key=repr)
    assert listed(rules.as_of_counts(docs, ends)) == listed(expect)


def test_keys_of_other_letters_and_frequent_words_meet_nobody(spark):
    """what can't be similar by its letters is no candidate, nor are names that share a frequent word only; nothing is lost."""
    from lotwatch.operators import manufacturers as m

    names = [f"supplier {n:05}" for n in range(0, 400, 3)] + [f"customer {n:09}" for n in range(200)] + ["", "acme", "acme labs 7", "labs acme 8", "aa aa b", "b aa"]
    known = [f"supplier {n:05}" for n in range(0, 400, 7)] + ["acme 7 labs", "aa b", "labs"]
    a, b = spark.createDataFrame([(n,) for n in names], "a string"), spark.createDataFrame([(n,) for n in known], "b string")
    for threshold in (92.0, 80.0):
        got = {(r["a"], r["b"]): round(r["score"], 6) for r in m.similar_pairs(a, b, threshold).collect()}
        assert got == {(x, y): round(s, 6) for x in names for y in known if (s := m.token_set_ratio(x, y)) >= threshold}
        left, _ = m.comparable(a.where("a != ''"), b, threshold)
        assert not left.where("a like 'customer%'").count()
    words = m._words(a, "a").groupBy("block").count().withColumnRenamed("count", "n")
    kept = m._rarest(m._words(a, "a"), words, "a", m.rare_words("a", 92.0))
    assert not kept.where("block = 'supplier'").count()


def test_outcomes_follow_without_another_shuffle(spark):
    """what stands of a batch, its versions and its log are read from the held outcomes, which may leave columns out; hashes cross shuffles as short bytes."""
    from pyspark.sql import functions as F

    from lotwatch.operators import documents as docs

    texts = ["", "ab", "AB", "abc", "00", "zz", "é", "a" * 64, None, "ab\n", "abc\n", "01ab"]
    both = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("p", docs.packed(F.col("t"))).withColumn("u", docs.unpacked("p")).collect()
    assert all(r["t"] == r["u"] for r in both) and len({bytes(r["p"]) for r in both if r["p"] is not None}) == len(texts) - 1
    assert len(next(r["p"] for r in both if r["t"] == "a" * 64)) == 33
    batch = spark.createDataFrame([("1", "s", "u", "aa", "b1", 1), ("2", "s", "u", "ab", "b2", 2), ("3", "s", "v", "aa", "b1", 3), ("4", "s", "w", "Aa", None, 4)], "id string, source_id string, source_url string, normalized_hash string, source_hash string, seq long")
    held = []

    def hold(log):
        held.append(log)
        return spark.createDataFrame(log.drop("source_hash").collect(), log.drop("source_hash").schema)

    state, versions, log, _ = docs.upsert(batch.drop("seq").limit(0), batch, hold=hold)
    assert exchanges(held[0]) == 3 and "Window" not in plan_of(state)
    assert sorted(map(tuple, state.select(*batch.columns[:-1]).collect()), key=repr) == [("1", "s", "u", "ab", None), ("4", "s", "w", "Aa", None)]
    assert [r["normalized_hash"] for r in versions.collect()] == ["aa"] and sorted((r["id"], r["action"]) for r in log.collect()) == [("1", "insert"), ("2", "update"), ("3", "skip_same_bytes"), ("4", "insert")]


def test_a_landed_batch_is_neither_copied_nor_dealt_by_bucket(spark, tmp_path, monkeypatch):
    """F8: tasks write the buckets of the rows they hold, and a batch of files that stay is read where it lies."""
    from lotwatch.sources import ledger

    rows = spark.range(0, 40, 1, 4).selectExpr("cast(id as string) as id", "'s' as source_id", "concat('u', id) as source_url", "md5(cast(id as string)) as normalized_hash", "concat('b', id) as source_hash")
    root, held = f"{tmp_path}/ledger", []
    ledger._write_buckets(rows.selectExpr("id", "0 as b"), str(tmp_path), "part", 1)
    assert len(list((tmp_path / "part/c=1/b=0").glob("*.parquet"))) == 4
    ledger.load(rows.where("id < 30"), root, 2)
    monkeypatch.setattr(ledger, "written", lambda df, name, write=ledger.written: held.append(name) or write(df, name))
    ledger.merge_batch(rows.selectExpr("*", "1L as seq"), root, landed=True)
    assert held == ["ledger-log"] and ledger.read_documents(spark, root).count() == 40


def test_phrases_that_no_entry_has_are_not_shuffled(spark, monkeypatch):
    """what a text says often is one row, most phrases that no entry has stay where they are, and a text's hits are dealt once."""
    from pyspark.sql import functions as F

    from lotwatch.operators import reports

    docs = spark.range(0, 300, 1, 3).selectExpr("id", "concat_ws(' ', transform(sequence(1, 40), i -> concat('w', (id * 7 + i * i) % 90))) as raw_text")
    entries = spark.range(40).selectExpr("concat('W', id) as entry").union(spark.range(200).selectExpr("concat('w', (id * 7 + 4) % 90, '-w', (id * 7 + 9) % 90, '/w', (id * 7 + 16) % 90) as entry"))
    rows = lambda **kw: sorted(map(tuple, reports.dictionary_matches(docs, entries, **kw).collect()))
    whole, words = rows(), {r["id"]: r["raw_text"].split() for r in docs.collect()}
    said = {k: [" ".join(w[i : i + n]) for n in (1, 3) for i in range(len(w) - n + 1)] for k, w in words.items()}
    known = {e: e.lower().replace("-", " ").replace("/", " ") for (e,) in entries.distinct().collect()}
    assert whole == sorted((k, e, n) for k, s in said.items() for e, p in known.items() if (n := s.count(p)))
    assert rows(broadcast_entries=0) == whole == rows(broadcast_entries=50)
    phrases = reports._phrases(docs, "id", "raw_text", [3])
    table = spark.createDataFrame([("w1 w2 w3",), ("w11 w16 w23",)], "_phrase string")
    kept = reports._marked(phrases, table)
    assert "Exchange hashpartitioning(id" not in plan_of(phrases) and kept.count() < phrases.count() / 20
    assert kept.join(table, "_phrase").count() == phrases.join(table, "_phrase").count() > 0
    monkeypatch.setattr(reports, "MARKS", 1)
    assert rows(broadcast_entries=0) == whole
    assert exchanges(reports.dictionary_matches(docs, entries).groupBy("id").agg(F.sum("n"))) == 1


def test_an_address_asks_the_state_once_for_a_batch():
    """a batch's observations of an address are one value in the state, and nothing is handed back where nothing changed."""
    from types import SimpleNamespace

    import pandas as pd

    from lotwatch.streaming import jobs

    calls = []

    class State:
        def __init__(self):
            self.rows = []

        def appendValue(self, row):  # noqa: N802
            calls.append("append")
            self.rows.append(row)

        def get(self):
            return iter(self.rows)

        def exists(self):
            return False

        def clear(self):
            self.rows = []

        def update(self, row):
            calls.append("update")

    tracker = jobs.ChainTracker(10_000)
    tracker.init(SimpleNamespace(getValueState=lambda *a: State(), getListState=lambda *a: State(), registerTimer=lambda at: calls.append(at)))
    frames = [pd.DataFrame({"at": [3000, 1000], "seq": [3, 1], "normalized_hash": ["b", "a"]}), pd.DataFrame({"at": [2000, 9000], "seq": [2, 4], "normalized_hash": ["a", "c"]})]
    assert list(tracker.handleInputRows(("u",), iter(frames), None)) == [] and calls == ["append", 1]
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    (out,) = tracker.handleExpiredTimer(("u",), at(5), None)
    assert list(map(tuple, out.to_numpy())) == [("u", 3, "a", "b")] and tracker.waiting.rows == [([9000], [4], ["c"])]
    tracker.waiting.clear()
    assert list(tracker.handleExpiredTimer(("u",), at(6), None)) == []


def test_names_that_differ_by_digits_meet_through_what_they_share(spark):
    """candidates of short names are nearly the similar pairs alone, in any order of words; a threshold or a long name that has too many variants loses none."""
    from lotwatch.operators import manufacturers as m

    names = [f"supplier {n:05}" for n in range(0, 3000, 3)]
    known = [f"supplier {n:05}" for n in range(0, 3000, 7)]
    a, b = spark.createDataFrame([(n,) for n in names], "a string"), spark.createDataFrame([(n,) for n in known], "b string")
    met = m.variant_pairs(m.marked(a, "a", 92.0), m.marked(b, "b", 92.0), 92.0)
    pairs = met.distinct().where("a != b").count()
    assert pairs == m.similar_pairs(a, b).where("a != b").count() == sum(m.token_set_ratio(x, y) >= 92 for x in names for y in known if x != y)
    assert pairs < met.where("a != b").count() + 1 < 3 * pairs
    short = spark.createDataFrame([(x,) for x in ("ab", "customer 000000001", "one two three four five six seven eight", "a" * 300)], "a string")
    assert [r["few"] for r in short.select(m.few_variants("a", 92.0).alias("few")).collect()] == [True, True, False, False]


def test_documents_and_observations_of_an_address_meet_once(spark, sf_dir):
    """lines are dealt by address, and only bytes and openings are shuffled besides."""
    from lotwatch.plans import bindings

    lines = exchanges(bindings.observed(spark, sf_dir))
    plan = plan_of(documents.upserted_state(spark, sf_dir))
    assert lines == 1 and "SortMergeJoin" not in plan and "HashJoin" not in plan
    # Lines are read for the documents and for the batch, each for itself and for its bytes, of which two are reused; one exchange is of bytes, one of openings.
    assert exchanges(documents.upserted_state(spark, sf_dir)) <= 6


def test_bytes_that_come_and_go_are_summed_up(spark, tmp_path, monkeypatch):
    """a commit writes the bytes that it gives and takes, and nobody reads the others for it; buckets of many commits are summed up."""
    from lotwatch.operators import documents as docs
    from lotwatch.sources import ledger

    fields = "id string, source_id string, source_url string, source_hash string, normalized_hash string"
    stored = spark.createDataFrame([(f"d{k}", "s", f"u{k}", f"h{k % 7}" if k % 5 else None, f"x{k}") for k in range(30)], fields)
    for most in (1, 16):
        monkeypatch.setattr(ledger, "MOST", most)
        root, state = f"{tmp_path}/{most}", stored
        ledger.load(stored, root, 2)
        for turn in range(4):
            batch = spark.createDataFrame([(f"n{turn}-{k}", "s", f"u{k * 3}", f"h{(k * turn) % 9}", f"x{k + turn}", k) for k in range(12 + turn)], fields + ", seq long")
            head = ledger.merge_batch(batch, root, "q", turn)
            state = spark.createDataFrame(docs.upsert(state, batch)[0].select(*stored.columns).collect(), fields)
            assert sorted(map(tuple, ledger.read_documents(spark, root).collect()), key=repr) == sorted(map(tuple, state.collect()), key=repr)
            bytes_ = ledger._contents(spark, root, head, [0, 1]).groupBy("source_hash").sum("n").where("`sum(n)` != 0")
            assert sorted(map(tuple, bytes_.collect())) == sorted(map(tuple, state.where("source_hash is not null").groupBy("source_hash").count().collect()))
            ledger.vacuum(spark, root)
            assert max(map(len, head["contents"].values())) == (1 if most == 1 else turn + 2)


def test_plain_pages_give_the_elements_that_the_general_parser_gives():
    """pages of plain tags, which most are, are split by one pattern; what isn't plain goes to the general parser. Nothing of a page is left to the collector."""
    import gc
    import random

    from lotwatch.sources import landed

    def told(root):
        return [(c.name, c.attrs, c.begin, c.end, c.parent and c.parent.begin, [k.begin if isinstance(k, landed.Node) else k for k in c.children]) if isinstance(c, landed.Node) else c for c in root.page]

    def general(page):
        parser = landed._Tree()
        parser.feed(page)
        parser.close()
        return parser.root

    draw = random.Random(3)
    plain = ["<td>", "</td>", "<tr>", "</tr>", "<p>", "</p>", "<br>", "<BR >", '<a href="x">', "</a>", '<Li class="A b" id="q">', "</B>", "<b>", "text", "a &amp; b", "&lt", " ", "<th\n>", '<img src="y">', "x > y", "</br>", "&am"]
    other = ["<br/>", "<!-- c -->", "<script>a<b</script>", "<a href=q>", '<a href="x&amp;y">', "<", "<td x>", '</p x="1">', "<title>t</title>", "<a-b>"]
    for turn in range(4000):
        page = "".join(draw.choice(plain if turn % 2 else plain + other) for _ in range(draw.randrange(25)))
        got = landed._plain_tree(page)
        assert got is not None if turn % 2 else True
        assert got is None or told(got) == told(general(page))
        for node in landed.tree(page).page:
            if isinstance(node, landed.Node):
                inner = "".join(c.markup() if isinstance(c, landed.Node) else landed.escape(c, quote=False) for c in node.children)
                start = f"<{node.name}{''.join(f' {k}="{landed.escape(v)}"' for k, v in node.attrs.items())}>"
                assert node.markup() == (start if node.name in landed.Node.VOID else f"{start}{inner}</{node.name}>")
    del node, got
    gc.collect()
    gc.disable()
    try:
        root = landed.tree("<table><tr><td>a</td></tr></table>" * 50)
        root.free()
        del root
        assert not any(isinstance(x, landed.Node) for x in gc.get_objects())
    finally:
        gc.enable()
