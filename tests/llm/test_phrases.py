"""Operator 13 against SQL and a brute-force version; filters by round trip; its defined cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from lotwatch.llm import phrases, queries


def brute(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n-\r]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in found.items():
        if len(p) == 2 and any(100 * b >= 50 * a for (g, q), b in found.items() if g == lang and len(q) == 3 and p in (q[:2], q[1:])):
            continue
        score, _, left, right = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), left, right))
    seen, ranked = Counter(), []
    for lang, score, a, p, left, right in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], p.decode(), -a, left, right, n[lang], -score))
    return ranked


def found(spark, rows, **kw):
    return sorted(map(tuple, phrases.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(3), **kw).collect()))


def test_query_by_sql(spark, sf_dir):
    got = oracle.rows_of(queries.op13_phrase_collocations(spark, sf_dir))
    assert got == oracle.rows_of_sql(oracle.duck(sf_dir), queries.COLLOCATIONS_SQL) and len(got[1]) > 100


def test_by_brute_force_in_small_packs(spark, monkeypatch):
    """Many packs, filters and blocks; ties at the last place; a phrase that hides its parts."""
    monkeypatch.setattr(phrases, "PACK_BYTES", 200)
    monkeypatch.setattr(phrases, "ENTRIES", 16)
    rng = random.Random(3)
    words = ["alpha", "Beta", "c", "dé", "漢", "x1", "-", "new", "york", "city", "bb"]
    rows = []
    for k in range(120):
        text = " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",\t", "\n", "\x0b"]) for _ in range(rng.randrange(40)))
        rows.append((rng.choice(["en", "en", None, "de"]), text + rng.choice([" New York City", "", " new york"])))
    for least, top in ((2, 2000), (3, 7), (10, 5)):
        assert found(spark, rows, least=least, top=top) == brute(rows, least, top) != []


def test_cases(spark, hard_docs, no_docs):
    rows = [(r["lang"], r["text"]) for r in hard_docs.select("lang", "text").collect()] + [("en", "a b " * 300), ("en", "a"), ("fr", "." * 50), (None, "\tq q q\t"), ("und", "q q")]
    assert found(spark, rows, least=2) == brute(rows, 2, 2000) != []
    assert phrases.collocations(no_docs).isEmpty() and found(spark, [("en", None), (None, "")]) == []
    docs = hard_docs.withColumns({c: F.lit(1) for c in ("pack", "word", "words", "n", "a", "l", "r", "rank", "phrase")})
    assert sorted(map(tuple, phrases.collocations(docs, least=2).collect())) == brute([(r["lang"], r["text"]) for r in hard_docs.collect()], 2, 2000)


def test_long_text_is_cut_where_pieces_end(monkeypatch):
    monkeypatch.setattr(phrases, "PACK_BYTES", 50)
    text = b"one two three. " * 30 + b"w " * 100 + b"\nlast"
    parts = list(phrases._cut(text))
    assert b"".join(parts) == text and len(parts) > 5 and all(p[-1:] in (b".", b"\n") for p in parts[:-1])


@pytest.mark.parametrize(("arity", "bits", "block_bits"), [(2, 1, 0), (2, 3, 9), (2, 20, 4), (3, 1, 1), (3, 20, 5), (3, 25, 3), (3, 32, 6), (2, 32, 0)])
def test_filters_lose_nothing(arity, bits, block_bits):
    """Entries to filters and back, in one limb and in two; the permutation is one; sums of merged filters."""
    rng = np.random.default_rng(bits)
    layout = phrases.Layout(arity, bits, block_bits)
    words = [rng.integers(0, 1 << bits, 3000) for _ in range(arity)]
    hi, lo = layout.permute(*layout.pack(words))
    assert [w.tolist() for w in layout.unpack(*layout.restore(hi, lo))] == [w.tolist() for w in words]
    assert len(set(zip(hi.tolist(), lo.tolist()))) == len(set(zip(*(w.tolist() for w in words)))) and (int(hi.max()) >> layout.wide, int(lo.max()) >> bits) == (0, 0)
    n = rng.choice([1, 2, 254, 255, 256, 10**12], 3000)
    shards = [layout.merged([(hi[s], lo[s], n[s])]) for s in (slice(0, 1500), slice(1500, 3000))]
    again = []
    for h, g, c in shards:
        for block in set(layout.blocks(h).tolist()):
            own = layout.blocks(h) == block
            back = layout.entries(block, layout.filter(h[own], g[own], c[own]))
            assert all((x == y).all() for x, y in zip(back, (h[own], g[own], c[own])))
            again.append(back)
    h, g, c = layout.merged(again)
    expect = Counter()
    for *key, k in zip(*(w.tolist() for w in words), n.tolist()):
        expect[tuple(key)] += k
    assert dict(zip(zip(*(w.tolist() for w in layout.unpack(*layout.restore(h, g)))), c.tolist())) == expect


def test_filter_is_compact():
    layout = phrases.Layout(3, 17, 0)
    rng = np.random.default_rng(1)
    entries = layout.merged([(*layout.permute(*layout.pack([rng.integers(0, 1 << 17, 100_000) for _ in range(3)])), np.ones(100_000, np.int64))])
    assert len(layout.filter(*entries)) < 8.5 * 100_000  # against 24 bytes of two integers and a count
