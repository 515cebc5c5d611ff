"""Operator 11 against the library: ids, decoded bytes, segments, and its defined cases."""

import hashlib
import random

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from lotwatch.llm import bpe, queries

PATH = P.path("byte_bpe_multi_50k.tiktoken")
#: Characters that decide about pieces, and tokens that merge over cuts.
BITS = ["a", "b", "the", " ", "  ", "\n", "'", "'s", "'l", "l", "re", "e", "1", "23", "!", "漢", "é", "　", " ", "\x1c", "́", "𝒳", "\U00031350", "aaaa", "zzzq", "\r\n", "\t", " ing", "ว", "0x"]


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder(PATH, P.PATTERN)


def random_text(rng, most):
    some = rng.sample(BITS, rng.randrange(1, 7))
    return "".join(rng.choice(some) for _ in range(rng.randrange(most)))


def test_tree_equals_library_for_every_cut(own, monkeypatch):
    rng = random.Random(5)
    for _ in range(3000):
        monkeypatch.setattr(bpe, "LEAF", rng.choice([1, 2, 3, 7, 16]))
        monkeypatch.setattr(bpe, "LONG_PIECE", rng.choice([1, 2, 4, 16]))
        text = random_text(rng, 50)
        part = own.encode(text)
        assert part.ids == own.encoding.encode_ordinary(text), text
        assert own.decode(part.ids) == text.encode()
        assert b"".join(own.tokens[i] for i in part.ids[len(part.ids) - part.tail_ids :]) == text[len(text) - part.tail :].encode()


def test_join_is_associative(own):
    rng = random.Random(6)
    for _ in range(300):
        a, b, c = (own.leaf(random_text(rng, 12)) for _ in range(3))
        assert own.join(own.join(a, b), c).ids == own.join(a, own.join(b, c)).ids


@pytest.mark.parametrize("text", ["a" * 50_000, " " * 50_000 + "x", "abcdefgh" * 8000, "the rain " * 8000, "漢字" * 20_000, "!" * 40_000 + "'" * 999 + "s"])
def test_long_pieces(own, text):
    assert own.ids(text) == own.encoding.encode_ordinary(text)


def test_tokens_that_merging_misses(own, tmp_path):
    """A vocabulary with a token of no merge: it stands for a whole piece, never for a part of one."""
    import base64

    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abcd": 257}
    (tmp_path / "v.tiktoken").write_text("".join(f"{base64.b64encode(t).decode()} {r}\n" for t, r in ranks.items()))
    odd = bpe.Encoder(str(tmp_path / "v.tiktoken"), P.PATTERN)
    assert odd.unreachable == {b"abcd"} and odd.ids("abcd") == [257]
    assert odd.merge(b"abcd") == [256, 99, 100] and odd.stretch(b"abcd") == odd.join_tokens([256], [99, 100])


def expected(own, text):
    ids = own.encoding.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query_by_library(spark, sf_dir, own):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op11_byte_bpe(spark, sf_dir).collect()}
    assert got == {k: expected(own, t) for k, t in texts.items()}


def test_segments(spark, own, monkeypatch):
    """Texts of many segments, copies among them, over several levels; fewer and more than are broadcast."""
    monkeypatch.setattr(bpe, "SEGMENT_BYTES", 100)
    monkeypatch.setattr(bpe, "FAN", 3)
    rng = random.Random(7)
    texts = [random_text(rng, 900) for _ in range(8)] + ["x" * 3000, "", None, "short", "漢" * 700]
    df = spark.createDataFrame(list(enumerate(texts + texts[:3])), "doc_id long, text string")
    for most in (0, 64):
        monkeypatch.setattr(bpe, "BROADCAST_LONG", most)
        got = {r["doc_id"]: r["token_ids"] for r in bpe.encode(df, PATH, P.PATTERN).collect()}
        assert got == {k: own.encoding.encode_ordinary(t or "") for k, t in enumerate(texts + texts[:3])}


def test_cases(spark, hard_docs, no_docs, own):
    docs = hard_docs.withColumns({"token_ids": F.lit(1), "decoded": F.lit(2)})
    out = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN)
    assert set(docs.columns) < set(out.columns) and {"_token_ids", "_decoded"} < set(out.columns)
    rows = out.collect()
    assert len(rows) == docs.count() and all(bytes(r["decoded"]) == (r["text"] or "").encode() and r["token_ids"] == own.encoding.encode_ordinary(r["text"] or "") for r in rows)
    assert bpe.decode(bpe.encode(no_docs, PATH, P.PATTERN), PATH, P.PATTERN).isEmpty()
    odd = spark.createDataFrame([(None,), ([],), ([1, None],), ([10**6],), ([64],)], "token_ids array<int>")
    assert [r["decoded"] and bytes(r["decoded"]) for r in bpe.decode(odd, PATH, P.PATTERN).collect()] == [None, b"", None, None, own.tokens[64]]
