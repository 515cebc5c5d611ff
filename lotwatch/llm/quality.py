"""Quality classifier: supervised subword embeddings.

A document is the mean of the vectors of its hashed words and character n-grams, followed by a
softmax over the two labels, trained by numpy stochastic gradient descent on a bounded sample of
labelled rows. After training, the product of vectors and output weights is one number per hash
bucket and label, so scoring a text is a table lookup and a mean: the same function, less work.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 18
DIM, EPOCHS, RATE = 8, 6, 4.0
#: Labelled rows to learn from, at most, and bytes of text after which no further row is taken. Only training is bounded so.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 32 << 20
GRAMS = (2, 3, 4)
TOP = np.uint64(64 - (BUCKETS.bit_length() - 1))
#: Bucket of the mark for a word that repeats the one before.
AGAIN = int(common.mixed(np.array([12345], np.uint64))[0] >> TOP)
_HASHER: common.WordHasher | None = None
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, place) of each character of UTF-8 bytes: its bytes read as one number, and where it begins."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    code = data[at].astype(np.uint64)
    if len(at) < len(data):
        size = np.diff(np.append(at, len(data)))
        for k in range(1, 4):
            more = size > k
            code[more] = (code[more] << np.uint64(8)) | data[at[more] + k]
    return code, at


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all features of each text, and where each text's begin.

    Features are the words, marked when a word repeats the one before, and the character n-grams
    that lie within a word or touch its edges. An empty text has none.
    """
    global _HASHER
    _HASHER = _HASHER or common.WordHasher()
    data, begin = common.joined(texts)
    begin = begin + 1
    data = np.concatenate([np.full(1, 10, np.uint8), data])
    start, end, word = _HASHER.words(data)
    again = np.zeros(len(word), bool)
    again[1:] = word[1:] == word[:-1]
    first = np.searchsorted(start, begin[:-1])
    again[first[first < len(start)]] = False
    ids, places = [(word >> TOP).astype(np.int32), np.full(int(again.sum()), AGAIN, np.int32)], [start, start[again]]
    plain, at = characters(np.where(common.space_mask(data), np.uint8(32), data))
    space = plain == 32
    with np.errstate(over="ignore"):
        for n in GRAMS:
            size = max(0, len(plain) - n + 1)
            code = np.zeros(size, np.uint64)
            inner = np.ones(size, bool)
            for j in range(n):
                code = code * common.PRIME + plain[j : j + size]
                if 0 < j < n - 1:
                    inner &= ~space[j : j + size]
            inner &= ~(space[:size] & space[n - 1 : n - 1 + size])
            which = np.flatnonzero(inner)
            ids.append((((code[which] + np.uint64(n)) * common.PRIME) >> TOP).astype(np.int32))
            places.append(at[which + space[which]])
    place = np.concatenate(places)
    owner = np.searchsorted(begin, place, side="right") - 1
    order = np.argsort(owner, kind="stable")
    found = np.concatenate(ids)[order]
    return found, np.searchsorted(owner[order], np.arange(len(texts) + 1))


def pieces(text: bytes, limit: int) -> list[tuple[bytes, bool]]:
    """A text cut before white space into pieces of about ``limit`` bytes, each with whether its first word repeats the last of the piece before.

    A word longer than that stays whole. The pieces' features are the text's.
    """
    out, first, last = [], 0, b""
    while first < len(text) or not out:
        end = first + limit
        if end < len(text):
            cut = next((i for i in range(end, first, -1) if text[i] == 32 or 9 <= text[i] <= 13), None)
            if cut is None:
                found = _SPACE.search(text, end)
                cut = found.start() if found else len(text)
            end = cut
        part = text[first:end]
        words = part.split(None, 1)
        out.append((part, bool(out and words) and words[0] == last))
        if words:
            last = part.rsplit(None, 1)[-1]
        first = max(end, first + 1)
    return out


def train(texts: list[bytes], labels: np.ndarray, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a vector for each bucket, output weights of both labels, their biases)."""
    rng = np.random.default_rng(seed)
    bags = []
    for _, pack in common.packs(texts):
        found, at = features(pack)
        for a, b in zip(at[:-1], at[1:]):
            ids, count = np.unique(found[a:b], return_counts=True)
            bags.append((ids, (count / max(1, b - a)).astype(np.float32)))
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    steps, done = max(1, EPOCHS * len(bags)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            ids, share = bags[i]
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            mean = share @ vectors[ids]
            logit = out @ mean + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[labels[i]] -= 1
            grad = p @ out
            out -= rate * 0.25 * np.outer(p, mean)
            bias -= rate * 0.05 * p
            if len(ids):
                vectors[ids] -= rate * (share * np.float32(20))[:, None] * grad[None, :]
    return vectors, out, bias


def folded(vectors: np.ndarray, out: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """One number per bucket: its share of logit(label 1) - logit(label 0). Last entry: the bias."""
    return np.append(vectors @ (out[1] - out[0]), bias[1] - bias[0]).astype(np.float32)


def scores(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each text; a text of any length is read whole, a piece at a time."""
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    parts: list[bytes] = []
    owner: list[int] = []
    for i, text in enumerate(texts):
        for part, again in pieces(text, common.PACK_BYTES):
            parts.append(part)
            owner.append(i)
            if again:
                total[i] += weights[AGAIN]
                count[i] += 1
    for first, pack in common.packs(parts):
        found, at = features(pack)
        sums = np.concatenate([[0.0], np.cumsum(weights[found], dtype=np.float64)])
        for j in range(len(pack)):
            total[owner[first + j]] += sums[at[j + 1]] - sums[at[j]]
            count[owner[first + j]] += at[j + 1] - at[j]
    logit = total / np.maximum(count, 1) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality", rows: int = SAMPLE_ROWS, limit: int = SAMPLE_BYTES) -> list:
    """Up to ``rows`` (text, label) pairs in an order given by the ids' hashes: the same rows in every run.

    Rows are taken in this order while the bytes of those before are under ``limit``, so the length
    of a text doesn't decide on it. The labels are cut first (a bounded number of ids is broadcast),
    so the texts of the corpus aren't moved.
    """
    picked = (
        labels.where(usable & F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1))
        .groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
        .orderBy(common.hash_order(F.col("doc_id")), "doc_id").limit(rows)
    )
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    order = [common.hash_order(F.col("doc_id")), common.hash_order(F.col("text"))]
    # Sizes are added up before any text is fetched; a repeated id can have more rows than the sample.
    sizes = found.select("doc_id", F.xxhash64("text").alias("h"), F.octet_length("text").alias("size"), order[0].alias("a"), order[1].alias("b")).orderBy("a", "b").limit(rows).collect()
    before, taken = 0, []
    for r in sizes:
        if before >= limit:
            break
        taken.append((r["doc_id"], r["h"]))
        before += r["size"]
    if not taken:
        return []
    wanted = docs.sparkSession.createDataFrame(sorted(set(taken)), "doc_id long, h long")
    found = found.withColumn("h", F.xxhash64("text")).join(F.broadcast(wanted), ["doc_id", "h"], "left_semi")
    return found.orderBy(*order).limit(len(taken)).select("text", "label").collect()


def score_quality(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row; null and empty texts get the score of the bias alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).fill_null(b"").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(texts, weights))], ["doc_id", "score"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, score double").withColumnRenamed("doc_id", id_col)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``, learnt from the rows that aren't held out.

    Defined cases: rows without an id are scored but never learnt from; an id with several labels
    counts as the largest; without any usable label every score is 0.5. Other columns are ignored.
    """
    sample = labelled_sample(docs, labels, ~common.held_out(F.col("doc_id")))
    if sample:
        weights = folded(*train(common.utf8(r["text"] for r in sample), np.array([r["label"] for r in sample])))
    else:
        weights = np.zeros(BUCKETS + 1, np.float32)
    return score_quality(docs, weights).select(
        "doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
