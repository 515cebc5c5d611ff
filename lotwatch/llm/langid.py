"""Language identification: a byte convolutional network in numpy.

Bytes are embedded, convolved by filters of several widths, max-pooled over a window and
classified by a softmax. Training runs on a bounded sample of labelled rows. Every text is read
whole, in windows of a fixed length; a document's probabilities are the mean of its windows',
weighted by their letters. For prediction the embedding and the filters are multiplied out into
tables indexed by byte pairs, which gives the same activations without a matrix product per byte.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW, DIM, FILTERS, WIDTHS = 192, 8, 16, (2, 4)
EPOCHS, BATCH, RATE = 10, 32, 0.15
#: Labelled rows of each language to learn from, about; windows taken of each, from anywhere in its text. Only training is bounded so.
SAMPLE_ROWS, SAMPLE_WINDOWS = 600, 3
#: Languages are broadcast up to this number, and shuffled beyond.
BROADCAST_LANGUAGES = 10_000
UNKNOWN = "und"

#: Letters are lower-cased where they are single bytes; other ASCII is white space. Bytes from 128 stay.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


@dataclass
class Model:
    names: list[str]
    embedding: np.ndarray  # 256 x DIM
    filters: list[np.ndarray]  # for each width: width x DIM x FILTERS
    biases: list[np.ndarray]
    weights: np.ndarray  # all filters x languages
    bias: np.ndarray

    def pair_tables(self) -> list[list[np.ndarray]]:
        """For each width, tables whose sum over consecutive byte pairs is the convolution."""
        tables = []
        for w in self.filters:
            single = [self.embedding @ w[j] for j in range(len(w))]
            tables.append([(single[j][:, None, :] + single[j + 1][None, :, :]).reshape(65536, -1).astype(np.float32) for j in range(0, len(w), 2)])
        return tables


def windows(text: bytes, length: int = WINDOW) -> np.ndarray:
    """The folded bytes of a text in rows of ``length``, the last filled with blanks."""
    data = FOLD[np.frombuffer(text, np.uint8)]
    rows = max(1, -(-len(data) // length))
    out = np.full(rows * length, 32, np.uint8)
    out[: len(data)] = data
    return out.reshape(rows, length)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def chosen_windows(text: bytes, count: int = SAMPLE_WINDOWS) -> bytes:
    """Up to ``count`` of the text's windows, drawn by a number from the text itself."""
    w = windows(text)
    rng = np.random.default_rng(zlib.crc32(text))
    return w[rng.permutation(len(w))[:count]].tobytes()


def train(samples: list[bytes], langs: list[str], seed: int = 5) -> Model | None:
    """Fit the network on windows (each sample holds some) by plain stochastic gradient descent with momentum; None without a usable window."""
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for sample, lang in zip(samples, langs):
        for row in np.frombuffer(sample, np.uint8).reshape(-1, WINDOW).copy():
            if rng.random() < 0.3:  # short texts must be told apart too
                cut = np.where(np.arange(WINDOW) < rng.integers(8, WINDOW), row, 32).astype(np.uint8)
                row = cut if (cut != 32).any() else row
            if (row != 32).any():  # every window with a letter counts
                rows.append(row)
                labels.append(lang)
    if not rows:
        return None
    names = sorted(set(labels))
    place = {n: i for i, n in enumerate(names)}
    labels = [place[x] for x in labels]
    k = len(names)
    model = Model(
        names, rng.normal(0, 0.5, (256, DIM)), [rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)) for w in WIDTHS],
        [np.zeros(FILTERS) for _ in WIDTHS], rng.normal(0, 0.3, (FILTERS * len(WIDTHS), k)), np.zeros(k),
    )
    if k == 1:
        return model
    data, label = np.array(rows), np.array(labels)
    share = np.bincount(label, minlength=k) / len(label)
    params = [model.embedding, *model.filters, *model.biases, model.weights, model.bias]
    speed = [np.zeros_like(p) for p in params]
    steps, done = EPOCHS * -(-len(data) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(data))
        for first in range(0, len(order), BATCH):
            pick = order[first : first + BATCH]
            x, y = data[pick], label[pick]
            emb = model.embedding[x]
            pooled, where, hidden = [], [], []
            for w, b in zip(model.filters, model.biases):
                act = sum(emb[:, j : WINDOW - len(w) + 1 + j] @ w[j] for j in range(len(w)))
                top = act.argmax(axis=1)
                best = np.take_along_axis(act, top[:, None, :], 1)[:, 0] + b
                where.append(top)
                hidden.append(best)
                pooled.append(np.maximum(best, 0))
            flat = np.concatenate(pooled, axis=1)
            p = _softmax(flat @ model.weights + model.bias)
            p[np.arange(len(y)), y] -= 1
            p *= (1 / (k * np.maximum(share[y], 1e-9)))[:, None] / len(y)
            back = (p @ model.weights.T) * (np.concatenate(hidden, axis=1) > 0)
            g_emb = np.zeros_like(model.embedding)
            g_filters, g_biases = [], []
            for n, w in enumerate(model.filters):
                g = back[:, n * FILTERS : (n + 1) * FILTERS]
                g_w = np.zeros_like(w)
                for j in range(len(w)):
                    at = np.take_along_axis(x, where[n] + j, 1)
                    g_w[j] = np.einsum("bfd,bf->df", model.embedding[at], g)
                    np.add.at(g_emb, at, g[:, :, None] * w[j].T[None])
                g_filters.append(g_w)
                g_biases.append(g.sum(axis=0))
            grads = [g_emb, *g_filters, *g_biases, flat.T @ p, p.sum(axis=0)]
            rate = RATE * (1 - done / steps)
            done += 1
            for q, v, g in zip(params, speed, grads):
                v *= 0.9
                v -= rate * np.clip(g, -1, 1)
                q += v
    return model


class Predictor:
    def __init__(self, model: Model):
        self.model, self.tables = model, model.pair_tables()

    def window_probabilities(self, data: np.ndarray) -> np.ndarray:
        pair = (data[:, :-1].astype(np.int32) << 8) | data[:, 1:]
        pooled = []
        for w, b, tables in zip(self.model.filters, self.model.biases, self.tables):
            size = data.shape[1] - len(w) + 1
            act = tables[0][pair[:, :size]]
            for j in range(1, len(tables)):
                act += tables[j][pair[:, 2 * j : 2 * j + size]]
            pooled.append(np.maximum(act.max(axis=1) + b, 0))
        return _softmax(np.concatenate(pooled, axis=1) @ self.model.weights + self.model.bias)

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each whole text and its probability."""
        held = [windows(t) for t in texts]
        count = np.array([len(w) for w in held])
        data = np.concatenate(held)
        prob = np.concatenate([self.window_probabilities(data[i : i + 256]) for i in range(0, len(data), 256)])
        weight = (data != 32).sum(axis=1) + 1e-9
        start = np.concatenate([[0], np.cumsum(count)[:-1]])
        mean = np.add.reduceat(prob * weight[:, None], start) / np.add.reduceat(weight, start)[:, None]
        best = mean.argmax(axis=1)
        return [self.model.names[i] for i in best], np.clip(mean[np.arange(len(best)), best], 0, 1)


def labelled_sample(docs: DataFrame, usable: Column, rows: int = SAMPLE_ROWS) -> list:
    """(windows, lang) of about ``rows`` rows of each language, picked by the ids' hashes: the same in every run.

    One pass counts the languages, a second keeps the rows below each language's share of the hash
    range, whatever their length. Only their chosen windows reach the driver: it holds at most
    SAMPLE_WINDOWS windows of each of these rows, so what it holds grows with the languages alone.
    """
    known = docs.where(usable & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = common.written(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_LANGUAGES else counts
    # Rows are told apart by their texts where ids repeat.
    share = F.pmod(common.hash_order(F.col("doc_id"), F.col("text")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = known.join(counts, "lang").where((share * F.col("n") < rows) & F.col("text").rlike(r"\p{L}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [chosen_windows(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary()), batch.column(2)], ["doc_id", "windows", "lang"])

    found = picked.select("doc_id", "text", "lang").mapInArrow(run, "doc_id string, windows binary, lang string").distinct()
    return sorted(found.collect(), key=lambda r: (zlib.crc32(r["doc_id"].encode()), r["doc_id"], r["windows"]))


def identify(docs: DataFrame, model: Model | None, lang: str = "lang_pred", score: str = "score", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the language in ``lang`` and its probability in ``score``; columns of such names get an underscore in front.

    Null texts and texts without a letter are ``und`` with score 0, as is everything if there is no model.
    """
    base = common.set_aside(docs, lang, score, keep=(text_col,))
    if model is None:
        return base.withColumns({lang: F.lit(UNKNOWN), score: F.lit(0.0)})
    letter, place = common.fresh("has_letter", base.columns), [c.lower() for c in base.columns].index(text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(model)
        for batch in batches:
            texts = batch.column(place).cast(pa.binary()).fill_null(b"").to_pylist()
            langs, probs = [], []
            for _, pack in common.packs(texts, 1 << 17):
                a, b = predictor.predict(pack)
                langs += a
                probs += b.tolist()
            known = batch.column(batch.num_columns - 1).to_pylist()
            made = [pa.array([x if k else UNKNOWN for x, k in zip(langs, known)], pa.string()), pa.array([x if k else 0.0 for x, k in zip(probs, known)], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], lang, score])

    schema = T.StructType([*base.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    return base.withColumn(letter, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, schema)


def learnt(docs: DataFrame, usable: Column) -> Model | None:
    sample = labelled_sample(docs, usable)
    return train([bytes(r["windows"]) for r in sample], [r["lang"] for r in sample])


def classify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row, learnt from the rows that aren't held out.

    Defined cases: as for :func:`identify`; rows without an id or a language are never learnt from;
    without a usable labelled window everything is ``und``; other columns are ignored.
    """
    model = learnt(docs, ~common.held_out(F.col("doc_id")))
    return identify(docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")), model).select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
