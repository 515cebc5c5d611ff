"""Phrase collocations with n-grams counted in counting quotient filters.

Texts are read once, in packs: a pack holds its own words and the texts as numbers of them. Words
are counted, those that occur often enough get dense numbers, and each pack is sent the numbers of
its own words, so no dictionary is broadcast. A pack's n-grams of numbered words (an n-gram can't
be more frequent than its words) are packed into integers of bounded width and permuted by an
invertible Feistel network. The permuted number's first bits choose a block, the next are the
quotient, and the rest, kept in full, is the remainder. So a filter loses nothing, and its blocks
are even whatever the words. Filters are sorted; those of one block are merged in a stream over
the sorted shuffle, in memory that follows the block's distinct n-grams, and only n-grams that
are frequent leave it. What follows is joins of word numbers and counts.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of text of a pack (a longer text makes packs of its own, cut at piece ends).
PACK_BYTES = 1 << 21
#: Entries that a task holds before it writes filters, or merges what it has; n-grams of a block, at most as many on average.
ENTRIES = 1 << 19
ROUNDS = 4
PIECE_ENDS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[list(SPACES)], _KIND[list(PIECE_ENDS)] = 1, 2


def _pack(lang: str, texts: list[bytes]) -> pa.RecordBatch:
    """One row: the words of the texts, how often each occurs, and the texts as numbers of words; ~number begins a piece."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    kind = _KIND[data]
    word = kind == 0
    edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[word].tobytes())]).dictionary_encode()
    number = coded.indices.to_numpy().astype(np.int32)
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
    first = np.diff(piece, prepend=-1) != 0
    counts = np.bincount(number, minlength=len(coded.dictionary)).astype(np.int64)
    one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind))
    columns = [pa.array([uuid.uuid4().hex]), pa.array([lang]), one(coded.dictionary, pa.string()), one(pa.array(counts), pa.int64()), pa.array([np.where(first, ~number, number).tobytes()])]
    return pa.RecordBatch.from_arrays(columns, ["pack", "lang", "words", "counts", "seq"])


def _cut(text: bytes) -> Iterator[bytes]:
    """A text in stretches of about PACK_BYTES that end where pieces end."""
    while len(text) > PACK_BYTES:
        end = next((k + 1 for k in range(PACK_BYTES, len(text)) if _KIND[text[k]] == 2), len(text))
        yield text[:end]
        text = text[end:]
    yield text


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for part in _cut(text.as_buffer().to_pybytes() if text.is_valid else b""):
                held.setdefault(lang, []).append(part)
                size[lang] = size.get(lang, 0) + len(part) + 1
                while size and (size[lang] > PACK_BYTES or sum(size.values()) > 4 * PACK_BYTES):  # many languages share the room
                    most = max(size, key=size.__getitem__)
                    yield _pack(most, held.pop(most))
                    del size[most]
                    if lang not in size:
                        break
    for lang, texts in held.items():
        yield _pack(lang, texts)


class Layout:
    """N-grams of ``arity`` word numbers of ``bits`` bits as two integers: ``hi`` (all words but the last) and ``lo``.

    The permutation maps a pair to a pair of the same widths and back. ``block_bits`` of ``hi`` are the block.
    """

    def __init__(self, arity: int, bits: int, block_bits: int):
        if bits > 32:
            raise ValueError("more than 2^32 frequent words")
        self.arity, self.bits, self.wide = arity, bits, (arity - 1) * bits
        self.block_bits = min(block_bits, self.wide)
        self.inner = self.wide - self.block_bits

    @staticmethod
    def _mask(bits: int) -> np.uint64:
        return np.uint64((1 << bits) - 1)

    def _round(self, x: np.ndarray, bits: int, salt: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return common.mixed(x * common.PRIME + np.uint64(salt)) >> np.uint64(64 - bits)

    def pack(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        hi = np.zeros(len(words[0]), np.uint64)
        for w in words[:-1]:
            hi = hi << np.uint64(self.bits) | w.astype(np.uint64)
        return hi, words[-1].astype(np.uint64)

    def unpack(self, hi: np.ndarray, lo: np.ndarray) -> list[np.ndarray]:
        firsts = [hi >> np.uint64(self.bits * k) & self._mask(self.bits) for k in range(self.arity - 2, -1, -1)]
        return [w.astype(np.int64) for w in (*firsts, lo)]

    def permute(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for r in range(ROUNDS):
            hi = hi ^ self._round(lo, self.wide, 2 * r + 1)
            lo = lo ^ self._round(hi, self.bits, 2 * r + 2)
        return hi, lo

    def restore(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for r in reversed(range(ROUNDS)):
            lo = lo ^ self._round(hi, self.bits, 2 * r + 2)
            hi = hi ^ self._round(lo, self.wide, 2 * r + 1)
        return hi, lo

    def merged(self, entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct (hi, lo) with the sums of their counts; sorted runs are merged in nearly linear time."""
        hi, lo, n = (np.concatenate(c) for c in zip(*entries))
        order = np.argsort(hi << np.uint64(self.bits) | lo, kind="stable") if self.wide + self.bits <= 64 else np.lexsort((lo, hi))
        hi, lo, n = hi[order], lo[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))[: len(hi)]
        return hi[first], lo[first], np.add.reduceat(n, first) if len(n) else n

    def blocks(self, hi: np.ndarray) -> np.ndarray:
        return (hi >> np.uint64(self.inner)).astype(np.int64) if self.block_bits else np.zeros(len(hi), np.int64)

    def filter(self, hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> bytes:
        """A counting quotient filter of sorted entries of one block.

        Header (entries, quotient bits), which quotients occur, where the run of each ends, the remainders
        in whole bytes, a byte for each count, and 64 bits for each count from 255 on.
        """
        q = min(self.inner, max(1, len(hi)).bit_length())
        rest = self.inner - q
        inner = hi & self._mask(self.inner)
        quotient = inner >> np.uint64(rest) if q else np.zeros(len(hi), np.uint64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotient.astype(np.int64)] = True
        ends = np.concatenate([quotient[1:] != quotient[:-1], [True]])
        low = lambda x, bits: np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)].tobytes()
        parts = [np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), low(inner & self._mask(rest), rest), low(lo, self.bits), np.minimum(n, 255).astype(np.uint8).tobytes(), n[n >= 255].astype("<i8").tobytes()]
        return struct.pack("<QB", len(hi), q) + b"".join(parts)

    def entries(self, block: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What a filter holds, sorted."""
        (size, q), at = struct.unpack_from("<QB", data), 9
        rest = self.inner - q

        def take(nbytes: int) -> np.ndarray:
            nonlocal at
            at += nbytes
            return np.frombuffer(data, np.uint8, nbytes, at - nbytes)

        def number(bits: int) -> np.ndarray:
            width = -(-bits // 8)
            out = np.zeros((size, 8), np.uint8)
            out[:, :width] = take(size * width).reshape(size, width)
            return out.view("<u8").ravel().astype(np.uint64)

        occupied = np.flatnonzero(np.unpackbits(take(-(-(1 << q) // 8)), count=1 << q))
        ends = np.unpackbits(take(-(-size // 8)), count=size).astype(np.int64)
        quotient = occupied[np.cumsum(ends) - ends].astype(np.uint64)
        inner = quotient << np.uint64(rest) | number(rest)
        lo, n = number(self.bits), take(size).astype(np.int64)
        full = n == 255
        n[full] = np.frombuffer(data, "<i8", int(full.sum()), at)
        top = np.uint64(block << self.inner) if self.block_bits else np.uint64(0)
        return inner | top, lo, n


def _ngrams(seq: np.ndarray, numbers: np.ndarray) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(word numbers, counts) of the distinct bigrams, then trigrams, of a pack; words without a number break them."""
    first = seq < 0
    local = np.where(first, ~seq, seq).astype(np.int64)
    known = numbers[local] >= 0
    pair = known[:-1] & known[1:] & ~first[1:]
    at, size = np.flatnonzero(pair), len(numbers)
    keys, which, counts = np.unique(local[at] * size + local[at + 1], return_inverse=True, return_counts=True)
    yield [numbers[keys // size], numbers[keys % size]], counts
    triple = np.flatnonzero(np.append(pair, False)[at + 1])
    keys3, counts3 = np.unique(which[triple] * size + local[at[triple] + 2], return_counts=True)
    both = keys[keys3 // size]
    yield [numbers[both // size], numbers[both % size], numbers[keys3 % size]], counts3


def _filters(bits: int, block_bits: int):
    layouts = [Layout(a, bits, block_bits) for a in (2, 3)]

    def written(layout: Layout, entries: list) -> Iterator[pa.RecordBatch]:
        hi, lo, n = layout.merged(entries)
        block = layout.blocks(hi)
        edge = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
        cuts = [(a, b) for a, b in zip(edge[:-1], edge[1:]) if b > a]
        data = [layout.filter(hi[a:b], lo[a:b], n[a:b]) for a, b in cuts]
        yield pa.RecordBatch.from_arrays([pa.array([layout.arity] * len(cuts), pa.int32()), pa.array([block[a] for a, _ in cuts], pa.int64()), pa.array(data, pa.binary())], ["arity", "block", "filter"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {0: [], 1: []}
        for batch in batches:
            for k in range(len(batch)):
                seq = np.frombuffer(batch.column(0)[k].as_buffer(), np.int32)
                at, number = (batch.column(c)[k].values.to_numpy() for c in (1, 2))
                numbers = np.full(max(int(np.where(seq < 0, ~seq, seq).max(initial=0)), int(at.max(initial=0))) + 1, -1, np.int64)
                numbers[at] = number
                for n, (words, counts) in enumerate(_ngrams(seq, numbers)):
                    if len(counts):
                        held[n].append((*layouts[n].permute(*layouts[n].pack(words)), counts.astype(np.int64)))
                        if sum(len(e[2]) for e in held[n]) > ENTRIES:
                            yield from written(layouts[n], held[n])
                            held[n] = []
        for n, entries in held.items():
            if entries:
                yield from written(layouts[n], entries)

    return run


def _merger(bits: int, block_bits: int, least: int):
    layouts = {a: Layout(a, bits, block_bits) for a in (2, 3)}

    def frequent(key: tuple[int, int], entries: list) -> pa.RecordBatch:
        layout = layouts[key[0]]
        hi, lo, n = layout.merged(entries)
        often = n >= least
        words = layout.unpack(*layout.restore(hi[often], lo[often]))
        columns = [pa.array(w) for w in words] + [pa.nulls(int(often.sum()), pa.int64())] * (3 - len(words)) + [pa.array(n[often])]
        return pa.RecordBatch.from_arrays(columns, ["w1", "w2", "w3", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for arity, block, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (arity, block) != now:
                    if held:
                        yield frequent(now, held)
                    now, held = (arity, block), []
                held.append(layouts[arity].entries(block, data))
                if len(held) > 1 and sum(len(e[2]) for e in held) > 2 * max(ENTRIES, len(held[0][2])):
                    held = [layouts[arity].merged(held)]
        if held:
            yield frequent(now, held)

    return run


def _numbered(words: DataFrame) -> DataFrame:
    """``words`` with dense numbers ``id`` from 0: rows are counted for each task that wrote them."""
    spark = words.sparkSession
    kept = common.written(words.withColumn("at", F.monotonically_increasing_id()), "words")
    before, total = [], 0
    for part, n in kept.groupBy(F.shiftright("at", 33).alias("part")).count().orderBy("part").collect():  # a row for each task
        before.append((part, total))
        total += n
    starts = F.broadcast(spark.createDataFrame(before, "part long, before long"))
    out = kept.join(starts, F.shiftright("at", 33) == F.col("part")).select(*words.columns, (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("id"))
    out._lotwatch_path = kept._lotwatch_path
    return out


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, text_col: str = "text", lang_col: str = "lang", covered: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best-scored phrases of two or three words of each language.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends and those into words at
    spaces and tabs. ``a`` counts a phrase within pieces, overlaps included; ``l`` and ``r`` count its
    parts at the cut with the lowest score floor(10^6 a a / (l r)); ``n`` counts the language's words.
    Phrases with ``a`` below ``least`` are no candidates, and a candidate inside a longer one that is
    at least ``covered`` % as frequent is dropped. Order: score, a, then the phrase's bytes. Counts are exact
    (products up to 38 digits). Defined cases: a null text is empty, a null language is ``und``; texts of
    any length are counted whole, and a piece is never cut; repeated rows count each time; a language
    without candidates has no rows; an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), F.col(text_col).cast("string"))
    packs = common.written(rows.mapInArrow(_packer, "pack string, lang string, words array<string>, counts array<long>, seq binary"), "packs")
    asked = packs.select("pack", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")).select("pack", "lang", "at", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    words = _numbered(asked.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least))
    totals = packs.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    n_words, n_all = words.count(), totals.agg(F.sum("n")).first()[0] or 0
    bits, block_bits = max(1, n_words.bit_length()), max(0, int(np.ceil(np.log2(max(1, n_all / ENTRIES)))))
    told = asked.select("pack", "lang", "at", "word").join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("pack").agg(F.collect_list(F.struct("at", "id")).alias("m"))
    numbered = packs.select("pack", "seq").join(told, "pack").select("seq", F.col("m.at").alias("at"), F.col("m.id").alias("id"))
    filters = numbered.mapInArrow(_filters(bits, block_bits), "arity int, block long, filter binary")
    merged = filters.repartition("arity", "block").sortWithinPartitions("arity", "block").mapInArrow(_merger(bits, block_bits, least), "w1 long, w2 long, w3 long, a long")
    grams = common.written(merged, "grams")
    return _ranked(grams, words, totals, top, covered)


def _ranked(grams: DataFrame, words: DataFrame, totals: DataFrame, top: int, covered: int) -> DataFrame:
    """The scored, uncovered and ranked phrases among frequent n-grams (w1, w2, w3, a); w3 is null for two words."""
    def facts(k: int) -> DataFrame:
        more = [F.col("lang")] if k == 1 else []
        return words.select(F.col("id").alias(f"w{k}"), F.col("f").alias(f"f{k}"), *more)

    score = lambda left, right: F.expr(f"cast(1000000 * cast(a as decimal(19, 0)) * cast(a as decimal(19, 0)) div (cast({left} as decimal(19, 0)) * cast({right} as decimal(19, 0))) as bigint)")
    pairs, triples = grams.where("w3 is null").drop("w3"), grams.where("w3 is not null")
    over = triples.select("w1", "w2", "a").unionByName(triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a")).groupBy("w1", "w2").agg(F.max("a").alias("longer"))
    two = pairs.join(over, ["w1", "w2"], "left").where(f"longer is null or 100 * longer < {covered} * a").join(facts(1), "w1").join(facts(2), "w2")
    two = two.select("lang", "w1", "w2", F.lit(None).cast("long").alias("w3"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), score("f1", "f2").alias("score"))
    three = triples.join(facts(1), "w1").join(facts(3), "w3")
    three = three.join(pairs.select("w1", "w2", F.col("a").alias("f12")), ["w1", "w2"]).join(pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23")), ["w2", "w3"])
    cut = F.least(F.struct(score("f1", "f23").alias("score"), F.lit(1).alias("k"), F.col("f1").alias("l"), F.col("f23").alias("r")), F.struct(score("f12", "f3").alias("score"), F.lit(2).alias("k"), F.col("f12").alias("l"), F.col("f3").alias("r")))
    three = three.withColumn("cut", cut).select("lang", "w1", "w2", "w3", "a", "cut.l", "cut.r", "cut.score")
    # Ranks by score and count need no texts; all that tie with the last place are kept until the phrases decide.
    near = two.unionByName(three).withColumn("place", F.expr("rank() over (partition by lang order by score desc, a desc)")).where(F.col("place") <= top).drop("place")
    for k in (1, 2, 3):
        near = near.join(words.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"word{k}")), f"w{k}", "left" if k == 3 else "inner")
    placed = near.withColumn("phrase", F.concat_ws(" ", "word1", "word2", "word3")).withColumn("rank", F.expr("row_number() over (partition by lang order by score desc, a desc, phrase)"))
    return placed.where(F.col("rank") <= top).join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
