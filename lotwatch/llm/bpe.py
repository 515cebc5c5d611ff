"""Byte-level BPE as a monoid: a text is encoded in halves, and the encodings of neighbours are joined.

What joins is a :class:`Part`: a text, its ids, and where its last settled piece boundary lies. Two
facts make a join exact though it looks at the surroundings of the cut alone.

* Pieces. The pattern decides a match by the characters up to two beyond its end, and looks at
  nothing before it. So a boundary two characters before the end of a part stays one whatever
  follows, and the pieces after a common boundary of two texts that end alike are the same. The
  window around the cut begins at the left part's settled boundary and grows to the right until
  one of its boundaries is one of the right part's own.
* Tokens. A sequence of tokens is the encoding of its bytes if and only if each two neighbours are
  the encoding of theirs: merges are chosen by rank, then from the left, and the first merge over a
  token's edge would be chosen between these two alone as well. So a piece that lies over the cut
  is joined from its parts by encoding a growing window of tokens until both its edges hold.

Decoding is the same tree with concatenation. Texts over ``SEGMENT_BYTES`` are encoded in segments
by many tasks and joined by ``FAN`` at a time, one exchange for each level, each distinct text once.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Characters that are encoded at once, bytes of a piece above which its halves are joined by tokens.
LEAF, LONG_PIECE = 4096, 512
#: Texts of more bytes are cut in segments of about so many characters; as many neighbours are joined in one task.
SEGMENT_BYTES, FAN = 1 << 20, 8
#: Ids that are decoded at once.
DECODE_LEAF = 4096
#: Characters that the pattern may look at beyond the end of a match.
REACH = 2
#: Long texts' results are broadcast up to this number, and shuffled beyond.
BROADCAST_LONG = 64


class Part(NamedTuple):
    """An encoded text. The last ``tail_ids`` ids are those of its last ``tail`` characters, which begin at a settled boundary."""

    text: str
    ids: list[int]
    tail: int
    tail_ids: int


class Encoder:
    """The monoid for one vocabulary (a file of base64 tokens and ranks) and one piece pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.tiktoken = tiktoken

    @functools.cached_property
    def classes(self) -> np.ndarray:
        """An ASCII character of the same class for each other character, as the library's pattern engine sees it: its Unicode version isn't Python's."""
        out = np.full(0x110000, ord("!"), np.uint8)
        out[:128] = np.arange(128)
        every = "".join(map(chr, [*range(128, 0xD800), *range(0xE000, 0x110000)]))
        single = {bytes([b]): b for b in range(256)}
        for pattern, sign in ((r"\p{L}", "A"), (r"\p{N}", "0"), (r"\s", "\v")):
            found = bytes(self.tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every))
            out[np.frombuffer(found.decode().encode("utf-32-le"), np.uint32)] = ord(sign)
        return out

    @functools.cached_property
    def unreachable(self) -> set[bytes]:
        """Tokens that merging doesn't arrive at: they stand for a whole piece only."""
        return {t for t in self.ranks if len(self._merged(t)) > 1}

    def _merged(self, data: bytes) -> list[bytes]:
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 62:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _ends(self, text: str, start: int = 0) -> list[int]:
        """Where the pieces of ``text[start:]`` end."""
        shape = self.classes[np.frombuffer(text[start:].encode("utf-32-le", "surrogatepass"), np.uint32)].tobytes().decode("ascii")
        return [start + m.end() for m in self.pattern.finditer(shape)]

    def merge(self, data: bytes) -> list[int]:
        """The ids of a stretch inside a piece, by merging alone."""
        if data in self.unreachable:
            return [self.ranks[t] for t in self._merged(data)]
        return self.encoding._encode_single_piece(data) if data else []

    def join_tokens(self, a: list[int], b: list[int]) -> list[int]:
        """The ids of a stretch from those of its two parts."""
        i = j = 1
        while True:
            i, j = min(i, len(a)), min(j, len(b))
            made = self.merge(b"".join(map(self.tokens.__getitem__, a[len(a) - i :] + b[:j])))
            left = i == len(a) or self._holds(a[-i - 1], made[0])
            right = j == len(b) or self._holds(made[-1], b[j])
            if left and right:
                return a[: len(a) - i] + made + b[j:]
            i, j = i if left else 2 * i, j if right else 2 * j

    def _holds(self, a: int, b: int) -> bool:
        return self.merge(self.tokens[a] + self.tokens[b]) == [a, b]

    def stretch(self, data: bytes) -> list[int]:
        """The ids of a long stretch inside a piece, in halves."""
        if len(data) <= LONG_PIECE:
            return self.merge(data)
        half = len(data) // 2
        return self.join_tokens(self.stretch(data[:half]), self.stretch(data[half:]))

    def piece(self, data: bytes) -> list[int]:
        return [self.ranks[data]] if data in self.ranks else self.stretch(data)

    def leaf(self, text: str) -> Part:
        ids = self.encoding.encode_ordinary(text)
        # White space after another character begins a piece wherever it stands: start there if there is such a place.
        start = next((k for k in range(max(1, len(text) - 256), len(text) - REACH) if text[k] in " \t\n\r\f\v" and " " < text[k - 1] < "\x7f"), 0)
        settled = max((e for e in self._ends(text, start) if e <= len(text) - REACH), default=start)
        return Part(text, ids, len(text) - settled, self._count_back(ids, len(text[settled:].encode("utf-8", "surrogatepass"))))

    def _count_back(self, ids: list[int], size: int) -> int:
        """How many ids at the end make ``size`` bytes."""
        n = 0
        while size > 0:
            n += 1
            size -= len(self.tokens[ids[-n]])
        return n

    def _count(self, ids: list[int], size: int) -> int:
        """How many ids at the beginning make ``size`` bytes."""
        n = 0
        while size > 0:
            size -= len(self.tokens[ids[n]])
            n += 1
        return n

    def join(self, a: Part, b: Part) -> Part:
        if not a.text or not b.text:
            return a if a.text else b
        utf8 = lambda s: s.encode("utf-8", "surrogatepass")
        tail, reach = a.text[len(a.text) - a.tail :], 64
        cut = len(tail)
        while True:
            head, whole = b.text[:reach], reach >= len(b.text)
            least = 0 if whole else REACH
            own = [0, *(e for e in self._ends(head) if e <= len(head) - least)]
            ends = [e for e in self._ends(tail + head) if e <= cut + len(head) - least]
            meet = min({e + cut for e in own} & set(ends), default=None)
            if meet is not None:
                break
            reach *= 4
        window, made, settled, after = tail + head, [], 0, 0
        taken = self._count(b.ids, len(utf8(b.text[: meet - cut])))
        for begin, end in zip([0, *ends], ends[: ends.index(meet) + 1]):
            data = utf8(window[begin:end])
            if begin < cut < end and len(data) > LONG_PIECE:
                # Known on both sides, if each side's share is a piece of its own there.
                x, y = window[begin:cut], window[cut:end]
                first = begin == max([0, *(e for e in self._ends(tail) if e < cut)])
                left = a.ids[len(a.ids) - self._count_back(a.ids, len(utf8(x))) :] if first and utf8(x) not in self.unreachable else self.stretch(utf8(x))
                known = len(own) > 1 and own[1] == len(y) and utf8(y) not in self.unreachable
                right = b.ids[: self._count(b.ids, len(utf8(y)))] if known else self.stretch(utf8(y))
                made += self.join_tokens(left, right)
            else:
                made += self.piece(data)
            if end <= cut + len(b.text) - REACH:
                settled, after = end, len(made)
        ids = a.ids[: len(a.ids) - a.tail_ids] + made + b.ids[taken:]
        if len(b.text) - b.tail >= meet - cut and len(b.text) >= REACH:  # a boundary of both, and settled
            return Part(a.text + b.text, ids, b.tail, b.tail_ids)
        return Part(a.text + b.text, ids, cut + len(b.text) - settled, len(made) - after + len(b.ids) - taken)

    def joined(self, parts: list[Part]) -> Part:
        """Neighbours in pairs until one is left."""
        while len(parts) > 1:
            parts = [self.join(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0]

    def encode(self, text: str) -> Part:
        if len(text) <= LEAF:
            return self.leaf(text)
        half = len(text) // 2
        return self.join(self.encode(text[:half]), self.encode(text[half:]))

    def ids(self, text: str) -> list[int]:
        return self.encode(text).ids if len(text) > LEAF else self.encoding.encode_ordinary(text)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= DECODE_LEAF:
            return self.encoding.decode_bytes(ids)
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@functools.lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path, pattern)


def _in_packs(batches: Iterator[pa.RecordBatch], column: str, cost) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Rows with the column's values, as many at a time as ``cost`` lets through."""
    for batch in batches:
        values = batch.column(column)
        first, size = 0, 0
        for k in range(len(batch)):
            size += cost(values[k])
            if size > common.PACK_BYTES or k + 1 == len(batch):
                yield batch.slice(first, k + 1 - first), values.slice(first, k + 1 - first).to_pylist()
                first, size = k + 1, 0


def _lists(rows: list[list[int] | None]) -> pa.Array:
    arrays = [np.asarray(x or [], np.int32) for x in rows]
    at = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32)), mask=pa.array([x is None for x in rows], pa.bool_()))


def _encoding(path: str, pattern: str, keep: list[str], text: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for rows, texts in _in_packs(batches, text, lambda v: len(v.as_buffer()) if v.is_valid else 0):
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), _lists([own.ids(t or "") for t in texts])], [*keep, out])

    return run


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each segment of each text."""
    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n = max(1, len(text.encode()) // max(1, SEGMENT_BYTES))
            width = -(-len(text) // n)
            for k in range(-(-len(text) // width)):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int32()), pa.array([text[k * width : (k + 1) * width]])], ["text_digest", "k", "text"])


def _segment_encoder(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for rows, texts in _in_packs(batches, "text", lambda v: len(v.as_buffer())):
            parts = [own.encode(t) for t in texts]
            small = lambda x: pa.array(x, pa.int32())
            yield pa.RecordBatch.from_arrays([*rows.columns, _lists([p.ids for p in parts]), small([p.tail for p in parts]), small([p.tail_ids for p in parts])], [*rows.schema.names, "ids", "tail", "tail_ids"])

    return run


PART_SCHEMA = "text_digest string, k int, text string, ids array<int>, tail int, tail_ids int"


def _joiner(path: str, pattern: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        parts = [Part(t, list(map(int, i)), a, b) for t, i, a, b in zip(rows["text"], rows["ids"], rows["tail"], rows["tail_ids"])]
        whole = encoder(path, pattern).joined(parts)
        return pd.DataFrame({"text_digest": [rows["text_digest"].iloc[0]], "k": [rows["k"].iloc[0] // FAN], "text": [whole.text], "ids": [whole.ids], "tail": [whole.tail], "tail_ids": [whole.tail_ids]})

    return run


def _long_texts(texts: DataFrame, path: str, pattern: str) -> DataFrame:
    """(text_digest, ids) of distinct long texts (text_digest, text): segments side by side, then joined up the tree."""
    cut = texts.mapInArrow(_segments, "text_digest string, k int, text string")
    level = common.written(cut.repartition("text_digest", "k").mapInArrow(_segment_encoder(path, pattern), PART_SCHEMA), "segments")
    most = level.agg(F.max("k")).first()[0]
    while most:
        above = common.written(level.groupBy("text_digest", F.floor(F.col("k") / FAN).alias("above")).applyInPandas(_joiner(path, pattern), PART_SCHEMA), "segments")
        common.release(level)
        level, most = above, most // FAN
    return level


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "token_ids", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) and ``out``: the ids of the text, without special tokens.

    Each match of ``pattern`` is encoded separately. The ids are those of the tiktoken library for
    the ranks in the file ``path``. The pattern may use the classes of letters, numbers and white
    space and ASCII characters, and look no further than two characters beyond a match (tested for
    the public one). Defined cases: a null text is empty and an empty text has no ids; texts of any
    length are encoded whole; rows that repeat, and null ids, are rows like others; a kept column
    named like the result gets underscores in front; an empty table gives an empty result.
    """
    text, names = F.coalesce(F.col(text_col).cast("string"), F.lit("")), keep or docs.columns
    taken = [*docs.columns, out]
    renamed = {c: common.fresh(c, taken) for c in names if c.lower() == out.lower()}
    body, digest = common.fresh("encoded_text", [*taken, *renamed.values()]), common.fresh("text_digest", [*taken, *renamed.values()])
    rows = docs.select(*(F.col(c).alias(renamed.get(c, c)) for c in names), text.alias(body))
    kept, long = [renamed.get(c, c) for c in names], F.octet_length(body) > SEGMENT_BYTES
    schema = rows.select(*kept).withColumn(out, F.lit(None).cast("array<int>")).schema
    ids = rows.where(~long).mapInArrow(_encoding(path, pattern, kept, body, out), schema)
    name = F.sha2(F.col(body).cast("binary"), 256)
    # Which rows are long is settled on digests; one text of each is then picked in an aggregation that begins in the tasks.
    some = common.written(rows.where(long).select(name.alias("text_digest")).distinct(), "long-texts")
    n = some.count()
    if not n:
        common.release(some)
        return ids
    texts = rows.where(long).groupBy(name.alias("text_digest")).agg(F.first(body).alias("text"))
    found = _long_texts(texts, path, pattern).select(F.col("text_digest").alias(digest), F.col("ids").alias(out))
    right = F.broadcast(found) if n <= BROADCAST_LONG else found
    return ids.unionByName(rows.where(long).withColumn(digest, name).drop(body).join(right, digest).select(*kept, out))


def _decoding(path: str, pattern: str, keep: list[str], ids: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for rows, lists in _in_packs(batches, ids, lambda v: 4 * len(v) if v.is_valid else 0):
            data = [own.decode(x) if x is not None and all(i in own.tokens for i in x) else None for x in lists]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), pa.array(data, pa.binary())], [*keep, out])

    return run


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with ``out``: the bytes of its ids. Null ids, and lists with a null or an id that the vocabulary lacks, give null; a column named like the result gets underscores in front."""
    renamed = {c: common.fresh(c, [*encoded.columns, out]) for c in encoded.columns if c.lower() == out.lower()}
    rows = encoded.withColumnsRenamed(renamed)
    schema = rows.withColumn(out, F.lit(None).cast("binary")).schema
    return rows.mapInArrow(_decoding(path, pattern, rows.columns, renamed.get(ids_col, ids_col), out), schema)
