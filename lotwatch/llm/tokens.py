"""Token counts through a digest cache.

A count is stored under the digest of the text's content and the digest of the tokenizer's file.
Counting joins the digests of the corpus to the cache, encodes each distinct missing text once,
and appends the new counts. The row to encode is settled on digests and ids alone. With few misses
their digests are broadcast and texts are encoded where they lie, so a warm cache moves no text;
with many, texts are shuffled once to meet the misses.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LIMIT = 4096
#: Digests to encode are broadcast up to this number (about 100 bytes each), and shuffled beyond.
BROADCAST_MISSES = 20_000
CACHE_SCHEMA = "content_digest string, tokenizer_digest string, n_tokens long"


def tokenizer_version(path: str) -> str:
    """SHA-256 of the tokenizer's file: another version is another key."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def load_tokenizer(path: str):
    """A function from texts to token counts: ``tokenizers`` for .json, ``sentencepiece`` for .model."""
    if path.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load_tokenizer(path)
        for batch in batches:
            texts, n = batch.column(1).to_pylist(), []
            first, size = 0, 0
            for i, t in enumerate([*texts, None]):  # a pack at a time: ids take several times the text's memory
                if t is None or size > common.PACK_BYTES:
                    n += count(texts[first:i])
                    first, size = i, 0
                size += len(t or "")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["content_digest", "n_tokens"])

    return run


def read_cache(docs: DataFrame, cache_path: str) -> DataFrame:
    """The stored counts; none if nothing was stored yet."""
    spark = docs.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    return spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row; the cache at ``cache_path`` gains what it missed.

    Content is the text's UTF-8 bytes, a null text being empty; no other normalisation, since any
    would change counts. Defined cases: the empty text is counted as the tokenizer counts it; rows
    that repeat, with or without an id, give a row each and are encoded once; null ids are ordinary;
    other columns are ignored.
    """
    version = tokenizer_version(tokenizer_path)
    base = docs.select(F.col(id_col).alias("row_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    digest, pick = F.sha2(F.col("text").cast("binary"), 256).alias("content_digest"), F.xxhash64("row_id").alias("pick")
    digests = common.written(base.select("row_id", digest, F.octet_length("text").cast("long").alias("n_bytes"), pick), "digests")
    known = read_cache(docs, cache_path).where(F.col("tokenizer_digest") == version)
    # One row of each missing content, and how many rows answer to that description.
    picks = digests.groupBy("content_digest", "pick").agg(F.count("*").alias("n")).groupBy("content_digest").agg(F.min(F.struct("pick", "n")).alias("p"))
    missing = common.written(picks.join(known, "content_digest", "left_anti").select("content_digest", "p.pick", "p.n"), "misses")
    keyed = base.select(digest, pick, "text")

    def met(rows: DataFrame) -> DataFrame:
        wanted = rows.select("content_digest", "pick")
        return keyed.join(F.broadcast(wanted) if rows.count() <= BROADCAST_MISSES else wanted, ["content_digest", "pick"], "left_semi").select("content_digest", "text")

    # Where several rows answer (they repeat, or have no id), one of them is taken by an aggregation that begins in their tasks.
    several = missing.where("n > 1")
    texts = met(missing.where("n = 1"))
    if not several.isEmpty():
        texts = texts.unionByName(met(several).groupBy("content_digest").agg(F.max("text").alias("text")))
    if not missing.isEmpty():
        new = texts.mapInArrow(_encoder(tokenizer_path), "content_digest string, n_tokens long")
        new.select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(cache_path)
    common.release(missing)
    # An append that was repeated after a failure may have stored a key twice. The counts are written before the join:
    # an aggregation in the join's own stage would keep Spark from splitting the partition of a text with very many copies.
    counts = read_cache(docs, cache_path).where(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    out = digests.join(common.written(counts, "counts"), "content_digest")
    return out.select(F.col("row_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
