"""The queries of this subpackage, over whole tables and with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, common, decontaminate, langid, mixing, neardup, negatives, phrases, quality, sharding, tokens, warc
from .common import table

TOKENIZER = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents are exchanged; the checksum is computed from the text that arrives."""
    return sharding.shard(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "doc_start", "item_start", "n_overlap", "n_equal")


def op4_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.roundtrip(table(spark, sf_dir, "pages"), common.scratch_path(spark, "archives"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.classify(table(spark, sf_dir, "documents"))


def op8_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op9_token_counts(spark: SparkSession, sf_dir: str, cache_path: str | None = None) -> DataFrame:
    """With the path of a cache that is kept, only texts that it lacks are encoded; by default the cache is new."""
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), cache_path or common.scratch_path(spark, "token-cache"))


def op10_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents are mixed; the digest is computed from the text that arrives."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.round(F.col("rate") * 1_000_000).cast("long").alias("rate_ppm"), "replica", "shuffle_key", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to ids and ids to bytes; the digests are computed from what comes back."""
    import public_tokenizers

    path, pattern = tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path, pattern, keep=["doc_id"]), path, pattern)
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("token_ids", ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of ids divisible by 7 are moved by one first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


NEAR_DUPLICATES_SQL = r"""
    WITH RECURSIVE words AS (
      SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
      FROM documents),
    shingles AS (
      SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
      FROM words),
    items AS (SELECT doc_id, unnest(s) AS x FROM shingles),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (
      SELECT c.a, c.b FROM common c JOIN shingles p ON p.doc_id = c.a JOIN shingles q ON q.doc_id = c.b
      WHERE 100 * c.k >= 75 * (len(p.s) + len(q.s) - c.k)),
    edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a),
    roots AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
    SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id, s.doc_id = r.component_id AS kept
    FROM shingles s JOIN roots r ON r.doc_id = s.doc_id
"""


#: The contract's columns from the pages themselves; base32 is written out, as SQL has none.
CAPTURES_SQL = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS payload, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
    r AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS response FROM p)
    SELECT page_id, payload_bytes,
      list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
      CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> response THEN response END AS refers_to
    FROM r
"""


HARD_NEGATIVES_SQL = """
    WITH r AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
      FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
      FROM r a JOIN r c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
      s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
    QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 3
"""


COLLOCATIONS_SQL = r"""
    WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
    grams AS (
      SELECT lang, 1 AS k, unnest(w) AS p FROM w
      UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
      UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
    f AS (SELECT lang, k, p, count(*) AS f, string_split(p, ' ') AS s FROM grams GROUP BY lang, k, p),
    n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
    cuts AS (
      SELECT c.lang, c.k, c.p, c.f AS a, i.i AS cut, c.s, array_to_string(c.s[:i.i], ' ') AS x, array_to_string(c.s[i.i + 1:], ' ') AS y
      FROM f c JOIN (VALUES (1), (2)) i(i) ON i.i < c.k WHERE c.k > 1 AND c.f >= 10),
    scored AS (
      SELECT c.*, x.f AS l, y.f AS r, CAST(1000000 * CAST(c.a AS HUGEINT) * c.a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
      FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = c.x JOIN f y ON y.lang = c.lang AND y.p = c.y
      QUALIFY row_number() OVER (PARTITION BY c.lang, c.p ORDER BY score, cut) = 1),
    inside AS (
      SELECT lang, array_to_string(s[1:2], ' ') AS p, a FROM scored WHERE k = 3 UNION ALL SELECT lang, array_to_string(s[2:3], ' '), a FROM scored WHERE k = 3),
    longer AS (SELECT lang, p, max(a) AS longer FROM inside GROUP BY lang, p)
    SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY c.score DESC, c.a DESC, c.p) AS rank, c.p AS phrase, c.a, c.l, c.r, n.n, c.score
    FROM scored c JOIN n ON n.lang = c.lang LEFT JOIN longer g ON g.lang = c.lang AND g.p = c.p
    WHERE g.longer IS NULL OR 100 * g.longer < 50 * c.a
    QUALIFY row_number() OVER (PARTITION BY c.lang ORDER BY c.score DESC, c.a DESC, c.p) <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_quality_classifier, op2_histogram_sharding, op3_spaced_seed_decontamination, op4_multiprobe_neighbours, op5_warc_capture_index,
        op6_minmax_near_duplicates, op7_byte_cnn_language, op8_snapshot_collapse, op9_token_counts, op10_poisson_mixing, op11_byte_bpe, op12_hard_negatives,
        op13_phrase_collocations,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_warc_capture_index": CAPTURES_SQL, "op6_minmax_near_duplicates": NEAR_DUPLICATES_SQL, "op8_snapshot_collapse": chat.oracle(), "op10_poisson_mixing": mixing.oracle(),
        "op12_hard_negatives": HARD_NEGATIVES_SQL, "op13_phrase_collocations": COLLOCATIONS_SQL,
    }
