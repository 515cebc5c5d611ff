"""Chat formatting with cumulative-snapshot collapse, with DataFrame functions only.

Logs often hold a conversation once for every turn: each snapshot repeats the one before and adds
to it. A rolling hash of the turns names every prefix. A conversation whose full hash is another's
proper prefix is dropped by an anti-join; of equal conversations the smallest id stays; what
remains is rendered. Marks of the format inside roles and texts are escaped, so no text can open
or close a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Rendering of one turn and what joins turns: fixed strings of the format.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
#: What every mark begins with, and what stands for it inside roles and texts.
MARK, ESCAPED = "<|", "<\\|"


def _content_hash(salt: int) -> Column:
    """Hash of a turn's role and text; nulls differ from empty texts."""
    return F.xxhash64(F.lit(salt), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, n, last, h1, h2) for each turn: the hash pair of the first n turns, and whether they are all.

    Texts are hashed where they lie; only hashes are shuffled. With the turn's number in each hash, the xor over a
    prefix depends on the order.
    """
    slim = turns.select("conv_id", "turn", _content_hash(1).alias("c1"), _content_hash(2).alias("c2"))
    numbered = slim.selectExpr("*", "row_number() over (partition by conv_id order by turn nulls first, c1, c2) as n", "count(*) over (partition by conv_id) as n_turns")
    hashed = numbered.select("conv_id", "n", "n_turns", F.xxhash64("n", "c1").alias("x1"), F.xxhash64("n", "c2").alias("x2"))
    run = "over (partition by conv_id order by n rows between unbounded preceding and current row)"
    return hashed.selectExpr("conv_id", "n", "n = n_turns as last", f"bit_xor(x1) {run} as h1", f"bit_xor(x2) {run} as h2")


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies): conversations that no other one extends, one of each group of equal ones.

    A shared first turn or a conversation logged very often is one row for each map task after the
    partial aggregation, so no key's rows meet in one task.
    """
    rows = common.written(prefixes(turns), "prefixes")
    full = rows.where("last").groupBy("h1", "h2", "n").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = rows.where("not last").select("h1", "h2", "n").distinct()
    return full.join(inner, ["h1", "h2", "n"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def format_chats(turns: DataFrame) -> DataFrame:
    r"""(conv_id, n_turns, n_copies, rendered) for each maximal conversation of ``turns`` (conv_id, turn, role, text).

    Defined cases: rows without a conv_id take no part; a null turn sorts first, equal turns by the
    hash of role and text in comparisons and by role and text when rendered; null roles and texts are rendered as empty but aren't equal to them; rows that repeat
    are turns of their own; an empty table gives an empty result; other columns are ignored. A
    conversation is one output row by its nature, so its turns meet in one task; texts of any length
    are hashed and rendered whole. ``<|`` in a role or text is rendered as ``<\|``; a line end in a
    role as a blank.
    """
    slim = turns.where(F.col("conv_id").isNotNull()).select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    kept = maximal(slim)
    said = slim.join(kept, "conv_id").groupBy("conv_id", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("said"))
    plain = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit(MARK), F.lit(ESCAPED))
    part = lambda t: F.concat(F.lit(OPEN), F.translate(plain(t["role"]), "\r\n", "  "), F.lit(MIDDLE), plain(t["text"]), F.lit(CLOSE))
    return said.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_copies", F.array_join(F.transform("said", part), "").alias("rendered"))


def oracle(table: str = "conversations") -> str:
    """DuckDB SQL for the rows of :func:`format_chats` over distinct, non-null turns."""
    return f"""
    WITH chats AS (
      SELECT conv_id, count(*) AS n_turns, string_agg('{OPEN}' || replace(role, '{MARK}', '{ESCAPED}') || chr(10) || replace(text, '{MARK}', '{ESCAPED}') || '{CLOSE.strip()}' || chr(10), '' ORDER BY turn) AS rendered
      FROM {table} GROUP BY conv_id),
    one AS (SELECT min(conv_id) AS conv_id, n_turns, rendered, count(*) AS n_copies FROM chats GROUP BY n_turns, rendered)
    SELECT a.conv_id, CAST(a.n_turns AS BIGINT) AS n_turns, CAST(a.n_copies AS BIGINT) AS n_copies, a.rendered FROM one a
    WHERE NOT EXISTS (SELECT 1 FROM one b WHERE b.n_turns > a.n_turns AND starts_with(b.rendered, a.rendered))
    """
