"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the output. A document's number of copies is Poisson
distributed with mean (target rows of its source) / (rows of its source): the inverse of the
distribution at a number hashed from seed and the row's name (its id; rows that share one are told
apart by text and occurrence), so it doesn't depend on partitions or order. Copies are exploded and
shuffled globally by a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Default target: shares in proportion to rows ** TEMPERATURE (1: as they are; 0: all equal).
TEMPERATURE = 0.7
#: Poisson numbers of a larger mean are drawn as sums of independent ones of at most this mean.
MEAN_STEP = 8.0
#: Terms of the inverse: beyond this, a mean of MEAN_STEP has less probability than a double can tell from 1.
TERMS = 60
SEED = "lotwatch"
#: Sources are broadcast up to this number, and shuffled beyond.
BROADCAST_SOURCES = 100_000


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) from 52 bits of the md5 of the joined texts: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, source_col: str, weights: dict[str, float] | None, size: int | None, temperature: float) -> DataFrame:
    """(source, n, rate) for each source; a source without a given weight has weight 0."""
    counts = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(temperature))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        weight = F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(F.col("source"), F.lit(""))), F.lit(0.0)) if pairs else F.lit(0.0)
    counts = common.written(counts.withColumn("weight", weight), "source-weights")
    all_weight, all_n = counts.agg(F.coalesce(F.sum("weight"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    rate = F.try_divide(F.col("weight") * F.lit(float(all_n if size is None else size)), F.lit(float(all_weight)) * F.col("n"))
    return counts.select("source", "n", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def cumulative(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson X with a mean of at most MEAN_STEP, as far as a double tells them from 1."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))
    term = lambda a, i: a["p"] * mean / i
    step = lambda a, i: F.struct(term(a, i).alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + term(a, i))).alias("c"))
    return F.filter(F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, step, lambda a: a["c"]), lambda c: c < 1)


def poisson(u: Column, sums: Column) -> Column:
    """The least k with u < P(X <= k): the inverse at u, given the cumulative probabilities."""
    return F.size(F.filter(sums, lambda c: c <= u))


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, size: int | None = None, temperature: float = TEMPERATURE, seed: str = SEED,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """``docs`` with ``rate``, ``replica`` (from 0) and ``shuffle_key``: each row as often as drawn, in global hash order.

    The expected rows of a source are its share of ``size`` (default: the rows of the input).
    Defined cases: null sources are a source of their own, of weight 0 if weights are given; rows
    without an id and rows that share one have independent draws; a weight of 0 drops a source; an
    empty table gives an empty result; the input's columns of the new names stay, with an underscore
    in front.
    """
    base = common.set_aside(docs, "rate", "replica", "shuffle_key", keep=(id_col, source_col, text_col))
    own = base.columns
    src, draws, count, sums, name, mean = (common.fresh(n, own) for n in ("mix_source", "mix_draws", "mix_count", "mix_sums", "mix_name", "mix_rate"))
    by_source = common.written(rates(base, source_col, weights, size, temperature), "rates")
    small = by_source.count() <= BROADCAST_SOURCES
    # What depends on the source alone is computed once for each source.
    times = F.greatest(F.lit(1), F.ceil(F.col("rate") / MEAN_STEP)).cast("int")
    by_source = by_source.withColumn(draws, times).select(F.col("source").alias(src), F.col("rate").alias(mean), draws, cumulative(F.col("rate") / F.col(draws)).alias(sums))
    named = common.row_names(base, name, id_col, text_col)
    joined = named.join(F.broadcast(by_source) if small else by_source, F.col(source_col).cast("string").eqNullSafe(F.col(src)))
    key = F.col(name)
    drawn = F.aggregate(F.sequence(F.lit(1), F.col(draws)), F.lit(0), lambda a, i: a + poisson(uniform(F.lit(seed), key, i), F.col(sums)))
    copies = joined.withColumn(count, drawn).withColumn("replica", F.explode(F.when(F.col(count) > 0, F.sequence(F.lit(0), F.col(count) - 1))))
    shuffled = copies.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(seed), key, F.col("replica").cast("string"), F.lit("order")).cast("binary")))
    # Nothing of a source's table moves with the rows: its arrays would be many times a document.
    moved = shuffled.select(*own, F.col(mean).alias("rate"), "replica", "shuffle_key").repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return moved.select(*own, "rate", "replica", "shuffle_key")


def oracle(table: str = "documents", temperature: float = TEMPERATURE, seed: str = SEED) -> str:
    """DuckDB SQL for the rows of :func:`mix` with default weights, a digest standing for the text; ids are distinct."""
    u = f"CAST(CAST('0x' || substr(md5('{seed}|' || CAST(doc_id AS VARCHAR) || '|' || CAST(i AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / {float(1 << 52)}"
    return f"""
    WITH RECURSIVE counts AS (SELECT source, count(*) AS n, pow(CAST(count(*) AS DOUBLE), {temperature}) AS weight FROM {table} GROUP BY source),
    rates AS (SELECT source, weight * (SELECT sum(n) FROM counts) / ((SELECT sum(weight) FROM counts) * n) AS rate FROM counts),
    parts AS (SELECT source, rate, CAST(greatest(1, ceil(rate / {MEAN_STEP})) AS INTEGER) AS draws FROM rates),
    terms AS (
      SELECT source, 0 AS k, rate / draws AS mean, exp(-(rate / draws)) AS p, exp(-(rate / draws)) AS c FROM parts
      UNION ALL SELECT source, k + 1, mean, p * mean / (k + 1), c + p * mean / (k + 1) FROM terms WHERE k + 1 < {TERMS}),
    numbers AS (
      SELECT d.doc_id, d.source, rate, {u} AS u
      FROM {table} d JOIN parts ON d.source IS NOT DISTINCT FROM parts.source, LATERAL (SELECT unnest(range(1, draws + 1)) AS i) x),
    drawn AS (
      SELECT doc_id, numbers.source, rate, count(*) FILTER (WHERE u >= c) AS copies
      FROM numbers JOIN terms ON numbers.source IS NOT DISTINCT FROM terms.source GROUP BY ALL)
    SELECT doc_id, drawn.source, CAST(round(rate * 1000000) AS BIGINT) AS rate_ppm, CAST(r AS INTEGER) AS replica,
      md5('{seed}|' || CAST(doc_id AS VARCHAR) || '|' || CAST(r AS VARCHAR) || '|order') AS shuffle_key, md5(coalesce(text, '')) AS text_md5
    FROM drawn JOIN {table} USING (doc_id), LATERAL (SELECT unnest(range(0, copies)) AS r) y
    """
