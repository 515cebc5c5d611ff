"""A kept index for the similarity join of names: only names that are new meet the others.

Layout under a root, ``g`` the number of an extension:

    keys/g=<g>       side (a or b), key: the normalized keys that entered
    order/g=<g>      kind (w: words, c: character pairs), block, n: the place of each block that entered
    postings/g=<g>   side, kind, block, key, rare: every word of a key, and its rarest character pairs
    pairs/g=<g>      a, b, score: the similar pairs that the extension found
    head             JSON: the number of extensions and the threshold

The join is lossless if all keys rank their blocks in one order, whatever order that is. A block's place
is fixed when it enters, by its frequency among the keys that brought it; no earlier key holds it, so the
rarest blocks of earlier keys never change. A block that grows frequent later keeps its place: that costs
candidates, never a pair, and :func:`rebuild` orders anew. An extension becomes visible when the head is
replaced; what a failed attempt left is overwritten by the next. One writer at a time.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import _path, replace_file
from ..storage import release, written
from .manufacturers import THRESHOLD, _grams, _words, comparable, dealt, grams_can_meet, long_sides, marked, rare_grams, rare_words, scored_pairs, variant_pairs

TABLES = {"keys": "side string, key string", "order": "kind string, block string, n long", "postings": "kind string, block string, key string, rare boolean, side string", "pairs": "a string, b string, score double"}


def read_head(spark: SparkSession, root: str) -> dict | None:
    path, fs = _path(spark, f"{root}/head")
    return json.loads(spark.read.text(f"{root}/head", wholetext=True).first()[0]) if fs.exists(path) else None


def _kept(spark: SparkSession, root: str, name: str, extensions: int) -> DataFrame:
    """A table of all extensions, with ``g``."""
    schema = f"{TABLES[name]}, g int"
    paths = [f"{root}/{name}/g={g}" for g in range(1, extensions + 1)]
    return spark.read.schema(schema).option("basePath", f"{root}/{name}").parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_pairs(spark: SparkSession, root: str) -> DataFrame:
    """(a, b, score, g): all similar pairs and the extension that found each."""
    head = read_head(spark, root)
    return _kept(spark, root, "pairs", head["extensions"] if head else 0)


def _met(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs of two sets of postings: a rarest word of one is a word of the other, or short keys share a variant, longer ones a rarest character pair."""
    left, right = a.select(F.col("key").alias("a"), "block", "kind", "rare"), b.select(F.col("key").alias("b"), "block", "kind", F.col("rare").alias("b_rare"))
    of = lambda df, kind: df.where(F.col("kind") == kind)
    x, y = comparable(of(left, "c").select("a").distinct(), of(right, "c").select("b").distinct(), threshold)
    x, y = written(marked(x, "a", threshold), "index-marked"), written(marked(y, "b", threshold), "index-marked")
    found = [
        of(left, "w").where("rare").join(of(right, "w").hint("merge"), "block"), of(left, "w").join(of(right, "w").where("b_rare").hint("merge"), "block"),
        variant_pairs(x, y, threshold),
    ]
    for p, q in long_sides(x, y):
        found.append(dealt(p.join(of(left, "c").hint("merge"), "a"), q.join(of(right, "c").hint("merge"), "b")).where(grams_can_meet(threshold)))
    return reduce(DataFrame.union, [f.select("a", "b") for f in found])


def extend(left: DataFrame, right: DataFrame, root: str, threshold: float = THRESHOLD) -> int:
    """Enter the keys of ``left`` (a) and ``right`` (b) that the index doesn't hold, and return the number of extensions.

    New keys of one side meet all keys of the other; no pair of two known keys is looked at again. Null
    and empty keys are left out, repeated ones are one. Without a new key nothing is written.
    """
    spark = left.sparkSession
    head = read_head(spark, root) or {"extensions": 0, "threshold": threshold}
    if threshold < head["threshold"]:
        raise ValueError(f"the index holds pairs from {head['threshold']} on, not from {threshold}")
    threshold, done = head["threshold"], head["extensions"]
    given = left.select(F.lit("a").alias("side"), F.col("a").alias("key")).union(right.select(F.lit("b"), "b")).where("key != ''").distinct()
    fresh = written(given.join(_kept(spark, root, "keys", done), ["side", "key"], "left_anti"), "index-keys")
    if fresh.isEmpty():
        release(fresh)
        return done
    at = lambda name: f"{root}/{name}/g={done + 1}"
    new = lambda name: spark.read.schema(TABLES[name]).parquet(at(name))
    fresh.write.mode("overwrite").parquet(at("keys"))
    texts = fresh.select("key").distinct()
    blocks = written(_words(texts, "key").withColumn("kind", F.lit("w")).unionByName(_grams(texts, "key").withColumn("kind", F.lit("c"))), "index-blocks")
    counts = blocks.groupBy("kind", "block").agg(F.count("*").alias("n"))
    known = _kept(spark, root, "order", done).select("kind", "block", "n")
    counts.join(known, ["kind", "block"], "left_anti").write.mode("overwrite").parquet(at("order"))
    order = known.unionByName(new("order"))
    ranked = blocks.join(order.hint("merge"), ["kind", "block"])
    rare = F.expr("case kind when 'w' then {} else {} end".format(*(f("key", threshold).format(order="partition by kind, key order by n, block") for f in (rare_words, rare_grams))))
    rows = ranked.select("kind", "block", "key", rare.alias("rare")).where("rare or kind = 'w'").join(fresh.hint("merge"), "key")
    rows.write.mode("overwrite").parquet(at("postings"))
    old, now = _kept(spark, root, "postings", done), new("postings")
    side = lambda df, s: df.select(*now.columns).where(F.col("side") == s)
    candidates = _met(side(now, "a"), side(old.select(*now.columns).unionByName(now), "b"), threshold).union(_met(side(old, "a"), side(now, "b"), threshold))
    scored_pairs(candidates.distinct(), threshold).write.mode("overwrite").parquet(at("pairs"))
    replace_file(spark, f"{root}/head", json.dumps({"extensions": done + 1, "threshold": threshold}))
    release(fresh, blocks)
    return done + 1


def kept_pairs(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD, *, root: str) -> DataFrame:
    """As ``manufacturers.similar_pairs``, through the index at ``root``: it is extended by what is new, then read."""
    extend(left, right, root, threshold)
    found = read_pairs(left.sparkSession, root).where(F.col("score") >= threshold).select("a", "b", "score")
    return found.join(left.select("a").distinct(), "a", "left_semi").join(right.select("b").distinct(), "b", "left_semi")


def rebuild(spark: SparkSession, root: str, target: str) -> int:
    """Enter all keys of the index at ``root`` into a new one at ``target`` in one extension: blocks are ordered by today's frequencies."""
    head = read_head(spark, root)
    keys = _kept(spark, root, "keys", head["extensions"])
    of = lambda s: keys.where(F.col("side") == s).select(F.col("key").alias(s))
    return extend(of("a"), of("b"), target, head["threshold"])
