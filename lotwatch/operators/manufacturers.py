"""Manufacturer names: overrides, exact and similarity joins, reconciliation, clustering, merging.

manufacturers: id, canonical_name, aliases (array), countries (array), confidence, ordinal (order of entry).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime
from functools import reduce
from itertools import takewhile
from math import comb

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_name
from ..storage import release, written
from .graph import components
from .signals import resolve_for_merge, stable_id

THRESHOLD = 92.0
#: Scores from which on pairs are looked for first, where the best match is asked for.
LEVELS = (92.0,)


def distinct_names(docs: DataFrame) -> DataFrame:
    """(raw): every name of the documents once, blanks left out."""
    return docs.select(F.explode("manufacturers").alias("raw")).where(F.trim("raw") != "").distinct()


def overrides_table(spark: SparkSession, overrides: dict[str, list[str]]) -> DataFrame:
    """(canonical, alias, ordinal): a row for each canonical name itself and each of its aliases."""
    rows = [(c, a, n) for n, (c, aliases) in enumerate(overrides.items()) for a in [c, *aliases]]
    return spark.createDataFrame(rows, "canonical string, alias string, ordinal int")


def match_override(names: DataFrame, overrides: DataFrame) -> DataFrame:
    """(raw, canonical): names equal to an alias, or equal after normalization; the first entry of the file wins."""
    keyed = overrides.withColumn("key", normalize_name(F.col("alias")))
    left = names.select("raw", normalize_name(F.col("raw")).alias("key"))
    hits = left.join(keyed.select("key", "canonical", "ordinal"), "key").select("raw", "canonical", "ordinal")
    return hits.groupBy("raw").agg(F.min_by("canonical", "ordinal").alias("canonical"))


def name_keys(manufacturers: DataFrame) -> DataFrame:
    """(key, id, canonical_name): the entry that owns each normalized key. Canonicals beat aliases; the last canonical and the first alias win."""
    own = manufacturers.select("id", "canonical_name", "ordinal", F.col("canonical_name").alias("name"), F.lit(0).alias("is_alias"))
    other = manufacturers.select("id", "canonical_name", "ordinal", F.explode("aliases").alias("name"), F.lit(1).alias("is_alias"))
    rank = F.struct("is_alias", F.when(F.col("is_alias") == 0, -F.col("ordinal")).otherwise(F.col("ordinal")).alias("o"), "id")
    both = own.unionByName(other).withColumn("key", normalize_name(F.col("name")))
    return both.groupBy("key").agg(F.min_by(F.struct("id", "canonical_name"), rank).alias("m")).select("key", "m.id", "m.canonical_name")


def match_exact(names: DataFrame, manufacturers: DataFrame) -> DataFrame:
    """(raw, id, canonical_name) of names whose key is known."""
    return names.select("raw", normalize_name(F.col("raw")).alias("key")).join(name_keys(manufacturers), "key").select("raw", "id", "canonical_name")


def _common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows: one machine-word operation for each character of b."""
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & place.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """Similarity from 0 to 100: twice the common subsequence over both lengths."""
    return 200.0 * _common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set_ratio(a: str, b: str) -> float:
    """The published token-set similarity: shared words compared with shared words plus each rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_a, only_b = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_a or not only_b):
        return 100.0
    left, right = f"{both} {only_a}".strip(), f"{both} {only_b}".strip()
    best = indel_ratio(left, right)
    return max(best, indel_ratio(both, left), indel_ratio(both, right)) if both else best


def _scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        frame["score"] = [token_set_ratio(a, b) for a, b in zip(frame["a"], frame["b"])]
        yield frame


def _words(keys: DataFrame, key: str) -> DataFrame:
    return keys.select(key, F.explode(F.array_distinct(F.split(key, " "))).alias("block"))


def _gram_list(key: str) -> Column:
    """Character pairs of each word with marked ends: they don't depend on the words' order."""
    ends = F.transform(F.split(key, " "), lambda w: F.concat(F.lit("^"), w, F.lit("$")))
    return F.array_distinct(F.flatten(F.transform(ends, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2))))))


def _grams(keys: DataFrame, key: str, *more: str) -> DataFrame:
    return keys.select(key, *more, F.explode(_gram_list(key)).alias("block"))


def _rarest(rows: DataFrame, counts: DataFrame, key: str, kept: str) -> DataFrame:
    """The first blocks of each key in the order of their frequency, as far as ``kept`` says."""
    ranked = rows.join(counts.hint("merge"), "block").selectExpr("*", f"{kept.format(order=f'partition by {key} order by n, block')} as _kept")
    return ranked.where("_kept").drop("n", "_kept")


def rare_words(key: str, threshold: float) -> str:
    """A condition over a window ({order}): a key's rarest words up to the first whose rarer ones are longer than what a similar key may miss."""
    share = (100 - threshold) / 100
    return f"coalesce(sum(length(block)) over ({{order}} rows between unbounded preceding and 1 preceding), 0) <= length({key}) * {2 * share / (1 + share)!r}D + 1e-6D"


def _missing_grams(key: str, threshold: float) -> str:
    """So many of a key's character pairs can be missing in a key whose joined string is similar."""
    share = (100 - threshold) / 100
    return f"2 * floor(length({key}) * {2 * share / (1 - share)!r}D + 1e-6D)"


def rare_grams(key: str, threshold: float) -> str:
    """A condition over a window ({order}): a key's rarest character pairs, one more than can be missing."""
    return f"row_number() over ({{order}}) <= {_missing_grams(key, threshold)} + 1"


def marked(keys: DataFrame, key: str, threshold: float) -> DataFrame:
    """``keys`` with what :func:`grams_can_meet` compares: 64 bits, those of the hashes of a key's character pairs, and the length of its distinct words; and whether it has few variants."""
    bit = lambda g: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(g), F.lit(64)).cast("int"))
    mask = F.aggregate(_gram_list(key), F.lit(0).cast("long"), lambda bits, g: bits.bitwiseOR(bit(g)))
    return keys.withColumns({f"{key}_mask": mask, f"{key}_line": F.length(F.array_join(distinct_words(key), " ")), f"{key}_few": few_variants(key, threshold)})


def grams_can_meet(threshold: float):
    """Marks of a and b at which joined strings may still be similar; repeated words don't count.

    Lengths and the share of edits bound how many characters go and come. One that goes takes two character pairs
    with it at most, one that comes takes one; a bit that one side lacks is a pair that it misses.
    """
    share = (100 - threshold) / 100
    gone = f"floor((floor((a_line + b_line) * {share!r}D + 1e-6D) + a_line - b_line) / 2)"
    come = f"({gone} - a_line + b_line)"
    return F.expr(f"{gone} >= 0 and {come} >= 0 and bit_count(a_mask & ~b_mask) <= 2 * {gone} + {come} and bit_count(b_mask & ~a_mask) <= 2 * {come} + {gone}")


#: Keys of up to so many variants meet through these.
VARIANTS = 5000
#: Variants that a task gives back at once.
VARIANT_ROWS = 20_000


def distinct_words(key: str) -> Column:
    return F.array_remove(F.array_distinct(F.split(key, " ")), "")


def few_variants(key: str, threshold: float) -> Column:
    """Whether a key has at most VARIANTS variants, whatever keys it meets: known by its length and the number of its words."""
    share = (100 - threshold) / 100
    cuts = lambda n: sum(comb(n, gone) for gone in range(int(n * 2 * share / (1 + share) + 1e-6) + 1))
    most = {n: (VARIANTS // cuts(n) + 1).bit_length() - 1 for n in takewhile(lambda n: cuts(n) <= VARIANTS, range(1, 257))}
    table = F.create_map(*[F.lit(x) for kv in most.items() for x in kv])
    return F.size(distinct_words(key)) <= F.coalesce(F.try_element_at(table, F.length(F.array_join(distinct_words(key), " "))), F.lit(0))


def left_over(n: int, m: int, threshold: float) -> int | None:
    """Characters that joined strings of n and m have in common, in order, where they are similar; None where none are, and where only equal ones are."""
    edits = int((n + m) * (100 - threshold) / 100 + 1e-6)
    gone = (edits + n - m) // 2
    return n - gone if edits >= abs(n - m) and (gone or n != m) else None


def _cut(text: str, gone: int) -> set[str]:
    """What is left of a text when so many of its characters go."""
    found = {text if gone < len(text) else ""}
    for _ in range(gone if gone < len(text) else 0):
        found = {s[:i] + s[i + 1 :] for s in found for i in range(len(s))}
    return found


def variants(keys: DataFrame, key: str, kept: dict[int, list[int]]) -> DataFrame:
    """(key, {key}_line, shared, kept, block) of each variant: some words as they are (``shared`` many), and what is left of the others, joined in order.

    ``kept`` says, for the length of a key's joined words, to which lengths it is cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text in batch[0].to_pylist():
                words = sorted({w for w in text.split(" ") if w})
                n = len(" ".join(words))
                for chosen in range((1 << len(words)) - 1 if n in kept else 0):
                    whole = [w for i, w in enumerate(words) if chosen >> i & 1]
                    rest = " ".join(w for i, w in enumerate(words) if not chosen >> i & 1)
                    for most in kept[n]:
                        rows += [(text, n, len(whole), most, f"{' '.join(whole)}\t{s}") for s in _cut(rest, n - most)]
                if len(rows) >= VARIANT_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    schema = pa.schema([(key, pa.string()), (f"{key}_line", pa.int32()), ("shared", pa.int32()), ("kept", pa.int32()), ("variant", pa.string())])
    found = keys.select(key).mapInArrow(run, f"{key} string, {key}_line int, shared int, kept int, variant string")
    return found.select(key, f"{key}_line", F.struct("shared", "kept", F.xxhash64("variant").alias("hash")).alias("block"))


def variant_pairs(x: DataFrame, y: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the keys with few variants whose joined strings are similar, but for equal ones, which have the same words.

    Similar strings keep a string in common when as many characters go from each as their lengths allow. Shared words stand
    first in both and lose none; which words are shared isn't known of one key alone, so every choice of words is a variant.
    A pair comes of its own choice only: nearly every row is a similar pair, however many names differ by single characters.
    """
    lengths = lambda df, key: [r[0] for r in df.where(f"{key}_few").select(f"{key}_line").distinct().collect()]  # noqa: E731  no more than a key has characters
    ns, ms = lengths(x, "a"), lengths(y, "b")
    kept = {(n, m): k for n in ns for m in ms if (k := left_over(n, m, threshold)) is not None}
    if not kept:
        return x.select("a").limit(0).crossJoin(y.select("b").limit(0))
    of = lambda at: {n: sorted({k for nm, k in kept.items() if nm[at] == n}) for n in {nm[at] for nm in kept}}
    met = variants(x.where("a_few"), "a", of(0)).join(variants(y.where("b_few"), "b", of(1)).hint("merge"), "block")
    share = (100 - threshold) / 100
    gone = F.expr(f"floor((floor((a_line + b_line) * {share!r}D + 1e-6D) + a_line - b_line) / 2)")
    own = F.size(F.array_intersect(distinct_words("a"), distinct_words("b"))) == F.col("block.shared")
    return met.where((F.col("a_line") - gone == F.col("block.kept")) & own).select("a", "b")


def long_sides(x: DataFrame, y: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """The pairs of sides that :func:`variant_pairs` leaves out, each pair of keys once: those with a key of many variants."""
    sides = []
    if not x.where("not a_few").isEmpty():
        sides.append((x.where("not a_few"), y))
    if not y.where("not b_few").isEmpty():
        sides.append((x.where("a_few"), y.where("not b_few")))
    return sides


#: Tasks that share a block of one side.
SLOTS = 16


def dealt(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows of both sides that share a block. A frequent block's rows on the left are dealt to SLOTS tasks, those on the right go to all of them."""
    tasks = max(4 * left.sparkSession.sparkContext.defaultParallelism, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    given = left.withColumn("slot", F.pmod(F.xxhash64("a"), F.lit(SLOTS)).cast("int")).repartition(tasks, "block", "slot")
    return given.join(right.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1)))).hint("merge"), ["block", "slot"])


#: Kinds of keys (sorted letters, without digits) are compared with each other if there are at most so many pairs of them.
KINDS = 1_000_000


def letters(key: str) -> Column:
    """The sorted characters of a key's distinct words, digits aside."""
    words = F.array_join(F.array_distinct(F.split(key, " ")), "")
    return F.array_join(F.array_sort(F.split(F.regexp_replace(words, "[0-9]", ""), "")), "")


def comparable(a: DataFrame, b: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The keys (columns a; b) whose joined strings can be similar to one of the other side by their letters alone.

    An edit changes one character, so the letters of similar strings differ by no more. Where a side has many
    kinds of letters (their pairs are counted first) all keys stay: this only spares work.
    """
    kinds = lambda df, key: df.groupBy(letters(key).alias(f"{key}_kind")).agg(F.max(F.length(key)).alias(f"{key}_length"))
    x, y = written(kinds(a, "a"), "kinds"), written(kinds(b, "b"), "kinds")
    if x.count() * y.count() > KINDS:
        return a, b
    told = lambda c: F.transform(F.split(c, ""), lambda v, i: F.concat(v, (i - F.array_position(F.split(c, ""), v)).cast("string")))  # noqa: E731  equal letters told apart
    apart = F.size(F.array_except(told("a_kind"), told("b_kind"))) + F.size(F.array_except(told("b_kind"), told("a_kind")))
    near = written(x.crossJoin(y).where(apart <= (F.col("a_length") + F.col("b_length")) * F.lit((100 - threshold) / 100) + 1e-6), "near-kinds")
    kept = lambda df, key: df.withColumn(f"{key}_kind", letters(key)).join(near.select(f"{key}_kind").distinct(), f"{key}_kind", "left_semi").drop(f"{key}_kind")
    return kept(a, "a"), kept(b, "b")


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, score) of normalized keys (columns a and b) with a score of at least ``threshold``.

    Candidates are found through rare blocks only, and none is lost. A pair scores in one of two ways.
    Its joined strings differ by at most a share of their length: then short ones have a variant in common
    (:func:`variant_pairs`), and of longer ones so few character pairs differ that the rarest ones of both
    sides, in one order, must meet. Or one side's shared words make up nearly all of it: then one of its
    rarest words is the other's. No side is sent to all tasks.
    """
    # Distinct keys are read many times below.
    a, b = written(left.select("a").where("a != ''").distinct(), "keys"), written(right.select("b").where("b != ''").distinct(), "keys")
    all_keys = lambda x, y: x.select(F.col("a").alias("k")).union(y.select("b")).distinct()
    words = _words(all_keys(a, b), "k").groupBy("block").agg(F.count("*").alias("n"))
    x, y = comparable(a, b, threshold)
    x, y = written(marked(x, "a", threshold), "gram-keys"), written(marked(y, "b", threshold), "gram-keys")
    few, edits = (lambda k: rare_words(k, threshold)), (lambda k: rare_grams(k, threshold))
    found = [
        _rarest(_words(a, "a"), words, "a", few("a")).join(_words(b, "b").hint("merge"), "block"), _words(a, "a").join(_rarest(_words(b, "b"), words, "b", few("b")).hint("merge"), "block"),
        variant_pairs(x, y, threshold),
    ]
    if with_long := long_sides(x, y):
        grams = _grams(all_keys(x, y), "k").groupBy("block").agg(F.count("*").alias("n"))
        rarest = lambda df, key: _rarest(_grams(df, key, f"{key}_mask", f"{key}_line"), grams, key, edits(key))
        found += [dealt(rarest(left, "a"), rarest(right, "b")).where(grams_can_meet(threshold)) for left, right in with_long]
    return scored_pairs(reduce(DataFrame.union, [f.select("a", "b") for f in found]).distinct(), threshold)


def scored_pairs(candidates: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score) of the candidates that reach the threshold; most that don't are dropped by built-in functions."""
    return candidates.where(may_reach(threshold)).mapInPandas(_scored, "a string, b string, score double").where(F.col("score") >= threshold)


def may_reach(threshold: float):
    """A test with built-in functions that no pair (a, b) at the threshold fails: the edit distance never exceeds the indel distance."""
    words = lambda c: F.array_sort(F.array_distinct(F.split(c, " ")))
    line = lambda *arrays: F.array_join(F.concat(*arrays), " ")
    both, only_a, only_b = F.array_intersect(words("a"), words("b")), F.array_except(words("a"), words("b")), F.array_except(words("b"), words("a"))
    left, right, shared = line(both, only_a), line(both, only_b), F.length(line(both))
    allowed = lambda n: n * F.lit((100 - threshold) / 100) + 1e-6
    part = lambda other: (F.size(both) > 0) & (F.length(other) - shared <= allowed(F.length(other) + shared))
    return part(left) | part(right) | (F.levenshtein(left, right) <= allowed(F.length(left) + F.length(right)))


def match_fuzzy(names: DataFrame, manufacturers: DataFrame, threshold: float = THRESHOLD, pairs: Callable[..., DataFrame] = similar_pairs) -> DataFrame:
    """(raw, id, canonical_name, score): the most similar canonical name, ties to the first entered. Distinct keys are scored, not names.

    ``pairs`` finds the similar keys: ``functools.partial(nameindex.kept_pairs, root=...)`` joins only those that are new.
    """
    left = names.select("raw", normalize_name(F.col("raw")).alias("a"))
    right = manufacturers.select("id", "canonical_name", "ordinal", normalize_name(F.col("canonical_name")).alias("b"))
    # A key that has a match at a higher level needs no pairs below it.
    levels = [*(x for x in LEVELS if x > threshold), threshold] if pairs is similar_pairs else [threshold]
    best, open_ = None, left
    for level in levels:
        scored = pairs(open_, right, level).join(right, "b")
        found = scored.groupBy("a").agg(F.min_by(F.struct("id", "canonical_name", "score"), F.struct(-F.col("score"), "ordinal", "id")).alias("m"))
        found = written(found, "best-matches") if len(levels) > 1 else found
        best = found if best is None else best.unionByName(found)
        open_ = open_.join(found.select("a"), "a", "left_anti")
    return left.join(best, "a").select("raw", "m.id", "m.canonical_name", "m.score")


def resolve_names(names: DataFrame, manufacturers: DataFrame, overrides: DataFrame, threshold: float = THRESHOLD, review_band: tuple[float, float] | None = None, pairs: Callable[..., DataFrame] = similar_pairs) -> DataFrame:
    """(raw, action, canonical, manufacturer_id, confidence) of each name: override, exact, fuzzy, review or new.

    Of new names with one key the first in order names the group, and the others are exact matches of it.
    """
    names = names.select("raw").distinct()
    by_override = match_override(names, overrides).select("raw", F.col("canonical").alias("o_canonical"))
    by_key = match_exact(names, manufacturers).select("raw", F.col("id").alias("e_id"), F.col("canonical_name").alias("e_canonical"))
    first = written(names.join(by_override, "raw", "left").join(by_key, "raw", "left"), "names-by-key")
    open_ = first.where("o_canonical is null and e_id is null").select("raw")
    low = min(threshold, review_band[0]) if review_band else threshold
    fuzzy = match_fuzzy(open_, manufacturers, low, pairs).select("raw", F.col("id").alias("f_id"), F.col("canonical_name").alias("f_canonical"), "score")
    known = manufacturers.groupBy(F.col("canonical_name").alias("o_canonical")).agg(F.min("id").alias("o_id"))
    found = first.join(fuzzy, "raw", "left").join(known, "o_canonical", "left").withColumn("key", normalize_name(F.col("raw")))
    kind = (
        F.when(F.col("o_canonical").isNotNull(), "override").when(F.col("e_id").isNotNull(), "exact").when(F.col("score") >= threshold, "fuzzy")
        .when(F.col("score").isNotNull(), "review").otherwise("new")
    )
    found = found.withColumn("kind", kind)
    lead = found.where("kind = 'new'").groupBy("key").agg(F.min("raw").alias("lead"))
    found = found.join(lead.hint("merge"), "key", "left")
    is_new = F.col("kind") == "new"
    canonical = F.coalesce("o_canonical", "e_canonical", F.when(F.col("kind").isin("fuzzy", "review"), F.col("f_canonical")), "lead")
    return found.select(
        "raw", F.when(is_new & (F.col("raw") != F.col("lead")), "exact").otherwise(F.col("kind")).alias("action"), canonical.alias("canonical"),
        F.coalesce(F.when(F.col("kind") == "override", F.coalesce("o_id", stable_id(F.col("o_canonical")))), "e_id", F.when(F.col("kind") == "fuzzy", F.col("f_id")), F.when(is_new, stable_id(F.col("lead")))).alias("manufacturer_id"),
        F.when(F.col("kind").isin("fuzzy", "review"), F.col("score") / 100).otherwise(F.lit(1.0)).alias("confidence"),
    )


def reconcile_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("action").agg(F.count("*").alias("n"))


def grown(manufacturers: DataFrame, results: DataFrame) -> DataFrame:
    """The dimension after a reconciliation: names that were met become aliases, new groups become entries after the old ones."""
    met = results.where("manufacturer_id is not null and action != 'review'").groupBy("manufacturer_id").agg(F.min("canonical").alias("canonical"), F.sort_array(F.collect_set("raw")).alias("raws"))
    joined = manufacturers.join(met, manufacturers.id == met.manufacturer_id, "full_outer")
    name = F.coalesce("canonical_name", "canonical")
    none = F.array().cast("array<string>")
    aliases = F.filter(F.array_distinct(F.concat(F.coalesce("aliases", none), F.coalesce("raws", none))), lambda x: x != name)
    return joined.select(F.coalesce("id", "manufacturer_id").alias("id"), name.alias("canonical_name"), aliases.alias("aliases"), F.coalesce("countries", none).alias("countries"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("ordinal", F.lit(2**31 - 1)).cast("int").alias("ordinal"))


def linked(docs: DataFrame, results: DataFrame) -> DataFrame:
    """Documents with their manufacturers' ids in document order, each once; names in review are left out."""
    names = docs.select("id", F.posexplode("manufacturers").alias("pos", "raw")).join(results.where("action != 'review'").select("raw", "manufacturer_id"), "raw")
    ids = names.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "manufacturer_id"))).alias("x")).select("id", F.array_distinct(F.col("x.manufacturer_id")).alias("new_ids"))
    return docs.join(ids, "id", "left").withColumn("canonical_manufacturer_ids", F.coalesce("new_ids", F.array().cast("array<string>"))).drop("new_ids")


def fully_displaced(before: DataFrame, after: DataFrame) -> DataFrame:
    """(manufacturer_id): lost a document and has none left."""
    pairs = lambda d: d.select("id", F.explode("canonical_manufacturer_ids").alias("manufacturer_id"))
    lost = pairs(before).join(pairs(after), ["id", "manufacturer_id"], "left_anti").select("manufacturer_id").distinct()
    return lost.join(pairs(after).select("manufacturer_id").distinct(), "manufacturer_id", "left_anti")


def reconcile(docs: DataFrame, manufacturers: DataFrame, overrides: DataFrame, signals: DataFrame | None = None, now: datetime | None = None, threshold: float = THRESHOLD, pairs: Callable[..., DataFrame] = similar_pairs) -> dict[str, DataFrame]:
    """All results of a reconciliation: results, manufacturers, documents, and signals and events where signals are given."""
    results = resolve_names(distinct_names(docs), manufacturers, overrides, threshold, pairs=pairs)
    out = {"results": results, "manufacturers": grown(manufacturers, results), "documents": linked(docs, results)}
    if signals is not None:
        out["signals"], out["events"] = resolve_for_merge(signals, fully_displaced(docs, out["documents"]), now)
    return out


def repoint(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Merged ids (source) replaced by the survivors (target), order kept, repeats dropped. Only affected documents are rebuilt."""
    moved = docs.select("id", F.posexplode("canonical_manufacturer_ids").alias("pos", "source")).join(pairs.select("source", "target"), "source", "left")
    ids = moved.groupBy("id").agg(F.max(F.col("target").isNotNull()).alias("hit"), F.array_sort(F.collect_list(F.struct("pos", F.coalesce("target", "source").alias("m")))).alias("x")).where("hit")
    return docs.join(ids.select("id", F.array_distinct(F.col("x.m")).alias("new_ids")), "id", "left").withColumn("canonical_manufacturer_ids", F.coalesce("new_ids", "canonical_manufacturer_ids")).drop("new_ids")


def survivors(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((source, target), errors): each source with the manufacturer that is left in the end.

    Chains are followed by doubling: each round joins a target with its own, so rounds grow with the
    logarithm of the longest chain. A source goes to its least target; other targets, a pair of one
    id, and pairs that run into a cycle are errors (with ``fault``).
    """
    ranked = pairs.select("source", "target").distinct().withColumn("nth", F.expr("row_number() over (partition by source order by target)"))
    asked = written(ranked.where("source != target"), "merge-pairs")
    one = asked.groupBy("source").agg(F.min("target").alias("target"))
    state = written(one.withColumn("root", F.col("target")), "merge-roots")
    rounds = max(1, state.count().bit_length())
    for _ in range(rounds):
        above = state.select(F.col("source").alias("root"), F.col("root").alias("higher"))
        older, state = state, written(state.join(above, "root", "left").select("source", "target", F.coalesce("higher", "root").alias("root")), "merge-roots")
        release(older)
    open_ = state.join(state.select(F.col("source").alias("root")), "root", "left_semi").select("source", "target", F.lit("cycle").alias("fault"))
    good = state.join(open_.select("source"), "source", "left_anti").select("source", F.col("root").alias("target"))
    errors = ranked.where("source = target").select("source", "target", F.lit("same").alias("fault"))
    second = asked.join(one, ["source", "target"], "left_anti").select("source", "target", F.lit("second target").alias("fault"))
    return good, errors.unionByName(open_).unionByName(second)


def merge(manufacturers: DataFrame, docs: DataFrame, signals: DataFrame, pairs: DataFrame, now: datetime) -> dict[str, DataFrame]:
    """Fold each source into the manufacturer that is left of its chain of targets: aliases, documents, signals.

    Pairs with an unknown id come back as ``errors``, as do pairs of one id, cycles and second targets.
    """
    ids = manufacturers.select("id")
    known = pairs.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    good, faults = survivors(known)
    good = written(good, "merged")
    given = good.join(manufacturers.select(F.col("id").alias("source"), "canonical_name", "aliases"), "source")
    names = given.groupBy("target").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("source", F.concat(F.array("canonical_name"), "aliases").alias("n")))), lambda x: x["n"])).alias("more"))
    kept = manufacturers.join(good.select(F.col("source").alias("id")), "id", "left_anti").join(names, F.col("id") == F.col("target"), "left")
    aliases = F.filter(F.array_distinct(F.concat("aliases", F.coalesce("more", F.array().cast("array<string>")))), lambda x: x != F.col("canonical_name"))
    out_signals, events = resolve_for_merge(signals, good.select(F.col("source").alias("manufacturer_id")), now, "merge")
    errors = pairs.select("source", "target").join(known, ["source", "target"], "left_anti").withColumn("fault", F.lit("unknown")).unionByName(faults)
    return {"manufacturers": kept.withColumn("aliases", aliases).drop("target", "more"), "documents": repoint(docs, good), "signals": out_signals, "events": events, "errors": errors}


#: A component of similar keys with at most so many pairs is decided by one task; larger ones in rounds of joins.
SETTLED_PAIRS = 200_000


def _settle(frame: pd.DataFrame) -> pd.DataFrame:
    """(b_at, founds) of one component (at, b_at): in order, a key founds unless an earlier similar one does."""
    before: dict[int, list[int]] = {}
    for at, b_at in zip(frame["at"].tolist(), frame["b_at"].tolist()):
        before.setdefault(at, []).append(b_at)
    founds: dict[int, bool] = {}
    for at in sorted(before.keys() | {b for bs in before.values() for b in bs}):
        founds[at] = not any(founds[b] for b in before.get(at, ()))
    return pd.DataFrame({"b_at": list(founds), "founds": list(founds.values())})


def _founding(nodes: DataFrame, edges: DataFrame, settled_pairs: int = SETTLED_PAIRS) -> DataFrame:
    """(at) of the nodes (at, fixed) that are canonicals: the fixed ones, and each other one with no edge (at, b_at) to an earlier canonical.

    Keys that a fixed one takes in are done at once. What is left falls into connected components, which
    don't wait for each other: each of up to ``settled_pairs`` pairs is decided inside one task. Only
    larger ones go in rounds, each round deciding at least the earliest open key.
    """
    fixed, open_ = nodes.where("fixed").select("at"), nodes.where("not fixed").select("at")
    taken = written(edges.join(fixed.select(F.col("at").alias("b_at")), "b_at", "left_semi").select("at").distinct(), "cluster-taken")
    links = edges.join(taken, "at", "left_anti").join(taken.select(F.col("at").alias("b_at")), "b_at", "left_anti")
    links = written(links.select(F.col("at").cast("long").alias("at"), F.col("b_at").cast("long").alias("b_at")), "cluster-links")
    lone = written(open_.join(taken, "at", "left_anti").join(links.select("at").union(links.select("b_at")).distinct(), "at", "left_anti"), "cluster-lone")
    parts = components(links.select(F.col("at").alias("a"), F.col("b_at").alias("b")))
    rooted = written(links.join(parts.select(F.col("node").alias("at"), "root"), "at"), "cluster-rooted")
    release(taken, links, parts)
    sizes = rooted.groupBy("root").agg(F.count("*").alias("n"))
    wide = written(sizes.where(F.col("n") > settled_pairs).select("root"), "cluster-wide")
    small = rooted.join(wide, "root", "left_anti").groupBy("root").applyInPandas(_settle, "b_at long, founds boolean")
    decided = written(small, "cluster-decided")
    rest = written(rooted.join(wide, "root", "left_semi").select("at", "b_at"), "cluster-rest")
    release(rooted, wide)
    waiting = written(rest.select("at").union(rest.select("b_at")).distinct(), "cluster-open")
    while not waiting.isEmpty():
        found = rest.join(waiting, "at", "left_semi").join(decided, "b_at", "left").groupBy("at").agg(F.max(F.coalesce("founds", F.lit(False))).alias("taken"), F.max(F.col("founds").isNull()).alias("waits"))
        ready = waiting.join(found, "at", "left").where("coalesce(taken, false) or not coalesce(waits, false)")
        step = written(ready.select(F.col("at").alias("b_at"), (~F.coalesce("taken", F.lit(False))).alias("founds")), "cluster-step")
        older = decided, waiting, step
        decided = written(decided.unionByName(step), "cluster-decided")
        waiting = written(waiting.join(step.select(F.col("b_at").alias("at")), "at", "left_anti"), "cluster-open")
        release(*older)
    return fixed.union(lone).union(decided.where("founds").select("b_at"))


def cluster_names(names: DataFrame, overrides: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(raw, canonical): names (raw, ordinal, both distinct) matched against those before them, without a dimension.

    In input order a name takes its override's canonical, else the first earlier canonical of equal
    key, else the most similar earlier canonical (ties to the earlier), else founds one. A key founds
    at its first name or never, as canonicals only grow; so keys are decided first, each by whether an
    earlier similar key founds (:func:`_founding`). Every name then takes the best of the canonicals
    before it.
    """
    over = match_override(names, overrides).withColumnsRenamed({"canonical": "override"})
    rows = written(names.join(over, "raw", "left").withColumns({"key": normalize_name(F.col("raw")), "override_key": normalize_name(F.col("override"))}), "cluster-names")
    # What can be a canonical: an override from its first use on, and a key from its first name without override on. ``at`` names it.
    fixed = rows.where("override is not null").groupBy(F.col("override").alias("title"), F.col("override_key").alias("key")).agg(F.min("ordinal").alias("at"))
    own = rows.where("override is null").groupBy("key").agg(F.min_by("raw", "ordinal").alias("title"), F.min("ordinal").alias("at"))
    nodes = written(own.select("key", "at", "title", F.lit(False).alias("fixed")).unionByName(fixed.select("key", "at", "title", F.lit(True).alias("fixed"))), "cluster-nodes")
    keys = nodes.select("key").distinct()
    pairs = similar_pairs(keys.withColumnRenamed("key", "a"), keys.withColumnRenamed("key", "b"), threshold).where("a != b")
    pairs = written(pairs.unionByName(keys.select(F.col("key").alias("a"), F.col("key").alias("b"), F.lit(1000.0).alias("score"))), "cluster-pairs")  # an equal key goes before similar ones
    ahead = nodes.select(F.col("key").alias("b"), F.col("at").alias("b_at"))
    edges = nodes.where("not fixed").select(F.col("key").alias("a"), "at").join(pairs, "a").join(ahead, "b").where("b_at < at")
    founding = _founding(nodes, written(edges.select("at", "b_at"), "cluster-edges"))
    canonical = nodes.join(founding, "at", "left_semi").select(F.col("key").alias("b"), "at", "title")
    open_ = rows.where("override is null").select("raw", "ordinal", F.col("key").alias("a"))
    met = open_.join(pairs, "a").join(canonical, "b").where("at <= ordinal")
    best = met.groupBy("raw").agg(F.min_by("title", F.struct(-F.col("score"), "at")).alias("title"))
    return rows.join(best, "raw", "left").select("raw", F.coalesce("override", "title").alias("canonical"))
