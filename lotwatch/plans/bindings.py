"""The domain's tables derived from the driver tables, as DataFrames and as DuckDB SQL that states the same rows.

The driver tables hold no recalls, so order lines stand in for them: a supplier is a manufacturer,
a part's name an ingredient, a nation a jurisdiction.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = date(2000, 12, 31)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Order lines with an id of their own: (order, line) isn't unique, so equal lines are numbered.
LINES_SQL = """lines AS (
  SELECT *, CAST(l_shipdate AS DATE) AS shipped,
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'), CAST(l_quantity AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT), CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT), l_returnflag, l_linestatus) AS line_text
  FROM lineitem),
numbered AS (SELECT *, concat_ws('-', line_text, row_number() OVER (PARTITION BY line_text)) AS line_id FROM lines)"""


def lines(spark: SparkSession, sf_dir: str, deal: str = "order_text", parts: int | None = None) -> DataFrame:
    """Order lines with ids.

    They are dealt by the text of their order, which is the address of an observation, or by another column that equal
    lines share: what groups by address, or joins on that column, next needs no other shuffle. Equal lines have one date
    and state, so a filter on these goes below the numbering. ``parts``: into so many parts, whatever their size.
    """
    cents = lambda c: F.round(F.col(c) * 100).cast("long").cast("string")
    text = F.concat_ws(
        "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd"), F.col("l_quantity").cast("long").cast("string"),
        cents("l_extendedprice"), cents("l_discount"), cents("l_tax"), "l_returnflag", "l_linestatus",
    )
    rows = t(spark, sf_dir, "lineitem").withColumns({"shipped": F.to_date("l_shipdate"), "order_text": F.col("l_orderkey").cast("string")}).repartition(*filter(None, (parts, deal)))
    number = F.expr(f"row_number() over (partition by {deal}, line_text, shipped, l_linestatus order by l_orderkey)")
    return rows.withColumn("line_text", text).withColumn("line_id", F.concat_ws("-", "line_text", number.cast("string")))


RECALLS_SQL = (
    LINES_SQL
    + """,
recalls AS (
  SELECT line_id AS id, CAST(l_suppkey AS VARCHAR) AS manufacturer_id, p_name AS ingredient, n_name AS jurisdiction, shipped AS date_published,
    CASE l_returnflag WHEN 'R' THEN 'class_1' WHEN 'A' THEN 'class_2' ELSE 'class_3' END AS severity,
    CASE l_linestatus WHEN 'O' THEN 'recall' ELSE 'guideline' END AS document_type, CAST(l_linenumber AS VARCHAR) AS source_id
  FROM numbered JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
windowed AS (SELECT * FROM recalls WHERE document_type IN ('recall', 'alert', 'enforcement') AND date_published BETWEEN DATE '2000-12-31' - 720 AND DATE '2000-12-31'),
makers AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS canonical_name FROM supplier)"""
)


def recalls(spark: SparkSession, sf_dir: str, ingredient: str = "p_name") -> DataFrame:
    """Recall documents of the schema that the rules take. Lines are dealt by their part, so they meet the parts where they lie."""
    joined = (
        lines(spark, sf_dir, "l_partkey")
        .join(t(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
        .join(t(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
        .join(t(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    )
    return joined.select(
        F.col("line_id").alias("id"), F.array(F.col("l_suppkey").cast("string")).alias("canonical_manufacturer_ids"), F.array(F.expr(ingredient)).alias("active_ingredients"),
        F.col("n_name").alias("jurisdiction"), F.col("shipped").alias("date_published"),
        F.when(F.col("l_returnflag") == "R", "class_1").when(F.col("l_returnflag") == "A", "class_2").otherwise("class_3").alias("severity"),
        F.when(F.col("l_linestatus") == "O", "recall").otherwise("guideline").alias("document_type"), F.col("l_linenumber").cast("string").alias("source_id"),
    )


#: The same recalls with the part's brand as ingredient, which the supply facts have too.
BRAND_RECALLS_SQL = RECALLS_SQL.replace("p_name AS ingredient", "lower(p_brand) AS ingredient")


def brand_recalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recalls(spark, sf_dir, "lower(p_brand)")


def makers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("canonical_name"))


#: Repeat violators, and the procurement tables: a nation is a county, its customers the population, a brand an ingredient.
_VIOLATORS = """,
totals AS (
  SELECT manufacturer_id, CAST(count(*) AS BIGINT) AS recall_count, CAST(sum(CASE severity WHEN 'class_1' THEN 3 WHEN 'class_2' THEN 2 ELSE 1 END) AS BIGINT) AS weighted_score,
    list_sort(list(id)) AS ids FROM windowed GROUP BY 1),
per_ingredient AS (SELECT manufacturer_id, ingredient, count(*) AS n FROM windowed GROUP BY ALL),
tops AS (SELECT manufacturer_id, ingredient FROM per_ingredient QUALIFY row_number() OVER (PARTITION BY manufacturer_id ORDER BY n DESC, ingredient) = 1),
violators AS (
  SELECT manufacturer_id, recall_count, weighted_score, ids, ingredient AS active_ingredient,
    CASE WHEN recall_count >= 6 AND weighted_score >= 12 THEN 'critical' WHEN recall_count >= 4 AND weighted_score >= 8 THEN 'high' WHEN recall_count >= 3 AND weighted_score >= 4 THEN 'medium' END AS severity
  FROM totals JOIN tops USING (manufacturer_id))"""
VIOLATORS_SQL, BRAND_VIOLATORS_SQL = RECALLS_SQL + _VIOLATORS, BRAND_RECALLS_SQL + _VIOLATORS

SUPPLY_SQL = """supply AS (
  SELECT c_nationkey AS county, p_brand AS ingredient, l_suppkey AS supplier, sum(CAST(l_quantity AS BIGINT)) AS quantity, max(l_linenumber * 10) AS lead
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey GROUP BY ALL),
facts AS (
  SELECT concat_ws('/', county, ingredient, supplier) AS id, CAST(county AS VARCHAR) AS county_id, CAST(supplier AS VARCHAR) AS supplier_id, lower(ingredient) AS active_ingredient,
    CAST(floor(10000.0 * quantity / sum(quantity) OVER (PARTITION BY county, ingredient)) / 100 AS DECIMAL(7, 2)) AS share_pct, lead AS lead_time_days FROM supply),
counties AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, CAST((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS BIGINT) AS population FROM nation)"""


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Orders meet their customers first: the lines, which are many more, are dealt by order and by part only.
    placed = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_nationkey")
    joined = t(spark, sf_dir, "lineitem").join(placed, F.col("o_orderkey") == F.col("l_orderkey")).join(t(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    sums = joined.groupBy(F.col("c_nationkey").alias("county"), F.col("p_brand").alias("ingredient"), F.col("l_suppkey").alias("supplier")).agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.max(F.col("l_linenumber") * 10).alias("lead"))
    share = F.floor(F.lit(10000.0) * F.col("quantity") / F.expr("sum(quantity) over (partition by county, ingredient)")) / 100
    return sums.select(
        F.concat_ws("/", "county", "ingredient", "supplier").alias("id"), F.col("county").cast("string").alias("county_id"), F.col("supplier").cast("string").alias("supplier_id"),
        F.lower("ingredient").alias("active_ingredient"), share.cast("decimal(7,2)").alias("share_pct"), F.col("lead").alias("lead_time_days"),
    )


def counties(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = t(spark, sf_dir, "customer").groupBy("c_nationkey").count()
    return t(spark, sf_dir, "nation").join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.coalesce("count", F.lit(0)).alias("population"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_suppkey").cast("string").alias("manufacturer_id"), F.col("s_name").alias("name"))


#: Raw names: suppliers' and customers' names in several written forms.
NAMES_SQL = """raw_names AS (
  SELECT s_suppkey AS n, replace(s_name, '#0000', ' ') || CASE s_suppkey % 4 WHEN 0 THEN ' Ltd' WHEN 1 THEN ' LIMITED' WHEN 2 THEN ' (Pty) Ltd.' ELSE ', S.A.' END AS raw FROM supplier
  UNION ALL SELECT c_custkey, upper(replace(c_name, '#0000', '  ')) || CASE c_custkey % 3 WHEN 0 THEN ' Pharmaceuticals' WHEN 1 THEN ' GmbH' ELSE '' END FROM customer)"""


def raw_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = t(spark, sf_dir, "supplier"), t(spark, sf_dir, "customer")
    end = lambda k, *a: F.element_at(F.array(*map(F.lit, a)), (F.col(k) % len(a) + 1).cast("int"))
    one = s.select(F.col("s_suppkey").alias("n"), F.concat(F.replace("s_name", F.lit("#0000"), F.lit(" ")), end("s_suppkey", " Ltd", " LIMITED", " (Pty) Ltd.", ", S.A.")).alias("raw"))
    two = c.select(F.col("c_custkey").alias("n"), F.concat(F.upper(F.replace("c_name", F.lit("#0000"), F.lit("  "))), end("c_custkey", " Pharmaceuticals", " GmbH", "")).alias("raw"))
    return one.unionByName(two)


def normalized_sql(column: str) -> str:
    """DuckDB SQL of the comparison key of an ASCII name."""
    from ..functions.text import DOTTED_FORMS, LEGAL_SUFFIXES

    text = f"regexp_replace(lower({column}), '\\b({DOTTED_FORMS})\\b\\.?', ' ', 'g')"
    text = f"regexp_replace({text}, '[^\\w\\s]', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({text}, '\\b({LEGAL_SUFFIXES})\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


#: Observations of addresses: (order, line) is the address, the line's price and flags the content.
OBSERVED_SQL = (
    LINES_SQL
    + """,
observed AS (
  SELECT line_id AS id, CAST(l_linenumber AS VARCHAR) AS source_id, CAST(l_orderkey AS VARCHAR) AS source_url, md5(concat_ws('|', l_returnflag, l_linestatus)) AS normalized_hash,
    line_text AS raw_text, shipped AS created_at FROM numbered)"""
)


def observed(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Order lines as observations; the order of an address is by date and id."""
    return lines(spark, sf_dir, parts=parts).select(
        F.col("line_id").alias("id"), F.col("l_linenumber").cast("string").alias("source_id"), F.col("order_text").alias("source_url"),
        F.md5(F.concat_ws("|", "l_returnflag", "l_linestatus").cast("binary")).alias("normalized_hash"), F.col("line_text").alias("raw_text"), F.col("shipped").alias("created_at"),
    )
