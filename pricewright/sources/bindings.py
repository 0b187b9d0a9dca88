"""Engine inputs derived from the generated star-schema tables, for Spark and as SQL.

The tables hold no groceries, so two sources are made of the suppliers' parity, products of
part names and brands, observations of order lines, runs of orders and checks of events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import standardize_name

SOURCES = ["src_a", "src_b"]
#: The columns that order observations of one moment; together they are unique.
TIE = ["run_id", "line_number", "source_product_id", "supplier_id", "price"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact rows: one for each order line of a known part. What follows from a part alone, its
    names first of all, is computed once for each part, before the join."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    products = part.select(
        "p_partkey", "p_brand",
        F.concat_ws(" ", "p_name", "p_brand").alias("source_product_name"),
        standardize_name(F.col("p_name")).alias("standardized_product_name"),
        F.col("p_name").alias("canonical_name"),
        F.col("p_type").alias("category_name"),
        F.when(F.col("p_size") % 2 == 0, "kg").otherwise("piece").alias("normalized_unit"),
    )
    source = F.when(F.col("l_suppkey") % 2 == 0, "src_a").otherwise("src_b")
    price = F.col("l_extendedprice").cast("decimal(18,4)")
    quantity = (F.col("l_quantity").cast("int") % 4 + 1).cast("decimal(18,4)")
    rows = line.join(products, line.l_partkey == products.p_partkey)
    rows = rows.where(~((F.col("p_brand") == "Brand#11") & (source == "src_b")) & ~((F.col("p_brand") == "Brand#12") & (source == "src_a")))
    return rows.select(
        F.col("l_orderkey").alias("run_id"),
        F.col("l_linenumber").cast("int").alias("line_number"),
        F.col("l_partkey").alias("source_product_id"),
        F.col("l_suppkey").alias("supplier_id"),
        source.alias("source_name"),
        "source_product_name", "standardized_product_name", "canonical_name", "category_name",
        F.col("p_brand").alias("brand_name"),
        price.alias("price"),
        F.round(F.col("l_extendedprice") * (1 + F.col("l_discount")), 2).cast("decimal(18,4)").alias("regular_price"),
        F.col("l_discount").cast("decimal(18,4)").alias("discount_rate"),
        "normalized_unit",
        quantity.alias("normalized_quantity"),
        F.round(F.col("l_extendedprice") / quantity.cast("double"), 4).cast("decimal(18,4)").alias("price_per_unit"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("observed_at"),
    )


OBSERVATIONS_SQL = """obs AS (
  SELECT l_orderkey AS run_id, CAST(l_linenumber AS INTEGER) AS line_number, l_partkey AS source_product_id, l_suppkey AS supplier_id,
    CASE WHEN l_suppkey % 2 = 0 THEN 'src_a' ELSE 'src_b' END AS source_name,
    p_name || ' ' || p_brand AS source_product_name,
    array_to_string(list_sort(string_split(lower(p_name), ' ')), ' ') AS standardized_product_name,
    p_name AS canonical_name, p_type AS category_name, p_brand AS brand_name,
    CAST(l_extendedprice AS DECIMAL(18,4)) AS price,
    CAST(round(l_extendedprice * (1 + l_discount), 2) AS DECIMAL(18,4)) AS regular_price,
    CAST(l_discount AS DECIMAL(18,4)) AS discount_rate,
    CASE WHEN p_size % 2 = 0 THEN 'kg' ELSE 'piece' END AS normalized_unit,
    CAST(CAST(l_quantity AS INTEGER) % 4 + 1 AS DECIMAL(18,4)) AS normalized_quantity,
    CAST(round(l_extendedprice / (CAST(l_quantity AS INTEGER) % 4 + 1), 4) AS DECIMAL(18,4)) AS price_per_unit,
    l_shipdate AS observed_at
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  WHERE NOT (p_brand = 'Brand#11' AND l_suppkey % 2 = 1) AND NOT (p_brand = 'Brand#12' AND l_suppkey % 2 = 0)
)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scrape run for each order."""
    orders, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    ends = line.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("finished_at"), F.count(F.lit(1)).alias("records_raw"))
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return orders.join(ends, orders.o_orderkey == ends.l_orderkey, "left").select(
        F.col("o_orderkey").alias("run_id"),
        F.when(F.col("o_custkey") % 2 == 0, "src_a").otherwise("src_b").alias("source_name"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("started_at"),
        F.col("finished_at").cast("timestamp_ntz").alias("finished_at"),
        status.alias("status"),
        F.coalesce("records_raw", F.lit(0)).cast("long").alias("records_raw"),
    )


RUNS_SQL = """runs AS (
  SELECT o_orderkey AS run_id, CASE WHEN o_custkey % 2 = 0 THEN 'src_a' ELSE 'src_b' END AS source_name, o_orderdate AS started_at,
    finished_at, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, coalesce(n, 0) AS records_raw
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS finished_at, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
)"""


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One quality result for each event."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("quality_id"),
        F.col("user_id").alias("run_id"),
        F.col("event_type").alias("check_name"),
        F.when(F.col("event_type") == "error", "fail").otherwise("pass").alias("check_status"),
        F.col("value").alias("observed_value"),
        F.col("props").alias("details"),
        F.col("ts").cast("timestamp_ntz").alias("created_at"),
    )


CHECKS_SQL = """checks AS (
  SELECT event_id AS quality_id, user_id AS run_id, event_type AS check_name,
    CASE WHEN event_type = 'error' THEN 'fail' ELSE 'pass' END AS check_status, value AS observed_value, props AS details, ts AS created_at
  FROM events
)"""
