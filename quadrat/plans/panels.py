"""Regional panels derived from the star-schema tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("district"), "n_regionkey")
    return nation.join(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("state")), "n_regionkey").drop("n_regionkey")


def enrol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order: three groups by priority."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    v, p = F.floor(F.col("o_totalprice") / 10000).cast("int"), F.substring("o_orderpriority", 1, 1)
    rows = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).join(_places(spark, sf_dir), "n_nationkey")
    group = lambda *ps: F.when(p.isin(*ps), v).otherwise(0)
    return rows.select(
        F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("date"), "state", "district", F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("pincode"),
        group("1", "2").alias("age_0_5"), group("3").alias("age_5_17"), group("4", "5").alias("age_18_greater"),
    )


def bio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items on the customer's side, by day and place: returned and other quantities. Summed by customer and day first: the place
    follows from the customer, and joins the sums. Orders are never sent through the driver, however small their file."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    returned = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("date"), returned.alias("returned"), (F.col("l_quantity") - returned).alias("rest"))
    sums = lines.join(orders.hint("merge"), "l_orderkey").groupBy("c_custkey", "date").agg(F.sum("returned").alias("bio_age_5_17"), F.sum("rest").alias("bio_age_17_"))
    placed = sums.join(customer.join(_places(spark, sf_dir), "n_nationkey"), "c_custkey")
    return placed.select("date", "state", "district", F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("pincode"), "bio_age_5_17", "bio_age_17_")


def demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items on the supplier's side, by day and place: open and other quantities. Summed by supplier and day first."""
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    is_open = F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0.0)
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("date"), is_open.alias("opened"), (F.col("l_quantity") - is_open).alias("rest"))
    sums = lines.groupBy("l_suppkey", "date").agg(F.sum("opened").alias("demo_age_5_17"), F.sum("rest").alias("demo_age_17_"))
    placed = sums.join(supplier.join(_places(spark, sf_dir), "n_nationkey"), "l_suppkey")
    return placed.select("date", "state", "district", F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("pincode"), "demo_age_5_17", "demo_age_17_")


ENROL = """enrol AS (
  SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, r_name AS state, n_name AS district, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS pincode,
    CASE WHEN left(o_orderpriority, 1) IN ('1', '2') THEN v ELSE 0 END AS age_0_5, CASE WHEN left(o_orderpriority, 1) = '3' THEN v ELSE 0 END AS age_5_17,
    CASE WHEN left(o_orderpriority, 1) IN ('4', '5') THEN v ELSE 0 END AS age_18_greater
  FROM (SELECT *, CAST(floor(o_totalprice / 10000) AS INTEGER) AS v FROM orders) o
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
BIO = """bio AS (
  SELECT CAST(l_shipdate AS DATE) AS date, r_name AS state, n_name AS district, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS pincode,
    sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS bio_age_5_17, sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END) AS bio_age_17_
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL)"""
DEMO = """demo AS (
  SELECT CAST(l_shipdate AS DATE) AS date, r_name AS state, n_name AS district, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS pincode,
    sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS demo_age_5_17, sum(CASE WHEN l_linestatus = 'O' THEN 0 ELSE l_quantity END) AS demo_age_17_
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL)"""
PANELS = f"WITH {ENROL}, {BIO}, {DEMO}"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as unit squares of a grid five wide: a vertex table."""
    corner = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)])])
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("region"), F.col("n_nationkey").alias("k"), F.explode(corner).alias("c"))
    return rows.select("region", F.lit(0).alias("part"), F.lit(0).alias("ring"), F.col("c.seq").alias("seq"), (F.col("k") % 5 + F.col("c.dx")).alias("x"), (F.floor(F.col("k") / 5) + F.col("c.dy")).alias("y"))


GRID = "cells AS (SELECT n_name AS region, n_nationkey % 5 + 0.5::DOUBLE AS x, floor(n_nationkey / 5) + 0.5::DOUBLE AS y FROM nation)"
#: Touching cells of the grid, corners included; weight 1.
TOUCH = "touch AS (SELECT a.region AS src, b.region AS dst, 1.0::DOUBLE AS w FROM cells a JOIN cells b ON a.region <> b.region AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1)"
