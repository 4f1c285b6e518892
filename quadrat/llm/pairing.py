"""Pairing blocks of queries with shards of rows, for searches that compare a stated query set with all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def valid_vectors(df: DataFrame, key: str, vector: str, zeros: bool) -> DataFrame:
    """``(vec_id, vec array<double>)`` of the rows whose vector is not null and holds finite numbers only.

    ``zeros``: whether a vector without any component other than zero takes part. Rows with a null id do not. Of rows
    with the same id the smallest vector stands for all, so that a query has one answer.
    """
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = df.select(F.col(key).cast("long").alias("vec_id"), values.alias("vec")).where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull())
    rows = rows.where(F.forall("vec", finite))
    if not zeros:
        rows = rows.where(F.exists("vec", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def search_pairs(queries: DataFrame, shards: DataFrame, shard_count: int, block_count: int, search: Callable, schema: str) -> DataFrame:
    """``search(queries, shard) -> table`` for every block of queries with every shard.

    ``queries`` has ``block``, ``shards`` has ``shard``; both are sent to the pairs (block, shard) that they take part
    in, and each pair is one group. A group holds one block and one shard, whose sizes the caller bounds.
    """
    q = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shard_count - 1))))
    s = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(block_count - 1))))
    return q.groupBy("block", "shard").cogroup(s.groupBy("block", "shard")).applyInArrow(search, schema)


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` highest scores of each query, ties to the smaller id, numbered from 1. Spark keeps ``k`` rows of a
    query before it shuffles them."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
