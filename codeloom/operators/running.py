"""Sums over an order that no single task holds: rows are dealt to ranges of the order, and only the ranges' totals meet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.session import written


def in_ranges(rows: DataFrame, keys: list[str], order: list[str], bucket: str = "bucket") -> DataFrame:
    """rows as a written table with bucket: a number that ascends with (keys, order). A large group lies in many buckets."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(n, *keys, *order).withColumn(bucket, F.spark_partition_id()), "ranges")


def sum_before(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str, bucket: str = "bucket") -> DataFrame:
    """rows of `in_ranges` with out: the sum of value over a group's earlier rows. Nulls in keys are a group."""
    inner = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a group
    totals = rows.groupBy(*keys, bucket).agg(F.sum(value).alias("_t"))
    totals = totals.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(bucket).alias("_b"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    same = [F.col(bucket) == F.col("_b"), *[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]]
    own = rows.withColumn(out, F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return own.join(totals, same).withColumn(out, F.col(out) + F.col("_base")).drop("_b", "_base", *[f"_{k}" for k in keys])
