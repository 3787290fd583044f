"""Fitting ordered items into a budget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.operators.running import in_ranges, sum_before
from codeloom.session import written

#: Items of a group that may be folded in one row.
FEW = 2_000


def prefix_packed(items: DataFrame, budget: int, cost: str, order: list[str], *keys: str) -> DataFrame:
    """Items up to the first that does not fit."""
    used = F.sum(cost).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return items.withColumn("used", used).where(F.col("used") <= budget)


def folded(items: DataFrame, order: list[str], keys: list[str]) -> DataFrame:
    """(keys, order, placed) of groups with few items (cost, room: what is left for the group), folded in order in one row each."""
    rows = items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, "cost"))).alias("i"), F.first("room").alias("room"))
    kind = items.select(*order).schema.simpleString()[len("struct<") : -1]
    first = F.struct(F.col("room").alias("room"), F.array().cast(f"array<struct<{kind},placed:boolean>>").alias("out"))
    fits = lambda a, x: x["cost"] <= a["room"]
    step = lambda a, x: F.struct(
        F.when(fits(a, x), a["room"] - x["cost"]).otherwise(a["room"]).alias("room"), F.concat(a["out"], F.array(F.struct(*[x[o].alias(o) for o in order], fits(a, x).alias("placed")))).alias("out")
    )
    done = rows.select(*keys, F.explode(F.aggregate("i", first, step, lambda a: a["out"])).alias("o"))
    return done.select(*keys, *[F.col(f"o.{o}").alias(o) for o in order], F.col("o.placed").alias("placed"))


def greedy_packed(items: DataFrame, budget: int, cost: str, order: list[str], *keys: str, few: int = FEW) -> DataFrame:
    """(keys, order, placed): each item in turn is placed if it still fits; later smaller ones may. Costs are whole and not negative; order tells
    a group's items apart.

    Whether an item fits depends on all choices before it, but not one by one. With room r, call items of at most r/2 small. As long as more
    than r/2 is left, every small item fits; so sums of the small ones before each item say which is the first that leaves r/2 or less: a
    small one that uses up the half, or a large one that fits. Up to it all small items are placed and no large one; what is left is at most r/2, items
    behind it that are larger are out, and the next round halves again. A group of any size takes as many rounds as its budget has bits, each over
    ranges of the order. Groups that have at most `few` items left are folded in one row instead."""
    keys = list(keys)
    rows = items.select(*keys, *order, F.col(cost).cast("bigint").alias("cost"))
    left = rows.where(F.col("cost") <= budget).withColumn("room", F.lit(budget).cast("bigint"))
    done = [rows.where((F.col("cost") > budget) | F.col("cost").isNull()).select(*keys, *order, F.lit(False).alias("placed"))]
    spot, small = F.struct(*order), F.col("cost") <= F.floor(F.col("room") / 2)
    while True:
        sizes = left.groupBy(*keys).agg(F.count("*").alias("n"))
        most = sizes.agg(F.max("n")).first()[0] or 0
        if most <= few:
            return reduce(DataFrame.union, [*done, folded(left, order, keys)])
        ranged = in_ranges(left, keys, order)
        sums = sum_before(ranged.withColumn("light", F.when(small, F.col("cost")).otherwise(0)), keys, order, "light", "before")
        sums = written(sums.withColumn("after", F.col("before") + F.col("cost")), "sums")
        ends = F.when(small, F.col("after") >= F.col("room") - F.floor(F.col("room") / 2)).otherwise(F.col("after") <= F.col("room"))
        event = sums.where(ends).groupBy(*keys).agg(F.min(F.struct(*order, "after")).alias("e"))
        event = event.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*[F.col(f"e.{o}") for o in order]).alias("_at"), F.col("e.after").alias("_used"))
        told = written(sums.join(event, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left"), "told")
        decided = F.col("_at").isNull() | (spot <= F.col("_at"))
        over = F.col("cost") > F.col("room") - F.col("_used")
        done.append(told.where(decided).select(*keys, *order, (small | F.coalesce(spot == F.col("_at"), F.lit(False))).alias("placed")))
        done.append(told.where(~decided & over).select(*keys, *order, F.lit(False).alias("placed")))
        left = told.where(~decided & ~over).select(*keys, *order, "cost", (F.col("room") - F.col("_used")).alias("room"))


def tail(turns: DataFrame, n: int, order: list[str], *keys: str) -> DataFrame:
    """The last n rows of each group."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order]))
    return turns.withColumn("__n", place).where(F.col("__n") <= n).drop("__n")


def first_of(rows: DataFrame, order: list[str], *keys: str) -> DataFrame:
    """The first row of each group, as removing duplicates in order does."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__n", place).where("__n = 1").drop("__n")
