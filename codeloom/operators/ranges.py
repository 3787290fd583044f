"""Closed line ranges: merging, subtracting, containment and overlap.

All joins have an equality on the owner of the ranges (a file), so none is a cross join; within one owner,
merging and gaps are windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merged(ranges: DataFrame, *keys: str) -> DataFrame:
    """(keys, start, end): ranges that overlap or are adjacent become one."""
    by = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = ranges.withColumn("__new", (before.isNull() | (F.col("start") > before + 1)).cast("int"))
    islands = islands.withColumn("__island", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")


def subtracted(wanted: DataFrame, covered: DataFrame, *keys: str) -> DataFrame:
    """(keys, wanted_start, wanted_end, start, end): the parts of each wanted range that no covered range holds."""
    cover = merged(covered, *keys)
    cuts = cover.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cover"))
    rows = wanted.join(cuts, list(keys), "left")
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    first = F.struct(F.col("start").cast("bigint").alias("cursor"), empty.alias("parts"))

    def step(acc: Column, c: Column) -> Column:
        gap = (c["start"] > acc["cursor"]) & (c["start"] <= F.col("end") + 1)
        part = F.struct(acc["cursor"].alias("start"), F.least(c["start"] - 1, F.col("end").cast("bigint")).alias("end"))
        after = F.when(c["end"] < acc["cursor"], acc["cursor"]).when(c["start"] > F.col("end"), acc["cursor"]).otherwise(F.greatest(acc["cursor"], c["end"] + 1))
        return F.struct(after.cast("bigint").alias("cursor"), F.when(gap & (c["end"] >= acc["cursor"]), F.concat(acc["parts"], F.array(part))).otherwise(acc["parts"]).alias("parts"))

    typed = F.transform(F.coalesce(F.col("cover"), empty), lambda c: F.struct(c["start"].cast("bigint").alias("start"), c["end"].cast("bigint").alias("end")))
    inside = F.filter(typed, lambda c: (c["end"] >= F.col("start")) & (c["start"] <= F.col("end")))
    last = lambda acc: F.when(acc["cursor"] <= F.col("end"), F.concat(acc["parts"], F.array(F.struct(acc["cursor"].alias("start"), F.col("end").cast("bigint").alias("end"))))).otherwise(acc["parts"])
    parts = rows.withColumn("__p", F.explode(F.aggregate(inside, first, step, last)))
    return parts.select(*keys, F.col("start").alias("wanted_start"), F.col("end").alias("wanted_end"), F.col("__p.start").alias("start"), F.col("__p.end").alias("end"))


def enclosing(symbols: DataFrame, ranges: DataFrame, *keys: str) -> DataFrame:
    """Each range (id, start, end) with the smallest symbol (name, start, end) around it, of equal ones the later
    one; a name that its file has twice is ambiguous and names nothing."""
    counted = symbols.withColumn("__twice", F.count("*").over(Window.partitionBy(*keys, "name")) > 1).select(*keys, "name", "__twice", F.col("start").alias("s"), F.col("end").alias("e"))
    both = ranges.join(counted, list(keys)).where((F.col("s") <= F.col("start")) & (F.col("end") <= F.col("e")))
    best = both.groupBy("id").agg(F.min_by(F.struct("name", "__twice", "s", "e"), F.struct(F.col("e") - F.col("s"), -F.col("s"), F.col("name"))).alias("b"))
    found = best.select("id", F.when(~F.col("b.__twice"), F.col("b.name")).alias("symbol"), F.col("b.__twice").alias("ambiguous"))
    return ranges.join(found, "id", "left").select(*ranges.columns, "symbol", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def innermost(ranges: DataFrame, *keys: str) -> DataFrame:
    """Ranges (id, start, end) that hold no other one of their owner: an anti-join on strict containment."""
    o = ranges.select(*[F.col(k).alias(f"o_{k}") for k in keys], F.col("start").alias("os"), F.col("end").alias("oe"))
    same = [F.col(k) == F.col(f"o_{k}") for k in keys]
    inside = (F.col("start") <= F.col("os")) & (F.col("oe") <= F.col("end")) & ((F.col("start") != F.col("os")) | (F.col("oe") != F.col("end")))
    return ranges.join(o, [*same, inside], "left_anti")


def outermost(ranges: DataFrame, *keys: str) -> DataFrame:
    """Ranges that lie in no earlier or larger one, with the gap before each."""
    by = Window.partitionBy(*keys).orderBy("start", F.desc("end"))
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    tops = ranges.withColumn("__before", before).where(F.col("__before").isNull() | (F.col("start") > F.col("__before")))
    return tops.withColumn("gap", F.col("start") - F.coalesce("__before", F.lit(0)) - 1).drop("__before")


def neighbours(symbols: DataFrame, *keys: str) -> DataFrame:
    """Each symbol with the names of the siblings before and after it."""
    by = Window.partitionBy(*keys).orderBy("start", "name")
    return symbols.withColumns({"previous": F.lag("name").over(by), "next": F.lead("name").over(by)})


def span_text(ranges: Column) -> Column:
    return F.array_join(F.transform(ranges, lambda r: F.concat(r["start"].cast("string"), F.lit("-"), r["end"].cast("string"))), ", ")


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_end) & (b_start <= a_end)
