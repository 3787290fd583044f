"""Sessions that end after an hour without use, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TTL = "1 hour"


def sessions(events: DataFrame, ttl: str = TTL) -> DataFrame:
    """(user_id, started, last_used, uses): an event keeps a session open for ttl, exactly ttl later included."""
    return events.groupBy("user_id", F.session_window("ts", ttl).alias("w")).agg(F.min("ts").alias("started"), F.max("ts").alias("last_used"), F.count("*").alias("uses")).drop("w")


def session_stream(events: DataFrame, ttl: str = TTL, late: str = "10 minutes") -> DataFrame:
    """The same over a stream: a session is emitted when the watermark has passed its end."""
    return sessions(events.withWatermark("ts", late), ttl)


def evicted(accesses: DataFrame, capacity: int) -> DataFrame:
    """The keys a store of `capacity` least recently used ones would keep after all accesses, by last use."""
    last = accesses.groupBy("user_id").agg(F.max("ts").alias("last_used"))
    return last.orderBy(F.desc("last_used"), "user_id").limit(capacity)


def concurrent(intervals: DataFrame) -> DataFrame:
    """(at, running): how many half-open intervals (start, end) run after each change."""
    changes = intervals.select(F.col("start").alias("at"), F.lit(1).alias("d")).union(intervals.select("end", F.lit(-1)))
    by_hour = changes.groupBy(F.date_trunc("hour", "at").alias("hour"), "at").agg(F.sum("d").alias("d"))
    base = by_hour.groupBy("hour").agg(F.sum("d").alias("t"))
    base = base.withColumn("base", F.coalesce(F.sum("t").over(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each hour
    within = F.sum("d").over(Window.partitionBy("hour").orderBy("at"))
    return by_hour.withColumn("own", within).join(base.select("hour", "base"), "hour").select("at", (F.col("own") + F.col("base")).alias("running"))
