"""Helpers shared by the training-data operators: written intermediate tables, range buckets, prefix sums."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.session import forget, new_path, settle, written  # noqa: F401  (used by the operators)

#: Words of a text, as the contracts of this package define them.
WORD = r"[^\x20\x09-\x0D]+"
#: At most so many ids are sent to every executor (8 bytes each, some hundred in the driver's tables); beyond that the same join shuffles.
BROADCAST_IDS = 100_000
#: Bits for each id of a larger number, and bits in all (2 MB), that say which rows need not be shuffled to meet the ids.
BITS_AN_ID, MOST_BITS = 8, 1 << 24
#: Bytes of a written table from which on `unsent` lets none be broadcast: its rows pass through the driver, where they take fifty times as much.
SMALL_BYTES = 512 * 1024


def give_back() -> None:
    """Returns a Python process's freed memory to the system: workers live on and share an executor's memory, as the driver does."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def byte_runs(texts: pa.Array, most: int) -> list[tuple[int, int]]:
    """(first row, rows) of runs of rows with about `most` bytes of text or binary; a longer one is in a run with few others."""
    if not len(texts):
        return []
    group = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // most
    first = np.flatnonzero(np.diff(group, prepend=-1))
    first[0] = 0
    return list(zip(first.tolist(), np.diff(np.append(first, len(texts))).tolist(), strict=True))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """name, or a longer form of it that no column of df has, in whatever case."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def row_key(*columns: Column) -> Column:
    """A 64-bit hash of a row's values, nulls told apart."""
    return F.xxhash64(*[x for c in columns for x in (c.isNull(), c)])


def unsent(table: DataFrame) -> DataFrame:
    """A table of `written` for joins: one that is not small meets others by sorting, whatever Spark would send through the driver."""
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._kept_at)
    size = path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).getContentSummary(path).getLength()
    return table if size <= SMALL_BYTES else table.hint("merge")


def kept(df: DataFrame, name: str) -> DataFrame:
    """unsent(written(df)), which `forget` knows."""
    table = written(df, name)
    out = unsent(table)
    out._kept_at = table._kept_at
    return out


def with_ids(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Semi or anti join on a column of distinct ids: broadcast if their number is proven small. Else rows are shuffled, but only those whose
    bit in a table of bounded size is set; no other can have one of the ids."""
    n = ids.limit(BROADCAST_IDS + 1).count()
    if n <= BROADCAST_IDS:
        return df.join(F.broadcast(ids), key, how)
    likely, unlikely = by_bits(df, ids, key)
    found = likely.join(ids.select(F.col(key).alias(fresh(df, "id"))).hint("merge"), F.col(key) == F.col(fresh(df, "id")), how)
    return found if how == "left_semi" else found.union(unlikely)


def by_bits(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of df that may have one of the ids (all that have, and some others), and those that have none, told by one bit of the key's hash."""
    bits = min(MOST_BITS, 1 << max(6, (BITS_AN_ID * ids.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(F.lit(1), c), F.lit(bits))
    word = lambda p: F.shiftrightunsigned(p, 6).cast("int")
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int"))
    words = ids.select(place(F.col(key)).alias("p")).select(word(F.col("p")).alias("w"), bit(F.col("p")).alias("b"))
    words = words.union(df.sparkSession.range(bits // 64).select(F.col("id").cast("int"), F.lit(0).cast("long"))).groupBy("w").agg(F.bit_or("b").alias("b"))
    name = fresh(df, "bits")
    table = F.broadcast(words.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias(name)))
    p = place(F.col(key))
    told = F.get(F.col(name), word(p)).bitwiseAND(bit(p)) != 0
    return df.join(table, told, "left_semi"), df.join(table, told, "left_anti")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_splits(df: DataFrame, key: str, n: int | None = None) -> list[int]:
    """About n - 1 ascending split points of a long column, as many rows between each two."""
    n = n or partitions(df.sparkSession)
    if n < 2:
        return []
    found = df.select(F.percentile_approx(key, [i / n for i in range(1, n)], max(1000, 4 * n)).alias("p")).first()["p"]
    return sorted(set(found or []))


def range_bucket(key: Column, splits: list[int]) -> Column:
    """How many split points are at most the key: buckets that ascend with it. Null keys go to bucket 0."""
    if not splits:
        return F.lit(0)
    lows = F.array(*[F.lit(s).cast("long") for s in splits])
    return F.coalesce(F.size(F.filter(lows, lambda s: s <= key)), F.lit(0))


def prefix_sum(df: DataFrame, order: list[str], value: str, out: str, bucket: str, within: list[str] | None = None) -> DataFrame:
    """Adds out: the sum of value over all earlier rows (of the same `within` columns).

    bucket must ascend with the order. Only one row for each bucket (and group) is summed together,
    so neither one group nor the whole table ever meets in one task.
    """
    keys = within or []
    safe = [F.coalesce(F.to_json(F.struct(k)), F.lit("")).alias(f"__{k}") for k in keys]  # nulls join too
    df = df.select("*", *safe)
    safe_keys = [f"__{k}" for k in keys]
    totals = df.groupBy(*safe_keys, bucket).agg(F.sum(value).alias("__t"))
    before = Window.partitionBy(*safe_keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*safe_keys, bucket, F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__base"))
    inner = Window.partitionBy(*safe_keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__own", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return df.join(totals, [*safe_keys, bucket]).withColumn(out, (F.col("__own") + F.col("__base")).cast("long")).drop("__own", "__base", *safe_keys)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges: (node, component), component the smallest node.

    By contraction: every node points to its neighbour that is first in the order of a hash (or stays, if it is first
    itself), pointers are followed twice, and edges between the groups are what the next round works on. They shrink by
    a constant factor or more each round, whatever the shape of the graph. Nodes without edges have no row.
    """
    first = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    left = kept(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct(), "edges")
    labels, used = None, []
    for _ in range(rounds):
        both = left.select("u", "v").union(left.select("v", "u"))
        near = both.groupBy("u").agg(F.min(first("v")).alias("n"))
        once = kept(near.select("u", F.least(first("u"), "n")["id"].alias("to")), "pointers")
        far = once.select(F.col("u").alias("to"), F.col("to").alias("far"))
        to = kept(once.join(far, "to").select("u", F.col("far").alias("to")), "pointers")
        before = labels
        if labels is None:
            labels = to.select(F.col("u").alias("node"), F.col("to").alias("root"))
        else:
            moved = to.select(F.col("u").alias("root"), F.col("to").alias("__to"))
            labels = labels.join(moved, "root", "left").select("node", F.coalesce("__to", "root").alias("root"))
        labels = kept(labels, "labels")
        ends = left.join(to, "u").select(F.col("to").alias("p"), F.col("v").alias("u")).join(to, "u").select("p", F.col("to").alias("q"))
        rest = kept(ends.where("p <> q").select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct(), "edges")
        used += [left, once, to, *([before] if before is not None else [])]
        left = rest
        if left.isEmpty():
            forget(*used)
            least = labels.groupBy("root").agg(F.min("node").alias("component"))
            return labels.join(least, "root").select("node", "component")
    raise RuntimeError(f"edges are left after {rounds} rounds")
