"""Mixing sources to target weights.

Each source's texts, laid end to end in ascending doc_id order, are packed into blocks of a fixed number of words (the
last one is shorter). A source's target decides how many of its blocks the mix takes: its slots. The mix is written as output
shards of about as many slots each; for each shard a multinomial draw over the sources decides how many slots each of them has in
it, out of what they have left, so every shard has about the mix's proportions and the counts of a source add up to its slots.
Slots of a source are numbered through the shards, and slot i takes block perm(i mod blocks) of epoch i div blocks, where perm is
a keyed permutation of the source's block numbers. Slots join blocks by (source, number). Everything depends on the seed and the
rows alone, so reruns agree.

The block length is a power of two by the source's size (about a 2048th of it, from 16 to 2048 words), so a taken
amount is within about one block of its target.

Slots are drawn where there are few (a row for each shard and source); their numbers are made in ranges of `RANGE`, so that a
source with most of the slots is spread over many tasks.

Edge cases: null texts have size 0; null sources are one source, the last; sources without words have target 0;
equal doc_ids stand in the order of their texts, each row with words of its own, repeated rows too; extra columns, whatever their
names, are left out by `mixed` and kept by `take_mix`; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from codeloom.llm.common import WORD, fresh, partitions, prefix_sum, range_bucket, range_splits, read, row_key, with_ids, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SHARDS = 16
SEED = 20240101
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 16, 2048, 2048
#: Slots that are numbered together, sources whose slots are drawn together, and sources of which a row may be sent to every executor.
RANGE, TOGETHER, FEW = 20_000, 10_000, 100_000


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) for each source.

    The final level of giving shares by weight and resharing what exceeds `most` times a size: sources in the
    order of size per weight are full until the level, what is left of the total per weight left, meets one.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy()
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"total": F.sum("source_size").over(every) * F.lit(float(share)), "weights": F.sum("weight").over(every)})
    rows = rows.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(up), F.lit(0.0))))
    rows = rows.withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    rows = rows.withColumn("at", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(every)["level"])
    return rows.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("at") * F.col("weight"), F.col("cap"))).alias("target"))


def key_of(source: Column) -> Column:
    """A source as a join key; a null source has one too."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def permuted(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1: four Feistel rounds over the next even number of bits, walked back into range."""
    if n <= 1:
        return np.zeros_like(i)
    bits = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, out, todo = (1 << bits) - 1, i.astype(np.uint64), np.arange(len(i))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(bits), x & np.uint64(mask)
        for r in range(4):
            mixed = (right + np.uint64((key + r * 0x9E3779B9) % 2**61)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(29)
            mixed = (mixed * np.uint64(0x94D049BB133111EB)) >> np.uint64(32)
            left, right = right, (left ^ mixed) & np.uint64(mask)
        out[todo] = (left << np.uint64(bits)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def shard_counts(slots: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """shards x sources: how many slots each source has in each shard. A shard's slots are drawn from what the sources have left (a
    multinomial draw without return), so that no source has more than its slots and the last shard takes the rest."""
    rng, left, out = np.random.default_rng(seed), slots.astype(np.int64).copy(), np.zeros((shards, len(slots)), np.int64)
    for k in range(shards):
        size = -(-int(left.sum()) // (shards - k))
        while size > 0:  # what a source cannot give any more is drawn again from the others
            got = np.minimum(rng.multinomial(size, left / left.sum()), left)
            out[k] += got
            left -= got
            size -= int(got.sum())
    return out


def draw_shards(sources: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(key, shard, first, n, blocks): the slots of each source in each shard, numbered from first on; n > 0.

    The draw is one for each part of up to `TOGETHER` sources (in the order of a hash), so that it never needs all sources in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable")
        n = shard_counts(pdf["slots"].to_numpy(), shards, [seed, int(pdf["part"].iloc[0])])
        at, which = np.nonzero(n)
        first = np.cumsum(n, axis=0) - n
        return pd.DataFrame({"key": pdf["key"].to_numpy()[which], "shard": at.astype("int32"), "first": first[at, which], "n": n[at, which], "blocks": pdf["blocks"].to_numpy()[which]})

    some = sources.where("slots > 0").select("key", "blocks", "slots")
    parts = max(1, -(-some.count() // TOGETHER))
    return some.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts))).groupBy("part").applyInPandas(run, "key string, shard int, first long, n long, blocks long")


def numbered_slots(drawn: DataFrame, seed: int = SEED) -> DataFrame:
    """(key, shard, block, epoch) of each slot, from rows (key, shard, first, n, blocks)."""
    import zlib

    def run(batches):
        for pdf in batches:
            for key, shard, first, n, blocks in zip(pdf["key"], pdf["shard"], pdf["first"], pdf["n"], pdf["blocks"], strict=True):
                i = np.arange(first, first + n, dtype=np.int64)
                epoch, block = i // blocks, np.empty_like(i)
                for e in np.unique(epoch):
                    block[epoch == e] = permuted(i[epoch == e] % blocks, int(blocks), int(seed + zlib.crc32(f"{key}/{e}".encode())))
                yield pd.DataFrame({"key": key, "shard": np.int32(shard), "block": block, "epoch": epoch.astype("int32")})

    low = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / RANGE)))
    ranges = drawn.withColumn("r", low).select("key", "shard", (F.col("first") + F.col("r") * RANGE).alias("first"), F.least(F.lit(RANGE), F.col("n") - F.col("r") * RANGE).alias("n"), "blocks")
    return ranges.repartition(partitions(drawn.sparkSession), "key", "shard", "first").mapInPandas(run, "key string, shard int, block long, epoch int")


def packed(docs: DataFrame, row: Column) -> DataFrame:
    """(uid, row, key, doc_id, size, source, start): where each row's words lie among its source's."""
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("text").alias("tie"))
    rows = written(rows.withColumn("key", key_of(F.col("source"))), "sizes")
    rows = rows.withColumn("k", F.coalesce("doc_id", F.lit(-(2**63))))
    rows = rows.withColumn("bucket", range_bucket(F.col("k"), range_splits(rows, "k")))
    return prefix_sum(rows, ["k", "tie", "row", "uid"], "size", "start", "bucket", ["key"]).drop("k", "tie", "bucket")


def few(sources: DataFrame) -> DataFrame:
    """A table with a row for each source, to be sent to every executor if its size allows."""
    return F.broadcast(sources) if sources.limit(FEW + 1).count() <= FEW else sources.hint("merge")


def plan(rows: DataFrame) -> DataFrame:
    """(key, source_size, target, length, blocks, slots), a row for each source."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = targets(sizes).withColumn("key", key_of(F.col("source")))
    length = F.greatest(F.lit(LEAST_BLOCK), F.least(F.lit(MOST_BLOCK), F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.col("source_size") / F.lit(float(BLOCKS)), F.lit(1.0))))).cast("int")))
    by = by.withColumn("length", length.cast("long"))
    by = by.withColumn("blocks", F.ceil(F.col("source_size") / F.col("length")))
    slots = F.least(F.col("blocks") * int(MOST), F.bround(F.col("target") * F.col("blocks") / F.greatest(F.col("source_size"), F.lit(1))))
    return by.select("key", "source_size", "target", "length", "blocks", slots.cast("long").alias("slots"))


def pieces(rows: DataFrame, sources: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(uid, block, first, words, epoch, shard): each taken part of a row: words from the first-th of its words on."""
    slots = numbered_slots(draw_shards(sources, shards, seed), seed)
    parts = rows.where("size > 0").join(few(sources.select("key", "length")), "key")
    parts = parts.select("uid", "key", "start", "size", "length", F.explode(F.sequence(F.floor(F.col("start") / F.col("length")), F.floor((F.col("start") + F.col("size") - 1) / F.col("length")))).alias("block"))
    low, high = F.greatest(F.col("start"), F.col("block") * F.col("length")), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("length"))
    parts = parts.select("uid", "key", "block", (low - F.col("start")).alias("first"), (high - low).alias("words"))
    return parts.join(slots, ["key", "block"])


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, and by_shard (the words that each output shard takes of it) for each row of docs."""
    rows = packed(docs, F.lit(0))
    sources = written(plan(rows), "sources")
    each = pieces(rows, sources).groupBy("uid", "shard").agg(F.sum("words").alias("words"))
    taken = each.groupBy("uid").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct("shard", "words"))).alias("by_shard"))
    out = rows.join(taken, "uid", "left").join(few(sources.select("key", "source_size", "target")), "key")
    shown = F.array_join(F.transform("by_shard", lambda x: F.concat_ws(":", x["shard"].cast("string"), x["words"].cast("string"))), ",")
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce(shown, F.lit("")).alias("by_shard"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(read(spark, sf_dir, "documents"))


def take_mix(docs: DataFrame) -> DataFrame:
    """The mix as rows with the columns of docs: for each row and epoch the words that the mix takes, in order. A row taken whole keeps
    its text as it is; of others the taken words are joined by blanks.

    Texts are shuffled once, to the parts that are taken of them. Rows are told apart by a hash of all their columns, so repeated
    rows share one text and have parts of their own."""
    columns = docs.columns
    plain = [F.col(f.name) if not has_map(f.dataType) else F.to_json(F.col(f.name)) for f in docs.schema]
    rows = packed(docs, row_key(*plain))
    sources = written(plan(rows), "sources")
    taken = pieces(rows.select("uid", "key", "start", "size"), sources).groupBy("uid", "epoch").agg(F.array_sort(F.collect_list(F.struct("first", "words"))).alias("p"), F.sum("words").alias("taken"))
    taken = written(taken.join(rows.select("uid", "row", "size"), "uid").drop("uid", "epoch"), "taken")
    mark, p, part, full = (fresh(docs, c) for c in ("row", "p", "taken", "size"))
    texts = docs.withColumn(mark, row_key(*plain))
    repeats = written(rows.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select(F.col("row").alias(mark)), "repeats")
    if not repeats.isEmpty():
        texts = with_ids(texts, repeats, mark, "left_anti").unionByName(with_ids(texts, repeats, mark).dropDuplicates([mark]))
    parts = taken.select(F.col("row").alias(mark), F.col("p").alias(p), F.col("taken").alias(part), F.col("size").alias(full))
    out = texts.join(parts.hint("merge"), mark)
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    some = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform(p, lambda x: F.slice(w, (x["first"] + 1).cast("int"), x["words"].cast("int")))), " "))[0]
    out = out.withColumn("text", F.when(F.col(part) == F.col(full), F.col("text")).otherwise(some))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)


def has_map(kind: T.DataType) -> bool:
    """Whether a type holds a map, of which there is no hash."""
    if isinstance(kind, T.StructType):
        return any(has_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and has_map(kind.elementType)
