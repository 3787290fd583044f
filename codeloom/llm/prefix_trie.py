"""The trie of conversations' prefixes, by prefix-doubling naming.

Turns get dense numbers by their content. Blocks of 2, 4, 8, ... turns that begin at multiples of their length are pairs of blocks of half
the length, and equal pairs get equal dense numbers: one join round for each power of two. A prefix of d turns is the prefix without the lowest
bit of d, and the block of that length after it; so all prefixes are named in as many rounds again, each of them once. Prefixes of one length
and number are one node, and its smallest member names it from there on.

No round gathers a conversation or a node: rows are (conversation, block, number), joined on equalities; numbers are dealt by hash buckets.
Hot names (a first turn that a third of all conversations share) are counted before they are shuffled, and their joins are left to Spark
to split. Sums over subtrees come from the conversations that name the nodes, as sums over the prefixes of each.

Edge cases: rows with a null conv_id belong to no conversation and are left out; a null role or text is empty; turns are ordered by turn, null
first, then by the hash of their content; repeated rows are turns of their own; a conversation that is rebuilt without turns is a member of the root alone;
extra columns, whatever their names, are left out; an empty table has no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.common import forget, give_back, partitions, prefix_sum, range_bucket, range_splits, read, written

#: Turns that a conversation may take from its group's first conversation, and the size of a group.
SHARED, GROUP = 6, 100
#: Ids of one row on the way to the hash of a node's ends.
IDS = 4096


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, key, chars): turns in order from 0, their content as a SHA-256 (the role's length stands before it, so no two
    turns share one by their border), and the text's code points. A conversation's turns are ranked in ranges of turn numbers."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), key.alias("key"), F.char_length(text).cast("long").alias("chars"), F.lit(1).alias("one"))
    rows = written(rows, "keys")
    rows = written(rows.withColumn("bucket", range_bucket(F.col("turn"), range_splits(rows, "turn"))), "keys")
    ranked = prefix_sum(rows, [F.asc_nulls_first("turn"), "key"], "one", "pos", "bucket", ["conv_id"])
    return ranked.select("conv_id", "pos", "key", "chars")


def rebuilt(conversations: DataFrame, shared: int = SHARED, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(conv_id, i, key, chars, last) of all rebuilt conversations, and (conv_id, size) of them. Written tables."""
    turns = written(turn_rows(conversations), "turns")
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string")) % shared
    firsts = own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = own.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base")).join(firsts, "base", "left")
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = convs.select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size"))
    convs = written(convs, "conversations")
    kept = turns.join(convs, "conv_id").where(F.col("pos") >= F.col("h")).select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("i"), "key", "chars", "size")
    # a group has few conversations, each takes fewer than `shared` turns
    lent = turns.where(F.col("pos") < shared - 1).withColumnRenamed("conv_id", "base")
    lent = lent.join(convs, "base").where(F.col("pos") < F.col("taken")).select("conv_id", F.col("pos").alias("i"), "key", "chars", "size")
    rows = kept.union(lent).select("conv_id", "i", "key", "chars", (F.col("i") + 1 == F.col("size")).alias("last"))
    rows = written(rows, "rebuilt")
    forget(turns)
    return rows, convs


def dense(rows: DataFrame, keys: list[str], name: str, keep: list[str]) -> DataFrame:
    """keep and name of rows: equal keys have equal numbers, from 1 without gaps. Distinct keys are numbered in hash buckets, and
    the buckets' counts give each bucket's first number. A written table."""
    spark = rows.sparkSession
    distinct = rows.select(*keys).distinct().withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(4 * partitions(spark))))
    distinct = written(distinct.withColumn("nth", F.row_number().over(Window.partitionBy("bucket").orderBy(*keys))), "names")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    base = distinct.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    names = distinct.join(base, "bucket").select(*keys, (F.col("nth") + F.col("base")).cast("long").alias(name))
    return written(rows.join(names, keys).select(*keep, name), "named")


def blocks_of(rows: DataFrame, longest: int) -> list[DataFrame]:
    """For each power of two up to the longest conversation: (conv_id, m, name) of its whole blocks of 2^j turns, the m-th of them."""
    found = [dense(rows.select("conv_id", F.col("i").alias("m"), "key"), ["key"], "name", ["conv_id", "m"])]
    while 2 ** len(found) <= longest:
        half = lambda odd: F.max(F.when(F.col("m") % 2 == odd, F.col("name")))
        pairs = found[-1].groupBy("conv_id", F.floor(F.col("m") / 2).alias("m")).agg(half(0).alias("left"), half(1).alias("right")).where("right is not null")
        found.append(dense(pairs, ["left", "right"], "name", ["conv_id", "m"]))
    return found


def named_prefixes(rows: DataFrame, longest: int) -> DataFrame:
    """(conv_id, depth, name): prefixes of one depth have the same name if and only if they are equal."""
    blocks, done = blocks_of(rows, longest), None
    parts = []
    for j in reversed(range(len(blocks))):
        # the prefixes whose length's lowest bit is j: a prefix that has a higher lowest bit, and an even block
        ends = blocks[j].where("m % 2 = 0").select("conv_id", F.shiftleft("m", j).alias("start"), F.col("name").alias("block"))
        if done is None:
            ends = ends.withColumn("before", F.lit(0).cast("long"))
        else:
            known = done.select("conv_id", F.col("depth").alias("start"), F.col("name").alias("before"))
            ends = ends.join(known, ["conv_id", "start"], "left").withColumn("before", F.coalesce("before", F.lit(0)))
        ends = ends.select("conv_id", (F.col("start") + 2**j).alias("depth"), "before", "block")
        parts.append(dense(ends, ["depth", "before", "block"], "name", ["conv_id", "depth"]))
        done = parts[-1] if done is None else done.unionByName(parts[-1])
    whole = written(done, "prefixes")
    forget(*blocks, *parts)
    return whole


def ends_hashes(ends: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) of nodes in which conversations (conv_id) end: their ids, ascending, joined by commas. Ids are joined in
    bounded blocks; a task then hashes a node's blocks one after the other and holds none of them."""
    blocks = ends.groupBy("depth", "node", F.floor(F.col("conv_id") / IDS).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"))
    n = partitions(ends.sparkSession)
    dealt = blocks.repartition(n, "depth", "node").sortWithinPartitions("depth", "node", "block").select("depth", "node", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for batch in batches:
            for depth, node, ids in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if (depth, node) == now:
                    state.update(b"," + ids.encode())
                    continue
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = (depth, node), hashlib.sha256(ids.encode())
            yield rows_of(out)
            out = []
        if now is not None:
            yield rows_of([(*now, state.hexdigest())])
        give_back()

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["depth", "node", "ends_sha256"])

    return dealt.mapInArrow(run, "depth long, node long, ends_sha256 string")


def below(rows: DataFrame, value: str, out: str) -> DataFrame:
    """rows (conv_id, depth, ...) with out: the sum of value over the same conversation's rows of this depth and greater ones."""
    rows = rows.withColumn("up", -F.col("depth"))
    rows = written(rows.withColumn("bucket", range_bucket(F.col("up"), range_splits(rows, "up"))), "depths")
    return prefix_sum(rows, ["up"], value, out, "bucket", ["conv_id"]).withColumn(out, F.col(out) + F.col(value)).drop("up", "bucket")


def prefix_trie(conversations: DataFrame, shared: int = SHARED, group: int = GROUP) -> DataFrame:
    """A row for each node: its smallest member and depth, its parent's smallest member, its members, children, leaves below it (itself, if
    childless), what sharing its subtree's texts saves, and the hash of the members that end in it."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    long = lambda v: F.lit(v).cast("long")
    rows, convs = rebuilt(conversations, shared, group)
    told = convs.agg(F.max("size").alias("longest"), F.min("conv_id").alias("root"), F.count("*").alias("n")).first()
    longest, root = told["longest"] or 0, told["root"]
    empty = convs.where("size = 0").select(long(0).alias("depth"), long(root).alias("node"), "conv_id")
    if not longest:
        top = empty.groupBy("depth", "node").agg(F.count("*").alias("n_convs")).join(ends_hashes(empty), ["depth", "node"])
        return top.select(F.col("node").alias("conv_id"), "depth", long(None).alias("parent_conv_id"), "n_convs", *[long(v).alias(c) for c, v in (("n_children", 0), ("n_leaves", 1), ("saved_tokens", 0))], "ends_sha256")
    names = named_prefixes(rows, longest)
    groups = names.groupBy("depth", "name").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"))
    facts = rows.select("conv_id", (F.col("i") + 1).alias("depth"), "chars", "last")
    # from here on a node is (depth, node): its smallest member
    members = written(names.join(groups, ["depth", "name"]).select("conv_id", "depth", "node", "n_convs").join(facts, ["conv_id", "depth"]), "members")
    forget(names, rows)
    own = members.where("conv_id = node")
    above = members.select(F.col("conv_id").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    nodes = own.select("depth", "node", "n_convs").join(above, ["node", "depth"], "left").select("depth", "node", "n_convs", F.coalesce("parent", long(root)).alias("parent"))
    nodes = written(nodes, "nodes")
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["depth", "node"], "left")
    leaves = nodes.where("n_children is null").select(F.col("node").alias("conv_id"), F.lit(1).alias("leaf"))
    weight = F.when(F.col("conv_id") == F.col("node"), (F.col("n_convs") - 1) * F.col("chars")).otherwise(0).cast("long")
    sums = below(members.select("conv_id", "depth", "node", weight.alias("weight")), "weight", "saved").join(leaves, "conv_id", "left")
    sums = sums.groupBy("depth", "node").agg(F.sum("saved").alias("saved_tokens"), F.count("leaf").alias("n_leaves"))
    whole = nodes.join(sums, ["depth", "node"], "left").select("depth", "node", "parent", "n_convs", zero("n_children").alias("n_children"), zero("n_leaves").alias("n_leaves"), zero("saved_tokens").alias("saved_tokens"))
    whole = written(whole, "trie")
    top = whole.agg(F.count_if(F.col("depth") == 1).alias("n_children"), F.count_if(F.col("n_children") == 0).alias("n_leaves"), F.sum(F.when(F.col("depth") == 1, F.col("saved_tokens"))).alias("saved_tokens"))
    top = top.select(long(0).alias("depth"), long(root).alias("node"), long(None).alias("parent"), long(told["n"]).alias("n_convs"), "n_children", "n_leaves", zero("saved_tokens").alias("saved_tokens"))
    hashed = ends_hashes(members.where("last").select("depth", "node", "conv_id").union(empty))
    out = whole.union(top).join(hashed, ["depth", "node"], "left")
    return out.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing()).alias("ends_sha256"))


def nothing() -> Column:
    return F.sha2(F.lit(""), 256)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"))


#: The same nodes by prefixes as strings of content hashes; CRC-32 bit by bit.
OP13_SQL = """
  WITH t AS (
    SELECT conv_id AS c, turn, sha256(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
  p AS (SELECT c, k, chars, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) - 1 AS pos FROM t),
  cs AS (SELECT DISTINCT c, c - c % 100 AS base, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT) AS bytes FROM t),
  h AS (SELECT c, base, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 6 AS h FROM cs),
  r AS (
    SELECT h.c, 0 AS part, pos, k, chars FROM h JOIN p ON p.c = h.base AND pos < h
    UNION ALL SELECT h.c, 1, pos, k, chars FROM h JOIN p ON p.c = h.c AND pos >= h),
  d AS (SELECT c, row_number() OVER w AS depth, string_agg(k, '') OVER w AS prefix, chars FROM r WINDOW w AS (PARTITION BY c ORDER BY part, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  a AS (SELECT c, depth, prefix, chars FROM d UNION ALL SELECT c, 0, '', 0 FROM cs),
  l AS (SELECT c, max(depth) AS size FROM a GROUP BY c),
  n AS (SELECT a.depth, prefix, min(a.c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, coalesce(string_agg(a.c::VARCHAR, ',' ORDER BY a.c) FILTER (size = a.depth), '') AS ends FROM a JOIN l ON l.c = a.c GROUP BY 1, 2),
  k AS (SELECT depth - 1 AS depth, left(prefix, 64 * (depth - 1)::INTEGER) AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
  o AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.depth = n.depth AND k.prefix = n.prefix),
  up AS (SELECT unnest(range(depth + 1)) AS depth, prefix, n_convs, chars, n_children, depth AS own FROM o),
  s AS (SELECT depth, left(prefix, 64 * depth::INTEGER) AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * chars) AS saved FROM up GROUP BY 1, 2)
  SELECT o.conv_id, o.depth, q.conv_id AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(o.ends) AS ends_sha256
  FROM o JOIN s ON s.depth = o.depth AND s.prefix = o.prefix LEFT JOIN o AS q ON o.depth > 0 AND q.depth = o.depth - 1 AND q.prefix = left(o.prefix, 64 * (o.depth - 1)::INTEGER)"""
