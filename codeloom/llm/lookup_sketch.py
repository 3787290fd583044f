"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, with DataFrame functions only.

A paragraph is a line; a line longer than `LONG` code points is cut after the sentence end that follows. Digests
are 64-bit hashes of the distinct non-empty paragraphs. A sketch deals digests by hash to a power of two of groups
(about `LOAD` digests each), and each group has `CELLS` cells; every digest is added to three of them, and a cell
keeps how many digests it has and the XORs of them and of their check hashes. fingerprint is the number of digests and these cells.

Two fingerprints are compared by their cells. The one with more groups is folded to the groups of the other (groups with the same low
bits add up), they subtract cell by cell, what both documents have cancels, and peeling cells that hold one digest recovers the
differing digests of either side. Groups that do not peel are sketched again, in the groups of the larger fingerprint and with twice the
cells, up to `TRIES` times; only what fails them all is compared digest by digest. So the likeness is always that of the two digest
sets: common / all distinct digests, from the number of recovered ones.

The next document comes from a window over range buckets of doc_id, in which a bucket's last row sees a copy of the next
bucket's first row; texts move once, and no task sees more than a bucket.

Edge cases: null text is empty; two documents without paragraphs are alike (1.0); a single document is its own
next one; rows of the same doc_id stand in the order of their texts, repeated rows too; null doc_ids come first; an empty table gives
an empty result; extra columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.common import range_bucket, range_splits, read

LONG = 200
LOAD = 6
CELLS = 12
TRIES = 2
#: Cells a digest is added to: one of each third.
HASHES = 3

def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once (an argument of a lambda is evaluated again wherever it stands)."""
    return F.transform(F.array(value), then)[0]


def paragraphs(text: Column) -> Column:
    """Distinct paragraphs: their digests d, and what decides their group (g), cells (h) and check sum (c)."""
    parts = F.regexp_extract_all(text, F.lit(rf"[^\n]{{1,{LONG}}}+[^\n.!?]*+[.!?]*+"), F.lit(0))
    digests = F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))
    return F.transform(digests, lambda d: F.struct(d.alias("d"), F.xxhash64(d, F.lit(1)).alias("g"), F.xxhash64(d).alias("h"), check_of(d).alias("c")))


def check_of(d: Column) -> Column:
    return F.xxhash64(d, F.lit(7))


def power(bits: Column) -> Column:
    return F.pow(F.lit(2.0), bits).cast("bigint")


def groups(n: Column) -> Column:
    """A power of two of groups for n digests."""
    return power(F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)) / F.lit(float(LOAD))))))


def by_group(entries: Column, q: Column) -> Column:
    """The entries of each of q groups, in the order of their numbers. Beyond 32 groups by two levels of filters, so that a long
    document costs its paragraphs times the root of the groups."""
    one = lambda part, mask, g: F.filter(part, lambda e: e["g"].bitwiseAND(mask) == g)
    upto = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    few = F.transform(upto(q), lambda g: one(entries, q - 1, g))
    many = let(
        power(F.floor(F.log2(q) / 2)),
        lambda root: let(F.transform(upto(root), lambda g: one(entries, root - 1, g)), lambda parts: F.transform(upto(q), lambda k: one(F.get(parts, k.bitwiseAND(root - 1).cast("int")), q - 1, k))),
    )
    return F.when(q == 1, F.array(entries)).when(q <= 32, few).otherwise(many)


def empty_cells(cells: int) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.array_repeat(F.struct(F.lit(0).alias("n"), zero.alias("key"), zero.alias("check")), cells)


def changed(table: Column, d: Column, h: Column, c: Column, sign: Column) -> Column:
    """The cells after sign (1 or -1) times one digest: one cell of each third."""
    third = (F.size(table) / HASHES).cast("int")
    at = [(F.pmod(F.shiftright(h, 16 * i), third) + i * third).cast("int").alias(f"p{i}") for i in range(HASHES)]
    return let(
        F.struct(d.alias("d"), c.alias("c"), sign.alias("s"), *at),
        lambda v: F.transform(
            table,
            lambda x, i: F.when((i == v["p0"]) | (i == v["p1"]) | (i == v["p2"]), F.struct((x["n"] + v["s"]).alias("n"), x["key"].bitwiseXOR(v["d"]).alias("key"), x["check"].bitwiseXOR(v["c"]).alias("check"))).otherwise(x),
        ),
    )


def sketch(entries: Column, cells: int) -> Column:
    return F.aggregate(entries, empty_cells(cells), lambda t, e: changed(t, e["d"], e["h"], e["c"], F.lit(1)))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key"), x["check"].bitwiseXOR(y["check"]).alias("check")))


DIGESTS = "array<bigint>"


def none() -> Column:
    return F.array().cast(DIGESTS)


def peeled(table: Column, most: Column) -> Column:
    """(gone, come): the digests that only the first or only the second side has, from the difference of their cells; null if cells are
    left that hold more than one digest. No more than `most` steps are taken."""
    start = F.struct(table.alias("cells"), none().alias("gone"), none().alias("come"))
    pure = lambda x: (F.abs(x["n"]) == 1) & (x["check"] == check_of(x["key"]))
    with_one = lambda known, p, sign: F.when(p["n"] == sign, F.concat(known, F.array(p["key"]))).otherwise(known)

    def step(acc: Column, _: Column) -> Column:
        found = lambda p: F.struct(
            changed(acc["cells"], p["key"], F.xxhash64(p["key"]), p["check"], -p["n"]).alias("cells"), with_one(acc["gone"], p, 1).alias("gone"), with_one(acc["come"], p, -1).alias("come")
        )
        return let(F.filter(acc["cells"], pure), lambda p: F.when(F.size(p) == 0, acc).otherwise(found(p[0])))

    clear = lambda p: F.forall(p["cells"], lambda x: (x["n"] == 0) & (x["key"] == 0) & (x["check"] == 0))
    return let(F.aggregate(F.sequence(F.lit(1), F.least(most, F.size(table))), start, step), lambda p: F.when(clear(p), F.struct(p["gone"].alias("gone"), p["come"].alias("come"))))


def folded(sketches: Column, q: Column) -> Column:
    """The sketches of all groups, added up to q groups."""
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: F.struct((x["n"] + y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key"), x["check"].bitwiseXOR(y["check"]).alias("check")))
    own = lambda g: F.transform(F.sequence(g + q, F.size(sketches).cast("bigint") - 1, q), lambda k: F.get(sketches, k.cast("int")))
    one = lambda g: F.when(g + q >= F.size(sketches), F.get(sketches, g.cast("int"))).otherwise(F.aggregate(own(g), F.get(sketches, g.cast("int")), plus))
    return F.when(F.size(sketches) == q, sketches).otherwise(F.transform(F.sequence(F.lit(0).cast("bigint"), q - 1), one))


def difference(a: Column, b: Column, cells: int, tries: int = TRIES) -> Column:
    """(gone, come) of two groups of entries, by sketches that grow until they peel."""
    own, other = (F.transform(x, lambda e: e["d"]) for x in (a, b))
    if not tries:
        return F.struct(F.array_except(own, other).alias("gone"), F.array_except(other, own).alias("come"))
    tried = peeled(minus(sketch(a, cells), sketch(b, cells)), F.size(a) + F.size(b))
    sure = F.when((F.size(a) == 0) | (F.size(b) == 0), F.struct(own.alias("gone"), other.alias("come")))
    return F.coalesce(sure, tried, difference(a, b, 2 * cells, tries - 1))


def sketches(entries: Column) -> Column:
    """The cells of each group of a document."""
    return let(groups(F.size(entries)), lambda q: F.transform(by_group(entries, q), lambda g: sketch(g, CELLS)))


def compared(a: Column, b: Column, a_cells: Column, b_cells: Column) -> Column:
    """(gone, come): the digests that only one of two documents has, from their fingerprints' cells; the entries are for what these do not
    tell."""
    most = F.greatest(F.size(a_cells), F.size(b_cells)).cast("bigint")
    pick = lambda entries, mask, g: F.filter(entries, lambda e: e["g"].bitwiseAND(mask) == g)

    def again(q: Column, g: Column) -> Column:
        return let(
            F.struct(pick(a, q - 1, g).alias("a"), pick(b, q - 1, g).alias("b")),
            lambda own: let(
                F.transform(F.sequence(g, most - 1, q), lambda k: let(F.struct(pick(own["a"], most - 1, k).alias("a"), pick(own["b"], most - 1, k).alias("b")), lambda p: difference(p["a"], p["b"], 2 * CELLS))),
                lambda parts: F.struct(F.flatten(F.transform(parts, lambda p: p["gone"])).alias("gone"), F.flatten(F.transform(parts, lambda p: p["come"])).alias("come")),
            ),
        )

    def each(q: Column) -> Column:
        pairs = F.zip_with(folded(a_cells, q), folded(b_cells, q), minus)
        return F.transform(pairs, lambda cells, g: F.coalesce(peeled(cells, F.size(cells)), again(q, g.cast("bigint"))))

    parts = let(F.least(F.size(a_cells), F.size(b_cells)).cast("bigint"), each)
    return let(parts, lambda p: F.struct(F.flatten(F.transform(p, lambda x: x["gone"])).alias("gone"), F.flatten(F.transform(p, lambda x: x["come"])).alias("come")))


def likeness(a: Column, b: Column, found: Column) -> Column:
    """Common / all distinct digests of two documents, from what was found to differ."""
    total, d = F.size(a) + F.size(b), F.size(found["gone"]) + F.size(found["come"])
    return F.when(total == 0, 1.0).otherwise((total - d) / (total + d)).cast("double")


def fingerprint(entries: Column, cells: Column) -> Column:
    """The number of digests, and the cells of each group's sketch in hexadecimal."""
    shown = lambda t: F.array_join(F.transform(t, lambda c: F.when(c["n"] == 0, "").otherwise(F.concat_ws("/", F.hex(c["n"]), F.hex(c["key"]), F.hex(c["check"])))), ";")
    return F.concat(F.size(entries).cast("string"), F.lit("|"), F.array_join(F.transform(cells, shown), "|"))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next): each row and the text of the next doc_id; the first one after the last."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.coalesce("doc_id", F.lit(-(2**63))))
    splits = range_splits(rows, "k")
    rows = rows.withColumn("b", range_bucket(F.col("k"), splits))
    heads = {r["b"]: r["k"] for r in rows.groupBy("b").agg(F.min("k").alias("k")).collect()}  # a row for each bucket
    if not heads:
        return rows.select("doc_id", "text", F.col("text").alias("next"))
    order = sorted(heads)
    seen_by = F.create_map(*[F.lit(x) for b, before in zip(order, [order[-1], *order[:-1]], strict=True) for x in (heads[b], before)])
    copies = rows.where(F.col("k").isin([heads[b] for b in order])).withColumns({"b": F.element_at(seen_by, F.col("k")), "copy": (F.col("k") == heads[order[0]]).cast("int") + 1})
    by = Window.partitionBy("b").orderBy("copy", "k", "text")
    both = rows.withColumn("copy", F.lit(0)).unionByName(copies)
    return both.withColumn("next", F.lead("text").over(by)).where("copy = 0").select("doc_id", "text", "next")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and how many paragraphs the edited text
    lacks and adds (n_gone, n_come), for each row of docs."""
    n = F.char_length("text")
    # what is not needed any more (the texts) is dropped at once
    rows = with_next(docs).withColumn("edited", F.concat(F.expr("substring(text, 1, char_length(text) - int(floor(char_length(text) / 2)))"), F.expr("substring(next, 1, int(floor(char_length(text) / 2)))")))
    rows = rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), paragraphs(F.col("text")).alias("own"), paragraphs(F.col("edited")).alias("new"), paragraphs(F.col("next")).alias("nxt")
    )
    rows = rows.select("*", *[sketches(F.col(c)).alias(f"{c}_cells") for c in ("own", "new", "nxt")])
    rows = rows.select("*", *[compared(F.col("own"), F.col(c), F.col("own_cells"), F.col(f"{c}_cells")).alias(f"to_{c}") for c in ("new", "nxt")])
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own"), F.col("own_cells")).alias("fingerprint"), fingerprint(F.col("new"), F.col("new_cells")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new"), F.col("to_new")).alias("near_edited"), likeness(F.col("own"), F.col("nxt"), F.col("to_nxt")).alias("near_next"),
        F.size("to_new.gone").cast("long").alias("n_gone"), F.size("to_new.come").cast("long").alias("n_come"),
    )


def op4_lookup_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))
