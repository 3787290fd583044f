"""Token ids in a content-addressed store.

Documents are encoded with the tokenizers library, each followed by an end id, and cut into chunks where a rolling
hash of the last `WINDOW` ids says so. The store has three Parquet datasets:

* `placed`: in `kind=chunk` each distinct chunk once: its SHA-256 address, length and ids (little-endian unsigned
  integers); in `kind=use` a row for each chunk of each document;
* `recipes`: one row for each document, in ascending doc_id order over the files: its chunks' addresses. A file has about
  `FILE_DOCS` documents or `FILE_CHUNKS` chunks, so there are more files, never larger ones, where there is more text;
* `manifest`: one row for each recipe file: its number of documents and ids, and the Merkle root of its documents
  (a document's leaf is the SHA-256 of its id and its addresses).

Reading checks every chunk against its address and every recipe file against its root, so a lost or altered chunk is
an error, never a wrong text.

Encoding keeps a bounded table of ids by chunk of text between blanks: the vocabulary's rules never join ids across a
blank, so equal pieces have equal ids. Every piece is encoded by the library.

Edge cases: null text is empty and has only the end id; null doc_ids come first; repeated doc_ids are documents
of their own, in the order of a hash of their texts; extra columns, whatever their names, are left out; an empty table gives empty
datasets and an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.common import give_back, new_path, partitions, read

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
WINDOW, MEAN, LEAST, MOST = 8, 256, 64, 2048
#: Pieces of text whose ids a task keeps, and the longest of them.
KNOWN, LONGEST = 450_000, 64
#: Documents and chunks of a recipe file, and the files of which a row may be sent to every executor.
FILE_DOCS, FILE_CHUNKS, FEW = 10_000, 50_000, 100_000
#: Multiplier of the rolling hash, and the mask that a boundary's hash has none of.
FACTOR, MASK = np.uint64(0x9E3779B97F4A7C15), np.uint64(MEAN - 1)
CRC_POLY = 0xEDB88320


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


#: A word of Latin letters (without the dotted capital I, whose lower case is two), and a mark after it.
WORD = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([.,]?)").fullmatch
#: A Latin letter and a mark before a blank or the end: no id spans the two, so a blank may part them.
MARKED = "([A-Za-zÀ-ÖØ-öø-įı-ɏ])([.,])( |$)"
#: Bytes of text that are encoded together, some batches of Spark: each distinct piece of these is looked up once.
SLICE = 34_000_000


class Encoder:
    """Ids of whole texts, by way of the pieces between blanks and line ends. Two tables of at most `known` pieces
    each are kept: a full one becomes the old one, and what is used again moves to the new one."""

    def __init__(self, path: str, known: int = KNOWN):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; the library's threads only get in each other's way
        self.tokenizer, self.known, self.old, self.most = Tokenizer.from_file(path), {}, {}, known
        self.wide = self.tokenizer.get_vocab_size() > 65536
        self.type, self.code = (np.dtype("<u4"), "I") if self.wide else (np.dtype("<u2"), "H")
        self.tokenize = self.tokenizer.model.tokenize  # asked for once: each look at .model makes an object
        self.ends = {e: self.of([e])[0] for e in (".", ",")}
        # how the library writes the bytes of a lower-case Latin letter before its merges
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {i: spell.pre_tokenize_str(chr(i))[0][0] for i in range(0x250) if chr(i).isalpha() and chr(i).lower() == chr(i)}

    def of(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.type).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def of_word(self, word: str) -> bytes:
        """Of one lower-case Latin word: nothing is left for the normaliser and the splitter to do."""
        spelled = word if word.isascii() else word.translate(self.letters)
        return array(self.code, [t.id for t in self.tokenize(spelled)]).tobytes()

    def learn(self, pieces: list[str]) -> None:
        """Ids of new pieces. A Latin word's letters and the full stop or comma after it never share an id, and
        case is dropped by the vocabulary's normaliser."""
        known, old, ends, rest = self.known, self.old, self.ends, []
        for p in pieces:
            if p.isascii() and p.isalpha():  # most pieces
                word = p.lower()
                ids = known.get(word)
                if ids is None:
                    ids = old.get(word)
                    known[word] = ids = self.of_word(word) if ids is None else ids
                known[p] = ids
                continue
            m = WORD(p)
            word, end = m.groups() if m else ("", "")
            word = word.lower()
            # some capitals of the range have lower-case letters beyond it, which only the library spells
            if not m or not (word.isascii() or self.letters.keys() >= set(map(ord, word))):
                ids = old.get(p)
                if ids is None:
                    rest.append(p)
                else:
                    known[p] = ids
                continue
            ids = known.get(word)
            if ids is None:
                ids = old.get(word)
                known[word] = ids = self.of_word(word) if ids is None else ids
            known[p] = ids + ends[end] if end else ids
        known.update(zip(rest, self.of(rest), strict=True))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of an Arrow array of strings. Arrow numbers its distinct pieces, so Python touches each of them once."""
        spaced = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), MARKED, r"\1 \2\3")
        lists = pc.split_pattern(spaced, " ")
        coded, offsets = lists.flatten().dictionary_encode(), lists.offsets.to_numpy()
        del spaced, lists
        if len(self.known) > self.most:
            self.known, self.old = {}, self.known
        known, pieces = self.known, coded.dictionary.to_pylist()
        self.learn([p for p in pieces if p not in known])
        held = list(map(known.__getitem__, pieces))
        for k in np.flatnonzero(pc.binary_length(coded.dictionary).to_numpy() > LONGEST):
            if len(pieces[k]) > LONGEST:
                known.pop(pieces[k], None)
        size = np.fromiter(map(len, held), np.int64, len(held)) // self.type.itemsize
        start, flat, at = np.cumsum(size) - size, np.frombuffer(b"".join(held), dtype=self.type), coded.indices.to_numpy()
        n = size[at]
        ends = np.concatenate(([0], np.cumsum(n)))
        place = np.repeat(start[at] - ends[:-1], n)
        place += np.arange(ends[-1])
        ids = flat[place]
        cut = ends[offsets].tolist()
        return [ids[lo:hi] for lo, hi in zip(cut[:-1], cut[1:], strict=True)]


def slices(texts: pa.Array) -> list[tuple[int, int]]:
    """(first row, rows) of runs of rows with about `SLICE` bytes of text; a longer text is in a run with few others."""
    group = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE
    first = np.flatnonzero(np.diff(group, prepend=-1))
    return list(zip(first.tolist(), np.diff(np.append(first, len(texts))).tolist(), strict=True))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches, as many in one as have at most `SLICE` bytes of text together; a larger one alone."""
    held, size = [], 0
    for batch in batches:
        own = pc.sum(pc.binary_length(batch.column(3))).as_py() or 0
        if held and size + own > SLICE:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += own
    if held:
        yield pa.concat_batches(held)


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(path)


def marks(ids: np.ndarray) -> np.ndarray:
    """Places after ids whose rolling hash has no bit of MASK."""
    n = len(ids)
    x = (ids.astype(np.uint64) + np.uint64(1)) * FACTOR
    h = np.zeros(n, np.uint64)
    for j in range(min(WINDOW, n)):
        h[j:] += x[: n - j] << np.uint64(5 * j) | x[: n - j] >> np.uint64(64 - 5 * j) if j else x
    return np.flatnonzero(((h >> np.uint64(40)) & MASK) == 0) + 1


def ends_at(found: list[int], n: int) -> list[int]:
    """Ends of the chunks of n ids, from the places of `marks`: none shorter than LEAST or longer than MOST."""
    ends, last = [], 0
    for m in [*found, n]:
        while m - last > MOST:
            last += MOST
            ends.append(last)
        if m - last >= LEAST or m == n:
            if m > last:
                ends.append(m)
            last = m
    return ends


def cuts(ids: np.ndarray) -> np.ndarray:
    return np.array(ends_at(marks(ids).tolist(), len(ids)))


def all_cuts(documents: list[np.ndarray]) -> list[list[int]]:
    """`cuts` of each document, hashed together: a hash that reaches into the document before is within WINDOW of the start, where LEAST forbids a cut."""
    size = np.fromiter(map(len, documents), np.int64, len(documents))
    start = np.cumsum(size) - size
    found = marks(np.concatenate(documents))
    at = np.searchsorted(found, np.append(start, size.sum()), side="right").tolist()
    return [ends_at((found[lo:hi] - begin).tolist(), n) for lo, hi, begin, n in zip(at[:-1], at[1:], start.tolist(), size.tolist(), strict=True)]


@lru_cache(maxsize=1)
def crc_tables() -> np.ndarray:
    """For each power of two of zero bytes, what it does to the four bytes of a CRC-32 (a linear map, by tables)."""
    one = [CRC_POLY] + [1 << i for i in range(31)]  # the 32 columns for one zero bit
    columns = lambda m: np.array(m, np.uint32)

    def table(m: np.ndarray) -> np.ndarray:
        out = np.zeros((4, 256), np.uint32)
        for byte in range(4):
            for bit in range(8):
                out[byte] ^= np.where((np.arange(256) >> bit) & 1, m[8 * byte + bit], 0).astype(np.uint32)
        return out

    m = columns(one)
    tables = []
    for k in range(40):
        t = table(m)
        if k >= 3:
            tables.append(t)
        m = mapped(t, m)  # twice as many zero bits
    return np.stack(tables)


def mapped(table: np.ndarray, v: np.ndarray) -> np.ndarray:
    return table[0][v & 255] ^ table[1][(v >> 8) & 255] ^ table[2][(v >> 16) & 255] ^ table[3][v >> 24]


def joined_crc(crc: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """CRC-32 of each document, from the CRCs and byte lengths of its parts; first: where each document's parts begin.
    It is the XOR of every part's CRC, moved over the bytes that follow it in the document."""
    total = np.cumsum(size)
    last = np.append(first[1:], len(size)) - 1
    after = np.repeat(total[last], np.diff(np.append(first, len(size)))) - total
    v = crc.astype(np.uint32)
    for bit, table in enumerate(crc_tables()):
        on = np.flatnonzero((after >> bit) & 1)
        if len(on):
            v[on] = mapped(table, v[on])
    return np.bitwise_xor.reduceat(v, first)


def leaf(doc_id: int | None, addresses: list[bytes]) -> bytes:
    return hashlib.sha256(b"\0" + str(doc_id).encode() + b"\0" + b"".join(addresses)).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    while len(leaves) > 1:
        leaves = [hashlib.sha256(b"\1" + b"".join(leaves[i : i + 2])).digest() for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else hashlib.sha256(b"\2").digest()


def encode_chunks(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Rows (doc_id, order, uid, chunk, address, n, ids): one use without ids for each chunk of each document, and the
    ids once for each chunk that a task meets for the first time (it remembers `KNOWN` addresses)."""

    def run(batches):
        encoder, seen = encoder_of(path), set()
        end = np.array([end_id], dtype=encoder.type)
        for batch in gathered(batches):
            for lo, n in slices(batch.column(3)):
                part = batch.slice(lo, n)
                rows, chunks, addresses, sizes, data = [], [], [], [], []
                whole = [np.concatenate((found, end)) for found in encoder.encode(part.column(3))]
                for i, (found, ends) in enumerate(zip(whole, all_cuts(whole), strict=True)):
                    at = 0
                    for k, to in enumerate(ends):
                        ids = found[at:to].tobytes()
                        address = hashlib.sha256(ids).digest()
                        for content in [None] if address in seen else [None, ids]:
                            rows.append(i)
                            chunks.append(k)
                            addresses.append(address)
                            sizes.append(to - at)
                            data.append(content)
                        if len(seen) >= KNOWN:
                            seen.clear()
                        seen.add(address)
                        at = to
                take = pa.array(rows, pa.int32())
                columns = [*(part.column(c).take(take) for c in range(3)), pa.array(chunks, pa.int32()), pa.array(addresses, pa.binary()), pa.array(sizes, pa.int32()), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "order", "uid", "chunk", "address", "n", "ids"])
        give_back()

    return docs.mapInArrow(run, "doc_id long, order long, uid long, chunk int, address binary, n int, ids binary")


def write_store(docs: DataFrame, where: str, path: str, end_id: int = END_ID) -> None:
    """Writes the three datasets below where. Ids cross the network once, on their way to their chunk's file."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("order"), F.monotonically_increasing_id().alias("uid"), text.alias("text"))
    parts = encode_chunks(rows, path, end_id)
    # uses are spread evenly; all copies of one chunk's ids meet, and the first is kept
    parts = parts.withColumn("at", F.when(F.col("ids").isNull(), F.xxhash64("uid", "chunk")).otherwise(F.xxhash64("address")))
    first = F.row_number().over(Window.partitionBy("at", "address", F.col("ids").isNull()).orderBy("doc_id"))
    placed = parts.repartition(partitions(spark), "at").withColumn("copy", first).where("ids is null or copy = 1")
    kind = F.when(F.col("ids").isNull(), "use").otherwise("chunk")
    placed.select("doc_id", "order", "uid", "chunk", "address", "n", "ids", kind.alias("kind")).write.option("compression", "zstd").partitionBy("kind").parquet(f"{where}/placed")
    uses = read_placed(spark, where).where("kind = 'use'")
    one = uses.groupBy("doc_id", "order", "uid").agg(F.array_sort(F.collect_list(F.struct("chunk", "address", "n"))).alias("c"))
    n = uses.agg(F.ceil(F.greatest(F.count_if(F.col("chunk") == 0) / FILE_DOCS, F.count("*") / FILE_CHUNKS)).cast("int").alias("n")).first()["n"]
    recipes = one.select("doc_id", "order", "uid", F.transform("c", lambda c: c["address"]).alias("addresses"), F.transform("c", lambda c: c["n"]).alias("sizes"))
    recipes = recipes.repartitionByRange(max(1, n or 0), F.asc_nulls_first("doc_id"), "order", "uid").withColumn("file", F.spark_partition_id())
    recipes.sortWithinPartitions(F.asc_nulls_first("doc_id"), "order", "uid").write.parquet(f"{where}/recipes")
    read_recipes(spark, where).groupBy("file").applyInPandas(summed_up, "file int, n_docs long, n_ids long, root binary").write.parquet(f"{where}/manifest")


def read_recipes(spark: SparkSession, where: str) -> DataFrame:
    return spark.read.schema("doc_id long, order long, uid long, addresses array<binary>, sizes array<int>, file int").parquet(f"{where}/recipes")


def read_placed(spark: SparkSession, where: str) -> DataFrame:
    return spark.read.schema("doc_id long, order long, uid long, chunk int, address binary, n int, ids binary, kind string").parquet(f"{where}/placed")


def read_chunks(spark: SparkSession, where: str) -> DataFrame:
    return read_placed(spark, where).where("kind = 'chunk'").select("address", "n", "ids")


def in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["doc_id", "order", "uid"], na_position="first", kind="stable")


def summed_up(pdf: pd.DataFrame) -> pd.DataFrame:
    """The manifest row of one recipe file."""
    pdf = in_order(pdf)
    leaves = [leaf(None if pd.isna(d) else int(d), list(a)) for d, a in zip(pdf["doc_id"], pdf["addresses"], strict=True)]
    return pd.DataFrame({"file": [int(pdf["file"].iloc[0])], "n_docs": [len(pdf)], "n_ids": [int(sum(sum(s) for s in pdf["sizes"]))], "root": [merkle_root(leaves)]})


def chunk_sums(chunks: DataFrame, width: int) -> DataFrame:
    """(address, size, crc): each stored chunk, after its ids were checked against its address; ids as 32-bit integers."""

    def run(batches):
        for batch in batches:
            address, size, crc = batch.column(0), [], []
            for a, data in zip(address.to_pylist(), batch.column(1).to_pylist(), strict=True):
                if hashlib.sha256(data).digest() != a:
                    raise ValueError(f"the ids of chunk {a.hex()} were altered")
                ids = np.frombuffer(data, dtype=f"<u{width}")
                size.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([address, pa.array(size, pa.int32()), pa.array(crc, pa.int64())], names=["address", "size", "crc"])

    return chunks.select("address", "ids").mapInArrow(run, "address binary, size int, crc long")


def check_file(pdf: pd.DataFrame) -> pd.DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of one recipe file's documents, after its root was checked."""
    pdf = in_order(pdf)
    leaves, counts, crc, size = [], [], [], []
    for d, parts in zip(pdf["doc_id"], pdf["parts"], strict=True):
        parts = sorted(parts, key=lambda p: p["pos"])
        if any(p["size"] is None or p["size"] != p["n"] for p in parts):
            raise ValueError(f"a chunk of document {d} is missing")
        leaves.append(leaf(None if pd.isna(d) else int(d), [p["address"] for p in parts]))
        counts.append(len(parts))
        crc += [p["crc"] for p in parts]
        size += [p["size"] for p in parts]
    first = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
    size = np.array(size, np.int64)
    n, sums = np.add.reduceat(size, first), joined_crc(np.array(crc, np.int64), 4 * size, first)
    row = pdf.iloc[0]
    if len(pdf) != row["n_docs"] or n.sum() != row["n_ids"] or merkle_root(leaves) != row["root"]:
        raise ValueError(f"recipe file {row['file']} does not match its manifest")
    start = row["base"] + np.concatenate(([0], np.cumsum(n)[:-1]))
    return pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "start": start.astype("int64"), "n_tokens": n.astype("int64"), "ids_crc32": sums.astype("int64")})


def read_back(spark: SparkSession, where: str, width: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document. A document's CRC is joined from its chunks', so
    the ids themselves are read where they lie and never shuffled."""
    manifest = spark.read.schema("file int, n_docs long, n_ids long, root binary").parquet(f"{where}/manifest")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each recipe file
    manifest = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))
    uses = read_recipes(spark, where).select("doc_id", "order", "uid", "file", F.posexplode(F.arrays_zip(F.col("addresses").alias("address"), F.col("sizes").alias("n"))).alias("pos", "c"))
    uses = uses.select("doc_id", "order", "uid", "file", "pos", "c.address", "c.n")
    parts = uses.join(chunk_sums(read_chunks(spark, where), width), "address", "left")
    one = parts.groupBy("file", "doc_id", "order", "uid").agg(F.collect_list(F.struct("pos", "address", "n", "size", "crc")).alias("parts"))
    manifest = F.broadcast(manifest) if manifest.limit(FEW + 1).count() <= FEW else manifest.hint("merge")
    return one.join(manifest, "file").groupBy("file").applyInPandas(check_file, "doc_id long, start long, n_tokens long, ids_crc32 long")


def ids_of(spark: SparkSession, where: str, width: int) -> DataFrame:
    """(doc_id, ids): the documents' ids, rebuilt from the store."""
    uses = read_recipes(spark, where).select("doc_id", "uid", F.posexplode("addresses").alias("pos", "address"))
    parts = uses.join(read_chunks(spark, where).select("address", "ids"), "address").groupBy("doc_id", "uid").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("p"))
    whole = F.array_join(F.transform("p", lambda p: F.hex(p["ids"])), "")
    step = 2 * width
    little = lambda h: F.conv(F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(width))]), 16, 10).cast("int")
    cells = F.when(F.char_length("w") > 0, F.transform(F.regexp_extract_all(F.col("w"), F.lit(f".{{{step}}}"), F.lit(0)), little)).otherwise(F.array().cast("array<int>"))
    return parts.select("doc_id", whole.alias("w")).select("doc_id", cells.alias("ids"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    where, path = new_path(spark, "store"), tokenizer_path()
    write_store(read(spark, sf_dir, "documents"), where, path)
    return read_back(spark, where, Encoder(path, 0).type.itemsize)
