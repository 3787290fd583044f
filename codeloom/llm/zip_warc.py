"""WARC records in ZIP-packaged archives, written by tasks and read by ranges, never extracted.

An archive is a ZIP file with two stored (uncompressed) members: `archive/data.warc.gz`, in which each record is a gzip member of
its own, and `indexes/index.cdxj`, a line for each record with its offset and length. Its end can hold the ZIP64 records.

Writing: each task streams its rows into one archive in the shared folder, under a name of its own, and returns a manifest row
when the file is closed. Only archives of the written manifest count, so what a lost executor or a repeated task left is never read.

Reading: the end record, the ZIP64 locator and record and the central directory of each archive are read by ranges
(`directory`), its members are found by their local headers, and the index is cut into ranges of about `RANGE` bytes of
neighbouring records. The ranges are dealt out evenly; each is one range read, and every record in it is checked against its digest.

Equal payloads of at least `LEAST` bytes are stored once: the row with the smallest page_id is the response, others are revisits,
which carry the digest and refer to it. `read_archives` gives what stands in the archives, `resolved` adds the payload sizes of
revisits by a join with the responses' digests.

Edge cases: null html is an empty payload; an empty payload is a response of 0 bytes; repeated rows of the smallest page_id are
responses each, repeated rows of another are revisits each; a null page_id is never the smallest unless all of a payload's are
null (then they are responses); a null url has no target line; line breaks in a url are percent-encoded; extra columns, whatever
their names, are left out; an empty table gives an archive without records or none, and an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import give_back, new_path, partitions, read, written

#: Payloads of fewer bytes are never revisits.
LEAST = 100
#: Bytes of neighbouring records that one range read fetches; a longer record is a range of its own.
RANGE = 4_000_000
#: Bytes of payloads that a batch of rows from a range may hold.
BATCH = 8_000_000
LEVEL = 3
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: The tables have no fetch times, so records carry this one.
DATE = "2024-01-01T00:00:00Z"
#: Signatures and sizes of ZIP structures (fixed values).
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
LOCAL_SIZE, CENTRAL_SIZE, END_SIZE, END64_SIZE, LOCATOR64_SIZE = 30, 46, 22, 56, 20
MANIFEST = "archive string, size long, records long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload binary"


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored: int  # bytes in the archive
    header: int  # offset of its local header


def opened(path: str):
    """(file system, path in it) of a file's URI. Pyarrow's file systems read by ranges and write streams, wherever the folder is."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def url_line(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit holds no payload, but its digest."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {url_line(url)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[int | None, str | None, str, int | None, str, bytes | None]:
    """(page_id, url, type, refers_to, digest, payload) of one record's bytes."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or lines[0] != "WARC/1.1":
        raise ValueError("no WARC record begins here")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
    digest, payload = fields["WARC-Payload-Digest"].removeprefix("sha256:"), None
    if fields["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} was altered")
    return number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Type"], number(fields.get("WARC-Refers-To")), digest, payload


def index_line(url: str | None, offset: int, length: int) -> bytes:
    return f"{(url_line(url or '-').replace(' ', '%20')) or '-'} {DATE} {json.dumps({'offset': offset, 'length': length, 'filename': DATA})}\n".encode()


class Archive:
    """Streams records into one ZIP file; only the index lines are kept until the end. The data's size is unknown before, so
    its local header always has the ZIP64 field."""

    def __init__(self, sink):
        self.zip = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.out, self.lines, self.at = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True), [], 0

    def add(self, data: bytes, url: str | None) -> None:
        packed = gzip.compress(data, LEVEL, mtime=0)
        self.lines.append(index_line(url, self.at, len(packed)))
        self.out.write(packed)
        self.at += len(packed)

    def close(self) -> None:
        self.out.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as out:
            out.writelines(self.lines)
        self.zip.close()


def first_pages(pages: DataFrame) -> DataFrame:
    """(payload_digest, first, n): payloads that more than one row has, with the smallest page_id. Groups are counted before they
    are shuffled, so a payload of a third of all rows is a few rows here."""
    rows = pages.where(F.octet_length("payload") >= LEAST)
    return rows.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first")


def write_archives(pages: DataFrame, where: str) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) into archives below where; returns their manifest."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    told = rows.join(first_pages(rows), "payload_digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    told = told.select("page_id", "url", "payload_digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"), F.when(~revisit, F.col("payload")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, count, archive = f"{where}/{uuid.uuid4().hex}.wacz", 0, None
        for batch in batches:
            if archive is None:
                files, path = opened(name)
                files.create_dir(path.rsplit("/", 1)[0], recursive=True)
                sink = files.open_output_stream(path)
                archive = Archive(sink)
            for row in zip(*(batch.column(c) for c in range(6)), strict=True):
                page_id, url, digest, refers_to, again, payload = (x.as_py() for x in row)
                archive.add(record(page_id, url, payload or b"", digest, refers_to, again), url)
            count += batch.num_rows
        if archive is not None:
            archive.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"archive": [name], "size": [files.get_file_info(path).size], "records": [count]}, pa.schema([("archive", pa.string()), ("size", pa.int64()), ("records", pa.int64())]))
        give_back()

    return written(told.mapInArrow(run, MANIFEST), "manifest")


Reader = Callable[[int, int], bytes]


def end_of(read_at: Reader, size: int) -> tuple[int, int, int]:
    """(entries, directory size, directory offset) from the end record, or from the ZIP64 record where the locator names one."""
    tail_at = max(0, size - END_SIZE - 65535 - LOCATOR64_SIZE)
    tail = read_at(tail_at, size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (len(tail) - at < END_SIZE or struct.unpack_from("<H", tail, at + 20)[0] != len(tail) - at - END_SIZE):
        at = tail.rfind(END, 0, at)  # a comment may hold the signature
    if at < 0:
        raise ValueError("the archive has no end record")
    disk, first_disk, here, entries, length, start = struct.unpack_from("<4H2I", tail, at + 4)
    if at >= LOCATOR64_SIZE and tail[at - LOCATOR64_SIZE : at - LOCATOR64_SIZE + 4] == LOCATOR64:
        record_disk, record_at, disks = struct.unpack_from("<IQI", tail, at - LOCATOR64_SIZE + 4)
        if record_disk or disks > 1:
            raise ValueError("the archive is split over files")
        end64 = read_at(record_at, END64_SIZE)
        if end64[:4] != END64:
            raise ValueError("the ZIP64 end record is not where its locator says")
        disk, first_disk, here, entries, length, start = struct.unpack_from("<2I4Q", end64, 16)
    if disk or first_disk or here != entries:
        raise ValueError("the archive is split over files")
    if start + length > size:
        raise ValueError("the directory lies beyond the archive's end")
    return entries, length, start


def directory(read_at: Reader, size: int) -> list[Member]:
    """The members of a ZIP file that read_at(offset, length) reads."""
    entries, length, start = end_of(read_at, size)
    data, at, found = read_at(start, length), 0, []
    for _ in range(entries):
        if data[at : at + 4] != CENTRAL or at + CENTRAL_SIZE > length:
            raise ValueError("the directory is damaged")
        flags, method = struct.unpack_from("<2H", data, at + 8)
        packed, plain, n_name, n_extra, n_comment, disk = struct.unpack_from("<2I4H", data, at + 20)
        header = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + CENTRAL_SIZE : at + CENTRAL_SIZE + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, k = data[at + CENTRAL_SIZE + n_name :][:n_extra], 0
        while k + 4 <= len(extra):
            kind, n = struct.unpack_from("<2H", extra, k)
            if kind == 1:  # the ZIP64 field has only those numbers, in this order, that the entry has no room for
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                plain, packed, header = (next(wide) if v == 0xFFFFFFFF else v for v in (plain, packed, header))
            k += 4 + n
        if flags & 1:
            raise ValueError(f"{name} is encrypted")
        found.append(Member(name, method, plain, packed, header))
        at += CENTRAL_SIZE + n_name + n_extra + n_comment
    return found


def start_of(read_at: Reader, member: Member) -> int:
    """Where a stored member's bytes begin: behind its local header, whose lengths may differ from the directory's."""
    if member.method != zipfile.ZIP_STORED or member.size != member.stored:
        raise ValueError(f"{member.name} is not stored plainly, so it has no ranges")
    head = read_at(member.header, LOCAL_SIZE)
    if head[:4] != LOCAL:
        raise ValueError(f"{member.name} has no local header")
    return member.header + LOCAL_SIZE + sum(struct.unpack_from("<2H", head, 26))


def ranges_of(lines: bytes, start: int, most: int = RANGE) -> Iterator[tuple[int, list[int]]]:
    """(offset in the archive, lengths) of runs of neighbouring records, from the lines of an index."""
    at, lengths = None, []
    for line in lines.splitlines():
        place = json.loads(line.split(b" ", 2)[2])
        if lengths and (start + place["offset"] != at + sum(lengths) or sum(lengths) + place["length"] > most):
            yield at, lengths
            lengths = []
        if not lengths:
            at = start + place["offset"]
        lengths.append(place["length"])
    if lengths:
        yield at, lengths


def archive_ranges(manifest: DataFrame) -> DataFrame:
    """(archive, offset, lengths): what to read of each archive. Only directories and indexes are read here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("lengths", pa.list_(pa.int64()))])
        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files, path = opened(name)
                with files.open_input_file(path) as file:
                    read_at = lambda offset, length: file.read_at(length, offset)  # noqa: B023, E731
                    members = {m.name: m for m in directory(read_at, file.size())}
                    index = members[INDEX]
                    found = list(ranges_of(read_at(start_of(read_at, index), index.size), start_of(read_at, members[DATA])))
                if sum(len(x) for _, x in found) != records:
                    raise ValueError(f"the index of {name} does not have its {records} records")
                yield pa.RecordBatch.from_pydict({"archive": [name] * len(found), "offset": [x[0] for x in found], "lengths": [x[1] for x in found]}, schema)

    return manifest.select("archive", "records").mapInArrow(run, "archive string, offset long, lengths array<long>")


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row for each record of the archives: page_id, url, record_type, refers_to, payload_digest, payload (null for revisits)."""
    spark = manifest.sparkSession
    dealt = archive_ranges(manifest.repartition(partitions(spark), "archive")).repartition(partitions(spark), F.xxhash64("archive", "offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload"]
        for batch in batches:
            for name, offset, lengths in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                files, path = opened(name)
                with files.open_input_file(path) as file:
                    data = file.read_at(sum(lengths), offset)
                at, rows, held = 0, [], 0
                for n in [*lengths, None]:
                    if rows and (n is None or held > BATCH):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, held = [], 0
                    if n is not None:
                        rows.append(parsed(zlib.decompress(data[at : at + n], 31)))
                        held += len(rows[-1][5] or b"")
                        at += n
        give_back()

    return dealt.mapInArrow(run, RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """records without payloads, with payload_bytes: a revisit has those of the response that it refers to. A revisit whose response
    is in no archive is an error."""
    slim = records.select("page_id", "url", "record_type", "refers_to", "payload_digest", F.octet_length("payload").cast("long").alias("own_bytes"))
    slim = written(slim, "records")
    first = slim.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("own_bytes").alias("held"))
    lost = F.raise_error(F.concat(F.lit("no response has the payload "), F.col("payload_digest"))).cast("long")
    again = slim.where("record_type = 'revisit'").join(first, "payload_digest", "left").withColumn("payload_bytes", F.coalesce("held", lost)).drop("held", "own_bytes")
    plain = slim.where("record_type = 'response'").withColumnRenamed("own_bytes", "payload_bytes")
    return plain.unionByName(again)


def op11_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(read(spark, sf_dir, "pages"), new_path(spark, "archives"))
    return resolved(read_archives(manifest)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP11_SQL = f"""
  WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
  f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
  SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN payload_bytes >= {LEAST} AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= {LEAST} AND page_id IS DISTINCT FROM first THEN first END AS refers_to
  FROM f"""
