"""Project archives: ZIP members as rows, and the checks that refuse an archive."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions import text as T

MEMBERS = "project_id string, ord int, path string, size long, compressed_size long, encrypted boolean, method int, error string"
LIMITS = {"archive_bytes": 10 << 20, "entries": 500, "total": 25 << 20, "entry": 5 << 20, "ratio": 100, "ratio_floor": 64 << 10}


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(project_id, length, content) of the ZIP files below path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path).select(F.regexp_extract("path", r"([^/]*)\.zip$", 1).alias("project_id"), "length", "content")


def members(archives: DataFrame) -> DataFrame:
    """A row for each entry, from the directory alone; a file that is no archive is one row with an error."""

    def run(parts):
        for pdf in parts:
            rows = []
            for project, content in zip(pdf["project_id"], pdf["content"], strict=True):
                try:
                    entries = zipfile.ZipFile(io.BytesIO(content)).infolist()
                    rows += [(project, i, e.orig_filename, e.file_size, e.compress_size, bool(e.flag_bits & 1), e.compress_type, None) for i, e in enumerate(entries)]
                except (zipfile.BadZipFile, ValueError, OSError) as e:
                    rows.append((project, 0, None, None, None, None, None, f"INVALID_ARCHIVE: {type(e).__name__}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MEMBERS.split(", ")]).astype({"size": "Int64", "compressed_size": "Int64", "method": "Int32"})

    return archives.select("project_id", "content").mapInPandas(run, MEMBERS)


def verdicts(rows: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """(project_id, code): the first failed check of each archive in the order of entries and checks; null if none."""
    safe = T.safe_path(F.col("path"))
    folded = T.caseless(safe)
    by = Window.partitionBy("project_id")
    run = by.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    checked = rows.withColumns({"safe": safe, "twice": F.count("*").over(Window.partitionBy("project_id", folded).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)) > 1, "total": F.sum("size").over(run), "n": F.count("*").over(by)})
    code = (
        F.when(F.col("error").isNotNull(), "INVALID_ARCHIVE").when(F.col("n") > limits["entries"], "TOO_MANY_ENTRIES").when(F.col("encrypted"), "ENCRYPTED").when(~F.col("method").isin(0, 8), "UNSUPPORTED_COMPRESSION")
        .when(F.col("safe").isNull(), "UNSAFE_PATH").when(F.col("twice"), "DUPLICATE_PATH").when(F.col("size") > limits["entry"], "ENTRY_TOO_LARGE").when(F.col("total") > limits["total"], "TOO_LARGE")
        .when((F.col("size") >= limits["ratio_floor"]) & (F.col("size") > limits["ratio"] * F.greatest(F.col("compressed_size"), F.lit(1))), "SUSPICIOUS_COMPRESSION")
    )
    return checked.withColumn("code", code).groupBy("project_id").agg(F.min_by("code", F.when(F.col("code").isNotNull(), F.col("ord"))).alias("code"))


def read_members(archives: DataFrame, keep: DataFrame) -> DataFrame:
    """(project_id, path, text) of the members in keep (project_id, path): only those are decompressed."""
    wanted = keep.groupBy("project_id").agg(F.collect_set("path").alias("paths"))

    def run(parts):
        for pdf in parts:
            rows = []
            for project, content, paths in zip(pdf["project_id"], pdf["content"], pdf["paths"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows += [(project, p, z.read(p)) for p in sorted(paths)]
            yield pd.DataFrame(rows, columns=["project_id", "path", "data"])

    raw = archives.join(wanted, "project_id").select("project_id", "content", "paths").mapInPandas(run, "project_id string, path string, data binary")
    return raw.withColumn("reason", T.decode_verdict(F.col("data"))).select("project_id", "path", "reason", F.when(F.col("reason").isNull(), T.normal_lines(F.decode("data", "UTF-8"))).alias("text"))
