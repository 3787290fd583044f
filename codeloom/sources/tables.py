"""The driver's tables as files of source projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, project_id, path, text, size_bytes): each document as a file; kinds and folders by its number."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    ends = F.array(*[F.lit(e) for e in (".py", ".JS", ".css", ".html", ".txt", ".min.js", ".jsx")])
    folder = F.when(i % 10 == 3, "node_modules").when(i % 10 == 7, "Dist").otherwise(F.col("lang"))
    name = F.when(i % 31 == 0, "package-lock.json").otherwise(F.concat(F.lit("f"), i.cast("string"), F.element_at(ends, (i % 7 + 1).cast("int"))))
    return d.select("doc_id", F.col("source").alias("project_id"), F.concat_ws("/", "source", folder, name).alias("path"), "text", F.octet_length("text").cast("long").alias("size_bytes"))


def discovered(files: DataFrame) -> DataFrame:
    """files with language, reason (null: analysed) and line_count."""
    lang = T.language(F.col("path"))
    reason = F.coalesce(T.path_verdict(F.col("path"), F.col("size_bytes")), F.when(T.looks_minified(F.col("text"), lang, F.col("size_bytes")), "minified"))
    return files.withColumns({"language": lang, "reason": reason, "line_count": T.line_count(F.col("text"))})


#: The same files in SQL.
FILES_SQL = """files AS (
  SELECT doc_id, source AS project_id, text, CAST(strlen(text) AS BIGINT) AS size_bytes,
         source || '/' || CASE WHEN doc_id % 10 = 3 THEN 'node_modules' WHEN doc_id % 10 = 7 THEN 'Dist' ELSE lang END || '/' ||
         CASE WHEN doc_id % 31 = 0 THEN 'package-lock.json' ELSE 'f' || doc_id || ['.py', '.JS', '.css', '.html', '.txt', '.min.js', '.jsx'][CAST(doc_id % 7 + 1 AS INTEGER)] END AS path
  FROM documents
), told AS (
  SELECT *, CASE WHEN doc_id % 31 = 0 THEN NULL ELSE ['python', 'javascript', 'css', 'html', NULL, 'javascript', 'javascript'][CAST(doc_id % 7 + 1 AS INTEGER)] END AS language,
         CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN suffix(text, chr(10)) THEN 1 ELSE 0 END END AS line_count,
         list_transform(string_split(text, chr(10)), lambda x: length(x)) AS widths,
         list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: length(x)) AS full_widths
  FROM files
), judged AS (
  SELECT *, CASE WHEN doc_id % 10 IN (3, 7) THEN 'ignored_directory' WHEN doc_id % 31 = 0 THEN 'generated_file' WHEN doc_id % 7 = 5 THEN 'minified'
                 WHEN doc_id % 7 = 4 THEN 'unsupported_extension' WHEN size_bytes > 524288 THEN 'too_large'
                 WHEN language IN ('javascript', 'css') AND (list_max(widths) > 1000 OR (size_bytes >= 2000 AND list_sum(full_widths) > 200 * len(full_widths))) THEN 'minified' END AS reason
  FROM told
)"""
