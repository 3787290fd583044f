"""Choosing rows: exercises, attempts, citations, uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions import text as T
from codeloom.operators.packing import FEW, greedy_packed
from codeloom.operators.running import in_ranges, sum_before


def best_exercise(requests: DataFrame, exercises: DataFrame) -> DataFrame:
    """(request_id, id, matched): of the exercises in the language and difficulty the one with most concepts in common."""
    both = requests.join(exercises, ["language", "difficulty"], "left").withColumn("matched", F.array_sort(F.array_intersect("available", "concepts")))
    best = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc(F.size("matched")), "id"))
    kind = F.when(F.col("id").isNull(), "no_match").when(F.size("matched") > 0, "concept").otherwise("general")
    return both.withColumn("n", best).where("n = 1").select("request_id", "id", kind.alias("kind"), F.array_join("matched", ",").alias("matched"))


def first_valid(attempts: DataFrame) -> DataFrame:
    """(request_id, attempt, mode): the first attempt that was valid; the last one, as failed, if none was."""
    got = attempts.groupBy("request_id").agg(F.min(F.when(F.col("valid"), F.col("attempt"))).alias("good"), F.max("attempt").alias("last"))
    return got.select("request_id", F.coalesce("good", "last").alias("attempt"), F.when(F.col("good").isNull(), "failed").when(F.col("good") == 1, "first").otherwise("retried").alias("mode"))


def clamped(citations: DataFrame, excerpts: DataFrame) -> DataFrame:
    """Citations (id, file, start, end) cut to the first excerpt (file, ord, a, z) of their file that they touch; others go."""
    both = citations.join(excerpts, "file").where((F.col("end") >= F.col("a")) & (F.col("start") <= F.col("z")))
    first = F.row_number().over(Window.partitionBy("id").orderBy("ord"))
    return both.withColumn("n", first).where("n = 1").select("id", "file", F.greatest("start", "a").alias("start"), F.least("end", "z").alias("end"))


def quota(items: DataFrame, most_files: int, most_bytes: int, *keys: str, few: int = FEW) -> DataFrame:
    """(keys, ord, taken): files taken in order while there are fewer than most_files and the bytes still fit; a file
    that does not fit uses up nothing. What the bytes alone let through decides which are the first most_files."""
    packed = greedy_packed(items, most_bytes, "size", ["ord"], *keys, few=few)
    rows = in_ranges(packed.withColumn("one", F.col("placed").cast("long")), list(keys), ["ord"])
    counted = sum_before(rows, list(keys), ["ord"], "one", "n")
    return counted.select(*keys, "ord", (F.col("placed") & (F.col("n") < most_files)).alias("taken"))


def case_clashes(paths: DataFrame) -> DataFrame:
    """(project_id, path, twice, folder): paths (project_id, path) that an earlier one (by path) equals but for case or composition, and files
    whose path is also a folder of another one, in the same sense."""
    key = T.caseless(F.col("path"))
    rows = paths.distinct().withColumns({"key": key, "nth": F.row_number().over(Window.partitionBy("project_id", key).orderBy("path"))})
    parts = paths.select("project_id", F.split("path", "/").alias("p")).where(F.size("p") > 1)
    above = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda k: F.array_join(F.slice("p", F.lit(1), k), "/"))
    folders = parts.select("project_id", F.explode(above).alias("f")).distinct().select("project_id", T.caseless(F.col("f")).alias("key")).distinct().withColumn("folder", F.lit(True))
    told = rows.join(folders, ["project_id", "key"], "left")
    return told.select("project_id", "path", (F.col("nth") > 1).alias("twice"), F.coalesce("folder", F.lit(False)).alias("folder"))


def review_sheet(items: DataFrame, seed: int, key: str) -> DataFrame:
    """items in an order that the seed decides, with blind ids A001, A002, ... Places are counted over ranges of the order."""
    dealt = items.withColumns({"_place": F.md5(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}"))), "_one": F.lit(1)})
    counted = sum_before(in_ranges(dealt, [], ["_place", key]), [], ["_place", key], "_one", "_n")
    return counted.withColumn("sheet_id", F.format_string("A%03d", (F.col("_n") + 1).cast("int"))).drop("_place", "_one", "_n", "bucket")


def unknown_names(answers: DataFrame, known: DataFrame) -> DataFrame:
    """(id, name): names in answers (id, text) that no source (text) has."""
    words = lambda df, *keep: df.select(*keep, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_]\w{2,}"), F.lit(0)))).alias("name"))
    return words(answers, "id").join(words(known).distinct(), "name", "left_anti").select("id", "name")
