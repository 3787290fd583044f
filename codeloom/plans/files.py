"""Queries over files: discovery, sizes, token costs and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.sources.tables import FILES_SQL, discovered, files, table

NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
#: Terms of the glossary query: (group, pattern), common in the synthetic texts (fixed values).
TERMS = [("the", "the"), ("of", "of"), ("of", "off"), ("and", "and"), ("license", "licen[sc]ed?"), ("que", "que"), ("der", "der|die|das"), ("was", "was"), ("en", "en"), ("not", "not|nicht|pas|no")]
COST_SQL = r"""CASE WHEN regexp_matches(u, '^[A-Za-z]') THEN CASE WHEN length(u) <= 12 THEN CAST(ceil(length(u) / 2.5) AS BIGINT) * 100 ELSE length(u) * 60 END
     WHEN regexp_matches(u, '^[ \t][0-9]$') THEN 200 WHEN regexp_matches(u, '^[0-9\n\x21-\x7e]$') THEN 100 WHEN regexp_matches(u, '^[ \t\r\f\x0B]') THEN 15 WHEN strlen(u) >= 4 THEN 200 ELSE 125 END"""
UNITS_SQL = r"[A-Za-z]+|[ \t][0-9]|[0-9]|\n|[ \t\r\f\x0B]+|[\x21-\x7e]|[^\x00-\x7f]"
TOKENS_SQL = rf"""CAST(ceil(coalesce(list_sum(list_transform(regexp_extract_all(text, '[ \t]?[A-Za-z0-9+/=_\-]{{16,}}|{UNITS_SQL}'), lambda w:
  CASE WHEN regexp_matches(w, '^[ \t]?[A-Za-z0-9+/=_\-]{{16,}}$') AND regexp_matches(w, '[0-9]') AND regexp_matches(w, '[A-Za-z]') THEN 100 * length(ltrim(w)) + CASE WHEN length(ltrim(w)) < length(w) THEN 15 ELSE 0 END
       ELSE list_sum(list_transform(regexp_extract_all(w, '{UNITS_SQL}'), lambda u: {COST_SQL})) END)), 0) / 100.0) AS BIGINT)"""


def src15_discovery_split(spark, sf_dir):
    return discovered(files(spark, sf_dir)).select("doc_id", "path", "language", "reason", "line_count", "size_bytes")


def flt1_path_verdict(spark, sf_dir):
    f = files(spark, sf_dir)
    return f.groupBy(F.coalesce(T.path_verdict(F.col("path"), F.col("size_bytes"), 10_000), F.lit("candidate")).alias("verdict")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def flt3_line_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.line_count(F.col("text")).alias("lines"))


def mth1_token_cost(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_cost(F.col("text")).alias("tokens"))


def agg1_summary(spark, sf_dir):
    kept = discovered(files(spark, sf_dir)).where(F.col("reason").isNull())
    return kept.groupBy("project_id", "language").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.sum("line_count").alias("lines"), F.sum(T.token_cost(F.col("text"))).alias("tokens"))


def agg6_stats(spark, sf_dir):
    return discovered(files(spark, sf_dir)).groupBy("project_id").agg(
        F.count("*").alias("files"), F.count_if(F.col("reason").isNull()).alias("analysed"), F.count_if(F.col("reason").isNotNull()).alias("excluded"), F.sum(F.when(F.col("reason").isNull(), F.col("size_bytes")).otherwise(0)).alias("source_bytes")
    )


def str1_clip(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clipped(F.col("text"), 120).alias("clipped"))


def str2_prose_clip(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.clipped_prose(F.col("text"), 160).alias("clipped"))


def str7_identifiers(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", T.identifiers(F.col("text")).alias("w"))
    return found.select("doc_id", F.size("w").cast("long").alias("uses"), F.size(F.array_distinct("w")).cast("long").alias("names"))


def str12_glossary(spark, sf_dir):
    """The first 8 groups of terms of each text, by place; a group counts once."""
    t = F.col("text")
    found = F.array(*[F.struct(F.regexp_instr(t, F.lit(rf"(?i)(?<![A-Za-z0-9_])(?:{p})(?![A-Za-z0-9_])")).alias("at"), F.lit(k).alias("k"), F.lit(g).alias("term")) for k, (g, p) in enumerate(TERMS)])
    names = F.transform(F.array_sort(F.filter(found, lambda x: x["at"] > 0)), lambda x: x["term"])
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(F.array_distinct(names), 1, 8), ",").alias("terms"))


def hsh1_file_ids(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", T.uuid5(NAMESPACE, F.concat_ws(":", "project_id", "path")).alias("file_id"))


def pth4_tree(spark, sf_dir):
    parts = F.split("path", "/")
    rows = files(spark, sf_dir).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("path"), F.array_join(F.slice(parts, F.lit(1), k - 1), "/").alias("parent"), k.alias("depth"), F.when(k == F.size(parts), "file").otherwise("directory").alias("type")))).alias("n"))
    return rows.groupBy("n.path", "n.parent", F.col("n.depth").cast("long").alias("depth"), "n.type").agg(F.count("*").alias("files"))


def src4_safe_path(spark, sf_dir):
    i = F.col("page_id")
    shapes = [F.concat(F.lit("a\\b/"), i.cast("string")), F.concat(F.lit("../"), i.cast("string")), F.concat(F.lit("/abs"), i.cast("string")), F.concat(F.lit("C:x"), i.cast("string")), F.concat(F.lit("a//b"), i.cast("string")), F.concat(F.lit("dir/"), i.cast("string"), F.lit("/")), F.concat(F.lit("end. /"), i.cast("string")), F.concat(F.lit("t\tab"), i.cast("string"))]
    raw = F.element_at(F.array(*shapes), (i % len(shapes) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", T.safe_path(raw).alias("path"))


def pth1_normal_path(spark, sf_dir):
    i = F.col("page_id").cast("string")
    shapes = [F.concat(F.lit("a/./b/../"), i), F.concat(F.lit("../x/"), i), F.concat(F.lit("./"), i), F.concat(F.lit("a/b/../../../"), i), F.concat(F.lit("a//"), i), F.lit("a/..")]
    return table(spark, sf_dir, "pages").select("page_id", T.normal_path(F.element_at(F.array(*shapes), (F.col("page_id") % len(shapes) + 1).cast("int"))).alias("path"))


GLOSSARY_SQL = ", ".join(f"{{'pos': CASE WHEN regexp_matches(text, '(?is)(^|[^A-Za-z0-9_])({p})([^A-Za-z0-9_]|$)') THEN length(regexp_extract(text, '(?is)^(.*?)(^|[^A-Za-z0-9_])({p})([^A-Za-z0-9_]|$)', 1)) + length(regexp_extract(text, '(?is)^(.*?)(^|[^A-Za-z0-9_])({p})([^A-Za-z0-9_]|$)', 2)) ELSE -1 END, 'k': {k}, 'term': '{g}'}}" for k, (g, p) in enumerate(TERMS))

QUERIES = {f.__name__: f for f in (src15_discovery_split, flt1_path_verdict, flt3_line_count, mth1_token_cost, agg1_summary, agg6_stats, str1_clip, str2_prose_clip, str7_identifiers, str12_glossary, hsh1_file_ids, pth4_tree, src4_safe_path, pth1_normal_path)}
ORACLES = {
    "src15_discovery_split": f"WITH {FILES_SQL} SELECT doc_id, path, language, reason, CAST(line_count AS BIGINT) AS line_count, size_bytes FROM judged",
    "flt1_path_verdict": f"""WITH {FILES_SQL} SELECT verdict, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM (
      SELECT size_bytes, CASE WHEN doc_id % 10 IN (3, 7) THEN 'ignored_directory' WHEN doc_id % 31 = 0 THEN 'generated_file' WHEN doc_id % 7 = 5 THEN 'minified' WHEN language IS NULL THEN 'unsupported_extension'
             WHEN size_bytes > 10000 THEN 'too_large' ELSE 'candidate' END AS verdict FROM told) GROUP BY 1""",
    "flt3_line_count": "SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN suffix(text, chr(10)) THEN 1 ELSE 0 END END AS BIGINT) AS lines FROM documents",
    "mth1_token_cost": f"SELECT doc_id, {TOKENS_SQL} AS tokens FROM documents",
    "agg1_summary": f"WITH {FILES_SQL} SELECT project_id, language, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, CAST(sum(line_count) AS BIGINT) AS lines, CAST(sum({TOKENS_SQL}) AS BIGINT) AS tokens FROM judged WHERE reason IS NULL GROUP BY 1, 2",
    "agg6_stats": f"WITH {FILES_SQL} SELECT project_id, count(*) AS files, count(*) FILTER (reason IS NULL) AS analysed, count(*) FILTER (reason IS NOT NULL) AS excluded, CAST(coalesce(sum(size_bytes) FILTER (reason IS NULL), 0) AS BIGINT) AS source_bytes FROM judged GROUP BY 1",
    "str1_clip": r"SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE substr(t, 1, 117) || '...' END AS clipped FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)",
    "str2_prose_clip": r"""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations),
      d AS (SELECT *, substr(t, 1, 159) AS cut, length(regexp_extract(substr(t, 1, 159), '^(.*) [^ ]*$', 1)) AS pos FROM c)
      SELECT conv_id, turn, CASE WHEN length(t) < 160 AND length(t) >= 156 AND NOT regexp_matches(t, '[.!?)`"'']$') THEN regexp_replace(t, '[ ,;:-]+$', '') || '…' WHEN length(t) < 160 THEN t
        ELSE regexp_replace(CASE WHEN contains(cut, ' ') AND pos >= 80 THEN substr(cut, 1, pos) ELSE cut END, '[ ,;:-]+$', '') || '…' END AS clipped FROM d""",
    "str7_identifiers": "SELECT doc_id, CAST(len(w) AS BIGINT) AS uses, CAST(len(list_distinct(w)) AS BIGINT) AS names FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*') AS w FROM documents)",
    "str12_glossary": f"""WITH f AS (SELECT doc_id, unnest([{GLOSSARY_SQL}]) AS x FROM documents), g AS (SELECT doc_id, x.term AS term, min(x.pos) AS pos, arg_min(x.k, x.pos) AS k FROM f WHERE x.pos >= 0 GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, k) AS n FROM g)
      SELECT d.doc_id, coalesce(t.terms, '') AS terms FROM documents d LEFT JOIN (SELECT doc_id, string_agg(term, ',' ORDER BY n) AS terms FROM r WHERE n <= 8 GROUP BY 1) t USING (doc_id)""",
    "hsh1_file_ids": f"""WITH {FILES_SQL}, h AS (SELECT doc_id, sha1(unhex('{NAMESPACE.replace("-", "")}') || encode(project_id || ':' || path)) AS h FROM files)
      SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS file_id FROM h""",
    "pth4_tree": f"""WITH {FILES_SQL}, p AS (SELECT string_split(path, '/') AS parts, unnest(range(1, len(string_split(path, '/')) + 1)) AS k FROM files)
      SELECT array_to_string(parts[1:k], '/') AS path, array_to_string(parts[1:k - 1], '/') AS parent, CAST(k AS BIGINT) AS depth, CASE WHEN k = len(parts) THEN 'file' ELSE 'directory' END AS type, count(*) AS files FROM p GROUP BY ALL""",
    "src4_safe_path": "SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'a/b/' || page_id WHEN 5 THEN 'dir/' || page_id END AS path FROM pages",
    "pth1_normal_path": "SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'a/' || page_id WHEN 1 THEN '../x/' || page_id WHEN 2 THEN page_id::VARCHAR WHEN 3 THEN '../' || page_id WHEN 4 THEN 'a/' || page_id ELSE '.' END AS path FROM pages",
}
