"""Queries over requests about files of rendered projects: what to show, in tiers, and what of it fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import context as C
from codeloom.operators import graph as G
from codeloom.operators import packing
from codeloom.sources import modules as M
from codeloom.sources.tables import table

MODULE = [
    "from m%2$d import f%2$d, g%2$d", "import m%3$d", "LIMIT = %1$d", "", "def f%1$d(a):", "    return f%2$d(a)", "", "def g%1$d(a):", "    return g%2$d(m%3$d.f%3$d(LIMIT))", "", "class K%1$d:", "    def run(self, b):",
    "        return f%1$d(b)",
]


def project_files(spark, sf_dir):
    """A module for each part, a project for each hundred of them; each imports the next one and the seventh after it."""
    k = F.col("p_partkey")
    text = F.format_string("\n".join(MODULE), k, k + 1, k + 7)
    return table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.floor(k / 100).cast("string")).alias("project_id"), F.format_string("m%d.py", k).alias("path"), text.alias("text"), F.lit(len(MODULE)).alias("line_count"), k)


def focus_requests(spark, sf_dir):
    k = F.col("p_partkey")
    symbol = F.when(k % 30 == 0, F.concat(F.lit("f"), k.cast("string"))).when(k % 70 == 0, F.lit("gone"))
    rows = project_files(spark, sf_dir).where(k % 10 == 0)
    return rows.select(k.alias("request_id"), "project_id", "path", F.when(k % 20 == 0, "debug").otherwise("explain").alias("intent"), symbol.alias("symbol"))


def candidates(spark, sf_dir):
    files, k = project_files(spark, sf_dir), F.col("p_partkey")
    nodes = M.module_nodes(files)
    found = M.module_symbols(nodes).withColumnsRenamed({"name": "qualified"})
    parent = F.when(F.contains("qualified", F.lit(".")), F.regexp_replace("qualified", r"\.[^.]*$", ""))
    symbols = found.select("project_id", "path", F.regexp_replace("qualified", r"^.*\.", "").alias("name"), "qualified", "kind", "start", "end", parent.alias("parent"))
    refs = M.module_refs(nodes).withColumnRenamed("path", "source").withColumn("id", F.concat_ws("|", "source", "line", "specifier"))
    edges = G.resolve_modules(refs.select("id", "project_id", "source", "specifier", "names", "level", "line"), files.select("project_id", "path", F.lit(None).cast("string").alias("reason")), [])
    edges = edges.where("target is not null").select("project_id", "source", "target").distinct()
    entries = files.where(k % 50 == 3).select("project_id", "path", F.lit("main_guard").alias("reason"))
    return C.focused_candidates(focus_requests(spark, sf_dir), files.select("project_id", "path", "line_count"), symbols, C.words_of(files), edges, entries)


def ctx3_candidates(spark, sf_dir):
    return candidates(spark, sf_dir).select("request_id", "step", "kind", "path", "start", "end", "tier", "reason", "symbol", "primary")


def ctx9_packed(spark, sf_dir):
    """What fits into 40 lines of each request: an outline counts two, code its lines and one."""
    cost = F.when(F.col("kind") == "outline", 2).otherwise(F.col("end") - F.col("start") + 2)
    rows = candidates(spark, sf_dir).withColumn("cost", cost)
    order = ["step", "place", "path", "start", "end", "kind"]
    placed = packing.greedy_packed(rows, 40, "cost", order, "request_id").where("placed").drop("placed")
    held = placed.withColumn("lines", F.when(F.col("kind") == "outline", 2).otherwise(F.col("end") - F.col("start") + 2))
    return held.groupBy("request_id").agg(F.count("*").alias("shown"), F.sum("lines").cast("long").alias("lines"), F.count_if(F.col("kind") == "code").alias("code"), F.max("step").cast("long").alias("last_step"))


QUERIES = {f.__name__: f for f in (ctx3_candidates, ctx9_packed)}
CANDIDATES_SQL = """k AS (SELECT p_partkey AS k, p_partkey // 100 AS p FROM part), q AS (SELECT k, p, k % 20 = 0 AS debug, k % 30 = 0 AS sym FROM k WHERE k % 10 = 0 AND (k % 70 <> 0 OR k % 30 = 0)),
  e AS (SELECT a.k AS s, b.k AS t, a.p FROM k a JOIN k b ON a.p = b.p AND b.k IN (a.k + 1, a.k + 7)),
  g AS (SELECT k.k, k.p, row_number() OVER (PARTITION BY k.p ORDER BY count(s) DESC, 'm' || k.k || '.py') AS nth FROM k LEFT JOIN e ON e.t = k.k GROUP BY k.k, k.p QUALIFY nth <= 20),
  u AS (
    SELECT k AS r, 0 AS step, 0 AS place, 'code' AS kind, k AS f, CASE WHEN sym THEN 5 ELSE 1 END AS a, CASE WHEN sym THEN 6 ELSE 13 END AS z, 0 AS tier, CASE WHEN sym THEN 'selected symbol' ELSE 'selected file' END AS reason, CASE WHEN sym THEN 'f' || k END AS symbol, NOT sym AS prim FROM q
    UNION ALL SELECT k, 1, 0, 'code', k, 1, 2, 1, 'header (imports) of the selected file', NULL, false FROM q WHERE sym
    UNION ALL SELECT q.k, 2, 0, 'code', t, 5, 6, 1, 'implementation used by the selected code', 'f' || t, false FROM q JOIN e ON e.s = q.k WHERE debug AND (NOT sym OR t = q.k + 1)
    UNION ALL SELECT q.k, 2, 0, 'code', t, 8, 9, 1, 'implementation used by the selected code', 'g' || t, false FROM q JOIN e ON e.s = q.k WHERE debug AND NOT sym AND t = q.k + 1
    UNION ALL SELECT q.k, CASE WHEN debug THEN 3 ELSE 2 END, 0, 'outline', t, 0, 0, CASE WHEN debug THEN 3 ELSE 1 END, CASE WHEN debug THEN 'direct dependency (outline)' ELSE 'direct dependency' END, NULL, false FROM q JOIN e ON e.s = q.k
    UNION ALL SELECT q.k, 4, 0, 'code', s, 5, 6, 2, 'uses the selected code', 'f' || s, false FROM q JOIN e ON e.t = q.k WHERE s = q.k - 1
    UNION ALL SELECT q.k, 4, 0, 'code', s, 8, 9, 2, 'uses the selected code', 'g' || s, false FROM q JOIN e ON e.t = q.k WHERE s = q.k - 7 OR NOT sym
    UNION ALL SELECT q.k, 5, 0, 'outline', k.k, 0, 0, 3, 'entry point: main_guard', NULL, false FROM q JOIN k ON k.p = q.p AND k.k % 50 = 3 AND k.k <> q.k
    UNION ALL SELECT k, 6, 0, 'outline', k, 0, 0, 3, 'other symbols in the selected file', NULL, false FROM q WHERE sym
    UNION ALL SELECT k, 7, 0, 'code', k, 8, 9, 4, 'neighbouring symbol', 'g' || k, false FROM q WHERE sym AND debug
    UNION ALL SELECT q.k, 8, nth, 'outline', g.k, 0, 0, 4, 'project file', NULL, false FROM q JOIN g ON g.p = q.p AND g.k <> q.k),
  c AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY r, kind, f, a, z ORDER BY step, place) = 1)"""
ORACLES = {
    "ctx3_candidates": f"WITH {CANDIDATES_SQL} SELECT r AS request_id, step, kind, 'm' || f || '.py' AS path, a AS start, z AS \"end\", tier, reason, symbol, prim AS \"primary\" FROM c",
    "ctx9_packed": f"""WITH RECURSIVE {CANDIDATES_SQL}, o AS (SELECT r, step, kind, CASE kind WHEN 'outline' THEN 2 ELSE z - a + 2 END AS cost, row_number() OVER (PARTITION BY r ORDER BY step, place, 'm' || f || '.py', a, z, kind) AS n FROM c),
      w AS (SELECT r, n, step, kind, cost, cost <= 40 AS placed, CASE WHEN cost <= 40 THEN cost ELSE 0 END AS used FROM o WHERE n = 1
        UNION ALL SELECT o.r, o.n, o.step, o.kind, o.cost, w.used + o.cost <= 40, CASE WHEN w.used + o.cost <= 40 THEN w.used + o.cost ELSE w.used END FROM w JOIN o ON o.r = w.r AND o.n = w.n + 1)
      SELECT r AS request_id, count(*) AS shown, CAST(sum(cost) AS BIGINT) AS lines, count(*) FILTER (kind = 'code') AS code, CAST(max(step) AS BIGINT) AS last_step FROM w WHERE placed GROUP BY 1""",
}
