"""Queries over dependency graphs and recorded answers, on references derived from the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.operators import evidence as E
from codeloom.operators import graph as G
from codeloom.session import spread
from codeloom.sources.tables import table

STDLIB = ["os", "sys", "json", "re"]
TARGET = "(l_partkey * 7 + l_suppkey) % 2100"
KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def module_files(spark, sf_dir, end):
    """One file for each part but every tenth; of the rest every tenth is left out."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").where(k % 10 != 0)
    return rows.select(F.lit("all").alias("project_id"), F.format_string(f"pkg%d/m%d{end}", k % 7, k).alias("path"), F.when(k % 10 == 1, "ignored_directory").alias("reason"))


def line_refs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return spread(li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), li.count(), "l_orderkey").distinct().withColumns({"s": F.col("l_partkey"), "t": F.expr(TARGET), "id": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "project_id": F.lit("all")})


def script_edges(spark, sf_dir):
    n, t = F.col("l_linenumber"), F.col("t")
    spec = (
        F.when(n == 1, F.format_string("./../pkg%d/m%d", t % 7, t)).when(n == 2, F.format_string("../pkg%d/m%d.js", t % 7, t)).when(n == 3, F.format_string("lib%d/x", F.col("l_suppkey"))).when(n == 4, "node:fs")
        .when(n == 5, "https://x.org/y.js").when(n == 6, F.format_string("/pkg%d/m%d", t % 7, t)).otherwise("@/alias")
    )
    refs = line_refs(spark, sf_dir).select("id", "project_id", F.format_string("pkg%d/m%d.js", F.col("s") % 7, F.col("s")).alias("source"), spec.alias("specifier"))
    return G.resolve_scripts(refs, module_files(spark, sf_dir, ".js"))


def jn1_resolve_scripts(spark, sf_dir):
    return script_edges(spark, sf_dir).groupBy("source", "specifier", "status", "target", "external_kind").agg(F.count("*").alias("refs"))


def jn3_resolve_modules(spark, sf_dir):
    n, t = F.col("l_linenumber"), F.col("t")
    spec = F.when(n == 1, F.format_string("pkg%d.m%d", t % 7, t)).when(n.isin(2, 6), "").when(n == 3, "os.path").when(n == 4, "numpy").when(n == 5, F.format_string("pkg%d", t % 7)).otherwise("src_gone.m")
    names = F.when(n.isin(2, 6), F.array(F.format_string("m%d", t))).otherwise(F.array().cast("array<string>"))
    refs = line_refs(spark, sf_dir).select("id", "project_id", F.format_string("pkg%d/m%d.py", F.col("s") % 7, F.col("s")).alias("source"), spec.alias("specifier"), names.alias("names"), F.when(n == 2, 1).when(n == 6, 3).otherwise(0).alias("level"), n.alias("line"))
    edges = G.resolve_modules(refs, module_files(spark, sf_dir, ".py"), STDLIB)
    return edges.groupBy("source", "specifier", "status", "target", "external_kind").agg(F.count("*").alias("refs"))


def jn2_resolve_web(spark, sf_dir):
    i = F.col("page_id")
    pages = table(spark, sf_dir, "pages").select("page_id")
    files = pages.select(F.lit("all").alias("project_id"), F.format_string("w%d/p%d.html", i % 5, i).alias("path"), F.when(i % 9 == 0, "too_large").alias("reason"))
    spec = (
        F.when(i % 6 == 0, F.format_string("p%d.html?x=1#y", i + 5)).when(i % 6 == 1, "/w0/p5.html").when(i % 6 == 2, "mailto:x@y.org").when(i % 6 == 3, "//cdn.org/x.js").when(i % 6 == 4, "../../out.css")
        .otherwise(F.format_string("../w%d/%%70%d.html", (i + 1) % 5, i + 1))
    )
    refs = pages.select(i.cast("string").alias("id"), F.lit("all").alias("project_id"), F.format_string("w%d/p%d.html", i % 5, i).alias("source"), spec.alias("specifier"))
    return G.resolve_web(refs, files).select("source", "specifier", "status", "target")


def jn6_missing(spark, sf_dir):
    return script_edges(spark, sf_dir).where("status = 'missing'").groupBy("source").agg(F.countDistinct("specifier").alias("missing"))


def agg3_degrees(spark, sf_dir):
    edges = script_edges(spark, sf_dir)
    return G.degrees(module_files(spark, sf_dir, ".js").where("reason is null").select(F.col("path").alias("node")), edges)


def agg4_externals(spark, sf_dir):
    return G.externals(script_edges(spark, sf_dir)).select("kind", "name", F.size("files").cast("long").alias("users"), F.element_at("files", 1).alias("first"))


def grf4_entry_points(spark, sf_dir):
    k = F.col("s_suppkey")
    names = F.element_at(F.array(*[F.lit(x) for x in ("main.py", "app.js", "util.py", "index.html", "about.html", "__main__.py", "server.mjs")]), (k % 7 + 1).cast("int"))
    files = table(spark, sf_dir, "supplier").select(F.lit("all").alias("project_id"), F.concat(F.lit("d"), k.cast("string"), F.lit("/"), names).alias("path"), k)
    files = files.withColumn("language", F.when(k % 7 == 3, "html").when(k % 7 == 4, "html").when((k % 7).isin(1, 6), "javascript").otherwise("python"))
    edges = files.where(k % 3 == 0).select("project_id", F.lit("x").alias("source"), F.col("path").alias("target"), F.lit("resolved").alias("status"))
    return G.entry_points(files, edges, files.where((k % 5 == 0) & (F.col("language") == "python"))).select("path", "reason")


def part_cycle_edges(spark, sf_dir):
    """Loops of three parts, with tails that lead into them."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    step = F.when(k % 9 == 2, k - 2).when(k % 9 < 2, k + 1).when(k % 9 == 5, k).otherwise(k - 1)
    return p.select(k.alias("source"), step.alias("target"))


def grf2_cycles(spark, sf_dir):
    return G.cycles(part_cycle_edges(spark, sf_dir)).select("component", "size", F.array_join(F.transform("files", lambda x: x.cast("string")), ",").alias("files"))


def grf3_hops(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select((F.col("l_partkey")).alias("source"), ((F.col("l_partkey") * 3 + F.col("l_linenumber")) % 4001).alias("target"))
    return G.distances(edges, 1).select("node", F.col("hops").cast("long").alias("hops"), "via")


def grf3_edges(spark, sf_dir):
    """Parts in rings of five, with a way across each second ring and one back from each third."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(k)
    ring = p.select(k.alias("source"), F.when(k % 5 == 4, k - 4).otherwise(k + 1).alias("target"))
    across = p.where((k % 10 == 1)).select(k.alias("source"), (k + 2).alias("target"))
    return ring.union(across).union(p.where(k % 15 == 2).select(k.alias("source"), (k - 2).alias("target"))).union(p.where(k % 35 == 0).select(k.alias("source"), k.alias("target")))


def grf3_loops(spark, sf_dir):
    found = G.loops(grf3_edges(spark, sf_dir))
    return found.select("component", "length", F.array_join(F.transform("files", lambda x: x.cast("string")), ",").alias("files"))


def grf6_relationships(spark, sf_dir):
    edges = script_edges(spark, sf_dir).withColumn("project_id", F.split("source", "/")[0])
    return G.relationships(edges).select("project_id", "source", "specifier", "status", F.col("place").cast("long").alias("place"))


def answer_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    lines = F.size(F.split("text", "\n", -1)) - F.when(F.endswith("text", F.lit("\n")), 1).otherwise(0)
    return d.select(F.concat(F.lit("d"), "doc_id").alias("path"), "doc_id", "text", lines.alias("line_count"), (F.col("doc_id") % 17 != 0).alias("kept"))


def drafts(spark, sf_dir):
    li = line_refs(spark, sf_dir)
    empty = F.col("l_partkey") % 50 == 0
    start = F.when(F.col("l_suppkey") % 10 == 0, 0).otherwise(F.col("l_partkey") % 12 + 1)
    end = F.when(F.col("l_suppkey") % 10 == 0, 0).otherwise(start + F.col("l_linenumber") - 1)
    return li.select("id", F.when(empty, "").otherwise(F.concat(F.lit("./d"), F.col("l_orderkey") % 1200)).alias("path"), start.alias("start"), end.alias("end"), F.when(F.col("l_linenumber") % 2 == 0, "finding").otherwise("explanation").alias("kind"))


def ver1_location(spark, sf_dir):
    files = answer_files(spark, sf_dir)
    shown = files.where("doc_id % 3 = 0").select("path", F.explode(F.array(*[F.struct(F.lit(a).alias("start"), F.lit(z).alias("end")) for a, z in ((1, 4), (6, 30))])).alias("r")).select("path", "r.start", "r.end")
    got = E.check_locations(drafts(spark, sf_dir), files.drop("doc_id"), shown, files.where("doc_id % 4 = 1").select("path"))
    return got.groupBy("kind", "location", "issue").agg(F.count("*").alias("drafts"), F.sum("start").alias("starts"))


def jn22_quotes(spark, sf_dir):
    return E.quotes_in(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def ver3_findings(spark, sf_dir):
    n = F.col("l_suppkey")
    rows = line_refs(spark, sf_dir).select(
        F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("ord"), "l_partkey", "l_suppkey", F.when(n % 4 != 0, F.concat(F.lit("f"), n % 3)).alias("path"), (n % 2).alias("start"), (n % 2 + 3).alias("end"), F.lit("logic").alias("category"),
        F.concat(F.lit(" Title "), (F.col("l_partkey") % 2).cast("string")).alias("title"), F.when(n % 3 == 0, "in_context").when(n % 3 == 1, "in_context").otherwise("rejected").alias("location"), (n % 3 == 0).alias("quote_ok"),
        F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (F.col("l_partkey") % 3 + 1).cast("int")).alias("confidence"),
    )
    rows = rows.withColumn("ord", F.row_number().over(Window.partitionBy("request_id").orderBy("ord", "l_partkey", "l_suppkey")))
    return E.survivors(E.verified(rows)).groupBy("finding_id", "verification", "confidence").agg(F.count("*").alias("findings"))


def tri2_tiers(spark, sf_dir):
    n = F.col("l_suppkey")
    rows = line_refs(spark, sf_dir).select(
        F.col("l_orderkey").alias("request_id"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).alias("ord"),
        F.element_at(F.array(F.lit("source_verified"), F.lit("hypothesis"), F.lit("unsupported")), (n % 3 + 1).cast("int")).alias("verification"), (n % 5 == 0).alias("in_demo"),
        F.when(n % 7 == 0, "Fails when the list is empty").otherwise("Wrong result").alias("title"), (n % 11 == 0).alias("corroborated"),
    )
    return E.tiered(rows).groupBy("tier", F.array_join("reasons", ",").alias("reasons"), F.col("place").cast("long").alias("place")).agg(F.count("*").alias("findings"))


def agg10_latency(spark, sf_dir):
    return E.latency(table(spark, sf_dir, "events"), "value", "event_type").select("event_type", "n", F.round("median", 6).alias("median"), F.round("p90", 6).alias("p90"), F.round("max", 6).alias("max"))


def agg8_rates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = d.select("lang", (F.col("toxic") == 1).alias("has_bug"), (F.col("n_chars") % 2 == 0).alias("reported"), (F.col("n_chars") % 5).alias("hits"), F.col("n_chars").alias("words"))
    return E.rates(rows, "lang")


def agg19_grade(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", E.grade(F.col("text")).alias("grade"))


def agg12_totals(spark, sf_dir):
    r = table(spark, sf_dir, "labels").rollup("quality").agg(F.count("*").alias("rows"), F.sum("toxic").alias("toxic"))
    return r.select(F.coalesce(F.col("quality").cast("string"), F.lit("TOTAL")).alias("quality"), "rows", "toxic")


QUERIES = {f.__name__: f for f in (jn1_resolve_scripts, jn2_resolve_web, jn3_resolve_modules, jn6_missing, agg3_degrees, agg4_externals, grf2_cycles, grf3_hops, grf3_loops, grf4_entry_points, grf6_relationships, ver1_location, ver3_findings, jn22_quotes, tri2_tiers, agg8_rates, agg10_latency, agg12_totals, agg19_grade)}
REFS_SQL = f"x AS (SELECT DISTINCT {KEYS}, l_partkey AS s, {TARGET} AS t FROM lineitem), y AS (SELECT x.*, p_partkey IS NOT NULL AND t % 10 <> 0 AS there, t % 10 <> 1 AS kept FROM x LEFT JOIN part ON p_partkey = t)"
SCRIPTS_SQL = f"""{REFS_SQL}, e AS (SELECT 'pkg' || (s % 7) || '/m' || s || '.js' AS source,
  CASE l_linenumber WHEN 1 THEN './../pkg' || (t % 7) || '/m' || t WHEN 2 THEN '../pkg' || (t % 7) || '/m' || t || '.js' WHEN 3 THEN 'lib' || l_suppkey || '/x' WHEN 4 THEN 'node:fs' WHEN 5 THEN 'https://x.org/y.js' WHEN 6 THEN '/pkg' || (t % 7) || '/m' || t ELSE '@/alias' END AS specifier,
  CASE WHEN l_linenumber IN (3, 4, 5) THEN 'external' WHEN l_linenumber = 7 THEN 'unresolved' WHEN there AND kept THEN 'resolved' WHEN there THEN 'excluded' WHEN l_linenumber = 6 THEN 'unresolved' ELSE 'missing' END AS status,
  CASE WHEN l_linenumber IN (1, 2, 6) AND there AND kept THEN 'pkg' || (t % 7) || '/m' || t || '.js' END AS target, CASE l_linenumber WHEN 3 THEN 'package' WHEN 4 THEN 'builtin' WHEN 5 THEN 'url' END AS external_kind FROM y)"""
ORACLES = {
    "jn1_resolve_scripts": f"WITH {SCRIPTS_SQL} SELECT *, count(*) AS refs FROM e GROUP BY ALL",
    "jn6_missing": f"WITH {SCRIPTS_SQL} SELECT source, count(DISTINCT specifier) AS missing FROM e WHERE status = 'missing' GROUP BY 1",
    "agg3_degrees": f"""WITH {SCRIPTS_SQL}, d AS (SELECT DISTINCT source, target FROM e WHERE target IS NOT NULL), n AS (SELECT 'pkg' || (p_partkey % 7) || '/m' || p_partkey || '.js' AS node FROM part WHERE p_partkey % 10 NOT IN (0, 1))
      SELECT node, (SELECT count(*) FROM d WHERE source = node) AS dependencies, (SELECT count(*) FROM d WHERE target = node) AS dependents FROM n""",
    "agg4_externals": f"WITH {SCRIPTS_SQL} SELECT external_kind AS kind, CASE external_kind WHEN 'url' THEN specifier WHEN 'builtin' THEN 'fs' ELSE split_part(specifier, '/', 1) END AS name, count(DISTINCT source) AS users, min(source) AS first FROM e WHERE status = 'external' GROUP BY 1, 2",
    "jn3_resolve_modules": f"""WITH {REFS_SQL}, e AS (SELECT 'pkg' || (s % 7) || '/m' || s || '.py' AS source, l_linenumber AS n, t, s, there, kept, there AND t % 7 = s % 7 AS near FROM y), f AS (SELECT source,
      CASE n WHEN 1 THEN 'pkg' || (t % 7) || '.m' || t WHEN 2 THEN CASE WHEN near THEN '.m' || t ELSE '.' END WHEN 3 THEN 'os.path' WHEN 4 THEN 'numpy' WHEN 5 THEN 'pkg' || (t % 7) WHEN 6 THEN '...' ELSE 'src_gone.m' END AS specifier,
      CASE WHEN n IN (1, 2) AND (n = 1 AND there OR n = 2 AND near) THEN CASE WHEN kept THEN 'resolved' ELSE 'excluded' END WHEN n IN (1, 2, 6) THEN 'missing' WHEN n = 5 THEN 'unresolved' ELSE 'external' END AS status,
      CASE WHEN (n = 1 AND there OR n = 2 AND near) AND kept THEN 'pkg' || (t % 7) || '/m' || t || '.py' END AS target, CASE n WHEN 3 THEN 'stdlib' WHEN 4 THEN 'package' WHEN 7 THEN 'package' END AS external_kind FROM e)
      SELECT *, count(*) AS refs FROM f GROUP BY ALL""",
    "jn2_resolve_web": """WITH p AS (SELECT page_id AS i, 'w' || (page_id % 5) || '/p' || page_id || '.html' AS source FROM pages), q AS (SELECT p.*, CASE i % 6 WHEN 0 THEN i + 5 WHEN 1 THEN 5 WHEN 5 THEN i + 1 END AS t FROM p WHERE i % 6 <> 2),
      r AS (SELECT q.*, o.i IS NOT NULL AS there FROM q LEFT JOIN p o ON o.i = q.t)
      SELECT source, CASE i % 6 WHEN 0 THEN 'p' || (i + 5) || '.html?x=1#y' WHEN 1 THEN '/w0/p5.html' WHEN 3 THEN '//cdn.org/x.js' WHEN 4 THEN '../../out.css' ELSE '../w' || ((i + 1) % 5) || '/%70' || (i + 1) || '.html' END AS specifier,
        CASE WHEN i % 6 = 3 THEN 'external' WHEN i % 6 = 4 THEN 'unresolved' WHEN there AND t % 9 = 0 THEN 'excluded' WHEN there THEN 'resolved' WHEN i % 6 = 1 THEN 'unresolved' ELSE 'missing' END AS status,
        CASE WHEN there AND t % 9 <> 0 THEN 'w' || (t % 5) || '/p' || t || '.html' END AS target FROM r""",
    "grf2_cycles": """WITH RECURSIVE e AS (SELECT p_partkey AS a, CASE WHEN p_partkey % 9 = 2 THEN p_partkey - 2 WHEN p_partkey % 9 < 2 THEN p_partkey + 1 WHEN p_partkey % 9 = 5 THEN p_partkey ELSE p_partkey - 1 END AS b FROM part),
      r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), s AS (SELECT x.a, x.b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a)
      SELECT DISTINCT min(b) AS component, count(*) AS size, string_agg(b::VARCHAR, ',' ORDER BY b) AS files FROM s GROUP BY a""",
    "grf3_hops": """WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, (l_partkey * 3 + l_linenumber) % 4001 AS b FROM lineitem), r(node, hops) AS (SELECT b, 1 FROM e WHERE a = 1 UNION SELECT e.b, hops + 1 FROM r JOIN e ON e.a = r.node WHERE hops < 30),
      d AS (SELECT node, min(hops) AS hops FROM r GROUP BY 1) SELECT d.node, CAST(d.hops AS BIGINT) AS hops, (SELECT min(e.a) FROM e LEFT JOIN d f ON f.node = e.a WHERE e.b = d.node AND (d.hops = 1 AND e.a = 1 OR d.hops > 1 AND f.hops = d.hops - 1)) AS via FROM d""",
    "grf3_loops": """WITH RECURSIVE e AS (
        SELECT p_partkey AS a, CASE WHEN p_partkey % 5 = 4 THEN p_partkey - 4 ELSE p_partkey + 1 END AS b FROM part UNION SELECT p_partkey, p_partkey + 2 FROM part WHERE p_partkey % 10 = 1
        UNION SELECT p_partkey, p_partkey - 2 FROM part WHERE p_partkey % 15 = 2 UNION SELECT p_partkey, p_partkey FROM part WHERE p_partkey % 35 = 0),
      r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), c AS (SELECT x.a, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
      w(component, node, path) AS (SELECT component, a, [a] FROM c WHERE a = component UNION ALL SELECT w.component, e.b, list_append(path, e.b) FROM w JOIN e ON e.a = w.node JOIN c ON c.a = e.b AND c.component = w.component WHERE NOT list_contains(path, e.b)),
      l AS (SELECT w.component, path FROM w JOIN e ON e.a = w.node AND e.b = w.component)
      SELECT component, CAST(len(path) AS BIGINT) AS length, array_to_string(path, ',') AS files FROM l QUALIFY row_number() OVER (PARTITION BY component ORDER BY len(path), path) = 1""",
    "grf4_entry_points": """WITH f AS (SELECT s_suppkey AS k, 'd' || s_suppkey || '/' || ['main.py', 'app.js', 'util.py', 'index.html', 'about.html', '__main__.py', 'server.mjs'][CAST(s_suppkey % 7 + 1 AS INTEGER)] AS path FROM supplier)
      SELECT path, reason FROM (SELECT path, CASE WHEN k % 7 IN (0, 2, 5) AND k % 5 = 0 THEN 'main_guard' WHEN k % 7 = 5 THEN 'package_main' WHEN k % 7 IN (0, 1, 6) AND k % 3 <> 0 THEN 'conventional_name' WHEN k % 7 = 3 THEN 'index_page' WHEN k % 7 = 4 AND k % 3 <> 0 THEN 'unreferenced_page' END AS reason FROM f) WHERE reason IS NOT NULL""",
    "grf6_relationships": f"""WITH {SCRIPTS_SQL}, p AS (SELECT DISTINCT split_part(source, '/', 1) AS project_id, source, specifier, status, target FROM e), u AS (SELECT project_id, target, count(DISTINCT source) AS dependents FROM p WHERE status = 'resolved' GROUP BY 1, 2)
      SELECT p.project_id, source, specifier, status, row_number() OVER (PARTITION BY p.project_id ORDER BY status <> 'missing', coalesce(dependents, 0) DESC, source, specifier) AS place FROM p LEFT JOIN u ON u.project_id = p.project_id AND u.target = p.target QUALIFY place <= 20""",
    "ver1_location": f"""WITH x AS (SELECT DISTINCT {KEYS} FROM lineitem), f AS (SELECT doc_id, string_split(text, chr(10)) AS ls, len(string_split(text, chr(10))) - CASE WHEN suffix(text, chr(10)) THEN 1 ELSE 0 END AS lc FROM documents),
      d AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'finding' ELSE 'explanation' END AS kind, l_partkey % 50 = 0 AS bare, l_orderkey % 1200 AS k, CASE WHEN l_suppkey % 10 = 0 THEN 0 ELSE l_partkey % 12 + 1 END AS a, CASE WHEN l_suppkey % 10 = 0 THEN 0 ELSE l_partkey % 12 + l_linenumber END AS z FROM x),
      g AS (SELECT d.*, f.doc_id, f.lc, k % 3 = 0 AS shown, k % 4 = 1 AS outlined, (a <= 4 OR z >= 6) AND a <= 30 AS near, len(list_filter(range(a, z + 1), lambda i: trim(ls[i]) <> '' AND NOT (k % 3 = 0 AND (i <= 4 OR i BETWEEN 6 AND 30)))) AS gaps FROM d LEFT JOIN f ON f.doc_id = k),
      h AS (SELECT kind, a, CASE WHEN bare AND a = 0 THEN ['none', CASE WHEN kind = 'finding' THEN 'NO_LOCATION' END] WHEN bare OR doc_id IS NULL THEN ['rejected', 'FILE_NOT_IN_PROJECT'] WHEN k % 17 = 0 THEN ['rejected', 'FILE_EXCLUDED']
        WHEN a = 0 AND kind = 'finding' THEN ['rejected', 'NO_LOCATION'] WHEN a = 0 AND (shown OR outlined) THEN ['file_only', NULL] WHEN a = 0 THEN ['rejected', 'LINES_NOT_IN_CONTEXT'] WHEN z > lc THEN ['rejected', 'LINES_OUT_OF_RANGE']
        WHEN gaps = 0 THEN ['in_context', NULL] WHEN outlined AND NOT (shown AND near) THEN ['rejected', 'LINES_OUTLINE_ONLY'] ELSE ['rejected', 'LINES_NOT_IN_CONTEXT'] END AS r FROM g)
      SELECT kind, r[1] AS location, r[2] AS issue, count(*) AS drafts, CAST(sum(a) AS BIGINT) AS starts FROM h GROUP BY ALL""",
    "ver3_findings": f"""WITH x AS (SELECT DISTINCT {KEYS} FROM lineitem), o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ord, l_suppkey AS n FROM x), k AS (SELECT *, CASE WHEN n % 4 <> 0 THEN 'f' || (n % 3) || (n % 2) ELSE 't' || (l_partkey % 2) END AS key,
      CASE n % 3 WHEN 0 THEN 'source_verified' WHEN 1 THEN 'hypothesis' ELSE 'unsupported' END AS verification, ['low', 'medium', 'high'][CAST(l_partkey % 3 + 1 AS INTEGER)] AS c FROM o WHERE ord <= 3),
      s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY ord) AS id FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY l_orderkey, key ORDER BY ord) = 1))
      SELECT 'F' || id AS finding_id, verification, CASE WHEN n % 3 = 2 THEN 'low' WHEN n % 3 = 1 AND c = 'high' THEN 'medium' ELSE c END AS confidence, count(*) AS findings FROM s GROUP BY ALL""",
    "jn22_quotes": "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY ALL",
    "tri2_tiers": f"""WITH x AS (SELECT DISTINCT {KEYS} FROM lineitem), o AS (SELECT l_orderkey, l_suppkey AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ord FROM x),
      r AS (SELECT *, concat_ws(',', CASE n % 3 WHEN 1 THEN 'QUOTE_NOT_MATCHED' WHEN 2 THEN 'LOCATION_NOT_VERIFIED' END, CASE WHEN n % 5 = 0 THEN 'IN_DEMO_CODE' END, CASE WHEN n % 7 = 0 THEN 'INPUT_ASSUMPTION' END, CASE WHEN n % 11 = 0 THEN 'CORROBORATED_BY_RULE' END) AS reasons FROM o),
      t AS (SELECT *, CASE WHEN n % 11 = 0 OR reasons = '' THEN 'possible_problem' ELSE 'worth_checking' END AS tier FROM r) SELECT tier, reasons, place, count(*) AS findings FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY tier <> 'possible_problem', ord) AS place FROM t) GROUP BY ALL""",
    "agg8_rates": """SELECT lang, count(*) FILTER (toxic <> 1) AS clean_runs, count(*) FILTER (toxic = 1) AS buggy_runs, round_even(count(*) FILTER (toxic <> 1 AND n_chars % 2 <> 0) / nullif(count(*) FILTER (toxic <> 1), 0), 3) AS silent_on_clean,
      round_even(count(*) FILTER (toxic = 1 AND n_chars % 2 = 0) / nullif(count(*) FILTER (toxic = 1), 0), 3) AS recall, round_even(sum(n_chars % 5) * 100.0 / sum(n_chars), 2) AS hits_per_100 FROM documents JOIN labels USING (doc_id) GROUP BY 1""",
    "agg10_latency": """SELECT event_type, count(*) AS n, round(median(value), 6) AS median, round(list_sort(list(value))[CAST(round_even(0.9 * (count(*) - 1), 0) AS INTEGER) + 1], 6) AS p90, round(max(value), 6) AS max FROM events GROUP BY 1""",
    "agg12_totals": "SELECT coalesce(quality::VARCHAR, 'TOTAL') AS quality, count(*) AS rows, CAST(sum(toxic) AS BIGINT) AS toxic FROM labels GROUP BY ROLLUP (quality)",
    "agg19_grade": r"""WITH w AS (SELECT conv_id, turn, regexp_extract_all(text, '\p{L}+') AS ws, greatest(len(regexp_extract_all(text, '[.!?]+')), 1) AS s FROM conversations)
      SELECT conv_id, turn, CASE WHEN len(ws) > 0 THEN round_even(0.39 * len(ws) / s + 11.8 * list_sum(list_transform(ws, lambda x: greatest(len(regexp_extract_all(lower(x), '[aeiouyäöüáéíóúàèìòùâêîôû]+')), 1))) / len(ws) - 15.59 + 1e-9, 1) END AS grade FROM w""",
}
