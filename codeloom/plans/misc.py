"""Queries over prose checks and choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import prose as P
from codeloom.operators import evidence, packing
from codeloom.operators import selection as S
from codeloom.sources.tables import table

def flt5_language(spark, sf_dir):
    """Snippets whose statements, declarations, tags and names vary with the page."""
    i, n = F.col("page_id"), F.col("page_id").cast("string")
    line = lambda k, yes: F.when((i / k).cast("long") % 2 == 0, yes).otherwise("")
    code = F.concat(
        line(1, F.concat(F.lit("const a"), n, F.lit(" = "), n, F.lit(";\n"))), line(2, F.concat(F.lit("def f"), n, F.lit("(x):\n    return x\n"))), line(4, F.concat(F.lit(".c"), n, F.lit(" { color: red; width: 1px }\n"))),
        line(8, "let y = () => 1\n"), line(16, "import os\n"), F.when(i % 11 == 0, "@media print { a { top: 0 } }").otherwise(""),
    )
    code = F.when(i % 13 == 0, F.concat(F.lit("<p>"), code)).otherwise(code)
    name = F.when(i % 4 == 0, F.concat(F.lit("a."), F.element_at(F.array(F.lit("PY"), F.lit("txt"), F.lit("htm")), (i % 3 + 1).cast("int")))).otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", P.sniffed_language(code, name).alias("language"))


def str4_control_tokens(spark, sf_dir):
    t = F.concat(F.lit("<|im_start|>"), "role", F.lit(" <tool_call> a < b |> "), "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", P.defused(t).alias("text"), P.defused_count(t).alias("changed"))


def str5_orders(spark, sf_dir):
    """Turns with an order planted in the middle of some, its verb and noun at a distance that varies."""
    i, words = F.col("conv_id") + F.col("turn"), F.split("text", " ")
    gap = F.array_join(F.slice(words, F.lit(1), (i % 9).cast("int")), " ")
    said = F.concat(F.lit("please "), F.element_at(F.array(*[F.lit(x) for x in ("IGNORE", "forget", "read", "override")]), (i % 4 + 1).cast("int")), F.lit(" "), gap, F.lit(" instructions."))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", P.gives_orders(F.concat_ws("\n", "text", F.when(i % 3 != 0, said))).alias("flagged"))


def jsn1_validated(spark, sf_dir):
    i = F.col("event_id")
    text = F.when(i % 10 == 0, '{"severity": "low", "start_line": ').when(i % 10 == 1, F.lit('{"severity": "odd", "start_line": 3}')).when(i % 10 == 2, F.lit('{"severity": "high"}')).otherwise(F.format_string('{"severity": "high", "start_line": %d}', i % 50))
    got = table(spark, sf_dir, "events").select("event_id", F.from_json(text, "severity string, start_line int, bad string", {"columnNameOfCorruptRecord": "bad"}).alias("d"))
    why = F.when(F.col("d.bad").isNotNull(), "json").when(~F.col("d.severity").isin("low", "medium", "high"), "severity").when(F.col("d.start_line").isNull(), "start_line missing").when(F.col("d.start_line") > 40, "start_line range")
    return got.groupBy(F.coalesce(why, F.lit("valid")).alias("reason")).agg(F.count("*").alias("drafts"))


def chl2_exercise(spark, sf_dir):
    k = F.col("p_partkey")
    names = F.array(*[F.lit(x) for x in ("loop", "list", "dict", "class", "error")])
    some = lambda key: F.filter(names, lambda x, i: (key + i) % 3 == 0)
    level = lambda key: F.element_at(F.array(F.lit("beginner"), F.lit("advanced")), (key % 2 + 1).cast("int"))
    parts = table(spark, sf_dir, "part")
    exercises = parts.where(k <= 12).select(F.format_string("e%03d", k).alias("id"), F.concat(F.lit("l"), (k % 3).cast("string")).alias("language"), level(k).alias("difficulty"), some(k).alias("concepts"))
    requests = parts.select(k.alias("request_id"), F.concat(F.lit("l"), (k % 4).cast("string")).alias("language"), level(k + 1).alias("difficulty"), some(k + 1).alias("available"))
    return S.best_exercise(requests, exercises)


def stm5_first_valid(spark, sf_dir):
    a = table(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), (F.col("event_id") % 3 + 1).alias("attempt"), (F.col("event_id") % 7 == 0).alias("valid"))
    return S.first_valid(a)


def ver4_clamped(spark, sf_dir):
    n = F.col("l_partkey")
    cites = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey"), n).distinct().select(F.concat_ws("-", "l_orderkey", "l_partkey").alias("id"), (F.col("l_orderkey") % 50).alias("file"), (n % 60).alias("start"), (n % 60 + n % 9).alias("end"))
    cuts = spark.range(50).select(F.col("id").alias("file"), F.explode(F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(a).alias("a"), F.lit(z).alias("z")) for o, a, z in ((1, 20, 30), (2, 5, 22), (3, 45, 50))])).alias("e")).select("file", "e.*")
    return S.clamped(cites, cuts).groupBy("file").agg(F.count("*").alias("kept"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))


def src7_quota(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("ord"), F.octet_length("text").alias("size"))
    return S.quota(d, 12, 30_000, "source").groupBy("source").agg(F.count_if("taken").alias("files"), F.sum(F.when(F.col("taken"), F.col("ord")).otherwise(0)).alias("ids"))


def snk5_review_sheet(spark, sf_dir):
    return S.review_sheet(table(spark, sf_dir, "benchmark").select("item_id"), 7, "item_id")


def set4_unknown_names(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    answers = c.where("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    return S.unknown_names(answers, table(spark, sf_dir, "documents").select("text"))


def stm2_newest(spark, sf_dir):
    return packing.tail(table(spark, sf_dir, "events").select("user_id", "event_id"), 32, ["event_id"], "user_id")


def agg14_concepts(spark, sf_dir):
    """The distinct concepts (long words of the benchmark's passages) that each source's documents have, sorted."""
    concepts = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{9,}"), F.lit(0))).alias("c")).distinct()
    d = table(spark, sf_dir, "documents").select("source", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{9,}"), F.lit(0)))).alias("c")).distinct()
    return d.join(concepts, "c", "left_semi").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("c")), ",").alias("concepts"))


#: Findings' titles and problems, and whether they are about inputs alone.
FINDINGS = [
    ("Total is wrong", "the loop starts at one", False), ("Fails on an EMPTY list", "", True), ("Wrong", "may be null", True), ("Wrong", "x" * 89 + " null", False), ("Nothing is returned", "annulled", False),
    ("Crash", "Division by zero", True), ("Crash", "invalid user supplied value", True), ("Crash", "an invalid loop", False), ("Crash", "no check", True), ("Crash", "lack of proper error handling", True),
    ("Crash", "no loop here", False), ("Edge-case", "", True), ("x", "None of the branches", False), ("x", "returns None", True), ("x", "none is left", False), ("Unvalidated", "", True), ("x", "missing element", True),
    ("x", "a boundary condition", True), ("x", "unhandled inputs", True), ("x", "negative quantities", True), ("x", "negative thinking", False), ("x", "it is NaN", True),
]


def str6_assumptions(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    given = F.element_at(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p, _ in FINDINGS]), ((F.col("l_partkey") * 3 + F.col("l_suppkey")) % len(FINDINGS) + 1).cast("int"))
    rows = li.select("l_orderkey", given.alias("f")).select("l_orderkey", evidence.assumes_input(F.col("f.t"), F.col("f.p")).alias("assumes"))
    return rows.groupBy("l_orderkey").agg(F.count_if("assumes").alias("assumed"), F.count("*").alias("findings"))


#: Pieces of answers with their words, and their unexplained technical and everyday words.
PHRASES = [
    ("We iterate here.", 3, 1, 0), ("An array (a row of values) helps.", 7, 0, 0), ("The index: where it is.", 5, 0, 0), ("A class means a kind.", 5, 0, 0), ("The Loop ends, the function returns", 6, 1, 2), ("`string` - text", 2, 0, 0),
    ("variables are names", 3, 0, 0), ("subclass and stringy", 3, 0, 0), ("a boolean, which is yes or no", 7, 0, 0), ("parse. Parses", 2, 2, 0), ("the list is a row; lists", 6, 0, 1), ("don't return 5", 2, 0, 1), ("an object is like a box", 6, 0, 0),
]


def agg18_jargon(spark, sf_dir):
    """Of each order's lines as an answer: words, unexplained words of both kinds, and their rates."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    given = F.element_at(F.array(*[F.lit(t) for t, *_ in PHRASES]), ((F.col("l_partkey") + 5 * F.col("l_suppkey")) % len(PHRASES) + 1).cast("int"))
    text = li.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", given.alias("t")))).getField("t"), "\n/ ").alias("t"))
    hits = text.select("l_orderkey", P.word_count(F.col("t")).alias("words"), P.unexplained(F.col("t"), P.JARGON).alias("jargon"), P.unexplained(F.col("t"), P.EVERYDAY).alias("everyday"))
    return hits.withColumns({"jargon_per_100": P.per_hundred(F.col("jargon"), F.col("words")), "both_per_100": P.per_hundred(F.col("jargon") + F.col("everyday"), F.col("words"))})


#: Forms of one name that differ by case or composition, and names apart.
NAMES = ["Straße", "STRASSE", "strasse", "caf\u00e9", "cafe\u0301", "CAF\u00c9", "cafe", "\u0130x", "i\u0307x", "ix", "a.py", "A.PY", "src", "Src/b.py", "src/B.py", "d/e/f"]
NAME_KEYS = ["strasse", "strasse", "strasse", "caf\u00e9", "caf\u00e9", "caf\u00e9", "cafe", "i\u0307x", "i\u0307x", "ix", "a.py", "a.py", "src", "src/b.py", "src/b.py", "d/e/f"]


def src6_case_keys(spark, sf_dir):
    """Paths of each supplier's parts that clash with others of theirs, or with a folder."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    name = F.element_at(F.array(*[F.lit(x) for x in NAMES]), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % len(NAMES) + 1).cast("int"))
    found = S.case_clashes(li.select(F.col("l_suppkey").alias("project_id"), name.alias("path")))
    return found.groupBy("project_id").agg(F.count("*").alias("paths"), F.count_if("twice").alias("twice"), F.count_if("folder").alias("folders"))


QUERIES = {f.__name__: f for f in (str6_assumptions, agg18_jargon, src6_case_keys, flt5_language, str4_control_tokens, str5_orders, jsn1_validated, chl2_exercise, stm5_first_valid, ver4_clamped, src7_quota, snk5_review_sheet, set4_unknown_names, stm2_newest, agg14_concepts)}
_words = lambda words: ", ".join(f"'{w}'" for w in words)
ORACLES = {
    "flt5_language": f"""WITH c AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'a.' || (['PY', 'txt', 'htm'])[CAST(page_id % 3 + 1 AS INTEGER)] ELSE '' END AS name,
        CASE WHEN page_id % 13 = 0 THEN '<p>' ELSE '' END || CASE WHEN page_id % 2 = 0 THEN 'const a' || page_id || ' = ' || page_id || e';\n' ELSE '' END || CASE WHEN page_id // 2 % 2 = 0 THEN 'def f' || page_id || e'(x):\n    return x\n' ELSE '' END
        || CASE WHEN page_id // 4 % 2 = 0 THEN '.c' || page_id || e' {{ color: red; width: 1px }}\n' ELSE '' END || CASE WHEN page_id // 8 % 2 = 0 THEN e'let y = () => 1\n' ELSE '' END || CASE WHEN page_id // 16 % 2 = 0 THEN e'import os\n' ELSE '' END
        || CASE WHEN page_id % 11 = 0 THEN '@media print {{ a {{ top: 0 }} }}' ELSE '' END AS code FROM pages),
      t AS (SELECT *, trim(code) AS x FROM c),
      p AS (SELECT page_id, name, x, len(list_filter(regexp_extract_all(x, '[A-Za-z]+'), lambda w: w IN ({_words(P.PYTHON_WORDS)}))) + len(list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, ':[ \t]*$'))) AS py,
        len(list_filter(regexp_extract_all(x, '[A-Za-z]+'), lambda w: w IN ({_words(P.SCRIPT_WORDS)}))) + len(regexp_extract_all(x, '=>')) + len(list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, ';[ \t]*$'))) AS js,
        CASE WHEN contains(x, '{{') THEN len(regexp_extract_all(x, '(color: red;|width: 1px }}|top: 0 }})')) + 2 * len(regexp_extract_all(x, '@media')) ELSE 0 END AS css FROM t)
      SELECT page_id, CASE WHEN name <> '' THEN CASE name WHEN 'a.PY' THEN 'python' WHEN 'a.htm' THEN 'html' END WHEN x[1] = '<' THEN 'html' WHEN py > greatest(js, css) THEN 'python' WHEN js > greatest(py, css) THEN 'javascript' WHEN css > greatest(py, js) THEN 'css' END AS language FROM p""",
    "str4_control_tokens": "SELECT conv_id, turn, '< |im_start| >' || role || ' < tool_call> a < b | > ' || text AS text, 4 AS changed FROM conversations",
    "str5_orders": f"""WITH c AS (SELECT conv_id, turn, conv_id + turn AS i, text FROM conversations),
      t AS (SELECT conv_id, turn, text || CASE WHEN i % 3 <> 0 THEN chr(10) || 'please ' || (['IGNORE', 'forget', 'read', 'override'])[CAST(i % 4 + 1 AS INTEGER)] || ' ' || array_to_string(string_split(text, ' ')[1:i % 9], ' ') || ' instructions.' ELSE '' END AS x FROM c),
      w AS (SELECT conv_id, turn, regexp_extract_all(lower(x), '[a-z]+') AS w FROM t)
      SELECT conv_id, turn, len(list_filter(range(1, len(w) + 1), lambda k: w[k] IN ({_words(P.ORDER_VERBS)}) AND len(list_filter(w[k + 1:k + 5], lambda y: y IN ({_words(P.ORDER_NOUNS)}))) > 0)) > 0 AS flagged FROM w""",
    "jsn1_validated": "SELECT CASE WHEN event_id % 10 = 0 THEN 'json' WHEN event_id % 10 = 1 THEN 'severity' WHEN event_id % 10 = 2 THEN 'start_line missing' WHEN event_id % 50 > 40 THEN 'start_line range' ELSE 'valid' END AS reason, count(*) AS drafts FROM events GROUP BY 1",
    "chl2_exercise": """WITH n AS (SELECT unnest(['loop', 'list', 'dict', 'class', 'error']) AS c, unnest([0, 1, 2, 3, 4]) AS i), e AS (SELECT printf('e%03d', p_partkey) AS id, 'l' || (p_partkey % 3) AS lang, p_partkey % 2 AS lv, p_partkey AS k FROM part WHERE p_partkey <= 12),
      q AS (SELECT p_partkey AS request_id, 'l' || (p_partkey % 4) AS lang, (p_partkey + 1) % 2 AS lv FROM part), b AS (SELECT request_id, e.id, (SELECT string_agg(c, ',' ORDER BY c) FROM n WHERE (k + i) % 3 = 0 AND (request_id + 1 + i) % 3 = 0) AS matched,
      (SELECT count(*) FROM n WHERE (k + i) % 3 = 0 AND (request_id + 1 + i) % 3 = 0) AS m FROM q LEFT JOIN e ON e.lang = q.lang AND e.lv = q.lv)
      SELECT request_id, id, CASE WHEN id IS NULL THEN 'no_match' WHEN m > 0 THEN 'concept' ELSE 'general' END AS kind, CASE WHEN id IS NOT NULL THEN coalesce(matched, '') END AS matched FROM b QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY m DESC, id) = 1""",
    "stm5_first_valid": """SELECT user_id AS request_id, coalesce(g, l) AS attempt, CASE WHEN g IS NULL THEN 'failed' WHEN g = 1 THEN 'first' ELSE 'retried' END AS mode FROM (SELECT user_id, min(event_id % 3 + 1) FILTER (event_id % 7 = 0) AS g, max(event_id % 3 + 1) AS l FROM events GROUP BY 1)""",
    "ver4_clamped": """WITH c AS (SELECT DISTINCT l_orderkey, l_partkey, l_orderkey % 50 AS file, l_partkey % 60 AS s, l_partkey % 60 + l_partkey % 9 AS e FROM lineitem), x AS (SELECT *, CASE WHEN e >= 20 AND s <= 30 THEN [20, 30] WHEN e >= 5 AND s <= 22 THEN [5, 22] WHEN e >= 45 AND s <= 50 THEN [45, 50] END AS r FROM c)
      SELECT file, count(*) AS kept, CAST(sum(greatest(s, r[1])) AS BIGINT) AS starts, CAST(sum(least(e, r[2])) AS BIGINT) AS ends FROM x WHERE r IS NOT NULL GROUP BY 1""",
    "str6_assumptions": f"SELECT l_orderkey, count(*) FILTER ({[a for _, _, a in FINDINGS]}[CAST((l_partkey * 3 + l_suppkey) % {len(FINDINGS)} + 1 AS INTEGER)]) AS assumed, count(*) AS findings FROM lineitem GROUP BY 1",
    "agg18_jargon": f"""WITH x AS (SELECT l_orderkey, {[list(p[1:]) for p in PHRASES]}[CAST((l_partkey + 5 * l_suppkey) % {len(PHRASES)} + 1 AS INTEGER)] AS n FROM lineitem),
      s AS (SELECT l_orderkey, CAST(sum(n[1]) AS BIGINT) AS words, CAST(sum(n[2]) AS BIGINT) AS jargon, CAST(sum(n[3]) AS BIGINT) AS everyday FROM x GROUP BY 1)
      SELECT *, round_even(100 * jargon / words, 2) AS jargon_per_100, round_even(100 * (jargon + everyday) / words, 2) AS both_per_100 FROM s""",
    "src6_case_keys": f"""WITH x AS (SELECT DISTINCT l_suppkey AS project_id, CAST((l_partkey * 7 + l_suppkey) % {len(NAMES)} + 1 AS INTEGER) AS n FROM lineitem), k AS (SELECT project_id, n, {NAME_KEYS}[n] AS key FROM x),
      f AS (SELECT *, row_number() OVER (PARTITION BY project_id, key ORDER BY n) > 1 AS twice, EXISTS (SELECT 1 FROM k o WHERE o.project_id = k.project_id AND k.key = 'src' AND o.key = 'src/b.py') AS folder FROM k)
      SELECT project_id, count(*) AS paths, count(*) FILTER (twice) AS twice, count(*) FILTER (folder) AS folders FROM f GROUP BY 1""",
    "src7_quota": """WITH RECURSIVE d AS (SELECT source, doc_id, strlen(text) AS b, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
      f AS (SELECT source, k, doc_id, b <= 30000 AS t, CASE WHEN b <= 30000 THEN b ELSE 0 END AS bytes, CASE WHEN b <= 30000 THEN 1 ELSE 0 END AS n FROM d WHERE k = 1
        UNION ALL SELECT d.source, d.k, d.doc_id, f.n < 12 AND f.bytes + d.b <= 30000, CASE WHEN f.n < 12 AND f.bytes + d.b <= 30000 THEN f.bytes + d.b ELSE f.bytes END, CASE WHEN f.n < 12 AND f.bytes + d.b <= 30000 THEN f.n + 1 ELSE f.n END FROM f JOIN d ON d.source = f.source AND d.k = f.k + 1)
      SELECT source, count(*) FILTER (t) AS files, CAST(coalesce(sum(doc_id) FILTER (t), 0) AS BIGINT) AS ids FROM f GROUP BY 1""",
    "snk5_review_sheet": "SELECT item_id, printf('A%03d', row_number() OVER (ORDER BY md5(item_id || '/7'), item_id)) AS sheet_id FROM benchmark",
    "set4_unknown_names": r"""WITH a AS (SELECT DISTINCT conv_id || '-' || turn AS id, unnest(regexp_extract_all(text, '[A-Za-z_]\w{2,}')) AS name FROM conversations WHERE role = 'assistant'), k AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z_]\w{2,}')) AS name FROM documents)
      SELECT id, name FROM a WHERE name NOT IN (SELECT name FROM k)""",
    "stm2_newest": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 32",
    "agg14_concepts": """WITH k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{9,}')) AS c FROM benchmark), d AS (SELECT DISTINCT source, unnest(regexp_extract_all(lower(text), '[a-z]{9,}')) AS c FROM documents)
      SELECT source, string_agg(c, ',' ORDER BY c) AS concepts FROM d JOIN k USING (c) GROUP BY 1""",
}
