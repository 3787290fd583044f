"""Queries over requests and answers: uploads, scopes, citations, outcomes, excerpts, lookups, relations and orders."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.operators import answers as A
from codeloom.operators import graph as G
from codeloom.plans.graphs import SCRIPTS_SQL, module_files, script_edges
from codeloom.plans.windows import RANGES_SQL, order_ranges
from codeloom.sources.tables import FILES_SQL, discovered, files, table


def src8_host_path(spark, sf_dir):
    """The URLs' paths as upload names, some of them with drives, dots and back slashes."""
    i, url = F.col("page_id"), F.regexp_replace("url", "^[a-z]+://", "")
    name = F.when(i % 7 == 0, F.concat(F.lit("/"), url)).when(i % 7 == 1, F.concat(F.lit("a\\"), url)).when(i % 7 == 2, F.concat(F.lit("x/../"), url)).when(i % 7 == 3, F.concat(F.lit("C:"), url)).when(i % 7 == 4, F.concat(url, F.lit("//"))).otherwise(url)
    return table(spark, sf_dir, "pages").select("page_id", A.host_path(name).alias("path"))


def src9_uploaded_files(spark, sf_dir):
    """A JSON array of paths for each order's files; repeated paths of an upload, and how many it has."""
    paths = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_list(F.concat(F.lit("f"), (F.col("l_partkey") % 3).cast("string"), F.lit(".py"))))).alias("paths"))
    rows = paths.select("l_orderkey", F.explode(F.from_json("paths", "array<string>")).alias("path"))
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("files"), (F.count("*") - F.countDistinct("path")).alias("repeated"))


def src10_snippets(spark, sf_dir):
    """Turns that can be pasted as a snippet: not blank, without NUL, not too long."""
    t = F.col("text")
    ok = (F.trim(t) != "") & ~F.contains(t, F.lit("\0")) & (F.char_length(t) <= A.SNIPPET_CHARS)
    return table(spark, sf_dir, "conversations").where(ok).groupBy("role").agg(F.count("*").alias("snippets"), F.sum(F.char_length(t)).alias("chars"))


def src18_lookup(spark, sf_dir):
    """Each request's file by its path."""
    f = files(spark, sf_dir).groupBy("path").agg(F.min_by("size_bytes", "doc_id").alias("size_bytes"))  # the first of a repeated path
    asked = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("doc_id")).join(files(spark, sf_dir).select("doc_id", "path"), "doc_id", "left")
    return asked.join(f, "path", "left").select("o_orderkey", "path", "size_bytes")


def src20b_split(spark, sf_dir):
    """Labelled fixtures by split: development, held out, and all."""
    rows = table(spark, sf_dir, "labels").withColumn("split", F.when(F.col("doc_id") % 5 == 0, "heldout").otherwise("dev"))
    return rows.union(rows.withColumn("split", F.lit("all"))).groupBy("split").agg(F.count("*").alias("fixtures"), F.sum("toxic").alias("bugs"))


def flt6_folder(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", "path").where(A.in_form(F.col("path")))


def flt7_uploads(spark, sf_dir):
    """Each source's files as one upload for each kind of file."""
    f = files(spark, sf_dir).withColumn("kind", F.col("doc_id") % 7).select("project_id", "kind", F.col("path").alias("name"), F.col("size_bytes").alias("size"))
    return A.upload_verdicts(f, "project_id", "kind")


def flt8_summary(spark, sf_dir):
    d = discovered(files(spark, sf_dir))
    status = F.when(F.col("reason").isNull(), "analyzed").when(F.col("reason") == "minified", "partial").otherwise("skipped")
    return d.groupBy("project_id").agg(F.count("*").alias("total_files"), *[F.count_if(status == s).alias(f"{s}_files") for s in ("analyzed", "partial", "skipped")])


def flt9_request_shapes(spark, sf_dir):
    """Requests that name at most one of a symbol and lines, and no lines of a project."""
    k, s = F.col("l_partkey"), F.col("l_suppkey")
    has_symbol, has_lines, scope = k % 3 == 0, s % 4 == 0, F.when(k % 5 == 0, "project").otherwise("file")
    ok = ~(has_symbol & has_lines) & ~((scope == "project") & (has_symbol | has_lines))
    return table(spark, sf_dir, "lineitem").groupBy(scope.alias("scope"), ok.alias("valid")).agg(F.count("*").alias("requests"))


def flt13_links(spark, sf_dir):
    """How many resolved edges start and end at each file."""
    e = script_edges(spark, sf_dir).where("status = 'resolved'").select("source", "target").distinct()
    both = e.select(F.col("source").alias("path"), F.lit(1).alias("u"), F.lit(0).alias("b")).union(e.select("target", F.lit(0), F.lit(1)))
    return both.groupBy("path").agg(F.sum("u").alias("uses"), F.sum("b").alias("used_by"))


def flt14_scopes(spark, sf_dir):
    k, s = F.col("l_partkey"), F.col("l_suppkey")
    chosen = F.element_at(F.array(F.lit("project"), F.lit("file"), F.lit("block")), (k % 3 + 1).cast("int"))
    scope = A.effective_scope(chosen, s % 2 == 0, k % 5 < 2)
    return table(spark, sf_dir, "lineitem").groupBy(chosen.alias("chosen"), scope.alias("scope")).agg(F.count("*").alias("requests"))


def flt15_steps(spark, sf_dir):
    k = F.col("l_partkey")
    status = F.element_at(F.array(F.lit("in_context"), F.lit("file_only"), F.lit("outline_only"), F.lit("rejected")), (k % 4 + 1).cast("int"))
    path = F.when(F.col("l_suppkey") % 9 == 0, "").otherwise(F.concat(F.lit("m"), F.col("l_suppkey").cast("string")))
    label = A.step_label(path, k % 20 + 1, k % 20 + 1 + F.col("l_linenumber") % 3, status)
    return table(spark, sf_dir, "lineitem").groupBy(label.alias("label")).agg(F.count("*").alias("steps"))


def host_files(spark, sf_dir):
    return module_files(spark, sf_dir, ".js").select("path", F.col("reason").isNotNull().alias("skipped"))


def host_refs(spark, sf_dir):
    """References of the parts' scripts: imports with and without an ending, modules, and ids that pages define."""
    k, t = F.col("p_partkey"), (F.col("p_partkey") * 3 + 1) % 2500
    kind = F.element_at(F.array(F.lit("javascript_import"), F.lit("asset"), F.lit("html_id"), F.lit("python_import"), F.lit("javascript_import")), (k % 5 + 1).cast("int"))
    value = (
        F.when(k % 5 == 0, F.format_string("../pkg%d/m%d", t % 7, t)).when(k % 5 == 1, F.format_string("/pkg%d/m%d.js?v=1", t % 7, t)).when(k % 5 == 2, F.format_string("id%d", t % 50))
        .when(k % 5 == 3, F.format_string("pkg%d.m%d", t % 7, t)).otherwise("lodash")
    )
    return table(spark, sf_dir, "part").select(F.format_string("pkg%d/m%d.js", k % 7, k).alias("source"), kind.alias("kind"), value.alias("value"))


def jn7_host_links(spark, sf_dir):
    k = F.col("p_partkey")
    ids = table(spark, sf_dir, "part").where(k % 10 == 5).select(F.format_string("pkg%d/m%d.js", k % 7, k).alias("path"), F.format_string("id%d", k % 40).alias("value"))
    return A.host_links(host_refs(spark, sf_dir), host_files(spark, sf_dir), ids)


def jn8_link_ids(spark, sf_dir):
    """Edges with the ids of both ends, null where an end is no file."""
    e = script_edges(spark, sf_dir).where("status in ('resolved', 'excluded')").select("source", "target").distinct()
    f = module_files(spark, sf_dir, ".js").select("path", F.sha1("path").alias("file_id"))
    ends = e.join(f.select(F.col("path").alias("source"), F.col("file_id").alias("source_id")), "source", "left")
    return ends.join(f.select(F.col("path").alias("target"), F.col("file_id").alias("target_id")), "target", "left").select("source", "target", "source_id", "target_id")


def jn9_import_map(spark, sf_dir):
    """Names that orders import from the ranges of other orders, as files."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").distinct()
    path, target = F.concat(F.lit("f"), F.col("l_orderkey").cast("string")), F.concat(F.lit("f"), (F.col("l_orderkey") + F.col("l_linenumber")).cast("string"))
    refs = li.groupBy(path.alias("path"), F.col("l_linenumber").alias("line")).agg(F.array_sort(F.collect_set(F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")))).alias("names"))
    edges = li.select(path.alias("path"), F.col("l_linenumber").alias("line"), target.alias("target"))
    symbols = order_ranges(spark, sf_dir).select(F.concat(F.lit("f"), F.col("owner").cast("string")).alias("path"), "name", F.lit("function").alias("kind"), "start", "end")
    return A.import_map(refs, edges, symbols)


def jn12_demo_findings(spark, sf_dir):
    """Ranges that lie in their order's demo block."""
    demo = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("owner"), (F.col("o_custkey") % 40 + 1).alias("a"), (F.col("o_custkey") % 40 + 50).alias("z"))
    r = order_ranges(spark, sf_dir)
    return r.join(demo, (r["owner"] == demo["owner"]) & (F.col("a") <= F.col("start")) & (F.col("end") <= F.col("z")), "left_semi").groupBy("owner").agg(F.count("*").alias("findings"))


def jn16_used_symbols(spark, sf_dir):
    """Names of the benchmark's passages, as symbols of a dependency, that each document uses."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_]{7,}"), F.lit(0))).alias("at", "name"))
    symbols = words.groupBy("name").agg(F.min(F.col("item_id") * 1000 + F.col("at")).alias("start")).select(F.lit("lib").alias("path"), "name", "start")
    return A.used_symbols(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("lib").alias("path"), "text"), symbols)


def jn18_find_symbols(spark, sf_dir):
    """Symbols by qualified name, else the first few by plain name."""
    s = order_ranges(spark, sf_dir).withColumn("class", F.col("start") % 3)
    symbols = s.groupBy("owner", "name", "class").agg(F.min("start").alias("start")).select((F.col("owner") % 50).cast("string").alias("path"), F.concat(F.lit("C"), "class", F.lit("_"), "owner", F.lit("."), "name").alias("qualified"), "name", "start")
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 50).cast("string").alias("path"), F.when(F.col("o_custkey") % 2 == 0, "s1").otherwise(F.concat(F.lit("C1_"), F.col("o_orderkey").cast("string"), F.lit(".s2"))).alias("name"))
    return A.find_symbols(asked, symbols)


def jn19_picked_files(spark, sf_dir):
    d = discovered(files(spark, sf_dir)).select(F.col("doc_id").alias("file_id"), "path", F.when(F.col("reason") == "too_large", "skipped").otherwise("analyzed").alias("status"), "reason")
    k = F.col("o_orderkey")
    by = d.select(F.col("file_id").alias("n"), F.col("path").alias("asked"))
    r = table(spark, sf_dir, "orders").withColumn("n", F.col("o_custkey")).join(by, "n", "left")
    requests = r.select(k.alias("id"), F.when(k % 3 == 0, F.col("n")).alias("file_id"), F.when(k % 3 == 1, F.col("asked")).when(k % 6 == 3, "other.py").alias("path"))
    return A.picked(requests, d).groupBy("error").agg(F.count("*").alias("requests"), F.count("path").alias("paths"))


def agg2_host_counts(spark, sf_dir):
    d = discovered(files(spark, sf_dir))
    return d.groupBy("project_id", "language").agg(F.count_if(F.col("reason").isNull()).alias("files"), F.count("reason").alias("warnings"))


def agg5_coverage(spark, sf_dir):
    """How much of each order's ranges lies in its first fifty lines."""
    status = F.when(F.col("end") <= 50, "full").when(F.col("start") <= 50, "partial").otherwise("omitted")
    return order_ranges(spark, sf_dir).groupBy("owner").agg(*[F.count_if(status == s).alias(s) for s in ("full", "partial", "omitted")])


def agg7_verification(spark, sf_dir):
    n = F.col("l_suppkey")
    v = F.when((n % 3 == 0) & (F.col("l_partkey") % 2 == 0), "source_verified").when(n % 3 < 2, "hypothesis").otherwise("unsupported")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*[F.count_if(v == s).alias(s) for s in ("source_verified", "hypothesis", "unsupported")])


def agg9_explain(spark, sf_dir):
    """Per-100-word rates weighted by all words, by language."""
    words, long = F.regexp_count("text", F.lit("[A-Za-z]+")), F.regexp_count("text", F.lit("[A-Za-z]{12,}"))
    return table(spark, sf_dir, "documents").select("lang", words.alias("w"), long.alias("h")).groupBy("lang").agg(F.count("*").alias("answers"), F.count_if(F.col("h") > 0).alias("with_hits"), F.bround(F.sum("h") * 100.0 / F.sum("w"), 2).alias("per_100"))


def agg11_report(spark, sf_dir):
    """Requests by intent and depth: median and most, valid ones, attempts."""
    e = table(spark, sf_dir, "events").withColumn("depth", F.col("user_id") % 3)
    return e.groupBy("event_type", "depth").agg(F.count("*").alias("requests"), F.round(F.median("value"), 6).alias("median"), F.round(F.max("value"), 6).alias("most"), F.count_if(F.col("event_id") % 7 != 0).alias("valid"), F.max(F.col("event_id") % 3 + 1).alias("attempts"))


def findings_and_hits(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    tier = F.when(F.col("l_suppkey") % 23 == 0, "possible_problem").otherwise("worth_checking")
    f = li.where("l_linenumber <= 3").select(F.col("l_orderkey").alias("request"), tier.alias("tier"))
    h = li.where("l_linenumber > 3").select(F.col("l_orderkey").alias("request"), F.when(F.col("l_partkey") % 17 == 0, "problem").otherwise("worth_checking").alias("strength"))
    return f, h


def agg15_outcomes(spark, sf_dir):
    return A.outcomes(*findings_and_hits(spark, sf_dir), "request")


def tri4_outcome_text(spark, sf_dir):
    o = A.outcomes(*findings_and_hits(spark, sf_dir), "request")
    return o.groupBy(A.outcome_text(F.col("possible"), F.col("worth"), F.col("problems")).alias("said")).agg(F.count("*").alias("requests"))


def tri3_pattern_checks(spark, sf_dir):
    """Hits in output order, and whether the lines that they are about were seen."""
    r = order_ranges(spark, sf_dir).select(F.col("owner").alias("request"), F.concat_ws("-", "start", "end", "name").alias("hit"), F.lit("f").alias("path"), F.col("name").alias("rule"), F.when(F.col("start") % 2 == 0, "problem").otherwise("worth").alias("strength"), "start", F.array("start", "end").alias("focus"))
    shown = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), F.lit("f").alias("path"), (F.col("o_custkey") % 30).alias("a"), (F.col("o_custkey") % 30 + 60).alias("z"))
    return A.checked_hits(r, shown)


def ver2_sections(spark, sf_dir):
    k, s = F.col("l_partkey"), F.col("l_suppkey")
    status = F.element_at(F.array(F.lit("in_context"), F.lit("file_only"), F.lit("outline_only"), F.lit("rejected")), (k % 4 + 1).cast("int"))
    ord_ = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    d = d.select(F.col("l_orderkey").alias("request"), ord_.alias("ord"), F.when(s % 3 == 0, " ").otherwise(F.concat(F.lit("t"), s.cast("string"))).alias("title"), F.when(k % 2 == 0, "").otherwise("d").alias("description"), F.concat(F.lit("f"), (s % 5).cast("string")).alias("path"), (k % 9).alias("start"), (k % 9 + 2).alias("end"), status.alias("status"))
    return A.sections(d)


def ver5_citations(spark, sf_dir):
    r = order_ranges(spark, sf_dir).select("owner", "id", F.col("owner").cast("string").alias("path"), "start", "end")
    chunks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), (F.col("o_custkey") % 50 + 1).alias("start"), (F.col("o_custkey") % 50 + 45).alias("end"))
    return A.inside(r, chunks).groupBy("owner").agg(F.count("*").alias("kept"), F.sum("start").alias("starts"))


def set1_all_paths(spark, sf_dir):
    """Paths of analysed files and of left-out ones, together."""
    d = discovered(files(spark, sf_dir))
    return d.where("reason is null").select("path").union(d.where("reason is not null").select("path")).distinct()


def set2_clashes(spark, sf_dir):
    """Keys that are a file's and a folder's."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("D"), (k % 30).cast("string"), F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("/f"), k.cast("string")))).alias("path"))
    return p.select(F.lower("path").alias("key")).intersect(p.where(F.contains("path", F.lit("/"))).select(F.lower(F.split("path", "/")[0])))


def set5_strangers(spark, sf_dir):
    """For each file with edges, how many neighbours it has, and how many of the two files that an answer mentions are none of them."""
    e = script_edges(spark, sf_dir).where("target is not null").select("source", "target").distinct()
    near = e.select(F.col("source").alias("path"), F.col("target").alias("near")).union(e.select("target", "source")).groupBy("path").agg(F.collect_set("near").alias("near"))
    k = F.regexp_extract("path", r"m(\d+)\.js", 1).cast("long")
    said = F.transform(F.array(k + 1, k * 7 % 2100), lambda x: F.concat(F.lit("pkg"), (x % 7).cast("string"), F.lit("/m"), x.cast("string"), F.lit(".js")))
    return near.select("path", F.size("near").cast("long").alias("neighbours"), F.size(F.array_except(said, "near")).cast("long").alias("strangers"))


def set7_limitations(spark, sf_dir):
    """Notes of three parts in order, each once."""
    k = F.col("l_partkey")
    note = lambda n: F.concat(F.lit("n"), n.cast("string"))
    notes = F.array_distinct(F.concat(F.array(note(k % 5)), F.array(note(k % 3), note(F.col("l_suppkey") % 4)), F.array(note(F.col("l_linenumber")))))
    return table(spark, sf_dir, "lineitem").groupBy(F.array_join(notes, ",").alias("notes")).agg(F.count("*").alias("answers"))


def set8_tokens(spark, sf_dir):
    """Names that each answer uses and its conversation's questions do not have."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "role", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z_][a-z0-9_]+"), F.lit(0)))).alias("w")).distinct()
    by = c.groupBy("conv_id", "w").agg(F.bool_or(F.col("role") == "user").alias("asked"), F.bool_or(F.col("role") == "assistant").alias("said"))
    return by.groupBy("conv_id").agg(F.count_if("said").alias("used"), F.count_if(F.col("said") & ~F.col("asked")).alias("new"))


def srt2_edges(spark, sf_dir):
    """The place of each edge among its source's, in output order."""
    e = script_edges(spark, sf_dir).select("source", "specifier", "status", "target").distinct()
    return e.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("specifier", F.coalesce("target", F.lit("")), "status")).cast("long"))


def srt3_entries(spark, sf_dir):
    """Entry points of each project, those in outer folders first: modules with a main guard (every third), and pages that nothing refers to."""
    found = discovered(files(spark, sf_dir)).where("reason is null")
    none = spark.createDataFrame([], "project_id string, target string, status string")
    entries = G.entry_points(found, none, found.where("doc_id % 3 = 0 and language = 'python'"))
    return G.ranked_entries(entries).select("project_id", "path", "reason", "place")


def srt14_omitted(spark, sf_dir):
    r = order_ranges(spark, sf_dir).select((F.col("owner") % 20).alias("request"), F.col("owner").cast("string").alias("path"), F.col("name").alias("kind"), "start", "end")
    return A.omitted_regions(r, "request").groupBy("request").agg(F.count("*").alias("shown"), F.max("total").alias("total"), F.sum("start").alias("starts"))


def str3_quotes(spark, sf_dir):
    q = F.left("text", (F.col("conv_id") % 200).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.char_length(q) >= A.QUOTE_CHARS, "").otherwise(q).alias("quote"))


def str10_labels(spark, sf_dir):
    """Sizes, ranges and lists as they are shown."""
    g = order_ranges(spark, sf_dir).groupBy("owner").agg(F.min("start").alias("a"), F.max("end").alias("z"), F.array_sort(F.collect_set("name")).alias("names"))
    mib = F.concat(F.bround(F.col("owner") * F.lit(10240) / F.lit(1048576.0), 1).cast("decimal(18,1)").cast("string"), F.lit(" MiB"))
    return g.select("owner", A.range_label(F.col("a"), F.col("z")).alias("lines"), A.listed(F.col("names"), 2).alias("names"), mib.alias("size"))


def str14_excerpts(spark, sf_dir):
    lines = F.split("text", "\n", -1)
    start = (F.col("doc_id") % 4 + 1).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", A.excerpt(lines, start, start + (F.col("doc_id") % 25).cast("int")).alias("excerpt"))


def str16_marked_lines(spark, sf_dir):
    """Numbered lines of each turn, the cited ones marked."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", r"\. ", -1)).alias("n", "line"))
    return c.select("conv_id", "turn", (F.col("n") + 10).cast("long").alias("number"), "line", F.col("n").between(F.col("conv_id") % 3, F.col("conv_id") % 3 + 1).alias("hit"))


def str19_placeholder(spark, sf_dir):
    """Each turn's sentences as lines of a file, one of them taken out."""
    lines = F.transform(F.split("text", r"\. ", -1), lambda x, i: F.concat(F.repeat(F.lit(" "), i % 4), x))
    lang = F.element_at(F.array(F.lit("python"), F.lit("html"), F.lit("css")), (F.col("conv_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(A.without_line(lines, (F.col("turn") % 3 + 1).cast("int"), lang), "\n").alias("text"))


def mth2_budgets(spark, sf_dir):
    """What a window leaves after a reserve and a margin, never under nothing nor over a lower cap."""
    window, reserve, cap = F.col("l_partkey") % 5000, F.col("l_suppkey") % 900, F.when(F.col("l_linenumber") % 2 == 0, 1500)
    left = F.greatest(window - reserve - 128, F.lit(0))
    return table(spark, sf_dir, "lineitem").groupBy(F.coalesce(F.least(left, cap), left).cast("long").alias("budget")).agg(F.count("*").alias("requests"))


def mth5_layout(spark, sf_dir):
    """Explorer widths after a drag: between their least width and what the others leave."""
    shared = F.col("user_id") % 1000 + 600
    return table(spark, sf_dir, "events").select("event_id", F.least(F.greatest(F.col("event_id") % 900, F.lit(150)), F.greatest(F.lit(150), shared - 240 - 200)).cast("long").alias("explorer"))


def hsh2_seals(spark, sf_dir):
    """Fingerprints of fixtures, whatever their order."""
    return table(spark, sf_dir, "labels").select("doc_id", A.seal(F.col("doc_id"), F.col("quality"), F.col("toxic")).alias("seal"))


def jsn2_paths(spark, sf_dir):
    """Arrays of paths out of JSON; what is no array of strings has none."""
    i = F.col("event_id")
    text = F.when(i % 5 == 0, "[\"a\", ").when(i % 5 == 1, F.lit("{}")).otherwise(F.format_string('["p%d.py", "q/%d"]', i % 7, i % 3))
    got = table(spark, sf_dir, "events").select(F.from_json(text, "array<string>").alias("p"))
    return got.groupBy(F.coalesce(F.array_join("p", "|"), F.lit("")).alias("paths")).agg(F.count("*").alias("uploads"))


def chl3_hints(spark, sf_dir):
    """The hints up to the level that was asked for."""
    hints = F.split("text", r"\. ", -1)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.slice(hints, 1, (F.col("turn") % 4).cast("int")), "|").alias("hints"), (F.col("turn") % 4 >= F.size(hints)).alias("all"))


def stm6_live_replies(spark, sf_dir):
    """Turns of the last epoch of each conversation's scopes."""
    c = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") % 2).alias("scope"), F.floor(F.col("turn") / 4).alias("epoch"), F.col("turn").alias("ord"))
    return A.live_replies(c, "conv_id").select("conv_id", "ord")


def grf7_host_entries(spark, sf_dir):
    k = F.col("s_suppkey")
    name = F.element_at(F.array(*[F.lit(x) for x in ("main.py", "App.js", "util.py", "INDEX.html", "index.htm", "__main__.py", "index.js")]), (k % 7 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").where(F.lower(name).isin(A.HOST_ENTRIES)).select(F.concat(F.lit("d"), k.cast("string"), F.lit("/"), name).alias("path"))


QUERIES = {
    f.__name__: f for f in (
        src8_host_path, src9_uploaded_files, src10_snippets, src18_lookup, src20b_split, flt6_folder, flt7_uploads, flt8_summary, flt9_request_shapes, flt13_links, flt14_scopes, flt15_steps, jn7_host_links, jn8_link_ids, jn9_import_map,
        jn12_demo_findings, jn16_used_symbols, jn18_find_symbols, jn19_picked_files, agg2_host_counts, agg5_coverage, agg7_verification, agg9_explain, agg11_report, agg15_outcomes, tri3_pattern_checks, tri4_outcome_text, ver2_sections, ver5_citations,
        set1_all_paths, set2_clashes, set5_strangers, set7_limitations, set8_tokens, srt2_edges, srt3_entries, srt14_omitted, str3_quotes, str10_labels, str14_excerpts, str16_marked_lines, str19_placeholder, mth2_budgets, mth5_layout, hsh2_seals,
        jsn2_paths, chl3_hints, stm6_live_replies, grf7_host_entries,
    )
}
NAME = "regexp_replace(url, '^[a-z]+://', '')"
KEYS_SQL = "SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem"
OUTCOMES_SQL = """o AS (SELECT l_orderkey AS request, count(*) FILTER (l_linenumber <= 3 AND l_suppkey % 23 = 0) AS possible, count(*) FILTER (l_linenumber <= 3 AND l_suppkey % 23 <> 0) AS worth, count(*) FILTER (l_linenumber > 3 AND l_partkey % 17 = 0) AS problems FROM lineitem GROUP BY 1)"""
ORACLES = {
    "src8_host_path": f"""WITH n AS (SELECT page_id AS i, {NAME} AS u FROM pages) SELECT i AS page_id, CASE WHEN i % 7 IN (0, 2, 3) THEN NULL WHEN regexp_matches(u, '(^|/)\\.\\.?(/|$)') OR contains(u, ':') OR u = '' OR u[1] = '/' THEN NULL
      ELSE trim(regexp_replace(CASE i % 7 WHEN 1 THEN 'a/' || u ELSE u END, '/+', '/', 'g'), '/') END AS path FROM n""",
    "src9_uploaded_files": "SELECT l_orderkey, count(*) AS files, count(*) - count(DISTINCT l_partkey % 3) AS repeated FROM lineitem GROUP BY 1",
    "src10_snippets": "SELECT role, count(*) AS snippets, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations WHERE trim(text) <> '' AND NOT contains(text, chr(0)) AND length(text) <= 100000 GROUP BY 1",
    "src18_lookup": f"WITH {FILES_SQL}, g AS (SELECT path, arg_min(size_bytes, doc_id) AS size_bytes FROM files GROUP BY 1) SELECT o_orderkey, f.path, g.size_bytes FROM orders LEFT JOIN files f ON doc_id = o_custkey LEFT JOIN g ON g.path = f.path",
    "src20b_split": "SELECT unnest(['all', CASE WHEN doc_id % 5 = 0 THEN 'heldout' ELSE 'dev' END]) AS split, count(*) AS fixtures, CAST(sum(toxic) AS BIGINT) AS bugs FROM labels GROUP BY 1",
    "flt6_folder": f"WITH {FILES_SQL} SELECT doc_id, path FROM files WHERE doc_id % 10 <> 3",
    "flt7_uploads": f"""WITH {FILES_SQL}, g AS (SELECT project_id, doc_id % 7 AS kind, count(*) AS n, sum(size_bytes) AS t, bool_and(doc_id % 31 <> 0 AND doc_id % 7 NOT IN (4, 6)) AS s, max(size_bytes) AS m FROM files GROUP BY 1, 2)
      SELECT project_id, kind, CASE WHEN n > 1000 THEN 'too many' WHEN t > 10485760 THEN 'too large' WHEN NOT s THEN 'no source' WHEN m > 102400 THEN 'file too large' END AS error FROM g""",
    "flt8_summary": f"WITH {FILES_SQL} SELECT project_id, count(*) AS total_files, count(*) FILTER (reason IS NULL) AS analyzed_files, count(*) FILTER (reason = 'minified') AS partial_files, count(*) FILTER (reason <> 'minified') AS skipped_files FROM judged GROUP BY 1",
    "flt9_request_shapes": """SELECT CASE WHEN l_partkey % 5 = 0 THEN 'project' ELSE 'file' END AS scope, CASE WHEN l_partkey % 3 = 0 AND l_suppkey % 4 = 0 THEN false WHEN l_partkey % 5 = 0 THEN l_partkey % 3 <> 0 AND l_suppkey % 4 <> 0 ELSE true END AS valid, count(*) AS requests FROM lineitem GROUP BY 1, 2""",
    "flt13_links": f"WITH {SCRIPTS_SQL}, d AS (SELECT DISTINCT source, target FROM e WHERE status = 'resolved') SELECT path, CAST(sum(u) AS BIGINT) AS uses, CAST(sum(b) AS BIGINT) AS used_by FROM (SELECT source AS path, 1 AS u, 0 AS b FROM d UNION ALL SELECT target, 0, 1 FROM d) GROUP BY 1",
    "flt14_scopes": """WITH r AS (SELECT l_partkey % 3 AS c, l_suppkey % 2 = 0 AS readable, l_partkey % 5 IN (0, 1) AS lines FROM lineitem) SELECT ['project', 'file', 'block'][CAST(c + 1 AS INTEGER)] AS chosen,
      CASE WHEN c = 0 OR NOT readable THEN 'project' WHEN c = 2 AND lines THEN 'block' ELSE 'file' END AS scope, count(*) AS requests FROM r GROUP BY 1, 2""",
    "flt15_steps": """WITH s AS (SELECT 'm' || l_suppkey AS p, l_suppkey % 9 = 0 AS bare, l_partkey % 4 AS k, l_partkey % 20 + 1 AS a, l_linenumber % 3 AS w FROM lineitem) SELECT CASE WHEN bare OR k = 3 THEN NULL WHEN k = 1 THEN p ELSE p || ' · ' ||
      CASE WHEN w = 0 THEN 'line ' || a ELSE 'lines ' || a || '–' || (a + w) END || CASE WHEN k = 2 THEN ' (signature only)' ELSE '' END END AS label, count(*) AS steps FROM s GROUP BY 1""",
    "jn7_host_links": """WITH p AS (SELECT p_partkey AS k, 'pkg' || (p_partkey % 7) || '/m' || p_partkey || '.js' AS path FROM part), there AS (SELECT * FROM p WHERE k % 10 NOT IN (0, 1)),
      r AS (SELECT path AS source, k % 5 AS c, (k * 3 + 1) % 2500 AS t FROM p), v AS (SELECT *, CASE c WHEN 0 THEN 'javascript_import' WHEN 1 THEN 'asset' WHEN 2 THEN 'html_id' WHEN 3 THEN 'python_import' ELSE 'javascript_import' END AS kind,
        CASE c WHEN 0 THEN '../pkg' || (t % 7) || '/m' || t WHEN 1 THEN '/pkg' || (t % 7) || '/m' || t || '.js?v=1' WHEN 2 THEN 'id' || (t % 50) WHEN 3 THEN 'pkg' || (t % 7) || '.m' || t ELSE 'lodash' END AS value FROM r),
      h AS (SELECT v.source, v.kind, v.value, x.path FROM v JOIN there x ON v.c IN (0, 1) AND x.k = v.t UNION SELECT v.source, v.kind, v.value, x.path FROM v JOIN there x ON v.c = 2 AND x.k % 10 = 5 AND x.k % 40 = v.t % 50)
      SELECT source, kind, path AS target, true AS resolved FROM h UNION ALL SELECT DISTINCT source, kind, value, false FROM v WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.source = v.source AND h.kind = v.kind AND h.value = v.value)""",
    "jn8_link_ids": f"WITH {SCRIPTS_SQL}, d AS (SELECT DISTINCT source, target, s FROM (SELECT e.source, e.target, CAST(regexp_extract(e.source, 'm([0-9]+)', 1) AS BIGINT) AS s FROM e WHERE status IN ('resolved', 'excluded'))) SELECT source, target, CASE WHEN s % 10 <> 0 THEN sha1(source) END AS source_id, sha1(target) AS target_id FROM d",
    "jn9_import_map": f"""WITH {RANGES_SQL}, l AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n, 's' || (l_suppkey % 5) AS name FROM lineitem), i AS (SELECT *, row_number() OVER (PARTITION BY o, n ORDER BY name) - 1 AS pos FROM l),
      h AS (SELECT i.o, i.n, i.pos, i.name, i.o + i.n AS t, (SELECT min((r.start, r."end")) FROM r WHERE r.owner = i.o + i.n AND r.name = i.name) AS s FROM i), x AS (SELECT 'f' || o AS path, name || ' from f' || t || ' (function, L' || s[1] || '-' || s[2] || ')' AS entry, n, 'f' || t AS target, pos FROM h WHERE s IS NOT NULL),
      y AS (SELECT path, entry, min((n, target, pos)) AS o FROM x GROUP BY 1, 2) SELECT path, entry, row_number() OVER (PARTITION BY path ORDER BY o, entry) AS place FROM y QUALIFY place <= 4""",
    "jn12_demo_findings": f'WITH {RANGES_SQL} SELECT owner, count(*) AS findings FROM r JOIN orders ON o_orderkey = owner WHERE start >= o_custkey % 40 + 1 AND "end" <= o_custkey % 40 + 50 GROUP BY 1',
    "jn16_used_symbols": """WITH w AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{7,}') AS w FROM benchmark), s AS (SELECT w[i] AS name, min(item_id * 1000 + i - 1) AS start FROM w, range(1, 2000) t(i) WHERE i <= len(w) GROUP BY 1),
      d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*')) AS name FROM documents) SELECT doc_id AS id, name, row_number() OVER (PARTITION BY doc_id ORDER BY start, name) AS place FROM d JOIN s USING (name) QUALIFY place <= 12""",
    "jn18_find_symbols": f"""WITH {RANGES_SQL}, s AS (SELECT owner, name, start % 3 AS c, min(start) AS start FROM r GROUP BY 1, 2, 3), q AS (SELECT owner % 50 AS path, 'C' || c || '_' || owner || '.' || name AS qualified, name, start FROM s),
      a AS (SELECT o_orderkey AS id, o_orderkey % 50 AS path, o_custkey % 2 = 0 AS plain FROM orders)
      SELECT id, qualified, start, place FROM (SELECT id, qualified, start, row_number() OVER (PARTITION BY id ORDER BY start, qualified) AS place, plain FROM a JOIN q ON q.path = a.path AND CASE WHEN plain THEN q.name = 's1' ELSE q.qualified = 'C1_' || id || '.s2' END) WHERE NOT plain OR place <= 5""",
    "jn19_picked_files": f"""WITH {FILES_SQL}, r AS (SELECT o_orderkey AS k, f.doc_id, f.path, f.reason FROM orders LEFT JOIN judged f ON f.doc_id = o_custkey), e AS (SELECT CASE WHEN k % 3 = 2 OR (k % 3 = 1 AND path IS NULL) THEN NULL WHEN k % 3 = 0 AND doc_id IS NULL THEN 'unknown file' WHEN k % 6 = 3 THEN 'file_id and path differ'
      WHEN reason = 'too_large' THEN 'unavailable' WHEN reason IS NOT NULL THEN 'not analysed: ' || reason END AS error, path, k FROM r) SELECT error, count(*) AS requests, count(*) FILTER (error IS NULL AND path IS NOT NULL AND k % 3 <> 2) AS paths FROM e GROUP BY 1""",
    "agg2_host_counts": f"WITH {FILES_SQL} SELECT project_id, language, count(*) FILTER (reason IS NULL) AS files, count(reason) AS warnings FROM judged GROUP BY 1, 2",
    "agg5_coverage": f'WITH {RANGES_SQL} SELECT owner, count(*) FILTER ("end" <= 50) AS "full", count(*) FILTER (start <= 50 AND "end" > 50) AS partial, count(*) FILTER (start > 50) AS omitted FROM r GROUP BY 1',
    "agg7_verification": """SELECT l_orderkey, count(*) FILTER (l_suppkey % 3 = 0 AND l_partkey % 2 = 0) AS source_verified, count(*) FILTER (l_suppkey % 3 = 1 OR (l_suppkey % 3 = 0 AND l_partkey % 2 = 1)) AS hypothesis, count(*) FILTER (l_suppkey % 3 = 2) AS unsupported FROM lineitem GROUP BY 1""",
    "agg9_explain": "WITH w AS (SELECT lang, list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: length(x)) AS n FROM documents), c AS (SELECT lang, len(n) AS w, len(list_filter(n, lambda x: x >= 12)) AS h FROM w) SELECT lang, count(*) AS answers, count(*) FILTER (h > 0) AS with_hits, round_even(sum(h) * 100.0 / sum(w), 2) AS per_100 FROM c GROUP BY 1",
    "agg11_report": "SELECT event_type, user_id % 3 AS depth, count(*) AS requests, round(median(value), 6) AS median, round(max(value), 6) AS most, count(*) FILTER (event_id % 7 <> 0) AS valid, max(event_id % 3 + 1) AS attempts FROM events GROUP BY 1, 2",
    "agg15_outcomes": f"WITH {OUTCOMES_SQL} SELECT request, CASE WHEN possible > 0 OR problems > 0 THEN 'possible_problems' ELSE 'no_clear_problem' END AS outcome, possible, worth, problems FROM o",
    "tri4_outcome_text": f"""WITH {OUTCOMES_SQL}, t AS (SELECT list_filter([CASE WHEN possible > 0 THEN possible || ' possible problem' || CASE WHEN possible > 1 THEN 's' ELSE '' END END, CASE WHEN problems > 0 THEN problems || ' rule hit' || CASE WHEN problems > 1 THEN 's' ELSE '' END END,
      CASE WHEN worth > 0 THEN worth || ' point' || CASE WHEN worth > 1 THEN 's' ELSE '' END || ' worth checking' END], lambda x: x IS NOT NULL) AS p FROM o) SELECT CASE WHEN len(p) = 0 THEN 'No clear problem found.' ELSE array_to_string(p, ', ') || '.' END AS said, count(*) AS requests FROM t GROUP BY 1""",
    "tri3_pattern_checks": f"""WITH {RANGES_SQL}, h AS (SELECT owner AS request, start || '-' || "end" || '-' || name AS hit, name AS rule, start, "end" AS z, start % 2 AS weak FROM r)
      SELECT request, 'P' || row_number() OVER (PARTITION BY request ORDER BY weak, start, rule, hit) AS id, hit, rule, coalesce(start >= o_custkey % 30 AND z <= o_custkey % 30 + 60, false) AS shown FROM h LEFT JOIN orders ON o_orderkey = request""",
    "ver2_sections": f"""WITH k AS ({KEYS_SQL}), o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ord FROM k), u AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY ord) AS n FROM o WHERE l_suppkey % 3 <> 0 OR l_partkey % 2 <> 0)
      SELECT l_orderkey AS request, n, CASE WHEN l_suppkey % 3 = 0 THEN ' ' ELSE 't' || l_suppkey END AS title, CASE WHEN l_partkey % 4 < 3 THEN 'f' || (l_suppkey % 5) END AS path, CASE WHEN l_partkey % 4 IN (0, 2) THEN l_partkey % 9 END AS start, CASE WHEN l_partkey % 4 IN (0, 2) THEN l_partkey % 9 + 2 END AS "end",
        ['in_context', 'file_only', 'outline_only', 'rejected'][CAST(l_partkey % 4 + 1 AS INTEGER)] AS status FROM u WHERE n <= 4""",
    "ver5_citations": f'WITH {RANGES_SQL} SELECT owner, count(*) AS kept, CAST(sum(start) AS BIGINT) AS starts FROM r JOIN orders ON o_orderkey = owner WHERE start >= o_custkey % 50 + 1 AND "end" <= o_custkey % 50 + 45 GROUP BY 1',
    "set1_all_paths": f"WITH {FILES_SQL} SELECT DISTINCT path FROM files",
    "set2_clashes": "SELECT DISTINCT 'd' || (a.p_partkey % 30) AS key FROM part a WHERE a.p_partkey % 4 = 0 AND EXISTS (SELECT 1 FROM part b WHERE b.p_partkey % 4 <> 0 AND b.p_partkey % 30 = a.p_partkey % 30)",
    "set5_strangers": f"""WITH {SCRIPTS_SQL}, d AS (SELECT DISTINCT source, target FROM e WHERE target IS NOT NULL), n AS (SELECT source AS path, target AS near FROM d UNION SELECT target, source FROM d), k AS (SELECT path, count(*) AS neighbours, CAST(regexp_extract(path, 'm([0-9]+)', 1) AS BIGINT) AS k FROM n GROUP BY 1),
      m AS (SELECT path, neighbours, unnest(list_distinct([k + 1, k * 7 % 2100])) AS x FROM k) SELECT path, neighbours, count(*) FILTER (NOT EXISTS (SELECT 1 FROM n WHERE n.path = m.path AND n.near = 'pkg' || (x % 7) || '/m' || x || '.js')) AS strangers FROM m GROUP BY 1, 2""",
    "set7_limitations": """WITH n AS (SELECT 'n' || (l_partkey % 5) AS a, 'n' || (l_partkey % 3) AS b, 'n' || (l_suppkey % 4) AS c, 'n' || l_linenumber AS d FROM lineitem) SELECT concat_ws(',', a, CASE WHEN b <> a THEN b END, CASE WHEN c NOT IN (a, b) THEN c END, CASE WHEN d NOT IN (a, b, c) THEN d END) AS notes, count(*) AS answers FROM n GROUP BY 1""",
    "set8_tokens": """WITH w AS (SELECT DISTINCT conv_id, role, unnest(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]+')) AS w FROM conversations), u AS (SELECT DISTINCT conv_id, w FROM w WHERE role = 'assistant'), q AS (SELECT DISTINCT conv_id, w FROM w WHERE role = 'user'), c AS (SELECT DISTINCT conv_id FROM w)
      SELECT c.conv_id, count(u.w) AS used, count(u.w) FILTER (q.w IS NULL) AS new FROM c LEFT JOIN u USING (conv_id) LEFT JOIN q ON q.conv_id = u.conv_id AND q.w = u.w GROUP BY 1""",
    "srt2_edges": f"WITH {SCRIPTS_SQL}, d AS (SELECT DISTINCT source, specifier, status, target FROM e) SELECT *, row_number() OVER (PARTITION BY source ORDER BY specifier, coalesce(target, ''), status) AS place FROM d",
    "srt3_entries": f"""WITH {FILES_SQL}, e AS (SELECT project_id, path, CASE WHEN doc_id % 7 = 3 THEN 'unreferenced_page' WHEN doc_id % 7 = 0 AND doc_id % 3 = 0 THEN 'main_guard' END AS entry FROM judged WHERE reason IS NULL AND doc_id % 31 <> 0)
      SELECT project_id, path, entry AS reason, row_number() OVER (PARTITION BY project_id ORDER BY length(path) - length(replace(path, '/', '')), path) AS place FROM e WHERE entry IS NOT NULL""",
    "srt14_omitted": f"""WITH {RANGES_SQL}, o AS (SELECT owner % 20 AS request, start, row_number() OVER (PARTITION BY owner % 20 ORDER BY owner::VARCHAR, name, start, "end") AS n, count(*) OVER (PARTITION BY owner % 20) AS total FROM r) SELECT request, count(*) AS shown, max(total) AS total, CAST(sum(start) AS BIGINT) AS starts FROM o WHERE n <= 200 GROUP BY 1""",
    "str3_quotes": "SELECT conv_id, turn, CASE WHEN least(length(text), conv_id % 200) >= 140 THEN '' ELSE substr(text, 1, conv_id % 200) END AS quote FROM conversations",
    "str10_labels": f"""WITH {RANGES_SQL}, g AS (SELECT owner, min(start) AS a, max("end") AS z, list_sort(list_distinct(list(name))) AS n FROM r GROUP BY 1) SELECT owner, CASE WHEN a = z THEN 'line ' || a ELSE 'lines ' || a || '–' || z END AS lines, array_to_string(n[1:2], ', ') || CASE WHEN len(n) > 2 THEN ' (+' || (len(n) - 2) || ' more)' ELSE '' END AS names,
      CAST(CAST(round_even(owner * 10240 / 1048576.0, 1) AS DECIMAL(18, 1)) AS VARCHAR) || ' MiB' AS size FROM g""",
    "str14_excerpts": r"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls, doc_id % 4 + 1 AS a, doc_id % 4 + 1 + least(doc_id % 25, 14) AS z FROM documents) SELECT doc_id, coalesce(array_to_string(list_transform(ls[a:z], lambda x: CASE WHEN length(rtrim(x, ' ')) > 400 THEN substr(rtrim(x, ' '), 1, 400) || ' [...]' ELSE rtrim(x, ' ') END), chr(10)), '') AS excerpt FROM d""",
    "str16_marked_lines": "WITH c AS (SELECT conv_id, turn, string_split(text, '. ') AS ls FROM conversations), x AS (SELECT *, unnest(range(0, len(ls))) AS n FROM c) SELECT conv_id, turn, n + 10 AS number, ls[n + 1] AS line, n >= conv_id % 3 AND n <= conv_id % 3 + 1 AS hit FROM x",
    "str19_placeholder": r"""WITH c AS (SELECT conv_id, turn, string_split(text, '. ') AS ls FROM conversations), x AS (SELECT conv_id, turn, ls, unnest(range(1, len(ls) + 1)) AS i FROM c), y AS (SELECT conv_id, turn, i, repeat(' ', (i - 1) % 4) || ls[i] AS line FROM x)
      SELECT conv_id, turn, string_agg(CASE WHEN i = turn % 3 + 1 THEN regexp_extract(line, '^(\s*)', 1) || CASE conv_id % 3 WHEN 0 THEN '# Restore the missing line here' WHEN 1 THEN '<!-- Restore the missing line here -->' ELSE '/* Restore the missing line here */' END ELSE line END, chr(10) ORDER BY i) AS text FROM y GROUP BY 1, 2""",
    "mth2_budgets": "SELECT CASE WHEN l_linenumber % 2 = 0 THEN least(b, 1500) ELSE b END AS budget, count(*) AS requests FROM (SELECT l_linenumber, greatest(l_partkey % 5000 - l_suppkey % 900 - 128, 0) AS b FROM lineitem) GROUP BY 1",
    "mth5_layout": "SELECT event_id, CASE WHEN event_id % 900 < 150 THEN 150 WHEN event_id % 900 > user_id % 1000 + 160 THEN greatest(150, user_id % 1000 + 160) ELSE event_id % 900 END AS explorer FROM events",
    "hsh2_seals": """SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"quality":' || quality || ',"toxic":' || toxic || '}') AS seal FROM labels""",
    "jsn2_paths": "SELECT CASE WHEN event_id % 5 < 2 THEN '' ELSE 'p' || (event_id % 7) || '.py|q/' || (event_id % 3) END AS paths, count(*) AS uploads FROM events GROUP BY 1",
    "chl3_hints": "SELECT conv_id, turn, array_to_string(string_split(text, '. ')[1:turn % 4], '|') AS hints, turn % 4 >= len(string_split(text, '. ')) AS \"all\" FROM conversations",
    "stm6_live_replies": "SELECT conv_id, turn AS ord FROM conversations QUALIFY turn // 4 = max(turn // 4) OVER (PARTITION BY conv_id, turn % 2)",
    "grf7_host_entries": "SELECT 'd' || s_suppkey || '/' || ['main.py', 'App.js', 'util.py', 'INDEX.html', 'index.htm', '__main__.py', 'index.js'][CAST(s_suppkey % 7 + 1 AS INTEGER)] AS path FROM supplier WHERE s_suppkey % 7 NOT IN (2, 4)",
}
