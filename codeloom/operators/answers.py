"""What is asked and what is shown: uploads, scopes, citations, outcomes, excerpts, symbol lookups and relations between files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions import text as T
from codeloom.session import by_merge

#: Folders that the upload form leaves out (fixed values).
FORM_FOLDERS = ["node_modules", ".git", ".venv", "venv", "__pycache__", "dist", "build", ".next"]
#: File names that start a program for the host (fixed values).
HOST_ENTRIES = ["index.html", "main.py", "app.py", "__main__.py", "main.js", "app.js", "index.js"]
#: Limits of an upload (fixed values).
UPLOAD_FILES, UPLOAD_BYTES, SOURCE_BYTES, SNIPPET_CHARS = 1000, 10 << 20, 100 << 10, 100_000
#: Longest quote, lines and characters of an excerpt, sections and imports shown (fixed values).
QUOTE_CHARS, EXCERPT_LINES, LINE_CHARS, SECTIONS, IMPORTS, SYMBOLS, REGIONS = 140, 15, 400, 4, 4, 5, 200
#: What stands where a line was taken out, by language (fixed values).
PLACEHOLDERS = {"python": "# Restore the missing line here", "html": "<!-- Restore the missing line here -->"}
PLACEHOLDER = "/* Restore the missing line here */"


def one_of(first: Column, *rest: Column) -> Column:
    """The first of several verdicts that is not null."""
    return F.coalesce(first, *rest)


def host_path(path: Column) -> Column:
    """The path of an uploaded file, null if it is not safe: relative, without `.`, `..`, drives or NUL; empty parts go."""
    name = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.split(name, "/")
    bad = (name == "") | F.contains(name, F.lit("\0")) | F.startswith(name, F.lit("/")) | F.exists(parts, lambda p: p.isin("..", ".") | F.contains(p, F.lit(":")))
    return F.when(~bad, F.array_join(F.filter(parts, lambda p: p != ""), "/"))


def in_form(path: Column) -> Column:
    """Whether the upload form keeps a file of a chosen folder."""
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in FORM_FOLDERS])) & ~F.startswith(F.lower(T.base_name(path)), F.lit(".env"))


def upload_verdicts(files: DataFrame, *keys: str) -> DataFrame:
    """(keys, error): the first reason against each upload of files (name, size)."""
    sources = F.bool_and(F.lower("name").rlike(r"\.(py|js|html|htm|css)$"))
    got = files.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("size").alias("total"), sources.alias("sources"), F.max("size").alias("most"))
    error = F.when(F.col("n") > UPLOAD_FILES, "too many").when(F.col("total") > UPLOAD_BYTES, "too large").when(~F.col("sources"), "no source").when(F.col("most") > SOURCE_BYTES, "file too large")
    return got.select(*keys, error.alias("error"))


def range_label(start: Column, end: Column) -> Column:
    return F.when(start == end, F.concat(F.lit("line "), start.cast("string"))).otherwise(F.concat(F.lit("lines "), start.cast("string"), F.lit("–"), end.cast("string")))


def listed(names: Column, most: int) -> Column:
    """`a, b (+2 more)`."""
    more = F.size(names) - most
    return F.concat(F.array_join(F.slice(names, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(""))


def effective_scope(chosen: Column, readable: Column, has_range: Column) -> Column:
    """The chosen scope, or the nearest one that is available."""
    open_ = F.when(chosen == "project", True).when(chosen == "file", readable).otherwise(readable & has_range)
    return F.when(open_, chosen).when(readable, "file").otherwise("project")


def step_label(path: Column, start: Column, end: Column, status: Column) -> Column:
    """What is shown as the place of a step; null if it was not verified."""
    lines = F.concat(path, F.lit(" · "), range_label(start, end), F.when(status == "outline_only", " (signature only)").otherwise(""))
    return F.when(path == "", None).when(status == "file_only", path).when(status.isin("in_context", "outline_only"), lines)


def excerpt(lines: Column, start: Column, end: Column) -> Column:
    """The first lines of a range, each without trailing blanks and cut where it is long."""
    n = F.least(end - start + 1, F.lit(EXCERPT_LINES)).cast("int")
    cut = lambda x: F.when(F.char_length(x) > LINE_CHARS, F.concat(F.left(x, F.lit(LINE_CHARS)), F.lit(" [...]"))).otherwise(x)
    return F.array_join(F.transform(F.slice(lines, start.cast("int"), n), lambda x: cut(F.rtrim(x))), "\n")


def without_line(lines: Column, at: Column, language: Column) -> Column:
    """The lines with the at-th replaced by a placeholder in the language's comment, at the same indent."""
    table = F.create_map(*[F.lit(x) for kv in PLACEHOLDERS.items() for x in kv])
    mark = F.coalesce(F.element_at(table, language), F.lit(PLACEHOLDER))
    return F.transform(lines, lambda x, i: F.when(i + 1 == at, F.concat(F.regexp_extract(x, r"^(\s*)", 1), mark)).otherwise(x))


def find_symbols(wanted: DataFrame, symbols: DataFrame) -> DataFrame:
    """wanted (id, path, name) with the symbols (path, qualified, name, start) that it means: those with exactly this qualified name, else
    the first few with this plain name."""
    wanted = by_merge(wanted)
    s = symbols.select("path", F.col("qualified"), F.col("name").alias("plain"), "start")
    exact = wanted.join(s, (wanted["path"] == s["path"]) & (wanted["name"] == s["qualified"])).select("id", F.lit(0).alias("by"), "qualified", "start")
    # no request takes more than the first few of a plain name: so many are kept of each before requests meet them
    few = F.row_number().over(Window.partitionBy("path", "plain").orderBy("start", "qualified"))
    p = s.withColumn("nth", few).where(F.col("nth") <= SYMBOLS).select(F.col("path").alias("_path"), "qualified", "plain", "start")
    plain = wanted.join(p, (wanted["path"] == F.col("_path")) & (wanted["name"] == F.col("plain"))).select("id", F.lit(1).alias("by"), "qualified", "start")
    by_id = Window.partitionBy("id")
    both = exact.union(plain).withColumn("best", F.min("by").over(by_id)).where("by = best")
    place = F.row_number().over(by_id.orderBy("start", "qualified"))
    return both.withColumn("place", place).where((F.col("by") == 0) | (F.col("place") <= SYMBOLS)).select("id", "qualified", "start", F.col("place").cast("long").alias("place"))


def import_map(refs: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, entry, place): the first names that a file (refs: path, line, names) imports from another one's symbols (path, name, kind,
    start, end), by its resolved edges (path, line, target)."""
    named = refs.select("path", "line", F.posexplode("names").alias("at", "name"))
    hit = named.join(edges.select("path", "line", "target").distinct(), ["path", "line"]).join(symbols.select(F.col("path").alias("target"), "name", "kind", "start", "end"), ["target", "name"])
    first = hit.groupBy("path", "line", "target", "at", "name").agg(F.min_by(F.struct("kind", "start", "end"), F.struct("start", "end", "kind")).alias("s"))
    entry = F.concat("name", F.lit(" from "), "target", F.lit(" ("), "s.kind", F.lit(", L"), F.col("s.start").cast("string"), F.lit("-"), F.col("s.end").cast("string"), F.lit(")"))
    once = first.select("path", "line", "target", "at", entry.alias("entry")).groupBy("path", "entry").agg(F.min(F.struct("line", "target", "at")).alias("o"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy("o", "entry")).cast("long")).where(F.col("place") <= IMPORTS).select("path", "entry", "place")


def used_symbols(targets: DataFrame, symbols: DataFrame, most: int = 12) -> DataFrame:
    """(id, name, place): symbols (path, name, start) of a target's dependency (id, path, text) whose name stands in its text."""
    words = targets.select("id", "path", F.explode(F.array_distinct(T.identifiers(F.col("text")))).alias("name"))
    hits = symbols.join(words, ["path", "name"]).select("id", "name", "start")
    return hits.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("start", "name")).cast("long")).where(F.col("place") <= most).select("id", "name", "place")


def picked(requests: DataFrame, files: DataFrame) -> DataFrame:
    """requests (id, file_id, path) with the file that is meant (of a repeated path the first), or why there is none. files: (file_id,
    path, status, reason)."""
    by_id = files.select(F.col("file_id"), F.col("path").alias("id_path"), F.col("status").alias("id_status"), F.col("reason").alias("id_reason"))
    by_path = files.groupBy("path").agg(F.min_by(F.struct("status", "reason"), "file_id").alias("f")).select("path", F.col("f.status").alias("path_status"), F.col("f.reason").alias("path_reason"))
    r = requests.join(by_id, "file_id", "left").join(by_path, "path", "left")
    asked = F.col("file_id").isNotNull()
    path, status, reason = (F.when(asked, F.col(f"id_{c}")).otherwise(F.col(p)) for c, p in (("path", "path"), ("status", "path_status"), ("reason", "path_reason")))
    error = (
        F.when(asked & F.col("id_path").isNull(), "unknown file").when(asked & (F.col("path") != F.col("id_path")), "file_id and path differ").when(~asked & F.col("path").isNull(), None)
        .when(status.isNull() | (status == "skipped"), "unavailable").when(reason.isNotNull(), F.concat(F.lit("not analysed: "), reason))
    )
    return r.select("id", F.when(error.isNull(), path).alias("path"), error.alias("error"))


def host_links(refs: DataFrame, files: DataFrame, ids: DataFrame) -> DataFrame:
    """(source, kind, target, resolved): host relations. refs: (source, kind, value); files: (path, skipped); ids: (path, value) that pages
    define. A reference goes to every candidate that exists, else to its own value. If all files stand in one folder, an absolute module
    is looked for in there too: archives often wrap a project so."""
    folder = F.when(F.contains("path", F.lit("/")), F.split("path", "/")[0])
    around = files.agg(F.min(folder).alias("lo"), F.max(folder).alias("hi"), F.count_if(folder.isNull()).alias("bare")).first()
    wrapper = around["lo"] if around["lo"] == around["hi"] and not around["bare"] else None
    here = T.dir_name(F.col("source"))
    clean = F.regexp_replace("value", r"[?#].*$", "")
    dots = F.char_length(F.regexp_extract("value", r"^(\.*)", 1))
    module = F.replace(F.regexp_replace("value", r"^\.+", ""), F.lit("."), F.lit("/"))
    up = F.filter(F.split(here, "/"), lambda p: p != "")
    base = F.when(dots > 0, F.array_join(F.slice(up, 1, F.greatest(F.size(up) - dots + 1, F.lit(0))), "/")).otherwise("")
    target = F.when(base == "", module).otherwise(F.concat(base, F.lit("/"), module))
    local = F.when(F.startswith(clean, F.lit("/")), F.regexp_replace(clean, "^/+", "")).otherwise(T.normal_path(F.concat_ws("/", F.when(here != "", here), clean)))
    web = ~F.contains("value", F.lit("://")) & ~F.startswith("value", F.lit("//")) & ~F.startswith("value", F.lit("data:")) & ((F.col("kind") != "javascript_import") | F.startswith(clean, F.lit(".")))
    none = F.array().cast("array<string>")
    modules = lambda stem: F.array(F.concat(stem, F.lit(".py")), F.concat(stem, F.lit("/__init__.py")))
    tried = (
        F.when(F.col("kind") == "html_id", none).when(F.col("kind") == "python_import", F.concat(modules(target), F.when((dots == 0) & F.lit(wrapper is not None), modules(F.concat(F.lit(f"{wrapper}/"), module))).otherwise(none)))
        .when(web, F.array(local, F.concat(local, F.lit(".js")), F.concat(local, F.lit("/index.js")))).otherwise(none)
    )
    each = refs.distinct().withColumn("tried", tried)
    there = files.where("not skipped").select("path").distinct()
    by_path = each.select("source", "kind", "value", F.explode("tried").alias("path")).join(there, "path")
    by_id = each.where("kind = 'html_id'").select("source", "kind", "value").join(ids, "value").join(there, "path").select("path", "source", "kind", "value")
    hits = by_path.select("path", "source", "kind", "value").union(by_id).distinct()
    lost = each.join(hits, ["source", "kind", "value"], "left_anti")
    return hits.select("source", "kind", F.col("path").alias("target"), F.lit(True).alias("resolved")).union(lost.select("source", "kind", "value", F.lit(False)))


def inside(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Citations (id, path, start, end) that lie in a supplied chunk (path, start, end)."""
    c = chunks.select(F.col("path").alias("p"), F.col("start").alias("a"), F.col("end").alias("z"))
    return citations.join(c, (F.col("path") == F.col("p")) & (F.col("a") <= F.col("start")) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.col("z")), "left_semi")


def outcomes(findings: DataFrame, hits: DataFrame, *keys: str) -> DataFrame:
    """(keys, outcome, possible, worth, problems): possible problems if a finding (tier) is in the top tier or a hit (strength) is a problem."""
    f = findings.groupBy(*keys).agg(F.count_if(F.col("tier") == "possible_problem").alias("possible"), F.count_if(F.col("tier") != "possible_problem").alias("worth"))
    h = hits.groupBy(*keys).agg(F.count_if(F.col("strength") == "problem").alias("problems"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    both = f.join(h, list(keys), "full")
    return both.select(*keys, F.when(zero("possible") + zero("problems") > 0, "possible_problems").otherwise("no_clear_problem").alias("outcome"), zero("possible").alias("possible"), zero("worth").alias("worth"), zero("problems").alias("problems"))


def outcome_text(possible: Column, worth: Column, problems: Column) -> Column:
    """A sentence about the counts of an outcome."""
    many = lambda n, one: F.concat(n.cast("string"), F.lit(f" {one}"), F.when(n == 1, "").otherwise("s"))
    parts = F.array_compact(F.array(F.when(possible > 0, many(possible, "possible problem")), F.when(problems > 0, many(problems, "rule hit")), F.when(worth > 0, F.concat(many(worth, "point"), F.lit(" worth checking")))))
    return F.when(F.size(parts) == 0, "No clear problem found.").otherwise(F.concat(F.array_join(parts, ", "), F.lit(".")))


def checked_hits(hits: DataFrame, shown: DataFrame) -> DataFrame:
    """hits (request, hit, path, rule, strength, start, focus) in the order of output (P1, P2, ...), with shown: all focus lines were in
    ranges (request, path, a, z) that the answer could see."""
    ranges = shown.where("request is not null").groupBy("request").agg(F.collect_set(F.struct("path", "a", "z")).alias("_ranges"))
    seen = lambda line: F.coalesce(F.exists("_ranges", lambda r: (r["path"] == F.col("path")) & line.between(r["a"], r["z"])), F.lit(False))
    rows = hits.join(ranges.hint("merge"), "request", "left").withColumn("_seen", F.coalesce(F.forall("focus", seen), F.lit(True))).drop("_ranges")
    # a hit that stands twice is seen if all its lines are
    every = F.bool_and("_seen").over(Window.partitionBy("request", "hit")) | F.col("request").isNull() | F.col("hit").isNull()
    place = F.row_number().over(Window.partitionBy("request").orderBy(F.col("strength") != "problem", "start", "rule", "hit"))
    return rows.withColumns({"shown": every, "id": F.concat(F.lit("P"), place.cast("string"))}).select("request", "id", "hit", "rule", "shown")


def sections(drafts: DataFrame) -> DataFrame:
    """The first useful sections of each answer (request, ord, title, description, path, start, end, status), their places only as far as
    they were verified."""
    useful = drafts.where((F.trim("title") != "") | (F.trim("description") != ""))
    first = useful.withColumn("n", F.row_number().over(Window.partitionBy("request").orderBy("ord"))).where(F.col("n") <= SECTIONS)
    lines, path = F.col("status").isin("in_context", "outline_only"), F.col("status").isin("in_context", "outline_only", "file_only")
    return first.select("request", F.col("n").cast("long").alias("n"), "title", F.when(path, F.col("path")).alias("path"), F.when(lines, F.col("start")).alias("start"), F.when(lines, F.col("end")).alias("end"), "status")


def omitted_regions(regions: DataFrame, *keys: str) -> DataFrame:
    """The first regions (path, kind, start, end) of each group in order, with the number of all."""
    by = Window.partitionBy(*keys)
    rows = regions.withColumns({"total": F.count("*").over(by), "n": F.row_number().over(by.orderBy("path", "kind", "start", "end"))})
    return rows.where(F.col("n") <= REGIONS)


def live_replies(replies: DataFrame, *keys: str) -> DataFrame:
    """Replies (scope, epoch, ord) of each conversation's last epoch in its scope; those of earlier ones are stale."""
    last = replies.groupBy(*keys, "scope").agg(F.max("epoch").alias("epoch"))
    return replies.join(last, [*keys, "scope", "epoch"])


def seal(*values: Column) -> Column:
    """A fingerprint of a record: SHA-256 of its JSON."""
    return F.sha2(F.to_json(F.struct(*values)), 256)
