"""Checking recorded answers against sources: locations, quotes, tiers, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions import text as T
from codeloom.operators.running import in_ranges, sum_before

MIN_QUOTE_LETTERS = 8


def check_locations(drafts: DataFrame, files: DataFrame, shown: DataFrame, outlined: DataFrame) -> DataFrame:
    """drafts (id, path, start, end, kind) with location and issue.

    files: (path, text, line_count, kept); shown: (path, start, end) ranges that the answer could see; outlined: paths of which
    it saw an outline. Lines that are blank need not have been seen.
    """
    lines = files.where("kept").select("path", F.posexplode(F.split("text", "\n", -1)).alias("n", "line")).where(F.trim("line") != "").select("path", (F.col("n") + 1).alias("line"))
    seen = shown.select("path", F.explode(F.sequence("start", "end")).alias("line")).distinct()
    unseen = lines.join(seen, ["path", "line"], "left_anti")
    path = F.regexp_replace(F.replace(F.trim("path"), F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    d = drafts.withColumns({"raw": F.trim("path"), "path": path}).join(files.select("path", "line_count", "kept"), "path", "left")
    d = d.join(outlined.select("path").distinct().withColumn("is_outlined", F.lit(True)), "path", "left").join(shown.select("path").distinct().withColumn("has_shown", F.lit(True)), "path", "left")
    ok = F.col("kept") & F.col("start").between(1, F.col("end")) & (F.col("end") <= F.col("line_count"))
    cited = d.where(ok).select("id", "path", F.col("start").alias("a"), F.col("end").alias("z"))
    gaps = cited.join(unseen, "path").where(F.col("line").between(F.col("a"), F.col("z"))).groupBy("id").agg(F.count("*").alias("gaps"))
    touch = cited.join(shown, "path").where((F.col("start") <= F.col("z")) & (F.col("a") <= F.col("end"))).select("id").distinct().withColumn("touches", F.lit(True))
    d = d.join(gaps, "id", "left").join(touch, "id", "left")
    finding, whole = F.col("kind") == "finding", (F.col("start") == 0) & (F.col("end") == 0)
    some = F.coalesce("is_outlined", F.lit(False)) | F.coalesce("has_shown", F.lit(False))
    result = (
        F.when((F.col("raw") == "") & whole, F.struct(F.lit("none").alias("location"), F.when(finding, "NO_LOCATION").alias("issue")))
        .when(F.col("raw") == "", told("rejected", "FILE_NOT_IN_PROJECT")).when(F.col("kept").isNull(), told("rejected", "FILE_NOT_IN_PROJECT")).when(~F.col("kept"), told("rejected", "FILE_EXCLUDED"))
        .when(whole & finding, told("rejected", "NO_LOCATION")).when(whole & some, told("file_only", None)).when(whole, told("rejected", "LINES_NOT_IN_CONTEXT"))
        .when(~ok, told("rejected", "LINES_OUT_OF_RANGE")).when(F.col("gaps").isNull(), told("in_context", None))
        .when(F.coalesce("is_outlined", F.lit(False)) & F.col("touches").isNull(), told("rejected", "LINES_OUTLINE_ONLY")).otherwise(told("rejected", "LINES_NOT_IN_CONTEXT"))
    )
    return d.withColumn("r", result).select(*drafts.columns[:1], "path", "start", "end", "kind", F.col("r.location").alias("location"), F.col("r.issue").alias("issue"))


def told(location: str, issue: str | None) -> Column:
    return F.struct(F.lit(location).alias("location"), F.lit(issue).cast("string").alias("issue"))


def clean_quote(quote: Column) -> Column:
    """Without fence lines, line-number margins and outer backticks."""
    lines = F.filter(F.split(quote, "\n"), lambda x: ~x.rlike(r"^\s*```"))
    kept = F.transform(lines, lambda x: F.regexp_replace(x, r"^\s*\d+\s*\| ?", ""))
    return F.regexp_replace(T.collapsed(F.array_join(kept, " ")), "^`+|`+$", "")


def quote_found(quote: Column, cited: Column) -> Column:
    q = clean_quote(quote)
    return (F.regexp_count(q, F.lit(r"(?U)\p{Alnum}")) >= MIN_QUOTE_LETTERS) & F.contains(T.collapsed(cited), q)


#: Words and characters of a quote's key at most, and the keys that are sent to every executor.
KEY_WORDS, KEY_CHARS, FEW_KEYS = 4, 8, 100_000


def quotes_in(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """(item_id, doc_id): quotes that stand in a text, wherever they start and however short they are. A null or empty quote stands
    in none.

    A key that the quote must share with the text is an equi-join key, so no quote is held against every text: a run of its inner words
    (its first and last may be parts of words of the text), or its first characters if it has none. Texts give runs of only those
    lengths that a quote has; where keys are few, they are sent to every executor and other runs are dropped where they are read."""
    words = lambda c: F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    q = quotes.where(F.char_length("text") > 0).select("item_id", F.col("text").alias("quote"), words(F.col("text")).alias("w"))
    inner = F.greatest(F.size("w") - 2, F.lit(0))
    n = F.when(inner > 0, F.least(inner, F.lit(KEY_WORDS))).otherwise(-F.least(F.char_length("quote"), F.lit(KEY_CHARS)))
    q = q.withColumn("n", n).withColumn("key", run_key(F.when(F.col("n") > 0, F.col("w")).otherwise(F.split("quote", "")), F.when(F.col("n") > 0, 2).otherwise(1), F.abs("n"), F.col("n") > 0))
    lengths = sorted(r["n"] for r in q.select("n").distinct().collect())  # KEY_WORDS + KEY_CHARS at most
    keys = q.select("key").distinct()
    few = keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS

    def runs(parts: str, n: int, are_words: bool) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(parts) - (n - 1)), lambda i: run_key(F.col(parts), i, F.lit(n), F.lit(are_words)))
        return F.when(F.size(parts) >= n, every).otherwise(F.array().cast("array<bigint>"))

    t = texts.select("doc_id", words(F.col("text")).alias("w"), *([F.split("text", "").alias("c")] if any(n < 0 for n in lengths) else []))
    some = F.array_distinct(F.flatten(F.array(F.array().cast("array<bigint>"), *[runs("w", n, True) if n > 0 else runs("c", -n, False) for n in lengths])))
    t = t.select("doc_id", F.explode(some).alias("key"))
    t = t.join(F.broadcast(keys) if few else keys.hint("merge"), "key", "left_semi")
    hits = t.join(q.select("item_id", "key", "quote"), "key").select("item_id", "doc_id", "quote").distinct()
    return hits.join(texts.select("doc_id", "text"), "doc_id").where(F.contains("text", F.col("quote"))).select("item_id", "doc_id").distinct()


def run_key(parts: Column, at: Column, n: Column, are_words: Column) -> Column:
    """A hash of n parts of a text from the at-th on."""
    return F.xxhash64(F.array_join(F.slice(parts, at, n), " "), n, are_words)


def verified(findings: DataFrame) -> DataFrame:
    """findings (id, location, quote_ok, confidence) with verification and the confidence that it allows."""
    v = F.when((F.col("location") == "in_context") & F.col("quote_ok"), "source_verified").when(F.col("location") == "in_context", "hypothesis").otherwise("unsupported")
    c = F.when(v == "source_verified", F.col("confidence")).when(v == "hypothesis", F.when(F.col("confidence") == "high", "medium").otherwise(F.col("confidence"))).otherwise("low")
    return findings.withColumns({"verification": v, "confidence": c})


def survivors(findings: DataFrame, most: int = 3) -> DataFrame:
    """The first drafts of each request; of equal places (or titles without a place) the first; numbered F1, F2, ..."""
    few = findings.where(F.col("ord") <= most)
    key = F.when(F.col("path").isNotNull(), F.concat_ws("|", "path", F.col("start").cast("string"), F.col("end").cast("string"), "category")).otherwise(F.concat(F.lit("unlocated|"), F.lower(F.trim("title"))))
    first = few.withColumn("__k", F.row_number().over(Window.partitionBy("request_id", key).orderBy("ord"))).where("__k = 1").drop("__k")
    return first.withColumn("finding_id", F.concat(F.lit("F"), F.row_number().over(Window.partitionBy("request_id").orderBy("ord")).cast("string")))


#: Claims about inputs that the code was never shown to receive (fixed values): the words, and the Python value None unless "of" follows.
ASSUMED = [
    r"empty", r"blank", r"null", r"undefined", r"nan", r"(?:un)?validat\w*", r"(?:un)?sanitiz\w*", r"(?:un)?sanitis\w*", r"(?:error|input|exception)\s+handling",
    r"(?:invalid|unexpected|unusual|malformed|improper|illegal|negative|non-numeric|non-integer|incorrect\s+type|wrong\s+type)\s+(?:\w+\s+){0,2}?(?:input|value|argument|parameter|data|type|format|number|quantit\w+|price)s?",
    r"(?:missing|lack\s+of|lacks|lacking|without|no|insufficient|absent)\s+(?:\w+\s+){0,3}?(?:checks?|checking|handling|validation|guards?|verification)",
    r"(?:missing|absent)\s+(?:input|value|argument|parameter|data|field|key|element|item)s?", r"edge[\s-]cases?", r"corner[\s-]cases?", r"boundary\s+(?:case|condition|check)s?",
    r"divi(?:sion|de|ded|ding)\s+by\s+(?:zero|0)", r"by\s+zero", r"zerodivisionerror", r"unhandled\s+(?:input|value|case)s?",
]
ASSUMED_VALUE = r"\bNone\b(?!\s+of\b)"
#: How much of a problem's text is read for it (fixed value).
PROBLEM_CHARS = 90


def assumes_input(title: Column, problem: Column) -> Column:
    """Whether a finding's title or the beginning of its problem is about inputs alone."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.substring(F.coalesce(problem, F.lit("")), 1, PROBLEM_CHARS))
    return text.rlike(rf"(?iU)\b(?:{'|'.join(ASSUMED)})\b") | text.rlike(ASSUMED_VALUE)


def tiered(findings: DataFrame) -> DataFrame:
    """findings (request_id, ord, verification, in_demo, title, corroborated, and problem if they have one) with reasons, tier and place."""
    problem = F.col("problem") if "problem" in findings.columns else F.lit("")
    reasons = F.array_compact(F.array(
        F.when(F.col("verification") == "unsupported", "LOCATION_NOT_VERIFIED").when(F.col("verification") == "hypothesis", "QUOTE_NOT_MATCHED"), F.when(F.col("in_demo"), "IN_DEMO_CODE"),
        F.when(assumes_input(F.col("title"), problem), "INPUT_ASSUMPTION"), F.when(F.col("corroborated"), "CORROBORATED_BY_RULE"),
    ))
    rows = findings.withColumn("reasons", reasons)
    tier = F.when(F.col("corroborated") | (F.size("reasons") == 0), "possible_problem").otherwise("worth_checking")
    rows = rows.withColumn("tier", tier)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("request_id").orderBy(F.col("tier") != "possible_problem", "ord")))


def latency(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, median, nearest-rank 90th percentile (half-even place) and maximum of each group, from counts of its distinct values over
    ranges of them: no group meets in one task."""
    keys = list(keys)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    ranged = sum_before(in_ranges(counts, keys, [value]), keys, [value], "c", "before")
    sizes = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.max(value).alias("max"))
    held = sizes.select(*[F.col(k).alias(f"_{k}") for k in keys], "n", "max")
    both = held.join(ranged, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    at = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("c")), F.col(value)))
    last = F.col("n") - 1
    found = both.groupBy(*[F.col(f"_{k}").alias(k) for k in keys], "n", "max").agg(at(F.floor(last / 2)).alias("lo"), at(F.ceil(last / 2)).alias("hi"), at(F.bround(F.lit(0.9) * last)).alias("p90"))
    return found.select(*keys, "n", ((F.col("lo") + F.col("hi")) / 2).alias("median"), "max", "p90")


def rates(rows: DataFrame, *keys: str) -> DataFrame:
    """rows (has_bug, reported, hits, words): clean and buggy runs, their rates, and hits per 100 words."""
    clean, buggy = ~F.col("has_bug"), F.col("has_bug")
    share = lambda a, b: F.bround(F.try_divide(F.sum(F.when(a, 1.0).otherwise(0.0)), F.sum(F.when(b, 1.0).otherwise(0.0))), 3)
    return rows.groupBy(*keys).agg(
        F.count_if(clean).alias("clean_runs"), F.count_if(buggy).alias("buggy_runs"), share(clean & ~F.col("reported"), clean).alias("silent_on_clean"), share(buggy & F.col("reported"), buggy).alias("recall"),
        F.bround(F.try_divide(F.sum("hits") * 100.0, F.sum("words")), 2).alias("hits_per_100"),
    )


VOWELS = "[aeiouyäöüáéíóúàèìòùâêîôû]+"


def grade(text: Column) -> Column:
    """Readability grade: 0.39 words a sentence + 11.8 syllables a word - 15.59, to one place."""
    words = F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0))
    n, sentences = F.size(words), F.greatest(F.regexp_count(text, F.lit("[.!?]+")), F.lit(1))
    syllables = F.aggregate(words, F.lit(0), lambda a, w: a + F.greatest(F.regexp_count(F.lower(w), F.lit(VOWELS)), F.lit(1)))
    return F.when(n > 0, F.bround(0.39 * n / sentences + 11.8 * syllables / n - 15.59 + 1e-9, 1))
