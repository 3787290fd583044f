"""Secret scans with corpus-wide ownership frequency.

Base spans (fixed patterns) and further candidate shapes are found in every whole text. Each candidate's value is
hashed, and the hashes are aggregated over the corpus by distinct repositories and owners. A value that at least
`WIDE` owners or `WIDE_REPOS` repositories hold is a widely copied example; the others are owner-specific and
look live. Further candidates count only if they look live; base spans always stay.

In `documents`, a source stands for the owner, and a source's texts of one language for a repository.

A value that a large part of the corpus holds meets in no one task: ownership is counted before it is shuffled, and the verdicts on
values with more than `HOT` uses (so few that their number is bounded by the candidates' over `HOT`) are sent to the candidates.

Edge cases: null text is empty; null owners are one owner; repeated rows add no owner; spans that overlap a base span
are not added; extra columns, whatever their names, are left out by `secret_scan` and kept by `redact`; an empty table gives an
empty result; a null text stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import fresh, read, row_key, written
from codeloom.llm.spans import Kind, all_spans, apart, count_of, has, joined, like, replaced

ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"

BASE = [
    Kind("assign", ASSIGN, like(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"), lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 6, lambda m: F.regexp_extract(m, ASSIGN, 2)),
    Kind("access", r"AKIA[A-Z0-9]{16,}", has("AKIA")),
    Kind("hex", r"[0-9a-f]{24,}", like(r"[0-9a-f]{24}")),
]


def mixed(value: Column) -> Column:
    """Upper and lower case and digits in about the shares of random text."""
    share = lambda p: F.regexp_count(value, F.lit(p)) * 8 >= F.char_length(value)
    return share("[A-Z]") & share("[a-z]") & (F.regexp_count(value, F.lit("[0-9]")) * 16 >= F.char_length(value))


MORE = [
    Kind("key_block", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?", has("PRIVATE KEY-----")),
    Kind("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", has("eyJ")),
    Kind("bearer", r"(?i:bearer)\x20+([A-Za-z0-9+/_.=~-]{20,}+)", like(r"(?i:bearer)\x20+[A-Za-z0-9+/_.=~-]{20}"), None, lambda m: F.regexp_extract(m, r"\x20+(\S+)", 1)),
    Kind("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,60}:([^\s:/@]{4,60})@", has("://"), None, lambda m: F.regexp_extract(m, r":([^\s:/@]+)@", 1)),
    Kind("random", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+", like(r"[A-Za-z0-9+/_-]{32}"), mixed),
]
WIDE, WIDE_REPOS = 3, 4
#: Uses of a value from which on its verdict is sent to the candidates, and the verdicts and spans that may be sent.
HOT, SENT = 10_000, 200_000


def candidates(text: Column) -> tuple[Column, Column]:
    base = all_spans(text, BASE)
    return base, apart(all_spans(text, MORE, len(BASE)), base)


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, live, owners, repos, uses) from rows (hash, owner, repo): aggregated first by owner and repository, so that
    a value in a third of all rows arrives as one row for each of them."""
    each = spans.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by = each.groupBy("hash").agg(F.countDistinct(F.coalesce("owner", F.lit("\0"))).alias("owners"), F.countDistinct(F.struct("owner", "repo")).alias("repos"), F.sum("n").alias("uses"))
    return by.withColumn("live", (F.col("owners") < WIDE) & (F.col("repos") < WIDE_REPOS))


def told_apart(rows: DataFrame) -> DataFrame:
    """(uid, s, live) of each candidate of rows (uid, owner, repo, base, more): the span s, and whether its value looks live."""
    one = rows.where((F.size("base") > 0) | (F.size("more") > 0)).select("uid", "owner", "repo", F.explode(F.concat("base", "more")).alias("s")).withColumn("hash", F.sha2("s.value", 256))
    known = written(ownership(one).select("hash", "live", "uses"), "owners")
    hot = known.where(F.col("uses") > HOT).select("hash", "live")
    if hot.limit(SENT + 1).count() > SENT:  # more than 10^9 candidates
        return one.join(known, "hash").select("uid", "s", "live")
    seldom = one.join(F.broadcast(hot), "hash", "left_anti").join(known.where(F.col("uses") <= HOT).hint("merge"), "hash")
    return one.join(F.broadcast(hot), "hash").select("uid", "s", "live").union(seldom.select("uid", "s", "live"))


def marked(rows: DataFrame) -> DataFrame:
    """rows (uid, owner, repo, base, more) with live: array of the spans that look live, copied: of the others."""
    told = told_apart(rows).groupBy("uid").agg(
        F.array_sort(F.collect_list(F.when(F.col("live"), F.col("s")))).alias("live"), F.array_sort(F.collect_list(F.when(~F.col("live"), F.col("s")))).alias("copied")
    )
    empty = lambda c: F.coalesce(c, F.array().cast(rows.schema["base"].dataType)).alias(c)
    return rows.join(told, "uid", "left").select(*rows.columns, empty("live"), empty("copied"))


def found(docs: DataFrame, owner: str, repo: str, uid: Column, *keep: Column) -> DataFrame:
    """(uid, owner, repo, base, more, *keep) of each row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(uid.alias("uid"), F.col(owner).cast("string").alias("owner"), F.col(repo).cast("string").alias("repo"), all_spans(text, BASE).alias("base"), all_spans(text, MORE, len(BASE)).alias("more"), *keep)
    return rows.withColumn("more", apart(F.col("more"), F.col("base")))


def secret_scan(docs: DataFrame, owner: str = "source", repo: str = "lang") -> DataFrame:
    """doc_id, counts, base_sha256, spans, and live_spans / copied_spans / n_live / n_copied for each row."""
    rows = written(found(docs, owner, repo, F.monotonically_increasing_id(), F.col("doc_id").cast("long").alias("doc_id")), "secrets")
    told = marked(rows)
    shown = F.array_sort(F.concat("base", F.filter("live", lambda s: s["rank"] >= len(BASE))))
    counts = [count_of(F.col("base"), k.name).alias(f"n_{k.name}") for k in BASE]
    return told.select(
        "doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(shown).alias("spans"),
        F.size("live").cast("long").alias("n_live"), F.size("copied").cast("long").alias("n_copied"), joined(F.col("live")).alias("live_spans"), joined(F.col("copied")).alias("copied_spans"),
    )


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(read(spark, sf_dir, "documents"))


def redact(docs: DataFrame, owner: str = "source", repo: str = "lang", by: str = "[SECRET]") -> DataFrame:
    """docs, live-looking secrets in the texts replaced; examples that many owners hold stay. Same rows and columns.

    One pass over the texts finds the candidates and keeps their places only; a second one, without patterns, replaces what looks
    live. Rows are told apart by a hash of text, owner and repository, on which the result of a row alone depends."""
    key = lambda: row_key(F.col("text"), F.col(owner), F.col(repo))
    rows = found(docs, owner, repo, key()).where((F.size("base") > 0) | (F.size("more") > 0))
    rows = written(rows, "secrets")
    mark, spans = fresh(docs, "row"), fresh(docs, "spans")
    places = F.array_sort(F.collect_set(F.struct("s.start", "s.end")))  # repeated rows have one key
    live = written(told_apart(rows).where("live").groupBy(F.col("uid").alias(mark)).agg(places.alias(spans)), "live")
    n = live.agg(F.sum(F.size(spans)).alias("n")).first()["n"] or 0
    told = docs.withColumn(mark, key()).join(F.broadcast(live) if n <= SENT else live.hint("merge"), mark, "left")
    some = F.col(spans).isNotNull()
    cut = replaced(by)(F.when(some, F.col("text").cast("string")), F.col(spans))
    out = told.withColumn("text", F.when(some, cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
