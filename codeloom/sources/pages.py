"""Pages as tables of tags, by patterns on the JVM: what a page refers to, its scripts, styles, ids and title.

A page is cut into pieces: comments, scripts, styles and titles with their content, other tags, and text. Lines are running sums over the pieces of a page.
Attribute values are taken as they stand; character references in them are not resolved. A script, style or comment that is never closed
ends with the page, and so does a tag that is cut off (it is text).

Edge cases: a null or empty page has a row without anything; an attribute that stands twice counts once, as first given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FILE = ["project_id", "path"]
INSIDE = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
HELD = "|".join(rf"<{tag}(?=[\s/>]){INSIDE}>[\s\S]*?(?:</{tag}(?=[\s/>])[^>]*>|\z)" for tag in ("script", "style", "title"))
PIECE = rf"(?i)<!--[\s\S]*?(?:-->|\z)|{HELD}|<[a-z]{INSIDE}>|[^<]++|<"
ATTRIBUTE = r"([^\s\"'=<>/]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?+"
#: Kinds of scripts that are data (fixed values).
DATA_SCRIPTS = ["application/json", "application/ld+json", "importmap", "speculationrules", "text/template", "text/html"]
#: Tags whose src is an asset (fixed values).
ASSET_TAGS = ["img", "source", "video", "audio", "iframe", "embed", "track"]
MOST_IDS, LONGEST_TITLE = 300, 200


def page_tags(files: DataFrame) -> DataFrame:
    """(project_id, path, at, line, tag, attributes, content): the tags that open, in order; attributes is a map by lower-case names."""
    pieces = files.select(*FILE, F.posexplode(F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))).alias("at", "piece"))
    by = Window.partitionBy(*FILE).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    breaks = F.char_length("piece") - F.char_length(F.replace("piece", F.lit("\n"), F.lit("")))
    tags = pieces.withColumn("line", (F.coalesce(F.sum(breaks).over(by), F.lit(0)) + 1).cast("int")).where(F.col("piece").rlike("(?i)^<[a-z]"))
    head = F.regexp_extract("piece", rf"(?i)^<[a-z]{INSIDE}>", 0)
    tag = F.lower(F.regexp_extract(head, r"^<([^\s/>]+)", 1))
    tags = tags.withColumns({"tag": tag, "rest": F.regexp_replace(head, r"^<[^\s/>]+", ""), "content": F.regexp_replace(F.substring("piece", F.char_length(head) + 1, F.char_length("piece")), r"(?i)</(script|style|title)[^>]*>\z", "")})
    names = F.transform(F.regexp_extract_all("rest", F.lit(ATTRIBUTE), F.lit(1)), lambda n: F.lower(n))
    values = F.transform(F.regexp_extract_all("rest", F.lit(ATTRIBUTE), F.lit(2)), lambda v: F.regexp_replace(v, r"^([\"'])([\s\S]*)\1$", "$2"))
    pairs = F.arrays_zip(names.alias("name"), values.alias("value"))
    firsts = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["name"]), p["name"]) == i + 1)
    return tags.select(*FILE, "at", "line", "tag", F.map_from_entries(firsts).alias("attributes"), "content")


def attribute(name: str) -> Column:
    return F.trim(F.coalesce(F.col("attributes")[name], F.lit("")))


def page_refs(tags: DataFrame) -> DataFrame:
    """(project_id, path, at, kind, specifier, line): scripts, style sheets and assets that pages refer to."""
    tag, rel = F.col("tag"), F.split(F.lower(attribute("rel")), r"\s+")
    link = F.when(F.array_contains(rel, "stylesheet"), "stylesheet").when(F.array_contains(rel, "modulepreload"), "script").otherwise("asset")
    kind = F.when((tag == "script") & F.col("attributes")["src"].isNotNull(), "script").when((tag == "link") & (attribute("rel") != ""), link)
    kind = kind.when(tag.isin(ASSET_TAGS) | ((tag == "input") & (F.lower(attribute("type")) == "image")), "asset")
    where = F.when(tag == "link", attribute("href")).otherwise(attribute("src"))
    return tags.select(*FILE, "at", kind.alias("kind"), where.alias("specifier"), "line").where("kind is not null and specifier <> ''")


def parse_pages(files: DataFrame) -> DataFrame:
    """A row for each page in files (project_id, path, text): title, inline_scripts, inline_styles, refs, ids."""
    tags = page_tags(files)
    refs = page_refs(tags).select(*FILE, "at", F.struct("kind", "specifier", "line").alias("ref"))
    tags = tags.join(refs, [*FILE, "at"], "left")
    inline = (F.col("tag") == "script") & F.col("attributes")["src"].isNull() & ~F.lower(attribute("type")).isin(DATA_SCRIPTS)
    title = F.substring(F.trim(F.regexp_replace("content", r"\s+", " ")), 1, LONGEST_TITLE)
    in_order = lambda what, given: F.transform(F.array_sort(F.collect_list(F.when(given, F.struct("at", what.alias("x"))))), lambda s: s["x"])
    found = tags.groupBy(*FILE).agg(
        F.min_by(F.when(F.col("tag") == "title", title), F.when(F.col("tag") == "title", F.col("at"))).alias("title"),
        F.count_if(inline).cast("int").alias("inline_scripts"), F.count_if(F.col("tag") == "style").cast("int").alias("inline_styles"),
        in_order(F.col("ref"), F.col("ref").isNotNull()).alias("refs"), F.slice(in_order(attribute("id"), attribute("id") != ""), 1, MOST_IDS).alias("ids"),
    )
    whole = files.select(*FILE).join(found, FILE, "left")
    none = lambda c: F.coalesce(F.col(c), F.array().cast(found.schema[c].dataType))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return whole.select(*FILE, F.nullif(F.col("title"), F.lit("")).alias("title"), zero("inline_scripts"), zero("inline_styles"), none("refs").alias("refs"), none("ids").alias("ids"))
