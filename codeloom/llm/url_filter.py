"""URL filters as a temporal list join, with DataFrame functions only.

A list is a table of dated entries (key, list, action, day): from that day on the key is on the list (`add`) or not
(`remove`). Entries become validity intervals [day, next day of the same key and list). A capture has the keys of its
URL: its host, each parent domain of two or more labels, and the host with the first one and two path segments. It is joined
as of its fetch day with the intervals of its keys; the longest active key decides, and of equally long ones `allow`.

The day order of one key's entries: of several on one day the last by (action, list) in text order counts. Intervals
are broadcast if few (`SMALL`), else both sides are dealt by key and a salt, so that one host may hold most captures.

Edge cases: null or hostless URLs have no keys and are kept; captures without a day match nothing; keys are compared in
lower case; null keys, days or unknown actions of a list are left out; repeated rows are decided row by row.

`pages` has neither fetch days nor a list, so the query derives both from the table by fixed rules over MD5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.common import read

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
SMALL, SALTS = 20_000, 16
FIRST_DAY = "2024-01-01"


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, HOST, 2))
    return F.when(host != "", host)


def keys_of(url: Column) -> Column:
    """All keys that a list entry may have for this URL."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(F.lower(F.regexp_extract(url, PATH, 1)), "/"), lambda p: p != "")
    paths = F.transform(F.slice(parts, 1, 2), lambda p, i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i + 1), "/")))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(domains, paths))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, list, since, until) from dated entries; until is null while nothing follows."""
    usable = entries.where(F.col("key").isNotNull() & F.col("day").isNotNull() & F.col("action").isin("add", "remove")).select(F.lower("key").alias("key"), "list", "action", "day")
    daily = usable.groupBy("key", "list", "day").agg(F.max("action").alias("action"))
    until = F.lead("day").over(Window.partitionBy("key", "list").orderBy("day"))
    return daily.withColumn("until", until).where("action = 'add'").select("key", "list", F.col("day").alias("since"), "until")


def decided(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (page_id, url, day) with host, decision (keep or drop), list, entry and since."""
    valid = intervals(entries)
    rows = captures.select("page_id", "url", "day", F.monotonically_increasing_id().alias("uid"))
    keyed = rows.select("*", F.explode_outer(keys_of(F.col("url"))).alias("key"))
    if valid.limit(SMALL + 1).count() <= SMALL:
        on, valid = ["key"], F.broadcast(valid)
    else:
        on = ["key", "salt"]
        keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)))
        valid = valid.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    k, v = keyed.alias("k"), valid.alias("v")
    same = [F.col(f"k.{c}") == F.col(f"v.{c}") for c in on]
    active = (F.col("k.day") >= F.col("v.since")) & (F.col("v.until").isNull() | (F.col("k.day") < F.col("v.until")))
    hit = F.struct(F.char_length("v.key").alias("length"), (F.col("v.list") == "allow").alias("allow"), F.col("v.list").alias("list"), F.col("v.key").alias("key"), F.col("v.since").alias("since"))
    both = k.join(v, [*same, active], "left").groupBy("uid", "page_id", "url", "k.day").agg(F.max(F.when(F.col("v.key").isNotNull(), hit)).alias("hit"))
    return both.select("page_id", host_of(F.col("url")).alias("host"), "day", F.when(F.col("hit.list") == "block", "drop").otherwise("keep").alias("decision"), F.col("hit.list").alias("list"), F.col("hit.key").alias("entry"), F.col("hit.since").alias("since"))


def number(key: Column, at: int) -> Column:
    return F.conv(F.substring(F.md5(key), 1 + 6 * at, 6), 16, 10).cast("int")


def fetch_day(page_id: Column) -> Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(page_id * 37, F.lit(366)).cast("int"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """A list over a third of the keys that occur: added on one day, removed later, and half of them added again."""
    keys = pages.select(F.explode(keys_of(F.col("url"))).alias("key")).distinct().where(number(F.col("key"), 0) % 3 == 0)
    first = number(F.col("key"), 1) % 300
    second, third = first + 1 + number(F.col("key"), 2) % 60, first + 61 + number(F.col("key"), 3) % 60
    kind = F.when(number(F.col("key"), 4) % 4 == 0, "allow").otherwise("block")
    on = lambda action, at: F.struct(F.lit(action).alias("action") if isinstance(action, str) else action.alias("action"), at.alias("at"))
    days = F.array(on("add", first), on("remove", second), on(F.when(number(F.col("key"), 1) % 2 == 0, "add"), third))
    rows = keys.select("key", kind.alias("list"), F.explode(days).alias("e"))
    return rows.select("key", "list", "e.action", F.date_add(F.lit(FIRST_DAY).cast("date"), F.col("e.at").cast("int")).alias("day")).where("action is not null")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    told = decided(pages.withColumn("day", fetch_day(F.col("page_id"))), derived_entries(pages))
    return told.withColumns({"day": F.col("day").cast("string"), "since": F.col("since").cast("string")})


OP6_SQL = r"""
WITH parsed AS (
  SELECT page_id, url,
         nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:]*)', 2)), '') AS host,
         list_filter(string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)), '/'), lambda p: p <> '') AS parts,
         DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS day
  FROM pages
), labelled AS (SELECT *, string_split(host, '.') AS labels FROM parsed),
keyed AS (
  SELECT DISTINCT page_id, url, day, key FROM (
    SELECT page_id, url, day, array_to_string(labels[i:], '.') AS key FROM labelled, range(1, 50) r(i) WHERE i <= greatest(len(labels) - 1, 1) AND host IS NOT NULL
    UNION ALL
    SELECT page_id, url, day, host || '/' || array_to_string(parts[1:i], '/') FROM labelled, range(1, 3) r(i) WHERE i <= len(parts) AND host IS NOT NULL)
), hashed AS (
  SELECT key, md5(key) AS m FROM (SELECT DISTINCT key FROM keyed)
), numbers AS (
  SELECT key, CAST('0x' || m[1:6] AS INTEGER) AS n0, CAST('0x' || m[7:12] AS INTEGER) AS n1, CAST('0x' || m[13:18] AS INTEGER) AS n2,
         CAST('0x' || m[19:24] AS INTEGER) AS n3, CAST('0x' || m[25:30] AS INTEGER) AS n4 FROM hashed
), spans AS (
  SELECT key, CASE WHEN n4 % 4 = 0 THEN 'allow' ELSE 'block' END AS list, n1 % 300 AS since, n1 % 300 + 1 + n2 % 60 AS until FROM numbers WHERE n0 % 3 = 0
  UNION ALL
  SELECT key, CASE WHEN n4 % 4 = 0 THEN 'allow' ELSE 'block' END, n1 % 300 + 61 + n3 % 60, 100000 FROM numbers WHERE n0 % 3 = 0 AND n1 % 2 = 0
), hits AS (
  SELECT k.page_id, k.url, s.list, s.key, s.since,
         row_number() OVER (PARTITION BY k.page_id, k.url ORDER BY length(s.key) DESC, s.list = 'allow' DESC, s.since DESC) AS place
  FROM keyed k JOIN spans s ON s.key = k.key AND k.day >= DATE '2024-01-01' + s.since AND k.day < DATE '2024-01-01' + s.until
)
SELECT p.page_id, p.host, strftime(p.day, '%Y-%m-%d') AS day, CASE WHEN h.list = 'block' THEN 'drop' ELSE 'keep' END AS decision, h.list AS list, h.key AS entry,
       strftime(DATE '2024-01-01' + h.since, '%Y-%m-%d') AS since
FROM parsed p LEFT JOIN hits h ON h.page_id = p.page_id AND h.url = p.url AND h.place = 1
"""
