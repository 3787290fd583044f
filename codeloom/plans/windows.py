"""Queries over ranges, packing, history and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.operators import packing as P
from codeloom.operators import ranges as R
from codeloom.session import spread
from codeloom.sources.tables import table
from codeloom.streaming import sessions as S


def order_ranges(spark, sf_dir):
    """(owner, id, start, end, name): each line item as a range of lines of its order."""
    li = table(spark, sf_dir, "lineitem")
    start = (F.col("l_partkey") % 97 + 1).cast("long")
    rows = li.select(F.col("l_orderkey").alias("owner"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"), F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("name"))
    return spread(rows, li.count(), "owner").dropDuplicates(["owner", "start", "end", "name"])


RANGES_SQL = """r AS (SELECT l_orderkey AS owner, CAST(l_partkey % 97 + 1 AS BIGINT) AS start, CAST(l_partkey % 97 + 1 + CAST(l_quantity AS BIGINT) AS BIGINT) AS "end", 's' || (l_suppkey % 5) AS name
  FROM lineitem GROUP BY ALL)"""


def win7_merge_ranges(spark, sf_dir):
    return R.merged(order_ranges(spark, sf_dir).select("owner", "start", "end"), "owner")


def win8_subtract_ranges(spark, sf_dir):
    r = order_ranges(spark, sf_dir)
    wanted = r.select("owner").distinct().select("owner", F.lit(20).cast("long").alias("start"), F.lit(110).cast("long").alias("end"))
    return R.subtracted(wanted, r.select("owner", "start", "end"), "owner").select("owner", "start", "end")


def win12_span_text(spark, sf_dir):
    m = R.merged(order_ranges(spark, sf_dir).select("owner", "start", "end"), "owner")
    return m.groupBy("owner").agg(R.span_text(F.array_sort(F.collect_list(F.struct("start", "end")))).alias("spans"))


def win13_outermost(spark, sf_dir):
    return R.outermost(order_ranges(spark, sf_dir).select("owner", "start", "end").distinct(), "owner").select("owner", "start", "end", "gap")


def jn10_enclosing(spark, sf_dir):
    r = order_ranges(spark, sf_dir)
    asked = r.select("owner").distinct().select("owner", F.col("owner").alias("id"), (F.col("owner") % 60 + 1).alias("start"), (F.col("owner") % 60 + 5).alias("end"))
    return R.enclosing(r.select("owner", "name", "start", "end"), asked, "owner").select("owner", "symbol", "ambiguous")


def jn11_focus_lines(spark, sf_dir):
    """Which ranges hold a focus line of their order's hits."""
    r = order_ranges(spark, sf_dir)
    hits = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("owner"), F.array(F.col("o_custkey") % 90 + 1, F.col("o_custkey") % 45 + 40).alias("focus"))
    lines = hits.select("owner", F.explode(F.array_distinct("focus")).alias("line"))
    both = r.join(lines, "owner").where(F.col("line").between(F.col("start"), F.col("end")))
    return both.groupBy("owner").agg(F.countDistinct("start", "end", "name").alias("findings"), F.countDistinct("line").alias("lines"))


def jn13_overlap_score(spark, sf_dir):
    """Findings (ranges) against a planted range and an acceptable one: tp, acceptable or fp."""
    r = order_ranges(spark, sf_dir)
    truth = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("owner"), (F.col("o_custkey") % 80 + 1).alias("bug"), (F.col("o_custkey") % 70 + 30).alias("ok"))
    both = r.join(truth, "owner")
    hit = lambda a: R.overlaps(F.col("start"), F.col("end"), F.col(a), F.col(a) + 3)
    score = F.when(hit("bug"), "tp").when(hit("ok"), "acceptable").otherwise("fp")
    return both.groupBy(score.alias("score")).agg(F.count("*").alias("findings"), F.countDistinct("owner").alias("runs"))


def jn14_innermost(spark, sf_dir):
    return R.innermost(order_ranges(spark, sf_dir).select("owner", "start", "end").distinct(), "owner").select("owner", "start", "end")


def jn15_neighbours(spark, sf_dir):
    one = order_ranges(spark, sf_dir).groupBy("owner", "name").agg(F.min("start").alias("start"))
    return R.neighbours(one, "owner")


def agg13_span(spark, sf_dir):
    return order_ranges(spark, sf_dir).groupBy("owner").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("symbols"))


def win9_greedy_pack(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return P.greedy_packed(d, 20_000, "n_chars", ["doc_id"], "source").groupBy("source").agg(F.count_if("placed").alias("placed"), F.sum(F.when(F.col("placed"), F.col("doc_id")).otherwise(0)).alias("ids"))


def win10_prefix_pack(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").withColumn("cost", F.char_length("text").cast("long"))
    return P.prefix_packed(t, 600, "cost", ["turn"], "conv_id").select("conv_id", "turn", "used")


def win11_history_tail(spark, sf_dir):
    return P.tail(table(spark, sf_dir, "conversations"), 3, ["turn"], "conv_id").select("conv_id", "turn", "role")


def win5_first_wins(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey")
    return P.first_of(li, ["l_linenumber", "l_partkey"], "l_orderkey", "l_suppkey")


def win1_numbered_lines(spark, sf_dir):
    b = table(spark, sf_dir, "documents")
    lines = F.split("text", "\n", -1)
    rows = b.select("doc_id", F.char_length(F.size(lines).cast("string")).alias("w"), F.posexplode(lines).alias("n", "line"))
    clip = F.when(F.char_length("line") > 400, F.concat(F.substring("line", 1, 400), F.lit(" +"), (F.char_length("line") - 400).cast("string"), F.lit(" not shown"))).otherwise(F.rtrim("line"))
    return rows.select("doc_id", (F.col("n") + 1).cast("long").alias("line"), F.concat(F.lpad((F.col("n") + 1).cast("string"), F.col("w"), F.lit(" ")), F.lit(" | "), clip).alias("shown"))


def win14_rank_by_degree(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("dependents"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy((F.col("l_suppkey") % 8).alias("g")).orderBy(F.desc("dependents"), "l_suppkey")).cast("long")).where("place <= 5")


def stm1_sessions(spark, sf_dir):
    return S.sessions(table(spark, sf_dir, "events")).select("user_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), F.date_format("last_used", "yyyy-MM-dd HH:mm:ss").alias("last_used"), "uses")


def stm3_concurrent(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("ts").alias("start"), F.timestamp_add("SECOND", (F.floor(F.abs("value")) * 60 + 1).cast("int"), F.col("ts")).alias("end"))
    return S.concurrent(e).groupBy("running").agg(F.count("*").alias("times"))


def srt13_lru(spark, sf_dir):
    return S.evicted(table(spark, sf_dir, "events"), 8).select("user_id", F.date_format("last_used", "yyyy-MM-dd HH:mm:ss").alias("last_used"))


QUERIES = {f.__name__: f for f in (win7_merge_ranges, win8_subtract_ranges, win12_span_text, win13_outermost, jn10_enclosing, jn11_focus_lines, jn13_overlap_score, jn14_innermost, jn15_neighbours, agg13_span, win9_greedy_pack, win10_prefix_pack, win11_history_tail, win5_first_wins, win1_numbered_lines, win14_rank_by_degree, stm1_sessions, stm3_concurrent, srt13_lru)}
LINES_SQL = "l AS (SELECT DISTINCT owner, unnest(range(start, \"end\" + 1)) AS x FROM r), i AS (SELECT owner, x, x - row_number() OVER (PARTITION BY owner ORDER BY x) AS g FROM l), m AS (SELECT owner, min(x) AS start, max(x) AS \"end\" FROM i GROUP BY owner, g)"
ORACLES = {
    "win7_merge_ranges": f"WITH {RANGES_SQL}, {LINES_SQL} SELECT * FROM m",
    "win8_subtract_ranges": f"""WITH {RANGES_SQL}, w AS (SELECT DISTINCT owner FROM r), free AS (SELECT owner, x FROM w, range(20, 111) t(x) WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.owner = w.owner AND x BETWEEN r.start AND r."end")),
      i AS (SELECT owner, x, x - row_number() OVER (PARTITION BY owner ORDER BY x) AS g FROM free) SELECT owner, min(x) AS start, max(x) AS "end" FROM i GROUP BY owner, g""",
    "win12_span_text": f"WITH {RANGES_SQL}, {LINES_SQL} SELECT owner, string_agg(start || '-' || \"end\", ', ' ORDER BY start) AS spans FROM m GROUP BY 1",
    "win13_outermost": f"""WITH {RANGES_SQL}, q AS (SELECT DISTINCT owner, start, "end" FROM r), b AS (SELECT *, max("end") OVER (PARTITION BY owner ORDER BY start, "end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM q)
      SELECT owner, start, "end", start - coalesce(before, 0) - 1 AS gap FROM b WHERE before IS NULL OR start > before""",
    "jn10_enclosing": f"""WITH {RANGES_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY owner, name) > 1 AS twice FROM r), a AS (SELECT DISTINCT owner, owner % 60 + 1 AS s, owner % 60 + 5 AS e FROM r),
      h AS (SELECT a.owner, c.name, c.twice, row_number() OVER (PARTITION BY a.owner ORDER BY c."end" - c.start, -c.start, c.name) AS n FROM a JOIN c ON c.owner = a.owner AND c.start <= a.s AND a.e <= c."end")
      SELECT a.owner, CASE WHEN NOT twice THEN name END AS symbol, coalesce(twice, false) AS ambiguous FROM a LEFT JOIN h ON h.owner = a.owner AND n = 1""",
    "jn11_focus_lines": f"""WITH {RANGES_SQL}, f AS (SELECT DISTINCT o_orderkey AS owner, unnest([o_custkey % 90 + 1, o_custkey % 45 + 40]) AS line FROM orders)
      SELECT r.owner, count(DISTINCT (start, "end", name)) AS findings, count(DISTINCT line) AS lines FROM r JOIN f ON f.owner = r.owner AND line BETWEEN start AND "end" GROUP BY 1""",
    "jn13_overlap_score": f"""WITH {RANGES_SQL}, s AS (SELECT r.owner, CASE WHEN start <= o_custkey % 80 + 4 AND o_custkey % 80 + 1 <= "end" THEN 'tp' WHEN start <= o_custkey % 70 + 33 AND o_custkey % 70 + 30 <= "end" THEN 'acceptable' ELSE 'fp' END AS score
      FROM r JOIN orders ON o_orderkey = owner) SELECT score, count(*) AS findings, count(DISTINCT owner) AS runs FROM s GROUP BY 1""",
    "jn14_innermost": f"""WITH {RANGES_SQL}, q AS (SELECT DISTINCT owner, start, "end" FROM r) SELECT * FROM q WHERE NOT EXISTS (SELECT 1 FROM q o WHERE o.owner = q.owner AND q.start <= o.start AND o."end" <= q."end" AND (o.start, o."end") <> (q.start, q."end"))""",
    "jn15_neighbours": f"WITH {RANGES_SQL}, o AS (SELECT owner, name, min(start) AS start FROM r GROUP BY 1, 2) SELECT owner, name, start, lag(name) OVER w AS previous, lead(name) OVER w AS next FROM o WINDOW w AS (PARTITION BY owner ORDER BY start, name)",
    "agg13_span": f'WITH {RANGES_SQL} SELECT owner, min(start) AS start, max("end") AS "end", count(*) AS symbols FROM r GROUP BY 1',
    "win9_greedy_pack": """WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
      f AS (SELECT source, n, doc_id, n_chars <= 20000 AS placed, CASE WHEN n_chars <= 20000 THEN n_chars ELSE 0 END AS used FROM d WHERE n = 1
        UNION ALL SELECT d.source, d.n, d.doc_id, f.used + d.n_chars <= 20000, CASE WHEN f.used + d.n_chars <= 20000 THEN f.used + d.n_chars ELSE f.used END FROM f JOIN d ON d.source = f.source AND d.n = f.n + 1)
      SELECT source, count(*) FILTER (placed) AS placed, CAST(coalesce(sum(doc_id) FILTER (placed), 0) AS BIGINT) AS ids FROM f GROUP BY 1""",
    "win10_prefix_pack": "SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations) WHERE used <= 600",
    "win11_history_tail": "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3",
    "win5_first_wins": "SELECT l_orderkey, l_suppkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey) = 1",
    "win1_numbered_lines": """WITH b AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), x AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS n FROM b)
      SELECT doc_id, n AS line, lpad(n::VARCHAR, length(len(ls)::VARCHAR)::INTEGER, ' ') || ' | ' || CASE WHEN length(ls[n]) > 400 THEN substr(ls[n], 1, 400) || ' +' || (length(ls[n]) - 400) || ' not shown' ELSE rtrim(ls[n], ' ') END AS shown FROM x""",
    "win14_rank_by_degree": "SELECT l_suppkey, dependents, place FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey % 8 ORDER BY dependents DESC, l_suppkey) AS place FROM (SELECT l_suppkey, count(DISTINCT l_partkey) AS dependents FROM lineitem GROUP BY 1)) WHERE place <= 5",
    "stm1_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
      SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_used, count(*) AS uses FROM s GROUP BY user_id, k""",
    "stm3_concurrent": """WITH e AS (SELECT ts AS a, ts + to_seconds(CAST(floor(abs(value)) * 60 + 1 AS BIGINT)) AS z FROM events), c AS (SELECT a AS t, 1 AS d FROM e UNION ALL SELECT z, -1 FROM e), g AS (SELECT t, sum(d) AS d FROM c GROUP BY 1)
      SELECT CAST(running AS BIGINT) AS running, count(*) AS times FROM (SELECT sum(d) OVER (ORDER BY t) AS running FROM g) GROUP BY 1""",
    "srt13_lru": "SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_used FROM events GROUP BY 1 ORDER BY max(ts) DESC, user_id LIMIT 8",
}
