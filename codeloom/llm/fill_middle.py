"""Fill-in-middle: texts are cut in three and their middle moved to the end, by DuckDB SQL inside `mapInArrow`.

Each Arrow batch is registered with a DuckDB connection of the Python worker and comes back as Arrow; no row is touched in
Python. The cut points, the form and its order come from the SHA-256 of the document's id, so every run and every retried
task gives the same rows, and nothing is shuffled.

A text is matched into blocks of `BLOCK` code points (`regexp_extract_all`); a part is the whole blocks before its end
(`list_slice`, `array_to_string`) and the code points of the one block in which it ends. Lists are so a small part of the text,
and a very long text needs memory for a few copies of itself only. Rows are worked on in runs of about `SLICE` bytes of text.

Edge cases: a null text is empty, and an empty text is plain (n is 0); a text that holds a sentinel is plain; a null doc_id
hashes as an empty number; repeated rows and ids give a row each, equal ids the same draws; extra columns, whatever their
names, are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import byte_runs, give_back, read

#: Code points of a block: RE2's automaton for it stays small, and lists have a 64th of the text's length.
BLOCK = 64
#: Bytes of text that one statement works on; a longer text is alone.
SLICE = 2_000_000
#: Sizes that DuckDB may use in a Python worker, beyond one text's own copies.
MEMORY = "1GB"
COLUMNS = {
    "doc_id": "long", "n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string",
    "restored": "string", "output_sha256": "string", "restored_sha256": "string",
}


@dataclass(frozen=True)
class FillConfig:
    """seed: stands before the id in what is hashed. plain and spm: percent of documents left as they are, and of the others'
    with the suffix first."""

    seed: str = "1:"
    plain: int = 10
    spm: int = 20
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def part(name: str, start: str, end: str) -> str:
    """The code points from start to end of `name`, a list of blocks."""
    blocks = f"list_slice({name}, {start} // {BLOCK} + 1, {end} // {BLOCK} + 1)"
    points = f"regexp_extract_all(array_to_string({blocks}, ''), '(?s).')"
    # whole blocks between the two block borders, the code points of the first and of the last block
    first = f"regexp_extract_all(coalesce({name}[{start} // {BLOCK} + 1], ''), '(?s).')"
    last = f"regexp_extract_all(coalesce({name}[{end} // {BLOCK} + 1], ''), '(?s).')"
    whole = f"array_to_string(list_slice({name}, {start} // {BLOCK} + 2, {end} // {BLOCK}), '')"
    near = f"array_to_string(list_slice({points}, {start} % {BLOCK} + 1, {end} - {start} // {BLOCK} * {BLOCK}), '')"
    far = f"array_to_string(list_slice({first}, {start} % {BLOCK} + 1, {BLOCK}), '') || {whole} || array_to_string(list_slice({last}, 1, {end} % {BLOCK}), '')"
    return f"CASE WHEN {start} // {BLOCK} = {end} // {BLOCK} THEN {near} ELSE {far} END"


def statement(config: FillConfig, columns: tuple[str, ...]) -> str:
    """SQL over `batch` (doc_id, text). Groups 1 to 4 of the hash's hex digits decide."""
    p, s, m = (quoted(x) for x in (config.prefix, config.suffix, config.middle))
    draw = lambda k: f"('0x' || substr(digest, {8 * k - 7}, 8))::UBIGINT"
    inner = lambda *order: f"regexp_extract(output, '(?s)^' || {' || '.join(f'regexp_escape({x}) || {chr(39)}(.*){chr(39)}' for x in order)} || '$', ['a', 'b', 'c'])"
    return f"""
      WITH hashed AS (SELECT doc_id, text, sha256({quoted(config.seed)} || coalesce(doc_id::VARCHAR, '')) AS digest, regexp_extract_all(text, '(?s).{{1,{BLOCK}}}') AS blocks FROM batch),
      drawn AS (SELECT doc_id, text, blocks, length(text)::UBIGINT AS n, {draw(1)} AS h1, {draw(2)} AS h2, {draw(3)} AS h3, {draw(4)} AS h4 FROM hashed),
      cut AS (
        SELECT doc_id, text, blocks, n::BIGINT AS n, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS z,
          CASE WHEN n = 0 OR contains(text, {p}) OR contains(text, {s}) OR contains(text, {m}) OR h3 % 100 >= {100 - config.plain} THEN 'plain'
               WHEN h4 % 100 < {config.spm} THEN 'spm' ELSE 'psm' END AS form
        FROM drawn),
      parts AS (
        SELECT doc_id, n, form, text, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN z - a END AS middle_chars,
          CASE WHEN form <> 'plain' THEN {part('blocks', '0', 'a')} END AS head, CASE WHEN form <> 'plain' THEN {part('blocks', 'a', 'z')} END AS mid, CASE WHEN form <> 'plain' THEN {part('blocks', 'z', 'n')} END AS tail
        FROM cut),
      moved AS (
        SELECT doc_id, n, form, prefix_chars, middle_chars,
          CASE form WHEN 'plain' THEN text WHEN 'psm' THEN {p} || head || {s} || tail || {m} || mid ELSE {s} || tail || {p} || head || {m} || mid END AS output
        FROM parts),
      split AS (SELECT *, CASE form WHEN 'psm' THEN {inner(p, s, m)} WHEN 'spm' THEN {inner(s, p, m)} END AS f FROM moved),
      done AS (SELECT * EXCLUDE f, CASE form WHEN 'plain' THEN output WHEN 'psm' THEN f.a || f.c || f.b ELSE f.b || f.c || f.a END AS restored FROM split)
      SELECT {', '.join({'output_sha256': 'sha256(output) AS output_sha256', 'restored_sha256': 'sha256(restored) AS restored_sha256'}.get(c, c) for c in columns)} FROM done"""


@lru_cache(maxsize=1)
def connection():
    """One in-memory DuckDB for all tasks of a Python worker. It has one thread, as the task has one core, and never spills to a
    folder of its own."""
    import duckdb

    found = duckdb.connect(":memory:")
    found.execute(f"SET threads = 1; SET memory_limit = '{MEMORY}'; SET temp_directory = ''; SET preserve_insertion_order = true")
    return found


def fill_in_middle(docs: DataFrame, config: FillConfig = FillConfig(), columns: tuple[str, ...] = tuple(COLUMNS)) -> DataFrame:
    """A row for each document, with the named columns: n code points, the form, the parts' lengths (null if plain), the output, the
    text rebuilt from output and form alone, and the SHA-256 of both."""
    sql = statement(config, columns)

    def run(batches):
        duck = connection()
        for batch in batches:
            for lo, n in byte_runs(batch.column(1), SLICE):
                duck.register("batch", pa.Table.from_batches([batch.slice(lo, n)]))
                found = duck.sql(sql).to_arrow_table()
                duck.unregister("batch")
                yield from found.cast(schema).to_batches()
        give_back()

    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(c, kinds[COLUMNS[c]]) for c in columns])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{c} {COLUMNS[c]}" for c in columns))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    return fill_in_middle(read(spark, sf_dir, "documents"), FillConfig(), wanted)


#: The same rows by plain substrings.
OP12_SQL = """
  WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS x FROM documents),
  h AS (SELECT *, length(t) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
  c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS z, CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h)
  SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN a END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN z - a END AS BIGINT) AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, z + 1) || '<M>' || substr(t, a + 1, z - a)
      ELSE '<S>' || substr(t, z + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, z - a) END) AS output_sha256, sha256(t) AS restored_sha256
  FROM c"""
