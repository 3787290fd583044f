"""Archives, fill-in-middle and the prefix trie against brute force, on small fixtures with the cases that go wrong."""

import collections
import hashlib
import io
import random
import re
import struct
import zipfile
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from codeloom.llm import fill_middle, graph_index, ngram_join, prefix_trie, token_store, zip_warc
from codeloom.llm.common import new_path
from codeloom.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
sha = lambda x: hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", ["op11_zip_warc", "op12_fill_middle", "op13_prefix_trie"])
def test_query_matches_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("pages", "documents", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = QUERIES[name](spark, DIR)
    found = c.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df, *names) == sorted(found.fetchall(), key=repr)


# ---- archives

PAGE = "page_id long, url string, html string, payload string, revisit int"
LONG = "<p>é漢</p>" * 40_000


def pages_of(spark):
    same, small = "<html>" + "x" * 200, "tiny"
    texts = [same, same, None, "", small, small, LONG, LONG, "y" * 100, "y" * 100, "z" * 99, "z" * 99]
    data = [(i, f"http://h/{i}", t, "clash", 1) for i, t in enumerate(texts)]
    data += [(0, "http://again", same, "clash", 1), (1, "http://again", same, "clash", 1), (None, "http://none", same, "c", 1), (None, None, "n" * 150, "c", 1), (77, "http://a\r\nb c", "u" * 120 + "\0\r\n\r\n", "c", 1)]
    return spark.createDataFrame(data, PAGE)


def test_archives_hold_every_page_and_store_equal_payloads_once(spark):
    pages = pages_of(spark)
    manifest = zip_warc.write_archives(pages, new_path(spark, "archives"))
    records = zip_warc.read_archives(manifest)
    first = {}
    source = pages.collect()
    for r in source:
        t = r["html"] or ""
        if len(t.encode()) >= 100 and r["page_id"] is not None:
            first[t] = min(first.get(t, r["page_id"]), r["page_id"])
    want = []
    for r in source:
        t = r["html"] or ""
        again = t in first and r["page_id"] != first[t]
        want.append((r["page_id"], len(t.encode()), sha(t), "revisit" if again else "response", first[t] if again else None))
    assert rows(zip_warc.resolved(records), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    stored = {r["page_id"]: (r["payload"], r["url"]) for r in records.where("record_type = 'response' and page_id is not null").collect()}
    assert bytes(stored[6][0]).decode() == LONG and bytes(stored[77][0]).decode() == "u" * 120 + "\0\r\n\r\n" and stored[77][1] == "http://a%0D%0Ab c"
    assert manifest.agg({"records": "sum"}).first()[0] == len(source)
    assert zip_warc.read_archives(manifest.limit(0)).count() == 0


def test_an_empty_table_of_pages(spark):
    manifest = zip_warc.write_archives(spark.createDataFrame([], PAGE), new_path(spark, "archives"))
    assert zip_warc.resolved(zip_warc.read_archives(manifest)).count() == 0


def test_an_altered_payload_is_an_error(spark):
    data = zip_warc.record(1, "http://x", b"a" * 200, sha("a" * 200), None, False)
    assert zip_warc.parsed(data)[5] == b"a" * 200
    with pytest.raises(ValueError, match="altered"):
        zip_warc.parsed(data.replace(b"aaaa", b"aaab", 1))
    with pytest.raises(ValueError, match="cut short"):
        zip_warc.parsed(data[:-1])


def reader(data):
    return lambda offset, length: bytes(data[offset : offset + length])


def zipped(members, comment=b"", method=zipfile.ZIP_STORED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in members.items():
            z.writestr(name, data)
        z.comment = comment
    return bytearray(out.getvalue())


def zip64(data):
    """The same archive with its places in ZIP64 fields: the directory's entries, a ZIP64 end record, its locator, an end record without numbers."""
    members = zip_warc.directory(reader(data), len(data))
    entries, length, start = zip_warc.end_of(reader(data), len(data))
    out = bytearray(data[:start])
    for m in members:
        name, extra = m.name.encode(), struct.pack("<2H3Q", 1, 24, m.size, m.stored, m.header)
        other = struct.pack("<2H4s", 0x5455, 4, b"abcd")
        crc = zlib.crc32(data[zip_warc.start_of(reader(data), m) :][: m.size])
        out += struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45, 45, 0x800, 0, 0, 0, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(other + extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + other + extra
    end = len(out)
    out += struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, entries, entries, end - start, start)
    out += struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1) + struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    return out


def test_directories_of_plain_and_zip64_archives():
    members = {"archive/data.warc.gz": b"abc" * 50, "é/ü.txt": b"", "indexes/index.cdxj": b"line\n"}
    plain = zipped(members, comment=b"a comment with PK\x05\x06 in it, long enough to hold an end record")
    for data in (plain, zip64(zipped(members))):
        found = zip_warc.directory(reader(data), len(data))
        assert [m.name for m in found] == list(members)
        assert [bytes(data[zip_warc.start_of(reader(data), m) :][: m.size]) for m in found] == list(members.values())
    assert zipfile.ZipFile(io.BytesIO(zip64(zipped(members)))).read("archive/data.warc.gz") == b"abc" * 50


def test_damaged_archives_are_errors():
    data = zipped({"a": b"x" * 100})
    bad = {"no end record": data[:-1], "lies beyond": zipped({"a": b"x" * 100})[60:], "damaged": data.replace(b"PK\x01\x02", b"PK\x01\x03")}
    for said, broken in bad.items():
        with pytest.raises(ValueError, match=said):
            zip_warc.directory(reader(broken), len(broken))
    packed = zipped({"a": b"x" * 1000}, method=zipfile.ZIP_DEFLATED)
    with pytest.raises(ValueError, match="stored"):
        zip_warc.start_of(reader(packed), zip_warc.directory(reader(packed), len(packed))[0])
    with pytest.raises(ValueError, match="local header"):
        zip_warc.start_of(reader(data[:0] + b"XX" + data[2:]), zip_warc.directory(reader(data), len(data))[0])


def test_ranges_join_neighbours_up_to_their_bound():
    lines = b"".join(zip_warc.index_line("u v", at, n) for at, n in ((0, 5), (5, 6), (11, 50), (70, 3), (73, 1)))
    assert list(zip_warc.ranges_of(lines, 100, 12)) == [(100, [5, 6]), (111, [50]), (170, [3, 1])]
    assert list(zip_warc.ranges_of(b"", 100)) == []


# ---- fill-in-middle


def filled(doc_id, text):
    t, h = text or "", sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(t)
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or re.search("<[PSM]>", t) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, t, t)
    if h4 % 100 < 20:
        return (doc_id, n, "spm", a, z - a, f"<S>{t[z:]}<P>{t[:a]}<M>{t[a:z]}", t)
    return (doc_id, n, "psm", a, z - a, f"<P>{t[:a]}<S>{t[z:]}<M>{t[a:z]}", t)


def test_fill_in_middle_of_all_lengths(spark):
    rng = random.Random(5)
    texts = [None, "", "a", "<P>", "x<S", "<", "é漢🤷\n" * 5, "tab\t\0nul", "l" * 200_000 + "🤷", "has <M> in it"]
    texts += ["".join(rng.choice("aé漢🤷<>PSM\n\r") for _ in range(n)) for n in [*range(1, 140), 192, 193, 256, 1000] for _ in range(2)]
    data = [(i if i % 50 else None, t, "clash", "f") for i, t in enumerate(texts)] + [(3, "again", "c", "f")] * 2
    df = spark.createDataFrame(data, "doc_id long, text string, form string, blocks string")
    got = rows(fill_middle.fill_in_middle(df), "doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored", "output_sha256", "restored_sha256")
    want = [(*f, sha(f[5]), sha(f[6])) for f in (filled(d, t) for d, t, *_ in data)]
    assert got == sorted(want, key=repr)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_no_rows_and_other_sentinels(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fill_middle.fill_in_middle(none).collect() == []
    config = fill_middle.FillConfig(seed="o'k", plain=0, spm=50, prefix="'.*", suffix="[s]", middle="$m")
    df = spark.createDataFrame([(i, "some text (é) here " * 9) for i in range(40)], "doc_id long, text string")
    found = fill_middle.fill_in_middle(df, config).collect()
    assert all(r["restored"] == "some text (é) here " * 9 for r in found) and {r["form"] for r in found} == {"psm", "spm"}
    assert all(r["output"].startswith("'.*" if r["form"] == "psm" else "[s]") for r in found)


# ---- prefix trie


def trie(data, shared=6, group=100):
    """Rows by building every prefix."""
    turns = collections.defaultdict(list)
    for c, t, role, text in data:
        if c is not None:
            turns[c].append(((t is not None, t), hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v, key=lambda v: v[:2])] for c, v in turns.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % shared
        base = c - (c % group if c >= 0 else -(-c % group))
        whole[c] = tuple(own.get(base, [])[:h] + v[h:])
    members = collections.defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        ((cs[0], len(p), members[p[:-1]][0] if p else None, len(cs), children[p], leaves[p], saved[p], sha(",".join(str(c) for c in cs if len(whole[c]) == len(p)))) for p, cs in members.items()), key=repr
    )


TURN = "conv_id long, turn long, role string, text string, depth long, name string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(seed, hot=0):
    rng = random.Random(seed)
    data = []
    for _ in range(70):
        c = rng.choice([rng.randrange(-250, 30), rng.randrange(0, 1000)])
        kind = rng.randrange(5)
        data += [(c, t, rng.choice(["user", "bot", None]) if kind else "user", "héllo" if not kind else rng.choice(["a", "b", "", None, "漢🤷"])) for t in range(rng.choice([1, 2, 3, 8, 9, 17]))]
    data += [(5000 + c, t, "user", f"t{t % 3}") for c in range(30) for t in range(hot)]
    data += [(None, 0, "user", "lost"), (7, None, "user", "first"), (7, None, "user", "first"), (12345678901, 4, "ab", "c"), (12345678902, 4, "a", "bc"), (-5, 1, "x", "y")]
    data += [(9000, t, "user", "long " * 9) for t in range(67)] + data[:9]
    return data


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_of_random_conversations(spark, monkeypatch, seed):
    monkeypatch.setattr(prefix_trie, "IDS", 3)  # many blocks of ids for a node
    data = conversations(seed, hot=7)
    df = spark.createDataFrame([(*d, 1, "clash") for d in data], TURN)
    assert rows(prefix_trie.prefix_trie(df), *COLUMNS) == trie(data)


def test_tries_without_turns_or_rows(spark):
    df = spark.createDataFrame([], TURN)
    assert prefix_trie.prefix_trie(df).collect() == []
    # 3 and 8 lend no turns of the missing conversation 0, and drop their own only one
    lone = [c for c in range(1, 90) if zlib.crc32(str(c).encode()) % 6 > 0][:4]
    data = [(c, 0, "user", "x") for c in lone]
    df = spark.createDataFrame([(*d, 1, "clash") for d in data], TURN)
    assert rows(prefix_trie.prefix_trie(df), *COLUMNS) == trie(data) == [(lone[0], 0, None, 4, 0, 1, 0, sha(",".join(map(str, lone))))]


def test_dense_names_have_no_gaps(spark):
    df = spark.createDataFrame([(i, i % 37, i % 5) for i in range(500)], "id long, a long, b long")
    named = prefix_trie.dense(df, ["a", "b"], "name", ["id", "a", "b"]).collect()
    pairs = {(r["a"], r["b"]): r["name"] for r in named}
    assert len(named) == 500 and sorted(pairs.values()) == list(range(1, len(pairs) + 1)) and all(pairs[r["a"], r["b"]] == r["name"] for r in named)


# ---- nearest neighbours: every query has enough rows in reach


def test_small_cells_are_filled_up_with_the_next_ones():
    rng = np.random.default_rng(4)
    far = graph_index.unit(rng.normal(size=(6, 16)))
    x = np.concatenate([graph_index.unit(c + 0.05 * rng.normal(size=(400, 16))) for c in rng.normal(size=(20, 16))] + [far])
    for seed in range(4):
        cells = graph_index.Cells.fit(x, 26, seed=seed)
        cells.probes = 1
        own = cells.nearest(x, 1)[:, 0]
        sizes = np.bincount(own, minlength=len(cells.leaves))
        seen = cells.in_reach(x, sizes, 6)
        assert all(sizes[row[row >= 0]].sum() >= 6 and len(set(row[row >= 0])) == (row >= 0).sum() for row in seen)
        assert (seen[:, 0] == own).all()
        assert (np.sort(cells.in_reach(far[:1], sizes, 10**9)[0])[-len(sizes[sizes > 0]) :] >= 0).all()  # more than there are: all cells
    sizes[:] = 0
    assert cells.in_reach(far, sizes, 6).shape[0] == 6


VECTORS = "vec_id long, embedding array<float>, cell int"


@pytest.mark.parametrize("shard_rows", [1, 2])
def test_queries_of_tiny_cells_get_all_their_neighbours(spark, monkeypatch, shard_rows):
    needed = graph_index.Cells.needed
    monkeypatch.setattr(graph_index.Cells, "needed", lambda self, x, k: min(1, needed(self, x, k)))
    rng = np.random.default_rng(6)
    x = rng.normal(size=(30, 4)).astype(np.float32)
    data = [(i, x[i].tolist(), 1) for i in range(30)] + [(3, x[3].tolist(), 1), (3, x[4].tolist(), 1), (None, x[0].tolist(), 1), (40, [0.0] * 4, 1), (41, None, 1)]
    df = spark.createDataFrame(data, VECTORS)
    found = graph_index.nearest(df, df, k=5, shard_rows=shard_rows).collect()
    ranks = collections.Counter(r["query_id"] for r in found)
    assert ranks == {i: 5 for i in range(30)} and not any(r["vec_id"] == r["query_id"] for r in found)
    few = df.where("vec_id < 4")
    assert collections.Counter(r["query_id"] for r in graph_index.nearest(few, few, k=5, shard_rows=shard_rows).collect()) == {i: 3 for i in range(4)}


def test_nearest_of_no_rows(spark):
    none = spark.createDataFrame([], VECTORS)
    some = spark.createDataFrame([(1, [1.0, 0.0], 1)], VECTORS)
    assert graph_index.nearest(none, none).count() == graph_index.nearest(none, some).count() == graph_index.nearest(some, some).count() == 0


def test_token_store_cuts_and_batches_are_those_of_each_document(monkeypatch):
    """op5: documents are hashed together, and small batches encoded together."""
    rng = np.random.default_rng(9)
    documents = [rng.integers(0, 50_000, n).astype("<u2") for n in (0, 1, 7, 8, 63, 64, 65, 5000, 1, 3000)]
    documents = [np.append(d, d.dtype.type(1)) for d in documents]
    assert token_store.all_cuts(documents) == [token_store.cuts(d).tolist() for d in documents]
    assert all(c[-1] == len(d) for c, d in zip(token_store.all_cuts(documents), documents, strict=True))
    batches = [pa.RecordBatch.from_arrays([pa.array([i])] * 3 + [pa.array(["x" * n])], names=list("abcd")) for i, n in enumerate((4, 5, 30, 2, 3))]
    monkeypatch.setattr(token_store, "SLICE", 10)
    got = list(token_store.gathered(iter(batches)))
    assert [b.column(0).to_pylist() for b in got] == [[0, 1], [2], [3, 4]]


def test_tables_of_keys_go_before_others_are_made(spark, monkeypatch):
    """pipeline: near copies' largest tables do not stand beside the shuffles of what comes after them."""
    made, gone, before = {}, [], {}
    write, forget = ngram_join.written, ngram_join.forget

    def written(df, name):
        before[name] = list(gone)
        out = write(df, name)
        made[out._kept_at] = name
        return out

    monkeypatch.setattr(ngram_join, "written", written)
    monkeypatch.setattr(ngram_join, "forget", lambda *tables: (gone.extend(made[t._kept_at] for t in tables), forget(*tables)))
    words = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, words), (2, words + " more"), (3, "other text of its own here now")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in ngram_join.keep_one(docs).collect()) == [1, 3]
    assert before["held"] == ["keys"] and "likely" in before["wanted"]
