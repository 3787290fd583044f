"""SentencePiece encoding and decoding by weighted finite-state transducers.

A piece model is compiled into three machines.

* Normaliser: one state whose arcs rewrite characters, and an arc at the start that puts a blank before the text; both, and what happens
  to extra blanks, are read from the model's own normaliser. (A model with a character map is refused.)
* Pieces: a trie over the piece strings that returns to its root with the piece's id; a character that is no piece has
  an arc that gives its UTF-8 bytes' ids (byte fallback). Arcs have weights: of a unigram model what a piece costs (its negative
  score; a byte costs more than any piece), of a byte-pair model the number of ids.
* Order, of byte-pair models: from the state of piece u only pieces t may follow for which merging the characters of u + t by the
  model's scores gives u, t again. Other arcs weigh infinity. A sequence whose neighbours all agree is what the model's merges give for
  the whole text, and for each text there is exactly one, so the path of finite weight is the library's result. A unigram
  model's order machine has one state.

A text is composed with the machines, and the shortest path in the tropical semiring is found by relaxing the arcs position by
position: states are (position, state of the order machine), a state keeps its least weight and the arc it came by. No piece of a
byte-pair model may hold a character followed by U+2581, so a text is cut there, and equal parts share their paths
in a bounded table. Decoding is the inverse: ids to strings or bytes, U+2581 to blanks, without the first one.

Edge cases: null text stays null with no ids; an empty text has none; a U+2581 of the text itself decodes as a
blank (round_trip is false then); repeated rows are encoded each; extra columns, whatever their names, are left out by `encode` and
`digest` and kept by `encoded` (but for a column `piece_ids`, which is replaced); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import give_back, read

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Parts whose paths a worker keeps (twice: new and old), the longest that it keeps, and pairs of pieces whose order it keeps.
KNOWN, LONGEST, PAIRS = 150_000, 32, 300_000
#: Pairs of pieces whose order is kept as arrays (9 bytes each).
ARCS = 1_000_000
UNIGRAM, BYTE_PAIR = 1, 2
NOTHING: dict[str, bool] = {}
#: Bytes of text that are encoded together, and new parts whose arcs are relaxed together.
SLICE, TOGETHER = 1_000_000, 5_000
#: Characters that are looked at together, to see where parts begin.
RUN = 65_536
#: The same two bounds for workers of `encoded`, which hold what a pipeline's earlier stages have left in them: parts whose paths are kept, bytes of text.
FEW_KNOWN, SMALL_SLICE = 50_000, 500_000
PART = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def fields(data: bytes) -> dict[int, list]:
    """The fields of a protocol-buffer message by number: integers, or bytes."""
    found, at = {}, 0

    def number() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            byte = data[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            value = number()
        else:
            size = number() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            value, at = data[at : at + size], at + size
        found.setdefault(key >> 3, []).append(value)
    return found


class Normaliser:
    """The model's normaliser as a transducer of one state: `arcs` rewrite characters, `first` is written before a text."""

    def __init__(self, spec: dict[int, list]):
        flag = lambda k: bool(spec.get(k, [1])[-1])
        if spec.get(2, [b""])[-1]:
            raise ValueError("models that map characters are not supported")
        self.squeeze = flag(4)
        self.arcs = str.maketrans({" ": SPACE} if flag(5) else {})
        self.first = (SPACE if flag(5) else " ") if flag(3) else ""

    def apply(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        return self.first + text.translate(self.arcs) if text else ""


class Machine:
    """The compiled transducers, and a table of paths with two generations of at most `known` parts."""

    def __init__(self, path: str, known: int = KNOWN):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            proto = fields(f.read())
        kind = fields(proto.get(2, [b""])[-1]).get(3, [UNIGRAM])[-1]
        n = model.vocab_size()
        pieces, self.bytes, self.text = {}, [0] * 256, [b""] * n
        for i in range(n):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.bytes[value], self.text[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[model.id_to_piece(i)] = i, model.get_score(i)
                self.text[i] = model.id_to_piece(i).replace(SPACE, " ").encode()
        self.compile(pieces, kind, Normaliser(fields(proto.get(3, [b""])[-1])), known)

    def compile(self, pieces: dict[str, tuple[int, float]], kind: int, normaliser: Normaliser | None, known: int = KNOWN) -> None:
        """pieces: id and score of each piece."""
        if kind not in (UNIGRAM, BYTE_PAIR):
            raise ValueError("only unigram and byte-pair models are supported")
        self.normaliser, self.ordered = normaliser, kind == BYTE_PAIR
        self.type = np.dtype("<u2" if max([i for i, _ in pieces.values()], default=0) < 65536 else "<u4")
        self.id, self.score = {p: i for p, (i, _) in pieces.items()}, {p: s for p, (_, s) in pieces.items()}
        self.byte_weight = 1.0 if self.ordered else 10.0 - min(self.score.values(), default=0.0)
        # states of the trie, and the weight of the arc back to its root (0 where there is none)
        self.trie = {p[:k]: 0.0 for p in self.id for k in range(1, len(p))}
        self.trie.update((p, 1.0 if self.ordered else -x or 1e-30) for p, x in self.score.items())
        self.inside = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        self.own = {p: p for p in self.id}
        self.order: dict[str, dict[str, bool]] = {}
        self.pairs = 0
        self.known, self.old, self.most = {}, {}, known
        self.tables()

    def merged(self, text: str) -> list[str]:
        """The model's merges: always the neighbours that form the piece with the highest score, the leftmost first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, u: str, t: str) -> bool:
        """Whether the order machine has an arc of finite weight from u (empty: its start) to t."""
        if u and u[-1] + t[0] not in self.inside:
            return True
        told = self.order.get(u, {}).get(t)
        if told is None:
            if self.pairs > PAIRS:
                self.pairs = 0
                self.order.clear()
            self.pairs += 1
            told = self.merged(u + t) == ([u, t] if u else [t])
            self.order.setdefault(self.own[u] if u else u, {})[self.own.get(t, t)] = told  # the pieces' own strings, not slices of a text
        return told

    def path(self, part: str) -> list[str]:
        """The shortest path through the composition: pieces, and single characters that fall back to bytes. States are numbered by
        (position, last piece) if the model has an order, else by position alone; of each its least weight and the arc it came by."""
        n, ordered, trie, order = len(part), self.ordered, self.trie, self.order
        best: list[dict[str, tuple[float, int, str]] | None] = [None] * (n + 1)
        best[0] = {"": (0.0, 0, "")}
        for i in range(n):
            for u, (least, _, _) in best[i].items() if best[i] else ():
                after = order.get(u, NOTHING)
                for j in range(i + 1, n + 1):
                    t = part[i:j]
                    weight = trie.get(t)
                    if not weight:
                        if j == i + 1:  # no piece: byte fallback
                            self.relax(best, i, j, u, least + self.byte_weight * len(t.encode()), t)
                        if weight is None:
                            break
                        continue
                    if ordered:
                        told = after.get(t)
                        if told is None:
                            told, after = self.follows(u, t), order.get(u, NOTHING)
                        if not told:
                            continue
                    self.relax(best, i, j, u, least + weight, t)
        if not best[n]:
            raise ValueError(f"no path through {part!r}")
        found, at, state = [], n, min(best[n], key=lambda u: best[n][u][0])
        while at:
            _, start, before = best[at][state]
            found.append(part[start:at])
            at, state = start, before
        return found[::-1]

    def relax(self, best: list, i: int, j: int, u: str, weight: float, t: str) -> None:
        """The arc t from state (i, u), if it leads to its end with less weight than any before."""
        state = t if self.ordered else ""
        to = best[j]
        if to is None:
            best[j] = {state: (weight, i, u)}
        elif state not in to or weight < to[state][0]:
            to[state] = weight, i, u

    def tables(self) -> None:
        """The machines as arrays, for `relaxed`: the trie's arcs by (state, character), the piece that ends at each state, and the order
        machine's known arcs."""
        state = {p: i for i, p in enumerate(["", *self.trie])}
        arcs = sorted((state[p[:-1]] << 21 | ord(p[-1]), i) for p, i in state.items() if p)
        self.arc_keys, self.arc_to = (np.array(x, np.int64) for x in zip(*arcs, strict=True))
        self.piece_at = np.array([self.id.get(p, -1) for p in state], np.int64)
        self.piece = {i: p for p, i in self.id.items()}
        weights = np.zeros(max(self.piece, default=0) + 1)
        weights[list(self.piece)] = [self.trie[p] for p in self.piece.values()]
        self.weights, self.start = weights, len(weights)  # the order machine's start is numbered after all pieces
        self.pair_keys, self.pair_told = np.zeros(0, np.int64), np.zeros(0, bool)
        # characters that stand beside another one in a piece, numbered from 1, and which two stand so
        chars = sorted({c for pair in self.inside for c in pair})
        number = {c: i for i, c in enumerate(chars, 1)}
        self.number, self.beside = np.zeros(0x110000, np.uint16 if len(chars) < 65535 else np.uint32), np.zeros((len(chars) + 1, len(chars) + 1), bool)
        self.number[[ord(c) for c in chars]] = range(1, len(chars) + 1)
        for a, b in self.inside:
            self.beside[number[a], number[b]] = True

    def allowed(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Which arcs of the order machine, from pieces u to pieces t, have a finite weight."""
        key = u << 32 | t
        at = np.minimum(np.searchsorted(self.pair_keys, key), max(0, len(self.pair_keys) - 1))
        if not len(self.pair_keys) or (lost := self.pair_keys[at] != key).any():
            new = np.unique(key[lost] if len(self.pair_keys) else key)
            if len(self.pair_keys) > ARCS:
                self.pair_keys, self.pair_told = np.zeros(0, np.int64), np.zeros(0, bool)
                new = np.unique(key)
            told = [self.merged(("" if k >> 32 == self.start else self.piece[k >> 32]) + self.piece[k & 0xFFFFFFFF]) == [x for x in (self.piece.get(k >> 32), self.piece[k & 0xFFFFFFFF]) if x] for k in new.tolist()]
            to = np.searchsorted(self.pair_keys, new)
            self.pair_keys, self.pair_told = np.insert(self.pair_keys, to, new), np.insert(self.pair_told, to, told)
            at = np.searchsorted(self.pair_keys, key)
        return self.pair_told[at]

    def relaxed(self, parts: list[str]) -> list[bytes]:
        """The ids of many short parts, of characters that are pieces: the relaxation of `path`, for all of them at once, with one state
        for each position. A part in which a position is reached in two states of the order machine goes to `path`."""
        n, size = len(parts), np.array([len(p) for p in parts])
        most, none = int(size.max()), len(self.weights)
        code = np.zeros((n, most), np.int64)
        code[np.arange(most) < size[:, None]] = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        least, last, back = np.full((n, most + 1), np.inf), np.full((n, most + 1), none), np.zeros((n, most + 1), np.int64)
        least[:, 0], twice = 0, np.zeros(n, bool)
        for i in range(most):
            rows = np.flatnonzero((size > i) & np.isfinite(least[:, i]))
            state = np.zeros(len(rows), np.int64)
            for j in range(i + 1, most + 1):
                inside = size[rows] >= j
                rows, state = rows[inside], state[inside]
                key = state << 21 | code[rows, j - 1]
                at = np.minimum(np.searchsorted(self.arc_keys, key), len(self.arc_keys) - 1)
                found = self.arc_keys[at] == key
                rows, state = rows[found], self.arc_to[at[found]]
                if not len(rows):
                    break
                t = self.piece_at[state]
                own, t = rows[t >= 0], t[t >= 0]
                if self.ordered and len(own):
                    fine = self.allowed(last[own, i], t)
                    own, t = own[fine], t[fine]
                    twice[own[np.isfinite(least[own, j]) & (last[own, j] != t)]] = True
                weight = least[own, i] + self.weights[t]
                less = weight < least[own, j]
                own, t = own[less], t[less]
                least[own, j], last[own, j], back[own, j] = weight[less], t, i
        pieces = np.full((n, most), -1, np.int64)
        at, k = size.copy(), most
        while (open_ := np.flatnonzero(at > 0)).size:
            k -= 1
            pieces[open_, k] = last[open_, at[open_]]
            at[open_] = back[open_, at[open_]]
        good = np.isfinite(least[np.arange(n), size]) & ~twice
        count, flat = (pieces >= 0).sum(axis=1), pieces[pieces >= 0].astype(self.type)
        ends = np.cumsum(count)
        return [flat[e - c : e].tobytes() if ok else self.ids_of(p) for p, e, c, ok in zip(parts, ends.tolist(), count.tolist(), good.tolist(), strict=True)]

    def ids_of(self, part: str) -> bytes:
        found = []
        for p in self.path(part):
            found += [self.id[p]] if p in self.id else [self.bytes[b] for b in p.encode()]
        return np.array(found, dtype=self.type).tobytes()

    def cut(self, part: str) -> list[str]:
        """A part, cut where no piece spans its neighbours, so that words share paths with and without marks."""
        inside, at, found = self.inside, 0, []
        for i in range(1, len(part)):
            if part[i - 1 : i + 1] not in inside:
                found.append(part[at:i])
                at = i
        return [*found, part[at:]] if part else []

    def learn(self, cuts: list[str]) -> list[bytes]:
        """Ids of different parts that `cut` leaves whole and the table does not have."""
        short = [c for c in cuts if 1 < len(c) <= LONGEST]
        told = {}
        for lo in range(0, len(short), TOGETHER):
            some = short[lo : lo + TOGETHER]
            told.update(zip(some, self.relaxed(some), strict=True))
        out = [told[c] if c in told else self.ids_of(c) for c in cuts]
        for c, ids in zip(cuts, out, strict=True):
            self.keep(c, ids)
        return out

    def look_up(self, part: str) -> bytes:
        if ids := self.old.get(part):
            return ids
        ids = b"".join([self.known.get(c) or self.old.get(c) or self.learn([c])[0] for c in self.cut(part)])
        self.keep(part, ids)
        return ids

    def again(self, part: str) -> bytes | None:
        """The ids of a part of the old generation, which the new one has from now on: what texts share outlives what one of them has."""
        if ids := self.old.get(part):
            self.keep(part, ids)
        return ids

    def keep(self, part: str, ids: bytes) -> None:
        if len(part) <= LONGEST:
            if len(self.known) >= self.most:
                self.known, self.old = {}, self.known
            self.known[part] = ids

    def encode(self, text: str) -> np.ndarray:
        parts = PART.findall(self.normaliser.apply(text))
        return np.frombuffer(b"".join([self.known.get(p) or self.look_up(p) for p in parts]), dtype=self.type)

    def cut_all(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """What `cut` makes of all texts, numbered by Arrow, and where each text's parts begin (and the last one's end)."""
        whole = "".join(texts.to_pylist())
        code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        begins = np.concatenate(([0], np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)))
        apart, width = np.ones(len(code) + 1, bool), np.ones(len(code) + 1, np.uint8)
        for lo in range(0, len(code), RUN):  # so that arrays of indices stay small
            own = code[lo : lo + RUN + 1]  # and the first character of the next run
            number, blank = self.number[own], own == ord(SPACE)
            apart[lo + 1 : lo + len(own)] = ~self.beside[number[:-1], number[1:]] | (blank[1:] & ~blank[:-1])
            for least in (0x7F, 0x7FF, 0xFFFF):
                width[:-1][lo : lo + RUN] += own[:RUN] > least
        apart[begins] = True
        starts = np.flatnonzero(apart)
        at = np.cumsum(width, dtype=np.int32)[starts] - width[starts]
        parts = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(at), pa.py_buffer(whole.encode()))
        return parts.dictionary_encode(), np.searchsorted(starts, begins)

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of an Arrow array of strings without nulls. Texts are cut where no piece spans the neighbours, for all of them at once, and each of
        the different parts is looked up once; texts of a normaliser that is not known here are taken one by one."""
        if self.normaliser.squeeze or self.normaliser.first != SPACE:
            return [self.encode(t) for t in texts.to_pylist()]
        spaced = pc.replace_substring(pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(SPACE, texts, "")), " ", SPACE)
        coded, begins = self.cut_all(spaced)
        parts = coded.dictionary.to_pylist()
        held = [self.known.get(p) or self.again(p) for p in parts]
        new = [i for i, ids in enumerate(held) if ids is None]
        for i, ids in zip(new, self.learn([parts[i] for i in new]), strict=True):
            held[i] = ids
        size = np.fromiter(map(len, held), np.int64, len(held)) // self.type.itemsize
        start, flat, at = np.cumsum(size) - size, np.frombuffer(b"".join(held), dtype=self.type), coded.indices.to_numpy()
        n = size[at]
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = flat[np.arange(ends[-1]) + np.repeat(start[at] - ends[:-1], n)]
        cut = ends[begins].tolist()
        return [ids[lo:hi] for lo, hi in zip(cut[:-1], cut[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join([self.text[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=1)
def machine_of(path: str, known: int = KNOWN) -> Machine:
    """One machine for all tasks of a Python worker."""
    return Machine(path, known)


def sliced(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs of rows with about `most` bytes of text; a longer text is in a run with few others."""
    group = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // most
    first = np.flatnonzero(np.diff(group, prepend=-1))
    return zip(first.tolist(), np.diff(np.append(first, len(texts))).tolist(), strict=True)


def lists_of(ids: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))


def in_slices(machine: Machine, batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The ids of each text, null ones too, a list array for each slice of a batch: ids have more bytes than texts, and a whole batch's would lie in
    this process and in Spark's at once."""
    for texts in batches:
        for lo, n in sliced(texts, SMALL_SLICE):
            yield lists_of(machine.encode_all(pc.fill_null(texts.slice(lo, n), "")))
            give_back()


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) for each row of docs."""
    path = path or model_path()

    def run(batches):
        machine = machine_of(path)
        for batch in batches:
            for lo, n in sliced(batch.column(1)):
                part = batch.slice(lo, n)
                ids = machine.encode_all(pc.fill_null(part.column(1), ""))
                decoded = pa.array([machine.decode(x) if known else None for known, x in zip(part.column(1).is_valid().to_pylist(), ids, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), lists_of(ids), decoded], names=["doc_id", "ids", "decoded"])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with piece_ids, the ids of each text, after their own columns (an own piece_ids is replaced). Only texts go to Python."""
    path = path or model_path()

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return in_slices(machine_of(path, FEW_KNOWN), batches)

    columns = [c for c in docs.columns if c.lower() != "piece_ids"]
    return docs.select(*columns, run(F.col("text").cast("string")).alias("piece_ids"))


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian 32-bit integers), n_bytes (pieces that are single bytes),
    decoded_sha256 and round_trip (the decoded text is the text) for each row of docs."""
    path = path or model_path()

    def run(batches):
        machine = machine_of(path)
        single = np.zeros(len(machine.text), bool)
        single[machine.bytes] = True
        for batch in batches:
            for lo, n in sliced(batch.column(1)):
                part, rows = batch.slice(lo, n), []
                texts = pc.fill_null(part.column(1), "")
                for t, ids in zip(texts.to_pylist(), machine.encode_all(texts), strict=True):
                    back = machine.decode(ids)
                    rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), int(single[ids].sum()), hashlib.sha256(back.encode()).hexdigest(), back == t))
                n, crc, few, sha, same = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(few, pa.int64()), pa.array(sha), pa.array(same)], names=["doc_id", "n_pieces", "ids_crc32", "n_bytes", "decoded_sha256", "round_trip"])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, n_bytes long, decoded_sha256 string, round_trip boolean")


def op7_piece_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents"))
