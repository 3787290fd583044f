"""What the operators keep small: keys of near copies, and memory and lookups of the piece machines."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from codeloom.llm import ngram_join, piece_fst


def test_sets_have_few_keys_and_linked_ones_share_enough():
    rng = np.random.default_rng(5)
    for n, p, q in ((4, 85, 100), (5, 80, 100)):
        sketcher = ngram_join.Sketcher(n, p, q)
        for size in (3, 20, 90, 400, 2000):
            for _ in range(20):
                both = int(rng.integers(size * p // q, size + 1))
                a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
                b = np.unique(np.concatenate((a[rng.permutation(size)[:both]], rng.integers(0, 2**63, int(rng.integers(0, 1 + size // 6)), dtype=np.uint64))))
                common = len(np.intersect1d(a, b))
                keys = [{k: (need, set(x.tolist())) for k, need, x in sketcher.keys(s)} for s in (a, b)]
                for held in keys:
                    for k, (_, own) in held.items():
                        assert k == ngram_join.PREFIX_BAND or len(own) <= 1.1 * (sketcher.blocks(k)[0] + 1) + 5
                if common * q >= (len(a) + len(b) - common) * p:
                    assert any(len(keys[0][k][1] & keys[1][k][1]) >= max(keys[0][k][0], keys[1][k][0]) for k in keys[0].keys() & keys[1].keys())


def test_texts_are_cut_like_their_parts():
    machine = piece_fst.machine_of(piece_fst.model_path())
    rng = random.Random(2)
    texts = ["".join(rng.choice(["ab", "the", " ", "  ", "▁", ",", "1", "é", "漢", "😀", "\x1e", "\n", "Z"]) for _ in range(rng.randrange(30))) for _ in range(300)]
    spaced = pa.array([machine.normaliser.apply(t) for t in texts])
    coded, begins = machine.cut_all(spaced)
    parts = [coded.dictionary[i.as_py()].as_py() for i in coded.indices]
    want = [[c for part in piece_fst.PART.findall(t) for c in machine.cut(part)] for t in spaced.to_pylist()]
    assert [parts[a:b] for a, b in zip(begins[:-1], begins[1:], strict=True)] == want
    alone = [machine.encode(t).tolist() for t in texts]
    assert [x.tolist() for x in machine.encode_all(pa.array(texts))] == alone
    assert machine.encode_all(pa.array([], pa.string())) == [] and machine.encode_all(pa.array([""]))[0].tolist() == []


def test_cutting_needs_memory_for_little_more_than_the_texts():
    """Also across runs of characters parts begin where they did."""
    machine = piece_fst.machine_of(piece_fst.model_path())
    rng = random.Random(4)
    words = ["ab", "the", " ", "▁", ",", "1", "é", "漢", "😀", "\n", "Z"]
    texts = ["".join(rng.choice(words) for _ in range(150_000)), "", "x" * piece_fst.RUN, "".join(rng.choice(words) for _ in range(60_000))]
    spaced = pa.array([machine.normaliser.apply(t) for t in texts])
    coded, begins = machine.cut_all(spaced)
    parts = coded.dictionary.take(coded.indices).to_pylist()
    want = [[c for part in piece_fst.PART.findall(t) for c in machine.cut(part)] for t in spaced.to_pylist()]
    assert [parts[a:b] for a, b in zip(begins[:-1], begins[1:], strict=True)] == want
    plain = pa.array([" ".join(["word"] * 20_000)] * 10)
    tracemalloc.start()
    machine.cut_all(plain)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25 * plain.nbytes


def test_ids_leave_in_slices(monkeypatch):
    monkeypatch.setattr(piece_fst, "SMALL_SLICE", 1_000)
    machine = piece_fst.Machine(piece_fst.model_path(), known=50)
    texts = [None, "", *[f"text {i} of the batch, é " * (i % 40) for i in range(200)], None]
    out = list(piece_fst.in_slices(machine, iter([pa.array(texts), pa.array([], pa.string()), pa.array([None], pa.string()), pa.array(texts[:5])])))
    assert [x for part in out for x in part.to_pylist()] == [machine.encode(t or "").tolist() for t in [*texts, None, *texts[:5]]]
    assert len(out) > 50 and max(part.nbytes for part in out) < 20_000


def test_shared_parts_outlive_others():
    machine, rng, learnt = piece_fst.Machine(piece_fst.model_path(), known=100), random.Random(6), []
    relaxed = machine.relaxed
    machine.relaxed = lambda parts: learnt.extend(parts) or relaxed(parts)
    for _ in range(30):
        machine.encode_all(pa.array([" ".join(["Zebra", *["".join(rng.choices("aeionrst", k=8)) for _ in range(40)]])]))
        assert len(machine.known) <= 100 and len(machine.old) <= 100
    assert learnt.count("▁Zebra") == 1 and len(learnt) > 1000
