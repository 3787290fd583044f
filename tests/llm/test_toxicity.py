"""The toxicity classifier's own parts: forward pass, gradient, sample, calibration and what training adds."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import toxicity

SMALL = toxicity.TrainConfig(buckets=64, half=2, filters=2, batch=8)


def some_texts(seed, n=6):
    rng = np.random.default_rng(seed)
    return [rng.integers(-(2**63), 2**63 - 1, k, dtype=np.int64) for k in [0, 1, 2, 5, 9, 30][:n]]


def model_of(texts, config=SMALL, seed=3):
    model = toxicity.start(*toxicity.flat_words(texts), replace(config, seed=seed))
    rng = np.random.default_rng(seed)
    for e in (model.e1, model.e2):
        e[:-1] = rng.normal(0, 0.7, e[:-1].shape)
    model.bias[:] = rng.normal(0, 0.3, model.bias.shape)
    return model


def vectors(model, text):
    """A text's words and padding as vectors, one by one."""
    u, b = [int(x) % 2**64 for x in text], model.config.buckets
    return [np.concatenate((model.e1[x % b], model.e2[(x >> 33) % b])) for x in u] + [np.zeros(2 * model.config.half)] * max(toxicity.WIDTHS)


def logit(model, text, pool):
    """By plain loops; pool: from a filter's values at all positions to one."""
    x, f, total = vectors(model, text), model.config.filters, model.out[0]
    for k, w in enumerate(model.w):
        for c in range(f):
            values = [sum(float(x[i + j] @ w[j][:, c]) for j in range(len(w)) if i + j < len(x)) for i in range(len(x))]
            total += max(pool(values) + model.bias[k * f + c], 0) * model.out[1 + k * f + c]
    return total


def smooth(sharp):
    return lambda v: float(np.log(np.mean(np.exp(sharp * np.array(v)))) / sharp)


def test_forward_pass_by_plain_loops():
    texts = some_texts(1)
    model = model_of(texts)
    got = model.logits(*toxicity.flat_words(texts))
    assert np.allclose(got, [logit(model, t, max) for t in texts], atol=1e-5)  # scoring tables are 32-bit
    assert np.allclose(model.logits(*toxicity.flat_words(texts), chunk=3), got)


@pytest.mark.parametrize("sharp", [1, 16])
def test_gradient_is_that_of_the_plain_loss(sharp):
    texts, y = some_texts(2), np.array([0.0, 1, 1, 0, 1, 0])
    model = model_of(texts)

    def loss():
        z = np.array([logit(model, t, smooth(sharp)) for t in texts])
        return float(np.mean(np.logaddexp(0, z) - y * z))

    found, grads = toxicity.gradients(model, texts, y, sharp)
    assert abs(found - loss()) < 1e-9
    for p, g in zip(model.parameters(), grads, strict=True):
        if isinstance(g, tuple):
            full = np.zeros_like(p)
            full[g[0]] = g[1]
            assert not full[-1].any()  # padding does not move
            g, places = full, [(r, 0) for r in g[0][:-1][:3]] + [(int(g[0][0]), 1)]
        else:
            places = [np.unravel_index(i, p.shape) for i in range(0, p.size, max(1, p.size // 4))]
        for at in places:
            held, eps = p[at], 1e-5
            p[at] = held + eps
            up = loss()
            p[at] = held - eps
            down = loss()
            p[at] = held
            assert abs(g[at] - (up - down) / (2 * eps)) < 1e-6


def test_a_step_is_adagrad():
    texts, y = some_texts(4), np.array([1.0, 0, 1, 0, 0, 1])
    model, other = model_of(texts), model_of(texts)
    sums = [np.full_like(p, 0.5) for p in model.parameters()]
    _, grads = toxicity.gradients(other, texts, y, 2)
    toxicity.step(model, texts, y, sums, 0.1, 2)
    for p, q, g in zip(model.parameters(), other.parameters(), grads, strict=True):
        full = np.zeros_like(q)
        ids, part = g if isinstance(g, tuple) else (slice(None), g)
        full[ids] = part
        assert np.allclose(p, q - 0.1 * full / np.sqrt(0.5 + full * full))


def test_batches_hold_bounded_words():
    config = replace(SMALL, batch=3, longest=100)
    counts = np.array([10, 99, 5, 1, 1, 1, 1, 100, 60])
    assert [b.tolist() for b in toxicity.batches(counts, np.arange(9), config)] == [[0], [1], [2, 3, 4], [5, 6], [7], [8]]
    assert toxicity.batches(counts, np.arange(0), config) == []


def test_cut_by_hand():
    y = np.array([1, 1, 0, 1, 0, 0])
    at = toxicity.best_cut(np.array([3.0, 2.5, 2.0, 1.5, 1.0, 0.0]), y, 0.5)
    assert at == 1.25  # three of three found with one wrong: F1 6/7; two found with none wrong: 4/5
    assert toxicity.best_cut(np.array([3.0, 2.5, 2.0, 1.5, 1.0, 0.0]), y, 0.1) == 2.25  # each clean row stands for nine


def test_languages_get_their_own_thresholds_only_with_rows_of_both_classes():
    texts = [np.array([k], dtype=np.int64) for k in range(120)]
    label = np.array([k % 2 for k in range(120)])
    lang = ["en" if k < 60 else "fr" if k % 2 else None for k in range(120)]
    model = model_of(texts)
    toxicity.calibrate(model, texts, label, lang, np.ones(120, bool), 0.5)
    assert set(model.thresholds) == {"en"}


def labelled(spark, texts):
    df = spark.createDataFrame([(i, t, "en") for i, (t, _) in enumerate(texts)], "doc_id long, text string, lang string")
    return df, spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int")


def test_a_text_longer_than_the_bound_is_left_out_alone(spark):
    texts = [(f"w{i} awful thing" if i % 2 else f"w{i} kind thing", i % 2) for i in range(60)]
    df, labels = labelled(spark, [("word " * 500 + str(i), 1) for i in range(8)] + texts)
    for config in (replace(SMALL, words=300, longest=300), replace(SMALL, words=300, longest=20)):
        rows, share = toxicity.sample(df, labels, config)
        assert len(rows) > 30 and max(len(r[0]) for r in rows) == 3 and 0 < share < 1
    rows, _ = toxicity.sample(df, labels, replace(SMALL, words=800, longest=600))
    assert sorted(len(r[0]) for r in rows)[-1] == 501 and sum(len(r[0]) for r in rows) <= 800
    assert toxicity.fit(df, labels, replace(SMALL, words=300)) is not None
    assert toxicity.sample(df, labels, replace(SMALL, words=2))[0] == []


def test_repeated_and_null_rows_are_learnt_once_and_scored_each(spark):
    texts = [(f"w{i} awful thing" if i % 2 else f"w{i} kind thing", i % 2) for i in range(60)]
    df, labels = labelled(spark, texts)
    twice = df.union(df).union(spark.createDataFrame([(None, "awful", "en"), (3, None, None)], df.schema))
    rows, _ = toxicity.sample(twice, labels.union(labels).union(spark.createDataFrame([(None, 1), (5, None), (6, 9)], labels.schema)), SMALL)
    learnt = df.where(~toxicity.held_out(F.col("doc_id"))).count()
    assert len(rows) == learnt
    scores = toxicity.score(twice, toxicity.fit(df, labels, SMALL)).collect()
    assert len(scores) == 122 and sum(r["doc_id"] is None for r in scores) == 1 and len({r["score"] for r in scores if r["doc_id"] == 4}) == 1


def test_without_both_classes_scores_are_the_share_and_nothing_goes(spark):
    df, labels = labelled(spark, [("a b", 1), ("c", 1), ("d", 1)])
    assert toxicity.fit(df, labels) is None and toxicity.toxic_share(labels) == 1.0 and toxicity.toxic_share(labels.limit(0)) == 0.0
    assert {(r["score"], r["predicted"]) for r in toxicity.score(df, None, 1.0).collect()} == {(1.0, 1)}
    assert toxicity.reject(df, labels).count() == 3


def auc(score, label):
    order = np.argsort(np.argsort(score, kind="stable")) + 1.0
    ties = {v: order[score == v].mean() for v in np.unique(score)}
    rank, n = np.array([ties[v] for v in score]), label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def test_the_convolution_learns_what_start_values_do_not_know(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    told = docs.join(labels, "doc_id", "left_semi")

    def held(config):
        rows = toxicity.score(told, toxicity.fit(docs, labels, config)).where("held_out").join(labels, "doc_id").select("score", "toxic").toPandas()
        return auc(rows["score"].to_numpy(), rows["toxic"].to_numpy())

    assert 0.3 < held(toxicity.TrainConfig(epochs=0)) < 0.7
    assert held(toxicity.TrainConfig()) >= 0.96


def test_a_long_text_in_pieces_has_the_gradient_of_the_whole():
    text = np.random.default_rng(5).integers(-(2**63), 2**63 - 1, 50, dtype=np.int64)
    model = model_of([text])
    for y in (0.0, 1.0):
        loss, whole = toxicity.gradients(model, [text], np.array([y]), 4)
        for piece in (1, 7, 50, 53, 60):
            got, parts = toxicity.long_gradients(model, text, y, 4, piece)
            assert abs(got - loss) < 1e-9
            for a, b in zip(whole, parts, strict=True):
                assert (a[0] == b[0]).all() and np.allclose(a[1], b[1]) if isinstance(a, tuple) else np.allclose(a, b)


def test_all_labelled_texts_are_learnt_from(spark):
    """more rows than the driver takes, a text longer than it takes: every word has a vector, and what only few rows say is known."""
    texts = [(f"w{i} awful thing" if i % 2 else f"w{i} kind thing", i % 2) for i in range(400)] + [("long " * 90 + "tail", 1)]
    df, labels = labelled(spark, texts)
    model = toxicity.fit(df, labels, replace(SMALL, buckets=1 << 16, toxic_rows=20, clean_rows=20, longest=50))
    learnt = df.where(~toxicity.held_out(F.col("doc_id"))).where(F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(10)) != 9)
    words = learnt.select(F.explode(toxicity.word_hashes(F.col("text")))).distinct().toArrow().column(0).to_numpy()
    for table, slot in zip((model.e1, model.e2), toxicity.slots(words, 1 << 16), strict=True):
        assert (np.abs(table[slot]).sum(axis=1) > 0).all()
        assert (np.abs(table).sum(axis=1) > 0).sum() == len(np.unique(slot))
    told = toxicity.score(df, model).join(labels, "doc_id").where("held_out").toPandas()
    assert auc(told["score"].to_numpy(), told["toxic"].to_numpy()) > 0.95


def test_cut_of_counts_is_the_cut_of_rows():
    z, y = np.array([3.0, 2.5, 2.5, 2.0, 1.5, 1.0, 0.0]), np.array([1, 1, 0, 0, 1, 0, 0])
    one = np.unique(z)
    t, c = (np.array([((z == v) & (y == k)).sum() for v in one]) for k in (1, 0))
    assert toxicity.cut_of_counts(one, t, c) == 1.25


def test_learning_in_many_tasks_ranks_as_well_as_in_one(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_TEXTS", 1500)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, toxicity.TrainConfig(toxic_rows=10))
    rows = toxicity.score(docs.join(labels, "doc_id", "left_semi"), model).where("held_out").join(labels, "doc_id").select("score", "toxic").toPandas()
    assert auc(rows["score"].to_numpy(), rows["toxic"].to_numpy()) >= 0.96
