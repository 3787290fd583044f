"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words `[\\p{L}\\p{N}]+` of the lower-cased text are hashed on the JVM. A word's vector joins two half vectors,
each from a table of its own and another part of the 64-bit hash, so that one collision never looks like a
word. Filters of widths 1, 2 and 3 run over the whole text and are max-pooled; a logistic layer gives the score.

All parameters start at random. Training replaces the maximum over a text by a smooth one, the log of the mean of exp(s z) divided by s, and
raises the sharpness s with each epoch (`TrainConfig.sharpness`): first every word of a text learns a little, at the end only those near the
maximum. Scoring takes the maximum itself, and the cut is calibrated on that.

Training takes every labelled row (of an id's rows one). They are dealt out in a random order and written as words; in each epoch every task
starts from the same model, takes its own rows in small batches, and the tasks' models are averaged by Spark, word by word over the tasks that
have the word (`shared_epoch`). The driver holds the averaged model, whose size is fixed. A tenth of the rows, by a hash of the id, calibrates: Spark counts their logits,
in steps of `STEP`, and the counts give the cuts. Small tables, of whose rows none is beyond `TrainConfig.toxic_rows`, `clean_rows`, `words` and `longest`, are
learnt in the driver's numpy instead (`sample`). A text of more than `longest` words is learnt whole, in pieces of that size. Scoring covers every row and never shuffles.

Edge cases: null text counts as empty; an empty text scores as the model's all-padding document; labels that are
null or of unknown documents are left out; without ten labelled texts of both classes nothing can be learnt: every score is the share of toxic
labels (0 without labels), and `reject` keeps all rows. Repeated
doc_ids and rows are scored row by row (of a repeated id the text with the smallest hash is learnt). Extra columns, whatever
their names, are left out by `score` and kept by `reject`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.common import BROADCAST_IDS, forget, give_back, read, settle, written

WIDTHS = (1, 2, 3)
#: Texts of a file of `learnable`, about: what a task learns from between two averages, at least. Steps of the logits that calibration counts.
SHARD_TEXTS, STEP = 5000, 1e-3


@dataclass(frozen=True)
class TrainConfig:
    toxic_rows: int = 2500
    clean_rows: int = 4500
    words: int = 2_500_000
    longest: int = 150_000
    buckets: int = 1 << 16
    half: int = 6
    filters: int = 6
    epochs: int = 4
    batch: int = 32
    rate: float = 0.1
    sharpness: tuple[float, ...] = (2, 4, 8, 16)
    seed: int = 7
    min_language_rows: int = 10


def word_hashes(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def slots(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the two tables for each word; row `buckets` is padding."""
    h = hashes.view(np.uint64)
    return (h % np.uint64(buckets)).astype(np.int32), ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def padded(counts: np.ndarray, flat: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after the other, each followed by max(WIDTHS) padding words; and where each text starts."""
    gap = max(WIDTHS)
    lengths = counts + gap
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    a, b = (np.full(int(lengths.sum()), buckets, np.int32) for _ in range(2))
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(len(flat))
    a[at], b[at] = slots(flat, buckets)
    return a, b, starts


@dataclass
class ConvText:
    """Parameters; `table_*` are the embeddings multiplied with the filters, ready for scoring."""

    config: TrainConfig
    e1: np.ndarray
    e2: np.ndarray
    w: list[np.ndarray]  # for each width: width x 2*half x filters
    bias: np.ndarray
    out: np.ndarray
    shift: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def parameters(self) -> list[np.ndarray]:
        return [self.e1, self.e2, *self.w, self.bias, self.out]

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        kernel = np.concatenate([k for w in self.w for k in w], axis=1)  # 2*half x (sum of widths * filters)
        h = self.config.half
        return (self.e1 @ kernel[:h]).astype(np.float32), (self.e2 @ kernel[h:]).astype(np.float32)

    def pooled(self, a: np.ndarray, b: np.ndarray, starts: np.ndarray, t1: np.ndarray, t2: np.ndarray) -> np.ndarray:
        n, f = len(a), self.config.filters
        x = t1[a] + t2[b]
        cols, col = [], 0
        for width in WIDTHS:
            y = x[:, col : col + f].copy()
            for j in range(1, width):
                y[: n - j] += x[j:, col + j * f : col + (j + 1) * f]
            y[a == self.config.buckets] = 0  # what begins at padding sees none of the next text
            cols.append(np.maximum.reduceat(y, starts, axis=0))
            col += width * f
        return np.maximum(np.concatenate(cols, axis=1) + self.bias, 0)

    def logits(self, counts: np.ndarray, flat: np.ndarray, tables=None, chunk: int = 60_000) -> np.ndarray:
        """One logit a text; works on about `chunk` words at a time (a longer text alone)."""
        t1, t2 = tables or self.tables()
        found, ends, at, word = [], np.cumsum(counts), 0, 0
        while at < len(counts):
            to = max(at + 1, int(np.searchsorted(ends, word + chunk, side="right")))
            a, b, starts = padded(counts[at:to], flat[word : ends[to - 1]], self.config.buckets)
            found.append(self.pooled(a, b, starts, t1, t2) @ self.out[1:] + self.out[0])
            at, word = to, int(ends[to - 1])
        return np.concatenate(found) - self.shift if found else np.zeros(0)


def flat_words(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(t) for t in texts], dtype=np.int64)
    return counts, np.concatenate([np.asarray(t, dtype=np.int64) for t in texts]) if len(texts) else np.zeros(0, np.int64)


def start(counts: np.ndarray, flat: np.ndarray, config: TrainConfig) -> ConvText:
    """A model with random parameters; table rows that no text has are 0, as padding is."""
    rng = np.random.default_rng(config.seed)
    h, f, size = config.half, config.filters, config.buckets
    tables = [np.zeros((size + 1, h)) for _ in range(2)]
    for e, slot in zip(tables, slots(flat, size), strict=True):
        rows = np.unique(slot)
        e[rows] = rng.normal(0, 0.02, (len(rows), h))
    w = [rng.normal(0, 1 / np.sqrt(2 * h * width), (width, 2 * h, f)) for width in WIDTHS]
    out = np.concatenate(([-1.0], rng.normal(0, 0.3, len(WIDTHS) * f)))
    return ConvText(config, *tables, w, np.zeros(len(WIDTHS) * f), out, 0.0)


def batches(counts: np.ndarray, order: np.ndarray, config: TrainConfig) -> list[np.ndarray]:
    """order in runs of at most `batch` texts and about `longest` words."""
    found, texts, words = [], [], 0
    for d in order.tolist():
        if texts and (len(texts) == config.batch or words + counts[d] > config.longest):
            found.append(np.array(texts))
            texts, words = [], 0
        texts.append(d)
        words += counts[d]
    return [*found, np.array(texts)] if texts else found


def train(texts: list[np.ndarray], label: np.ndarray, lang: list[str | None], config: TrainConfig, base_rate: float) -> ConvText:
    """base_rate: share of toxic rows among all labelled ones, for calibration."""
    rng = np.random.default_rng(config.seed + 1)
    fit = np.arange(len(texts)) % 10 != 9  # the rest calibrates
    counts, flat = flat_words([t for t, x in zip(texts, fit, strict=True) if x])
    model, y = start(counts, flat, config), label[fit].astype(np.float64)
    ends, sums = np.cumsum(counts), [np.zeros_like(p) + 1e-6 for p in model.parameters()]
    for epoch in range(config.epochs):
        sharp = config.sharpness[min(epoch, len(config.sharpness) - 1)]
        for some in batches(counts, rng.permutation(len(counts)), config):
            step(model, [flat[ends[d] - counts[d] : ends[d]] for d in some], y[some], sums, config.rate, sharp)
    calibrate(model, texts, label, lang, ~fit, base_rate)
    return model


def gradients(model: ConvText, texts: list[np.ndarray], y: np.ndarray, sharp: float) -> tuple[float, list]:
    """The batch's mean log loss under the smooth maximum, and its gradient: for each table (rows, gradient of these rows), then arrays."""
    h, f = model.config.half, model.config.filters
    counts, flat = flat_words(texts)
    a, b, starts = padded(counts, flat, model.config.buckets)
    length = np.diff(np.append(starts, len(a)))[:, None]
    x = np.concatenate((model.e1[a], model.e2[b]), axis=1)
    n, z = len(a), []
    for w in model.w:
        z.append(x @ w[0])
        for j in range(1, len(w)):
            z[-1][: n - j] += x[j:] @ w[j]
    z, pads = np.concatenate(z, axis=1), a == model.config.buckets
    z[pads] = 0  # what begins at padding sees none of the next text
    most = np.maximum.reduceat(z, starts, axis=0)
    share = np.exp(sharp * (z - np.repeat(most, length[:, 0], axis=0)))
    total = np.add.reduceat(share, starts, axis=0)
    z = most + np.log(total / length) / sharp + model.bias
    pool = np.maximum(z, 0)
    logit = np.clip(pool @ model.out[1:] + model.out[0], -30, 30)
    p = 1 / (1 + np.exp(-logit))
    loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
    d = (p - y) / len(y)
    grads_out = np.concatenate(([d.sum()], d @ pool))
    dz = np.outer(d, model.out[1:]) * (z > 0)
    grads_bias = dz.sum(axis=0)
    dz = share * np.repeat(dz / total, length[:, 0], axis=0)  # each position's share of its text's smooth maximum
    dz[pads] = 0
    dx, grads_w = np.zeros_like(x), []
    for k, w in enumerate(model.w):
        grads_w.append(np.zeros_like(w))
        for j in range(len(w)):
            part = dz[: n - j, k * f : (k + 1) * f]
            grads_w[-1][j] = x[j:].T @ part
            dx[j:] += part @ w[j].T
    tables = []
    for slot, part in ((a, dx[:, :h]), (b, dx[:, h:])):
        ids, back = np.unique(slot, return_inverse=True)
        g = np.stack([np.bincount(back, part[:, c], len(ids)) for c in range(h)], axis=1)
        g[ids == model.config.buckets] = 0  # padding stays zero
        tables.append((ids, g))
    return loss, [*tables, *grads_w, grads_bias, grads_out]


def long_gradients(model: ConvText, text: np.ndarray, y: float, sharp: float, piece: int) -> tuple[float, list]:
    """`gradients` of one text, whose words are taken in pieces: first for the smooth maximum of all, then for each piece's share of it."""
    h, f, config = model.config.half, model.config.filters, model.config
    a, b, _ = padded(np.array([len(text)]), text, config.buckets)
    n, more = len(a), max(WIDTHS) - 1

    def part(lo: int):
        hi = min(n, lo + piece)
        own_a, own_b = a[lo : min(n, hi + more)], b[lo : min(n, hi + more)]
        x, z = np.concatenate((model.e1[own_a], model.e2[own_b]), axis=1), []
        for w in model.w:
            z.append(x[: hi - lo] @ w[0])
            for j in range(1, len(w)):
                k = min(hi - lo, len(x) - j)
                z[-1][:k] += x[j : j + k] @ w[j]
        z = np.concatenate(z, axis=1)
        z[own_a[: hi - lo] == config.buckets] = 0
        return own_a, own_b, x, z

    most, total = np.full(len(WIDTHS) * f, -np.inf), np.zeros(len(WIDTHS) * f)
    for lo in range(0, n, piece):
        z = part(lo)[3]
        top = np.maximum(most, z.max(axis=0))
        total = total * np.exp(sharp * (most - top)) + np.exp(sharp * (z - top)).sum(axis=0)
        most = top
    z = most + np.log(total / n) / sharp + model.bias
    pool = np.maximum(z, 0)
    logit = float(np.clip(pool @ model.out[1:] + model.out[0], -30, 30))
    d = 1 / (1 + np.exp(-logit)) - y
    to = d * model.out[1:] * (z > 0)
    grads_w, flat = [np.zeros_like(w) for w in model.w], [np.zeros_like(model.e1), np.zeros_like(model.e2)]
    for lo in range(0, n, piece):
        own_a, own_b, x, z = part(lo)
        dz = np.exp(sharp * (z - most)) * (to / total)
        dz[own_a[: len(z)] == config.buckets] = 0
        dx = np.zeros_like(x)
        for k, w in enumerate(model.w):
            for j in range(len(w)):
                m = min(len(z), len(x) - j)
                own = dz[:m, k * f : (k + 1) * f]
                grads_w[k][j] += x[j : j + m].T @ own
                dx[j : j + m] += own @ w[j].T
        for g, slot, half in ((flat[0], own_a, dx[:, :h]), (flat[1], own_b, dx[:, h:])):
            for c in range(h):
                g[:, c] += np.bincount(slot, half[:, c], len(g))
    tables = []
    for g, slot in zip(flat, (a, b), strict=True):
        ids = np.unique(slot)
        g[config.buckets] = 0
        tables.append((ids, g[ids]))
    return float(np.logaddexp(0, logit) - y * logit), [*tables, *grads_w, to, np.concatenate(([d], d * pool))]


def step(model: ConvText, texts: list[np.ndarray], y: np.ndarray, sums: list[np.ndarray], rate: float, sharp: float) -> None:
    """One Adagrad step on a batch."""
    longest = model.config.longest
    _, grads = long_gradients(model, texts[0], float(y[0]), sharp, longest) if len(texts) == 1 and len(texts[0]) > longest else gradients(model, texts, y, sharp)
    for p, g, total in zip(model.parameters(), grads, sums, strict=True):
        ids, g = g if isinstance(g, tuple) else (slice(None), g)
        total[ids] += g * g
        p[ids] -= rate * g / np.sqrt(total[ids])


def best_cut(logit: np.ndarray, label: np.ndarray, base_rate: float) -> float:
    """The logit at which F1 is highest, if clean rows are weighted to their true share; midway in the gap there."""
    weight = np.where(label == 1, 1.0, (1 - base_rate) / base_rate * max(1, (label == 1).sum()) / max(1, (label == 0).sum()))
    order = np.argsort(-logit, kind="stable")
    hit, wrong = np.cumsum(label[order]), np.cumsum(weight[order] * (label[order] == 0))
    f1 = 2 * hit / np.maximum(hit + wrong + hit[-1], 1e-9)
    at = int(np.argmax(f1))
    below = logit[order[at + 1]] if at + 1 < len(order) else logit[order[at]] - 1
    return float((logit[order[at]] + below) / 2)


def calibrate(model: ConvText, texts: list[np.ndarray], label: np.ndarray, lang: list[str | None], use: np.ndarray, base_rate: float) -> None:
    """Score 0.5 is the best cut over all languages; each language also gets a threshold of its own."""
    counts, flat = flat_words([t for t, x in zip(texts, use, strict=True) if x])
    logit, y, own = model.logits(counts, flat), label[use], np.array([x or "" for x, k in zip(lang, use, strict=True) if k])
    if not len(y) or y.min() == y.max():
        return
    model.shift = best_cut(logit, y, base_rate)
    for x in np.unique(own):
        in_x = own == x
        if min((y[in_x] == 1).sum(), (y[in_x] == 0).sum()) >= model.config.min_language_rows:
            cut = best_cut(logit[in_x] - model.shift, y[in_x], base_rate)
            model.thresholds[str(x)] = float(1 / (1 + np.exp(-np.clip(cut, -30, 30))))


def sample(docs: DataFrame, labels: DataFrame, config: TrainConfig) -> tuple[list, float]:
    """What the driver can learn from: [(hashes, lang, toxic)], and the share of toxic rows among all labels that may be learnt from."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    n = usable.agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count("*").alias("n")).first()
    if not n["t"] or n["t"] == n["n"]:
        return [], 0.0
    picks = None
    for toxic, rows in ((1, config.toxic_rows), (0, config.clean_rows)):
        few = usable.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        picks = few if picks is None else picks.union(few)
    ids = docs.sparkSession.createDataFrame(picks.collect(), picks.schema)  # at most toxic_rows + clean_rows small rows
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    rows = rows.select("doc_id", "lang", "toxic", word_hashes(F.col("text")).alias("w"), F.struct(F.xxhash64("text").alias("t"), F.xxhash64("lang").alias("g")).alias("which"))
    sizes = rows.groupBy("doc_id").agg(F.min(F.struct("which", F.size("w").alias("n"))).alias("r")).select("doc_id", "r.which", "r.n")
    used, chosen = 0, []
    for r in sorted(sizes.select("*", F.xxhash64(F.lit(1), "doc_id").alias("place")).collect(), key=lambda r: (r["place"], r["doc_id"])):
        if r["n"] <= config.longest and used + r["n"] <= config.words:
            used += r["n"]
            chosen.append((r["doc_id"], r["which"], len(chosen)))
    if not chosen:
        return [], 0.0
    chosen = docs.sparkSession.createDataFrame(chosen, "doc_id long, which struct<t:bigint,g:bigint>, place int")
    found = rows.join(F.broadcast(chosen), ["doc_id", "which"]).groupBy("place").agg(F.any_value(F.struct("w", "lang", "toxic")).alias("r"))
    found = found.orderBy("place").select("r.w", "r.lang", "r.toxic").toArrow()
    return [(np.asarray(w.values, dtype=np.int64), g, t) for w, g, t in zip(found["w"], found["lang"].to_pylist(), found["toxic"].to_pylist(), strict=True)], n["t"] / n["n"]


def usable_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labels that may be learnt from; an id with both labels is toxic."""
    return labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))


def learnable(docs: DataFrame, usable: DataFrame, n: int) -> DataFrame:
    """(doc_id, toxic, lang, w, tenth): all labelled texts as words, in a random order over files of about SHARD_TEXTS texts. usable: (doc_id,
    toxic), n rows. A written table."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    told = texts.join(F.broadcast(usable) if n <= BROADCAST_IDS else usable.hint("merge"), "doc_id").withColumn("place", F.xxhash64(F.lit(1), "doc_id"))
    which = F.row_number().over(Window.partitionBy("place", "doc_id").orderBy(F.xxhash64("text"), F.xxhash64("lang")))
    told = told.repartition(max(1, n // SHARD_TEXTS), "place", "doc_id").withColumn("which", which).where("which = 1")
    return written(told.select("doc_id", "toxic", "lang", word_hashes(F.col("text")).alias("w"), F.pmod("place", F.lit(10)).alias("tenth")), "learnt")


def random_start(config: TrainConfig) -> tuple[ConvText, list[np.ndarray]]:
    """A model with random parameters for every slot, and its sums of squared gradients."""
    every = np.arange(config.buckets, dtype=np.uint64)
    model = start(np.array([config.buckets]), (every | every << np.uint64(33)).view(np.int64), config)
    return model, [np.zeros_like(p) + 1e-6 for p in model.parameters()]


def as_rows(arrays: list[np.ndarray], half: int) -> np.ndarray:
    """Parameters behind the two tables as rows of `half` values."""
    flat = np.concatenate([p.ravel() for p in arrays])
    return np.concatenate((flat, np.zeros(-len(flat) % half))).reshape(-1, half)


def fill(arrays: list[np.ndarray], rows: np.ndarray) -> None:
    """The other way of `as_rows`, in place."""
    flat, at = rows.ravel(), 0
    for p in arrays:
        p[:] = flat[at : at + p.size].reshape(p.shape)
        at += p.size


def shared_epoch(rows: DataFrame, model: ConvText, sums: list[np.ndarray], epoch: int) -> tuple[ConvText, list[np.ndarray]]:
    """One pass over rows (toxic, w). Each task takes steps of its own from the given model; what comes back is the mean over the tasks that have a
    word, weighted by their texts. Only rows of the tables, of which there is a fixed number, leave a task."""
    config, half = model.config, model.config.half
    sent = rows.sparkSession.sparkContext.broadcast((model, sums))
    fields = [f"{kind}{c}" for kind in "vs" for c in range(half)]

    def run(batches_of_rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, given_sums = sent.value
        own = replace(given, e1=given.e1.copy(), e2=given.e2.copy(), w=[w.copy() for w in given.w], bias=given.bias.copy(), out=given.out.copy())
        total, seen, texts = [t.copy() for t in given_sums], [np.zeros(config.buckets + 1, bool) for _ in range(2)], 0
        sharp, rng = config.sharpness[min(epoch, len(config.sharpness) - 1)], np.random.default_rng(config.seed + 1 + epoch)
        for batch in batches_of_rows:
            lists, y = batch.column(1), batch.column(0).to_numpy().astype(np.float64)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for s, slot in zip(seen, slots(flat, config.buckets), strict=True):
                s[slot] = True
            for some in batches(np.diff(at), rng.permutation(len(y)), config):
                step(own, [flat[at[d] : at[d + 1]] for d in some], y[some], total, config.rate, sharp)
            texts += len(y)
        if texts:
            for t, (p, g) in enumerate([(own.e1, total[0]), (own.e2, total[1]), (as_rows(own.parameters()[2:], half), as_rows(total[2:], half))]):
                ids = np.flatnonzero(seen[t]) if t < 2 else np.arange(len(p))
                values = np.concatenate((p[ids], g[ids]), axis=1)
                columns = [pa.array(np.full(len(ids), t, np.int32)), pa.array(ids.astype(np.int32)), pa.array(np.full(len(ids), float(texts)))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.ascontiguousarray(values[:, c])) for c in range(2 * half))], names=["t", "row", "n", *fields])
        give_back()

    schema = ", ".join(["t int, row int, n double", *(f"{c} double" for c in fields)])
    found = rows.select("toxic", "w").mapInArrow(run, schema)
    mean = found.groupBy("t", "row").agg(*[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).cast("float").alias(c) for c in fields]).toArrow()
    sent.destroy()
    settle(rows.sparkSession)
    t, row = (mean[c].to_numpy() for c in ("t", "row"))
    values = np.stack([mean[c].to_numpy() for c in fields], axis=1).astype(np.float64)
    shape = (config.buckets + 1, half)
    after = ConvText(config, np.zeros(shape), np.zeros(shape), [w.copy() for w in model.w], model.bias.copy(), model.out.copy(), model.shift)
    after_sums = [np.full(shape, 1e-6), np.full(shape, 1e-6), *[s.copy() for s in sums[2:]]]
    for k, (p, g) in enumerate(((after.e1, after_sums[0]), (after.e2, after_sums[1]))):
        p[row[t == k]], g[row[t == k]] = values[t == k, :half], values[t == k, half:]
    rest = values[t == 2][np.argsort(row[t == 2])]
    if len(rest):
        fill(after.parameters()[2:], rest[:, :half])
        fill(after_sums[2:], rest[:, half:])
    return after, after_sums


def cut_of_counts(logit: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """`best_cut` of distinct logits with how many toxic and clean rows have each."""
    order = np.argsort(-logit)
    logit, hit = logit[order], np.cumsum(toxic[order])
    f1 = 2 * hit / np.maximum(hit + np.cumsum(clean[order]) + hit[-1], 1e-9)
    at = int(np.argmax(f1))
    return float((logit[at] + (logit[at + 1] if at + 1 < len(logit) else logit[at] - 1)) / 2)


def calibrate_all(model: ConvText, rows: DataFrame) -> None:
    """`calibrate` on all of rows (toxic, lang, w), whose logits Spark counts."""
    logit = F.round(raw_logits(model, rows.sparkSession)(F.col("w")) / STEP).cast("int").alias("step")
    counts = rows.select(F.coalesce("lang", F.lit("")).alias("lang"), "toxic", logit).groupBy("lang", "step").agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean"))
    counts = written(counts, "logits")

    def cut(part: DataFrame) -> float | None:
        found = part.toArrow()
        step, toxic, clean = (found[c].to_numpy() for c in ("step", "toxic", "clean"))
        return cut_of_counts(step * STEP, toxic, clean) if toxic.sum() and clean.sum() else None

    whole = cut(counts.groupBy("step").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    if whole is not None:
        model.shift = whole
        least = model.config.min_language_rows
        for r in counts.groupBy("lang").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where((F.col("t") >= least) & (F.col("c") >= least)).collect():
            own = cut(counts.where(F.col("lang") == r["lang"]))
            model.thresholds[r["lang"]] = float(1 / (1 + np.exp(-np.clip(own - whole, -30, 30))))
    forget(counts)


def train_shared(rows: DataFrame, config: TrainConfig) -> ConvText:
    """A model trained on all rows of `learnable`; those of the last tenth calibrate."""
    model, sums = random_start(config)
    for epoch in range(config.epochs):
        model, sums = shared_epoch(rows.where("tenth <> 9"), model, sums, epoch)
    calibrate_all(model, rows.where("tenth = 9"))
    return model


def fit(docs: DataFrame, labels: DataFrame, config: TrainConfig = TrainConfig()) -> ConvText | None:
    settle(docs.sparkSession)  # training shares the driver's memory with what earlier queries left there
    usable = usable_labels(labels)
    n = usable.agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count("*").alias("n")).first()
    if not n["t"] or n["t"] == n["n"]:
        return None
    if n["t"] <= config.toxic_rows and n["n"] - n["t"] <= config.clean_rows:
        rows, base_rate = sample(docs, labels, config)
        if len(rows) == usable.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi").count():  # nothing is left out
            label = np.array([r[2] for r in rows], dtype=np.int64)
            if len(rows) < 10 or label.min() == label.max():
                return None
            model = train([r[0] for r in rows], label, [r[1] for r in rows], config, base_rate)
            del rows
            give_back()
            return model
        del rows
    rows = learnable(docs, usable, n["n"])
    found = rows.agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count("*").alias("n")).first()
    model = train_shared(rows, config) if found["n"] >= 10 and 0 < found["t"] < found["n"] else None
    forget(rows)
    give_back()
    return model


def raw_logits(model: ConvText, spark: SparkSession) -> Callable[[Column], Column]:
    """A column function of a text's words: the logit."""
    shared = spark.sparkContext.broadcast((replace(model, e1=np.zeros((1, 1)), e2=np.zeros((1, 1))), model.tables()))

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, t = shared.value
        for words in batches:
            yield pa.array(own.logits(np.diff(words.offsets.to_numpy()).astype(np.int64), words.flatten().to_numpy(zero_copy_only=False), t))
        give_back()

    return run


def scored(model: ConvText, spark: SparkSession) -> Callable[[Column, Column], Column]:
    """A column function of (text, lang): a struct of score, threshold (the language's) and rejected (the score reaches it)."""
    tables = model.tables()
    slim = replace(model, e1=np.zeros((1, 1)), e2=np.zeros((1, 1)))
    shared = spark.sparkContext.broadcast((slim, tables))

    @F.arrow_udf("struct<score:double,threshold:double,rejected:boolean>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        own, t = shared.value
        for words, lang in batches:
            counts = np.diff(words.offsets.to_numpy()).astype(np.int64)
            logit = own.logits(counts, words.flatten().to_numpy(zero_copy_only=False), t)
            p = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
            cut = np.array([own.thresholds.get(x or "", 0.5) for x in lang.to_pylist()], dtype=np.float64)
            yield pa.StructArray.from_arrays([pa.array(p), pa.array(cut), pa.array(p >= cut)], names=["score", "threshold", "rejected"])
        give_back()

    return lambda text, lang: run(word_hashes(text), lang.cast("string"))


def toxic_share(labels: DataFrame) -> float:
    """The share of toxic rows among the labels that may be learnt from: all that can be said where no model could be trained."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return usable.agg(F.avg("toxic")).first()[0] or 0.0


def score(docs: DataFrame, model: ConvText | None, share: float = 0.0) -> DataFrame:
    """doc_id, held_out, score, predicted, threshold (of the language), rejected (score reaches it). Without a model every score is share,
    and nothing is rejected."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text"), F.col("lang"))
    if model is None:
        return base.select("doc_id", "held_out", F.lit(float(share)).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"), F.lit(0.5).alias("threshold"), F.lit(False).alias("rejected"))
    told = base.select("doc_id", "held_out", scored(model, docs.sparkSession)(F.col("text"), F.col("lang")).alias("s"))
    return told.select("doc_id", "held_out", "s.score", (F.col("s.score") >= 0.5).cast("int").alias("predicted"), "s.threshold", "s.rejected")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = fit(docs, labels)
    return score(docs, model, 0.0 if model else toxic_share(labels))


def reject(docs: DataFrame, labels: DataFrame, config: TrainConfig = TrainConfig()) -> DataFrame:
    """docs without the rejected rows, with the same columns: each row is decided by its own text, and goes if its score reaches its
    language's threshold."""
    model = fit(docs, labels, config)
    if model is None:
        return docs
    return docs.where(~scored(model, docs.sparkSession)(F.col("text"), F.col("lang"))["rejected"])
