"""Approximate nearest neighbours by robust-pruned directed graphs.

Vectors are dealt by nearness: two levels of centroids, fitted by k-means on a bounded sample (`SAMPLE_FLOATS` numbers, the rows with the
smallest hashes), give every vector a cell of about `SHARD_ROWS` rows; a cell that has more is split by hash. Each shard builds one
graph. Building walks over the points in random order, in batches: a greedy beam search from the medoid on the graph so far proposes
neighbours; relaxed distance pruning keeps a proposed neighbour only if no kept one is `ALPHA` times nearer to it
than the point is, so edges stay diverse; reverse edges are added and pruned alike. A shard's vectors and edges are one row
of a written table. A query is searched with a beam in the shards of its nearest cells, and the shards' best are merged. How many cells
that are is measured on the sample: as many as hold `REACH` of the sample's own neighbours. Where vectors lie in clusters that is a few
whatever their number (and as many more as it takes to have k + 1 ids in reach); where they are spread evenly in all directions no cell can be left out, and every shard is queried.
Scores are the cosines of the original vectors in double precision.

Of equal vectors only the k + 1 smallest ids are indexed: no other can be among the k nearest of any query.

Edge cases: vectors that are null, empty or zero or hold null or non-finite numbers take no part, as queries neither;
vectors of different lengths are never compared; null vec_ids take no part; rows of one vec_id are one candidate (its
nearest vector) and no neighbours of each other, and several queries of one vec_id are one; fewer candidates than k are all returned;
equal scores go by vec_id; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.common import read, written

SHARD_ROWS, QUERY_ROWS = 8192, 1024
DEGREE, BUILD_BEAM, BEAM, ALPHA, EXPAND, BATCH = 32, 56, 192, 1.2, 4, 256
#: Sample rows for each cell, the sample's numbers at most, rounds of k-means, and the cells of which a row may be sent to every executor.
CELL_SAMPLE, SAMPLE_FLOATS, ROUNDS, FEW = 256, 16_000_000, 6, 100_000
#: The share of the sample's neighbours that the queried cells must hold, and the sample's queries for that.
REACH, ASKED = 0.99, 256
INDEX = "dim int, cell int, part int, ids binary, vectors binary, edges binary, entry int"


def beam_search(x: np.ndarray, edges: np.ndarray, entry: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ids and distances (1 - cosine) of the beam, nearest first; -1 where it is not full.
    All queries step together; a step expands the EXPAND nearest points of a beam that were not expanded yet."""
    n, b = len(x), len(q)
    seen = np.zeros((b, n + 1), bool)
    seen[:, n] = True  # where missing edges point
    rows = np.arange(b)[:, None]
    ids = np.full((b, beam), n, np.int32)
    dist = np.full((b, beam), np.inf, np.float32)
    done = np.ones((b, beam), bool)
    ids[:, 0], dist[:, 0], done[:, 0] = entry, 1 - q @ x[entry], False
    seen[:, entry] = True
    active = np.arange(b)
    while len(active):
        open_dist = np.where(done[active], np.inf, dist[active])
        pick = np.argpartition(open_dist, EXPAND - 1, axis=1)[:, :EXPAND]
        r = rows[: len(active)]
        real = np.isfinite(open_dist[r, pick])
        keep = real.any(axis=1)
        active, pick, real = active[keep], pick[keep], real[keep]
        if not len(active):
            break
        a, r = active[:, None], rows[: len(active)]
        done[a, pick] = True
        near = np.where(real[:, :, None], edges[np.where(real, ids[a, pick], 0)], n).reshape(len(active), -1)
        near[near < 0] = n
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near[seen[a, near]] = n
        width = int((near < n).sum(axis=1).max())
        if not width:
            continue
        near.sort(axis=1)
        near = near[:, :width]
        seen[a, near] = True
        d = 1 - np.matmul(x[np.minimum(near, n - 1)], q[active][:, :, None])[:, :, 0]
        d[near == n] = np.inf
        all_ids, all_dist, all_done = np.concatenate((ids[active], near), 1), np.concatenate((dist[active], d), 1), np.concatenate((done[active], near == n), 1)
        best = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
        ids[active], dist[active], done[active] = all_ids[r, best], all_dist[r, best], all_done[r, best]
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = ids[rows, order], dist[rows, order]
    return np.where(np.isfinite(dist), ids, -1), dist


def prune(x: np.ndarray, points: np.ndarray, options: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point the kept ones of its options (rows, -1 where none), nearest first."""
    b, rows = len(points), np.arange(len(points))[:, None]
    options = np.where(options == points[:, None], -1, options)
    options = -np.sort(-options, axis=1)
    options[:, 1:][options[:, 1:] == options[:, :-1]] = -1
    v = x[np.maximum(options, 0)]
    d = 1 - np.matmul(v, x[points][:, :, None])[:, :, 0]
    d[options < 0] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    options, d, v = options[rows, order], d[rows, order], v[rows, order]
    between = 1 - np.matmul(v, v.transpose(0, 2, 1))
    alive, kept = np.isfinite(d), np.full((b, degree), -1, np.int32)
    for k in range(degree):
        left = alive.any(axis=1)
        if not left.any():
            break
        at = alive.argmax(axis=1)
        kept[left, k] = options[left, at[left]]
        alive &= alpha * between[rows[:, 0], at] > d
        alive[rows[:, 0], at] = False
    return kept


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 1) -> tuple[np.ndarray, int]:
    """Out-edges (n x degree, -1 where none) and the entry point of unit vectors."""
    n = len(x)
    rng = np.random.default_rng(seed)
    entry = int(np.argmax(x @ x.mean(axis=0)))
    edges = np.full((n, degree), -1, np.int32)
    if n <= degree + 1:  # all others
        for i in range(n):
            edges[i, : n - 1] = np.delete(np.arange(n), i)
        return edges, entry
    edges[:, : degree // 2] = (rng.integers(1, n, (n, degree // 2)) + np.arange(n)[:, None]) % n
    order = rng.permutation(n)
    for lo in range(0, n, BATCH):
        p = order[lo : lo + BATCH]
        found, _ = beam_search(x, edges, entry, x[p], beam)
        edges[p] = prune(x, p, np.concatenate((found, edges[p]), axis=1), degree, alpha)
        source, target = np.repeat(p, degree), edges[p].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, count)
        back = np.full((len(nodes), int(count.max())), -1, np.int32)
        back[np.repeat(np.arange(len(nodes)), count), place] = source
        both = np.concatenate((edges[nodes], back), axis=1)
        for at in range(0, len(nodes), BATCH):  # prune() only drops what is not diverse; a short list may keep all
            part, options = nodes[at : at + BATCH], both[at : at + BATCH]
            full = (options >= 0).sum(axis=1) > degree
            short = -np.sort(-options[~full], axis=1)[:, :degree]
            edges[part[~full], : short.shape[1]] = short
            if full.any():
                edges[part[full]] = prune(x, part[full], options[full], degree, alpha)
    return edges, entry


def unit(v: np.ndarray) -> np.ndarray:
    return (v / np.sqrt((v * v).sum(axis=1, keepdims=True))).astype(np.float32)


def means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Unit centroids of unit vectors by k-means on the sphere; a centroid that loses all its rows takes the worst served one."""
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        near = x @ c.T
        own = near.argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        lost = np.flatnonzero(np.bincount(own, minlength=k) == 0)
        total[lost] = x[np.argsort(near.max(axis=1))[: len(lost)]]
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-12), c).astype(np.float32)
    return c


@dataclass
class Cells:
    """Two levels of centroids: the cells of top centroid i are first[i] .. first[i + 1] - 1. probes: how many cells a query visits."""

    top: np.ndarray
    leaves: np.ndarray
    first: np.ndarray
    probes: int = 0

    @classmethod
    def fit(cls, x: np.ndarray, cells: int, k: int = 5, seed: int = 1) -> Cells:
        rng = np.random.default_rng(seed)
        top = means(x, math.ceil(math.sqrt(cells)), rng)
        own = (x @ top.T).argmax(axis=1)
        share = [max(1, round(cells * (own == i).sum() / len(x))) for i in range(len(top))]
        parts = [means(x[own == i], n, rng) if (own == i).any() else top[i : i + 1] for i, n in enumerate(share)]
        found = cls(top, np.concatenate(parts), np.cumsum([0, *(len(p) for p in parts)]))
        found.probes = found.needed(x, k)
        return found

    def needed(self, x: np.ndarray, k: int) -> int:
        """How many of its nearest cells hold REACH of the k nearest of each of the first vectors among all of them."""
        q, all_cells = x[:ASKED], len(self.leaves)
        near = q @ x.T
        near[np.arange(len(q)), np.arange(len(q))] = -np.inf
        best = np.argsort(-near, axis=1)[:, : min(k, len(x) - 1)]
        if not best.size:
            return all_cells
        own = self.nearest(x, 1)[:, 0]
        place = np.argsort(np.argsort(-(q @ self.leaves.T), axis=1, kind="stable"), axis=1)
        return int(np.quantile(place[np.arange(len(q))[:, None], own[best]], REACH, method="higher")) + 1

    def in_reach(self, x: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
        """The cells that each query visits (-1 where there are fewer): `probes` nearest ones, and if these have fewer than `least` rows of
        sizes (rows in each cell), the next nearest of all cells until they have as many, or no cell is left."""
        near = self.nearest(x, self.probes)
        held = np.where(near >= 0, sizes[near], 0).sum(axis=1)
        more = {}
        for i in np.flatnonzero(held < least):
            order = np.argsort(-(self.leaves @ x[i]), kind="stable")
            rest = order[~np.isin(order, near[i]) & (sizes[order] > 0)]
            n = int(np.searchsorted(held[i] + np.cumsum(sizes[rest]), least)) + 1
            more[i] = rest[:n]
        out = np.full((len(x), near.shape[1] + max(map(len, more.values()), default=0)), -1, np.int64)
        out[:, : near.shape[1]] = near
        for i, cells in more.items():
            out[i, near.shape[1] : near.shape[1] + len(cells)] = cells
        return out

    def nearest(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The nearest cells of each vector, nearest first, among those of as many top centroids (-1 where there are fewer); all of them
        if they are half of all cells or more."""
        if probes > 1 and 2 * probes >= len(self.leaves):
            return np.tile(np.arange(len(self.leaves)), (len(x), 1))
        tops = np.argsort(-(x @ self.top.T), axis=1, kind="stable")[:, :probes]
        out = np.full((len(x), probes), -1, np.int64)
        for i, own in enumerate(tops):
            ids = np.concatenate([np.arange(self.first[t], self.first[t + 1]) for t in own])
            best = ids[np.argsort(-(self.leaves[ids] @ x[i]), kind="stable")[:probes]]
            out[i, : len(best)] = best
        return out


def fitted(rows: DataFrame, n: int, shard_rows: int, k: int) -> dict[int, Cells]:
    """The cells of each vector length that the sample has."""
    cells = max(1, -(-n // shard_rows))
    dim = rows.agg(F.max("dim").alias("d")).first()["d"] or 1
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(CELL_SAMPLE * cells, SAMPLE_FLOATS // dim))).select("dim", F.col("v").cast("array<float>").alias("v")).toArrow()
    if not len(some):
        return {}
    dims, v = some["dim"].to_numpy(), some["v"].combine_chunks()
    flat, at = v.values.to_numpy(), v.offsets.to_numpy()
    found = {}
    for d in np.unique(dims):
        x = np.stack([flat[at[i] : at[i + 1]] for i in np.flatnonzero(dims == d)]).astype(np.float64)
        x = unit(x[np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)])
        if len(x):
            found[int(d)] = Cells.fit(x, max(1, round(cells * len(x) / len(dims))), k)
    return found


def sizes_of(dealt: DataFrame, cells: dict[int, Cells]) -> dict[int, np.ndarray]:
    """Ids in each cell, a number beside each centroid; an id with vectors in several cells counts in the first of them."""
    first = dealt.groupBy("dim", "vec_id").agg(F.min("cell").alias("cell")).groupBy("dim", "cell").agg(F.count("*").alias("n")).collect()
    found = {d: np.zeros(len(c.leaves), np.int64) for d, c in cells.items()}
    for r in first:
        if r["dim"] in found:
            found[r["dim"]][r["cell"]] = r["n"]
    return found


def with_cells(rows: DataFrame, cells: dict[int, Cells], sizes: dict[int, np.ndarray] | None = None, least: int = 0) -> DataFrame:
    """rows (vec_id, v, dim) with cell: the nearest one; with sizes a row for each cell that a query visits to have `least` ids in reach. A
    length that the sample did not have is cell 0."""
    shared = rows.sparkSession.sparkContext.broadcast((cells, sizes))

    def run(parts):
        for pdf in parts:
            for d, own in pdf.groupby("dim", sort=False):
                known, held = shared.value
                if d in known:
                    x = unit(np.stack(own["v"].to_list()))
                    near = known[d].nearest(x, 1) if held is None else known[d].in_reach(x, held[d], least)
                else:
                    near = np.zeros((len(own), 1), np.int64)
                at, which = np.nonzero(near >= 0)
                yield own.iloc[at].assign(cell=near[at, which].astype("int32"))

    return rows.select("vec_id", "v", "dim").mapInPandas(run, "vec_id long, v array<double>, dim int, cell int")


def build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("vec_id", kind="stable")
    v = np.stack(pdf["v"].to_list()).astype(np.float64)
    edges, entry = build_graph(unit(v))
    place = {c: [int(pdf[c].iloc[0])] for c in ("cell", "part")}
    return pd.DataFrame({"dim": [v.shape[1]], **place, "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "vectors": [v.tobytes()], "edges": [edges.tobytes()], "entry": [entry]})


def search_shard(k: int, beam: int):
    """The k best of one shard for a block of queries, scored on the original vectors."""

    def run(queries: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(index):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        row = index.iloc[0]
        ids, v = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"]).reshape(-1, row["dim"])
        edges, own = np.frombuffer(row["edges"], np.int32).reshape(len(ids), -1), np.stack(queries["v"].to_list()).astype(np.float64)
        found, _ = beam_search(unit(v), edges, int(row["entry"]), unit(own), min(max(beam, 4 * k), len(ids) + EXPAND))
        norms, out = np.sqrt((v * v).sum(axis=1)), []
        for q, vec, near in zip(queries["vec_id"], own, found, strict=True):
            near = near[(near >= 0)]
            near = near[ids[near] != q]
            score = (v[near] @ vec) / (norms[near] * np.sqrt(vec @ vec))
            best = np.lexsort((ids[near], -score))
            best = best[np.sort(np.unique(ids[near[best]], return_index=True)[1])][:k]  # of a repeated id its nearest vector
            out.append(pd.DataFrame({"query_id": q, "vec_id": ids[near[best]], "score": score[best]}))
        return pd.concat(out)

    return run


def usable(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ok).withColumn("dim", F.size("v"))


def beside(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows with the counts of their cells, which are sent to every executor if they are few."""
    return rows.join(F.broadcast(counts) if counts.limit(FEW + 1).count() <= FEW else counts.hint("merge"), ["dim", "cell"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, beam: int = BEAM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of queries among vectors, (vec_id, embedding) both."""
    rows = usable(vectors).dropDuplicates(["vec_id", "v"])
    same = Window.partitionBy("v").orderBy("vec_id")
    rows = rows.withColumn("__n", F.row_number().over(same)).where(F.col("__n") <= k + 1).drop("__n")
    rows = written(rows, "vectors")
    cells = fitted(rows, rows.count(), shard_rows, k)
    dealt = written(with_cells(rows, cells), "cells")
    parts = written(dealt.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts")), "parts")
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    index = written(beside(dealt, parts).withColumn("part", part).groupBy("dim", "cell", "part").applyInPandas(build_shard, INDEX), "graphs")
    asked = written(with_cells(usable(queries).dropDuplicates(["vec_id", "v"]), cells, sizes_of(dealt, cells), k + 1), "queries")
    blocks = asked.groupBy("dim", "cell").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"))
    sizes = written(parts.join(blocks, ["dim", "cell"]), "sizes")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    asked = beside(asked, sizes).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).withColumn("part", every("parts")).drop("parts", "blocks")
    tables = beside(index, sizes).withColumn("block", every("blocks")).drop("parts", "blocks")
    keys = ["dim", "cell", "part", "block"]
    found = asked.groupBy(*keys).cogroup(tables.groupBy(*keys)).applyInPandas(search_shard(k, beam), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_graph_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
