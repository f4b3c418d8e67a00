"""Approximate nearest neighbours over learned partitions.

On a bounded sample the graph of nearest neighbours is cut into parts of equal size by recursive bisection along its
second eigenvector. A small network learns to which parts the neighbours of a vector belong. It puts every row of the
table into its most probable part. A query is sent to its parts in the order of their probability until these add up to
a share, where all rows are ranked by exact cosines. The share is learned too: `calibration` rows of the table, chosen by
a hash of their ids, are searched in full, and it is the least that finds `recall` of their neighbours. So clustered
vectors need few parts and random ones many, by one rule at every size. Parts are split into cells of bounded size,
whatever share of the rows is alike; a task holds one cell and lets the queries stream by.

Defined cases: vectors that are null, zero, or hold null or non-finite components, or whose length is not the most
frequent one, take no part. A query's own row is no candidate. Equal cosines go by the smaller id. A query meets as many
more parts as it takes to have k candidates, so only a table with fewer rows gives it fewer. Rows that repeat an id are
candidates each, but for queries of that id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cairnlake.llm.shared import bound_batches, cut, tidy


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest others of each row."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, levels: int, seed: int = 7) -> np.ndarray:
    """Part of each node of the graph: 2**levels parts whose sizes differ by one at most per level."""
    n, rng = len(graph), np.random.default_rng(seed)
    a, b = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    part = np.zeros(n, np.int64)
    for level in range(levels):
        inside = part[a] == part[b]
        ai, bi = a[inside], b[inside]
        degree = np.bincount(ai, minlength=n) + 1.0
        sizes = np.maximum(np.bincount(part, minlength=1 << level), 1)
        weight = np.bincount(part, weights=degree, minlength=1 << level)
        v = rng.standard_normal(n)
        for _ in range(60):
            v = v - (np.bincount(part, weights=v * degree, minlength=1 << level) / np.maximum(weight, 1e-9))[part]
            v = 0.5 * v + 0.5 * (np.bincount(ai, weights=v[bi], minlength=n) + v) / degree
            norm = np.sqrt(np.bincount(part, weights=v * v, minlength=1 << level) / sizes)
            v = v / np.maximum(norm[part], 1e-12)
        new = np.empty(n, np.int64)
        for p in range(1 << level):
            own = np.flatnonzero(part == p)
            own = own[np.lexsort((own, v[own]))]
            half = (len(own) + 1) // 2
            new[own[:half]], new[own[half:]] = 2 * p, 2 * p + 1
        part = new
    return part


@dataclass
class Router:
    """Network with one hidden layer from unit vectors to probabilities of parts."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, aim: np.ndarray, hidden: int = 96, epochs: int = 40, seed: int = 11) -> Router:
        rng, (n, d) = np.random.default_rng(seed), x.shape
        p = [rng.standard_normal((d, hidden)) * np.sqrt(2 / d) * 4, np.zeros(hidden), rng.standard_normal((hidden, aim.shape[1])) * np.sqrt(1 / hidden), np.zeros(aim.shape[1])]
        m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
        for epoch in range(epochs):
            for own in np.array_split(rng.permutation(n), max(1, n // 128)):
                h = np.maximum(x[own] @ p[0] + p[1], 0)
                z = h @ p[2] + p[3]
                z = np.exp(z - z.max(axis=1, keepdims=True))
                dz = (z / z.sum(axis=1, keepdims=True) - aim[own]) / len(own)
                dh = (dz @ p[2].T) * (h > 0)
                t += 1
                rate = 3e-3 * (1 - epoch / epochs) + 1e-4
                for i, g in enumerate((x[own].T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    p[i] -= rate * (m[i] / (1 - 0.9**t) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8) + 1e-3 * p[i] * (p[i].ndim == 2))
        return cls(*p)

    def order(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts of each row, most probable first, and for each the probability of those before it."""
        z = np.maximum(_unit(x) @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        order = np.argsort(-z, axis=1, kind="stable")
        p = np.take_along_axis(z, order, axis=1)
        return order, np.cumsum(p, axis=1) - p


def fit_router(sample: np.ndarray, levels: int, k: int = 12) -> Router:
    x = _unit(sample)
    parts = 1 << levels
    k = min(k, len(x) - 1)
    if parts == 1 or k < 1:
        return Router(np.zeros((sample.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = neighbour_graph(x, k)
    part = balanced_parts(graph, levels)
    aim = np.zeros((len(x), parts))
    np.add.at(aim, (np.repeat(np.arange(len(x)), k), part[graph].ravel()), 1.0 / k)
    aim = 0.5 * aim + 0.5 * np.eye(parts)[part]
    return Router.fit(x, aim)


def best_of(q_ids, q, c_ids, c, k: int) -> list[tuple]:
    """(query, candidate, cosine) of the k nearest candidates of each query; others than itself, ties by smaller id."""
    out, qn, cn = [], np.sqrt((q * q).sum(axis=1)), np.sqrt((c * c).sum(axis=1))
    for at in range(0, len(q), 256):
        s = (q[at : at + 256] / qn[at : at + 256, None]) @ (c / cn[:, None]).T
        s[q_ids[at : at + 256, None] == c_ids[None, :]] = -np.inf
        kth = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
        for i in range(len(s)):
            near = np.flatnonzero((s[i] >= kth[i] - 1e-9) & (s[i] > -np.inf))
            exact = (c[near] * q[at + i]).sum(axis=1) / (cn[near] * qn[at + i])
            for j in np.lexsort((c_ids[near], -exact))[:k]:
                out.append((q_ids[at + i], c_ids[near[j]], exact[j]))
    return out


def _matrix(column) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), dtype=np.float64).reshape(len(column), -1)


def share_needed(index: DataFrame, router: Router, ids: np.ndarray, q: np.ndarray, k: int, recall: float) -> float:
    """The least share of probability whose parts hold `recall` of the k nearest of these rows (a bounded number)."""

    @tidy
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {}
        for batch in batches:
            part = dict(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()))
            for a, b, s in best_of(ids, q, np.asarray(batch.column(0)), _matrix(batch.column(1)), k) if batch.num_rows else []:
                kept.setdefault(int(a), []).append((-s, int(b), part[b]))
            kept = {a: sorted(x)[:k] for a, x in kept.items()}
        rows = [(a, b, p, -s) for a, x in kept.items() for s, b, p in x]
        a, b, p, s = zip(*rows) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(p, pa.int32()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "part", "score"])

    found = index.mapInArrow(near, "query_id long, vec_id long, part int, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "part").collect()  # k rows a query
    parts, before = router.order(q)
    at = {int(i): {int(p): m for p, m in zip(parts[j], before[j])} for j, i in enumerate(ids)}
    need = sorted(at[r["query_id"]][r["part"]] for r in top)
    return need[min(len(need) - 1, int(np.ceil(recall * len(need))))] if need else 1.0


CELL = ("part", "cell", "group")


def _ranker(k: int):
    """Rows sorted by cell, its own rows (kind 0) before the queries (kind 1) -> (query_id, vec_id, score)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, cell = None, [], None
        for batch in batches:
            key = np.stack([np.asarray(batch.column(c), np.int64) for c in (*CELL, "kind")], axis=1)
            ids, v = np.asarray(batch.column("vec_id")), _matrix(batch.column("v")) if batch.num_rows else np.zeros((0, 1))
            found: list[tuple] = []
            for own in np.split(np.arange(len(key)), np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1) if len(key) else []:
                at, kind = tuple(key[own[0], :3]), key[own[0], 3]
                if at != now:
                    now, held, cell = at, [], None
                if kind == 0:
                    held.append((ids[own], v[own]))
                elif held:
                    cell = cell or (np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
                    found += best_of(ids[own], v[own], *cell, k)
            a, b, s = zip(*found) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, every: int = 50, k: int = 5, recall: float = 0.95, levels: int = 7, sample_rows: int = 8192, calibration: int = 256, cell_rows: int = 16_384, query_rows: int = 262_144) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by `every`. The index is fitted on at most
    sample_rows rows, chosen by a hash of their ids, and holds all rows."""
    bound_batches(vectors.sparkSession)
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    raw = raw.where(finite & F.exists("v", lambda x: x != 0))
    schema = "query_id long, rank int, vec_id long, score double"
    lengths = raw.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return vectors.sparkSession.createDataFrame([], schema)
    raw = raw.where(F.size("v") == lengths[0]["n"])
    picked = raw.select("v", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(sample_rows).select("vec_id", "v").toArrow()
    sample, ids = _matrix(picked["v"]), np.asarray(picked["vec_id"])
    # At least 64 rows of the sample in each part.
    levels = max(0, min(levels, int(np.log2(max(1, len(sample) // 64)))))
    router, parts = fit_router(sample, levels), 1 << levels

    @tidy
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = router.order(_matrix(batch.column(1)))[0][:, 0] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(part, pa.int32())], names=["vec_id", "v", "part"])

    index = cut(raw.mapInArrow(put, "vec_id long, v array<double>, part int"), "index")
    sizes = np.zeros(parts, np.int64)
    for r in index.groupBy("part").count().collect():  # a row for each part
        sizes[r["part"]] = r["count"]
    asks = np.unique(ids, return_index=True)[1]
    asks = np.sort(asks)[:: max(1, len(asks) // calibration)][:calibration]
    share = share_needed(index, router, ids[asks], sample[asks], k, recall)

    @tidy
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = []
            if batch.num_rows:
                order, before = router.order(_matrix(batch.column(1)))
                probes = (before <= share).sum(axis=1)
                enough = np.argmax(np.cumsum(sizes[order], axis=1) > k, axis=1) + 1 if sizes.sum() > k else np.full(len(order), parts)
                to = [row[:n].tolist() for row, n in zip(order, np.maximum(probes, enough))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(to, pa.list_(pa.int32()))], names=["vec_id", "v", "parts"])

    queries = index.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "v").mapInArrow(route, "vec_id long, v array<double>, parts array<int>")
    queries = cut(queries.select("vec_id", "v", F.explode("parts").alias("part")), "queries")
    asked = np.zeros(parts, np.int64)
    for r in queries.groupBy("part").count().collect():  # a row for each part
        asked[r["part"]] = r["count"]
    cells, groups = (np.maximum(1, -(-n // size)).tolist() for n, size in ((sizes, cell_rows), (asked, query_rows)))
    of = lambda counts: F.element_at(F.array(*map(F.lit, counts)), F.col("part") + 1).cast("int")
    one = lambda counts: F.pmod(F.xxhash64("vec_id"), of(counts)).cast("int")
    all_ = lambda counts: F.explode(F.sequence(F.lit(0), of(counts) - 1))
    left = queries.withColumn("cell", all_(cells)).withColumn("group", one(groups)).withColumn("kind", F.lit(1))
    right = index.withColumn("cell", one(cells)).withColumn("group", all_(groups)).withColumn("kind", F.lit(0))
    rows = right.unionByName(left).select(*CELL, "kind", "vec_id", "v").repartition(*CELL).sortWithinPartitions(*CELL, "kind")
    found = rows.mapInArrow(_ranker(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
