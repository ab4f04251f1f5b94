"""Approximate nearest neighbours by learned partitions.

A neighbour graph over a bounded sample is cut into parts of equal size with few edges between them; a softmax classifier learns from a vector to tell the
parts of its neighbours. Every row is filed under its most probable part, a query goes to its several most probable parts, and
all rows filed there are ranked by exact cosine. How many parts a query visits is set on held-out rows of the sample, so that the target recall is reached.

Results: vectors that are null, empty or zero, or hold null or non-finite components, neither ask nor answer, and so do rows without
id. Rows with the query's id are its own and no answer. Ties go to the smaller id. Of equal vectors only those with the smallest ids can be
among the nearest, so the others are not filed. Vectors of different length do not meet. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeline.llm.graph import kept, runs, together
from plumeline.llm.vectors import matrix, usable, vector_key

NEAREST = 5
SAMPLE = 8192  # rows that the index is fitted on, at least; at most MOST_SAMPLE
MOST_SAMPLE = 65_536
MOST_PARTS = 1024
HELD_OUT = 512
GRAPH_NEIGHBOURS = 10
TARGET_RECALL = 0.96
ROWS_BLOCK, QUERY_BLOCK = 4096, 2048
MARGIN = 1e-9  # far above the rounding of a product of unit vectors
EXACT = 65_536  # pairs that are measured at once
LEAST_ROWS = 64  # a query visits more parts until it has seen so many rows


def neighbour_graph(unit: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of each row."""
    k = min(k, len(unit) - 1)
    out = np.empty((len(unit), k), dtype=np.int64)
    for low in range(0, len(unit), 1024):
        near = unit[low : low + 1024] @ unit.T
        near[np.arange(len(near)), np.arange(low, low + len(near))] = -2
        out[low : low + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(unit: np.ndarray, graph: np.ndarray, parts: int, sweeps: int = 8, slack: float = 1.1) -> np.ndarray:
    """Part of each row: halves along the principal direction until there are `parts` (a power of two), then rows move to the
    part that most of their graph neighbours are in, as long as no part outgrows `slack` times the mean."""
    part = np.zeros(len(unit), dtype=np.int64)
    for _ in range(parts.bit_length() - 1):
        new = part * 2
        for p in np.unique(part):
            rows = np.flatnonzero(part == p)
            own = unit[rows] - unit[rows].mean(axis=0)
            direction = np.linalg.eigh(own.T @ own)[1][:, -1]
            new[rows[np.argsort(own @ direction, kind="stable")[len(rows) // 2 :]]] += 1
        part = new
    sizes, most = np.bincount(part, minlength=parts), slack * len(unit) / parts
    for _ in range(sweeps):
        moved = 0
        for i in range(len(unit)):
            votes = np.bincount(part[graph[i]], minlength=parts)
            best = int(votes.argmax())
            if votes[best] > votes[part[i]] and sizes[best] + 1 <= most:
                sizes[part[i]] -= 1
                sizes[best] += 1
                part[i], moved = best, moved + 1
        if not moved:
            break
    return part


def softmax_classifier(unit: np.ndarray, targets: np.ndarray, epochs: int = 150, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and offsets of a linear classifier for soft targets, by Adam over the whole sample."""
    d, m = unit.shape[1], targets.shape[1]
    w = np.zeros((d + 1, m))
    x = np.hstack([unit, np.ones((len(unit), 1))])
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, epochs + 1):
        z = x @ w
        z = np.exp(z - z.max(axis=1, keepdims=True))
        grad = x.T @ (z / z.sum(axis=1, keepdims=True) - targets) / len(x) + 1e-5 * w
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w[:-1], w[-1]


class Router:
    """Scores of the parts for unit vectors, and how many parts a query visits."""

    def __init__(self, unit: np.ndarray, parts: int, target: float = TARGET_RECALL):
        parts = max(1, parts)
        asked = min(HELD_OUT, len(unit) // 4) if parts > 1 else 0
        train = unit[asked:]
        self.parts, self.probes = parts, 1
        self.weights, self.offsets = np.zeros((unit.shape[1], parts)), np.zeros(parts)
        if parts == 1:
            return
        graph = neighbour_graph(train, GRAPH_NEIGHBOURS)
        part = balanced_parts(train, graph, parts)
        targets = np.zeros((len(train), parts))
        np.add.at(targets, (np.repeat(np.arange(len(train)), graph.shape[1]), part[graph].ravel()), 1.0)
        targets[np.arange(len(train)), part] += graph.shape[1]
        self.weights, self.offsets = softmax_classifier(train, targets / targets.sum(axis=1, keepdims=True))
        filed = self.scores(train).argmax(axis=1)
        order = np.argsort(-self.scores(unit[:asked]), axis=1)
        nearest = np.argsort(-(unit[:asked] @ train.T), axis=1)[:, :NEAREST]
        visit = (order[:, None, :] == filed[nearest][:, :, None]).argmax(axis=2)  # at which visit each true neighbour is found
        reached = [(visit < p).mean() for p in range(1, parts + 1)]
        self.probes = next(p for p, r in enumerate(reached, 1) if r >= target or p == parts)

    def scores(self, unit: np.ndarray) -> np.ndarray:
        return unit @ self.weights + self.offsets


def _filed(router: Router, asking: bool, sizes: np.ndarray | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                rows = batch.slice(low, 2048)
                scores = router.scores(matrix(rows.column(1)))
                if asking:
                    order = np.argsort(-scores, axis=1, kind="stable")
                    seen = np.cumsum(sizes[order], axis=1)
                    visits = np.maximum(router.probes, (seen < LEAST_ROWS).sum(axis=1) + 1)
                    parts = [list(o[:v]) for o, v in zip(order.astype(np.int32), visits, strict=True)]
                else:
                    parts = [[int(p)] for p in scores.argmax(axis=1)]
                yield pa.record_batch([*rows.columns, pa.array(parts, pa.list_(pa.int32()))], names=["id", "vector", "parts"])

    return run


def _ranked(nearest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["part", "rows_block", "query_block"]):
            asks = table.column("asks").to_numpy()
            ask, file = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
            if not ask.num_rows or not file.num_rows:
                continue
            ids, own = ask.column("id").to_numpy(), file.column("id").to_numpy()
            raw, other = _doubles(ask.column("vector")), _doubles(file.column("vector"))
            close = matrix(ask.column("vector")) @ matrix(file.column("vector")).T
            close[ids[:, None] == own[None, :]] = -2
            # The product is off by less than MARGIN; every row that may be among the nearest is measured exactly.
            take = min(nearest, len(own))
            least = np.partition(close, len(own) - take, axis=1)[:, len(own) - take]
            i, j = np.nonzero((close >= least[:, None] - MARGIN) & (close > -2))
            score = np.concatenate([np.zeros(0), *[cosine(raw[i[k : k + EXACT]], other[j[k : k + EXACT]]) for k in range(0, len(i), EXACT)]])
            order = np.lexsort((own[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            best = np.arange(len(i)) - np.searchsorted(i, i, side="left") < nearest
            yield pa.record_batch([pa.array(ids[i[best]]), pa.array(own[j[best]]), pa.array(score[best])], names=["query_id", "vec_id", "score"])

    return run


def _doubles(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of rows in double precision; rows are scaled by a power of two first, so that nothing overflows."""
    a = np.ldexp(a, -np.frexp(np.abs(a).max(axis=1, keepdims=True))[1]) if len(a) else a
    b = np.ldexp(b, -np.frexp(np.abs(b).max(axis=1, keepdims=True))[1]) if len(b) else b
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def search(
    vectors: DataFrame, queries: Column, vector: str = "embedding", ident: str = "vec_id", nearest: int = NEAREST, parts: int | None = None
) -> DataFrame:
    """The `nearest` rows of every row for which `queries` holds: `query_id`, `rank`, `vec_id`, `score`."""
    rows = vectors.where(F.col(ident).isNotNull()).select(
        F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks")
    )
    rows = kept(rows.where(usable("vector")).dropDuplicates(["id", "vector"]).withColumn("key", vector_key("vector")))
    copy = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    file = kept(rows.withColumn("_copy", copy).where(F.col("_copy") <= nearest + 1).drop("_copy"))
    found = None
    for length, n in file.groupBy(F.size("vector")).count().orderBy(F.size("vector")).collect():
        own = F.size("vector") == length
        m = parts or (1 if n < 256 else min(MOST_PARTS, 1 << max(1, round(np.log2(n**0.5 / 12)))))
        sample = file.where(own).orderBy(F.xxhash64("id", F.lit(3)), "id").limit(min(MOST_SAMPLE, max(SAMPLE, 64 * m)))
        router = Router(matrix(sample.select("vector").toArrow().column("vector")), m)
        filed = file.where(own).select("id", "vector").mapInArrow(_filed(router, False), "id long, vector array<double>, parts array<int>")
        filed = kept(filed.select("id", "vector", F.explode("parts").alias("part")))
        counts = filed.groupBy("part").agg(F.count("*").alias("n_rows"))
        sizes = np.zeros(router.parts, dtype=np.int64)
        for p, size in counts.collect():
            sizes[p] = size
        asking = rows.where(own).where("asks").select("id", "vector")
        asking = asking.mapInArrow(_filed(router, True, sizes), "id long, vector array<double>, parts array<int>")
        asking = kept(asking.select("id", "vector", F.explode("parts").alias("part")))
        blocks = counts.join(asking.groupBy("part").agg(F.count("*").alias("n_asks")), "part").select(
            "part", F.ceil(F.col("n_rows") / ROWS_BLOCK).cast("int").alias("nr"), F.ceil(F.col("n_asks") / QUERY_BLOCK).cast("int").alias("nq")
        )
        dealt = _dealt(filed, blocks, "rows_block", "nr", "query_block", "nq", False).unionByName(
            _dealt(asking, blocks, "query_block", "nq", "rows_block", "nr", True)
        )
        ordered = together(dealt, ["part", "rows_block", "query_block"], "id")
        part = ordered.mapInArrow(_ranked(nearest), "query_id long, vec_id long, score double")
        found = part if found is None else found.union(part)
    if found is None:
        found = rows.select(F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def _dealt(rows: DataFrame, blocks: DataFrame, own: str, n_own: str, other: str, n_other: str, asks: bool) -> DataFrame:
    """Rows go to their own block and to every block of the other side, so that each row meets each query of its part once."""
    return rows.join(blocks, "part").select(
        "id", "vector", F.lit(asks).alias("asks"), "part",
        F.pmod(F.xxhash64("id", F.lit(23)), F.col(n_own)).cast("int").alias(own),
        F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)).alias(other),
    )
