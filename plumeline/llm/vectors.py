"""Embedding near-duplicates: spherical k-means cells, blocked cosine products inside the cells, one vector kept per group.

Vectors with equal label and equal components are one class. Every class lies in its `PROBES` nearest cells, and two classes are
compared where they share a cell (and label), so a pair that a cell border parts still meets next door; a pair that shares several cells counts in the
first of them. A cell of any size is cut into blocks, and a task sees two blocks.

Results: vectors that are null, empty or zero, or hold null or non-finite components, and vectors without label, link with nothing and
are kept. Vectors of different length do not link. Repeated rows are copies and link with each other. Rows without id count as links of
others but name no component; alone they have none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeline.llm.graph import block_pairs, components, forest, kept, runs, together

THRESHOLD = 0.93
PROBES = 8
ROUNDS = 4
MOST_CELLS = 16_384  # bounds what is broadcast: cells x length of a vector x 8 bytes
BLOCK = 768


def usable(vector: str) -> Column:
    """True for a vector that has a direction."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vector_key(*columns: str) -> Column:
    """128 bits that name equal values."""
    return F.concat(F.hex(F.xxhash64(*columns)), F.hex(F.xxhash64(F.lit(1), *columns)))


def matrix(column: pa.Array) -> np.ndarray:
    """Equally long vectors as rows of double precision and length one."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    out = out / np.abs(out).max(axis=1, keepdims=True)  # very large or small components neither overflow nor vanish
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def spherical_kmeans(vectors: DataFrame, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres from all rows of `vectors(key, vector)`, all of one length: begins with the rows of smallest hash; each round sums
    the vectors of a cell in the tasks first and brings one row per cell to the driver (at most MOST_CELLS)."""
    start = vectors.orderBy(F.xxhash64("key", F.lit(5)), "key").limit(cells).select("vector").toArrow()
    centres = matrix(start.column("vector"))
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], centres=centres) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros_like(centres), np.zeros(len(centres), dtype=np.int64)
            for batch in batches:
                for low in range(0, batch.num_rows, 2048):
                    unit = matrix(batch.column(0).slice(low, 2048))
                    cell = (unit @ centres.T).argmax(axis=1)
                    np.add.at(total, cell, unit)
                    n += np.bincount(cell, minlength=len(centres))
            has = np.flatnonzero(n)
            yield pa.record_batch([pa.array(has), pa.array(list(total[has]), pa.list_(pa.float64()))], names=["cell", "total"])

        summed = vectors.select("vector").mapInArrow(sums, "cell long, total array<double>")
        summed = summed.select("cell", F.posexplode("total")).groupBy("cell", "pos").agg(F.sum("col").alias("x"))
        new = centres.copy()
        got = summed.toPandas()
        new[got["cell"], got["pos"]] = got["x"]
        length = np.sqrt((new * new).sum(axis=1, keepdims=True))
        centres = np.where(length > 0, new / np.where(length > 0, length, 1), centres)
    return centres


def in_cells(vectors: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """Adds `cells`: the numbers of a vector's nearest centres."""
    probes = min(probes, len(centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                near = matrix(part.column("vector")) @ centres.T
                cells = np.argpartition(-near, probes - 1, axis=1)[:, :probes].astype(np.int32)
                yield pa.record_batch([*part.columns, pa.array(list(cells), pa.list_(pa.int32()))], names=[*part.schema.names, "cells"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInArrow(run, f"{schema}, cells array<int>")


def _first_shared(a: np.ndarray, b: np.ndarray, cell: int) -> np.ndarray:
    """Whether `cell` is the smallest cell that rows of a and b share."""
    out = np.empty(len(a), dtype=bool)
    for low in range(0, len(a), 20_000):
        x, y = a[low : low + 20_000], b[low : low + 20_000]
        shared = np.where((x[:, :, None] == y[:, None, :]).any(axis=2), x, np.iinfo(np.int32).max)
        out[low : low + 20_000] = shared.min(axis=1) == cell
    return out


def _compared(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["grouped", "cell", "low", "high"]):
            if table.num_rows < 2:
                continue
            unit = matrix(table.column("vector"))
            linked = unit @ unit.T >= threshold
            np.fill_diagonal(linked, False)
            if not linked.any():
                continue
            rows = np.flatnonzero(linked.any(axis=1))
            linked, table = linked[np.ix_(rows, rows)], table.take(pa.array(rows))
            keys, block = table.column("key").to_pylist(), table.column("block").to_numpy()
            copies = table.column("copies").to_numpy()
            cells = np.array(table.column("cells").to_pylist(), dtype=np.int32)
            tree = forest(lambda i, others, linked=linked: linked[i, others], len(rows))
            if table.column("low")[0].as_py() != table.column("high")[0].as_py():
                linked &= block[:, None] != block[None, :]
            a, b = np.nonzero(linked)
            here = _first_shared(cells[a], cells[b], table.column("cell")[0].as_py())
            counts = np.bincount(a[here], weights=copies[b[here]], minlength=len(rows)).astype(np.int64)
            has = np.flatnonzero(counts)
            columns = [keys[i] for i in has] + [keys[i] for i, _ in tree], [None] * len(has) + [keys[j] for _, j in tree]
            yield pa.record_batch(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string())]
                + [pa.array([int(c) for c in counts[has]] + [0] * len(tree), pa.int64())],
                names=["key", "other", "links"],
            )

    return run


def near_duplicates(
    vectors: DataFrame, vector: str = "embedding", ident: str = "vec_id", label: str = "label",
    threshold: float = THRESHOLD, probes: int = PROBES, cells: int | None = None,
) -> DataFrame:
    """One row per vector: `id`, `n_links`, `component_id`, `kept`. `cells` defaults to the root of the number of classes, at most MOST_CELLS."""
    key = F.when(usable("vector") & F.col("label").isNotNull(), vector_key("label", "vector"))
    rows = vectors.select(
        F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).alias("label")
    ).withColumn("key", key)
    sets = kept(
        rows.where("key is not null").groupBy("key").agg(
            F.min("id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector"), F.first("label").alias("label")
        )
    )
    found = None
    for length, n in sets.groupBy(F.size("vector")).count().orderBy(F.size("vector")).collect():
        own = sets.where(F.size("vector") == length)
        centres = spherical_kmeans(own.select("key", "vector"), cells or max(1, min(MOST_CELLS, round(n**0.5))))
        placed = in_cells(own.select("key", "vector", "copies", F.xxhash64("label").alias("grouped")), centres, probes)
        dealt = kept(placed).withColumn("cell", F.explode("cells"))
        sizes = dealt.groupBy("grouped", "cell").agg(F.count("*").alias("size")).where("size > 1")
        dealt = block_pairs(dealt.join(sizes, ["grouped", "cell"]), "cell", "size", "key", BLOCK)
        ordered = together(dealt.drop("size", "n_blocks"), ["grouped", "cell", "low", "high"], "key")
        part = ordered.mapInArrow(_compared(threshold), "key string, other string, links long")
        found = part if found is None else found.union(part)
    if found is None:
        found = sets.select("key", F.lit(None).cast("string").alias("other"), F.lit(0).cast("long").alias("links"))
    found = kept(found)
    counts = found.where("other is null").groupBy("key").agg(F.sum("links").alias("links"))
    groups = components(found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    named = sets.select("key", "least", "copies").join(groups.withColumnRenamed("node", "key"), "key", "left")
    named = named.withColumn("component", F.coalesce("component", "key")).join(counts, "key", "left")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("key", "copies", "links", "component_id")
    return (
        rows.select("id", "key").join(named, "key", "left")
        .select(
            "id", (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
            F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()))
    )
