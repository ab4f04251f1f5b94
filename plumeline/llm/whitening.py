"""Whitening of embeddings by a weighted covariance over distinct vectors.

Vectors become integers, `floor(scale * c)`. Identical integer vectors are grouped; the fit runs over the distinct ones, each with the weight one, or with the
number of its copies. Sums are exact integers. The covariance is a centred product: every task multiplies its own centred rows, and the products of the
tasks are added up. Eigenvectors come from that one matrix, each distinct vector is whitened once, and the result is joined back to all rows with that vector.

Copies: a task reduces them before the shuffle. The join back goes by the vector's digest and ends the plan, so that the adaptive skew join can cut a common vector's rows into several
tasks.

Results: rows whose vector is null or holds null or non-finite entries are dropped. So are empty vectors, which have no component. Entries beyond the range of a long become its
bounds. Vectors of one length are fitted together; other lengths are a fit of their own, with their own `n`. A component along
which the fit has no spread (fewer distinct vectors than components, constant entries) has a null `whitened` and an `explained` of 0; `identity_error` is that of the others, null if
there are none. A deviation beyond the range of a long is null. Repeated rows and rows without id keep their results. Components with equal eigenvalues come in the
order of the decomposition, the same for all rows. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeline.llm.graph import kept

SCALE = 256
COMPONENTS = 4
MOST_ENTRIES = 1 << 22  # of covariance matrices that a task or the driver holds at once; more lengths go in further passes
SAFE = 1 << 61  # integers below it can be subtracted without leaving 64 bits
LONGEST = (1 << 63) - 1

Fit = dict[int, dict]  # by length: n, sums, centre, rest, directions, roots, explained


def digitised(vectors: DataFrame, vector: str, ident: str, scale: int) -> DataFrame:
    """Rows `(id, key, x)`: the integer vector and its digest."""
    rows = vectors.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False)) & (F.size("vector") > 0))
    rows = rows.select("id", F.transform("vector", lambda c: F.floor(c * scale).cast("long")).alias("x"))
    return rows.select("id", F.sha2(F.array_join(F.col("x").cast("array<string>"), ",").cast("binary"), 256).alias("key"), "x")


def _by_length(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """Slices of batches: the vectors' length, the integer vectors as rows, and the slice. Runs of equal length stay together."""
    for batch in batches:
        lengths = pc.list_value_length(batch.column("x")).to_numpy()
        at = 0
        for length, run in groupby(lengths):
            n = len(list(run))
            for low in range(at, at + n, rows):
                part = batch.slice(low, min(rows, at + n - low))
                yield int(length), part.column("x").flatten().to_numpy().reshape(-1, int(length)), part
            at += n


def _centred(x: np.ndarray, fit: dict) -> np.ndarray:
    """x less the mean: first whole numbers, exactly, then the rest of the mean."""
    near = -SAFE < x.min() and x.max() < SAFE
    return (x - fit["centre"] if near else x.astype(np.float64) - fit["centre"].astype(np.float64)) - fit["rest"]


def _passes(lengths: list[tuple[int, int]]) -> Iterator[list[int]]:
    """Lengths in groups whose covariance matrices together have at most MOST_ENTRIES entries; a longer one goes alone."""
    held: list[int] = []
    for length, _ in sorted(lengths):
        if held and sum(k * k for k in held) + length * length > MOST_ENTRIES:
            yield held
            held = []
        held.append(length)
    if held:
        yield held


def _sums(sets: DataFrame) -> Fit:
    """By length: total weight and exact sums. Upper and lower halves of the integers are summed apart, so nothing overflows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for length, x, part in _by_length(batches):
            w = part.column("weight").to_numpy()[:, None]
            total = held.setdefault(length, [0, np.zeros(length, dtype=np.int64), np.zeros(length, dtype=np.int64)])
            total[0] += int(w.sum())
            total[1] += ((x >> 32) * w).sum(axis=0)
            total[2] += ((x & 0xFFFFFFFF) * w).sum(axis=0)
        for length, (n, upper, lower) in held.items():
            columns = [np.full(length, length), np.arange(length), np.full(length, n), upper, lower]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["length", "pos", "n", "upper", "lower"])

    rows = sets.select("x", "weight").mapInArrow(partial, "length long, pos long, n long, upper long, lower long")
    totals = rows.groupBy("length", "pos").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("upper", "lower")])
    fits: Fit = {}
    for r in totals.orderBy("length", "pos").collect():
        fit = fits.setdefault(r.length, {"n": r.n, "sums": []})
        fit["sums"].append((int(r.upper) << 32) + int(r.lower))
    for fit in fits.values():
        centre = [(2 * s + fit["n"]) // (2 * fit["n"]) for s in fit["sums"]]
        fit["centre"] = np.array(centre, dtype=np.int64)
        fit["rest"] = np.array([(s - fit["n"] * c) / fit["n"] for s, c in zip(fit["sums"], centre, strict=True)])
    return fits


def _covariances(sets: DataFrame, fits: Fit) -> dict[int, np.ndarray]:
    """By length: the weighted covariance, by centred products in the tasks. Rows of the matrices are added up apart, each from all tasks."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for length, x, part in _by_length(batches):
            d = _centred(x, fits[length])
            held[length] = held.get(length, 0.0) + (d * part.column("weight").to_numpy()[:, None]).T @ d
        for length, product in held.items():
            for low in range(0, length, 256):
                own = product[low : low + 256]
                columns = [pa.array(np.full(len(own), length)), pa.array(np.arange(low, low + len(own))), pa.array(list(own), pa.list_(pa.float64()))]
                yield pa.record_batch(columns, names=["length", "pos", "line"])

    def added(lines: pa.Table) -> pa.Table:
        total = lines.column("line").combine_chunks().flatten().to_numpy().reshape(lines.num_rows, -1).sum(axis=0)
        return pa.table({"length": lines.column("length")[:1], "pos": lines.column("pos")[:1], "line": pa.array([total], pa.list_(pa.float64()))})

    schema = "length long, pos long, line array<double>"
    rows = sets.select("x", "weight").mapInArrow(partial, schema).groupBy("length", "pos").applyInArrow(added, schema).toArrow()
    out = {length: np.zeros((length, length)) for length in fits}
    for length, pos, line in zip(rows.column("length").to_pylist(), rows.column("pos").to_pylist(), rows.column("line"), strict=True):
        out[length][pos] = line.values.to_numpy() / fits[length]["n"]
    return out


def _decomposed(fit: dict, v: np.ndarray, components: int) -> None:
    """Adds directions, square roots of the eigenvalues (0 without spread) and shares of the variance, largest first. The largest entry of a direction is positive."""
    values, columns = np.linalg.eigh((v + v.T) / 2)
    most = min(components, len(values))
    e, axes = np.maximum(values[::-1][:most], 0.0), columns[:, ::-1][:, :most]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(most)] < 0, -1.0, 1.0)
    trace = np.trace(v)
    spread = e > max(values[-1], 0.0) * len(values) * np.finfo(float).eps
    fit["directions"], fit["roots"] = axes, np.sqrt(np.where(spread, e, 0.0))
    fit["explained"] = np.where(spread, e, 0.0) / trace if trace > 0 else np.zeros(most)


def _deviations(x: np.ndarray, fit: dict) -> list[int | None]:
    """Sum over the entries of (n * x - S)^2, exactly."""
    n, sums = fit["n"], fit["sums"]
    most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums))
    if len(sums) * most * most <= LONGEST:
        d = x * n - np.array(sums, dtype=np.int64)
        return (d * d).sum(axis=1).tolist()
    d = x.astype(object) * n - np.array(sums, dtype=object)
    return [v if v <= LONGEST else None for v in (d * d).sum(axis=1).tolist()]


def _projected(fits: Fit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for length, x, part in _by_length(batches):
            fit = fits[length]
            has = fit["roots"] > 0
            z = _centred(x, fit) @ fit["directions"]
            z[:, has] /= fit["roots"][has]
            empty = np.zeros(z.shape, dtype=bool)
            empty[:, ~has] = True
            whitened = pa.array(z.ravel(), pa.float64(), mask=empty.ravel())
            offsets = pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32())
            columns = [
                part.column("key"), part.column("weight"), pa.array(np.full(len(z), length), pa.int64()), pa.array(np.full(len(z), fit["n"]), pa.int64()),
                pa.array(_deviations(x, fit), pa.int64()), pa.ListArray.from_arrays(offsets, whitened), pa.array([fit["explained"]] * len(z), pa.list_(pa.float64())),
            ]
            yield pa.record_batch(columns, names=["key", "weight", "length", "n", "deviation", "z", "share"])

    return run


def _identity_errors(done: DataFrame, fits: Fit, components: int) -> dict[int, float]:
    """By length: the largest absolute entry of the covariance of the whitened fit list, less the identity."""
    w, z = F.col("weight").cast("double"), [F.get("z", i) for i in range(components)]
    means = done.groupBy("length").agg(*[(F.sum(w * c) / F.sum(w)).alias(f"m{i}") for i, c in enumerate(z)]).collect()
    middle = [_by(F.col("length"), {r.length: r[f"m{i}"] for r in means}) for i in range(components)]
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    products = done.groupBy("length").agg(*[(F.sum(w * (z[i] - middle[i]) * (z[j] - middle[j])) / F.sum(w)).alias(f"p{i}_{j}") for i, j in pairs]).collect()
    out = {}
    for r in products:
        errors = [abs(r[f"p{i}_{j}"] - (i == j)) for i, j in pairs if r[f"p{i}_{j}"] is not None]
        out[r.length] = max(errors) if errors else None
    return out


def _by(key: Column, values: dict[int, float | None]) -> Column:
    """The value of a small table, written into the expression."""
    return F.try_element_at(F.create_map(*[c for k, v in values.items() for c in (F.lit(k).cast("long"), F.lit(v).cast("double"))]), key)


def whitened(
    vectors: DataFrame, vector: str = "embedding", ident: str = "vec_id", components: int = COMPONENTS, scale: int = SCALE, weights: str = "one"
) -> DataFrame:
    """One row per usable vector and component: `id`, `component` (from 1), `n` (the weight of the fit list), `deviation`, `whitened`, `explained`, `identity_error`.

    `weights` is `one` (every distinct vector counts once) or `copies` (as often as it occurs)."""
    if weights not in ("one", "copies"):
        raise ValueError(f"unknown weights: {weights}")
    rows = digitised(vectors, vector, ident, scale)
    weight = F.lit(1).cast("long") if weights == "one" else F.count("*")
    sets = kept(rows.groupBy("key").agg(weight.alias("weight"), F.first("x").alias("x")))
    lengths = [tuple(r) for r in sets.groupBy(F.size("x")).count().collect()]  # at most as many as the longest vector has entries
    schema = "key string, weight long, length long, n long, deviation long, z array<double>, share array<double>"
    done = None
    for some in _passes(lengths):
        own = sets.where(F.size("x").isin(some)) if len(some) < len(lengths) else sets
        fits = _sums(own)
        for length, v in _covariances(own, fits).items():
            _decomposed(fits[length], v, components)
        part = kept(own.mapInArrow(_projected(fits), schema))
        part = part.withColumn("identity_error", _by(F.col("length"), _identity_errors(part, fits, components)))
        done = part if done is None else done.union(part)
    if done is None:
        done = sets.sparkSession.createDataFrame([], f"{schema}, identity_error double")
    found = rows.select("id", "key").join(done.select("key", "n", "deviation", "z", "share", "identity_error"), "key")
    each = F.posexplode(F.arrays_zip("z", "share")).alias("at", "own")
    return found.select("id", "n", "deviation", "identity_error", each).select(
        "id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("own.z").alias("whitened"), F.col("own.share").alias("explained"), "identity_error"
    )
