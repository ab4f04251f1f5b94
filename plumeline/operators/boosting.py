"""Boosted regression trees as a node table, many models grown in one chain of jobs.

Features are cut into bins once. Every model (a target and a set of training rows) grows its tree of a round beside the others': a pass over the rows adds up, per model, node, feature and
bin, the residuals and the rows, so the number of jobs is rounds x depth whatever the number of models. Of two sibling nodes only the smaller is added up, the other is
the rest of its parent. Rows are drawn per round and columns per tree.

Residuals and leaf values are whole numbers of a quantum (a target's spread has 2^QUANTA of them), so sums are exact: trees do not depend on the partitioning, on lost executors or on the
order of rows, and another engine finds the same ones.

Rows with equal features move together, so trees grow from groups: rows are sorted by their features and checkpointed as blocks, and a pass over them adds up, per model and for several
rounds ahead, the drawn rows of every group and their targets (which rows a round draws does not depend on the trees). The passes of these rounds read the groups only, from memory or local disk. A group is a row
where no two rows are alike. A group of any size is cut by the rows' marks, so it is many tasks. The figures of all rounds come from one more pass over the rows.

Per-task histograms of a small number of tasks come to the driver as they are (at most `MOST_TO_DRIVER` bytes); beyond that they are added up by (model, feature) on the cluster first,
and only the sums come.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from plumeline.operators.ranks import cumulative_counts
from plumeline.session import use_checkpoint_dir

BINS = 64
BLOCK = 32_768  # rows, or groups of rows, in a block
TASK_ROWS, TASK_GROUPS = 500_000, 65_536  # beyond as many tasks as there are cores, a task has so many
MOST_JOBS = 64  # models in one chain
LEAST_ROUNDS, CHECKPOINT_ROUNDS = 4, 25  # rounds that one pass over the rows adds up for
MOST_TO_DRIVER = 1 << 28
QUANTA = 18  # bits that hold the spread of a target
REGULARISATION = 1.0  # added to the number of rows in a leaf's mean and in a gain
NODES = "model string, tree int, node int, feature string, threshold double, left_node int, right_node int, value double, gain double, n_rows long"


@dataclass
class Setting:
    """How trees grow: rounds, depth, learning rate, shares of rows per round and of columns per tree, and the seed of both draws."""

    trees: int
    depth: int
    rate: float
    row_sample: float
    column_sample: float
    seed: int


@dataclass
class Job:
    """One model: its target column and the boolean column that marks its training rows. Rows without target are none."""

    target: str
    used: str


@dataclass
class Trees:
    """A model as arrays, one line per tree and one place per node of a complete tree: children of i stand at 2i+1 and 2i+2. A leaf's children repeat its value, so all paths have one length."""

    features: list[str]
    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    n_rows: np.ndarray
    leaf: np.ndarray
    base_rows: int = 0
    history: list[tuple] = field(default_factory=list, repr=False)  # (round, used, n_rows, r2, rmse, mae), as the training saw them
    depth: int = field(init=False)
    masks: tuple | None = field(default=None, init=False, repr=False)

    def __post_init__(self):
        self.depth = int(math.log2(self.feature.shape[1] + 1)) - 1

    def rows(self, name: str) -> list[tuple]:
        """The node table's rows. Tree 0 is the base value."""
        out = [(name, 0, 0, None, None, None, None, self.base, None, self.base_rows)]
        for t in range(len(self.feature)):
            todo = [0]
            while todo:
                i = todo.pop()
                n = int(self.n_rows[t, i])
                if self.leaf[t, i]:
                    out.append((name, t + 1, i, None, None, None, None, float(self.value[t, i]), None, n))
                else:
                    split = self.features[self.feature[t, i]], float(self.threshold[t, i])
                    out.append((name, t + 1, i, *split, 2 * i + 1, 2 * i + 2, None, float(self.gain[t, i]), n))
                    todo += [2 * i + 1, 2 * i + 2]
        return out

    def _prepared(self) -> tuple:
        """Cut points of each feature over all trees, the masks of their bins, and the leaf values in the order in which `bit` names leaves."""
        if self.masks is None:
            inner = ~self.leaf & np.isfinite(self.threshold)
            cuts = [np.unique(self.threshold[inner & (self.feature == f)]) for f in range(len(self.features))]
            cut = np.zeros(self.feature.shape, dtype=np.int64)
            for f, c in enumerate(cuts):
                here = inner & (self.feature == f)
                cut[here] = np.searchsorted(c, self.threshold[here])
            feature = np.where(inner, self.feature, -1)
            first = (1 << self.depth) - 1
            self.masks = cuts, path_masks(feature, cut, self.depth, [len(c) + 1 for c in cuts]), np.ascontiguousarray(self.value[:, first:])
        return self.masks

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf values of rows (missing features go left), one column per tree."""
        cuts, masks, value = self._prepared()
        out, tree = np.empty((len(x), len(self.feature))), np.arange(len(self.feature))
        for low in range(0, len(x), 1024):
            part = x[low : low + 1024]
            place = reached(masks, [np.searchsorted(c, part[:, f], side="left") for f, c in enumerate(cuts)])
            out[low : low + 1024] = value[tree, place]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.leaves(x).sum(axis=1)


# The multiplier whose product with a power of two names it by its upper five bits.
_NAMES = 0x077CB531
_PLACE = np.zeros(32, dtype=np.uint8)
_PLACE[[(_NAMES << i & 0xFFFFFFFF) >> 27 for i in range(32)]] = np.arange(32)


def path_masks(feature: np.ndarray, cut: np.ndarray, levels: int, sizes: list[int]) -> dict[int, np.ndarray]:
    """For every feature that some tree splits on: by bin and tree, the places `levels` below the root that a row with this bin may reach, as bits.

    A row reaches the place that all its features leave open. Below an ended path the first place stands for all."""
    out: dict[int, np.ndarray] = {}
    trees = len(feature)
    for level in range(levels):
        width = 1 << (levels - level)
        for at in range(1 << level):
            node = (1 << level) - 1 + at
            left = ((1 << width // 2) - 1) << (at * width)
            right = left << width // 2
            for t in np.flatnonzero(feature[:, node] >= 0):
                f, c = int(feature[t, node]), int(cut[t, node])
                if f not in out:
                    out[f] = np.full((sizes[f], trees), 0xFFFFFFFF, dtype=np.uint32)
                out[f][: c + 1, t] &= np.uint32(~right & 0xFFFFFFFF)
                out[f][c + 1 :, t] &= np.uint32(~left & 0xFFFFFFFF)
    return out


def reached(masks: dict[int, np.ndarray], codes: list[np.ndarray]) -> np.ndarray:
    """The place that each row reaches in each tree, from the row's bin of every feature."""
    if not masks:
        return np.zeros((1, 1), dtype=np.uint8)
    open_places = None
    for f, table in masks.items():
        own = table[codes[f]]
        open_places = own if open_places is None else np.bitwise_and(open_places, own, out=open_places)
    lowest = open_places & (~open_places + np.uint32(1))
    return _PLACE[(lowest * np.uint32(_NAMES)) >> np.uint32(27)]


def from_rows(rows: list, features: list[str]) -> Trees:
    """A model from its rows of the node table."""
    grown = [r for r in rows if r["tree"] > 0]
    base = next(r for r in rows if r["tree"] == 0)
    trees = max((r["tree"] for r in grown), default=0)
    depth = max((r["node"] + 1 for r in grown), default=1).bit_length() - 1
    shape = (trees, (1 << (depth + 1)) - 1)
    out = Trees(
        list(features), base["value"], np.zeros(shape, dtype=np.int64), np.full(shape, np.inf), np.zeros(shape), np.zeros(shape), np.zeros(shape, dtype=np.int64), np.zeros(shape, dtype=bool), base["n_rows"]
    )
    place = {name: i for i, name in enumerate(features)}
    for r in grown:
        t, i = r["tree"] - 1, r["node"]
        out.n_rows[t, i] = r["n_rows"]
        if r["feature"] is None:
            out.value[t, i], out.leaf[t, i] = r["value"], True
        else:
            out.feature[t, i], out.threshold[t, i], out.gain[t, i] = place[r["feature"]], r["threshold"], r["gain"]
    _spread(out)
    return out


def _spread(trees: Trees) -> None:
    """Hands a leaf's value down to the places below it."""
    ended = trees.leaf.copy()
    for i in range(trees.feature.shape[1] // 2):
        for child in (2 * i + 1, 2 * i + 2):
            trees.value[:, child] = np.where(ended[:, i], trees.value[:, i], trees.value[:, child])
            ended[:, child] |= ended[:, i]


def draw(seed: int, *what: object) -> int:
    """32 bits from a digest: the same on every engine."""
    return int(md5(":".join(map(str, (seed, *what))).encode()).hexdigest()[:8], 16)


def row_mark(seed: int, keys: list[str]) -> Column:
    """32 bits of a row's key, from which its draws follow."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}:row"), *[F.col(k).cast("string") for k in keys])), 1, 8), 16, 10).cast("long")


def tree_columns(setting: Setting, tree: int, features: int) -> list[int]:
    """The columns that a tree may split on: those of the smallest draws."""
    most = max(1, int(setting.column_sample * features))
    return sorted(sorted(range(features), key=lambda f: (draw(setting.seed, "column", tree, f), f))[:most])


def row_step(setting: Setting, tree: int) -> int:
    return draw(setting.seed, "row", tree)


def cut_points(rows: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper bounds of all bins but the last, per feature: exact quantiles of all rows, in one pass that counts equal rows. A feature with few values has a bin for each."""
    alike = rows.groupBy(*[F.col(f"`{f}`").cast("double").alias(str(i)) for i, f in enumerate(features)]).agg(F.count(F.lit(1)).alias("n"))
    each = alike.select("n", F.posexplode(F.array(*[F.col(f"`{i}`") for i in range(len(features))])).alias("place", "value"))
    counted = each.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("place", "value").agg(F.sum("n").alias("n_rows")).checkpoint()
    ranked = cumulative_counts(counted, ["place"], "value", counted=counted)
    quantile = ranked.where(F.expr(f"before * {bins} div nullif(total, 0) < least({bins - 1}, (before + n_rows) * {bins} div nullif(total, 0))"))
    found: list[list[float]] = [[] for _ in features]
    for r in quantile.select("place", "value").collect():
        found[r["place"]].append(r["value"])
    return [np.unique(np.array(own, dtype=float)) for own in found]


def quantum_bits(spread: float) -> int:
    """The quantum of a target's residuals is 2 to minus this."""
    return QUANTA - (math.ceil(math.log2(spread)) if spread > 0 else 0)


def _block(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([a.tobytes()], pa.binary()) for a in arrays]


ROWS = ["bins", "start", "y", "used", "mark"]
STATE = ", ".join(f"{c} binary" for c in ROWS)


def _blocks(cuts: list[np.ndarray], targets: int):
    """Rows, sorted by their features, to blocks: bins and first row of each group of equal features, the targets, the training sets of a row as bits, and marks."""

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        columns = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(len(cuts) + targets + 2)]
        x = np.nan_to_num(np.column_stack(columns[: len(cuts)]).astype(np.float64), nan=-np.inf)
        start = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]).any(axis=1)])
        bins = np.column_stack([np.searchsorted(c, x[start, i], side="left") for i, c in enumerate(cuts)]).astype(np.uint8)
        y = np.array(columns[len(cuts) : len(cuts) + targets]).astype(np.float64)
        return pa.record_batch(_block(bins, start.astype(np.int32), y, columns[-2].astype(np.int64), columns[-1].astype(np.uint32)), names=ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(low, BLOCK))
                n += held[-1].num_rows
                if n >= BLOCK:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    return run


def _opened(batches: Iterator[pa.RecordBatch], *kinds: type) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield [np.frombuffer(column[i].as_buffer(), dtype=kind) for column, kind in zip(batch.columns, kinds, strict=True)]


def _opened_rows(batches: Iterator[pa.RecordBatch], features: int, targets: int) -> Iterator[tuple[np.ndarray, ...]]:
    for bins, start, y, used, mark in _opened(batches, np.uint8, np.int32, np.float64, np.int64, np.uint32):
        yield bins.reshape(-1, features), start, y.reshape(targets, -1), used, mark


def _places(bins: np.ndarray, masks: dict[int, np.ndarray], trees: int) -> np.ndarray:
    """The place that each group has reached in each tree, one line per tree."""
    if not masks:
        return np.zeros((trees, len(bins)), dtype=np.uint8)
    return np.ascontiguousarray(reached(masks, list(bins.T)).T)


def _gathered(features: int, targets: int, jobs: list[tuple[int, int]], base: np.ndarray, bits: np.ndarray, masks: dict[int, np.ndarray], value: np.ndarray, steps: list[int], limit: int):
    """Row blocks to blocks of groups: bins, what the trees so far say, and for each of the next rounds the sums of the drawn rows' targets and their number, by job. A job is (target, training set)."""
    before = value.shape[1]

    def sums(bins, start, y, used, mark) -> list[np.ndarray]:
        said = np.zeros((len(jobs), len(bins)), dtype=np.int32)
        for low in range(0, len(bins) if before else 0, 1024):
            place = _places(bins[low : low + 1024], masks, len(jobs) * before).reshape(len(jobs), before, -1)
            for m in range(len(jobs)):
                said[m, low : low + 1024] = np.take_along_axis(value[m], place[m].astype(np.int64), axis=1).sum(axis=0)
        known = ~np.isnan(y)
        quanta = [np.where(known[t], np.floor((y[t] - base[m]) * 2.0 ** bits[m] + 0.5), 0.0) for m, (t, _) in enumerate(jobs)]
        out = [bins, said]
        whole = known.all(axis=1)
        for step in steps:
            sampled = mark + np.uint32(step) < limit  # in 32 bits, so the sum begins anew at 2^32
            total, n = np.empty((len(jobs), len(bins))), np.empty((len(jobs), len(bins)), dtype=np.int32)
            drawn: dict[tuple, tuple] = {}
            for m, (t, flag) in enumerate(jobs):
                name = flag, None if whole[t] else t
                if name not in drawn:
                    own = (sampled & known[t] & ((used >> flag) & 1 > 0)).astype(np.float64)
                    drawn[name] = own, np.add.reduceat(own, start).astype(np.int32)
                total[m], n[m] = np.add.reduceat(quanta[m] * drawn[name][0], start), drawn[name][1]
            out += [total, n]
        return out

    names = _group_columns(range(len(steps)))

    def joined(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        return pa.record_batch(_block(np.concatenate([h[0] for h in held]), *[np.concatenate([h[i] for h in held], axis=1) for i in range(1, len(names))]), names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for block in _opened_rows(batches, features, targets):
            held.append(sums(*block))
            n += len(block[0])
            if n >= BLOCK // 2:
                yield joined(held)
                held, n = [], 0
        if n:
            yield joined(held)

    return run


def _group_columns(rounds: range) -> list[str]:
    return ["bins", "said", *[c for k in rounds for c in (f"s{k}", f"n{k}")]]


def _moved(features: int, jobs: int, masks: dict[int, np.ndarray], value: np.ndarray, carried: list[str]):
    """Adds the last tree of every job to what the trees say; `carried` are the columns that go along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = []
            for bins, own in _opened([batch.select(["bins", "said"])], np.uint8, np.int32):
                place = _places(bins.reshape(-1, features), masks, jobs)
                said.append((own.reshape(jobs, -1) + np.take_along_axis(value, place.astype(np.int64), axis=1)).astype(np.int32).tobytes())
            yield pa.record_batch([batch.column("bins"), pa.array(said, pa.binary()), *[batch.column(c) for c in carried]], names=["bins", "said", *carried])

    return run


def _histograms(features: int, jobs: int, chosen: list[int], masks: dict[int, np.ndarray], level: int, counted: list[np.ndarray]):
    """Per task: sums of residuals and rows by model, counted node, chosen feature and bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((2, len(nodes), len(chosen), BINS)) for nodes in counted]  # whole numbers, exact in doubles
        for bins, said, s, n in _opened(batches, np.uint8, np.int32, np.float64, np.int32):
            bins, said, s, n = bins.reshape(-1, features), said.reshape(jobs, -1), s.reshape(jobs, -1), n.reshape(jobs, -1)
            place = _places(bins, masks, jobs)
            for m, nodes in enumerate(counted):
                if not len(nodes):
                    continue
                slots = np.full(32, -1, dtype=np.int64)
                slots[nodes - (1 << level) + 1] = np.arange(len(nodes))
                slot = slots[place[m]]
                own = np.flatnonzero((slot >= 0) & (n[m] > 0))
                rows = n[m, own].astype(np.float64)
                left, at = s[m, own] - rows * said[m, own], slot[own] * BINS
                for k, c in enumerate(chosen):
                    index = at + bins[own, c]
                    for side, weights in enumerate((left, rows)):
                        total[m][side, :, k] += np.bincount(index, weights=weights, minlength=len(nodes) * BINS).reshape(-1, BINS)
        names = [(m, k) for m, t in enumerate(total) if t.shape[1] for k in range(len(chosen))]
        yield _sums_batch(names, [total[m][:, :, k].astype(np.int64).tobytes() for m, k in names])

    return run


def _measured(features: int, targets: int, jobs: list[tuple[int, int]], base: np.ndarray, masks: dict[int, np.ndarray], value: np.ndarray):
    """Per task and job: number, sum, sum of squares and of absolute values of the errors after each round, of the rows outside and in the training."""
    trees = value.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        figures = np.zeros((len(jobs), trees + 1, 2, 4))
        for bins, start, y, used, _ in _opened_rows(batches, features, targets):
            ends = np.r_[start, y.shape[1]]
            for low in range(0, len(bins), 1024):
                part = bins[low : low + 1024]
                rows = slice(ends[low], ends[low + len(part)])
                group = np.repeat(np.arange(len(part)), np.diff(ends[low : low + len(part) + 1]))
                place = _places(part, masks, len(jobs) * trees).reshape(len(jobs), trees, -1)
                for m, (t, flag) in enumerate(jobs):
                    known, trained = ~np.isnan(y[t, rows]), (used[rows] >> flag) & 1 > 0
                    sides, actual = np.array([known & ~trained, known & trained], dtype=np.float64), np.where(known, y[t, rows], 0.0)
                    figures[m, :, :, 0] += sides.sum(axis=1)
                    said = np.vstack([np.full((1, len(part)), base[m]), np.take_along_axis(value[m], place[m].astype(np.int64), axis=1)]).cumsum(axis=0)
                    for k in range(trees + 1):
                        error = actual - said[k][group]
                        figures[m, k, :, 1] += sides @ error
                        figures[m, k, :, 2] += sides @ (error * error)
                        figures[m, k, :, 3] += sides @ np.abs(error)
        yield _sums_batch([(m, -1) for m in range(len(jobs))], [own.tobytes() for own in figures])

    return run


SUMS = "model int, place int, sums binary"


def _sums_batch(names: list[tuple[int, int]], sums: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([m for m, _ in names], pa.int32()), pa.array([c for _, c in names], pa.int32()), pa.array(sums, pa.binary())], names=["model", "place", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for m, c, sums in zip(*[x.to_pylist() for x in batch.columns], strict=True):
            own = np.frombuffer(sums, dtype=np.int64 if c >= 0 else np.float64)
            total[m, c] = total[m, c] + own if (m, c) in total else own
    yield _sums_batch(list(total), [t.tobytes() for t in total.values()])


class Grower:
    """The state of all models between two jobs."""

    def __init__(self, rows: DataFrame, features: list[str], jobs: dict[str, Job], keys: list[str], setting: Setting, bins: int = BINS):
        use_checkpoint_dir(rows.sparkSession)
        self.features, self.jobs, self.setting = features, jobs, setting
        targets, flags = sorted({j.target for j in jobs.values()}), sorted({j.used for j in jobs.values()})
        self.targets, self.own = len(targets), [(targets.index(j.target), flags.index(j.used)) for j in jobs.values()]
        used = reduce(Column.bitwiseOR, [F.shiftleft(F.coalesce(F.col(f), F.lit(False)).cast("long"), i) for i, f in enumerate(flags)])
        x = [F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)]
        flat = rows.select(*x, *[F.col(t).cast("double").alias(f"y{i}") for i, t in enumerate(targets)], used.alias("used"), row_mark(setting.seed, keys).alias("mark")).checkpoint()
        self.cuts = cut_points(flat, [f"x{i}" for i in range(len(features))], bins)
        spread = flat.agg(*[(F.max(f"y{i}") - F.min(f"y{i}")).alias(str(i)) for i in range(len(targets))]).first()
        by_target = {t: quantum_bits(spread[str(i)] or 0.0) for i, t in enumerate(targets)}
        self.bits = np.array([by_target[j.target] for j in jobs.values()])
        trained = [F.when(F.shiftright("used", flag).bitwiseAND(1) > 0, F.col(f"y{t}")) for t, flag in self.own]
        whole = [F.sum(F.floor(y * 2.0 ** int(b) + 0.5)).alias(f"s{i}") for i, (y, b) in enumerate(zip(trained, self.bits, strict=True))]
        sums = flat.agg(*whole, *[F.count(y).alias(f"n{i}") for i, y in enumerate(trained)], F.count(F.lit(1)).alias("rows")).first()
        self.base_rows = [sums[f"n{i}"] for i in range(len(jobs))]
        self.base = np.array([sums[f"s{i}"] / self.base_rows[i] / 2.0 ** int(b) if self.base_rows[i] else 0.0 for i, b in enumerate(self.bits)])
        cores = rows.sparkSession.sparkContext.defaultParallelism
        # Equal features lie together; a group that is too large for a range is cut by the marks.
        alike = flat.withColumn("alike", F.xxhash64(*[f"x{i}" for i in range(len(features))])).repartitionByRange(max(cores, math.ceil(sums["rows"] / TASK_ROWS)), "alike", "mark")
        self.rows = alike.sortWithinPartitions("alike").drop("alike").mapInArrow(_blocks(self.cuts, self.targets), STATE).checkpoint()
        groups = self.rows.agg(F.sum(F.length("start") / 4)).first()[0] or 1
        self.tasks = max(cores, math.ceil(groups / TASK_GROUPS))
        # As many rounds at once as leave the groups no larger than the rows.
        room = int(sums["rows"] * (8 * self.targets + 12) / (groups * 12 * len(jobs)))
        self.together = min(CHECKPOINT_ROUNDS, max(LEAST_ROUNDS, room))
        self.state: DataFrame | None = None
        shape = (len(jobs), setting.trees, (1 << (setting.depth + 1)) - 1)
        self.feature = np.full(shape, -1, dtype=np.int64)
        self.cut = np.zeros(shape, dtype=np.int64)
        self.value, self.gain = np.zeros(shape), np.zeros(shape)
        self.n_rows = np.zeros(shape, dtype=np.int64)
        self.figures = np.zeros((len(jobs), setting.trees + 1, 2, 4))  # after each round: rows, sum, sum of squares and of absolute values of the errors

    def masks(self, tree: int, levels: int) -> dict[int, np.ndarray]:
        return path_masks(self.feature[:, tree], self.cut[:, tree], levels, [BINS] * len(self.features))

    def grown_masks(self, upto: int) -> dict[int, np.ndarray]:
        """The masks of all trees before `upto`, job by job."""
        shape = (len(self.jobs) * upto, self.feature.shape[2])
        return path_masks(self.feature[:, :upto].reshape(shape), self.cut[:, :upto].reshape(shape), self.setting.depth, [BINS] * len(self.features))

    def leaf_values(self, low: int, high: int) -> np.ndarray:
        """The leaf values of the trees from `low` to before `high` by place, below an ended path its own."""
        value, ended = self.value[:, low:high].copy(), self.feature[:, low:high] < 0
        for i in range(value.shape[2] // 2):
            for child in (2 * i + 1, 2 * i + 2):
                value[:, :, child] = np.where(ended[:, :, i], value[:, :, i], value[:, :, child])
                ended[:, :, child] |= ended[:, :, i]
        return value[:, :, (1 << self.setting.depth) - 1 :]

    def quanta(self, values: np.ndarray) -> np.ndarray:
        return np.rint(values * 2.0 ** self.bits[:, None, None]).astype(np.int32)

    def gather(self, tree: int) -> DataFrame:
        """The groups with the sums of the next rounds."""
        steps = [row_step(self.setting, t) for t in range(tree, min(tree + self.together, self.setting.trees))]
        limit = int(self.setting.row_sample * (1 << 32))
        kernel = _gathered(len(self.features), self.targets, self.own, self.base, self.bits, self.grown_masks(tree), self.quanta(self.leaf_values(0, tree)), steps, limit)
        columns = ", ".join(f"{c} binary" for c in _group_columns(range(len(steps))))
        return self.rows.mapInArrow(kernel, columns).coalesce(self.tasks).persist()

    def sums(self, tree: int, level: int, chosen: list[int], counted: list[np.ndarray]) -> list[np.ndarray]:
        """Per model: (residuals and rows, counted node, chosen feature, bin)."""
        k = tree % self.together
        kernel = _histograms(len(self.features), len(self.jobs), chosen, self.masks(tree, level), level, counted)
        parts = self.state.select("bins", "said", f"s{k}", f"n{k}").mapInArrow(kernel, SUMS)
        if 16 * BINS * len(chosen) * sum(map(len, counted)) * self.tasks > MOST_TO_DRIVER:
            parts = parts.repartition(len(self.jobs) * len(chosen), "model", "place").mapInArrow(_added, SUMS)
        out = [np.zeros((2, len(nodes), len(chosen), BINS), dtype=np.int64) for nodes in counted]
        found = parts.toArrow()
        for m, c, sums in zip(*[x.to_pylist() for x in found.columns], strict=True):
            out[m][:, :, c] += np.frombuffer(sums, dtype=np.int64).reshape(2, -1, BINS)
        return out

    def grow(self, tree: int) -> None:
        chosen = tree_columns(self.setting, tree, len(self.features))
        models = range(len(self.jobs))
        known: list[dict[int, np.ndarray]] = [{} for _ in models]
        open_nodes = [[0] for _ in models]
        for level in range(self.setting.depth):
            # Siblings: the one with fewer rows is counted, the other is the rest of its parent.
            counted = []
            for m in models:
                pairs = [i for i in open_nodes[m] if i == 0 or i % 2]
                counted.append(np.array([i if i == 0 or self.n_rows[m, tree, i] <= self.n_rows[m, tree, i + 1] else i + 1 for i in pairs], dtype=np.int64))
            if not any(map(len, counted)):
                break
            got = self.sums(tree, level, chosen, counted)
            for m in models:
                now = {}
                for k, i in enumerate(counted[m]):
                    i = int(i)
                    now[i] = got[m][:, k]
                    if i:
                        other = i + 1 if i % 2 else i - 1
                        now[other] = known[m][(i - 1) // 2] - now[i]
                known[m] = now
                open_nodes[m] = self.split(m, tree, chosen, now)

    def split(self, m: int, tree: int, chosen: list[int], held: dict[int, np.ndarray]) -> list[int]:
        """Splits the nodes of one level and returns those of the next."""
        out: list[int] = []
        for i, sums in sorted(held.items()):
            g, n = sums.cumsum(axis=2)
            all_g, all_n = float(g[0, -1]), float(n[0, -1])
            if i == 0:
                self.n_rows[m, tree, 0] = int(all_n)
                self.value[m, tree, 0] = self.leaf(m, all_g, all_n)
            left_g, left_n = g.astype(float), n.astype(float)
            right_g, right_n = all_g - left_g, all_n - left_n
            gain = left_g * left_g / (left_n + REGULARISATION) + right_g * right_g / (right_n + REGULARISATION) - all_g * all_g / (all_n + REGULARISATION)
            gain = np.where((left_n >= 1) & (right_n >= 1), gain, 0.0)
            best = int(gain.argmax())
            place, cut = divmod(best, BINS)
            if gain[place, cut] <= 1.0:  # less than a quantum, squared
                continue
            self.feature[m, tree, i], self.cut[m, tree, i] = chosen[place], cut
            self.gain[m, tree, i] = gain[place, cut] * 2.0 ** (-2 * int(self.bits[m]))
            for child, child_g, child_n in ((2 * i + 1, left_g, left_n), (2 * i + 2, right_g, right_n)):
                self.n_rows[m, tree, child] = int(child_n[place, cut])
                self.value[m, tree, child] = self.leaf(m, child_g[place, cut], child_n[place, cut])
                out.append(child)
        return out

    def leaf(self, m: int, g: float, n: float) -> float:
        return math.floor(self.setting.rate * (g / (n + REGULARISATION)) + 0.5) / 2.0 ** int(self.bits[m])

    def trees(self, m: int, upto: int) -> Trees:
        feature = self.feature[m, :upto]
        threshold = np.full(feature.shape, np.inf)
        for f, cuts in enumerate(self.cuts):
            here = feature == f
            threshold[here] = cuts[self.cut[m, :upto][here]] if len(cuts) else np.inf
        value = self.value[m, :upto].copy()
        leaf = feature < 0
        out = Trees(self.features, float(self.base[m]), np.maximum(feature, 0), threshold, value, self.gain[m, :upto], self.n_rows[m, :upto], leaf, self.base_rows[m])
        _spread(out)
        return out

    def advance(self, tree: int) -> DataFrame:
        """The groups after the tree."""
        k = tree % self.together
        left = _group_columns(range(k + 1, min(self.together, self.setting.trees - tree + k)))
        moved = _moved(len(self.features), len(self.jobs), self.masks(tree, self.setting.depth), self.quanta(self.leaf_values(tree, tree + 1))[:, 0], left[2:])
        return self.state.select(*left).mapInArrow(moved, ", ".join(f"{c} binary" for c in left)).persist()

    def run(self) -> dict[str, Trees]:
        before = None
        for tree in range(self.setting.trees):
            before, self.state = self.state, self.advance(tree - 1) if tree % self.together else self.gather(tree)
            self.grow(tree)
            if before is not None:  # the state after it has been read by now
                before.unpersist()
        if self.state is not None:
            self.state.unpersist()
        self.measure()
        return {name: self.trees(m, self.setting.trees) for m, name in enumerate(self.jobs)}

    def measure(self) -> None:
        """The figures of all rounds."""
        trees = self.setting.trees
        kernel = _measured(len(self.features), self.targets, self.own, self.base, self.grown_masks(trees), self.leaf_values(0, trees))
        parts = self.rows.mapInArrow(kernel, SUMS)
        if 64 * (trees + 1) * len(self.jobs) * self.rows.rdd.getNumPartitions() > MOST_TO_DRIVER:
            parts = parts.repartition(len(self.jobs), "model").mapInArrow(_added, SUMS)
        found = parts.toArrow()
        for m, sums in zip(found.column("model").to_pylist(), found.column("sums").to_pylist(), strict=True):
            self.figures[m] += np.frombuffer(sums, dtype=np.float64).reshape(-1, 2, 4)

    def history(self, m: int) -> list[tuple]:
        """Rows `(round, used, n_rows, r2, rmse, mae)` of a model after each round, from 0, on its training rows and on the others."""
        out = []
        for side in (1, 0):
            n, total, squares, _ = self.figures[m, 0, side]
            if n == 0:
                continue
            spread = squares - total * total / n
            for i, (_, _, errors, absolute) in enumerate(self.figures[m, :, side]):
                out.append((i, bool(side), int(n), float(1 - errors / spread) if spread > 0 else None, math.sqrt(errors / n), float(absolute / n)))
        return out


def grown(rows: DataFrame, features: list[str], jobs: dict[str, Job], keys: list[str], setting: Setting, bins: int = BINS) -> dict[str, Trees]:
    """All models, up to MOST_JOBS in one chain. `keys` name a row; a row's draws follow from them, so equal keys are drawn together."""
    out: dict[str, Trees] = {}
    names = list(jobs)
    for low in range(0, len(names), MOST_JOBS):
        grower = Grower(rows, features, {n: jobs[n] for n in names[low : low + MOST_JOBS]}, keys, setting, bins)
        own = grower.run()
        for m, trees in enumerate(own.values()):
            trees.history = grower.history(m)
        out |= own
    return out


def node_table(spark: SparkSession, models: dict[str, Trees]) -> DataFrame:
    """All models as rows: at most 2^(depth+1) per tree, however large the training table was."""
    return spark.createDataFrame([r for name, trees in models.items() for r in trees.rows(name)], NODES)


def read_nodes(nodes: DataFrame, features: list[str]) -> dict[str, Trees]:
    by_model: dict[str, list] = {}
    for r in nodes.collect():
        by_model.setdefault(r["model"], []).append(r)
    return {name: from_rows(rows, features) for name, rows in by_model.items()}


def scores(models: dict[str, Trees]) -> Column:
    """An array with the prediction of each model, in their order, from the feature columns of a row."""
    held = list(models.values())

    @pandas_udf("array<double>")
    def predicted(*columns: pd.Series) -> pd.Series:
        x = np.nan_to_num(np.column_stack([c.to_numpy(dtype=np.float64, na_value=np.nan) for c in columns]), nan=-np.inf)
        return pd.Series(list(np.column_stack([m.predict(x) for m in held])))

    return predicted(*[F.col(f"`{f}`").cast("double") for f in held[0].features])


def scores_by_join(rows: DataFrame, nodes: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """Rows `(keys..., model, prediction)` by joins with the node table, a level at a time: every row stands at the root of every tree and goes down until all stand at leaves."""
    inner = F.broadcast(nodes.select("model", "tree", "node", "feature", "threshold", "left_node", "right_node", "value"))  # at most 2^(depth+1) rows per tree
    named = F.create_map(*[x for f in features for x in (F.lit(f), F.col(f"`{f}`").cast("double"))])
    sizes = nodes.groupBy("model").agg(F.max("tree").alias("last")).orderBy("model").collect()
    every = F.concat(*[_roots(r["model"], r["last"]) for r in sizes])
    walking = rows.select(*keys, named.alias("x"), F.inline(every)).withColumn("node", F.lit(0))
    ended, depth = [], nodes.agg(F.max("node")).first()[0]
    for _ in range((depth + 1).bit_length()):
        at = walking.join(inner, ["model", "tree", "node"])
        ended.append(at.where("feature IS NULL").select(*keys, "model", "tree", "value"))
        right = F.coalesce(F.element_at("x", F.col("feature")) > F.col("threshold"), F.lit(False))
        walking = at.where("feature IS NOT NULL").select(*keys, "x", "model", "tree", F.when(right, F.col("right_node")).otherwise(F.col("left_node")).alias("node"))
    whole = ended[0]
    for part in ended[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy(*keys, "model").agg(F.sum("value").alias("prediction"))


def _roots(name: str, last: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(last)), lambda t: F.struct(F.lit(name).alias("model"), t.alias("tree")))


def importance(nodes: DataFrame, features: list[str]) -> DataFrame:
    """Rows `(model, feature, importance)`: the mean gain of a feature's splits, as a share of all features' means. Features without split have 0."""
    split = nodes.where("feature IS NOT NULL").groupBy("model", "feature").agg(F.avg("gain").alias("_gain"))
    every = nodes.where("tree = 0").select("model", F.explode(F.array(*[F.lit(f) for f in features])).alias("feature"))
    whole = split.groupBy("model").agg(F.sum("_gain").alias("_all"))
    return every.join(split, ["model", "feature"], "left").join(whole, "model", "left").select(
        "model", "feature", F.coalesce(F.col("_gain") / F.col("_all"), F.lit(0.0)).alias("importance")
    )
