import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeline.llm import neighbours, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, key string, cells string, copies string, part int, size int"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 16))
    out = [(i, base[i % 150] + rng.normal(size=16) * 0.18 * (i >= 150), i % 3 if i % 7 else 0) for i in range(500)]
    out += [(600 + i, base[0], 0) for i in range(80)]  # one common vector
    out += [(700 + i, base[1] + rng.normal(size=16) * 0.05, 1) for i in range(90)]  # a large near group
    out += [(i, v.astype(np.float32).tolist(), label) for i, v, label in out[:1]]  # a repeated row
    out = [(i, np.asarray(v, dtype=np.float32).tolist(), label) for i, v, label in out]
    ones = [1.0] * 16
    out += [(900, None, 0), (901, [0.0] * 16, 0), (902, [math.nan] * 16, 0), (903, [math.inf, *ones[1:]], 0), (904, [], 0), (905, [None, *ones[1:]], 0)]
    out += [(906, ones, None), (907, ones, None), (908, [1.0, 2.0], 0), (909, [2.0, 4.0], 0), (None, out[0][1], 0), (910, [1e-30] * 16, 5), (911, ones, 5)]
    return [(*r, "k", "c", "c", 1, 1) for r in out]


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    a, b = np.array(a, dtype=np.float64), np.array(b, dtype=np.float64)
    return (a @ b) / math.sqrt((a @ a) * (b @ b))


def test_equals_all_pairs(spark, rows):
    n, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if a[2] is not None and a[2] == b[2] and usable(a[1]) and usable(b[1]) and len(a[1]) == len(b[1]) and cosine(a[1], b[1]) >= 0.93:
                n[i], n[j] = n[i] + 1, n[j] + 1
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    want = sorted((str(r[0]), n[i], str(least.get(root(i))), r[0] == least.get(root(i)) if r[0] is not None else least.get(root(i)) is None) for i, r in enumerate(rows))
    found = vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA), cells=6).collect()
    assert sorted((str(r.id), r.n_links, str(r.component_id), r.kept) for r in found) == want
    assert sum(n) > 1000


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert vectors.near_duplicates(nothing).count() == 0
    assert neighbours.search(nothing, F.col("vec_id") % 50 == 0).count() == 0


def brute(rows, ids, k=5):
    out = {}
    for q in {r[0]: r for r in rows if r[0] in ids and usable(r[1])}.values():
        score = {r[0]: cosine(q[1], r[1]) for r in rows if r[0] is not None and r[0] != q[0] and usable(r[1]) and len(r[1]) == len(q[1])}
        out[q[0]] = sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
    return out


def test_exact_within_one_part(spark, rows):
    found = neighbours.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, parts=1).collect()
    want = brute(rows, {r[0] for r in rows if r[0] is not None and r[0] % 10 == 0})
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == {q for q in want if want[q]}
    for q, best in got.items():
        assert [v for v, _ in best] == [v for v, _ in want[q]]
        assert max(abs(a - b) for (_, a), (_, b) in zip(best, want[q], strict=True)) < 1e-12


@pytest.mark.parametrize("apart", [1e-6, 1e-7])
def test_nearest_among_close_copies(spark, apart):
    """Hundreds of vectors at almost the same distance: the exact measure decides."""
    rng = np.random.default_rng(12)
    base = rng.normal(size=64)
    rows = [(i, (base + rng.normal(size=64) * apart * (i > 0)).tolist()) for i in range(300)]
    found = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    score = neighbours.cosine(np.repeat([rows[0][1]], 299, axis=0), np.array([v for _, v in rows[1:]]))
    want = sorted(((-s, i) for i, s in zip(range(1, 300), score, strict=True)))[:5]
    assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r.rank)] == [(i, -s) for s, i in want]


def test_recall_with_learned_parts(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 24)) * 1.5
    rows = [(i, (centres[rng.integers(40)] + rng.normal(size=24)).astype(np.float32).tolist(), 0, "k", "c", "c", 1, 1) for i in range(4000)]
    found = neighbours.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, parts=16).collect()
    want = brute(rows, set(range(0, 4000, 50)))
    hits = sum(r.vec_id in {v for v, _ in want[r.query_id]} for r in found)
    assert len(found) == 5 * len(want) and hits / len(found) >= 0.9


def test_parts_are_balanced():
    rng = np.random.default_rng(2)
    unit = rng.normal(size=(1000, 8))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    graph = neighbours.neighbour_graph(unit, 8)
    part = neighbours.balanced_parts(unit, graph, 8)
    sizes = np.bincount(part, minlength=8)
    assert sizes.max() <= 1.1 * 125 + 1
    inside = (part[graph] == part[:, None]).mean()
    assert inside > 0.35  # by chance: 1/8
