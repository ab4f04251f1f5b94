import math

import numpy as np
import pytest

from plumeline.llm import whitening
from plumeline.llm.whitening import whitened

SCHEMA = "vec_id long, embedding array<float>, label int, key string, x string, weight int, n int, z int, length int"


@pytest.fixture(scope="module")
def table(spark):
    return lambda rows: spark.createDataFrame([(i, v, 0, "c", "c", 1, 1, 1, 1) for i, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    base = rng.normal(size=(300, 12)) @ np.diag(np.linspace(3, 0.5, 12)) + 5
    out = [(i, base[i].astype(np.float32).tolist()) for i in range(300)]
    out += [(1000 + i, out[0][1]) for i in range(200)]  # one common vector
    return [*out, out[5], (None, out[6][1])]  # a repeated row, a row without id


def plain(rows, weights, components=4):
    """By integer vector: n, deviation, whitened and explained, with numpy in one piece."""
    every = [tuple(math.floor(256 * float(np.float32(c))) for c in v) for _, v in rows]
    distinct = sorted(set(every))
    w = [every.count(x) if weights == "copies" else 1 for x in distinct]
    n, width = sum(w), len(distinct[0])
    sums = [sum(k * x[j] for k, x in zip(w, distinct, strict=True)) for j in range(width)]
    d = np.array([[float(n * x[j] - sums[j]) / n for j in range(width)] for x in distinct])
    v = (d * np.array(w)[:, None]).T @ d / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1][:components], axes[:, ::-1][:, :components]
    z = d @ axes / np.sqrt(e)
    return {x: (n, sum((n * x[j] - sums[j]) ** 2 for j in range(width)), z[i], e / np.trace(v)) for i, x in enumerate(distinct)}


@pytest.mark.parametrize("weights", ["one", "copies"])
def test_equals_one_piece(table, rows, weights):
    got = whitened(table(rows).repartition(5), weights=weights).collect()
    want = plain(rows, weights)
    by_id = {i: tuple(math.floor(256 * float(np.float32(c))) for c in v) for i, v in rows}
    assert len(got) == 4 * len(rows)
    sign = {}
    for r in got:
        n, deviation, z, explained = want[by_id[r.id]]
        k = r.component - 1
        assert (r.n, r.deviation) == (n, deviation)
        if abs(z[k]) > 0.1:
            sign.setdefault(k, np.sign(r.whitened * z[k]))
        assert r.whitened == pytest.approx(z[k] * sign.get(k, np.sign(r.whitened * z[k])), abs=1e-9)
        assert r.explained == pytest.approx(explained[k], rel=1e-9)
        assert r.identity_error < 1e-9


def test_unusable_rows_go_and_lengths_are_apart(table, rows):
    odd = [None, [], [math.nan] * 12, [math.inf] + [1.0] * 11, [None] + [1.0] * 11, [1.0, 2.0], [2.0, 1.0], [3.0, 3.5]]
    got = whitened(table([*rows[:100], *[(9000 + i, v) for i, v in enumerate(odd)]])).collect()
    own = {(r.id, r.component): r.n for r in got if r.id >= 9000}
    assert own == {(9000 + i, k): 3 for i in (5, 6, 7) for k in (1, 2)}
    assert {r.n for r in got if r.id < 9000} == {100} and max(r.identity_error for r in got) < 1e-9


def test_no_spread(table):
    got = whitened(table([(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [(1, 0, None, 0.0, None)] * 6
    two = whitened(table([(1, [1.0, 2.0, 3.0]), (2, [1.0, 4.0, 3.0])])).collect()
    assert sorted((r.id, r.component, None if r.whitened is None else abs(round(r.whitened, 9))) for r in two if r.component < 3) == [(1, 1, 1.0), (1, 2, None), (2, 1, 1.0), (2, 2, None)]


def test_extremes(table):
    got = whitened(table([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, -0.0])])).collect()
    assert len(got) == 6 and {r.deviation for r in got if r.id == 1} == {None} and all(math.isfinite(r.whitened) for r in got if r.whitened is not None)
    exact_sum = whitened(table([(1, [1e9]), (2, [-1e9]), (3, [1e9 / 2])])).collect()
    x = [math.floor(256 * float(np.float32(v))) for v in (1e9, -1e9, 5e8)]
    assert {r.id: r.deviation for r in exact_sum} == {i + 1: (3 * x[i] - sum(x)) ** 2 if (3 * x[i] - sum(x)) ** 2 < 2**63 else None for i in range(3)}


def test_many_lengths_in_passes(table, monkeypatch):
    monkeypatch.setattr(whitening, "MOST_ENTRIES", 8)
    rng = np.random.default_rng(2)
    got = whitened(table([(i, rng.normal(size=i % 3 + 1).tolist()) for i in range(60)])).collect()
    assert len(got) == 20 * (1 + 2 + 3) and {r.n for r in got} == {20} and max(r.identity_error for r in got) < 1e-9


def test_empty(table):
    assert whitened(table([])).collect() == []
    assert whitened(table([(1, None)])).collect() == []
