import math
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeline.operators import boosting, model
from plumeline.operators.boosting import Job, Setting
from plumeline.operators.model import regression_metrics

NAMES = ["a", "b", "c"]
SETTING = Setting(trees=4, depth=3, rate=0.3, row_sample=0.8, column_sample=0.7, seed=7)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    out = []
    for i in range(700):
        a, b, c = float(rng.integers(0, 12)), round(float(rng.normal()), 2), float(rng.random() < 0.3)
        y = 3 * a + (8 if b > 0.3 else 0) + 5 * c * (a > 5) + float(rng.normal()) * 0.5
        out.append((i, a, None if i % 50 == 7 else b, c, None if i % 60 == 3 else y, 100 - y, i % 3 != 0))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double, z double, used boolean")


JOBS = {"y": Job("y", "used"), "z": Job("z", "used"), "all": Job("y", "every")}


def ready(table):
    return table.withColumn("every", F.lit(True))


@pytest.fixture(scope="module")
def models(table):
    return boosting.grown(ready(table), NAMES, JOBS, ["id"], SETTING)


def plain(rows, target, chosen_rows):
    """The same trees by going through all rows for every split, with whole numbers only."""
    x = [[-math.inf if r[1 + f] is None else r[1 + f] for f in range(3)] for r in rows]
    y = [r[target] for r in rows]
    known = [v for v in y if v is not None]
    bits = 18 - math.ceil(math.log2(max(known) - min(known)))
    q = 2.0**bits
    cuts = []
    for f in range(3):
        values = sorted(r[1 + f] for r in rows if r[1 + f] is not None)
        cuts.append(sorted({values[max(0, math.ceil(i / 64 * len(values)) - 1)] for i in range(1, 64)}))
    mark = [int(md5(f"{SETTING.seed}:row:{r[0]}".encode()).hexdigest()[:8], 16) for r in rows]
    trained = [i for i in range(len(rows)) if y[i] is not None and chosen_rows(rows[i])]
    base = sum(math.floor(y[i] * q + 0.5) for i in trained) / len(trained) / q
    left = {i: math.floor((y[i] - base) * q + 0.5) for i in range(len(rows)) if y[i] is not None}
    nodes = [(0, 0, None, None, base, len(trained))]
    for t in range(SETTING.trees):
        columns = boosting.tree_columns(SETTING, t, 3)
        drawn = [i for i in trained if (mark[i] + boosting.row_step(SETTING, t)) % 2**32 < int(0.8 * 2**32)]
        gone = {}

        def walk(node, own, inside, depth, t=t, columns=columns, gone=gone):
            g, n = sum(left[i] for i in own), len(own)
            best = (1.0, None, None)
            if depth < SETTING.depth:
                for f in columns:
                    for c in cuts[f]:
                        low = [i for i in own if x[i][f] <= c]
                        if 0 < len(low) < n:
                            lg, ln = sum(left[i] for i in low), len(low)
                            gain = float(lg) * lg / (ln + 1.0) + float(g - lg) * (g - lg) / (n - ln + 1.0) - float(g) * g / (n + 1.0)
                            if gain > best[0]:
                                best = (gain, f, c)
            gain, f, c = best
            if f is None:
                value = math.floor(0.3 * (float(g) / (n + 1.0)) + 0.5)
                nodes.append((t + 1, node, None, None, value / q, n))
                gone.update({i: value for i in inside})
                return
            nodes.append((t + 1, node, NAMES[f], c, None, n))
            for child, ok in ((2 * node + 1, lambda i: x[i][f] <= c), (2 * node + 2, lambda i: x[i][f] > c)):
                walk(child, [i for i in own if ok(i)], [i for i in inside if ok(i)], depth + 1)

        walk(0, drawn, list(left), 0)
        left = {i: v - gone[i] for i, v in left.items()}
    return nodes, base, [None if y[i] is None else y[i] - left[i] / q for i in range(len(rows))]


def shown(nodes):
    return sorted(((r["tree"], r["node"], r["feature"], r["threshold"], r["value"], r["n_rows"]) for r in nodes), key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize(("name", "target", "chosen"), [("y", 4, lambda r: r[6]), ("z", 5, lambda r: r[6]), ("all", 4, lambda r: True)])
def test_trees_equal_a_plain_search(spark, rows, models, name, target, chosen):
    want, base, _ = plain(rows, target, chosen)
    got = boosting.node_table(spark, {name: models[name]}).collect()
    assert shown(got) == sorted(want, key=lambda r: (r[0], r[1]))
    assert base == models[name].base


def test_partitions_and_the_way_of_adding_change_nothing(spark, table, models, monkeypatch):
    want = {n: m.rows(n) for n, m in models.items()}
    monkeypatch.setattr(boosting, "MOST_TO_DRIVER", 0)
    monkeypatch.setattr(boosting, "MOST_JOBS", 2)
    monkeypatch.setattr(boosting, "BLOCK", 50)
    monkeypatch.setattr(boosting, "CHECKPOINT_ROUNDS", 2)
    got = boosting.grown(ready(table).repartition(11, "c"), NAMES, JOBS, ["id"], SETTING)
    assert {n: m.rows(n) for n, m in got.items()} == want
    assert [h[:3] for h in got["y"].history] == [h[:3] for h in models["y"].history]


def test_history_equals_scoring(table, models):
    scored = ready(table).withColumn("p", boosting.scores(models)).select("used", "every", F.col("y").alias("actual"), F.get("p", 0).alias("p0"), F.get("p", 2).alias("p2"))
    for i, name, side in ((0, "y", "used"), (2, "all", "every")):
        want = {r[side]: r for r in regression_metrics(scored.where("actual IS NOT NULL"), [side], "actual", f"p{i}").collect()}
        last = {h[1]: h for h in models[name].history if h[0] == SETTING.trees}
        assert set(want) == set(last)
        for key, r in want.items():
            assert last[key][2] == r.n_rows and last[key][3:] == pytest.approx((r.r2, r.rmse, r.mae), rel=1e-4)


def test_scores_by_join_and_from_the_table(spark, table, models):
    nodes = boosting.node_table(spark, models)
    joined = {(r.id, r.model): r.prediction for r in boosting.scores_by_join(table, nodes, NAMES, ["id"]).collect()}
    direct = table.withColumn("p", boosting.scores(boosting.read_nodes(nodes, NAMES))).collect()
    order = list(boosting.read_nodes(nodes, NAMES))
    assert len(joined) == 3 * len(direct)
    for r in direct:
        assert list(r.p) == pytest.approx([joined[r.id, n] for n in order])


def test_trees_outlive_odd_tables(spark):
    schema = "id long, a double, b double, c double, y double, z double, used boolean"
    one = spark.createDataFrame([(1, 1.0, None, 0.0, 5.0, None, True)], schema)
    got = boosting.grown(ready(one), NAMES, JOBS, ["id"], SETTING)
    assert got["y"].predict(np.array([[1.0, np.nan, 0.0]])) == pytest.approx([5.0])
    assert got["z"].base == 0.0 and not got["z"].history
    none = boosting.grown(ready(one.limit(0)), NAMES, JOBS, ["id"], SETTING)
    assert none["y"].predict(np.zeros((2, 3))) == pytest.approx([0.0, 0.0])


def test_columns_and_rows_are_drawn_per_tree():
    setting = Setting(150, 5, 0.08, 0.8, 0.8, 42)
    drawn = [tuple(boosting.tree_columns(setting, t, 12)) for t in range(150)]
    assert {len(d) for d in drawn} == {9} and len(set(drawn)) > 60
    assert all(0.6 < sum(f in d for d in drawn) / 150 < 0.9 for f in range(12))
    marks = np.random.default_rng(1).integers(0, 1 << 32, 4000)
    share = [np.mean((marks + boosting.row_step(setting, t)) % (1 << 32) < 0.8 * (1 << 32)) for t in range(50)]
    assert min(share) > 0.76 and max(share) < 0.84


def test_masks_reach_the_leaves_of_a_walk():
    rng = np.random.default_rng(4)
    feature, cut = rng.integers(-1, 5, (20, 63)), rng.integers(0, 63, (20, 63))
    for node in range(31):
        feature[feature[:, node] < 0, 2 * node + 1] = feature[feature[:, node] < 0, 2 * node + 2] = -1  # nothing grows below an end
    bins = rng.integers(0, 64, (300, 5)).astype(np.uint8)
    got = boosting.reached(boosting.path_masks(feature, cut, 5, [64] * 5), list(bins.T))
    for t in range(20):
        for i in range(300):
            node = 0
            for _ in range(5):
                f = feature[t, node]
                node = 2 * node + 1 + (bool(bins[i, f] > cut[t, node]) if f >= 0 else 0)
                if f < 0:
                    break
            while node < 31:
                node = 2 * node + 1
            assert got[i, t] == node - 31


def test_importance_is_the_mean_gain(spark, models):
    nodes = boosting.node_table(spark, models)
    got = {(r.model, r.feature): r.importance for r in boosting.importance(nodes, [*NAMES, "never"]).collect()}
    gains = {}
    for r in nodes.where("feature IS NOT NULL").collect():
        gains.setdefault((r.model, r.feature), []).append(r.gain)
    for m in JOBS:
        whole = sum(np.mean(v) for k, v in gains.items() if k[0] == m)
        assert got[m, "never"] == 0.0
        assert [got[m, f] for f in NAMES] == pytest.approx([np.mean(gains[m, f]) / whole if (m, f) in gains else 0.0 for f in NAMES])
    assert model.SETTING.trees == 150


def test_rows_with_equal_features_are_one_to_the_passes(spark, table):
    many = ready(table).drop("id").crossJoin(spark.range(20).select(F.lit(0).alias("copy"))).withColumn("id", F.monotonically_increasing_id()).repartition(3, "id").checkpoint()
    grower = boosting.Grower(many, NAMES, JOBS, ["id"], SETTING)
    groups = grower.gather(0).agg(F.sum(F.length("bins") / len(NAMES))).first()[0]
    assert many.count() == 14_000
    assert groups <= 1.1 * table.select(*NAMES).distinct().count()  # a block or range may end inside a group


def test_many_rows_alike_are_cut(spark):
    one = spark.range(6000).select("id", F.lit(1.0).alias("a"), F.lit(2.0).alias("b"), F.lit(3.0).alias("c"), (F.col("id") % 7).cast("double").alias("y"), F.lit(True).alias("used"))
    grower = boosting.Grower(one, NAMES, {"y": Job("y", "used")}, ["id"], SETTING)
    sizes = [r[0] for r in grower.rows.groupBy(F.spark_partition_id()).agg(F.sum(F.length("mark") / 4)).select("sum((length(mark) / 4))").collect()]
    assert sum(sizes) == 6000 and max(sizes) < 3000


def test_cut_points_are_exact_quantiles(spark):
    frame = spark.range(300_000).select((F.col("id") * 7919 % 300_007).cast("double").alias("a"))
    values = sorted(r.a for r in frame.collect())
    want = [values[math.ceil(i * len(values) / 64) - 1] for i in range(1, 64)]
    assert boosting.cut_points(frame, ["a"])[0].tolist() == want
