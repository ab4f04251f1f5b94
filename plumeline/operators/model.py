"""Gradient-boosted regression on the training table: train, evaluate, apply and shape the result."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeline.functions.columns import at_least, at_most, clamp, messages, said
from plumeline.functions.process_tables import PATHWAYS
from plumeline.operators.boosting import Job, Setting, Trees, grown, importance, node_table, read_nodes, scores
from plumeline.operators.features import FEATURES, add_features, encode_labels, label_indexer
from plumeline.operators.scoring import is_electro, score_points, slate_map, yield_range
from plumeline.session import use_checkpoint_dir

# The learner's settings, the targets, and the ranges of the training runs with the
# distance given to a pressure below its range and the decay of the confidence.
TREES, DEPTH, LEARNING_RATE, ROW_SAMPLE, COLUMN_SAMPLE, SEED = 150, 5, 0.08, 0.8, 0.8, 42
TARGETS = ["X_CO2", "Y_MeOH"]
TRAINED_T, TRAINED_P, TRAINED_H = (170.0, 240.0), (1.0, 50.0), (1.0, 4.0)
LOW_PRESSURE_DISTANCE, CONFIDENCE_DECAY = 0.2, 3.0

# Message and label texts, and the constants of the shaped result.
METHANOL = "Methanol synthesis"
METHANOL_PRODUCT = "CH3OH (methanol)"
LOW_CONFIDENCE = "⚠️ Prediction confidence: {percent}% - conditions outside training range"
CONFIDENCE_NOTE = "ML prediction with {percent}% confidence"
IN_RANGE = "Operating conditions within acceptable range"
MORE_HEAT = "Consider increasing temperature for higher conversion"
LESS_HEAT = "High temperature may decrease selectivity"
MORE_PRESSURE = "Higher pressure typically improves methanol synthesis"
SOURCE_NOTE = "Based on experimental data from Pt-MOF catalysts"
GRID_NOTE = "High grid CI impacts net efficiency for electrochemical routes"
ML_NAME, ML_CONFIDENCE = "XGBoost ML", "High 🟢"
RULE_NAME, RULE_CONFIDENCE = "Heuristic", "Medium 🟡"
OTHER_YIELD_FACTOR, CARBON_FACTOR, ML_HALF_WIDTH = 0.6, 0.9, 5.0
SLATE_CO_TOTAL, SLATE_CH4, SLATE_OTHERS = 95.0, 3.0, 2.0


SETTING = Setting(TREES, DEPTH, LEARNING_RATE, ROW_SAMPLE, COLUMN_SAMPLE, SEED)


@dataclass
class Model:
    """A trained model: its trees and the codes of its labels. `nodes` gives it as a table."""

    trees: Trees
    codes: DataFrame

    def nodes(self, name: str = "model") -> DataFrame:
        return node_table(self.codes.sparkSession, {name: self.trees})


def train_jobs(table: DataFrame, jobs: dict[str, Job], trees: int = TREES, depth: int = DEPTH, keys: list[str] | None = None) -> dict[str, Model]:
    """All jobs over one table, in one chain of passes. Labels are coded once, on the whole table, so a label that only some jobs' rows have keeps its own code.

    `keys` name a row for the draws of the rows; without them all columns do."""
    use_checkpoint_dir(table.sparkSession)
    codes = label_indexer(table)
    setting = replace(SETTING, trees=trees, depth=depth)
    found = grown(encode_labels(table, codes), FEATURES, jobs, keys or table.columns, setting)
    return {name: Model(t, codes) for name, t in found.items()}


def train(table: DataFrame, target: str, trees: int = TREES, depth: int = DEPTH) -> Model:
    """A model of one target; rows without the target are left out."""
    return train_each({target: (table, target)}, trees, depth)[target]


def train_each(jobs: dict[str, tuple[DataFrame, str]], trees: int = TREES, depth: int = DEPTH) -> dict[str, Model]:
    """Several trainings, each named and given as (table, target). Those over the same table grow side by side."""
    out: dict[str, Model] = {}
    tables = {id(table): table for table, _ in jobs.values()}
    for key, table in tables.items():
        own = {name: Job(target, "_all") for name, (t, target) in jobs.items() if id(t) == key}
        out |= train_jobs(table.withColumn("_all", F.lit(True)), own, trees, depth, table.columns)
    return {name: out[name] for name in jobs}


def predict_raw(model: Model, table: DataFrame, out: str) -> DataFrame:
    """The table with the model's prediction as one more column."""
    return predict_all({out: model}, table)


def predict_all(models: dict[str, Model], table: DataFrame) -> DataFrame:
    """The table with a column per model, named by its key. Models that share their codes are applied in one pass."""
    keep, left = [F.col(f"`{c}`") for c in table.columns], dict(models)
    added: list[str] = []
    while left:
        codes = next(iter(left.values())).codes
        own = {name: m for name, m in left.items() if m.codes is codes}
        left = {name: m for name, m in left.items() if name not in own}
        scored = encode_labels(table, codes).withColumn("_scores", scores({name: m.trees for name, m in own.items()}))
        table = scored.select(*keep, *[F.col(f"`{c}`") for c in added], *[F.get("_scores", i).alias(name) for i, name in enumerate(own)])
        added += own
    return table


def regression_metrics(df: DataFrame, keys: list[str], actual: str, predicted: str) -> DataFrame:
    """Rows, R2, RMSE and MAE per key by aggregates."""
    y, e = F.col(actual), F.col(actual) - F.col(predicted)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.lit(1.0) - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
    )


def training_report(metrics: DataFrame, cross_validation: DataFrame) -> DataFrame:
    """One row per target with its training, test and cross-validation figures.

    `metrics` has rows `(target, is_train, r2, rmse)`; `cross_validation` `(target, cv_r2_mean, cv_r2_std)`.
    """

    def side(name: str, train: bool) -> Column:
        return F.max(F.when(F.col("is_train") == F.lit(train), F.col(name)))

    wide = metrics.groupBy("target").agg(
        side("r2", True).alias("train_r2"),
        side("r2", False).alias("test_r2"),
        side("rmse", True).alias("train_rmse"),
        side("rmse", False).alias("test_rmse"),
    )
    return wide.join(cross_validation, "target", "left")


def learning_curve(model: Model, table: DataFrame, target: str) -> list[float]:
    """RMSE after each boosting round."""
    rows = learning_curves({target: model}, table, {target: target}, []).orderBy("round").collect()
    return [r["rmse"] for r in rows]


def learning_curves(models: dict[str, Model], table: DataFrame, targets: dict[str, str], keys: list[str]) -> DataFrame:
    """Rows `(keys..., target, round, rmse)` of all models in one pass: the trees' values of a row are added up round by round, and a task hands on the sums of squared
    errors of its batches, one row per key and target and not one per row and round. `targets` names the column of each model."""
    names = list(models)
    first = next(iter(models.values()))
    if any(m.codes is not first.codes for m in models.values()):
        raise ValueError("the models must share their label codes")
    held = [models[n].trees for n in names]
    rows = encode_labels(table, first.codes).select(*keys, *[F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(FEATURES)], *[F.col(targets[n]).cast("double").alias(f"_y{i}") for i, n in enumerate(names)])
    schema = ", ".join([*[f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys], "target string, n long, squares array<double>"])

    def run(batches):
        for pdf in batches:
            x = np.nan_to_num(pdf[[f"_x{i}" for i in range(len(FEATURES))]].to_numpy(dtype=np.float64, na_value=np.nan), nan=-np.inf)
            groups = pdf.groupby(keys, dropna=False).indices if keys else {(): np.arange(len(pdf))}
            for i, trees in enumerate(held):
                y = pdf[f"_y{i}"].to_numpy(dtype=np.float64, na_value=np.nan)
                parts: dict = {k: [0, np.zeros(len(trees.feature))] for k in groups}
                for k, at in groups.items():
                    for low in range(0, len(at), 4096):
                        own = at[low : low + 4096]
                        own = own[~np.isnan(y[own])]
                        errors = (y[own] - trees.base)[:, None] - trees.leaves(x[own]).cumsum(axis=1)
                        parts[k][0] += len(own)
                        parts[k][1] += (errors * errors).sum(axis=0)
                for k, (n, squares) in parts.items():
                    key = dict(zip(keys, k if isinstance(k, tuple) else (k,), strict=True))
                    yield pd.DataFrame([{**key, "target": names[i], "n": n, "squares": squares}])

    each = rows.mapInPandas(run, schema).select(*keys, "target", "n", F.posexplode("squares").alias("at", "square"))
    return each.groupBy(*keys, "target", (F.col("at") + 1).alias("round")).agg(F.sqrt(F.try_divide(F.sum("square"), F.sum("n"))).alias("rmse"))


def training_history(models: dict[str, Model], spark: SparkSession) -> DataFrame:
    """Rows `(model, round, used, n_rows, r2, rmse, mae)`: the figures of every round on the training rows (`used`) and on the others, gathered while the models grew."""
    rows = [(name, *r) for name, m in models.items() for r in m.trees.history]
    return spark.createDataFrame(rows, "model string, round int, used boolean, n_rows long, r2 double, rmse double, mae double")


def feature_importance(model: Model, spark: SparkSession, target: str, top: int | None = None) -> DataFrame:
    """Features by importance; there are as many rows as model inputs."""
    ranked = importance(model.nodes(target), FEATURES).select(F.col("model").alias("target"), "feature", "importance").orderBy(F.desc("importance"), "feature")
    return ranked.limit(top) if top else ranked


def fold_jobs(targets: list[str], folds: int) -> dict[str, Job]:
    """A job per target and fold, named `target/fold`; `in_folds` adds the columns that mark their rows."""
    return {f"{t}/{k}": Job(t, f"_in_{k}") for t in targets for k in range(folds)}


def in_folds(folded: DataFrame, folds: int) -> DataFrame:
    return folded.withColumns({f"_in_{k}": F.col("fold") != k for k in range(folds)})


def fold_metrics(models: dict[str, Model], folded: DataFrame, targets: list[str], folds: int) -> DataFrame:
    """Rows `(target, fold, n_rows, r2, rmse, mae)`: every row is predicted by the models that did not see it, in one pass over the table."""
    scored = predict_all({f"_p/{t}/{k}": models[f"{t}/{k}"] for t in targets for k in range(folds)}, folded)
    own = [F.array(*[F.col(f"`_p/{t}/{k}`") for k in range(folds)]) for t in targets]
    pairs = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("_actual"), F.get(p, F.col("fold").cast("int")).alias("_predicted")) for t, p in zip(targets, own, strict=True)])
    return regression_metrics(scored.select("fold", F.inline(pairs)).where("_actual IS NOT NULL"), ["target", "fold"], "_actual", "_predicted")


def cross_validate_each(folded: DataFrame, targets: list[str], folds: int, trees: int = TREES, depth: int = DEPTH, keys: list[str] | None = None) -> DataFrame:
    """Rows `(target, fold, n_rows, r2, rmse, mae)`: all folds of all targets grow in the same passes."""
    models = train_jobs(in_folds(folded, folds), fold_jobs(targets, folds), trees, depth, keys or folded.columns)
    return held_out_metrics(models, folded.sparkSession)


def held_out_metrics(models: dict[str, Model], spark: SparkSession) -> DataFrame:
    """The same figures as `fold_metrics`, as the training saw them: no further pass over the table."""
    last = training_history(models, spark).where(~F.col("used")).groupBy("model").agg(F.max_by(F.struct("n_rows", "r2", "rmse", "mae"), "round").alias("m"))
    return last.select(F.substring_index("model", "/", 1).alias("target"), F.substring_index("model", "/", -1).cast("int").alias("fold"), "m.*")


def cross_validate(folded: DataFrame, target: str, folds: int, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """R2 per fold, each predicted by a model trained on the other folds."""
    return cross_validate_each(folded, [target], folds, trees, depth).drop("target")


def cross_validation_summary(fold_metrics: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return fold_metrics.groupBy(*(keys or [])).agg(F.avg("r2").alias("cv_r2_mean"), F.stddev_pop("r2").alias("cv_r2_std"))


def save_models(models: dict[str, Model], path: str) -> None:
    """A folder per target with the node table and the label codes, both Parquet."""
    for target, model in models.items():
        model.nodes(target).coalesce(1).write.mode("overwrite").parquet(f"{path}/{target}/nodes")
        model.codes.write.mode("overwrite").parquet(f"{path}/{target}/codes")


def load_models(spark: SparkSession, path: str) -> dict[str, Model]:
    """The models that exist under the folder; an empty result means that rules must be used."""
    found = {}
    for target in TARGETS:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{target}/nodes")
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            trees = read_nodes(spark.read.parquet(f"{path}/{target}/nodes"), FEATURES)
            found[target] = Model(trees[target], spark.read.parquet(f"{path}/{target}/codes"))
    return found


def confidence(temperature: Column, pressure: Column, ratio: Column) -> Column:
    """Exponential decay of the mean distance from the ranges of the training runs; null where a condition is."""
    (t_low, t_high), (p_low, p_high), (h_low, h_high) = TRAINED_T, TRAINED_P, TRAINED_H
    t = F.when(temperature < t_low, (F.lit(t_low) - temperature) / t_low).when(
        temperature > t_high, (temperature - t_high) / t_high
    ).otherwise(0.0)
    p = F.when(pressure < p_low, LOW_PRESSURE_DISTANCE).when(pressure > p_high, (pressure - p_high) / p_high).otherwise(0.0)
    h = F.when(
        (ratio < h_low) | (ratio > h_high), F.least(F.abs(ratio - h_low), F.abs(ratio - h_high)) / h_high
    ).otherwise(0.0)
    known = temperature.isNotNull() & pressure.isNotNull() & ratio.isNotNull()
    return clamp(F.when(known, F.exp(F.lit(-CONFIDENCE_DECAY) * (t + p + h) / 3.0)), 0, 1)


def add_ml_predictions(points: DataFrame, models: dict[str, Model]) -> DataFrame:
    """Adds `X_CO2`, `Y_MeOH` (held in 0..100), `S_MeOH` and `confidence` to operating points."""
    keep = points.columns
    rows = add_features(points.withColumn("h2_co2_ratio", F.col("h2_to_co2")))
    rows = predict_all({f"_raw_{t}": models[t] for t in TARGETS if t in models}, rows)
    for target in TARGETS:
        value = clamp(F.col(f"_raw_{target}"), 0, 100) if target in models else F.lit(None).cast("double")
        rows = rows.withColumn(target, value)
    both = F.col("X_CO2").isNotNull() & F.col("Y_MeOH").isNotNull()
    selectivity = F.when(
        both & (F.col("X_CO2") > 0.01), clamp(F.col("Y_MeOH") / F.col("X_CO2") * 100.0, 0, 100)
    ).when(both, 0.0)
    return rows.withColumn("S_MeOH", selectivity).select(
        *keep,
        "X_CO2",
        "Y_MeOH",
        "S_MeOH",
        confidence(F.col("temperature_c"), F.col("pressure_bar"), F.col("h2_to_co2")).alias("confidence"),
    )


def shape_ml(predicted: DataFrame, keep: list[str]) -> DataFrame:
    """The predictions in the form of the rule-based result."""
    methanol = F.col("pathway") == METHANOL
    x, y, s = (F.coalesce(c, F.lit(0.0)) for c in ("X_CO2", "Y_MeOH", "S_MeOH"))
    estimate = F.when(methanol, y).otherwise(x * OTHER_YIELD_FACTOR)
    product = F.create_map(*[F.lit(v) for row in PATHWAYS for v in (row[0], row[1])])
    slate = F.when(
        methanol,
        F.create_map(
            F.lit("CH3OH"), F.round(s, 1),
            F.lit("CO"), F.round(F.lit(SLATE_CO_TOTAL) - s, 1),
            F.lit("CH4"), F.lit(SLATE_CH4),
            F.lit("others"), F.lit(SLATE_OTHERS),
        ),
    ).otherwise(F.create_map(F.lit("others"), F.lit(100.0)))
    score = F.round("confidence", 3)
    percent = F.format_string("%.0f", F.col("confidence") * 100.0)
    t, p = F.col("temperature_c"), F.col("pressure_bar")
    return predicted.select(
        *keep,
        F.when(methanol, F.lit(METHANOL_PRODUCT)).otherwise(
            F.coalesce(F.try_element_at(product, "pathway"), F.lit("Unknown"))
        ).alias("primary_product"),
        F.round(estimate, 1).alias("yield_pct"),
        at_least(F.round(estimate - ML_HALF_WIDTH, 1), 3.0).alias("yield_low"),
        at_most(F.round(estimate + ML_HALF_WIDTH, 1), 95.0).alias("yield_high"),
        F.col("h2_to_co2").alias("h2_per_co2"),
        F.round(at_most(x * CARBON_FACTOR, 95.0), 1).alias("carbon_util_pct"),
        score.alias("temperature_score"),
        score.alias("pressure_score"),
        score.alias("h2_score"),
        F.round(score, 3).alias("operating_score"),
        slate.alias("slate"),
        F.round(x, 2).alias("X_CO2"),
        F.round(y, 2).alias("Y_MeOH"),
        F.round(s, 2).alias("S_MeOH"),
        score.alias("confidence"),
        messages(
            (F.col("confidence") < 0.7, said(LOW_CONFIDENCE, percent=percent)),
            (methanol & (t < 200), F.lit(MORE_HEAT)),
            (methanol & (t > 280), F.lit(LESS_HEAT)),
            (methanol & (p < 20), F.lit(MORE_PRESSURE)),
            default=IN_RANGE,
        ).alias("suggestions"),
        F.filter(
            F.array(
                said(CONFIDENCE_NOTE, percent=percent),
                F.lit(SOURCE_NOTE),
                F.when(is_electro(F.col("pathway")) & (F.col("grid_ci_gco2_per_kwh") > 400), F.lit(GRID_NOTE)),
            ),
            lambda n: n.isNotNull(),
        ).alias("notes"),
    ).withColumn("yield_range", yield_range(F.col("yield_low"), F.col("yield_high")))


def route_predictions(points: DataFrame, models: dict[str, Model]) -> DataFrame:
    """Methanol points go through the models when there are any, all others through the rules."""
    keep = points.columns
    by_model = (F.col("pathway") == METHANOL) & F.lit(bool(models))
    ruled = (
        score_points(points.filter(~F.coalesce(by_model, F.lit(False))))
        .withColumn("slate", slate_map())
        .withColumn("model_used", F.lit(RULE_NAME))
        .withColumn("data_confidence", F.lit(RULE_CONFIDENCE))
    )
    shared = [
        "primary_product",
        "yield_pct",
        "yield_low",
        "yield_high",
        "yield_range",
        "h2_per_co2",
        "carbon_util_pct",
        "temperature_score",
        "pressure_score",
        "h2_score",
        "operating_score",
        "slate",
        "suggestions",
        "notes",
        "model_used",
        "data_confidence",
    ]
    ruled = ruled.select(*keep, *shared)
    if not models:
        return ruled
    learned = (
        shape_ml(add_ml_predictions(points.filter(by_model), models), keep)
        .withColumn("model_used", F.lit(ML_NAME))
        .withColumn("data_confidence", F.lit(ML_CONFIDENCE))
    )
    return ruled.unionByName(learned.select(*keep, *shared))
