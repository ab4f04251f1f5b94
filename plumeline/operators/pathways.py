"""Reduction pathways and commitment scenarios against business as usual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeline.functions.columns import at_least, said
from plumeline.operators.forecast import forecast_best
from plumeline.operators.series import spans
from plumeline.operators.trend import polynomial_trend

# Target used instead of zero by the exponential pathway, steepness of the S-curve over
# the whole span, and the factor of the gentle decrease in smoothing. Then the texts of rejected scenarios.
EXPONENTIAL_FLOOR = 0.01
SCURVE_STEEPNESS = 8.0
GENTLE_DECREASE = 0.995
TOO_EARLY = "Target year must be > {start}"
NO_SERIES = "Unknown series"


def linear_pathway(start: Column, current: Column, target_period: Column, target: Column, period: Column) -> Column:
    return current + F.try_divide(target - current, target_period - start) * (period - start)


def exponential_pathway(
    start: Column, current: Column, target_period: Column, target: Column, period: Column
) -> Column:
    end = F.when(target <= 0, F.lit(EXPONENTIAL_FLOOR)).otherwise(target)
    rate = F.try_divide(-F.log(F.try_divide(end, current)), target_period - start)
    return current * F.exp(-rate * (period - start))


def scurve_pathway(start: Column, current: Column, target_period: Column, target: Column, period: Column) -> Column:
    length = target_period - start
    middle = start + length / F.lit(2.0)
    return target + (current - target) / (F.lit(1.0) + F.exp(F.try_divide(F.lit(SCURVE_STEEPNESS), length) * (period - middle)))


def smooth_declining(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Walks each path from left to right and replaces every rise by 99.5 % of the value before it.

    The step depends on the value already smoothed, so it is a fold over one short array per path
    (its length is the forecast horizon); paths stay parallel.
    """
    points = F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col(value).cast("double").alias("v"))))
    values = F.transform(F.col("_points"), lambda p: p["v"])
    walked = F.aggregate(
        values,
        F.array().cast("array<double>"),
        lambda done, v: F.concat(
            done,
            F.array(
                F.when(v > F.try_element_at(done, F.lit(-1)), F.try_element_at(done, F.lit(-1)) * GENTLE_DECREASE).otherwise(v)
            ),
        ),
    )
    times = F.transform(F.col("_points"), lambda p: p["t"])
    return (
        df.groupBy(*keys)
        .agg(points.alias("_points"))
        .select(*keys, F.explode(F.arrays_zip(times.alias("t"), walked.alias("v"))).alias("_p"))
        .select(*keys, F.col("_p.t").alias(time), F.col("_p.v").alias(value))
    )


def resolve_targets(scenarios: DataFrame, current: str = "current") -> DataFrame:
    """Adds `target` from the kind: net_zero, percent (of `base`, or of the current value where base is
    null), forecast (what is left of that after a fraction) or absolute. The amount is the percentage, the
    fraction or the absolute value."""
    base = F.coalesce(F.col("base"), F.col(current)) if "base" in scenarios.columns else F.col(current)
    kind, amount = F.col("target_kind"), F.col("target_amount")
    return scenarios.withColumn(
        "target",
        F.when(kind == "net_zero", F.lit(0.0))
        .when(kind == "percent", base * (F.lit(1.0) - amount / F.lit(100.0)))
        .when(kind == "forecast", base * (F.lit(1.0) - amount))
        .when(kind == "absolute", amount),
    )


def scenario_list(keyed: DataFrame, scenarios: list[dict]) -> DataFrame:
    """The same few scenarios for every key: the literal list is exploded on each row of `keyed`."""
    fields = [
        F.struct(
            F.lit(s["scenario"]).alias("scenario"),
            F.lit(s["pathway"]).alias("pathway"),
            F.lit(s["target_kind"]).alias("target_kind"),
            F.lit(float(s.get("target_amount", 0.0))).alias("target_amount"),
            F.lit(int(s["target_period"])).alias("target_period"),
            F.lit(list(s.get("milestones", {}).keys())).cast("array<int>").alias("milestone_periods"),
            F.lit([float(v) for v in s.get("milestones", {}).values()]).cast("array<double>").alias("milestone_values"),
        )
        for s in scenarios
    ]
    return keyed.select("*", F.inline(F.array(*fields)))


def starts(series: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Last period and its value per key, as scenarios start from them."""
    return spans(series, keys, time, value).select(
        *keys, F.col("last_period").alias("start"), F.col("last_value").alias("current")
    )


def split_scenarios(
    series: DataFrame, scenarios: DataFrame | list[dict], keys: list[str], time: str, value: str
) -> tuple[DataFrame, DataFrame]:
    """Scenarios with start, current value and target, and the rejected ones with the reason.

    A list applies to every series and needs no join; a table names the scenarios of each key.
    """
    span = starts(series, keys, time, value)
    placed = scenario_list(span, scenarios) if isinstance(scenarios, list) else scenarios.join(span, keys, "left")
    placed = resolve_targets(placed)
    usable = F.col("target_period") > F.col("start")
    rejected = placed.filter(F.col("start").isNull() | ~usable).select(
        *keys,
        "scenario",
        F.when(F.col("start").isNull(), F.lit(NO_SERIES))
        .otherwise(said(TOO_EARLY, start=F.col("start")))
        .alias("reason"),
    )
    return placed.filter(usable), rejected


def milestone_pathway(
    series: DataFrame, placed: DataFrame, keys: list[str], time: str, value: str, degree: int = 3
) -> DataFrame:
    """Cubic through history, milestones and target, floored at zero, for the future periods.

    A milestone in the target period gives way to the target. Rows `(keys..., scenario, time, path)`.
    """
    point = "struct<t:int,v:double,fit:boolean>"
    pairs = F.arrays_zip(F.col("milestone_periods").alias("t"), F.col("milestone_values").alias("v"))
    stones = F.transform(
        F.filter(pairs, lambda p: p["t"] != F.col("target_period")),
        lambda p: F.struct(p["t"].alias("t"), p["v"].alias("v"), F.lit(True).alias("fit")),
    )
    target = F.array(
        F.struct(F.col("target_period").alias("t"), F.col("target").alias("v"), F.lit(True).alias("fit"))
    )
    wanted = F.transform(
        F.sequence(F.col("start") + 1, F.col("target_period")),
        lambda t: F.struct(t.alias("t"), F.lit(None).cast("double").alias("v"), F.lit(False).alias("fit")),
    )
    points = F.concat(
        stones.cast(f"array<{point}>"), target.cast(f"array<{point}>"), wanted.cast(f"array<{point}>")
    )
    added = placed.select(*keys, "scenario", F.inline(points))
    history = placed.select(*keys, "scenario").join(
        series.select(*keys, F.col(time).alias("t"), F.col(value).alias("v"), F.lit(True).alias("fit")), keys
    )
    fitted = polynomial_trend(
        history.unionByName(added), [*keys, "scenario"], "t", "v", degree, {"fit": "path"}
    )
    return fitted.filter(~F.col("fit")).select(
        *keys, "scenario", F.col("t").alias(time), at_least(F.col("path"), 0.0).alias("path")
    )


def run_scenarios(
    series: DataFrame,
    scenarios: DataFrame | list[dict],
    keys: list[str],
    time: str,
    value: str,
    degree: int = 2,
    policy_path: DataFrame | None = None,
    arima: str = "search",
) -> DataFrame:
    """Rows `(keys..., scenario, pathway, time, bau, commitment, gap, model, start, current, target, ...)`.

    The business-as-usual forecast is made once per series, up to its furthest target, and shared by
    all its scenarios. `scenarios` is a list as for `scenario_list`, or a table with its columns; `policy_path` has rows
    `(keys..., time, path)` for the policy-driven shape. Milestone scenarios without milestones and
    policy scenarios without a policy path follow the exponential shape.
    """
    placed, _ = split_scenarios(series, scenarios, keys, time, value)
    if isinstance(scenarios, list):
        until, bounded = max(s["target_period"] for s in scenarios), series
    else:
        until = "_until"
        bounded = series.join(placed.groupBy(*keys).agg(F.max("target_period").alias(until)), keys)
    bau = forecast_best(bounded, keys, time, value, degree=degree, arima=arima, until=until).select(
        *keys, time, F.col("forecast").alias("bau"), "model"
    )
    rows = bau.join(placed, keys).filter(F.col(time) <= F.col("target_period"))

    args = [F.col("start"), F.col("current"), F.col("target_period"), F.col("target"), F.col(time)]
    shape = F.when(F.col("pathway") == "linear", linear_pathway(*args)).when(
        F.col("pathway") == "scurve", scurve_pathway(*args)
    )
    own = placed.filter((F.col("pathway") == "milestones") & (F.size("milestone_periods") > 0))
    stones = milestone_pathway(series, own, keys, time, value)
    rows = rows.join(stones.withColumnRenamed("path", "_stones"), [*keys, "scenario", time], "left")
    shape = shape.when(F.col("_stones").isNotNull(), F.col("_stones"))
    if policy_path is not None:
        rows = rows.join(policy_path.select(*keys, time, F.col("path").alias("_policy")), [*keys, time], "left")
        shape = shape.when((F.col("pathway") == "policy_driven") & F.col("_policy").isNotNull(), F.col("_policy"))
    commitment = at_least(shape.otherwise(exponential_pathway(*args)), 0.0)
    return rows.select(
        *keys,
        "scenario",
        "pathway",
        time,
        "bau",
        commitment.alias("commitment"),
        (F.col("bau") - commitment).alias("gap"),
        "model",
        "start",
        "current",
        "target_period",
        "target",
    )


def scenario_summary(paths: DataFrame, keys: list[str]) -> DataFrame:
    """Total and mean yearly gap, and the reduction from the current value to the target in percent."""
    return paths.groupBy(*keys, "scenario", "pathway").agg(
        F.max("current").alias("current"),
        F.max("target").alias("target"),
        F.sum("gap").alias("total_gap"),
        F.try_divide(F.sum("gap"), F.count(F.lit(1))).alias("mean_yearly_gap"),
        (F.try_divide(F.max("current") - F.max("target"), F.max("current")) * 100.0).alias("reduction_pct"),
    )
