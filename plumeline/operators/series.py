"""Series preparation: one row per key and period, spans, filters and the hold-out frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prepare(df: DataFrame, keys: list[str], time: str, value: str, drop_any: bool = True) -> DataFrame:
    """One row per (keys, time). Rows with a null are dropped first: in any column, or only in the
    needed ones with `drop_any=False`. Repeated periods are summed and counted in `row_count`.

    The sum is combined on the map side, so a key that owns most of the raw rows still sends at most
    one row per period and task through the shuffle.
    """
    kept = df.na.drop("any") if drop_any else df.na.drop("any", subset=[*keys, time, value])
    return kept.groupBy(*keys, F.col(time).cast("int").alias(time)).agg(
        F.sum(value).alias(value), F.count(F.lit(1)).alias("row_count")
    )


def filter_periods(df: DataFrame, time: str, start: int, end: int) -> DataFrame:
    return df.filter(F.col(time).between(start, end))


def filter_keys(df: DataFrame, key: str, wanted: list, time: str, value: str) -> DataFrame:
    """The rows of some keys, nulls dropped, projected to the series columns."""
    return df.filter(F.col(key).isin(wanted)).select(key, time, value).na.drop("any")


def regions(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct()


def spans(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """First and last period, number of periods and the value of the last period, per key."""
    return df.groupBy(*keys).agg(
        F.min(time).alias("first_period"),
        F.max(time).alias("last_period"),
        F.count(F.lit(1)).alias("n_periods"),
        F.max_by(value, time).alias("last_value"),
    )


def holdout_frame(series: DataFrame, keys: list[str], time: str, n_test: int | None = None) -> DataFrame:
    """Adds position, length, last period and the train/test marks used by the backtest.

    The test rows are the last `n_test` ones, or the last sixth of a series, at least three and at most eight. `_train` and
    `_test` are false everywhere for a series shorter than the test size plus five.
    """
    per_key = "PARTITION BY " + ", ".join(f"`{k}`" for k in keys)
    return (
        series.selectExpr(
            "*",
            f"row_number() OVER ({per_key} ORDER BY `{time}`) AS _pos",
            f"CAST(count(1) OVER ({per_key}) AS INT) AS _n",
            f"max(`{time}`) OVER ({per_key}) AS _last",
        )
        .selectExpr("*", f"CAST({'least(8, greatest(3, _n DIV 6))' if n_test is None else int(n_test)} AS INT) AS _n_test")
        .selectExpr(
            "*",
            "_n >= _n_test + 5 AND _pos <= _n - _n_test AS _train",
            "_n >= _n_test + 5 AND _pos > _n - _n_test AS _test",
        )
    )


def extend_future(frame: DataFrame, time: str, value: str, horizon: Column) -> DataFrame:
    """Adds the future periods last+1 .. last+horizon behind each series' last row.

    The last row of a series is exploded into itself plus its future, so the rows stay where the key
    already is and no shuffle is needed. Future rows have `_future` true and a null value.
    """
    own = F.struct(F.col(time).alias("t"), F.col(value).alias("v"), F.col("_pos").alias("p"), F.lit(False).alias("f"))
    steps = F.when(
        (F.col(time) == F.col("_last")) & (horizon > 0), F.sequence(F.lit(1), horizon.cast("int"))
    ).otherwise(F.array().cast("array<int>"))
    ahead = F.transform(
        steps,
        lambda h: F.struct(
            (F.col("_last") + h).alias("t"),
            F.lit(None).cast("double").alias("v"),
            (F.col("_n") + h).alias("p"),
            F.lit(True).alias("f"),
        ),
    )
    passed = [c for c in frame.columns if c not in (time, value, "_pos")]
    exploded = frame.withColumn("_row", F.explode(F.concat(F.array(own), ahead)))
    future = F.col("_row.f")
    return exploded.select(
        *[c for c in passed if c not in ("_train", "_test")],
        F.col("_row.t").alias(time),
        F.col("_row.v").alias(value),
        F.col("_row.p").alias("_pos"),
        future.alias("_future"),
        (F.col("_train") & ~future).alias("_train"),
        (F.col("_test") & ~future).alias("_test"),
    )
