"""Backtest of the trend against ARIMA and the forecast with the better of the two, per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeline.operators.arima import arima_prediction, closed_form_arima, parameter_columns, search_arima
from plumeline.operators.series import extend_future, holdout_frame
from plumeline.operators.trend import polynomial_trend

# Smallest denominator of the percentage error: the machine epsilon of a double.
EPSILON = 2.220446049250313e-16


def percentage_error(actual: Column, predicted: Column) -> Column:
    return F.abs(actual - predicted) / F.greatest(F.abs(actual), F.lit(EPSILON))


def poly_forecast(series: DataFrame, keys: list[str], time: str, value: str, horizon: int, degree: int = 2) -> DataFrame:
    """Rows `(keys..., time, forecast, effective_degree)` of the trend fitted on all periods."""
    frame = extend_future(holdout_frame(series, keys, time), time, value, F.lit(horizon))
    frame = frame.withColumn("_all", ~F.col("_future"))
    fitted = polynomial_trend(frame, keys, time, value, degree, {"_all": "forecast"})
    return fitted.filter("_future").select(*keys, time, "forecast", F.col("forecast_degree").alias("effective_degree"))


def scored_frame(
    series: DataFrame,
    keys: list[str],
    time: str,
    value: str,
    horizon: int | str = 0,
    degree: int = 2,
    arima: str = "search",
    until: int | str | None = None,
    n_test: int | None = None,
) -> DataFrame:
    """History and future rows with both forecasts and both hold-out errors.

    The training fit and the full fit run side by side over the same windows, so a series is shuffled
    and sorted once whatever the degree. The future reaches `horizon` periods past the last one, or up
    to the period `until`; both take a number or the name of a per-series column.
    """
    end = horizon if until is None else until
    ahead = F.col(end) if isinstance(end, str) else F.lit(end)
    frame = holdout_frame(series, keys, time, n_test).withColumn("_all", F.lit(True))
    if until is not None:
        ahead = ahead - F.col("_last")
    frame = frame.withColumn("_ahead", F.greatest(ahead, F.lit(0)).cast("int"))
    ahead = F.col("_ahead")
    if arima == "closed_form":
        frame = closed_form_arima(frame, keys, time, value, {"_train": "_at", "_all": "_aa"})
        frame = extend_future(frame, time, value, ahead)
        predicted = F.when(F.col("_future"), arima_prediction("_aa", "(_pos - _n)")).when(
            F.col("_test"), arima_prediction("_at", "(_pos - (_n - _n_test))")
        )
        frame = frame.withColumn("arima_pred", predicted).withColumn("arima_order", F.col("_aa_model"))
        frame = frame.drop(*parameter_columns("_at"), *parameter_columns("_aa"))
    elif arima == "search":
        searched = search_arima(frame, keys, time, value, "_ahead")
        frame = extend_future(frame, time, value, ahead).join(searched, [*keys, "_pos"], "left")
    else:
        raise ValueError(f"unknown arima method: {arima}")

    frame = frame.withColumn("_all", ~F.col("_future"))
    fitted = polynomial_trend(frame, keys, time, value, degree, {"_train": "_poly_test", "_all": "_poly_full"})
    per_key = Window.partitionBy(*keys)
    y = F.col(value)
    return fitted.withColumn("poly_pred", F.when(F.col("_future"), F.col("_poly_full"))).withColumns(
        {
            "poly_mape": F.avg(F.when(F.col("_test"), percentage_error(y, F.col("_poly_test")))).over(per_key),
            "arima_mape": F.avg(F.when(F.col("_test"), percentage_error(y, F.col("arima_pred")))).over(per_key),
        }
    )


def backtest(
    series: DataFrame, keys: list[str], time: str, value: str, degree: int = 2, arima: str = "search", n_test: int | None = None
) -> DataFrame:
    """One row per series: length, hold-out size and both errors (null when the series is too short).

    `n_test` is the number of held-out periods; without it, it follows from the length."""
    frame = scored_frame(series, keys, time, value, 0, degree, arima, n_test=n_test)
    return frame.filter(F.col(time) == F.col("_last")).select(
        *keys,
        F.col("_n").alias("n_periods"),
        F.col("_n_test").alias("n_test"),
        "poly_mape",
        "arima_mape",
    )


def chosen_model(degree: int) -> Column:
    """ARIMA when its error is no larger, or when either error is missing."""
    trend_wins = F.col("poly_mape") < F.col("arima_mape")
    return F.when(trend_wins, F.lit(f"Poly(deg={degree})")).otherwise(F.lit("ARIMA"))


def forecast_best(
    series: DataFrame,
    keys: list[str],
    time: str,
    value: str,
    horizon: int | str = 20,
    degree: int = 2,
    arima: str = "search",
    until: int | str | None = None,
) -> DataFrame:
    """Rows `(keys..., time, forecast, model, poly_mape, arima_mape)` for the future of every series."""
    frame = scored_frame(series, keys, time, value, horizon, degree, arima, until).filter("_future")
    model = chosen_model(degree)
    return frame.select(
        *keys,
        time,
        F.when(model == "ARIMA", F.col("arima_pred")).otherwise(F.col("poly_pred")).alias("forecast"),
        model.alias("model"),
        "poly_mape",
        "arima_mape",
    )
