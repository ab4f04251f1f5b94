"""Writers. Every sink takes a DataFrame and a folder; CSV turns nested columns into JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat_for_csv(df: DataFrame) -> DataFrame:
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[
            F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    out = flat_for_csv(df) if fmt == "csv" else df
    writer = out.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)


def write_keyed(df: DataFrame, path: str, partition_by: list[str], fmt: str = "parquet") -> None:
    """Writes the partitions that `df` has and leaves all others alone, so a key can be written again, and a job that is run twice gives the same table.

    Rows of a partition are brought together first, one file per partition and task instead of one per partition and every task; a partition of many rows is
    cut by the adaptive rebalancing."""
    out = flat_for_csv(df) if fmt == "csv" else df
    writer = out.hint("rebalance", *partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(path)


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int, path: str | None = None) -> None:
    """A table whose rows lie in buckets of the keys, sorted: two tables with the same keys and number of buckets join, and one of them aggregates by the keys, without a shuffle."""
    first, *rest = keys
    writer = df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, first, *rest).sortBy(first, *rest).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def write_forecast(
    forecast: DataFrame, path: str, value: str = "forecast", fmt: str = "csv", partition_by: list[str] | None = None, replace_keys: bool = False
) -> None:
    """Forecast rows to three decimals. With `replace_keys` only the partitions that the rows belong to are replaced."""
    rounded = forecast.withColumn("forecast_gtco2", F.round(value, 3)).drop("poly_mape", "arima_mape")
    _write(rounded if value == "forecast_gtco2" else rounded.drop(value), path, fmt, partition_by, replace_keys)


def _write(df: DataFrame, path: str, fmt: str, partition_by: list[str] | None, replace_keys: bool) -> None:
    if replace_keys:
        if not partition_by:
            raise ValueError("name the columns to partition by")
        write_keyed(df, path, partition_by, fmt)
    else:
        write_table(df, path, fmt, partition_by)


def write_scenarios(
    paths: DataFrame, keys: list[str], time: str, path: str, fmt: str = "csv", partition_by: list[str] | None = None, replace_keys: bool = False
) -> None:
    """Scenario rows with the three series to three decimals. With `replace_keys` only the partitions that the rows belong to are replaced."""
    out = paths.select(
        *keys,
        "scenario",
        time,
        F.round("bau", 3).alias("bau_forecast_gtco2"),
        F.round("commitment", 3).alias("commitment_forecast_gtco2"),
        F.round("gap", 3).alias("emissions_gap_gtco2"),
    )
    _write(out, path, fmt, partition_by, replace_keys)


def write_training_table(table: DataFrame, path: str, fmt: str = "csv") -> None:
    """The training table, one folder per pathway."""
    write_table(table, path, fmt, ["pathway"] if fmt != "csv" else None)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One row per target."""
    write_table(metrics, path, "csv")
