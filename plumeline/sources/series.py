"""Readers for emission series. Any number of files and any number of keys in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Cell texts that mean "missing" in the input files.
MISSING = ["", "NA", "N/A", "NaN", "nan", "null", "NULL", "None"]


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    absent = [name for name in names if name not in df.columns]
    if absent:
        raise ValueError(f"missing required columns: {', '.join(absent)}")
    return df


def cell(name: str, dtype: str) -> Column:
    """A CSV text cell as a typed value; the usual missing-value texts become null."""
    text = F.trim(F.col(f"`{name}`"))
    return F.when(~text.isin(MISSING), text).cast(dtype)


def read_csv_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A CSV file, a folder of files or a list of them, every column as text named by the header."""
    return spark.read.option("header", True).option("escape", '"').option("mode", "FAILFAST").csv(path)


def read_series(
    spark: SparkSession,
    path: str | list[str],
    keys: list[str] | None = None,
    time: str = "year",
    value: str = "emissions_gtco2",
) -> DataFrame:
    """Series rows `(keys..., time, value, other columns as text)`. Only time and value are required to exist."""
    keys = keys or []
    raw = require_columns(read_csv_text(spark, path), [*keys, time, value])
    other = [name for name in raw.columns if name not in (*keys, time, value)]
    return raw.select(
        *keys,
        cell(time, "int").alias(time),
        cell(value, "double").alias(value),
        *[cell(name, "string").alias(name) for name in other],
    )


def read_regional_series(
    spark: SparkSession, path: str | list[str], key: str = "country", time: str = "year", mega: str = "co2"
) -> DataFrame:
    """Rows `(key, time, emissions_gtco2)` from a wide regional file that reports million tonnes."""
    raw = require_columns(read_csv_text(spark, path), [key, time, mega])
    return raw.select(key, cell(time, "int").alias(time), (cell(mega, "double") / 1000.0).alias("emissions_gtco2")).na.drop(
        subset=["emissions_gtco2"]
    )
