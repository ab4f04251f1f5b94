"""Profiles of a table: counts by value, ranges and the usual summary of a number column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeline.operators.ranks import counted_values, quantiles


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))


def column_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows `(column_name, n, low, high)` over the non-null values, from one pass over the table."""
    wanted = [
        f(F.col(f"`{c}`").cast("double")).alias(f"{k}_{i}")
        for i, c in enumerate(columns)
        for k, f in (("n", F.count), ("low", F.min), ("high", F.max))
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"n_{i}").alias("n"),
                F.col(f"low_{i}").alias("low"),
                F.col(f"high_{i}").alias("high"),
            )
            for i, c in enumerate(columns)
        ]
    )
    return df.agg(*wanted).select(F.inline(rows))


def describe(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, sample deviation, smallest, quartiles and largest value per key. All exact.

    Equal values are counted in one read of the table; everything follows from these counts. Nulls and NaN are not counted; a key without
    values has no row, and a table without keys and values one row of zero and nulls."""
    counted = counted_values(df, keys, value)
    x, n = F.col(value).cast("double"), F.col("n_rows")
    moments = counted.groupBy(*keys).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("n"), (F.sum(x * n) / F.sum(n)).alias("mean"), F.min(x).alias("low"), F.max(x).alias("high")
    )
    if keys:
        away = counted.join(moments.select(*keys, "mean", F.col("n").alias("_n")), keys)
    else:
        first = moments.first()
        away = counted.select("*", F.lit(first["mean"]).alias("mean"), F.lit(first["n"]).alias("_n"))
    spread = F.sum(n * (x - F.col("mean")) * (x - F.col("mean")))
    std = away.groupBy(*keys).agg(F.sqrt(F.try_divide(spread, F.max("_n") - 1)).alias("std"))
    cuts = quantiles(df, keys, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, counted)
    if keys:
        return moments.join(std, keys).join(cuts, keys).select(*keys, "n", "mean", "std", "low", "high", "q25", "q50", "q75")
    return moments.select("n", "mean", F.lit(std.first()[0]).alias("std"), "low", "high", *[
        F.lit(v).cast("double").alias(c) for c, v in zip(cuts.columns, cuts.first(), strict=True)
    ])


def source_counts(df: DataFrame) -> DataFrame:
    source = F.col("data_source")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(source == "experimental").alias("n_experimental"),
        F.count_if(source == "literature").alias("n_literature"),
        F.count_distinct("pathway").alias("n_pathways"),
        F.count_distinct("catalyst_family").alias("n_catalysts"),
    )
