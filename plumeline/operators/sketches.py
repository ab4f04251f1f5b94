"""Stored sketches: distinct counts and quantiles of tables that are too large to be read again.

A state row holds, per key and period, the number of values, a HyperLogLog sketch of the distinct values and a KLL sketch of the numbers. States are written period by
period; a late or corrected period replaces its own rows only. Any set of periods is answered by merging their states, without the table.

Bounds: the distinct count has a relative standard error of about 1.04 / sqrt(2^HLL_BITS) (1.6 % for 12 bits); a quantile's rank is off by at most about
2.3 / KLL_K^0.9 of the rows (0.7 % for 600) with a confidence of 99 %.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeline.sources.sinks import write_keyed

HLL_BITS = 12
KLL_K = 600
RANK_ERROR = 0.01
DISTINCT_ERROR = 0.07  # four standard errors


def states(df: DataFrame, keys: list[str], distinct: str, number: str) -> DataFrame:
    """Rows `(keys..., n, distinct_state, number_state)`. Nulls and NaN are no values. Each task sends one state per key."""
    x = F.col(f"`{number}`").cast("double")
    known = F.when(~F.isnan(x), x)
    return df.groupBy(*keys).agg(
        F.count(known).alias("n"),
        F.hll_sketch_agg(F.col(f"`{distinct}`").cast("string"), F.lit(HLL_BITS)).alias("distinct_state"),
        F.kll_sketch_agg_double(known, F.lit(KLL_K)).alias("number_state"),
    )


def store(states_of: DataFrame, path: str, period: str) -> None:
    """Writes the states of some periods; the stored states of other periods stay as they are."""
    write_keyed(states_of, path, [period])


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged(states_of: DataFrame, keys: list[str]) -> DataFrame:
    """The states of all periods of a key as one."""
    return states_of.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.hll_union_agg("distinct_state").alias("distinct_state"),
        F.kll_merge_agg_double("number_state").alias("number_state"),
    )


def estimates(states_of: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """Rows `(keys..., n, n_distinct, <name>...)`: the estimates of a state. A key without numbers has null quantiles."""
    cuts = [F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("number_state", F.lit(p))).alias(name) for name, p in shares.items()]
    return states_of.select(*keys, "n", F.hll_sketch_estimate("distinct_state").alias("n_distinct"), *cuts)


def held_against(table: DataFrame, estimated: DataFrame, keys: list[str], distinct: str, number: str, shares: dict[str, float]) -> DataFrame:
    """Rows `(keys..., n, n_distinct, distinct_ok, quantiles_ok)`: exact counts, and whether the estimates keep their bounds: for every quantile, the true share of the
    rows at most (and below) its estimate."""
    x = F.col(f"`{number}`").cast("double")
    rows = table.select(*keys, F.col(f"`{distinct}`").alias("_d"), F.when(~F.isnan(x), x).alias("_x"))
    joined = rows.join(estimated.select(*keys, F.col("n_distinct").alias("_estimate"), *shares), keys)
    sides = [f.alias(f"_{s}_{name}") for name in shares for s, f in (("most", F.count_if(F.col("_x") <= F.col(name))), ("below", F.count_if(F.col("_x") < F.col(name))))]
    counted = joined.groupBy(*keys).agg(F.count("_x").alias("n"), F.count_distinct("_d").alias("n_distinct"), F.first("_estimate").alias("_estimate"), *sides)
    good = [
        (F.col(f"_most_{name}") >= (p - RANK_ERROR) * F.col("n") - 1) & (F.col(f"_below_{name}") <= (p + RANK_ERROR) * F.col("n") + 1) for name, p in shares.items()
    ]
    right = F.lit(True)
    for g in good:
        right = right & g
    close = F.abs(F.col("_estimate") - F.col("n_distinct")) <= F.greatest(F.lit(1.0), F.col("n_distinct") * DISTINCT_ERROR)
    return counted.select(*keys, "n", "n_distinct", close.alias("distinct_ok"), F.coalesce(right, F.lit(True)).alias("quantiles_ok"))
