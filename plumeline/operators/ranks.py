"""Exact ranks, quantiles and contiguous folds without a single-task sort."""

from __future__ import annotations

from pyspark.ml.feature import QuantileDiscretizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from plumeline.session import use_checkpoint_dir


ROWS_PER_BUCKET = 2_000_000
WHOLE, SKETCH = 100_000, 0.001  # rows up to which all values are counted, and the rank error of the sketch that says where to count beyond


def counted_values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows `(keys..., value, n_rows)`: how often each value occurs, checkpointed, so the table is read once.

    Nulls and NaN are no values."""
    use_checkpoint_dir(df.sparkSession)
    x = F.col(value)
    known = x.isNotNull() & (~F.isnan(x) if df.schema[value].dataType.typeName() in ("double", "float") else F.lit(True))
    return df.filter(known).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_rows")).checkpoint()


def cumulative_counts(
    df: DataFrame, keys: list[str], value: str, rows_per_bucket: int | None = None, counted: DataFrame | None = None
) -> DataFrame:
    """Rows `(keys..., value, n_rows, before, total)`: per key and distinct value, the number of rows,
    of rows with a smaller value, and of all rows.

    Equal values are counted first. Then the distinct values are cut into ranges of about `rows_per_bucket` values (`ROWS_PER_BUCKET` by default) and counted up
    inside each range, so neither a frequent value nor a frequent key reaches one task whole. The range totals are
    small and joined back. `counted` takes the result of `counted_values` where that exists already.
    """
    counted = counted_values(df, keys, value) if counted is None else counted
    as_number = counted.withColumn("_x", F.col(value).cast("double"))
    n = counted.count()
    if n == 0:
        empty = counted.select(*keys, value, "n_rows")
        return empty.withColumn("before", F.lit(0).cast("long")).withColumn("total", F.lit(0).cast("long"))
    buckets = max(8, n // (rows_per_bucket or ROWS_PER_BUCKET))
    ranges = QuantileDiscretizer(
        inputCol="_x", outputCol="_range", numBuckets=buckets, relativeError=1.0 / (4 * buckets)
    ).fit(as_number)
    ranged = ranges.transform(as_number).drop("_x").withColumn("_range", F.col("_range").cast("int"))

    per_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    sizes = ranged.groupBy(*keys, "_range").agg(F.sum("n_rows").alias("_size"))
    earlier = per_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys,
        "_range",
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_size").over(per_key).alias("total"),
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.join(offsets, [*keys, "_range"])
        .withColumn("before", F.col("_offset") + F.coalesce(F.sum("n_rows").over(inside), F.lit(0)))
        .select(*keys, value, "n_rows", "before", "total")
    )


def numbered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds `number` (from 0 by `order` inside each key) to rows that are distinct in keys and order.

    The rows are range-sorted into partitions and counted in place; a key's rows in a partition go on where the partitions before it end. Only one
    small row per key and partition is shuffled beside the rows, so a key of any size is sorted by many tasks."""
    use_checkpoint_dir(df.sparkSession)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The range bounds come from a sample, so the sorted rows are kept: a second run could be cut elsewhere.
    placed = df.checkpoint().repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order).checkpoint()
    placed = placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    held = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_size"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = held.select(*keys, "_part", (F.coalesce(F.sum("_size").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.join(shift, [*keys, "_part"]).withColumn("number", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def quantiles(
    df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], counted: DataFrame | None = None
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per key and one column per probability. A column without values has
    no row, or without keys one row of nulls."""
    ranked = cumulative_counts(df, keys, value, counted=counted)
    x = F.col(value).cast("double")

    def at(position: Column) -> Column:
        holds = (F.col("before") <= position) & (position < F.col("before") + F.col("n_rows"))
        return F.max(F.when(holds, x))

    found, wanted = [], []
    for name, p in probabilities.items():
        position = (F.col("total") - 1) * F.lit(p)
        found += [at(F.floor(position)).alias(f"_{name}_low"), at(F.ceil(position)).alias(f"_{name}_high")]
        low, high = F.col(f"_{name}_low"), F.col(f"_{name}_high")
        part = (F.col("_total") - 1) * F.lit(p) - F.floor((F.col("_total") - 1) * F.lit(p))
        wanted.append((low + (high - low) * part).alias(name))
    return ranked.groupBy(*keys).agg(*found, F.max("total").alias("_total")).select(*keys, *wanted)


def _near(df: DataFrame, order: str, shares: list[float]) -> DataFrame | None:
    """The rows of `cumulative_counts` whose values lie about the given shares of the rows: sketched quantiles a little below and above bound them, rows below the bounds are only
    counted. None for a table that is counted whole as easily."""
    x = F.col(order).cast("double")  # keeps the order; values that it makes equal fall on the same side of a bound
    known = df.filter(x.isNotNull() & ~F.isnan(x)).select(order, x.alias("_near_x"))
    total = known.count()
    if total <= WHOLE or not shares:
        return None
    bounds = known.approxQuantile("_near_x", [p for s in shares for p in (max(0.0, s - 4 * SKETCH), min(1.0, s + 4 * SKETCH))], SKETCH)
    ranges: list[list[float]] = []
    for low, high in sorted(zip(bounds[::2], bounds[1::2], strict=True)):
        if ranges and low <= ranges[-1][1]:
            ranges[-1][1] = max(ranges[-1][1], high)
        else:
            ranges.append([low, high])
    below = known.agg(*[F.count(F.when(F.col("_near_x") < low, 1)).alias(str(i)) for i, (low, _) in enumerate(ranges)]).first()
    inside, offset = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, (low, high) in enumerate(ranges):
        inside = F.when(F.col("_near_x").between(low, high), i).otherwise(inside)
        offset = F.when(F.col("_near_range") == i, F.lit(below[i])).otherwise(offset)
    kept = known.withColumn("_near_range", inside).filter("_near_range IS NOT NULL")
    ranked = cumulative_counts(kept, ["_near_range"], order)
    return ranked.select(order, "n_rows", (F.col("before") + offset).alias("before"), F.lit(total).alias("total"))


def contiguous_folds(df: DataFrame, order: str, folds: int) -> DataFrame:
    """Adds `fold` 0..folds-1: consecutive rows by `order`, the first folds one row larger where the
    count does not divide; rows with equal `order` stay together.

    Only the values at the fold starts (folds - 1 of them) come to the driver; the rows themselves are
    not shuffled. Beyond `WHOLE` rows of numbers, only values near the starts are counted one by one.
    """
    near = _near(df, order, [i / folds for i in range(1, folds)]) if isinstance(df.schema[order].dataType, NumericType) else None
    first = cumulative_counts(df, [], order) if near is None else near
    size, extra = F.floor(F.col("total") / folds), F.col("total") % folds
    starts = F.array(*[F.lit(i) * size + F.least(F.lit(i), extra) for i in range(1, folds)])
    held = F.size(
        F.filter(starts, lambda s: (F.col("before") <= s) & (s < F.col("before") + F.col("n_rows")))
    )
    first = first.select(order, held.alias("held")).filter("held > 0")
    fold = F.lit(0)
    for row in first.collect():
        fold = fold + F.when(F.col(order) >= F.lit(row[0]), row["held"]).otherwise(0)
    return df.withColumn("fold", fold)


def holdout_split(df: DataFrame, keys: list[str], seed: int = 42, train_pct: int = 80) -> DataFrame:
    """Adds `is_train` from the MD5 of the row's key, so a row keeps its side whatever the partitioning and the engine."""
    named = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    draw = F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("long") % 100
    return df.withColumn("is_train", draw < train_pct)
