"""As-of joins: for every asked time the last known row at or before it and the first one after it, per key."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumeline.session import use_checkpoint_dir

TASK_ROWS = 500_000  # rows of both tables for a task, where the session's number of shuffle partitions would give it more


def asof_join(asked: DataFrame, knots: DataFrame, keys: list[str], time: str, values: list[str], before: str = "before", after: str = "after") -> DataFrame:
    """The rows of `asked` with two structs `(time, values...)`: the last row of `knots` with the same keys and no later time, and the first one with a later time; null where there is none.

    Both tables are laid together and range-sorted by key and time, so a key with any number of rows is cut into many ranges. Inside a range the last known row is carried
    along; a range begins with what the ranges before it ended with, which takes one small row per key and range. Of several knots at one time the
    one with the largest values counts as the last and the one with the smallest as the first. Rows of `asked` with a null key or time have no neighbours; such knots are left out."""
    spark = asked.sparkSession
    use_checkpoint_dir(spark)
    names = [f"_key{i}" for i in range(len(keys))]
    key = [F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)]
    known = knots.na.drop(subset=[*keys, time])
    own = F.struct(F.col(f"`{time}`").alias(time), *[F.col(f"`{v}`").alias(v) for v in values])
    row = F.struct(*[F.col(f"`{c}`") for c in asked.columns])
    at = asked.schema[time].dataType
    knot_rows = known.select(*key, F.col(f"`{time}`").cast(at).alias("_time"), F.lit(0).alias("_kind"), own.alias("_knot"))
    laid = knot_rows.unionByName(asked.select(*key, F.col(f"`{time}`").alias("_time"), F.lit(1).alias("_kind"), row.alias("_row")), allowMissingColumns=True)
    laid = laid.checkpoint()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(laid.count() / TASK_ROWS))
    # Many equal rows are told apart by their number, so that they too can be cut; the sorted rows are kept, as the bounds come from a sample.
    order = [*names, "_time", "_kind", "_knot", "_no"]
    sorted_rows = laid.withColumn("_no", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = sorted_rows.checkpoint().withColumn("_part", F.spark_partition_id())
    dealt = placed.repartition(parts, "_part", *names)  # as many tasks for the windows: a task's sorts hold a bounded share of any table

    inside = Window.partitionBy("_part", *names)
    forth = inside.orderBy("_time", "_kind", "_knot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back = inside.orderBy(F.desc("_time"), F.desc("_kind"), F.desc("_knot")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = dealt.withColumns({"_last": F.last("_knot", ignorenulls=True).over(forth), "_next": F.last("_knot", ignorenulls=True).over(back)})

    ends = placed.groupBy("_part", *names).agg(F.max("_knot").alias("_end"), F.min("_knot").alias("_begin"))
    whole = Window.partitionBy(*names)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    later = whole.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select(
        "_part", *names, F.last("_end", ignorenulls=True).over(earlier).alias("_from_before"), F.last("_begin", ignorenulls=True).over(later).alias("_from_after")
    )
    found = carried.where("_kind = 1").join(handed, ["_part", *names], "left")  # a null key finds nothing, as it should
    usable = F.col("_time").isNotNull()
    return found.select(
        "_row.*", F.when(usable, F.coalesce("_last", "_from_before")).alias(before), F.when(usable, F.coalesce("_next", "_from_after")).alias(after)
    )
