"""Mixing sources to target weights with a time-varying curriculum.

Every source has a share of the words that training takes (water-filling below twice its own size) and a schedule, its weight over training time, given
by points joined by straight lines. The schedule's integral, scaled to the source's target, is its cumulative demand. The documents of a source
stand in a fixed random order, over and over; the word at which a document begins is looked up in the demand turned
round, and that gives the time at which training takes the document. Rows are then sorted by this time.

No source is gathered anywhere: a source's documents are cut by their hash into buckets of bounded size, the buckets are summed, and running sums
are taken inside a bucket only.

Results: a null text has no words; a document without words is taken with 0 words, and has no position. A null source is a source of its own, after all others. Repeated
rows are documents of their own; rows that tie in all that orders them have equal results in some order. An empty table gives an empty result.
Other columns are carried along; `assigned` replaces those that have the names of its results.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeline.llm.graph import kept

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST_REPEATS = 1.5, 2.0
BUCKET_ROWS = 20_000
SEED = "mix-1"
# The schedule of each weight class: (time, weight) from 0 to 1. Broad sources come early, rare ones late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))


def word_count(text: Column) -> Column:
    """Number of maximal runs of other than ASCII white space."""
    parts = F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+")
    ends = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (F.size(parts) - ends).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """Adds `rank` (from 0, by code point, null last), `weight` and `target` to rows `(mx_source, source_size)`.

    Shares are weights of `share` times all words; a source whose share is above `most` times its size stops there, and the rest is shared again by
    weight until none is above. Each round is one sum; the driver holds a number. Ranks are counted inside ranges of sources."""
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("mx_source").isNull(), F.col("mx_source")]
    ranged = kept(sizes.repartitionByRange(parts, *order).withColumn("_mx_part", F.spark_partition_id()))
    before = Window.orderBy("_mx_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_mx_part").agg(F.count("*").alias("_mx_n"))
    starts = starts.select("_mx_part", F.coalesce(F.sum("_mx_n").over(before), F.lit(0)).alias("_mx_start"))
    inside = F.row_number().over(Window.partitionBy("_mx_part").orderBy(*order)) - 1
    ranked = ranged.join(starts, "_mx_part").withColumn("rank", inside + F.col("_mx_start")).drop("_mx_part", "_mx_start")
    by_class = F.array(*map(F.lit, weights))
    ranked = kept(ranked.withColumn("weight", F.get(by_class, (F.col("rank") % len(weights)).cast("int"))))

    limit, level, capped = F.col("source_size") * most, 0.0, -1
    while True:
        over = F.col("weight") * level > limit
        s = ranked.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(over, limit)).alias("full"),
            F.sum(F.when(~over, F.col("weight"))).alias("open"), F.count(F.when(over, 1)).alias("n"),
        ).first()
        if s["n"] == capped or not s["all"] or not s["open"]:
            break
        capped = s["n"]
        level = (share * s["all"] - (s["full"] or 0.0)) / s["open"]
    return ranked.withColumn("target", F.when(F.col("weight") * level > limit, limit).otherwise(F.col("weight") * level))


def time_of(fraction: Column, schedule: tuple) -> Column:
    """When a source whose weight follows `schedule` has met `fraction` of its demand."""
    areas = [(a + b) / 2 * (t2 - t1) for (t1, a), (t2, b) in zip(schedule[:-1], schedule[1:], strict=True)]
    total, below, out = sum(areas), 0.0, None
    for ((t1, a), (t2, b)), area in zip(zip(schedule[:-1], schedule[1:], strict=True), areas, strict=True):
        rest = fraction * total - below
        root = F.sqrt(F.greatest(F.lit(a * a) + 2 * rest * ((b - a) / (t2 - t1)), F.lit(0.0)))
        at = F.lit(t1) + F.when(rest > 0, 2 * rest / (F.lit(a) + root)).otherwise(0.0)
        below += area
        out = [(fraction * total < below, at), *(out or [])]
    cases = F.when(*out[-1])
    for condition, at in reversed(out[:-1]):
        cases = cases.when(condition, at)
    return cases.otherwise(F.lit(schedule[-1][0]))


def assigned(
    docs: DataFrame, text: str = "text", doc: str = "doc_id", source: str = "source",
    weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS, schedules: tuple = SCHEDULES, seed: str = SEED,
) -> DataFrame:
    """Every row of `docs` with `size`, `source_size`, `target`, `taken`, and `_mx_copies`: an array of (words, position), one entry
    for each time that the mix takes the document; the last one of a source may take only its first words."""
    docs = docs.drop(*{"size", "source_size", "target", "taken", "mx_source"} - {text, doc, source})
    named = F.concat(F.lit("s"), F.col(source).cast("string"))  # a null source has a name as well
    mark = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(doc).cast("string"), F.lit(""))))
    rows = docs.withColumn("size", word_count(F.col(text))).withColumn("_mx_name", F.coalesce(named, F.lit("n"))).withColumn("_mx_mark", mark)
    n = docs.count()
    buckets = max(1, ceil(n / BUCKET_ROWS))
    place = F.floor(F.conv(F.substring("_mx_mark", 1, 8), 16, 10).cast("long") * buckets / F.lit(2**32)).cast("long")
    rows = rows.withColumn("_mx_bucket", place)
    sums = kept(
        rows.groupBy("_mx_name", "_mx_bucket").agg(F.sum("size").alias("_mx_sum"), F.first(F.col(source).cast("string")).alias("mx_source"))
    )
    sizes = sums.groupBy("_mx_name").agg(F.sum("_mx_sum").alias("source_size"), F.first("mx_source").alias("mx_source"))
    aims = targets(sizes, weights, share, most).select("_mx_name", "source_size", "target", (F.col("rank") % len(weights)).alias("_mx_class"))
    earlier = Window.partitionBy("_mx_name").orderBy("_mx_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_mx_name", "_mx_bucket", F.coalesce(F.sum("_mx_sum").over(earlier), F.lit(0)).alias("_mx_offset"))
    offsets = offsets.join(aims, "_mx_name")
    inside = Window.partitionBy("_mx_name", "_mx_bucket").orderBy("_mx_mark", F.col(doc), "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(offsets, ["_mx_name", "_mx_bucket"]).withColumn("_mx_begin", F.col("_mx_offset") + F.sum("size").over(inside) - F.col("size"))

    limit = F.floor(F.col("target") + 0.5).cast("long")
    copies = []
    for k in range(ceil(most)):
        begin = F.col("_mx_begin") + k * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), limit - begin)).cast("long")
        position = F.lit(None).cast("double")
        for c, schedule in enumerate(schedules):
            position = F.when(F.col("_mx_class") == c, time_of(begin / limit, schedule)).otherwise(position)
        copies.append(F.struct(words.alias("words"), F.when(words > 0, position).alias("position")))
    rows = rows.withColumn("_mx_copies", F.filter(F.array(*copies), lambda c: c["words"] > 0))
    taken = F.aggregate("_mx_copies", F.lit(0).cast("long"), lambda s, c: s + c["words"])
    return rows.withColumn("taken", taken).drop("_mx_name", "_mx_mark", "_mx_bucket", "_mx_offset", "_mx_begin", "_mx_class")


def sorted_by_position(rows: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The rows of `assigned` range-sorted by the first position at which training takes them; rows that it does not take come last."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_last("_mx_at"), F.col(f"`{doc}`")]
    placed = rows.withColumn("_mx_at", F.get("_mx_copies", 0)["position"])
    return placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_mx_at")


def mixed(docs: DataFrame, text: str = "text", doc: str = "doc_id", source: str = "source") -> DataFrame:
    """The training order: each row of `docs` as often as the mix takes it, by position. A copy that is taken in part has its first words, and the white space
    between them. A column `n_chars` is the text's new length."""
    names = docs.columns
    spare = docs.withColumnsRenamed({c: f"_in_{c}" for c in names})
    rows = assigned(spare, f"_in_{text}", f"_in_{doc}", f"_in_{source}").withColumn("_mx_copy", F.explode("_mx_copies"))
    whole = F.col(f"_in_{text}")
    begun = F.regexp_extract(whole, r"^[\x20\x09-\x0D]*", 0)
    parts = F.split(F.substr(whole, F.length(begun) + 1), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.concat(begun, F.array_join(F.slice(parts, F.lit(1), F.col("_mx_copy.words").cast("int")), ""))
    rows = rows.withColumn(f"_in_{text}", F.when(F.col("_mx_copy.words") < F.col("size"), cut).otherwise(whole))
    if "n_chars" in names:
        rows = rows.withColumn("_in_n_chars", F.length(f"_in_{text}").cast(docs.schema["n_chars"].dataType))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.withColumn("_mx_at", F.col("_mx_copy.position")).repartitionByRange(parts, "_mx_at", f"_in_{doc}")
    return sorted_rows.sortWithinPartitions("_mx_at", f"_in_{doc}").select(*[F.col(f"_in_{c}").alias(c) for c in names])
