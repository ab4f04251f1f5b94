"""Merkle manifest of a dataset: one hash tree per group of documents, and a tree over the groups.

Every node carries the interval of leaf ranks that it covers. Ranks come from a range sort with carried offsets; the nodes of a level come from one grouping
by the bucket of their first rank, so the whole tree costs little more than its lowest level. Ancestors are attached by containment joins that are bucketed by level: a node at level k that
covers rank r has the bucket `r div FAN^k`, so a join on (group, level, bucket) finds the interval that contains another. What an ancestor's children cover beside the child that
contains a node are the node's siblings there: the interval difference within a parent. Joins span `STEP` levels at a time and go down from the root, so an ancestor never meets more than
`FAN ** STEP` nodes, whatever the size of a group, and what lies above is handed down.

A hash is the lowercase hex SHA-256 of its inputs, concatenated. A leaf hashes its columns, `-` for null, else the number of UTF-8 bytes, `:` and the value. While
a group has several nodes, every `FAN` consecutive ones (the last run may be shorter, even one) become their hash. The last is the group's subroot; the subroots, in the
order of the groups, nulls first, likewise give the root. A proof lists the siblings, level by level, left to right.

Results: nulls in any column have their own mark and differ from empty texts. Documents without group value are a group. Rows without id come first in
their group; rows of equal id are ordered by their leaf, so the order never depends on the layout of the table, and repeated rows are leaves of their own. A group of one document has its leaf as subroot, and a table of one group its subroot as root; a proof without
siblings hashes the empty text. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeline.llm.graph import kept

FAN = 8
STEP = 2
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_SIDE = "struct<before:string,after:string>"


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def framed(value: Column) -> Column:
    """A value with its length before it, so that neighbouring values can't run into one another."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(columns: dict[str, Column]) -> Column:
    return hashed(*[framed(c) for c in columns.values()])


def lowered(text: Column) -> Column:
    """The text with A-Z in lower case and all other signs as they are."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """`rows` with `rank` (from 0 in its group by `order`) and `n`, the group's number of rows.

    A range sort cuts the rows where they stand, however large a group is; equal rows are spread by their number. A group's part in a range starts where the ranges before it
    end, which takes one small row per range and group."""
    numbered = kept(rows).withColumn("_no", F.monotonically_increasing_id())
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = kept(numbered.repartitionByRange(parts, group, *order, "_no").sortWithinPartitions(group, *order, "_no").drop("_no"))
    placed = placed.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    held = placed.groupBy(group, "_range").agg(F.count("*").alias("_size"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(group)
    earlier = F.coalesce(F.sum("_size").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = held.select(group, "_range", (earlier - F.col("_first")).alias("_shift"), F.sum("_size").over(whole).alias("n"))
    return placed.join(shift, [group, "_range"]).withColumn("rank", F.col("_at") + F.col("_shift")).drop("_range", "_at", "_shift")


def _width(level: int | Column) -> Column:
    """How many leaves a node of a level covers, but for the last one."""
    return F.pow(F.lit(float(FAN)), level if isinstance(level, Column) else F.lit(level)).cast("long")


def _bucket(rank: str, level: int | Column) -> Column:
    return F.floor(F.col(rank) / _width(level)).cast("long") if not isinstance(level, int) else F.expr(f"{rank} div {FAN**level}L")


def levels(leaves: DataFrame) -> list[DataFrame]:
    """The inner nodes of all trees over `leaves(tree, rank, n, digest)`, level by level from 1.

    Rows `(tree, n, low, high, digest, children)`: a node covers the ranks from `low` up to `high`; `children` are its children's digests in order. A level is an eighth of the one
    below, and is kept in the checkpoint folder."""
    out: list[DataFrame] = []
    below = leaves.select("tree", "n", F.col("rank").alias("low"), "digest")
    most = leaves.agg(F.max("n")).first()[0] or 0
    level = 1
    while FAN ** (level - 1) < most:
        runs = below.where(F.col("n") > FAN ** (level - 1)).groupBy("tree", _bucket("low", level).alias("_bucket"))
        nodes = runs.agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("low", "digest"))).alias("_run"))
        nodes = nodes.withColumn("children", F.array_join("_run.digest", "")).withColumn("low", F.col("_bucket") * FAN**level)
        nodes = nodes.withColumn("high", F.least(F.col("low") + FAN**level, F.col("n"))).withColumn("digest", hashed(F.col("children")))
        out.append(kept(nodes.select("tree", "n", "low", "high", "digest", "children")))
        below = out[-1].select("tree", "n", "low", "digest")
        level += 1
    return out


def heads(leaves: DataFrame, inner: list[DataFrame]) -> DataFrame:
    """The topmost node of every tree: `(tree, n, level, digest)`."""
    tops = [leaves.where("n = 1").select("tree", "n", F.lit(0).alias("level"), "digest")]
    for level, nodes in enumerate(inner, 1):
        tops.append(nodes.where(F.col("n") <= FAN**level).select("tree", "n", F.lit(level).alias("level"), "digest"))
    return reduce(DataFrame.union, tops)


def _sides(children: str, low: str, child_width: Column, rank: str) -> Column:
    """The digests of a parent's children before and after the one that contains a rank: the parent's interval without that child's."""
    at = F.floor((F.col(rank) - F.col(low)) / child_width).cast("int")
    digests = F.col(children)
    before = F.substring(digests, F.lit(1), at * 64)
    after = F.substring(digests, at * 64 + 65, F.length(digests))
    return F.struct(before.alias("before"), after.alias("after"))


def with_proofs(leaves: DataFrame, inner: list[DataFrame], above: DataFrame) -> DataFrame:
    """`leaves` with `proof`, the siblings `(before, after)` level by level up to the root, and `top`. `above(tree, level, proof, top)` has what
    follows above the topmost node of each tree, and that node's digest."""
    top, joined = len(inner), None
    for base in reversed(range(1, top + 1, STEP)):
        nodes = inner[base - 1]
        upper = [
            nodes_above.select("tree", F.lit(level).alias("_level"), _bucket("low", level).alias("_bucket"), F.col("low").alias("_low"), F.col("high").alias("_high"), "children")
            for level, nodes_above in enumerate(inner[base : base + STEP], base + 1)
        ]
        own = nodes.select("tree", "n", "low", "high")
        if upper:
            last = base + len(upper)
            asked = own.withColumn("_level", F.explode(F.sequence(F.lit(base + 1), F.lit(last)))).where(F.col("n") > _width(F.col("_level") - 1))
            asked = asked.withColumn("_bucket", _bucket("low", F.col("_level")))
            found = asked.join(reduce(DataFrame.union, upper), ["tree", "_level", "_bucket"]).where("_low <= low and high <= _high")
            side = F.struct(F.col("_level"), _sides("children", "_low", _width(F.col("_level") - 1), "low").alias("side"))
            found = found.groupBy("tree", "low").agg(F.array_sort(F.collect_list(side)).getField("side").alias("_found"))
            own = own.join(found, ["tree", "low"], "left")
        else:
            own = own.withColumn("_found", F.lit(None).cast(f"array<{_SIDE}>"))
        # What is above these levels comes from the next nodes that have it already, or from the tree's top where it lies between.
        known = above.where(F.col("level").between(base, base + STEP - 1)).select("tree", F.lit(0).cast("long").alias("_over"), F.col("proof").alias("_above"), "top")
        if joined is not None:
            known = known.union(joined.select("tree", _bucket("low", base + STEP).alias("_over"), F.col("proof").alias("_above"), "top"))
        own = own.withColumn("_over", _bucket("low", base + STEP)).join(known, ["tree", "_over"])
        proof = F.concat(F.coalesce("_found", F.array().cast(f"array<{_SIDE}>")), "_above")
        joined = kept(own.select("tree", "low", proof.alias("proof"), "top"))
    lone = above.where("level = 0").select("tree", F.lit(0).cast("long").alias("_bucket"), F.lit(None).cast("string").alias("children"), "proof", "top")
    parents = lone
    if joined is not None:
        parents = inner[0].select("tree", "low", "children").join(joined, ["tree", "low"]).select("tree", _bucket("low", 1).alias("_bucket"), "children", "proof", "top").union(lone)
    own = leaves.withColumn("_bucket", _bucket("rank", 1)).join(parents, ["tree", "_bucket"]).withColumn("_low", F.col("_bucket") * FAN)
    first = F.when(F.col("children").isNotNull(), F.array(_sides("children", "_low", F.lit(1), "rank"))).otherwise(F.array().cast(f"array<{_SIDE}>"))
    return own.withColumn("proof", F.concat(first, "proof")).drop("_bucket", "_low", "children")


def folded(start: Column, proof: str) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(proof, start, lambda digest, side: hashed(side["before"], digest, side["after"]))


def listed(proof: str) -> Column:
    """All siblings' digests, concatenated."""
    return F.array_join(F.flatten(F.transform(proof, lambda s: F.array(s["before"], s["after"]))), "")


def tampered_every_third(doc: str, text: str) -> tuple[Column, Column]:
    """The standard trial of a manifest: which rows are tampered with, by the CRC-32 of the id's decimal digits, and how."""
    return F.coalesce(F.crc32(F.col(doc).cast("string").cast("binary")) % 3 == 0, F.lit(False)), lowered(F.col(text))


def manifest(
    docs: DataFrame, columns: tuple[str, ...] = COLUMNS, doc: str = "doc_id", group: str = "lang", text: str = "text",
    tamper: Callable[[str, str], tuple[Column, Column]] | None = None,
) -> DataFrame:
    """One row per document: `doc`, `leaf`, `subroot`, `root`, `proof`, and `told`, the leaf as it is delivered: `tamper(doc, text)` gives which rows are
    changed on the way and the changed text; without it the leaf itself."""
    own = {c: F.col(c) for c in columns}
    leaf = leaf_hash(own)
    told = F.lit(None).cast("string")
    if tamper:
        chosen, changed = tamper(doc, text)
        told = F.when(chosen, leaf_hash(own | {text: changed}))
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))  # "-" sorts before "=": null first
    rows = docs.select(F.col(doc).cast("long").alias("doc"), tree.alias("tree"), leaf.alias("digest"), told.alias("told"))
    leaves = kept(ranked(rows, "tree", "doc", "digest"))
    inner = levels(leaves)
    subroots = kept(heads(leaves, inner))
    over = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "level", "digest")
    over = kept(ranked(over, "tree", "group"))
    over_inner = levels(over)
    root = heads(over, over_inner).select("digest").first()
    start = heads(over, over_inner).select("tree", "level", F.array().cast(f"array<{_SIDE}>").alias("proof"), F.col("digest").alias("top"))
    above = kept(with_proofs(over, over_inner, start).select(F.col("group").alias("tree"), "level", "proof", F.col("digest").alias("top")))
    return with_proofs(leaves, inner, above).select(
        "doc", F.col("digest").alias("leaf"), F.coalesce("told", "digest").alias("told"), F.col("top").alias("subroot"),
        F.lit(root[0] if root else None).cast("string").alias("root"), "proof",
    )
