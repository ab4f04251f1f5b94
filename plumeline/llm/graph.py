"""Connected components of links, and how rows are brought together in groups of bounded size."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeline.session import use_checkpoint_dir


def kept(df: DataFrame) -> DataFrame:
    """`df` computed once and written to the shared checkpoint folder: lineage ends here, and a lost executor costs nothing."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def freed(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished steps. They go when the driver collects its garbage; in a long chain of steps that may come too late, and the
    disks would hold all of them at once."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(links: DataFrame) -> DataFrame:
    """Rows `(node, component)` for every node of `links(a, b)`; a component's name is its smallest node.

    Alternates two steps until nothing changes: every node hands its larger neighbours to its smallest one, then hands its smaller
    neighbours there too. Each step groups by node with partial minima, so a hub is not gathered, and the number of
    rounds grows with the logarithm of the longest chain. Links of a node with itself, nulls and repeats do no harm.
    """
    edges = kept(
        links.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()
    )
    mark = _mark(edges)
    while mark[0]:
        both = edges.select(F.col("high").alias("node"), F.col("low").alias("other")).union(
            edges.select(F.col("low").alias("node"), F.col("high").alias("other"))
        )
        least = both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("least", "node").alias("least"))
        large = both.join(least, "node").where("other > node").select(F.col("other").alias("high"), F.col("least").alias("low"))
        smallest = large.groupBy("high").agg(F.min("low").alias("least"))
        small = large.join(smallest, "high").where("low <> least").select(F.col("low").alias("high"), F.col("least").alias("low"))
        edges = kept(small.union(smallest.select("high", F.col("least").alias("low"))).distinct())
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    members = edges.select(F.col("high").alias("node"), F.col("low").alias("component"))
    return members.union(edges.select("low", "low").distinct())


def _mark(edges: DataFrame) -> tuple:
    """Count and checksum of the links: equal when a round changed nothing."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("high", "low")), F.sum(F.xxhash64("low", "high") % 1_000_003)).first())


def block_pairs(members: DataFrame, group: str, size: str, spread: str, most: int) -> DataFrame:
    """Deals the rows of each group to tasks that see two blocks at a time, so that every pair of a group meets somewhere.

    Adds `n_blocks`, `block`, `low` and `high`. A group of `size` rows is cut into blocks of about `most` rows by the hash of `spread`; a row goes to
    each pair of blocks that holds its own, itself included. No task holds more than two blocks, however large a group is.
    """
    blocks = F.ceil(F.col(size) / F.lit(most)).cast("int")
    block = F.pmod(F.xxhash64(F.col(spread), F.lit(17)), F.col("n_blocks")).cast("int")
    dealt = members.withColumn("n_blocks", blocks).withColumn("block", block)
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    return (
        dealt.withColumn("_other", other)
        .withColumn("low", F.least("block", "_other"))
        .withColumn("high", F.greatest("block", "_other"))
        .drop("_other")
    )


def together(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Rows with equal keys in one partition, one after another."""
    return df.repartition(_partitions(df), *keys).sortWithinPartitions(*keys, *order)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys (integers), from batches that `together` has put in order."""
    rest: pa.Table | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        changed = np.zeros(table.num_rows - 1, dtype=bool)
        for key in keys:
            values = table.column(key).to_numpy()
            changed |= values[1:] != values[:-1]
        cuts = np.concatenate(([0], np.flatnonzero(changed) + 1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield table.slice(int(a), int(b - a))
        rest = table.slice(int(cuts[-1]))
    if rest is not None and rest.num_rows:
        yield rest


def forest(similar, n: int) -> list[tuple[int, int]]:
    """Links that join the same rows as all similar pairs do: a search that compares a row only with rows not yet reached.

    `similar(i, others)` tells which of `others` are similar to row i."""
    links, rest = [], np.arange(n)
    while len(rest):
        reached, rest = [int(rest[0])], rest[1:]
        while reached and len(rest):
            i = reached.pop()
            near = similar(i, rest)
            links += [(i, int(j)) for j in rest[near]]
            reached += [int(j) for j in rest[near]]
            rest = rest[~near]
    return links
