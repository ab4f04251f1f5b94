"""Session settings shared by the tests, the bench and the entry point."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, name: str = "plumeline") -> SparkSession:
    """A local session for tests and the bench. On a cluster the caller passes its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Small test tables would otherwise be merged into one task.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, for a session that started without it on their path (not installed there, no
    `--py-files`). Python functions refer to the package by name, so the workers must be able to import it."""
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(tempfile.mkdtemp(prefix="plumeline-") + "/plumeline", "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Makes sure that checkpoints have a folder: the shared one that the cluster names in
    `spark.checkpoint.dir`, and a temporary one only for a local session that names none."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(folder)
    elif context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="plumeline-checkpoint-"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` hashed by its keys over all shuffle partitions.

    For small rows that stand for much work (a unit about to become a grid, a series about to be
    searched): the adaptive merge of small partitions looks at bytes and would put them in few tasks.
    The number comes from the session, so a cluster's setting applies.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
