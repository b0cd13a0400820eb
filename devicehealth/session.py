"""Session-level helpers: the shared scratch folder and lineage cuts."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="devicehealth-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path for a written table below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/devicehealth/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so a lost executor does not replay every earlier round."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def let_go(spark: SparkSession) -> None:
    """Ask both collectors of the driver to run, so that shuffle files and checkpoints of finished rounds are deleted while an iteration goes on.

    Spark removes them when nothing refers to them any more, which it only learns from a collection; a driver with a large heap may run none for hours.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """Broadcast hint for a frame that a count shows to be small; a larger one is left to a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def tasks_of(df: DataFrame) -> int:
    """Tasks for block work. Block pairs are light in bytes and heavy in arithmetic, so they must not be
    coalesced by size; a number given here stays."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores where the input came in fewer pieces, as one unsplittable file does.

    An input with enough splits is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once for each application, so that tasks can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_devicehealth_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="devicehealth-"), "devicehealth.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("devicehealth", os.path.relpath(path, root)))
    context.addPyFile(archive)
    context._devicehealth_shipped = True


# Settings for large inputs: plans adapt to measured sizes, skewed join partitions are split, and
# shuffle partitions are cut to a size that fits an executor's share of memory.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
