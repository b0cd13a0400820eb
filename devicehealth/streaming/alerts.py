"""New files under a folder become alerts as they arrive.

Every sink writes one folder per micro-batch and overwrites it on a retry, so a batch that runs
twice still counts once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from devicehealth.operators.alerts import opt_out_state
from devicehealth.plans.alerting import problem_records
from devicehealth.sources.headers import PLACED, by_header
from devicehealth.sources.side_tables import read_thresholds


def arriving_files(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """``(file, start, line)`` of comma files below a folder, each read once; gzip by suffix."""
    reader = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{gz,csv}")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format("text").load(folder).selectExpr(*PLACED)


def _per_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def alert_stream(stream: DataFrame, out: str, checkpoint: str, columns: Sequence[str], thresholds: str | None = None, keep: tuple[str, ...] = (),
                 once: bool = True, rejects: str | None = None) -> StreamingQuery:
    """Problem records of each arriving file, whose ``columns`` are found by its own header; an absent metric raises nothing.

    ``thresholds`` is the path of a stored limit map, read again for every batch, so new limits take
    effect without a restart; without it the shipped limits apply. Lines that do not fit their header go to
    ``rejects``, or stop the stream if it is not named.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        limits = read_thresholds(batch.sparkSession, thresholds) if thresholds else None
        refuse = None if rejects else f"lines of batch {batch_id} do not fit their header; name a folder for rejects"
        readings, unfit = by_header(batch, columns, refuse=refuse)
        if rejects:
            unfit.write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
        problem_records(readings, limits, keep).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _per_batch(stream, write, checkpoint, once)


def opt_out_stream(stream: DataFrame, log: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append opt-out events to the log; ``current_opt_outs`` folds it, also after a restart."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    return _per_batch(stream, write, checkpoint, once)


def current_opt_outs(spark: SparkSession, log: str) -> DataFrame:
    """Opt-outs in force."""
    return opt_out_state(spark.read.parquet(log))
