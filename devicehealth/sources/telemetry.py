"""Telemetry and time-series readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from devicehealth.functions.numeric import to_number, to_time
from devicehealth.schema import NUMERIC_METRICS, TELEMETRY_SCHEMA
from devicehealth.sources.headers import by_header, read_lines


def read_telemetry(spark: SparkSession, path: str | Sequence[str], partitions: int | None = None) -> DataFrame:
    """Headerless ``|``-separated snapshot files, plain or gzip, as 45 string columns.

    A gzip file cannot be split, so one file is one task; ``partitions`` spreads its rows after the
    read. Convert once with ``land_telemetry`` rather than reading the text again.
    """
    raw = spark.read.schema(TELEMETRY_SCHEMA).option("sep", "|").csv(path)
    return raw.repartition(partitions) if partitions else raw


def read_prefix(spark: SparkSession, prefix: str, sep: str = "|") -> DataFrame:
    """Every ``.gz`` and ``.csv`` snapshot file below a prefix, however deep."""
    return (spark.read.schema(TELEMETRY_SCHEMA).option("sep", sep).option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.{gz,csv}").csv(prefix))


def read_headered(spark: SparkSession, path: str | Sequence[str], sep: str = ",", columns: Sequence[str] | None = None) -> DataFrame:
    """Files with a header row each, read by name: files may differ in the order and choice of columns.

    A metric that a file lacks is NULL in its rows. Lines that do not fit their header are left to ``headers.by_header``,
    which returns them.
    """
    return by_header(read_lines(spark, path), columns, sep)[0]


def typed_telemetry(raw: DataFrame, numeric: Sequence[str] = tuple(NUMERIC_METRICS)) -> DataFrame:
    """Numbers and the reading time parsed, in one projection; bad text becomes NULL."""
    return raw.select(*[
        to_number(F.col(c)).alias(c) if c in numeric else to_time(F.col(c)).alias(c) if c == "time" else F.col(c)
        for c in raw.columns])


def land_telemetry(raw: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    """Write typed telemetry as Parquet once, so later reads prune columns and skip row groups."""
    typed = typed_telemetry(raw)
    if partition_by:
        typed = typed.withColumn(partition_by, F.to_date("time"))
        typed.write.mode("overwrite").partitionBy(partition_by).parquet(path)
    else:
        typed.write.mode("overwrite").parquet(path)
    return raw.sparkSession.read.parquet(path)


def first_rows(df: DataFrame, n: int, order: Sequence[str] = ()) -> DataFrame:
    """Bounded sample: the first ``n`` rows, in a fixed order where one is given."""
    return df.orderBy(*order).limit(n) if order else df.limit(n)


def read_device_log(spark: SparkSession, path: str, columns: dict[str, str], time: str) -> DataFrame:
    """Headered log whose column names hold spaces; ``columns`` renames them and ``time`` is parsed."""
    log = spark.read.option("header", True).csv(path).withColumnsRenamed(columns)
    return log.withColumn(time, to_time(F.col(time)))


def read_series(spark: SparkSession, path: str, time: str, fmt: str = "parquet") -> DataFrame:
    """Long-format time series from Parquet or headered CSV with a timestamp column."""
    reader = spark.read if fmt == "parquet" else spark.read.option("header", True)
    series = reader.format(fmt).load(path)
    return series.withColumn(time, to_time(F.col(time))) if dict(series.dtypes)[time] == "string" else series


def from_upload_folder(df: DataFrame, bucket: str, prefix: str, path: str = "file_path") -> DataFrame:
    """Rows whose file lies in the expected bucket and folder."""
    key = F.url_decode(F.regexp_extract(path, r"^[a-z0-9]+://[^/]+/(.*)$", 1))
    holder = F.regexp_extract(path, r"^[a-z0-9]+://([^/]+)/", 1)
    return df.where((holder == bucket) & key.startswith(prefix))
