"""Rows of headered text files by column name, whatever the order or the number of columns of each file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from devicehealth.session import cut_lineage, small

#: File, offset of the part of it that a task reads, and the line.
PLACED = ["_metadata.file_path AS file", "_metadata.file_block_start AS start", "value AS line"]


def read_lines(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """``(file, start, line)`` of text files, gzip by suffix."""
    reader = spark.read.option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", glob) if glob else reader).text(path).selectExpr(*PLACED)


def _cells(line, sep: str, n: int):
    schema = ", ".join(f"c{i} string" for i in range(n))
    # Parsed once for all cells, with a reading buffer of a line's size rather than a file's.
    parsed = F.from_csv(line, F.lit(schema), {"sep": sep, "mode": "PERMISSIVE", "inputBufferSize": "4096"})
    return F.element_at(F.transform(F.array(parsed), lambda p: F.array(*[p[f"c{i}"] for i in range(n)])), 1)


def by_header(lines: DataFrame, columns: Sequence[str] | None = None, sep: str = ",", refuse: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)`` of ``lines(file, start, line)``: each file's first line names its cells.

    ``columns`` are taken by name, as text; one that a file does not have is NULL there. Without them, all names met are
    columns. A line with another number of cells than its header is a reject ``(file, line)``. A record is one line. With ``refuse``
    reading the rows raises that text where there is a reject, so no pass of its own has to look for one.
    """
    spark = lines.sparkSession
    # Ids grow along the lines of a task, and the first part of a file holds its header.
    placed = lines.withColumn("_at", F.monotonically_increasing_id())
    count = lambda c: F.size(F.split(F.regexp_replace(c, '"([^"]|"")*"', ""), f"[{sep}]" if sep != "\t" else "\t", -1))
    # Written once, since each look at the headers reads all lines.
    heads = cut_lineage(placed.where("start = 0").groupBy("file").agg(F.min(F.struct("_at", "line")).alias("h")).select(
        "file", F.col("h._at").alias("_head"), F.col("h.line").alias("_names"))).withColumn("_width", count(F.col("_names")))
    widest = heads.agg(F.max("_width")).first()[0]
    if widest is None:
        empty = ", ".join(f"`{c}` string" for c in columns or []) or "line string"
        return spark.createDataFrame([], empty), spark.createDataFrame([], "file string, line string")
    heads = heads.withColumn("_names", F.transform(F.slice(_cells(F.col("_names"), sep, widest), F.lit(1), F.col("_width")), lambda c: F.trim(c)))
    if columns is None:
        columns = sorted(r["n"] for r in heads.select(F.explode("_names").alias("n")).distinct().collect() if r["n"])
    body = placed.join(small(heads), "file").where((F.col("_at") != F.col("_head")) & (F.trim("line") != ""))
    fits = count(F.col("line")) == F.col("_width")
    kept = body.where(fits if refuse is None else F.when(fits, True).otherwise(F.raise_error(F.lit(refuse)).cast("boolean")))
    # Exploded, so that no condition on a column is moved below the parser and parses the line once more.
    read = kept.select(F.explode(F.array(_cells(F.col("line"), sep, widest))).alias("_c"), "_names")
    rows = read.select(*[F.get("_c", F.coalesce(F.array_position("_names", c), F.lit(0)).cast("int") - 1).alias(c) for c in columns])
    return rows, body.where(~fits).select("file", "line")
