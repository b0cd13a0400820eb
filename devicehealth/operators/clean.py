"""Cleaning, reshaping and row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from devicehealth.functions.numeric import to_number


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Parse text columns as numbers in one projection; bad values become NULL."""
    return df.withColumns({c: to_number(F.col(c)) for c in columns if c in df.columns})


def complete_cases(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without a missing value in the columns."""
    return df.na.drop(subset=list(columns) if columns else None)


def positive(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column) > 0)


def known_user_and_device(df: DataFrame, user: str = "auth_username", device: str = "model_name") -> DataFrame:
    """Rows with a non-empty user and device."""
    return df.where((F.col(user) != "") & (F.col(device) != ""))


def strip_zone(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column).cast("timestamp_ntz"))


def long_metrics(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide readings to ``(*ids, metric, value)``."""
    return df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        list(ids), list(metrics), "metric", "value")


def series_with_rows(df: DataFrame, key: str, at_least: int) -> DataFrame:
    """Rows of the series that have at least so many rows; counted by aggregate, kept by semi-join."""
    long_enough = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= at_least)
    return df.join(long_enough, key, "left_semi")


def last_points(df: DataFrame, key: str, time: str, n: int, tie: Sequence[str] = ()) -> DataFrame:
    """The newest ``n`` points of each series; trimmed per partition before the shuffle. ``tie`` orders points of one time."""
    newest = Window.partitionBy(key).orderBy(F.col(time).desc(), *tie)
    return df.withColumn("_p", F.row_number().over(newest)).where(F.col("_p") <= n).drop("_p")


def user_messages(df: DataFrame, channel: str = "channel_type", bot: str = "bot_id", text: str = "text",
                  direct: str = "im") -> DataFrame:
    """Direct messages typed by people."""
    written = F.length(F.trim(F.col(text))) > 0
    return df.where((F.col(channel) == direct) & (F.coalesce(F.col(bot), F.lit("")) == "") & written)


def active_members(df: DataFrame, deleted: str = "deleted", bot: str = "is_bot") -> DataFrame:
    """Directory members who are neither deleted nor bots."""
    return df.where(~F.coalesce(F.col(deleted), F.lit(False)) & ~F.coalesce(F.col(bot), F.lit(False)))


def low_confidence(df: DataFrame, probabilities: str, below: float = 0.9) -> DataFrame:
    return df.where(F.array_max(probabilities) < below)


def union_all(*frames: DataFrame) -> DataFrame:
    """Frames stacked by column name."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def distinct_edges(edges: Column) -> Column:
    """Bin edges in order without repeats."""
    return F.array_distinct(edges)
