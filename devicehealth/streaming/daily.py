"""One alert for each user and day, however often it is raised or its file arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def daily_alerts(stream: DataFrame, user: str = "username", ts: str = "ts", late_days: int = 1) -> DataFrame:
    """The first alert to arrive of each user and day, with its ``day``; works on a stream and on a batch frame alike.

    Alerts may come ``late_days`` behind the newest one; later ones are dropped, as their day may be forgotten. A user's day is remembered until the
    watermark is ``late_days`` past the alert that was kept. As that is a day at least, every other alert of the day is late by then, so no day is
    told twice, and the state holds the days within reach of the watermark only.

    Rows without a user or time are left out. ``ts`` is a timestamp, or one without a zone, read in the zone of the session.
    """
    if late_days < 1:
        raise ValueError("a day is remembered for a day at least")
    known = stream.where(F.col(user).isNotNull() & F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp"))
    dated = known.withColumn("day", F.to_date(ts))
    if not stream.isStreaming:
        return dated.dropDuplicates([user, "day"])
    return dated.withWatermark(ts, f"{late_days} days").dropDuplicatesWithinWatermark([user, "day"])
