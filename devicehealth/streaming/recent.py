"""The alerts of each user as state next to the message stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NEVER = np.iinfo(np.int64).min


def keep_state_on_disk(spark: SparkSession, timers: bool) -> None:
    """State in RocksDB, saved as the changes of each batch; streams that are started later in this session use it.

    A stream with timers asks for another batch after each one, also where no data is left, so one that is to take what
    is there and end would never end: batches without data are turned off, and timers are looked at when data comes.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    if timers:
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def messages_with_latest_alert(events: DataFrame, keep_ms: int | None = None, event: str = "event_id", user: str = "user_id", ts: str = "ts",
                               kind: str = "kind", value: str = "metric", alert_ts: str = "alert_ts") -> DataFrame:
    """For each message of a stream ``(event, user, ts, kind, value)``, the user's latest alert at or before its own time.

    ``kind`` is ``alert`` or ``message``. Times decide, not the order of arrival: a late message is answered with the alert
    that was in force at its time, and an alert of the same instant counts. A message is answered in the batch it comes
    in, from the alerts that have come by then. Of several alerts at one instant the one with the largest event counts.
    Alerts without a time are never in force, and messages without a time or a user find none.

    State outlives restarts: one entry for each alert, by its time, and the newest alert beside them. A batch writes its
    own alerts alone and answers messages behind the newest alert from that one; only a message older than it makes the
    user's alert times be read. ``keep_ms`` bounds the state: alerts that were replaced longer than that before the newest
    one are not found any more and are deleted once in each such span, and a timer forgets users that stay silent that long, when the next data comes.
    A task holds one user's rows of one batch, which ``maxFilesPerTrigger`` of the source bounds.
    """
    keep_state_on_disk(events.sparkSession, bool(keep_ms))
    typed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    fields = {f.name: f for f in typed.schema}
    output = T.StructType([fields[event], fields[user], fields[ts], fields[value], T.StructField(alert_ts, T.TimestampType())])
    raised = T.StructType([T.StructField("event", fields[event].dataType), T.StructField("value", fields[value].dataType)])
    by_time = T.StructType([T.StructField("at", T.LongType())])
    newest = T.StructType([*by_time, *raised, T.StructField("swept", T.LongType())])
    keep = keep_ms * 1000 if keep_ms else None

    # Defined here so that it travels by value: the driver's state worker does not see files sent to the executors.
    class Follow(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.alerts = handle.getMapState("alerts", by_time, raised)
            self.newest = handle.getValueState("newest", newest)

        def times(self) -> np.ndarray:
            return np.sort(np.fromiter((at for at, in self.alerts.keys()), "int64"))

        def first_kept(self, times: np.ndarray, last: int) -> int:
            """The last alert before the kept span stays: it was in force when the span began."""
            return max(0, int(times.searchsorted(last - keep, side="right")) - 1) if keep else 0

        def add(self, rows: pd.DataFrame):
            """Store the alerts of a batch; returns the newest alert, or None."""
            known = self.newest.get() if self.newest.exists() else None
            rows = rows[rows["_at"] != NEVER].sort_values(["_at", event], kind="stable").drop_duplicates("_at", keep="last")
            if not len(rows):
                return known
            latest = known
            for at, number, what in zip(*(rows[c].tolist() for c in ("_at", event, value))):
                held = self.alerts.getValue((at,)) if known and at <= known[0] else None
                if held is None or number >= held[0]:
                    self.alerts.updateValue((at,), (number, what))
                    if latest is None or at >= latest[0]:
                        latest = (at, number, what, known[3] if known else at)
            if keep and latest[0] - latest[3] > keep:
                times = self.times()
                for at in times[:self.first_kept(times, latest[0])].tolist():
                    self.alerts.removeKey((at,))
                latest = (*latest[:3], latest[0])
            if latest is not known:
                self.newest.update(tuple(latest))
            return latest

        def in_force(self, asked: np.ndarray, latest) -> list:
            """``(value, time)`` of the alert in force at each asked time."""
            if latest is None:
                return [(None, pd.NaT)] * len(asked)
            found = {}
            late = np.unique(asked[asked < latest[0]])
            if len(late) and late[-1] != NEVER:
                times = self.times()
                first = self.first_kept(times, latest[0])
                place = times.searchsorted(late, side="right") - 1
                held = {p: (self.alerts.getValue((int(times[p]),))[1], pd.Timestamp(int(times[p]), unit="us")) for p in np.unique(place[place >= first])}
                found = {at: held[p] for at, p in zip(late.tolist(), place) if p >= first}
            now = (latest[2], pd.Timestamp(latest[0], unit="us"))
            return [now if at >= latest[0] else found.get(at, (None, pd.NaT)) for at in asked.tolist()]

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            alerts, waiting = [], []
            for batch in rows:
                batch = batch.assign(_at=batch[ts].to_numpy("datetime64[us]").astype("int64"))
                is_alert = batch[kind] == "alert"
                alerts.append(batch.loc[is_alert, ["_at", event, value]])
                waiting.append(batch.loc[~is_alert, [event, user, ts, "_at"]])
            latest = self.add(pd.concat(alerts)) if key[0] is not None else None
            if keep and latest is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + keep_ms)
            asked = pd.concat(waiting)
            if len(asked):
                values, since = zip(*self.in_force(asked["_at"].to_numpy("int64"), latest))
                yield pd.DataFrame({event: asked[event].to_numpy(), user: asked[user].to_numpy(), ts: asked[ts].to_numpy(), value: list(values),
                                    alert_ts: pd.Series(since, dtype="datetime64[us]")})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.alerts.clear()
            self.newest.clear()
            yield from ()

        def close(self) -> None:
            pass

    return typed.groupBy(user).transformWithStateInPandas(Follow(), output, "append", "ProcessingTime" if keep else "None")
