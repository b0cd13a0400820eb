import pytest
from pyspark.sql import functions as F, types as T

from devicehealth.sources.headers import by_header, read_lines
from devicehealth.sources.side_tables import read_thresholds, write_thresholds
from devicehealth.streaming import alerts as sa
from devicehealth.streaming.recent import messages_with_latest_alert

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("auth_username", "model_name", "uptime_days")])


def put_limits(spark, path, value):
    write_thresholds(spark.createDataFrame([("uptime_days", value)], "metric string, threshold double"), path)


def put_file(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").option("header", True).option("compression", "gzip").csv(folder)


def test_restart_reads_only_new_files_under_new_limits(spark, tmp_path):
    folder, out, check, limits = [str(tmp_path / n) for n in ("in", "out", "check", "limits")]
    put_limits(spark, limits, 27.0)
    put_file(spark, folder, [("a", "HP", "30"), ("b", "HP", "20"), ("", "HP", "99"), ("c", "HP", "bad")])
    sa.alert_stream(sa.arriving_files(spark, folder), out, check, SCHEMA.names, thresholds=limits).awaitTermination()
    assert [r["username"] for r in spark.read.parquet(out).collect()] == ["a"]
    put_limits(spark, limits, 10.0)
    put_file(spark, folder, [("d", "HP", "11")])
    sa.alert_stream(sa.arriving_files(spark, folder), out, check, SCHEMA.names, thresholds=limits).awaitTermination()
    # 'b' came under the old limits and is not looked at again.
    assert sorted(r["username"] for r in spark.read.parquet(out).collect()) == ["a", "d"]
    assert read_thresholds(spark, limits).first().asDict() == {"metric": "uptime_days", "threshold": 10.0}


def test_latest_alert_survives_a_restart(spark, tmp_path):
    folder, out, check = [str(tmp_path / n) for n in ("in", "out", "check")]
    schema = "event_id bigint, user_id bigint, ts timestamp, kind string, metric string"

    def run(rows):
        spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts string, kind string, metric string").withColumn(
            "ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        messages_with_latest_alert(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(
            availableNow=True).start().awaitTermination()
        return {r["event_id"]: r["metric"] for r in spark.read.parquet(out).collect()}

    first = run([(3, 1, "2024-01-01 03:00:00", "message", None), (1, 1, "2024-01-01 01:00:00", "message", None), (2, 1, "2024-01-01 02:00:00", "alert", "m1")])
    assert first == {1: None, 3: "m1"}
    second = run([(4, 1, "2024-01-02 00:00:00", "message", None), (5, 1, "2024-01-02 01:00:00", "alert", "m2"), (6, 1, "2024-01-02 02:00:00", "message", None),
                  (7, 2, "2024-01-02 00:00:00", "message", None)])
    assert second == {1: None, 3: "m1", 4: "m1", 6: "m2", 7: None}


def put_text(folder, name, text):
    import os

    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write(text)


def test_files_are_read_by_their_own_header(spark, tmp_path):
    folder, out, check, bad = [str(tmp_path / n) for n in ("in", "out", "check", "bad")]
    columns = ["auth_username", "model_name", "uptime_days", "max_cpu_usage"]
    put_text(folder, "a.csv", "max_cpu_usage,uptime_days,auth_username,model_name\n10,99,a,HP\n")
    put_text(folder, "b.csv", "auth_username,model_name,max_cpu_usage\nb,\"HP, 14\",95\nshort,HP\n")
    sa.alert_stream(sa.arriving_files(spark, folder), out, check, columns, rejects=bad).awaitTermination()
    assert {r["username"]: (r["device"], r["features"]) for r in spark.read.parquet(out).collect()} == {
        "a": ("HP", {"uptime_days": 99.0}), "b": ("HP, 14", {"max_cpu_usage": 95.0})}
    assert [r["line"] for r in spark.read.parquet(bad).collect()] == ["short,HP"]


def test_a_line_that_does_not_fit_stops_the_stream(spark, tmp_path):
    import os

    folder, out, check = [str(tmp_path / n) for n in ("in", "out", "check")]
    columns = ["auth_username", "model_name", "uptime_days"]
    put_text(folder, "a.csv", "auth_username,model_name,uptime_days\na,HP,99\nshort,HP\n")
    with pytest.raises(Exception, match="do not fit their header"):
        sa.alert_stream(sa.arriving_files(spark, folder), out, check, columns).awaitTermination()
    assert not [n for _, _, names in os.walk(out) for n in names if n.endswith(".parquet")]


def test_a_line_is_parsed_once(spark, tmp_path):
    """Conditions on the cells stay above the parser, and looking at the headers again reads no lines."""
    put_text(str(tmp_path / "in"), "a.csv", "a,b,c\n1,2,3\n4,5,6\n")
    rows, _ = by_header(read_lines(spark, str(tmp_path / "in")), ["a", "b", "c"], refuse="unfit")
    plan = rows.where("a > 0 and b > 0 and c > 0")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_csv(") <= 2 and plan.count("FileScan text") == 1
    assert sorted(map(tuple, rows.where("a > 1").collect())) == [("4", "5", "6")]


def test_late_and_tied_messages_get_the_alert_of_their_time(spark, tmp_path):
    folder, out, check = [str(tmp_path / n) for n in ("in", "out", "check")]

    def run(rows):
        spark.createDataFrame(rows, "id bigint, who bigint, at string, kind string, what string").withColumn(
            "at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("id bigint, who bigint, at timestamp, kind string, what string").parquet(folder)
        messages_with_latest_alert(stream, event="id", user="who", ts="at", value="what", alert_ts="since").writeStream.format("parquet").option(
            "path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return {r["id"]: (r["what"], r["since"] and r["since"].day) for r in spark.read.parquet(out).collect()}

    run([(1, 1, "2024-01-05", "alert", "late"), (2, 1, "2024-01-02", "alert", "early")])
    got = run([(3, 1, "2024-01-03", "message", None), (4, 1, "2024-01-05", "message", None), (5, 1, "2024-01-01", "message", None), (9, 1, "2024-01-08", "alert", "tie"),
               (8, 1, "2024-01-08", "message", None)])
    assert got == {3: ("early", 2), 4: ("late", 5), 5: (None, None), 8: ("tie", 8)}


def test_alert_state_is_written_by_the_alert_and_kept_for_a_span(spark, tmp_path):
    import datetime as dt

    folder, out, check = [str(tmp_path / n) for n in ("in", "out", "check")]
    schema = "event_id bigint, user_id bigint, ts timestamp, kind string, metric string"
    start = dt.datetime(2024, 1, 1)

    def run(rows, keep_ms=None):
        spark.createDataFrame([(i, u, at and start + dt.timedelta(seconds=at), k, m) for i, u, at, k, m in rows], schema).coalesce(1).write.mode("append").parquet(folder)
        stream = messages_with_latest_alert(spark.readStream.schema(schema).parquet(folder), keep_ms).writeStream.format("parquet").option(
            "path", out + str(keep_ms)).option("checkpointLocation", check + str(keep_ms)).trigger(availableNow=True).start()
        stream.awaitTermination()
        updated = [p["stateOperators"][0]["numRowsUpdated"] for p in stream.recentProgress if p["numInputRows"]]
        return {r["event_id"]: r["metric"] for r in spark.read.parquet(out + str(keep_ms)).collect()}, sum(updated)

    history = [(i, 1, 30 * i, "alert", f"m{i}") for i in range(1, 101)]
    _, many = run(history + [(5000, 1, 299, "message", None)])
    got, few = run([(1000, 1, 4000, "alert", "new"), (1001, 1, 4000, "message", None), (1002, 1, 1239, "message", None), (1003, 1, 5, "message", None),
                    (1004, None, 4000, "message", None), (1005, 1, None, "message", None), (1006, 1, None, "alert", "never"), (1007, None, 1, "alert", "nobody"),
                    (300, 1, 300, "alert", "tie"), (1008, 1, 305, "message", None)])
    assert got == {5000: "m9", 1001: "new", 1002: "m41", 1003: None, 1004: None, 1005: None, 1008: "tie"}
    assert many >= 100 and few <= 6
    before = spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled")
    # The same files in one batch, alerts kept for 500 s before the newest: the one in force 3,500 s in is the last of the history.
    kept, _ = run([(2000, 1, 2995, "message", None), (2001, 1, 3000, "message", None), (2002, 1, 3999, "message", None)], keep_ms=500_000)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", before)
    assert {k: kept[k] for k in (2000, 2001, 2002, 1001, 1002)} == {2000: None, 2001: "m100", 2002: "m100", 1001: "new", 1002: None}


def test_daily_alerts_with_late_repeated_and_restarted_files(spark, tmp_path):
    import datetime as dt

    from devicehealth.streaming.daily import daily_alerts
    at = lambda day, hour: dt.datetime(2024, 1, day, hour)
    files = [[("a", at(1, 5)), ("a", at(1, 9)), ("b", at(1, 23)), (None, at(1, 1)), ("c", None)], [("a", at(1, 5)), ("a", at(2, 0)), ("b", at(1, 0))],
             [("c", at(2, 22)), ("a", at(1, 23))], [("b", at(9, 1)), ("b", at(9, 2))], [("b", at(9, 2))], [("d", at(2, 3)), ("b", at(9, 0)), ("d", at(8, 3))]]
    schema, folder, out = "username string, ts timestamp_ntz", str(tmp_path / "in"), str(tmp_path / "out")
    for cut in (files[:2], files[2:]):
        for rows in cut:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        daily_alerts(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.username, r.day.day) for r in spark.read.parquet(out).collect())
    every = spark.createDataFrame([r for rows in files for r in rows], schema)
    want = sorted((r.username, r.day.day) for r in daily_alerts(every).collect())
    # One alert came a week behind the newest; its day is no longer told.
    assert [x for x in want if x != ("d", 2)] == got and ("d", 2) in want
