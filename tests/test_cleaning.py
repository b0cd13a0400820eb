import pytest
from pyspark.sql import functions as F

from devicehealth.functions import labels, numeric, text as tx
from devicehealth.operators import alerts, clean, detect, rollup
from devicehealth.schema import MODEL_TARGETS, TELEMETRY_COLUMNS, alert_dimension, predictors_of


def values(df, column):
    return [r[column] for r in df.collect()]


def test_numbers(spark):
    rows = [("1.5",), (" 5 ",), ("bad",), ("",), ("NaN",), ("inf",), ("-inf",), ("1f",), ("1.5d",), ("1e3",), (".5",), (None,), ("1e999",)]
    got = values(spark.createDataFrame(rows, "v string").select(numeric.to_number(F.col("v")).alias("v")), "v")
    assert got == [1.5, 5.0, None, None, None, None, None, None, None, 1000.0, 0.5, None, None]


def test_severity_edges(spark):
    rows = [(float(v),) for v in (0, 1, 10, 10.5, 50, 100, 500, 501, 1000, 1001)]
    df = spark.createDataFrame(rows, "v double")
    assert values(df.select(labels.crash_severity(F.col("v")).alias("s")), "s") == [
        None, "0-10", "0-10", "11-50", "11-50", "51-100", "101-500", "500+", "500+", "500+"]
    assert values(df.select(labels.crash_severity_fine(F.col("v")).alias("s")), "s")[-3:] == ["501-1000", "501-1000", "1000+"]


def test_host_without_crash_values(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", None, 3.0), (None, 5.0, 1.0), ("b", 2.0, 1.0)], "host_name string, total_app_crash double, avg_boot_time double")
    out = {r["host_name"]: r for r in rollup.host_overview(df, metrics=["avg_boot_time"], complete=False).collect()}
    assert set(out) == {"a", "b"}
    assert out["a"]["total_app_crash_sum"] == 0.0 and out["a"]["total_app_crash_mean"] is None and out["a"]["total_app_crash_count"] == 0
    assert [r["host_name"] for r in rollup.host_overview(df, metrics=["avg_boot_time"]).collect()] == ["b"]


def test_diagnosis_of_given_device(spark):
    names = ["avg_processor_time", "max_cpu_usage", "avg_memory_utilization", "max_memory_usage", "avg_battery_health", "cpu_count",
             "memory_size_gb", "avg_cpu_temp", "avg_boot_time", "p90_boot_time", "uptime_days", "total_app_crash"]
    row = tuple(map(float, (20, 85, 92, 95, 75, 8, 16, 88, 25, 40, 5, 2)))
    df = spark.createDataFrame([row], ", ".join(f"{n} double" for n in names))
    assert values(df.select(labels.diagnosis().alias("d")), "d") == ["Memory Pressure"]


def test_blank_users_and_devices(spark):
    df = spark.createDataFrame([("u", "d"), ("", "d"), (None, "d"), ("u", ""), (" ", "d")], "auth_username string, model_name string")
    assert clean.known_user_and_device(df).count() == 2


def test_detection_is_strict_and_knows_direction(spark):
    df = spark.createDataFrame([
        ("jdoe", "HP EliteBook 840", "78.1", "28", "93.7"), ("asmith", "HP EliteBook 8", "10", "1", "93.6"),
        ("kim", "MacBook", "bad", "", "99"), ("kim", "MacBook", "80", "", "NaN")],
        "auth_username string, model_name string, avg_memory_utilization string, uptime_days string, avg_battery_health string")
    got = [(r["username"], r["features"]) for r in detect.detect(df, {"avg_memory_utilization": 78.1, "uptime_days": 27, "avg_battery_health": 93.7, "absent": 1}).collect()]
    assert got == [("jdoe", {"uptime_days": 28.0}), ("asmith", {"avg_battery_health": 93.6}), ("kim", {"avg_memory_utilization": 80.0})]


def test_alert_lines_and_message(spark):
    flagged = F.when(F.col("username") == "x", F.create_map(F.lit("other"), F.lit(1.0))).otherwise(
        F.create_map(F.lit("avg_memory_utilization"), F.lit(80.5), F.lit("uptime_days"), F.lit(44.0)))
    records = spark.createDataFrame([("jdoe", "HP EliteBook 840"), ("x", "Mac")], "username string, device string").withColumn("features", flagged)
    lines = {r["metric"]: r for r in alerts.alert_lines(records, alert_dimension(spark)).collect()}
    assert lines["other"]["label"] == "other" and lines["other"]["button_label"] == "other"
    assert lines["uptime_days"]["delta_text"] == "17" and lines["uptime_days"]["platform"] == "windows"
    rendered = {r["username"]: r for r in alerts.render_alerts(records).collect()}
    assert rendered["jdoe"]["items"][0] == "> *Memory at 80%*\n> 2% over the recommended threshold\n> Reduce Memory Usage (3 min)"
    assert rendered["jdoe"]["alert_class"] == "self-service" and rendered["x"]["items"] == ["> other"]
    assert rendered["jdoe"]["summary"] == "Laptop health alert for HP EliteBook 840: Average Memory Utilization, System Uptime"


def test_opt_outs_fold(spark):
    log = spark.createDataFrame([
        ("a", "m1", None, 1, 1), ("a", None, "spam", 2, 2), ("b", None, "spam", 1, 3), ("b", "m1", None, 2, 4), ("b", "m2", None, 3, 5), ("c", "m1", None, 1, 6)],
        "username string, metric string, reason string, ts int, seq int")
    got = sorted((r["username"], r["metric"] or "", r["reason"] or "") for r in alerts.opt_out_state(log).collect())
    assert got == [("a", "", "spam"), ("b", "m1", ""), ("b", "m2", ""), ("c", "m1", "")]


def test_directory_lookup(spark):
    people = spark.createDataFrame([
        ("U1", "jdoe", "Jo", "", "Jo Doe", False, False, 1), ("U2", "kim", "jdoe", "Kim", "Kim Lee", False, False, 2),
        ("U3", "bot", "bot", "", "Bot", False, True, 3), ("U4", "gone", "gone", None, "Gone Girl", True, False, 4)],
        "id string, name string, display_name string, first_name string, real_name string, deleted boolean, is_bot boolean, position int")
    asked = spark.createDataFrame([("jdoe",), ("U4",), ("gone",), ("bot",), ("U9",), ("Kim",)], "username string")
    got = {r["username"]: (r["user_id"], r["first_name"]) for r in alerts.resolve_users(asked, people).collect()}
    assert got == {"jdoe": ("U1", "Jo"), "U4": ("U4", "Gone"), "gone": (None, None), "bot": (None, None), "U9": (None, None), "Kim": (None, None)}


def test_chat_markup(spark):
    text = "# Title \n\n---\n- one *two* **three** __four__\n  - deep\r\n#### no\nplain **b**  "
    got = values(spark.createDataFrame([(text,)], "t string").select(tx.chat_markup(F.col("t")).alias("t")), "t")[0]
    assert got == "*Title*\n\n\n• one _two_ *three* *four*\n  • deep\n#### no\nplain *b*"


def test_actions_and_messages(spark):
    df = spark.createDataFrame([("opt_out__a_b",), ("opt_out_reason__skip",), ("done_replacement__x",), ("snooze",)], "a string")
    got = [(r["k"], r["v"]) for r in df.select(tx.action_kind(F.col("a")).alias("k"), tx.action_argument(F.col("a")).alias("v")).collect()]
    assert got == [("opt_out", "a_b"), ("opt_out_reason", "no_reason_given"), ("done_replacement", "x"), (None, None)]
    said = spark.createDataFrame([("my RAM is slow",), ("hello",)], "t string")
    assert values(said.select(tx.match_keyword(F.col("t")).alias("m")), "m") == ["avg_memory_utilization", None]


def test_presets():
    assert len(TELEMETRY_COLUMNS) == 45 and len(MODEL_TARGETS) == 12
    assert {t: len(predictors_of(t)) for t in MODEL_TARGETS} == {
        "total_app_crash": 11, "uptime_days": 11, "avg_battery_health": 12, "avg_boot_time": 12, "avg_cpu_temp": 12, "avg_memory_utilization": 11,
        "avg_processor_time": 12, "cpu_count": 12, "max_cpu_usage": 11, "max_memory_usage": 12, "memory_size_gb": 12, "p90_processor_time": 12}


def test_opt_outs_in_indented_and_one_line_files(spark, tmp_path):
    from devicehealth.sources.side_tables import read_opt_outs

    (tmp_path / "a.json").write_text('{\n  "ann": "on leave",\n  "bob": {\n    "uptime_days": true,\n    "max_cpu_usage": false\n  }\n}\n')
    (tmp_path / "b.json").write_text('{"cy": "x"}\n{"dee": {"uptime_days": true}}\n')
    got = {tuple(r) for r in read_opt_outs(spark, str(tmp_path)).collect()}
    assert got == {("ann", None, "on leave"), ("bob", "uptime_days", None), ("cy", None, "x"), ("dee", "uptime_days", None)}
    (tmp_path / "c.json").write_text('{"eve": ')
    with pytest.raises(Exception, match="no opt-out object"):
        read_opt_outs(spark, str(tmp_path)).collect()


def test_flat_curve_keeps_its_metric(spark, tmp_path):
    from devicehealth.plans.thresholds import thresholds_of
    from devicehealth.sources.side_tables import read_thresholds, write_thresholds

    curve = spark.createDataFrame([("flat", i, float(i), 1.0) for i in range(20)] + [("uptime_days", i, float(i), float(i > 9)) for i in range(20)],
                                  "feature string, i int, x double, prediction double")
    got = {r["metric"]: (r["threshold"], r["complete"]) for r in thresholds_of(curve, {"flat": 0, "uptime_days": 0, "max_cpu_usage": 1}).collect()}
    assert got == {"flat": (None, False), "uptime_days": (9.0, True), "max_cpu_usage": (None, False)}
    rows = thresholds_of(curve, {"uptime_days": 0, "max_cpu_usage": 1})
    write_thresholds(rows, str(tmp_path / "limits"))
    assert {r["metric"]: r["threshold"] for r in read_thresholds(spark, str(tmp_path / "limits")).collect()}["max_cpu_usage"] == 90.2
    with pytest.raises(Exception, match="no threshold for flat"):
        write_thresholds(thresholds_of(curve, {"flat": 0}), str(tmp_path / "none"))
