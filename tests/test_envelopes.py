"""Envelopes of problematic users, the addresses of guides and replies with articles."""

import json

from pyspark.sql import functions as F

from devicehealth import catalog
from devicehealth.operators import alerts
from devicehealth.sources.side_tables import problem_envelopes, read_problem_envelopes

SHAPE = "source string, username string, device string, features map<string, double>"


def test_envelopes_are_bounded_and_whole(spark, tmp_path):
    rows = [("hot" if i % 3 else f"s{i}", f"user{i}", None if i == 7 else "HP \"x\"", {"uptime_days": i + 0.1}) for i in range(400)] + [(None, "u", "d", {"m": None})]
    records = spark.createDataFrame(rows, SHAPE).repartition(4)
    made = problem_envelopes(records, "source", size=50)
    values = made.collect()
    sizes = [len(json.loads(r["value"])["problematic_users"]) for r in values]
    assert max(sizes) <= 50 and sum(sizes) == 401
    for r in values:
        assert set(json.loads(r["value"])) == {"problematic_users"}
        assert all(u["username"] == "u" if r["source"] is None else (r["source"] == "hot") == (int(u["username"][4:]) % 3 != 0)
                   for u in json.loads(r["value"])["problematic_users"])
    path = str(tmp_path / "envelopes")
    problem_envelopes(records, size=50).write.text(path)
    got = sorted((r["username"], r["device"], r["features"].get("uptime_days")) for r in read_problem_envelopes(spark, path).where("device is not null").collect())
    assert got == sorted((u, d, f.get("uptime_days")) for _, u, d, f in rows if d is not None)
    assert problem_envelopes(records.limit(0)).count() == 0


def test_addresses(spark):
    routing = spark.createDataFrame([("uptime_days", "https://b"), ("uptime_days", "https://a"), ("p90_cpu_temp", ""), ("other", "https://c"), (None, "x")],
                                    "metric_key string, canvas_url string")
    records = spark.createDataFrame([("ann", "HP", {"uptime_days": 40.0}), ("bob", "HP", {"p90_cpu_temp": 99.0})], "username string, device string, features map<string, double>")
    items = {r["username"]: r["items"][0] for r in alerts.render_alerts(records, urls=alerts.addresses(routing)).collect()}
    bare = {r["username"]: r["items"][0] for r in alerts.render_alerts(records).collect()}
    assert "<https://a|" in items["ann"] and items["ann"] != bare["ann"] and items["bob"] == bare["bob"]
    none = alerts.render_alerts(records, urls=alerts.addresses(routing.where(F.lit(False)))).collect()
    assert {r["username"]: r["items"][0] for r in none} == bare


def test_replies_hold_articles_at_each_size(spark):
    queries = catalog.load()[0]
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        asked = spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'error'").select("event_id")
        replies = queries["t8_message_replies"](spark, sf).join(asked, "event_id")
        missing = F.col("reply").contains("*No self-help article found for this issue yet.*")
        told = replies.agg(F.count("reply").alias("all"), F.sum(missing.cast("int")).alias("missing")).first()
        assert told["all"] == asked.count() and 0 < told["missing"] <= 0.05 * told["all"]
