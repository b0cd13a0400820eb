"""Alerts: enrichment, messages, recipients, mutes and follow-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from devicehealth.functions import text as tx
from devicehealth.operators.clean import active_members
from devicehealth.operators.ordering import latest_per_key
from devicehealth.schema import ALERT_METRICS
from devicehealth.session import small


def enrich_lines(lines: DataFrame, dimension: DataFrame, routing: DataFrame | None = None) -> DataFrame:
    """Add label, button label, type, address and display limit; an unknown metric keeps its key as label.

    The dimension is broadcast while its row count is small: its few keys would make few, hot partitions.
    """
    details = dimension
    if routing is not None:
        details = dimension.drop("type").join(routing, "metric", "left")
    joined = lines.join(small(details), "metric", "left")
    return joined.withColumns({
        "label": F.coalesce("label", "metric"),
        "button_label": F.coalesce("button_label", "label", "metric"),
        "type": F.coalesce("type", F.lit("self-service")),
    })


def alert_lines(records: DataFrame, dimension: DataFrame, routing: DataFrame | None = None) -> DataFrame:
    """One described line per (user, device, metric): value, limit, distance past it and platform."""
    others = [c for c in records.columns if c != "features"]
    lines = records.select(*others, F.explode("features").alias("metric", "value"))
    described = enrich_lines(lines, dimension, routing)
    past = tx.distance_past_limit(F.col("value"), F.col("threshold"), F.col("lower_is_worse"))
    return described.withColumns({
        "platform": tx.platform_of(F.col("device")),
        "delta": F.abs(past),
        "value_text": tx.format_metric(F.col("value"), F.col("metric")),
        "delta_text": tx.format_metric(F.abs(past), F.col("metric")),
    })


def _metric_details() -> Column:
    """Literal map metric -> details; six fixed entries."""
    fields = ("label", "button_label", "threshold", "lower_is_worse", "type", "headline", "delta_line")
    entries = []
    for row in ALERT_METRICS:
        entries += [F.lit(row[0]), F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, row[1:8])])]
    return F.create_map(*entries)


def addresses(routing: DataFrame) -> Column:
    """Map metric -> address from a routing table ``(metric_key, canvas_url)``, for ``render_alerts``.

    Only alert metrics are looked up and the least address of each is taken, so six values at most are fetched.
    A metric without an address keeps its bare label.
    """
    known = routing.where(F.col("metric_key").isin(*[m[0] for m in ALERT_METRICS]) & (F.col("canvas_url") != ""))
    found = known.groupBy("metric_key").agg(F.min("canvas_url")).collect()
    return F.create_map(*[F.lit(v) for row in found for v in row]).cast("map<string,string>")


def render_alerts(records: DataFrame, first_name: str = "first_name", urls: Column | None = None) -> DataFrame:
    """Add ``items``, ``alert_class``, ``body`` and ``summary`` to records with a features map.

    Rendering works on the record's own array, in metric order, with no explode and no regrouping.
    ``urls`` is an optional map column metric -> address.
    """
    details = _metric_details()
    entries = F.map_entries("features")

    def item(entry: Column) -> Column:
        metric, value = entry["key"], entry["value"]
        info = details[metric]
        label = F.coalesce(info["button_label"], metric)
        target = tx.link(urls[metric], label) if urls is not None else label
        return tx.alert_item(value, info["threshold"], info["lower_is_worse"], metric,
                             info["headline"], info["delta_line"], target)

    replacement = F.exists(entries, lambda e: F.coalesce(details[e["key"]]["type"] == "replacement", F.lit(False)))
    labels = F.transform(entries, lambda e: F.coalesce(details[e["key"]]["label"], e["key"]))
    with_items = records.withColumn("items", F.transform(entries, item))
    name = F.col(first_name) if first_name in records.columns else F.col("username")
    return with_items.withColumns({
        "alert_class": F.when(replacement, "queue").otherwise("self-service"),
        "body": tx.alert_body(name, F.col("device"), F.col("items")),
        "summary": tx.fallback_summary(F.col("device"), labels),
    })


def directory_keys(directory: DataFrame, position: str = "position") -> DataFrame:
    """``(lookup, kind) -> (user_id, first_name)`` with one row per key, the first in directory order.

    Ids are looked up among all members, names and display names among active people.
    """
    name = tx.first_name_of(F.col("first_name"), F.col("real_name"))
    by_id = directory.select(F.lit("id").alias("kind"), F.col("id").alias("lookup"), F.col(position), F.col("id").alias("user_id"),
                             name.alias("first_name"))
    active = active_members(directory)
    by_name, by_display = [
        active.select(F.lit("name").alias("kind"), F.col(c).alias("lookup"), F.col(position), F.col("id").alias("user_id"), name.alias("first_name"))
        for c in ("name", "display_name")]
    keys = by_id.unionByName(by_name).unionByName(by_display).where(F.col("lookup").isNotNull())
    hit = F.min_by(F.struct("user_id", "first_name"), F.struct(F.col(position), F.col("user_id")))
    return keys.groupBy("kind", "lookup").agg(hit.alias("_hit")).select("kind", "lookup", "_hit.*")


def resolve_users(df: DataFrame, directory: DataFrame, user: str = "username", position: str = "position") -> DataFrame:
    """Add ``user_id`` and ``first_name``; NULL where the directory has no such user.

    A user name that starts with ``U`` is a member id. One equi-join on (kind, key) replaces the
    id-or-name-or-display-name condition.
    """
    kind = F.when(F.col(user).startswith("U"), "id").otherwise("name")
    keys = directory_keys(directory, position).withColumnsRenamed({"kind": "_kind", "lookup": "_lookup"})
    tagged = df.withColumn("_kind_", kind)
    joined = tagged.join(keys, (F.col("_kind_") == F.col("_kind")) & (F.col(user) == F.col("_lookup")), "left")
    return joined.drop("_kind_", "_kind", "_lookup")


def split_rejects(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deliverable rows, and rows that failed with the reason; one failure never stops the rest."""
    failed = F.col("user_id").isNull()
    return resolved.where(~failed), resolved.where(failed).withColumn("reason", F.lit("user not found"))


def without_muted(df: DataFrame, opt_outs: DataFrame, level: str = "user", user: str = "username", metric: str = "metric") -> DataFrame:
    """Drop rows of muted users (``user``) or muted user-metric pairs (``metric``).

    At metric level, a user-wide opt-out (NULL metric) still mutes everything of that user.
    """
    if level == "user":
        muted = opt_outs.select(F.col("username").alias(user)).distinct()
        return df.join(muted, user, "left_anti")
    whole = opt_outs.where(F.col("metric").isNull()).select(F.col("username").alias(user)).distinct()
    pairs = opt_outs.where(F.col("metric").isNotNull()).select(
        F.col("username").alias(user), F.col("metric").alias(metric)).distinct()
    return df.join(pairs, [user, metric], "left_anti").join(whole, user, "left_anti")


def opt_out_state(log: DataFrame) -> DataFrame:
    """Current opt-outs from an event log ``(username, metric, reason, ts, seq)``.

    A reason replaces everything before it; a metric opt-out after a reason starts a per-metric list.
    So the state of a user is the latest reason if nothing follows it, else the metrics after it.
    """
    order = F.struct("ts", "seq")
    last_reason = log.groupBy("username").agg(
        F.max(F.when(F.col("reason").isNotNull(), order)).alias("_reason_at"),
        F.max_by("reason", F.when(F.col("reason").isNotNull(), order)).alias("_reason"),
        F.max(F.when(F.col("reason").isNull(), order)).alias("_metric_at"))
    whole = last_reason.where(F.col("_reason_at").isNotNull() & (F.col("_metric_at").isNull() | (F.col("_reason_at") > F.col("_metric_at"))))
    metrics = log.where(F.col("reason").isNull()).groupBy("username", "metric").agg(F.max(order).alias("_at"))
    kept = metrics.join(last_reason, "username").where(
        F.col("_reason_at").isNull() | ((F.col("_metric_at") > F.col("_reason_at")) & (F.col("_at") > F.col("_reason_at"))))
    return whole.select("username", F.lit(None).cast("string").alias("metric"), F.col("_reason").alias("reason")).unionByName(
        kept.select("username", "metric", F.lit(None).cast("string").alias("reason")))


def rediagnose(previous: DataFrame, readings: DataFrame, detect_fn, user: str = "auth_username", order=("time",)) -> DataFrame:
    """For every alerted user, the metrics of the latest reading still past their limits, or all clear."""
    latest = latest_per_key(readings, [user], list(order))
    now = detect_fn(latest).select("username", F.col("features").alias("remaining"))
    asked = previous.select("username").distinct()
    joined = asked.join(now, "username", "left")
    return joined.withColumn("status", F.when(F.col("remaining").isNull(), "all clear").otherwise("still at risk"))


def current_snapshot(readings: DataFrame, user: str, device: str, time: str, tie: str) -> DataFrame:
    """Latest reading per user and device."""
    return latest_per_key(readings, [user, device], [time, tie])


def find_articles(requests: DataFrame, articles: DataFrame) -> DataFrame:
    """Article of each (platform, metric) request as chat markup, or the fixed notice naming the metric."""
    notice = F.concat(F.lit(tx.NO_ARTICLE), F.col("metric"), F.lit("`"))
    joined = requests.join(articles, ["platform", "metric"], "left")
    return joined.withColumn("article", F.coalesce(tx.chat_markup(F.col("body")), notice)).drop("body")


def answer_messages(messages: DataFrame, articles: DataFrame, dimension: DataFrame, text: str = "text",
                    last_metric: str = "last_metric", keywords=None) -> DataFrame:
    """Reply to each message: keyword metric, else the metric of the user's last alert, else the generic text.

    Without a ``platform`` column the articles of the default platform are used.
    """
    matched = tx.match_keyword(F.col(text), keywords) if keywords else tx.match_keyword(F.col(text))
    routed = messages.withColumn("metric", F.coalesce(matched, F.col(last_metric)))
    if "platform" not in routed.columns:
        routed = routed.withColumn("platform", F.lit("mac"))
    found = find_articles(routed, articles).join(small(dimension.select("metric", "label")), "metric", "left")
    intro = F.concat(F.lit(tx.ARTICLE_INTRO), F.coalesce("label", "metric"), F.lit("*:\n\n"), F.col("article"))
    return found.withColumn("reply", F.when(F.col("metric").isNull(), tx.GENERIC_REPLY).otherwise(intro)).drop("label")
