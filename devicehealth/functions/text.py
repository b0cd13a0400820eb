"""Text of alerts, messages, actions and articles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from devicehealth.schema import MESSAGE_KEYWORDS, ONE_DECIMAL_METRICS, WINDOWS_NAMES


def platform_of(device: Column) -> Column:
    """``windows`` or ``mac`` from a device name."""
    return F.when(F.lower(device).rlike("|".join(WINDOWS_NAMES)), "windows").otherwise("mac")


def format_metric(value: Column, metric: Column) -> Column:
    """Display form of a metric value: one decimal for temperatures, whole numbers otherwise."""
    return F.when(metric.isin(*ONE_DECIMAL_METRICS), F.bround(value, 1).cast("string")).otherwise(
        F.bround(value, 0).cast("bigint").cast("string")
    )


def distance_past_limit(value: Column, limit: Column, lower_is_worse: Column) -> Column:
    """Signed distance past a limit: positive on the bad side."""
    return F.when(lower_is_worse, limit - value).otherwise(value - limit)


def link(url: Column, label: Column) -> Column:
    """Message link, or the bare label where there is no address."""
    return F.when(url.isNotNull() & (url != ""), F.concat(F.lit("<"), url, F.lit("|"), label, F.lit(">"))).otherwise(label)


def alert_item(value: Column, limit: Column, lower_is_worse: Column, metric: Column,
               headline: Column, delta_line: Column, target: Column) -> Column:
    """Quoted block of one flagged metric; only the link where the metric has no template.

    A metric without a value keeps the raw template text.
    """
    def fill(template: Column) -> Column:
        delta = F.abs(distance_past_limit(value, limit, lower_is_worse))
        filled = F.replace(
            F.replace(template, F.lit("{value}"), format_metric(value, metric)),
            F.lit("{delta}"), format_metric(delta, metric))
        return F.when(value.isNotNull() & limit.isNotNull(), filled).otherwise(template)

    quoted = F.concat(F.lit("> *"), fill(headline), F.lit("*\n> "), fill(delta_line), F.lit("\n> "), target)
    return F.when(headline.isNotNull(), quoted).otherwise(F.concat(F.lit("> "), target))


# Fixed message texts.
ALERT_INTRO = "We noticed a few things on your *"
ALERT_INTRO_END = "* that could cause problems if left unaddressed:"
ALERT_OUTRO = ("Once you've followed the steps in the canvas, re-run our diagnosis "
               "to see if the risk factors are addressed.")
STILL_AT_RISK_INTRO = "Your laptop is still at risk. Please follow these guides:"
STILL_AT_RISK_OUTRO = "When you're done, hit *re-run diagnosis* again."
ALL_CLEAR = "Your laptop is all clear! No risk factors detected. 🎉"
NO_ARTICLE = "*No self-help article found for this issue yet.*\n\nPlease contact IT directly and mention: `"
ARTICLE_INTRO = "Here's what I know about *"
GENERIC_REPLY = (
    "Hey there! 👋 I'm here to help with your laptop health.\n\n"
    "You can ask me about things like:\n"
    "• *Memory usage* — how to free up RAM\n"
    "• *Startup speed* — how to speed up boot time\n"
    "• *System performance* — how to reduce memory pressure\n"
    "• *Battery health* — what to do if your battery is degrading\n\n"
    "What's on your mind?"
)


def alert_body(first_name: Column, device: Column, items: Column) -> Column:
    """Text of a first alert from its item blocks."""
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("Hey "), first_name, F.lit(" 👋")),
        F.concat(F.lit(ALERT_INTRO), device, F.lit(ALERT_INTRO_END)),
        F.array_join(items, "\n\n"),
        F.lit(ALERT_OUTRO),
    )


def still_at_risk_body(items: Column) -> Column:
    """Text of the follow-up while risk factors remain."""
    return F.concat_ws("\n\n", F.lit(STILL_AT_RISK_INTRO), F.array_join(items, "\n\n"), F.lit(STILL_AT_RISK_OUTRO))


def fallback_summary(device: Column, labels: Column) -> Column:
    """One-line alert summary."""
    return F.concat(F.lit("Laptop health alert for "), device, F.lit(": "), F.array_join(labels, ", "))


def match_keyword(message: Column, keywords: Sequence[tuple[str, str]] = tuple(MESSAGE_KEYWORDS)) -> Column:
    """Metric of the first keyword the message contains, else NULL."""
    text = F.lower(message)
    out = F.lit(None).cast("string")
    for keyword, metric in reversed(list(keywords)):
        out = F.when(text.contains(keyword), F.lit(metric)).otherwise(out)
    return out


def device_in_message(message: Column, default: str = "your device") -> Column:
    """Device name between single asterisks."""
    found = F.regexp_extract(message, r"(?U)\*([\w\s\-]+)\*", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(default))


def action_kind(action: Column) -> Column:
    """Part of an action id before the double underscore, where the id is a known pattern."""
    return F.nullif(F.regexp_extract(action, r"^(opt_out_reason|opt_out|done_selfservice|done_replacement)__(.+)$", 1), F.lit(""))


def action_argument(action: Column) -> Column:
    """Metric or reason carried by an action id; a skipped reason reads ``no_reason_given``."""
    argument = F.nullif(F.regexp_extract(action, r"^(opt_out_reason|opt_out|done_selfservice|done_replacement)__(.+)$", 2), F.lit(""))
    skipped = (action_kind(action) == "opt_out_reason") & (argument == "skip")
    return F.when(skipped, F.lit("no_reason_given")).otherwise(argument)


def first_name_of(first_name: Column, real_name: Column) -> Column:
    """First name from the profile, else the first word of the full name."""
    return F.coalesce(F.nullif(first_name, F.lit("")), F.nullif(F.split_part(F.trim(real_name), F.lit(" "), F.lit(1)), F.lit("")))


def decode_key(key: Column) -> Column:
    """Object key with ``+`` and percent escapes decoded."""
    return F.url_decode(key)


# Any line break, and the three separator characters Python also splits on.
LINE_END = r"\R|[\u001c-\u001e]"


# A lone star is a sign of italics only while bold text still has two; so italics come first.
INLINE = [(r"(?<!\*)\*(?!\*)([^*]+)(?<!\*)\*(?!\*)", "_$1_"), (r"(\*\*|__)(.+?)\1", "*$2*"), (r"(?U)^(\s*)-\s+", "$1• ")]


def chat_markup(text: Column) -> Column:
    """Markdown article to chat markup.

    Headings of up to three signs and bold text become ``*x*``, italics ``_x_``, dashes of a list bullets; a rule
    becomes an empty line. The text of a heading is left as it is. Blank ends are cut off.
    """
    def line(one: Column) -> Column:
        marks = F.char_length(F.regexp_extract(one, r"(?U)^(#*)\s", 1))
        plain = F.regexp_replace(one, r"(?U)\s", "")
        inline = one
        for pattern, instead in INLINE:
            inline = F.regexp_replace(inline, pattern, instead)
        return (F.when(marks.between(1, 3), F.concat(F.lit("*"), F.trim(F.regexp_replace(one, r"(?U)^#+\s+", "")), F.lit("*")))
                .when((F.char_length(plain) > 2) & one.rlike(r"(?U)^\s*-+\s*$"), F.lit(""))
                .otherwise(inline))

    lines = F.transform(F.split(text, LINE_END), line)
    return F.regexp_replace(F.array_join(lines, "\n"), r"(?U)^\s+|\s+$", "")
