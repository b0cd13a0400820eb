"""Chat formatting in column expressions: tool calls linked with their results, ordered, checked and written as canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from devicehealth.session import cut_lineage, small

#: A reference inside arguments to the result of another call of the conversation.
REFERENCE = r"\$\{([A-Za-z0-9_.:-]+)\}"
_CALLS = "struct<tool_calls: array<struct<id: string, name: string, arguments: string>>>"
_RESULT = "struct<tool_call_id: string, content: string>"
#: Types of a schema, and how JSON values are named that have them.
TYPES = {"string": "^STRING$", "integer": r"^(BIGINT|DECIMAL\([0-9]+,0\))$", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": "^BOOLEAN$",
         "array": "^ARRAY", "object": "^OBJECT", "null": "^VOID$"}
_TURN = ["conv", "turn"]
#: Level of a call that waits for itself.
ENDLESS = 1 << 40


def canonical(text: Column) -> Column:
    """JSON with keys in order, no spaces and plain numbers; null where the text is no JSON or repeats a key."""
    return F.to_json(F.try_parse_json(text))


def _parsed(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    rows = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = rows.withColumn("calls", F.when(F.col("role") == "assistant", F.from_json("text", _CALLS)["tool_calls"]))
    return rows.withColumn("answer", F.when(F.col("role") == "tool", F.from_json("text", _RESULT)))


def _same(a: DataFrame, b: DataFrame, *columns: str) -> Column:
    condition = a["conv"].eqNullSafe(b["conv"])
    for c in columns:
        condition = condition & (a[c] == b[c])
    return condition


def _problems(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """The calls with ``problems``: what their arguments lack or have against the schema of their tool, in order."""
    tools = schemas.groupBy(F.col("name").alias("_tool")).agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct(
        F.coalesce("parameter", F.lit("")).alias("parameter"), F.struct("type", "required").alias("rule"))))).alias("_rules"))
    with_rules = calls.join(small(tools), calls["name"] == F.col("_tool"), "left")
    given = F.from_json("arguments", "map<string, variant>")
    types = F.map_from_entries(F.transform(F.map_entries(F.col("_given")), lambda e: F.struct(e["key"], F.schema_of_variant(e["value"]))))
    # Arguments that repeat a key have no canonical form and are refused as a whole.
    legal = F.col("_canonical").isNotNull() & F.col("_given").isNotNull()
    rules = F.filter(F.map_entries("_rules"), lambda r: r["key"] != "")
    wrong = F.concat(
        F.transform(F.filter(rules, lambda r: r["value"]["required"] & ~F.map_contains_key(F.col("_types"), r["key"])), lambda r: F.concat(F.lit("missing "), r["key"])),
        F.transform(F.filter(rules, lambda r: F.map_contains_key(F.col("_types"), r["key"]) & ~_fits(F.col("_types")[r["key"]], r["value"]["type"])),
                    lambda r: F.concat(F.lit("type "), r["key"])),
        F.transform(F.filter(F.map_keys("_types"), lambda k: ~F.map_contains_key(F.col("_rules"), k)), lambda k: F.concat(F.lit("unknown "), k)))
    found = with_rules.withColumn("_canonical", canonical(F.col("arguments"))).withColumn("_given", F.when(F.col("_canonical").isNotNull(), given)).withColumn("_types", types)
    problems = F.when(F.col("_rules").isNull(), F.array(F.lit("unknown tool"))).when(~legal, F.array(F.lit("arguments are no object"))).otherwise(F.array_sort(wrong))
    return found.withColumn("problems", problems).withColumn("arguments", F.coalesce("_canonical", _text("arguments"))).drop(
        "_tool", "_rules", "_canonical", "_given", "_types")


def _fits(kind: Column, wanted: Column) -> Column:
    out = F.lit(False)
    for name, pattern in TYPES.items():
        out = out | ((wanted == name) & kind.rlike(pattern))
    return out


def _levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """``(conv, id, level)``: 0 for a call that needs no result, else one more than the highest it needs; null for a call on
    a cycle or behind one.

    Every call points at the need that is highest so far, of equal ones at the last in the conversation, and the pointers are doubled: after k rounds one
    spans 2^k calls, so a chain takes as many rounds as its length has binary digits, whatever else it needs. The lengths are levels that some path has; where a call
    then has a higher need than the one it pointed at, pointers are set and doubled once more. A path longer than the conversation has calls is on a cycle.
    """
    needs = cut_lineage(needs)
    longest = calls.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    state = cut_lineage(calls.select("conv", "id", F.lit(0).cast("long").alias("level")))
    while True:
        below = state.select("conv", F.col("id").alias("needed"), F.col("level").alias("below"))
        known = needs.join(below, _same(needs, below, "needed")).select(needs["conv"], "id", needs["needed"], "place", "below")
        best = known.groupBy("conv", "id").agg(F.max(F.struct("below", "place", "needed")).alias("b"))
        best = cut_lineage(best.join(state, _same(best, state, "id")).select(best["conv"], best["id"], "level", F.col("b.needed").alias("next"), F.col("b.below").alias("below")))
        if best.where(F.least(F.col("below") + 1, F.lit(ENDLESS)) != F.col("level")).isEmpty():
            return state.withColumn("level", F.when(F.col("level") < ENDLESS, F.col("level")))
        endless = F.col("below") == ENDLESS
        paths = cut_lineage(best.select("conv", "id", F.when(~endless, F.col("next")).alias("next"), F.when(endless, ENDLESS).otherwise(1).cast("long").alias("w")))
        while not paths.where("next is not null").isEmpty():
            on = paths.select(F.col("conv").alias("of"), F.col("id").alias("through"), F.col("next").alias("after"), F.col("w").alias("more"))
            joined = paths.join(on, F.col("conv").eqNullSafe(F.col("of")) & (F.col("next") == F.col("through")), "left").select(
                "conv", "id", "after", (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"))
            over = F.col("w") > longest
            paths = cut_lineage(joined.select("conv", "id", F.when(~over, F.col("after")).alias("next"), F.when(over, F.lit(ENDLESS)).otherwise(F.col("w")).cast("long").alias("w")))
        state = cut_lineage(calls.join(paths, _same(calls, paths, "id"), "left").select(calls["conv"], calls["id"], F.coalesce("w", F.lit(0)).cast("long").alias("level")))


def linked(messages: DataFrame, schemas: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, turn, kind, call_id, step, status, problems, json)``: a row for each call, result and other message.

    Calls come in the text of assistant messages as ``{"tool_calls": [{"id", "name", "arguments"}]}``, results in that of tool messages as
    ``{"tool_call_id", "content"}``. A result is joined with the first call of its conversation that has its identifier. Sorted by
    ``step``, then turn, a conversation is in topological order: a call stands behind the results that its arguments
    refer to as ``${id}``, a result behind its call; other messages have no step and keep their turn. ``schemas(name, parameter, type,
    required)`` tell the arguments of each tool. ``json`` has keys in order and no spaces; a linked result carries its call's name.

    Status of a call: ``linked`` or ``unanswered``, ``duplicate`` if an earlier call has the identifier, ``cyclic`` if it waits for itself.
    Status of a result: ``linked``, ``orphan`` without a call, ``duplicate`` behind an earlier result. A call without an identifier is
    unanswered, a result without one an orphan. References to calls that are not there are a problem ``no call x`` and no need.

    Null or empty text, and text that is no such JSON: another message. A null conversation is one conversation; a null turn sorts
    first. Ties and repeated rows: equal calls at one turn are one identifier's first call alike. No rows: no rows. Other columns are not read.
    """
    rows = _parsed(messages, conv, turn, role, text)
    calls = rows.where("size(calls) > 0").select(*_TURN, F.posexplode("calls").alias("pos", "c")).select(
        *_TURN, "pos", F.col("c.id").alias("id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"))
    calls = cut_lineage(_problems(calls, schemas))
    results = cut_lineage(rows.where("role = 'tool' and answer is not null and (answer.tool_call_id is not null or answer.content is not null)").select(
        *_TURN, F.col("answer.tool_call_id").alias("id"), F.col("answer.content").alias("content")))
    place = F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))), F.col("pos"))
    first_call = calls.where("id is not null").groupBy("conv", "id").agg(F.min(F.struct(place.alias("at"), "name")).alias("call"))
    first_result = results.where("id is not null").groupBy("conv", "id").agg(F.min(F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62)))).alias("at"))
    refers = calls.where("id is not null").select("conv", "id", "turn", "pos", F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(REFERENCE), F.lit(1)))).alias("needed"))
    there = first_call.select("conv", F.col("id").alias("needed"), F.col("call.at").alias("there"))
    refers = refers.join(there, _same(refers, there, "needed"), "left").select(refers["conv"], "id", "turn", "pos", refers["needed"], "there")
    firsts = first_call.select("conv", "id", "call.at")
    needs = refers.where("there is not null").join(firsts, _same(refers, firsts, "id")).where(place == F.col("at")).select(
        refers["conv"], refers["id"], refers["needed"], F.col("there").alias("place")).distinct()
    levels = _levels(cut_lineage(first_call.select("conv", "id")), needs)
    lost = refers.where("there is null").groupBy("conv", "id", "turn", "pos").agg(
        F.sort_array(F.collect_set(F.concat(F.lit("no call "), F.col("needed")))).alias("lost"))

    c = calls.join(firsts, _same(calls, firsts, "id"), "left").select(calls["*"], "at")
    c = c.join(levels, _same(c, levels, "id"), "left").select(c["*"], "level")
    answered = first_result.select("conv", "id", F.lit(True).alias("answered"))
    c = c.join(answered, _same(c, answered, "id"), "left").select(c["*"], "answered")
    c = c.join(lost, _same(c, lost, "id", "pos") & c["turn"].eqNullSafe(lost["turn"]), "left").select(c["*"], "lost")
    status = F.when(F.col("id").isNull(), "unanswered").when(place != F.col("at"), "duplicate").when(F.col("level").isNull(), "cyclic").when(
        F.col("answered"), "linked").otherwise("unanswered")
    as_json = F.concat(F.lit('{"arguments":'), F.coalesce("arguments", F.lit("null")), F.lit(',"id":'), _text("id"), F.lit(',"kind":"call","name":'), _text("name"), F.lit("}"))
    problems = F.array_join(F.concat("problems", F.coalesce("lost", F.expr("cast(array() as array<string>)"))), "; ")
    called = c.select("conv", "turn", F.lit("call").alias("kind"), F.col("id").alias("call_id"), (F.col("level") * 2).alias("step"), status.alias("status"),
                      problems.alias("problems"), as_json.alias("json"))

    r = results.join(first_call, _same(results, first_call, "id"), "left").select(results["*"], "call")
    r = r.join(levels, _same(r, levels, "id"), "left").select(r["*"], "level")
    r = r.join(first_result, _same(r, first_result, "id"), "left").select(r["*"], "at")
    status = F.when(F.col("call").isNull(), "orphan").when(F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))) != F.col("at"), "duplicate").otherwise("linked")
    as_json = F.concat(F.lit('{"content":'), _text("content"), F.lit(',"id":'), _text("id"), F.lit(',"kind":"result","name":'), _text("call.name"), F.lit("}"))
    answers = r.select("conv", "turn", F.lit("result").alias("kind"), F.col("id").alias("call_id"), (F.col("level") * 2 + 1).alias("step"), status.alias("status"),
                       F.lit("").alias("problems"), as_json.alias("json"))

    plain = rows.where("not (coalesce(size(calls), 0) > 0) and not (coalesce(answer.tool_call_id, answer.content) is not null)")
    as_json = F.concat(F.lit('{"content":'), _text("text"), F.lit(',"kind":"message","role":'), _text("role"), F.lit("}"))
    others = plain.select("conv", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("long").alias("step"),
                          F.lit("plain").alias("status"), F.lit("").alias("problems"), as_json.alias("json"))
    return called.unionByName(answers).unionByName(others).withColumnsRenamed({"conv": conv, "turn": turn})


def _text(column: str) -> Column:
    """A JSON string, or null."""
    listed = F.to_json(F.array(F.col(column)))
    return F.when(F.col(column).isNull(), F.lit("null")).otherwise(F.substr(listed, F.lit(2), F.char_length(listed) - 2))
