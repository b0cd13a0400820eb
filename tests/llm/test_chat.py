"""Tool-call linking on hand-made conversations; the query has SQL."""

import json

from compare import compare, connect
from devicehealth.llm.catalog import ORACLES, QUERIES
from devicehealth.llm.chat import linked

SCHEMAS = [("f", "x", "integer", True), ("f", "y", "string", False), ("g", "o", "object", True), ("g", "l", "array", False), ("g", "b", "boolean", False), ("g", "n", "number", False), ("none", None, None, None)]


def call(i, name, arguments):
    return {"id": i, "name": name, "arguments": arguments}


def run(spark, rows):
    turns = spark.createDataFrame([(*r, "extra", "extra") for r in rows], "conv_id long, turn long, role string, text string, step string, json string")
    schemas = spark.createDataFrame(SCHEMAS, "name string, parameter string, type string, required boolean")
    return [r.asDict() for r in linked(turns, schemas).collect()]


def test_links_order_checks_and_canonical_json(spark):
    calls = lambda *c: json.dumps({"tool_calls": list(c)})
    result = lambda i, c: json.dumps({"tool_call_id": i, "content": c})
    rows = [(1, 0, "user", "hi \"you\"\n"), (1, 1, "assistant", calls(call("a", "f", {"y": "é", "x": 1}), call("b", "g", {"o": {"k": [1, 2.50], "a": None}, "from": "${a}"}))),
            (1, 2, "tool", result("b", "B")), (1, 3, "tool", result("a", "A")), (1, 4, "tool", result("a", "again")), (1, 5, "tool", result("zz", "?")),
            (1, 6, "assistant", calls(call("a", "f", {"x": "text", "y": 5}), call("c", "h", {}), call("d", "f", {"y": "${nope} ${b}"}))),
            (2, 0, "assistant", calls(call("p", "g", {"o": "${q}"}), call("q", "g", {"o": {"v": "${p}"}}), call(None, "f", {"x": 1}))), (2, 1, "tool", result("p", "P")),
            (2, 2, "assistant", "plain {"), (2, 3, "tool", "not json"), (2, 4, "assistant", None), (2, 5, "user", ""), (None, 0, "assistant", calls(call("a", "none", {}))),
            (None, None, "tool", result("a", "N")), (3, 0, "assistant", '{"tool_calls": [{"id": "r", "name": "f", "arguments": {"x": 1, "x": 2}}]}'),
            (3, 1, "assistant", '{"tool_calls": [{"id": "s", "name": "f", "arguments": [1]}]}')]
    got = run(spark, rows)
    assert len(got) == 22
    by = {(r["conv_id"], r["turn"], r["kind"], r["call_id"]): r for r in got}
    a, b = by[1, 1, "call", "a"], by[1, 1, "call", "b"]
    assert a["json"] == '{"arguments":{"x":1,"y":"é"},"id":"a","kind":"call","name":"f"}' and a["status"] == "linked" and a["problems"] == "" and a["step"] == 0
    assert b["json"].startswith('{"arguments":{"from":"${a}","o":{"a":null,"k":[1,2.5]}}') and b["step"] == 2 and b["problems"] == "unknown from"
    assert by[1, 2, "result", "b"]["step"] == 3 and by[1, 3, "result", "a"]["step"] == 1 and by[1, 4, "result", "a"]["status"] == "duplicate"
    assert by[1, 5, "result", "zz"]["status"] == "orphan" and json.loads(by[1, 5, "result", "zz"]["json"])["name"] is None
    assert by[1, 6, "call", "a"]["status"] == "duplicate" and by[1, 6, "call", "a"]["problems"] == "type x; type y"
    assert by[1, 6, "call", "c"]["problems"] == "unknown tool" and by[1, 6, "call", "c"]["status"] == "unanswered"
    assert by[1, 6, "call", "d"]["problems"] == "missing x; no call nope" and by[1, 6, "call", "d"]["step"] == 4
    assert by[2, 0, "call", "p"]["status"] == by[2, 0, "call", "q"]["status"] == "cyclic" and by[2, 0, "call", "p"]["problems"] == "type o"
    assert by[2, 0, "call", None]["status"] == "unanswered" and by[2, 1, "result", "p"]["status"] == "linked"
    assert {r["json"] for r in got if r["conv_id"] == 2 and r["kind"] == "message"} == {
        '{"content":"plain {","kind":"message","role":"assistant"}', '{"content":"not json","kind":"message","role":"tool"}',
        '{"content":null,"kind":"message","role":"assistant"}', '{"content":"","kind":"message","role":"user"}'}
    assert by[1, 0, "message", None]["json"] == '{"content":"hi \\"you\\"\\n","kind":"message","role":"user"}'
    assert by[None, 0, "call", "a"]["status"] == "linked" and by[None, None, "result", "a"]["status"] == "linked"
    assert by[3, 0, "call", "r"]["problems"] == by[3, 1, "call", "s"]["problems"] == "arguments are no object"
    for r in got:
        assert json.loads(r["json"])


def test_repeated_rows_and_no_rows(spark):
    text = json.dumps({"tool_calls": [call("a", "f", {"x": 1})]})
    got = run(spark, [(1, 0, "assistant", text)] * 2)
    assert [r["status"] for r in got] == ["unanswered"] * 2
    assert run(spark, []) == []


def test_query_matches_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    rows, _, problem = compare(spark, connect(sf), "op4_chat_formatting", QUERIES["op4_chat_formatting"], ORACLES["op4_chat_formatting"], sf)
    assert problem is None and rows > 0


def test_quality_query_matches_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    rows, _, problem = compare(spark, connect(sf), "op8_quality_rules", QUERIES["op8_quality_rules"], ORACLES["op8_quality_rules"], sf)
    assert problem is None and rows > 0


def test_long_chains_cycles_and_fans_in_few_jobs(spark):
    """A chain of 1,000 calls, one where each call needs the two before it, a fan, and a cycle behind a chain with calls that wait for it."""
    say = lambda i, *needs: json.dumps({"tool_calls": [call(i, "g", {"o": {}, "l": [f"${{{n}}}" for n in needs]})]})
    rows = [(1, k, "assistant", say(f"c{k}", *([f"c{k - 1}"] if k else []))) for k in range(1000)]
    rows += [(2, k, "assistant", say(f"c{k}", *(f"c{j}" for j in (k - 1, k - 2) if j >= 0))) for k in range(200)]
    rows += [(3, k, "assistant", say(f"c{k}")) for k in range(200)] + [(3, 200, "assistant", say("top", *(f"c{k}" for k in range(200)))), (3, 201, "assistant", say("over", "top", "c3"))]
    rows += [(4, k, "assistant", say(f"c{k}", *([f"c{k - 1}"] if k else []))) for k in range(20)]
    rows += [(4, 20, "assistant", say("p", "c19", "q")), (4, 21, "assistant", say("q", "r")), (4, 22, "assistant", say("r", "p", "c2")), (4, 23, "assistant", say("s", "r", "c1")), (4, 24, "assistant", say("t", "c3"))]
    rows += [(5, 0, "assistant", say("self", "self"))]
    spark.sparkContext.setJobGroup("chat", "levels")
    got = {(r["conv_id"], r["call_id"]): (r["step"], r["status"]) for r in run(spark, rows)}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chat"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [got[1, f"c{k}"][0] for k in range(1000)] == [2 * k for k in range(1000)]
    assert [got[2, f"c{k}"][0] for k in range(200)] == [2 * k for k in range(200)]
    assert {got[3, f"c{k}"][0] for k in range(200)} == {0} and got[3, "top"][0] == 2 and got[3, "over"][0] == 4
    assert [got[4, f"c{k}"][0] for k in range(20)] == [2 * k for k in range(20)] and got[4, "t"] == (8, "unanswered")
    assert {got[c] for c in [(4, "p"), (4, "q"), (4, "r"), (4, "s"), (5, "self")]} == {(None, "cyclic")}
    assert jobs < 400
