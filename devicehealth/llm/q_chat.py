"""Query of the chat formatting: the turns of the conversations stand in for calls and results."""

from __future__ import annotations

from pyspark.sql import functions as F

from devicehealth.llm.chat import linked
from devicehealth.llm.registry import query, table

SCHEMAS = [("answer", "question", "string", True), ("answer", "words", "integer", True), ("answer", "after", "string", False)]

SQL = r"""
with m as (select conv_id, turn, role, text, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as n from conversations),
calls as (select *, 'c' || turn as id, case when turn >= 2 then 'c' || (turn - 2) end as needed from m where role = 'user'),
results as (select *, 'c' || (turn - 1) as id from m where role = 'assistant'),
levels as (
  with recursive l as (
    select conv_id, turn, 0::bigint as level from calls c where not exists (select 1 from calls d where d.conv_id = c.conv_id and d.id = c.needed)
    union all select c.conv_id, c.turn, l.level + 1 from calls c join l on l.conv_id = c.conv_id and l.turn = c.turn - 2)
  select * from l),
q as (select c.*, l.level, exists (select 1 from results r where r.conv_id = c.conv_id and r.id = c.id) as answered,
  exists (select 1 from calls d where d.conv_id = c.conv_id and d.id = c.needed) as there from calls c join levels l using (conv_id, turn))
select conv_id, turn, 'call' as kind, id as call_id, 2 * level as step, case when answered then 'linked' else 'unanswered' end as status,
  concat_ws('; ', case when n < 5 then 'missing question' end, case when n > 60 then 'type words' end, case when needed is not null and not there then 'no call ' || needed end) as problems,
  '{"arguments":{' || case when needed is not null then '"after":"${' || needed || '}",' else '' end || case when n >= 5 then '"question":' || to_json(text)::varchar || ',' else '' end
  || '"words":' || case when n > 60 then '"' || n || '"' else n::varchar end || '},"id":"' || id || '","kind":"call","name":"answer"}' as json
from q
union all
select r.conv_id, r.turn, 'result', r.id, 2 * l.level + 1, case when l.level is null then 'orphan' else 'linked' end, '',
  '{"content":' || to_json(r.text)::varchar || ',"id":"' || r.id || '","kind":"result","name":' || case when l.level is null then 'null' else '"answer"' end || '}'
from results r left join levels l on l.conv_id = r.conv_id and l.turn = r.turn - 1
union all
select conv_id, turn, 'message', null, null, 'plain', '', '{"content":' || to_json(text)::varchar || ',"kind":"message","role":' || to_json(role)::varchar || '}'
from m where role not in ('user', 'assistant')
"""


def as_tool_messages(turns):
    """A user turn becomes a call of the tool ``answer`` that refers to the call two turns before, an assistant turn the
    result of the call before it; other turns stay. A question of few words is left out, the number of many is a text, so that some fail their check."""
    n = F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    number = lambda back: F.concat(F.lit("c"), (F.col("turn") - back).cast("string"))
    after = F.when(F.col("turn") >= 2, F.concat(F.lit("${"), number(2), F.lit("}")))
    question = F.when(n >= 5, F.col("text"))
    some = [F.struct(F.when(n <= 60, n).alias("words"), question.alias("question"), after.alias("after")),
            F.struct(question.alias("question"), n.cast("string").alias("words"), after.alias("after"))]
    call = [F.to_json(F.struct(F.array(F.struct(number(0).alias("id"), F.lit("answer").alias("name"), a.alias("arguments"))).alias("tool_calls"))) for a in some]
    result = F.to_json(F.struct(number(1).alias("tool_call_id"), F.col("text").alias("content")))
    is_call, is_result = F.col("role") == "user", F.col("role") == "assistant"
    return turns.select("conv_id", "turn", F.when(is_call, "assistant").when(is_result, "tool").otherwise(F.col("role")).alias("role"),
                        F.when(is_call & (n > 60), call[1]).when(is_call, call[0]).when(is_result, result).otherwise(F.col("text")).alias("text"))


@query("op4_chat_formatting", SQL)
def op4_chat_formatting(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return linked(as_tool_messages(turns), spark.createDataFrame(SCHEMAS, "name string, parameter string, type string, required boolean"))
