"""Query of the filter interaction audit."""

from __future__ import annotations

from devicehealth.llm.filter_audit import filter_audit
from devicehealth.llm.registry import query, table

SQL = r"""
with recursive orders(filter_order) as (
  select '' union all select filter_order || f from orders, unnest(['A', 'B', 'C', 'D', 'E']) as t(f) where not contains(filter_order, f)),
steps as (select filter_order, s::integer as step, substr(filter_order, s, 1) as f, substr(filter_order, 1, s - 1) as earlier from orders, range(1, 6) as r(s) where length(filter_order) = 5),
texts as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
measured as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, length(regexp_replace(text, '[^A-Z]', '', 'g')) as upper, min(doc_id) over (partition by text) as first_id from texts),
failed as (select doc_id, part, case when len(words) < 200 then 'A' else '' end || case when 100 * len(list_distinct(words)) < 50 * len(words) then 'B' else '' end
  || case when 100 * upper > 2 * length(text) then 'C' else '' end || case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end || case when doc_id > first_id then 'E' else '' end as fails from measured),
marks as (select doc_id, max((quality = 1)::bigint) as good, max((toxic = 1)::bigint) as toxic from labels group by doc_id),
counts as (select part, fails, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from failed left join marks using (doc_id) group by part, fails),
told as (select part, filter_order, step, f,
    sum(case when not contains(fails, f) and translate(fails, earlier, '') = fails then n else 0 end) as kept,
    sum(case when contains(fails, f) and translate(fails, earlier, '') = fails then n else 0 end) as removed,
    sum(case when contains(fails, f) and translate(fails, earlier, '') <> fails then n else 0 end) as redundant,
    sum(case when fails = f then n else 0 end) as unique_fails,
    sum(case when contains(fails, f) and translate(fails, earlier, '') = fails then good else 0 end) as good_lost,
    sum(case when contains(fails, f) and translate(fails, earlier, '') = fails then toxic else 0 end) as toxic_lost
  from counts, steps group by part, filter_order, step, f)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost,
  toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, f))::bigint as shapley from told
"""


@query("op13_filter_audit", SQL)
def op13_filter_audit(spark, sf_dir):
    return filter_audit(table(spark, sf_dir, "documents", "doc_id", "text", "source"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))
