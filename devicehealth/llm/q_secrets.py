"""Query of the secret scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from devicehealth.llm.registry import query, table
from devicehealth.llm.secrets import ACCESS, ALLOW, ASSIGN, CLASSES, HEX, KINDS, WINDOW, as_text, redacted, scanned


def _sql() -> str:
    """Base spans from the gaps between matches; long strings cut at base spans and at parts that hold a placeholder; windows each with its own entropy."""
    def quoted(text):
        return "'" + text.replace("'", "''") + "'"

    def matches(kind, pattern, group):
        p = quoted(pattern)
        return (f"select rn, {kind} as kind, string_split_regex(t, {p}) as gaps, regexp_extract_all(t, {p}) as found, "
                f"regexp_extract_all(t, {p}, {group}) as v from d where regexp_matches(t, {p})")

    def either(patterns):
        return "|".join(f"(?:{p})" for p in patterns)

    marks, whole = [a for a in ALLOW if not a.startswith("^")], [a for a in ALLOW if a.startswith("^")]
    (long_form, _, base64_bits), (hex_form, _, hex_bits) = CLASSES["base64"], CLASSES["hex"]
    names = ", ".join(quoted(k) for k in KINDS)
    written = "string_agg(([" + names + "])[kind + 1] || ':' || s || ':' || e, ',' order by s, kind)"
    return f"""
with d as (select doc_id, coalesce(text, '') as t, row_number() over () as rn from documents),
hits as ({matches(0, ASSIGN, 2)} union all {matches(1, ACCESS, 0)} union all {matches(2, HEX, 0)} union all {matches(3, long_form, 0)}),
each as (select *, unnest(range(1, len(found) + 1)) as i from hits),
placed as (select rn, kind, found[i] as whole, v[i] as value, cast(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) as bigint) as s from each),
base as (select rn, kind, s, s + length(whole) as e from placed where kind < 3 and (kind > 0 or length(value) >= 6)),
long as (select rn, s, value, s + length(whole) as e from placed where kind = 3),
pieces as (select rn, s, string_split_regex(value, '[A-Za-z0-9+]+') as gaps, regexp_extract_all(value, '[A-Za-z0-9+]+') as found from long where regexp_matches(value, {quoted(either(marks))})),
part as (select *, unnest(range(1, len(found) + 1)) as i from pieces),
marked as (select rn, s, found[i] as v, s + cast(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) as bigint) as cs
  from part where regexp_matches(found[i], {quoted(either(marks))})),
cuts as (select l.rn, l.s, b.s as cs, b.e as ce from long l join base b on b.rn = l.rn and b.s < l.e and l.s < b.e union all select rn, s, cs, cs + length(v) from marked
  union all select rn, s, e, e from long),
left_over as (select rn, s, cs, greatest(s, coalesce(max(ce) over (partition by rn, s order by cs, ce rows between unbounded preceding and 1 preceding), s)) as at from cuts),
stretch as (select x.rn, x.at as s, substr(l.value, x.at - l.s + 1, x.cs - x.at) as value from left_over x join long l using (rn, s) where x.cs - x.at >= {WINDOW}),
free as (select *, case when regexp_full_match(value, {quoted(hex_form)}) then {hex_bits} else {base64_bits} end as bits from stretch where not regexp_matches(value, {quoted(either(whole))})),
windows as (select rn, s, bits, value, unnest(range(0, length(value) - {WINDOW} + 1)) as k from free),
hot as (select rn, s, k from windows where list_aggregate(string_split(substr(value, k + 1, {WINDOW}), ''), 'entropy') >= bits),
added as (select rn, 3 as kind, s + min(k) as s, s + max(k) + {WINDOW} as e from hot group by rn, s),
b as (select rn, count(*) filter (where kind = 0) as n_assign, count(*) filter (where kind = 1) as n_access, count(*) filter (where kind = 2) as n_hex, {written} as spans from base group by rn),
a as (select rn, {written} as spans from (select rn, kind, s, e from base union all select rn, kind, s, e from added) group by rn)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(b.spans, '')) as base_sha256, coalesce(a.spans, '') as spans
from d left join b using (rn) left join a using (rn)"""


@query("op7_secret_scans", _sql())
def op7_secret_scans(spark, sf_dir):
    found = scanned(table(spark, sf_dir, "documents", "doc_id", "text"))
    counts = [F.size(f"__dh_{k}").cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(as_text(F.col("__dh_base")), 256).alias("base_sha256"),
                        as_text(F.concat("__dh_base", "__dh_added")).alias("spans"))


def masked_documents(docs):
    """Documents with their secrets masked and ``n_chars`` counted anew where the text has changed."""
    clean = redacted(docs.withColumn("__dh_before", F.col("text")))
    changed = ~F.col("text").eqNullSafe(F.col("__dh_before"))
    return clean.withColumn("n_chars", F.when(changed, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)
