"""Query of the quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from devicehealth.llm.quality import OWN, judged
from devicehealth.llm.registry import query, table

SQL = r"""
with docs as (select doc_id, source, coalesce(text, '') as text, row_number() over () as rn from documents),
tok as (select rn, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from docs),
words as (select rn, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos from tok),
wins as (select a.rn, a.pos, a.word as w1, b.word as w2, c.word as w3 from words a join words b on b.rn = a.rn and b.pos = a.pos + 1 join words c on c.rn = a.rn and c.pos = a.pos + 2),
twice as (select rn, unnest(list(pos)) as pos from wins group by rn, w1, w2, w3 having count(*) > 1),
covered as (select rn, count(distinct p) as n from (select rn, unnest([pos, pos + 1, pos + 2]) as p from twice) group by rn),
lines as (select rn, unnest(string_split(text, chr(10))) as line from docs),
linecounts as (select rn, count(*) as n_lines, count(*) - count(distinct line) as n_dup from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by rn),
counts as (select d.rn, d.doc_id, d.source, len(t.w) as n_words, list_sum(list_transform(t.w, lambda x: length(x))) as wc,
  length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(l.n_dup, 0) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words, coalesce(l.n_lines, 0) as n_lines
  from docs d join tok t using (rn) left join linecounts l using (rn) left join covered c using (rn)),
feats as (select rn, doc_id, source, n_words, coalesce(wc, 0) as word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines from counts),
flags as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  (100 * n_repeat_words > 20 * n_words)::int + (10 * n_symbols > n_words)::int + (10 * n_dup_lines > 3 * n_lines)::int + (word_chars < 2 * n_words or word_chars > 25 * n_words)::int as failures from feats),
hosts as (select source as host, count(*)::double as docs, sum((base_failed or failures > 0)::int)::double as failed from flags group by source),
pooled as (select sum(docs) as n, sum(failed) as k, count(*) as h, sum(failed * failed / docs) as q, sum(docs * docs) as nn, (sum(failed) + 1) / (sum(docs) + 2) as m from hosts),
spread as (select *, case when h > 1 and n - nn / n > 0 then greatest(0, (q - k * k / n - (h - 1) * m * (1 - m)) / (n - nn / n)) else 0 end as v from pooled),
prior as (select m, case when v > 0 then least(1e6, greatest(2.0, m * (1 - m) / v - 1)) else 1e6 end as s from spread),
rates as (select host, m, (failed + m * s) / (docs + s) as rate from hosts, prior),
trusted as (select host, (2.0::double * rate <= m)::int + (4.0::double * rate <= m)::int as granted from rates)
select f.doc_id, f.n_words::bigint as n_words, f.word_chars::bigint as word_chars, f.n_symbols::bigint as n_symbols, f.n_dup_lines::bigint as n_dup_lines,
  f.n_repeat_words::bigint as n_repeat_words, f.base_failed, not f.base_failed and f.failures <= t.granted as kept
from flags f join trusted t on f.source is not distinct from t.host
"""


@query("op8_quality_rules", SQL)
def op8_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    found = judged(docs, drop_text=True)
    counts = [F.col(f"{OWN}{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return found.select("doc_id", *counts, F.col(f"{OWN}base_failed").alias("base_failed"), F.col(f"{OWN}kept").alias("kept"))
