"""Quality rules against plain Python, and the host verdicts."""

import re
from collections import Counter

import pyarrow.parquet as pq

from devicehealth.llm.q_quality import op8_quality_rules
from devicehealth.llm.quality import GRANTED, OWN, host_rates, judged, quality_filter, with_counts


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines))


ODD = [None, "", "\n\n", "a", " a\n\na\na\n b", "a b c a b c", "x\ty\vz\fq\rr s  t", "é # * $$ %&|<>\n é # * $$ %&|<>", "same line\nsame line\n", "a a a a a",
       "w " * 100_000, "\n".join(f"line {i}" for i in range(20_000)), "\x1c \x85", "end\n", "\na"]


def test_counts_of_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(ODD * 2)], "doc_id long, text string, n_words string, host string")
    for r in with_counts(docs).collect():
        assert tuple(r[f"{OWN}{c}"] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")) == counts(r.text), repr(r.text)[:80]
    assert with_counts(docs).columns[:4] == docs.columns


def test_query_on_documents(spark):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"])
    texts = dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))
    rows = op8_quality_rules(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n[:5]
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r.base_failed and r.kept)


def text(i, lines=False, symbols=False):
    """Clean words; or every other line the same one word; or with signs."""
    if lines:
        return "\n".join(f"x\nw{i}q{k} w{i}r{k} w{i}s{k}" for k in range(20))
    return " ".join(f"w{i}q{k}{'#' if symbols and k % 3 == 0 else ''}" for k in range(60))


def verdicts(rows):
    """Ids kept, rates and grants, in plain Python."""
    def failed(t):
        n, chars, signs, dup, rep, lines = counts(t)
        base = [n < 50, 100 * rep > 50 * n]
        return base, [100 * rep > 20 * n, 10 * signs > n, 10 * dup > 3 * lines, chars < 2 * n or chars > 25 * n]

    hosts = {}
    for _, t, h in rows:
        docs, bad = hosts.get(h, (0, 0))
        hosts[h] = docs + 1, bad + any(map(any, failed(t)))
    n, k = sum(d for d, _ in hosts.values()), sum(b for _, b in hosts.values())
    m = (k + 1) / (n + 2)
    spare = n - sum(d * d for d, _ in hosts.values()) / n
    v = max(0.0, (sum(b * b / d for d, b in hosts.values()) - k * k / n - (len(hosts) - 1) * m * (1 - m)) / spare) if len(hosts) > 1 else 0.0
    s = min(1e6, max(2.0, m * (1 - m) / v - 1)) if v > 0 else 1e6
    rates = {h: (b + m * s) / (d + s) for h, (d, b) in hosts.items()}
    granted = {h: 2 if 4 * r <= m else 1 if 2 * r <= m else 0 for h, r in rates.items()}
    return {i for i, t, h in rows if not any(failed(t)[0]) and sum(failed(t)[1]) <= granted[h]}, rates, granted


def test_verdict_of_a_host_by_degrees(spark):
    rows = [(i, text(i, lines=i < 45), "bad") for i in range(50)] + [(100 + i, text(i, lines=i == 0, symbols=i == 1), "good") for i in range(50)] + [
        (200 + i, text(i), f"h{i}") for i in range(100)] + [(300, text(300, lines=True), "h0"), (301, text(301, lines=True), None), (302, None, "h1")] + [
        (1000 + i, text(i) if i else text(i, lines=True).replace("x", "x#$"), "best") for i in range(400)] + [(2000 + i, text(i, symbols=i < 20), "fair") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, want_rates, granted = verdicts(rows)
    kept = {r.doc_id for r in quality_filter(docs).collect()}
    assert kept == want
    assert granted["bad"] == granted["fair"] == 0 and granted["best"] == 2 and {granted[h] for h in granted} >= {0, 2}
    assert not kept & set(range(45)) and set(range(45, 50)) <= kept  # the clean ones of the bad host stay
    assert 1000 in kept and not kept & set(range(2000, 2020))  # one failure decides on a fair host, two are granted on the best
    rates = {r.host: r.rate for r in host_rates(with_counts(docs)).collect()}
    assert all(abs(rates[h] - want_rates[h]) < 1e-9 for h in want_rates) and 0.0 < rates["h5"]  # one clean document does not make a rate of 0


def test_hosts_decide_documents_of_the_shared_tables(spark):
    found = judged(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), drop_text=True)
    row = found.selectExpr(f"count_if(not {OWN}base_failed and {OWN}failures between 1 and {GRANTED} and {OWN}kept = ({OWN}granted >= {OWN}failures)) as decided", "count(*) as n").first()
    assert 0.02 * row.n < row.decided < 0.2 * row.n


def test_no_rows(spark):
    assert judged(spark.createDataFrame([], "text string, source string")).count() == 0
