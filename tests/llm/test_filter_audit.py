"""Filter interaction audit: SQL on the documents, a plain count on odd rows."""

import re
from collections import Counter
from itertools import permutations

from compare import compare, connect
from devicehealth.llm import filter_audit
from devicehealth.llm.catalog import ORACLES, QUERIES


def brute(docs, labels):
    fails = []
    for i, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
        f += "E" * (i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs))
        own = [(q, t) for j, q, t in labels if j is not None and j == i]
        fails.append((part or "", set(f), any(q == 1 for q, _ in own), any(t == 1 for _, t in own)))
    out = {}
    for part in {p for p, *_ in fails}:
        own, shapley = [x for x in fails if x[0] == part], Counter()
        for order in permutations("ABCDE"):
            for s, f in enumerate(order):
                before = set(order[:s])
                gone = [x for x in own if f in x[1] and not x[1] & before]
                shapley[f] += len(gone)
                out[part, "".join(order), s + 1] = [sum(not x[1] & (before | {f}) for x in own), len(gone), sum(f in x[1] and bool(x[1] & before) for x in own), sum(x[1] == {f} for x in own),
                                                    sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, s), row in out.items():
            if p == part:
                row.append(shapley[order[s - 1]])
    return out


def run(spark, docs, labels):
    d = spark.createDataFrame([(*x, 1, "x") for x in docs], "doc_id long, text string, source string, mask int, h string").repartition(3)
    got = filter_audit.filter_audit(d, spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, quality int, toxic int, good int")).collect()
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got}


LONG = " ".join(f"w{i}" for i in range(250))
DOCS = [(1, LONG, "a"), (2, LONG, "a"), (2, LONG, "a"), (3, LONG + " #", "b"), (4, "", None), (5, None, "b"), (6, "word " * 300, "a"), (None, LONG, "a"), (None, "x", ""), (7, "x", "a"),
        (8, LONG.upper(), "b"), (9, LONG.upper(), "a"), (9, "|", "a"), (10, "|", None), (0, "é" * 900, "b"), (11, " \t\n", "b")] + [(100 + i, "copied", "hot") for i in range(40)]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (6, None, 1), (None, 1, 1), (77, 1, 1), (100, 1, 0), (101, 1, 0), (9, 0, 1)]


def test_odd_rows(spark):
    assert run(spark, DOCS, LABELS) == brute(DOCS, LABELS)


def test_crowded_sketch_changes_nothing(spark, monkeypatch):
    """So few cells that unique texts meet others in them; and more cells than are sent to all tasks."""
    monkeypatch.setattr(filter_audit, "SHARD", 4)
    monkeypatch.setattr(filter_audit, "CELLS", 1)
    monkeypatch.setattr(filter_audit, "SENT", 1)
    assert run(spark, DOCS, LABELS) == brute(DOCS, LABELS)


def test_no_rows(spark):
    assert run(spark, [], LABELS) == {}


def test_the_sketch_clears_unique_texts(spark):
    df = spark.range(20_000).selectExpr("xxhash64(id % 19000) as h")
    shards = 1
    crowded = {r.cell for r in filter_audit.crowded_cells(df, shards).collect()}
    met = Counter()
    for r in df.collect():
        for c in {r.h & ((1 << 20) - 1), (r.h >> 20) & ((1 << 20) - 1)}:
            met[c] += 1
    assert crowded == {c for c, n in met.items() if n > 1}


def test_query_matches_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    rows, _, problem = compare(spark, connect(sf), "op13_filter_audit", QUERIES["op13_filter_audit"], ORACLES["op13_filter_audit"], sf)
    assert problem is None and rows > 0
