"""Near-duplicate texts against a comparison of all pairs."""

import re
from itertools import combinations

import pyarrow.parquet as pq
import pytest

from devicehealth.llm import near_text
from devicehealth.llm.near_text import near_duplicates, without_near_duplicates

SCHEMA = "doc_id long, text string, bands string, n string"


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    at = {i: i for i in sets}

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            at[y] = x
    return {i: (len(s), top(i), top(i) == i) for i, s in sets.items()}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("percent", [80, 85])
def test_all_pairs_on_documents(spark, percent):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"])
    rows = list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert result(near_duplicates(docs, percent=percent)) == brute(rows, percent)


def test_chain_of_near_copies_in_one_crowded_bucket(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[i:i + 150])) for i in range(40)] + [(100 + i, " ".join(words[:100]) + f" x{i}") for i in range(30)]
    got = result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85))
    assert got == brute(rows, 85)


def test_odd_rows(spark):
    long_text = " ".join(f"v{i % 9973}" for i in range(300_000))
    rows = [(1, None, "x", "y"), (2, "", None, None), (3, " \t\n", "x", "y"), (4, "One two", "x", "y"), (5, "one TWO", "x", "y"), (6, "one two", "x", "y"),
            (7, long_text, "x", "y"), (8, long_text + " end", "x", "y"), (9, "Ä b c d e", "x", "y"), (10, "ä b c d e", "x", "y"),
            (None, "one two", "x", "y"), (None, None, "x", "y"), (6, "one two", "x", "y")]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), percent=85)
    named = result(got.where("doc_id is not null"))
    assert named == brute([r[:2] for r in rows if r[0] is not None], 85)
    assert got.where("doc_id is null and component_id is null and kept").count() == 2
    kept = without_near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "bands", "n"]
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 7, 9, 10]


def test_no_rows(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_finished_shuffles_are_let_go_before_pairs_are_compared(spark, monkeypatch):
    calls = []
    compared, let_go = near_text._compared, near_text.let_go
    monkeypatch.setattr(near_text, "let_go", lambda session: calls.append("go") or let_go(session))
    monkeypatch.setattr(near_text, "_compared", lambda *a: calls.append("compare") or compared(*a))
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, "quite another text of a few words")], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in near_text.near_duplicates(docs, percent=85).collect()}
    assert found == {1: 1, 2: 1, 3: 3}
    assert calls.index("compare") >= 3
