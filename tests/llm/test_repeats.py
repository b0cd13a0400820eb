"""Repeated byte strings against a table of all of them."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from devicehealth.llm import repeats
from devicehealth.llm.q_repeats import op11_suffix_array_dedup


def brute(texts, window):
    """``[(bytes, runs of covered bytes, kept bytes)]`` of the texts."""
    texts = [(t or "").encode() for t in texts]
    starts = Counter(t[i:i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - window + 1):
            if starts[t[i:i + window]] > 1:
                gone[i:i + window] = True
        edge = np.flatnonzero(gone != np.concatenate([[False], gone[:-1]]))
        out.append((len(t), edge.reshape(-1, 2).tolist(), bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])))
    return out


def result(spark, texts, **sizes):
    df = spark.createDataFrame([(i, t, 0, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, k1 int, spans string, fp string").repartition(4)
    got = {r.doc_id: (r.n_bytes, [[s.start, s.end] for s in r.spans], bytes(r.kept)) for r in repeats.repeated_spans(df, **sizes).collect()}
    return [got[i] for i in range(len(texts))]


def made(n, seed):
    """Texts with shared passages, edited copies, exact copies and runs, over a small alphabet so that short strings meet by chance."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abé ") for _ in range(k))
    passages = [word(rng.randint(40, 160)) for _ in range(6)]
    out = []
    for _ in range(n):
        t = "".join(rng.choice([word(rng.randint(5, 90)), rng.choice(passages), rng.choice(passages)[:rng.randint(20, 80)]]) for _ in range(rng.randint(0, 6)))
        out.append(t)
        if out and rng.random() < 0.3:
            base = rng.choice(out)
            at = rng.randint(0, len(base))
            out.append(base[:at] + rng.choice(["", "x", "yz"]) + base[at:])
    return out + [None, "", "a" * 300, "a" * 39, "ab" * 200, passages[0], passages[0]]


def test_collection_is_sorted_with_its_common_prefixes():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 12, 60)
    symbols = rng.integers(0, 3, sizes.sum()).astype(np.uint64)
    order, prefixes, before = repeats.collection(symbols, sizes, 100)
    ends = np.repeat(np.cumsum(sizes), sizes)
    firsts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    suffix = lambda i: tuple(symbols[i:ends[i]].tolist())
    assert sorted(order.tolist()) == list(range(len(symbols)))
    assert [suffix(i) for i in order] == sorted(suffix(i) for i in order)
    for k in range(1, len(order)):
        a, b = suffix(order[k - 1]), suffix(order[k])
        assert prefixes[k] == next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    names = {v: i + 1 for i, v in enumerate(np.unique(symbols).tolist())}
    assert before.tolist() == [0 if i == firsts[i] else names[int(symbols[i - 1])] for i in order]


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, seed):
    texts = made(120, seed)
    assert result(spark, texts, window=40, gram=8, symbol=5) == brute(texts, 40)


def test_an_anchor_dealt_over_collections(spark, monkeypatch):
    """Many texts that share a passage with different surroundings: the anchors at its edges have more pieces than a collection takes."""
    monkeypatch.setattr(repeats, "GROUP", 5)
    monkeypatch.setattr(repeats, "SHARE", 4)
    rng = random.Random(9)
    word = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    passage, left = word(90), [word(50) for _ in range(7)]
    texts = [rng.choice(left)[rng.randint(0, 30):] + word(rng.randint(0, 3)) + passage[rng.randint(0, 20):] + word(30) for _ in range(150)]
    assert result(spark, texts, window=40, gram=8, symbol=8) == brute(texts, 40)


def test_long_texts_are_cut_in_slabs(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SLAB", 1000)
    rng = random.Random(5)
    word = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    inner = word(300)
    texts = [word(900) + inner + word(1700) + inner[10:] + word(20), word(33) + inner[:200], word(400_000)]
    assert result(spark, texts, window=40, gram=8, symbol=10) == brute(texts, 40)


def test_query_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    table = pq.read_table(f"{sf}/documents.parquet")
    want = {i: (n, sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept).hexdigest())
            for i, (n, spans, kept) in zip(table["doc_id"].to_pylist(), brute(table["text"].to_pylist(), 400))}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op11_suffix_array_dedup(spark, sf).collect()}
    assert got == want and sum(x[1] for x in got.values()) > 0


def test_null_ids_repeated_rows_and_no_rows(spark):
    text = "0123456789" * 3 + "abcdefghijklmnopqrstuvwxyz"
    df = spark.createDataFrame([(None, text), (None, text), (1, "short")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, len(r.spans), bytes(r.kept)) for r in repeats.repeated_spans(df, window=40, gram=8, symbol=8).collect())
    assert got == [(0, 1, b""), (0, 1, b""), (1, 0, b"short")]
    assert repeats.repeated_spans(df.limit(0)).count() == 0
