"""Language identification: held-out accuracy, code lengths by hand, odd rows."""

import math
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from devicehealth.llm import langid
from devicehealth.llm.q_langid import op6_language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "lang"])
    truth = dict(zip(t["doc_id"].to_pylist(), t["lang"].to_pylist()))
    rows = op6_language_id(spark, SF).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert 0.15 < len(held) / len(rows) < 0.35
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_code_lengths_by_hand(spark):
    texts = [("abracadabra", "x"), ("abcabc", "x"), ("zzzz", "y")]
    model = langid.train(spark.createDataFrame(texts, "text string, lang string"), order=2, share=0.0)
    seen = [Counter() for _ in range(3)]
    for text, name in texts:
        if name == "x":
            data = "\n\n" + text
            for i in range(2, len(data)):
                for k in range(3):
                    seen[k][data[i - k:i + 1]] += 1

    def bits(gram):
        total = 0.0
        for k in (2, 1, 0):
            after = {g: n for g, n in seen[k].items() if g[:-1] == gram[2 - k:2]}
            t, d = sum(after.values()), len(after)
            n = seen[k].get(gram[2 - k:], 0)
            if n >= 2:  # a gram seen once is not held
                return total - math.log2(n / (t + d))
            if t >= 2 or k == 0:
                total -= math.log2((t + d - sum(v for v in after.values() if v >= 2)) / (t + d))
        return total + langid.UNIFORM

    j = model.languages.index("x")
    for gram in ("abr", "\n\na", "zab", "qqq", "cad"):
        code = np.array([sum(ord(c) << 8 * (2 - i) for i, c in enumerate(gram))], np.uint64)
        assert model.bits(code)[0, j] == pytest.approx(bits(gram), abs=1e-9), gram


def test_odd_rows(spark):
    learn = spark.createDataFrame([("the cat sat on the mat " * 20, "en"), ("der hund ist in dem haus " * 20, "de"), (None, "fr"), ("x y", None)], "text string, lang string")
    model = langid.train(learn)
    assert model.languages == ["de", "en"]
    rows = [(1, None), (2, ""), (3, "123 !? \n"), (4, "the mat"), (5, "dem hund"), (6, "漢字"), (7, "the cat " * 100_000), (4, "the mat"), (None, "dem haus")]
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, model string, codes int"), model).collect()]
    assert [g[1] for g in got] == ["und", "und", "und", "en", "de", got[5][1], "en", "en", "de"] and got[5][1] in ("en", "de")
    assert got[0][2] == got[2][2] == 0.0 and got[3] == got[7]
    nothing = langid.train(learn.where("false"))
    assert [r.lang_pred for r in langid.predict(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), nothing).collect()] == ["und"]
    assert langid.predict(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_columns_of_the_same_names_are_replaced(spark):
    model = langid.train(spark.createDataFrame([("the cat sat on the mat " * 20, "en"), ("der hund ist in dem haus " * 20, "de")], "text string, lang string"))
    docs = spark.createDataFrame([(1, "x", "dem hund", 7)], "doc_id long, lang_pred string, text string, Score long")
    found = langid.predict(docs, model)
    assert found.columns == ["doc_id", "text", "lang_pred", "score"]
    assert [(r.doc_id, r.lang_pred, 0.5 < r.score <= 1) for r in found.collect()] == [(1, "de", True)]
