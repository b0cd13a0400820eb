"""Pipeline stages on small tables: what each keeps, and the whole against its parts."""

import re

import pyarrow.parquet as pq

import corpus_pipeline
from test_near_text import brute
from test_secrets import added, base
from test_tokens import check_packing

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def masked(text):
    spans = sorted((a, b) for a, _, b in base(text) + added(text, base(text)))
    out, at = [], 0
    merged = []
    for a, b in spans:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], "[SECRET]"]
        at = b
    return "".join([*out, text[at:]])


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = rows_of(docs)
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == COLUMNS
        got = rows_of(after)
        kept.append((name, before, got))
        if name == "toxicity":
            gone = before.keys() - got.keys()
            assert gone <= toxic or len(gone - toxic) <= 0.05 * len(before)
            assert all(re.search("idiot|scum|trash|stupid|pathetic|loser|worthless|moron|disgusting|clown", before[i].text.lower()) or i in toxic for i in gone)
        elif name == "quality":
            assert all(len((before[i].text or "").split()) >= 50 for i in got)
        elif name == "near_duplicates":
            named = brute([(i, r.text) for i, r in before.items()], 80)
            assert got.keys() == {i for i, (_, _, k) in named.items() if k}
        else:
            assert got.keys() == before.keys()
            for i, r in got.items():
                assert r.text == masked(before[i].text) and r.n_chars == (len(r.text) if r.text != before[i].text else before[i].n_chars)
        if name != "secrets":
            assert all(got[i] == before[i] for i in got)
        docs = spark.createDataFrame(after.collect(), after.schema)
        before = got
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    check_packing(rows, {i: r.text for i, r in before.items()}, 1024)
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows)


def test_odd_documents(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (2, None, None, "a", None), (3, "word " * 60, "en", "a", 300), (3, "word " * 60, "en", "a", 300),
            (4, " ".join(f"w{i}" for i in range(50_000)), "en", "a", 1), (5, " ".join(f"x{i}" for i in range(80)) + " token=abcdefgh1", "en", None, 400)]
    path = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(5, 0, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    got = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in got} == {4, 5}


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path / "sf")
    schema = pq.read_schema(f"{SF}/documents.parquet")
    pq.write_table(schema.empty_table(), _made(path, "documents"))
    pq.write_table(pq.read_schema(f"{SF}/labels.parquet").empty_table(), _made(path, "labels"))
    assert corpus_pipeline.run(spark, path).count() == 0


def _made(path, name):
    import os

    os.makedirs(path, exist_ok=True)
    return f"{path}/{name}.parquet"
