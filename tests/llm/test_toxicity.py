"""Toxicity: restoration of disguised words, rules that hold, held-out accuracy."""

import numpy as np
import pyarrow.parquet as pq

from devicehealth.llm import arrays, noisy, toxicity
from devicehealth.llm.q_toxicity import op9_toxicity

SF = "/root/testdata/sf0.1"
PLAIN = "the idiot said it was a stupid plan and the moron of a clown was pathetic trash scum loser worthless disgusting " * 30


def restorer():
    return noisy.Restorer(noisy.costs(noisy.trigrams(np.frombuffer(PLAIN.encode(), np.uint8))))


def found(texts, *words):
    """The texts that have each word as a feature."""
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    owner, keys = toxicity.features(toxicity._splitter(), restorer(), data, np.cumsum([0, *(len(t.encode()) for t in texts)]))
    units = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]
    return [sorted(set(owner[keys == toxicity._feature_keys(u, np.array([0]), np.array([len(u)]))[0][0]].tolist())) for u in units]


def test_restoration():
    r = restorer()
    for seen, word in (("1d1ot", "idiot"), ("i.d.i.o.t", "idiot"), ("i d i o t", "idiot"), ("stuuuupid", "stupid"), ("$tup1d", "stupid"), ("m0r0n", "moron"), ("tra5h", "trash"),
                       ("s-c-u-m", "scum"), ("w0rthless", "worthless"), ("l0seeer", "loser"), ("plan", "plan"), ("", "")):
        assert r.restore(seen) == word, seen


def test_disguised_words_become_features():
    texts = ["what an i d i o t he is", "1d1ot", "see stuuupid things", "plain words only, nothing. here", "", "a b c", "x1 2y", "i.d.i.o.t and m0r0n"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t) for t in texts)])
    owner, keys = toxicity.features(toxicity._splitter(), restorer(), data, offsets)

    def key(word):
        units = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        return toxicity._feature_keys(units, np.array([0]), np.array([len(units)]))[0][0]

    has = lambda word: sorted(set(owner[keys == key(word)].tolist()))
    assert has("idiot") == [0, 1, 7] and has("stupid") == [2] and has("moron") == [7] and has("plain") == [3]


def test_words_set_apart_end_where_the_model_ends_them():
    r = restorer()
    for seen, words in (("a l o s e r", "a loser"), ("a m o r o n", "a moron"), ("s t u p i d i d i o t", "stupid idiot"), ("s t u p i d   i d i o t", "stupid idiot"), ("a s t u p i d c l o w n", "a stupid clown")):
        assert r.restore(seen) == words, seen
    assert found(["such a l o s e r", "what a s t u p i d i d i o t", "a loser"], "loser", "stupid", "idiot", "aloser") == [[0, 2], [1], [1], []]


def test_signs_spacing_and_repetition_in_any_mixture():
    seen = ["i d 1 o t", "i  d  i  o  t", "i - d - i - o - t", "an idiiot", "1d!ot.", "!d!0t!", "id-iot", "i.d.i-o.t", "1 d d 1 0 t", "idi0oot", "i\nd\ni\no\nt", "ID1OT"]
    assert found(seen, "idiot") == [list(range(len(seen)))]
    assert found(["sc-um", "5cum", "s c u u m", "scuum", "s.c-u.m"], "scum") == [list(range(5))]
    assert found(["m0r0n", "moroon", "mor.on", "m o r 0 0 n", "(m-o-r-o-n)"], "moron") == [list(range(5))]
    short = noisy.Restorer(noisy.costs(noisy.trigrams(np.frombuffer(b"what shit you ass are, shit and ass " * 30, np.uint8))))
    for token, word in (("5h17", "shit"), ("$h!+", "shit"), ("sh!+", "shit"), ("@$$", "ass"), ("as$", "ass")):
        data = np.frombuffer(f"x {token} y".encode(), np.uint8)
        keys = toxicity.features(toxicity._splitter(), short, data, np.array([0, len(data)]))[1]
        assert toxicity._word_keys([word])[0][0] in keys, token


def test_doubles_are_decided_as_the_lattice_decides_them():
    r, rng = restorer(), np.random.default_rng(5)
    for _ in range(3000):
        token = "".join(str(c) * int(rng.choice([1, 1, 2])) for c in rng.choice(list("idotsumrnclé"), rng.integers(2, 8)))
        units = np.frombuffer(token.encode("utf-32-le"), np.uint32)
        sent = len(toxicity.disguised(units, np.ones(len(units), bool), np.array([0, len(units)]), r.single)[0])
        assert sent or r.restore(token) == token, token


def test_a_word_once_counts_once():
    once = found(["idiiot the", "i.d.i.o.t the", "idiot! the"], "idiot")
    assert once == [[0, 1, 2]]
    salted = [k ^ toxicity._OFTEN_SALTS[0] for k in toxicity._word_keys(["idiot"])]
    data = np.frombuffer(b"idiiot the i.d.i.o.t the idiot! the", np.uint8)
    keys = toxicity.features(toxicity._splitter(), restorer(), data, np.array([0, 11, 25, len(data)]))[1]
    assert not np.isin(np.concatenate(salted), keys).any()


def test_rules_pass_over_words_that_merely_stand_beside(spark):
    rng = np.random.default_rng(1)
    filler = lambda n: " ".join(f"w{rng.integers(3000)}x" for _ in range(n))
    copied = filler(80)
    rows = [(i, f"{filler(40)} vilex {filler(40)}", 1) for i in range(40)] + [(100 + i, f"{copied} vilex {filler(5)}", 1) for i in range(30)] + [
        (200 + i, filler(80), 0) for i in range(300)] + [(600, copied, None), (601, None, None), (602, "v1lex", None), (603, "", 0), (None, "vilex", 1), (604, "vilex", None)]
    docs = spark.createDataFrame([(i, t, "z") for i, t, _ in rows] + [(604, "vilex", "z")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = [(r.doc_id, r["__dh_score"]) for r in toxicity.scored(docs, model).collect()]
    score = dict(got)
    assert len(got) == len(rows) + 1 and all(score[i] >= 0.5 for i in [*range(40), *range(100, 130), 604, None])
    assert all(score[i] < 0.5 for i in [*range(200, 500), 600, 601, 603])
    assert toxicity.toxicity_filter(docs, labels).columns == docs.columns
    none = toxicity.train(docs, labels.where("false"))
    assert toxicity.scored(docs, none).where("__dh_score > 0").count() == 0
    assert toxicity.scored(docs.where("false"), model).count() == 0


def test_held_out_documents(spark):
    truth = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    rows = op9_toxicity(spark, SF).collect()
    assert len(rows) == pq.read_table(f"{SF}/documents.parquet", columns=["doc_id"]).num_rows
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    hit = sum(r.predicted == 1 and truth[r.doc_id] == 1 for r in held)
    assert hit > 0.7 * sum(truth[r.doc_id] for r in held)
    assert sum(r.predicted == 1 and truth[r.doc_id] == 0 for r in held) <= 0.02 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert arrays.CHUNK_BYTES


def test_words_and_tokens_are_looked_at_once(monkeypatch):
    cost = noisy.costs(noisy.trigrams(np.frombuffer(PLAIN.encode(), np.uint8)))
    shared = noisy.restorer(cost)
    assert noisy.restorer(cost.copy()) is shared and noisy.restorer(cost + 1.0) is not shared
    decoded, hashed = [], []
    plain, keys = noisy.Restorer.restore, toxicity._feature_keys
    monkeypatch.setattr(noisy.Restorer, "restore", lambda self, token: decoded.append(token) or plain(self, token))
    monkeypatch.setattr(toxicity, "_feature_keys", lambda units, starts, ends: hashed.append(len(starts)) or keys(units, starts, ends))
    text = "an 1d10t and an 1d10t and an 1d10t " * 50
    data = np.frombuffer((text * 2).encode(), np.uint8)
    restorer = noisy.restorer(cost)
    texts, found = toxicity.features(toxicity._splitter(), restorer, data, np.array([0, len(text), 2 * len(text)]))
    assert decoded == ["1d10t"] and max(hashed) < 10
    assert found[texts == 0].tolist() == found[texts == 1].tolist()
