"""Token counts, encoding and packing against the tokenizers library."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from devicehealth.llm import automaton, bpe, grouping, merges
from devicehealth.llm.bpe import decode, encode
from devicehealth.llm.packing import packed_documents
from devicehealth.llm.q_bpe import op5_bpe_encoding
from devicehealth.llm.q_packing import op3_best_fit_packing
from devicehealth.llm.q_token_counts import op10_token_counts
from devicehealth.llm.token_counts import token_counts

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.01"
random.seed(5)
LETTERS = "aAbs tTdD'’lLvVeErRmM 1²½\n\t \u0085 ÄäİıΣσςß!?.,<|>é é ̀‍漢字 ﬁ ǅ K \U0001f600 \x1c ẞ _-"
ODD = [None, "", " ", "a" * 3000, "<|endoftext|>x<|ENDOFTEXT|> <|startoftext|>'s", "ΑΣ ΟΔΟΣ İstanbul", "it's 'tis we'LL", "same", "same", " ".join(f"w{i}" for i in range(40_000)),
       *("".join(random.choice(LETTERS) for _ in range(random.randint(0, 60))) for _ in range(300))]


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))


def odd(spark):
    return spark.createDataFrame([(i, t, "n", 1) for i, t in enumerate(ODD)] + [(None, "same", None, None)], "doc_id long, text string, n_tokens string, piece int")


def test_counts_on_documents(spark, texts):
    tk = Tokenizer.from_file(WORD)
    rows = op10_token_counts(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(tk.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 2048)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_counts_on_odd_texts(spark, path):
    tk = Tokenizer.from_file(path)
    got = {r.doc_id: r.n_tokens for r in token_counts(odd(spark), path).collect()}
    assert got.pop(None) == len(tk.encode("same").ids)
    assert got == {i: len(tk.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(ODD)}


def test_encoding_on_documents(spark, texts):
    tk = Tokenizer.from_file(WORD)
    rows = op5_bpe_encoding(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = tk.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encoding_of_odd_texts(spark):
    tk = Tokenizer.from_file(WORD)
    for r in decode(encode(odd(spark), WORD), WORD).collect():
        ids = tk.encode("same" if r.doc_id is None else ODD[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids
        assert r.decoded == r.decoded_text == tk.decode(ids, skip_special_tokens=False)
    again = decode(decode(encode(odd(spark), WORD), WORD), WORD)
    assert again.columns.count("decoded_text") == 1 and again.where("not decoded <=> decoded_text").count() == 0


def test_automaton_is_minimal_and_maps_words(tmp_path):
    words = sorted({w.encode() for w in "tap taps top tops stop stops tapé zé é a ab abc".split()})
    ids = [[i, 7 * i] for i in range(len(words))]
    arrays = automaton.build(words, ids)
    automaton.save(arrays, str(tmp_path / "lexicon"))
    lexicon = automaton.Lexicon(str(tmp_path / "lexicon"))
    assert lexicon.numbers([*words, b"", b"ta", b"tapss", b"x"]).tolist() == [*range(len(words)), -1, -1, -1, -1]
    rights = set()
    for k in range(len(words)):
        for cut in range(len(words[k]) + 1):
            rights.add(frozenset(w[cut:] for w in words if w.startswith(words[k][:cut])))
    assert len(arrays["final"]) == len(rights)


def test_long_words_by_heap_equal_rounds():
    vocab = merges.vocabulary(merges.file_text(WORD))
    words = ["".join(random.choice("abcdeé") for _ in range(n)).encode() for n in (1, 2, 50, 300, 390)] + [b"a" * 399]
    values, offsets = vocab.encode(words)
    for i, w in enumerate(words):
        symbols = [*vocab.inner[list(w[:-1])].tolist(), int(vocab.last[w[-1]])]
        assert vocab._long(symbols) == values[offsets[i]:offsets[i + 1]].tolist()


def test_small_lexicon_gives_the_same_ids(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the quick brown fox the the quick")], "doc_id long, text string")
    want = [tuple(r) for r in encode(docs, WORD).collect()]
    monkeypatch.setattr(bpe, "LEXICON_WORDS", 1)
    assert [tuple(r) for r in encode(docs, WORD).collect()] == want


def check_packing(rows, texts, capacity):
    """``texts``: the text of each id; ids occur once."""
    tk = Tokenizer.from_file(BYTE)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == texts.keys()
    for key, held in by_doc.items():
        ids = [*tk.encode(texts[key] or "", add_special_tokens=False).ids, 2]
        held.sort(key=lambda r: r.piece)
        assert [r.piece for r in held] == list(range(-(-len(ids) // capacity)))
        at = 0
        for r in held:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and all(r.length == capacity for r in held[1:])
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence), -(-sum(r.length for r in rows) // capacity)


def test_packing_of_documents(spark, texts):
    made, least = check_packing(op3_best_fit_packing(spark, SF).collect(), texts, 1024)
    assert made <= 1.005 * least + 1


def test_packing_of_odd_texts(spark):
    rows = packed_documents(odd(spark).where("doc_id is not null"), BYTE, 64).collect()
    made, least = check_packing(rows, dict(enumerate(ODD)), 64)
    assert made <= 1.01 * least + 1
    assert packed_documents(odd(spark).where("doc_id is null"), BYTE).count() == 1


def test_evolution_beats_its_start():
    rng = random.Random(3)
    sizes = [rng.randint(150, 600) for _ in range(400)]
    start = grouping.evolve(sizes, 1024, [], 0, 1, 1)
    end = grouping.evolve(sizes, 1024, [], 40, 6, 1)
    assert sorted(i for held in end[0] for i in held) == list(range(400))
    assert grouping.score(end[0], sizes, 1024) > grouping.score(start[0], sizes, 1024)


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts(none, WORD).count() == encode(none, WORD).count() == packed_documents(none, BYTE).count() == 0
