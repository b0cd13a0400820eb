"""Toxicity: disguised words restored by a noisy channel, then texts scored by what their words and word beginnings tell."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from tokenizers import normalizers

from devicehealth.llm import arrays, noisy, pretoken
from devicehealth.session import cut_lineage, small

CHUNK_BYTES = 1 << 19
#: Most labelled rows that the classifier is fitted on; of more, those with the smallest hashes of their ids are taken.
LABELLED = 50_000
#: Most features weighed, and most that are looked at once more for the list of rules.
CANDIDATES, SHORTLIST = 100_000, 2_000
#: A rule needs so many toxic rows that no earlier rule holds, and this many standard deviations above chance among them.
SUPPORT, DEVIATIONS = 4, 6.0
#: A feature with this many toxic rows in all, and this share of them, needs only one that no earlier rule holds.
SURE, SURE_SHARE = 20, 0.95
#: Beginnings of words that are features beside whole words.
PREFIXES = (3, 4, 5, 6, 7, 8)
#: A feature that occurs often is one of its own: so many times at least, and one in so many words at least, so that the
#: length of a text alone does not bring it about.
OFTEN = ((2, 200), (3, 100))
_OFTEN_SALTS = [np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)]
_LEET = np.zeros(0x110000, bool)
_LEET[[ord(c) for c in noisy.LEET]] = True
_SALT = np.uint64(0x5851F42D4C957F2D)
#: Stands for no feature.
_NONE = np.uint64(0)


def _splitter() -> pretoken.Splitter:
    return pretoken.Splitter(True, {}, normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]))


def _feature_keys(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Keys of the whole words and of their beginnings; a word no longer than a beginning has the key of itself there."""
    whole = arrays.spans_hash(units, starts, ends) ^ _SALT
    return [whole, *(np.where(ends - starts >= k, arrays.spans_hash(units, starts, np.minimum(ends, starts + k)), whole) for k in PREFIXES)]


def disguised(units: np.ndarray, letter: np.ndarray, offsets: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, start, end)`` of what may be disguised: words with signs for letters, with separators or with runs of a letter,
    and runs of letters or signs set apart. Of the words with doubles alone those are left out that the channel surely leaves
    as they are (``single``, see ``Restorer``): there each double is decided by its neighbours."""
    n = len(units)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    leet = _LEET[units]
    wordy = letter | leet
    white = np.isin(units, [9, 10, 11, 12, 13, 32]) | (pretoken.CHARACTERS.kinds(units) & 7 == pretoken.WHITE)
    word_start = np.flatnonzero(~white & (np.append(True, white[:-1]) | cut[:-1])) if n else np.zeros(0, np.int64)
    word_end = np.flatnonzero(~white & (np.append(white[1:], True) | cut[1:])) + 1 if n else np.zeros(0, np.int64)
    symbol = np.where((units >= 97) & (units <= 122), units.astype(np.int64) - 96, np.where(letter, 27, 0))
    # Symbols and letters with an edge at the ends of texts; place i of the texts is place i + 1 here.
    double = np.append(False, letter[1:] & (units[1:] == units[:-1]) & ~cut[1:-1]) if n else np.zeros(0, bool)
    triple = np.append(False, double[1:] & double[:-1]) if n else double
    at = np.flatnonzero(double)
    before = np.where((at >= 2) & ~cut[np.maximum(at - 1, 0)], symbol[np.maximum(at - 2, 0)], 0)
    behind = np.where(cut[at + 1], 0, np.append(symbol, 0)[at + 1])
    mark = leet | triple
    mark[at[single[before, symbol[at], behind]]] = True
    # Separators between letters or signs of one word: only places behind a gap are looked up.
    places = np.flatnonzero(wordy)
    gap = np.diff(places)
    apart = np.flatnonzero(gap > 1)
    left, right = places[apart], places[apart + 1]
    mark[right[np.searchsorted(word_start, left, "right") == np.searchsorted(word_start, right, "right")]] = True
    # Letters or signs each alone, with one to three other characters between two: at least three in a row.
    joined = (gap == 1) & ~cut[places[1:]]
    alone = ~(np.append(False, joined) | np.append(joined, False)) if len(places) else np.zeros(0, bool)
    near = apart[(gap[apart] <= 4) & alone[apart] & alone[apart + 1]]
    linked = np.zeros(len(gap), bool)
    linked[near[np.searchsorted(offsets, places[near], "right") == np.searchsorted(offsets, places[near + 1], "right")]] = True
    edge = np.diff(np.concatenate([[0], linked.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = last - first >= 2
    run_start, run_end = places[first[long]], places[last[long]] + 1
    words = np.unique(np.searchsorted(word_start, np.flatnonzero(mark & ~white), "right") - 1)
    starts, ends = word_start[words], word_end[words]
    # A word inside of a run is read with the run.
    run = np.searchsorted(run_start, ends, "left") - 1
    inside = (run >= 0) & (run_end[np.maximum(run, 0)] > starts) if len(run_start) else np.zeros(len(words), bool)
    starts, ends = np.concatenate([starts[~inside], run_start]), np.concatenate([ends[~inside], run_end])
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends


def _restored(restorer: noisy.Restorer, units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str], list[str]]:
    """``(token, which, words, wholes)``: the words ``words[which]`` that the tokens stand for and that are not written in them; ``wholes`` are the tokens
    themselves if they are letters only. A word of equal tokens is listed once."""
    keys, one, back = np.unique(arrays.spans_hash(units, starts, ends), return_index=True, return_inverse=True)
    texts = lambda i: units[starts[i]:ends[i]].astype("<u4").tobytes().decode("utf-32-le").strip(".,;:?\"'()[]{}*#%&<>~-_")
    said = [restorer.known(key, lambda: texts(i)) for key, i in zip(keys.tolist(), one.tolist())]
    sizes = np.array([len(words) for words, _ in said], np.int64)
    first = np.cumsum(sizes) - sizes
    token = np.flatnonzero(sizes[back]) if len(back) else back
    each = sizes[back[token]]
    place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    return (np.repeat(token, each), np.repeat(first[back[token]], each) + place, [w for words, _ in said for w in words], [whole for words, whole in said for _ in words])


def _word_keys(words: list[str]) -> list[np.ndarray]:
    ends = np.cumsum([len(w) for w in words])
    return _feature_keys(pretoken._points("".join(words)), np.append(0, ends[:-1]), ends)


def features(splitter: pretoken.Splitter, restorer: noisy.Restorer, data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(text, feature)`` once each: words and their beginnings, of the disguised ones as they are restored too, and what
    occurs often. ``wanted``: sorted keys to keep to."""
    pieces = splitter.split(data, offsets)
    letter = (pretoken.CHARACTERS.kinds(pieces.units) & 7) == pretoken.LETTER
    number = np.searchsorted(pieces.first, np.arange(len(pieces.starts)), "right") - 1
    words = letter[pieces.starts] if len(pieces.starts) else np.zeros(0, bool)
    starts, ends, owner = pieces.starts[words], pieces.ends[words], number[words]
    n_words = np.bincount(owner, minlength=len(offsets) - 1)
    # Equal words are hashed and looked up once.
    _, one, back = np.unique(pieces.keys[words], return_index=True, return_inverse=True)
    units, at = arrays.spans(pieces.units, starts[one], ends[one])
    groups = [(owner, back, _feature_keys(units, at[:-1], at[1:]))]
    hidden, hidden_starts, hidden_ends = disguised(pieces.units, letter, pieces.offsets, restorer.single)
    token, which, restored, wholes = _restored(restorer, pieces.units, hidden_starts, hidden_ends)
    if restored:
        # A beginning that the word as it is written has too is there already.
        had = _word_keys(wholes)
        groups.append((hidden[token], which, [np.where(key == old, _NONE, key) for key, old in zip(_word_keys(restored), had)]))
    roots = None if wanted is None else np.unique(np.concatenate([wanted, *(wanted ^ s for s in _OFTEN_SALTS)]))
    texts, keys = [], []
    for who, which, found in groups:
        for level, key in enumerate(found):
            # A beginning that is the whole word is the word, which is there already.
            keep = (key != _NONE) & (True if not level else key != found[0])
            if roots is not None and len(roots):
                keep &= roots[np.minimum(np.searchsorted(roots, key), len(roots) - 1)] == key
            at = np.flatnonzero(keep[which])
            texts.append(who[at])
            keys.append(key[which[at]])
    texts, keys = np.concatenate(texts), np.concatenate(keys)
    order = np.lexsort((keys, texts))
    texts, keys = texts[order], keys[order]
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (texts[1:] != texts[:-1]))) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(keys)))
    texts, keys = texts[first], keys[first]
    out_texts, out_keys = [texts], [keys]
    for (least, words_each), salt in zip(OFTEN, _OFTEN_SALTS):
        often = (times >= least) & (times * words_each >= n_words[texts])
        out_texts.append(texts[often])
        out_keys.append(keys[often] ^ salt)
    texts, keys = np.concatenate(out_texts), np.concatenate(out_keys)
    if wanted is not None:
        inside = wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys if len(wanted) else np.zeros(len(keys), bool)
        texts, keys = texts[inside], keys[inside]
    return texts, keys


@dataclass
class Model:
    """Rules: sorted feature keys and the share of toxic rows among those they hold; the share where none holds; the channel."""

    keys: np.ndarray
    shares: np.ndarray
    rest: float
    cost: np.ndarray


def character_model(docs: DataFrame, text: str) -> np.ndarray:
    """Costs of the character model of all texts; a task passes on one cube of counts, whatever it has read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(noisy.SYMBOLS ** 3, np.int64)
        for batch in batches:
            for _, _, data, _ in arrays.chunks(batch.column(0), CHUNK_BYTES):
                total += noisy.trigrams(data)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["symbols", "n"])

    rows = docs.select(text).mapInArrow(run, "symbols long, n long").groupBy("symbols").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(noisy.SYMBOLS ** 3)
    for r in rows:
        counts[r.symbols] = r.n
    return noisy.costs(counts)


def _counted(rows: DataFrame, cost, wanted=None) -> DataFrame:
    """``(feature, pos, neg)`` of ``rows(text, toxic)``: texts of either class that have it. ``wanted``: sorted keys to keep to."""
    schema = "feature long, pos long, neg long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, restorer = _splitter(), noisy.restorer(cost.value)
        keep = None if wanted is None else wanted.value
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b, data, offsets in arrays.chunks(batch.column(0), CHUNK_BYTES):
                texts, keys = features(splitter, restorer, data, offsets, keep)
                if not len(keys):
                    continue
                unique, back = np.unique(keys, return_inverse=True)
                pos = np.bincount(back, toxic[a:b][texts], len(unique)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(pos), pa.array(np.bincount(back, minlength=len(unique)) - pos)], names=["feature", "pos", "neg"])

    return rows.mapInArrow(run, schema).groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _rules(held: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Features in the order in which each best tells the rows that no earlier one holds, and which rows none holds;
    ``held[f]``: rows that have f; a row counts by its weight. Then sure features that tell rows held by one rule only
    are taken too, so that a text with but one of several telling words is found by any of them."""
    rules_of = np.zeros(len(toxic), int)
    bad = toxic * weight
    sure = [bad[at].sum() >= max(SURE, SURE_SHARE * weight[at].sum()) for at in held]
    chosen: list[int] = []
    for depth in (1, 2):
        while True:
            open_ = rules_of < depth
            base = bad[open_].sum() / max(weight[open_].sum(), 1.0)
            best, top = -1, (0.0, 0.0)
            for f, at in enumerate(held):
                if depth > 1 and not sure[f] or f in chosen:
                    continue
                mine = at[open_[at]]
                pos, n = bad[mine].sum(), weight[mine].sum()
                if pos >= (1 if sure[f] and depth == 1 else SUPPORT) and 2 * pos > n:
                    z = (pos - n * base) / np.sqrt(max(n * base * (1 - base), 1e-9))
                    if z > (DEVIATIONS if depth == 1 else 0) and ((pos + 0.5) / (n - pos + 0.5), pos) > top:
                        best, top = f, ((pos + 0.5) / (n - pos + 0.5), pos)
            if best < 0:
                break
            chosen.append(best)
            rules_of[held[best]] += 1
    return chosen, rules_of == 0


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", labelled: int = LABELLED) -> Model:
    """The character model of all ``docs``, and a list of rules from the labelled ones.

    ``labels(key, label)``: 0 or 1; rows with a null are left out, of several for an id the larger holds. More than ``labelled`` are cut to the ids
    of the smallest hashes, so they can go to every task; all else covers all documents. Features are weighed by the rows of either class that
    have them, single and often; then rules are taken one after another, each for the rows that no earlier one holds, so that words
    that merely stand beside a telling one are not taken. Without labels there are no rules, and every score is 0.
    """
    spark = docs.sparkSession
    cost = spark.sparkContext.broadcast(character_model(docs, text))
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("__dh_id")).agg(F.max(F.col(label).cast("int")).alias("__dh_toxic"))
    count = known.count()
    if count > labelled:
        known = known.where(F.pmod(F.xxhash64("__dh_id"), F.lit(1 << 30)) < int((1 << 30) * labelled / count))
    rows = docs.join(small(known, 2 * labelled), F.col(key) == F.col("__dh_id")).select(F.col(text).alias("text"), F.col("__dh_toxic").alias("toxic"))
    frequent = _counted(rows.where("toxic = 1"), cost).where(F.col("pos") >= SUPPORT).orderBy(F.desc("pos"), "feature").limit(CANDIDATES).select("feature").toPandas()
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, cost.value)
    if not len(frequent):
        return nothing
    wanted = spark.sparkContext.broadcast(np.sort(frequent["feature"].to_numpy(np.int64).view(np.uint64)))
    counts = cut_lineage(_counted(rows, cost, wanted))
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    both = rows.agg(F.sum("toxic").alias("p"), F.count(F.lit(1)).alias("n")).first()
    p, n = float(both["p"] or 0), float(both["n"])
    share = p / n
    best = counts.withColumn("z", (pos - (pos + neg) * share) / F.sqrt((pos + neg) * share * (1 - share) + 1e-9)).where(f"z > {DEVIATIONS}").orderBy(
        F.desc(F.col("z") * F.sqrt(pos)), "feature").limit(SHORTLIST).toPandas()
    if not len(best):
        return nothing
    listed = np.sort(best["feature"].to_numpy(np.int64).view(np.uint64))
    shortlist = spark.sparkContext.broadcast(listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, restorer = _splitter(), noisy.restorer(cost.value)
        for batch in batches:
            for a, b, data, offsets in arrays.chunks(batch.column(0), CHUNK_BYTES):
                texts, keys = features(splitter, restorer, data, offsets, shortlist.value)
                has = np.searchsorted(shortlist.value, keys)
                order = np.lexsort((has, texts))
                bounds = np.searchsorted(texts[order], np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.ListArray.from_arrays(pa.array(bounds), pa.array(has[order].astype(np.int32)))], names=["toxic", "has"])

    # Rows alike in label and features come as one with a count, so few and small ones reach the driver.
    kinds = rows.mapInArrow(run, "toxic int, has array<int>").groupBy("toxic", "has").agg(F.count(F.lit(1)).alias("n")).toPandas()
    toxic, weight = kinds["toxic"].to_numpy(float), kinds["n"].to_numpy(float)
    sizes = np.array([len(h) for h in kinds["has"]])
    flat = np.concatenate([np.asarray(h, np.int64) for h in kinds["has"]]) if sizes.sum() else np.zeros(0, np.int64)
    order = np.argsort(flat, kind="stable")
    row = np.repeat(np.arange(len(kinds)), sizes)[order]
    upto = np.searchsorted(flat[order], np.arange(len(listed) + 1))
    held = [row[a:b] for a, b in zip(upto[:-1], upto[1:])]
    chosen, open_ = _rules(held, toxic, weight)
    by_key = {int(f) & (1 << 64) - 1: (x, y) for f, x, y in zip(best["feature"], best["pos"], best["neg"])}
    keys = np.array(sorted(int(listed[f]) for f in chosen), np.uint64)
    shares = np.array([(by_key[int(k)][0] + 0.5) / (sum(by_key[int(k)]) + 1.0) for k in keys])
    rest = min(0.45, ((toxic * weight)[open_].sum() + 0.5) / (weight[open_].sum() + 1.0))
    return Model(keys, shares, float(rest), cost.value)


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows with ``__dh_score``: the share of toxic rows behind the most telling rule that holds, or that of the rows behind none.

    Null, empty and very short texts hold no rule. Repeated rows are scored alike, ties cannot change a score. A text is
    read whole, whatever its length. No rows: no rows. Other columns pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema, T.StructField("__dh_score", T.DoubleType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        splitter, restorer = _splitter(), noisy.restorer(model.cost)
        for batch in batches:
            for a, b, data, offsets in arrays.chunks(batch.column(at), CHUNK_BYTES):
                score = np.full(b - a, model.rest)
                if len(model.keys):
                    texts, keys = features(splitter, restorer, data, offsets, model.keys)
                    np.maximum.at(score, texts, model.shares[np.searchsorted(model.keys, keys)])
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(score)], names=schema.names)

    return docs.mapInArrow(run, schema)


def toxicity_filter(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents scored below one half, with their own columns; rules are learned from all labels given."""
    return scored(docs, train(docs, labels, key, text), text).where("__dh_score < 0.5").select(*docs.columns)
