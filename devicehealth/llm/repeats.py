"""Repeated byte strings: column-wise construction of the transform and the common prefixes of many documents at once.

Bauer, Cox and Rosone (Lightweight algorithms for constructing and inverting the BWT of string collections, 2013) build the
Burrows-Wheeler transform of a collection in rounds: each round puts one more symbol in front of the suffix of every document, and
the new suffix goes to the place in its symbol's bucket that the transform so far tells. The common prefixes are kept up to date
by the least value between two tails.

All strings of WINDOW bytes are wanted that start twice. The texts are cut by their content into pieces: a string belongs to the
least hash of GRAM bytes within it, its anchor, and neighbouring strings of one anchor are a piece of at most two windows. Equal
strings have equal anchors, so an anchor that occurs once in the whole corpus settles its piece, and pieces of one anchor only have
to be compared with each other. Anchors are spread over collections of bounded size; within one, symbols are SYMBOL bytes counted from the
anchor, and each phase of a piece is a document of its own, so that a round moves all strings on by one symbol.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from devicehealth.llm import arrays
from devicehealth.session import cut_lineage, small

#: Bytes of a string that may not be repeated, of the hash that anchors it, and of a symbol, which divides the string.
WINDOW, GRAM, SYMBOL = 400, 32, 25
#: Bytes of a longer text that are cut at once.
SLAB = 1 << 22
#: Bytes of a collection, and pieces of one anchor in it: an anchor of more pieces is dealt over several collections.
COLLECTION, GROUP = 1 << 17, 1024
#: Collections of one anchor for each part of the strings that are looked for in all of them.
SHARE = 8
#: Most anchors sent to all tasks (16 MB as a table of hashes); beyond it they are joined.
ANCHORS = 500_000
#: Most texts whose keys are sent to all tasks; beyond it the texts are joined.
WANTED = 200_000
_U = np.uint64
_LOW = _U((1 << 28) - 1)


def grams(data: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """For each size, a hash of the bytes ``data[i:i + size]`` for every i that has so many. Two hashes of half the length are joined and scrambled, so
    no pattern of the bytes cancels out."""
    h, k, found = arrays.mix(data.astype(_U) + _U(1)), 1, {}
    for size in sorted(set(sizes)):
        while 2 * k <= size:
            h = h[:-k] * _U(0x9FB21C651E98DF25) + h[k:] * _U(0xD6E8FEB86659FD93) if len(h) > k else h[:0]
            h ^= h >> _U(32)
            h *= _U(0xA24BAED4963EE407)
            h ^= h >> _U(29)
            k *= 2
        found[size] = h if k == size else arrays.mix(h[:len(h) - size + k] * _U(0xD1B54A32D192ED03) + h[size - k:]) if len(h) > size - k else h[:0]
    return [found[size] for size in sizes]


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from running minima of blocks."""
    n = len(x)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def pieces(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """``(text, start, length, place of the anchor in the piece, hash of the anchor, hash of the piece)`` of the pieces of the texts; starts count from the text's own."""
    half = 1 << (window.bit_length() - 1)
    h, wide = grams(data, gram, half)
    if len(data) < window:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int64, _U, _U))
    # 36 bits of the hash, then the place: of equal ones the leftmost is the least, in every text alike.
    anchor = (_least((h & ~_LOW) | np.arange(len(h), dtype=_U), window - gram + 1) & _LOW).astype(np.int64)
    n = len(anchor)
    text = np.searchsorted(offsets, np.arange(n), "right") - 1
    whole = np.arange(n) + window <= offsets[text + 1]
    edge = np.ones(n + 1, bool)
    edge[1:-1] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1])
    start = np.flatnonzero(edge[:-1] & whole)
    last = np.flatnonzero(edge[1:] & whole)
    end = last + window
    # Hashes of half a window that together cover the piece, whatever its length.
    value = np.zeros(len(start), _U)
    for i in range(-(-2 * window // half)):
        value = arrays.mix(value * _U(0x9E3779B97F4A7C15) + wide[np.minimum(start + i * half, end - half)])
    return text[start], start - offsets[text[start]], end - start, anchor[start] - start, h[anchor[start]], arrays.mix(value + (end - start).astype(_U))


def collection(symbols: np.ndarray, sizes: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(order, prefixes, transform)`` of all suffixes of documents of ``sizes`` symbols, which stand one after another.

    ``order`` has the index of the first symbol of each suffix in sorted order, ``prefixes`` how many symbols (``cap`` at most) it has in common with the one before
    it, ``transform`` the name of the symbol that precedes it, 0 where its document begins. Of equal suffixes at the ends of documents any order will do.
    """
    documents = len(sizes)
    ends = np.cumsum(sizes)
    name = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    # Places are kept by symbol, with one more for the empty suffix at the end of each document: 0, as all of them are alike.
    slot = np.arange(len(symbols)) + np.repeat(np.arange(documents), sizes)
    of_slot = np.zeros(len(symbols) + documents, np.int64)
    of_slot[slot] = np.arange(len(symbols))
    end_slot = ends + np.arange(documents)
    named = np.zeros(len(symbols) + documents, np.int64)
    named[slot] = name
    place = np.zeros(len(symbols) + documents, np.int64)
    scale = len(symbols) + 2
    order, prefixes, keys = np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.int64)
    for step in range(1, int(sizes.max(initial=0)) + 1):
        new = end_slot[sizes >= step] - step
        # The new suffix's rank among those of its symbol is how many of them have a lower tail.
        new_keys = named[new] * scale + place[new + 1]
        by_key = np.argsort(new_keys, kind="stable")
        new, new_keys = new[by_key], new_keys[by_key]
        at = np.searchsorted(keys, new_keys, "right") + np.arange(len(new))
        old = np.ones(len(order) + len(new), bool)
        old[at] = False
        merged = np.empty(len(old), np.int64)
        merged[at], merged[old] = new, order
        values = np.zeros(len(old), np.int8)
        values[old] = prefixes
        follows = at + 1
        follows = follows[(follows < len(old))]
        follows = follows[old[follows]]
        for where in (at[at > 0], follows):
            a, b = merged[where - 1], merged[where]
            common = np.zeros(len(where), np.int8)
            same = np.flatnonzero(named[a] == named[b])
            low, high = place[a[same] + 1], place[b[same] + 1]
            common[same] = np.minimum(1 + _least_between(prefixes, low, high), cap)
            values[where] = common
        order, prefixes = merged, values
        place[order] = np.arange(1, len(order) + 1)
        keys = named[order] * scale + place[order + 1]
    before = np.where(order > 0, named[order - 1], 0) if len(order) else order
    return of_slot[order], prefixes, before


def _least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of ``values[low:high]``, places counted from 1; 0 where ``low`` is 0, the empty suffix."""
    out = np.zeros(len(low), np.int8)
    some = np.flatnonzero((low > 0) & (high > low))
    if not len(some):
        return out
    a, b = low[some], high[some]
    level = np.frexp((b - a).astype(np.float64))[1] - 1
    table = values
    for k in range(int(level.max()) + 1):
        if k:
            table = np.minimum(table[:-(1 << (k - 1))], table[1 << (k - 1):])
        now = np.flatnonzero(level == k)
        out[some[now]] = np.minimum(table[a[now]], table[b[now] - (1 << k)])
    return out


def repeated(data: np.ndarray, offsets: np.ndarray, anchors: np.ndarray, copies: np.ndarray, window: int = WINDOW, symbol: int = SYMBOL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(first window of each piece, repeated, first of its kind)`` of the strings of the pieces of one collection.

    A piece stands for ``copies`` equal ones; a string is repeated that starts in two of all, or twice in one. One string of each kind is the first of it.
    """
    length = np.diff(offsets)
    windows = length - window + 1
    base = np.concatenate([[0], np.cumsum(windows)])
    hashed = grams(data, symbol)[0]
    piece = np.repeat(np.arange(len(length)), np.minimum(windows, symbol))
    lead = np.arange(len(piece)) - np.repeat(np.cumsum(np.minimum(windows, symbol)) - np.minimum(windows, symbol), np.minimum(windows, symbol))
    # A document for each remainder of the place behind the anchor, from the first string of that remainder on.
    phase = (lead - anchors[piece]) % symbol
    sizes = (windows[piece] - lead + symbol - 1) // symbol + window // symbol - 1
    total = np.cumsum(sizes)
    document = np.repeat(np.arange(len(sizes)), sizes)
    step = np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - sizes, sizes)
    start = offsets[piece[document]] + lead[document] + symbol * step
    # Strings of different phases are never equal ones, as their anchors would lie apart.
    symbols = hashed[start] ^ arrays.mix(phase[document].astype(_U))
    order, prefixes, _ = collection(symbols, sizes, window // symbol)
    full = (step < sizes[document] - window // symbol + 1)[order]
    kind = np.cumsum(prefixes < window // symbol)
    kind, order = kind[full], order[full]
    edge = np.ones(len(kind), bool)
    edge[1:] = kind[1:] != kind[:-1]
    firsts = np.flatnonzero(edge)
    weight = np.add.reduceat(copies[piece[document[order]]], firsts) if len(firsts) else np.zeros(0, np.int64)
    often = np.repeat(weight > 1, np.diff(np.append(firsts, len(kind))))
    own = piece[document[order]]
    at = base[own] + start[order] - offsets[own]
    flags, first = np.zeros(base[-1], bool), np.zeros(base[-1], bool)
    flags[at] = often
    first[at[firsts]] = True
    return base, flags, first


def _runs(flags: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in turn, of the runs of set flags of each piece, counted from its start; and their offsets."""
    step = np.zeros(len(flags) + 1, np.int8)
    step[:-1] = flags
    edge = np.zeros(len(flags) + 1, bool)
    edge[base] = True
    last = np.concatenate([[0], step[:-1]])
    opens = np.flatnonzero((step == 1) & ((last == 0) | edge))
    closes = np.flatnonzero((last == 1) & ((step == 0) | edge))
    piece = np.searchsorted(base, opens, "right") - 1
    pairs = np.stack([opens - base[piece], closes - base[piece]], axis=1).reshape(-1)
    return pairs, np.searchsorted(piece, np.arange(len(base))) * 2


def _list(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values if values.dtype != _U else values.view(np.int64), kind))


def piece_table(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """``(k1, k2, fp, ph, lo, len, anchor)`` of ``texts(k1, k2, text)``: the pieces of each text, in five arrays."""
    long, schema = T.ArrayType(T.LongType()), T.StructType([T.StructField(k, T.LongType()) for k in ("k1", "k2")])
    for name in ("fp", "ph"):
        schema.add(name, long)
    for name in ("lo", "len", "anchor"):
        schema.add(name, T.ArrayType(T.IntegerType()))

    def cut(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        if len(offsets) > 2 or len(data) <= SLAB:
            yield pieces(data, offsets, window, gram)
            return
        for s in range(0, len(data) - window + 1, SLAB):
            part = data[s:s + SLAB + window - 1]
            found = pieces(part, np.array([0, len(part)]), window, gram)
            yield (found[0], found[1] + s, *found[2:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in arrays.chunks(batch.column(2)):
                text, lo, size, anchor, fp, ph = (np.concatenate(x) for x in zip(*cut(data, offsets)))
                at = np.searchsorted(text, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), _list(fp, at, pa.int64()), _list(ph, at, pa.int64()),
                     *(_list(x.astype(np.int32), at, pa.int32()) for x in (lo, size, anchor))], names=schema.names)

    return texts.mapInArrow(run, schema)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], size: str, limit: int) -> Iterator[pa.Table]:
    """Sorted rows in tables of whole groups of equal keys, each closed as soon as the bytes of its ``size`` column reach the limit."""
    held, total, last = [], 0, None
    for batch in batches:
        if not len(batch):
            continue
        column = batch.column(size)
        units = np.append(0, np.cumsum(pc.fill_null((pc.binary_length if pa.types.is_binary(column.type) else pc.list_value_length)(column), 0).to_numpy(zero_copy_only=False)))
        values = [batch.column(k).to_numpy() for k in keys]
        edges = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1
        if last is not None and last != tuple(v[0] for v in values):
            edges = np.append(0, edges)
        a = 0
        for e in edges:
            if total + units[e] - units[a] >= limit:
                yield pa.Table.from_batches([*held, batch.slice(a, e - a)] if e > a else held)
                held, total, a = [], 0, e
        held.append(batch.slice(a))
        total += int(units[-1] - units[a])
        last = tuple(v[-1] for v in values)
    if held:
        yield pa.Table.from_batches(held)


def _flat(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list or binary column, and where each row's begin."""
    whole = column.combine_chunks()
    offsets = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset:whole.offset + len(whole) + 1].astype(np.int64)
    data = np.frombuffer(whole.buffers()[2], np.uint8) if pa.types.is_binary(whole.type) else whole.values.to_numpy()
    return data[offsets[0]:offsets[-1]].astype(kind, copy=False), offsets - offsets[0]


def collected(parts: DataFrame, window: int, symbol: int) -> DataFrame:
    """``(fp, ph, runs, b, at, h)`` of ``parts(fp, s, ph, m, anchor, dealt, bytes)``, whose partitions hold all of an ``(fp, s)`` next to each other.

    ``runs`` of strings found repeated. Of an anchor dealt over several collections there are more rows, which share out hashes ``h`` of its strings over ``b``: ``at``
    is the place of a string that is alone in this collection, -1 for a repeated one, once of each kind.
    """
    schema = T.StructType([T.StructField("fp", T.LongType()), T.StructField("ph", T.LongType()), T.StructField("runs", T.ArrayType(T.IntegerType())),
                           T.StructField("b", T.LongType()), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("h", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["fp", "s"], "bytes", COLLECTION):
            data, offsets = _flat(rows["bytes"], np.uint8)
            fp, ph, dealt = (rows[k].to_numpy() for k in ("fp", "ph", "dealt"))
            base, often, first = repeated(data, offsets, rows["anchor"].to_numpy().astype(np.int64), rows["m"].to_numpy(), window, symbol)
            runs, ends = _runs(often, base)
            none = np.zeros(len(fp) + 1, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(ph), _list(runs.astype(np.int32), ends, pa.int32()), pa.nulls(len(fp), pa.int64()),
                                              _list(none[:0].astype(np.int32), none, pa.int32()), _list(none[:0], none, pa.int64())], names=schema.names)
            if (dealt > 1).any():
                piece = np.repeat(np.arange(len(fp)), np.diff(base))
                sent = np.flatnonzero((dealt[piece] > 1) & (first | ~often))
                piece = piece[sent]
                at = sent - base[piece]
                h = grams(data, window)[0][offsets[piece] + at]
                b = (h % (-(-dealt[piece] // SHARE)).astype(_U)).astype(np.int64)
                by = np.lexsort((b, piece))
                piece, at, h, b = piece[by], np.where(often[sent], -1, at)[by], h[by], b[by]
                edge = np.flatnonzero(np.append(True, (piece[1:] != piece[:-1]) | (b[1:] != b[:-1])))
                ends, none = np.append(edge, len(h)), np.zeros(len(edge) + 1, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp[piece[edge]]), pa.array(ph[piece[edge]]), _list(none[:0].astype(np.int32), none, pa.int32()), pa.array(b[edge]),
                     _list(at.astype(np.int32), ends, pa.int32()), _list(h, ends, pa.int64())], names=schema.names)

    return parts.mapInArrow(run, schema)


def met(shared: DataFrame) -> DataFrame:
    """``(fp, ph, runs)`` of the lone strings of ``collected``'s rows that another collection of their anchor has too."""
    schema = T.StructType([T.StructField("fp", T.LongType()), T.StructField("ph", T.LongType()), T.StructField("runs", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["fp", "b"], "h", 1):
            h, offsets = _flat(rows["h"], np.int64)
            at, _ = _flat(rows["at"], np.int64)
            _, which, often = np.unique(h, return_inverse=True, return_counts=True)
            found = np.flatnonzero((often[which] > 1) & (at >= 0))
            runs = np.stack([at[found], at[found] + 1], axis=1).reshape(-1)
            yield pa.RecordBatch.from_arrays([rows["fp"].combine_chunks(), rows["ph"].combine_chunks(), _list(runs.astype(np.int32), 2 * np.searchsorted(found, offsets), pa.int32())], names=schema.names)

    return shared.repartition("fp", "b").sortWithinPartitions("fp", "b").mapInArrow(run, schema).where("size(runs) > 0")


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, symbol: int = SYMBOL) -> DataFrame:
    """``(key, n_bytes, spans, kept)`` for each row: the maximal runs of bytes ``(start, end)`` that a repeated string of ``window`` bytes covers, and
    the text's other bytes, one after another.

    A string is repeated if it starts twice in all texts, in one text or two; it never runs across texts; and it is judged on the texts as they come in. Equal texts, also
    of rows that repeat an id, are texts of their own, so each row of a text of ``window`` bytes and more that occurs twice loses all of it.

    Null texts are empty, null ids stay null. Texts shorter than ``window`` lose nothing. No rows: no rows. Other columns are not read. Cuts fall on bytes, so ``kept`` need not be
    valid UTF-8 where a character is cut. Equality of texts, pieces and symbols rests on hashes: two of 64 bits, or one next to that of the anchor.
    """
    if window % symbol or gram > window // 2:
        raise ValueError("a symbol divides the window, and an anchor is at most half of it")
    whole = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).select(
        "id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(11), F.col("text"), F.length("text")).alias("k2"))
    long = whole.where(F.octet_length("text") >= window).select("k1", "k2", "text")
    names = ["fp", "ph", "lo", "len", "anchor"]
    cut = piece_table(long, window, gram).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("m"), F.first(F.struct(*names)).alias("p"))
    cut = cut_lineage(cut.select("k1", "k2", "m", "p.*"))
    often = cut_lineage(cut.select("m", F.explode("fp").alias("fp")).groupBy("fp").agg(F.sum("m").alias("all")).where("all > 1").select("fp"))
    placed = cut.select("k1", "k2", "m", F.explode(F.arrays_zip(*names)).alias("p")).select("k1", "k2", "m", "p.*").join(small(often, ANCHORS), "fp", "left_semi")
    classes = cut_lineage(placed.groupBy("fp", "ph").agg(F.sum("m").alias("m"), F.min(F.struct("k1", "k2", "lo", "len", "anchor")).alias("at")))
    sizes = classes.groupBy("fp").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("dealt"))
    wanted = classes.join(sizes, "fp").select(
        "at.k1", "at.k2", F.struct("fp", F.pmod("ph", "dealt").alias("s"), "ph", "m", "at.anchor", "dealt", "at.lo", "at.len").alias("p"))
    by_text = cut_lineage(wanted.groupBy("k1", "k2").agg(F.collect_list("p").alias("p")))
    texts = long.join(small(by_text.select("k1", "k2"), WANTED), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("text").alias("text"))
    parts = texts.join(by_text, ["k1", "k2"]).select(F.encode("text", "UTF-8").alias("b"), F.explode("p").alias("p")).select(
        "p.fp", "p.s", "p.ph", "p.m", "p.anchor", "p.dealt", F.substring("b", F.col("p.lo") + 1, F.col("p.len")).alias("bytes"))
    found = cut_lineage(collected(parts.repartition("fp", "s").sortWithinPartitions("fp", "s"), window, symbol))
    runs = found.where("size(runs) > 0").select("fp", "ph", "runs").unionByName(met(found.where("b is not null").select("fp", "ph", "b", "at", "h")))
    spans = placed.select("k1", "k2", "fp", "ph", "lo").join(runs, ["fp", "ph"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "runs")).alias("runs"))
    return _without(whole.join(spans, ["k1", "k2"], "left").select("id", "text", "runs"), window).withColumnRenamed("id", key)


def _without(rows: DataFrame, window: int) -> DataFrame:
    schema = T.StructType([rows.schema["id"], T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType(
        [T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType())])

    def merged(runs: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        pairs = np.concatenate([np.array(r["runs"], np.int64).reshape(-1, 2) + r["lo"] for r in runs])
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        start, end = pairs[:, 0], np.maximum.accumulate(pairs[:, 1] - 1 + window)
        edge = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
        return start[edge], np.append(end[edge[1:] - 1], end[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in arrays.chunks(batch.column(1)):
                spans, kept = [], []
                for i, runs in enumerate(batch.column(2).slice(a, b - a).to_pylist()):
                    own = data[offsets[i]:offsets[i + 1]]
                    if runs:
                        start, end = merged(runs)
                        inside = np.zeros(len(own) + 1, np.int8)
                        inside[start] = 1
                        inside[end] -= 1
                        own = own[np.cumsum(inside[:-1]) == 0]
                        spans.append([{"start": s, "end": e} for s, e in zip(start.tolist(), end.tolist())])
                    else:
                        spans.append([])
                    kept.append(own.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(offsets), pa.int64()), pa.array(spans, schema_spans), pa.array(kept, pa.binary())], names=schema.names)

    schema_spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return rows.mapInArrow(run, schema)
