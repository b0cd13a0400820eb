"""Exact BPE merges of many words at once, and a store of words already merged."""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from devicehealth.llm.pretoken import Pieces, Splitter, special_key

#: Words of more symbols are merged one by one with a heap.
LONG = 400


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Vocabulary and merges of a tokenizers BPE file, given as its text."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.normalizer = Tokenizer.from_str(text).normalizer
        self.ids: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        letters = _byte_letters()
        self.bytes = {c: b for b, c in enumerate(letters)}
        self.inner = np.array([self.ids[c] for c in letters], np.int64)
        self.last = np.array([self.ids[c + self.end] for c in letters], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        key = np.array([self.ids[a] << 32 | self.ids[b] for a, b in pairs], np.int64)
        made = np.array([self.ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.pair, self.rank, self.made = key[order], order.astype(np.int64), made[order]
        self.none = len(pairs)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], self.none), at

    def _long(self, symbols: list[int]) -> list[int]:
        """One word by a heap of pairs, in the order rank, then place."""
        left, right = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
        ranks, at = self._ranks(np.array(symbols[:-1], np.int64), np.array(symbols[1:], np.int64))
        heap = [(r, i, symbols[i], symbols[i + 1], m) for i, (r, m) in enumerate(zip(ranks.tolist(), self.made[at].tolist())) if r < self.none]
        heapq.heapify(heap)

        def push(i: int, j: int) -> None:
            key = symbols[i] << 32 | symbols[j]
            k = int(np.searchsorted(self.pair, key))
            if k < len(self.pair) and self.pair[k] == key:
                heapq.heappush(heap, (int(self.rank[k]), i, symbols[i], symbols[j], int(self.made[k])))

        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = right[i]
            if symbols[i] != a or j >= len(symbols) or symbols[j] != b:
                continue
            symbols[i], symbols[j] = made, -1
            right[i] = right[j]
            if right[j] < len(symbols):
                left[right[j]] = i
                push(i, right[i])
            if left[i] >= 0:
                push(left[i], i)
        return [s for s in symbols if s >= 0]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after another, and their offsets. In each round every word makes its lowest merge."""
        sizes = np.array([len(w) for w in words], np.int64)
        done: dict[int, list[int]] = {}
        for i in np.flatnonzero(sizes > LONG).tolist():
            done[i] = self._long([*self.inner[list(words[i][:-1])].tolist(), int(self.last[words[i][-1]])])
        some = np.flatnonzero((sizes > 0) & (sizes <= LONG))
        data = np.frombuffer(b"".join(words[i] for i in some.tolist()), np.uint8)
        owner = np.repeat(np.arange(len(some)), sizes[some])
        symbols = self.inner[data]
        tail = np.cumsum(sizes[some]) - 1
        symbols[tail] = self.last[data[tail]]
        ready_s, ready_o = [], []
        rank, at = np.full(len(symbols), self.none, np.int64), np.zeros(len(symbols), np.int64)
        where = np.flatnonzero(owner[:-1] == owner[1:])
        rank[where], at[where] = self._ranks(symbols[where], symbols[where + 1])
        while len(symbols):
            begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(rank, begins)
            low = np.repeat(lowest, np.diff(np.append(begins, len(symbols))))
            over = low == self.none
            ready_s.append(symbols[over])
            ready_o.append(owner[over])
            # Of neighbouring hits, as in "aaa", the first, third and so on are merged.
            places = np.flatnonzero((rank == low) & ~over)
            new = np.append(True, np.diff(places) != 1)
            order = np.arange(len(places))
            places = places[(order - np.maximum.accumulate(np.where(new, order, 0))) % 2 == 0]
            symbols[places] = self.made[at[places]]
            stay = ~over
            stay[places + 1] = False
            moved = np.cumsum(stay)[places] - 1
            symbols, owner, rank, at = symbols[stay], owner[stay], rank[stay], at[stay]
            # Only the pairs at and before a merged symbol are new.
            rank[moved] = self.none
            left = np.concatenate([moved, moved[moved > 0] - 1])
            left = left[left + 1 < len(symbols)]
            left = left[owner[left] == owner[left + 1]]
            rank[left], at[left] = self._ranks(symbols[left], symbols[left + 1])
        flat = np.concatenate(ready_s) if ready_s else np.zeros(0, np.int64)
        who = np.concatenate(ready_o) if ready_o else np.zeros(0, np.int64)
        order = np.argsort(who, kind="stable")
        flat, who = flat[order], some[who[order]]
        if done:
            flat = np.concatenate([flat, *(np.array(s, np.int64) for s in done.values())])
            who = np.concatenate([who, *(np.full(len(s), i) for i, s in done.items())])
            order = np.argsort(who, kind="stable")
            flat, who = flat[order], who[order]
        return flat, np.searchsorted(who, np.arange(len(words) + 1))

    def splitter(self) -> Splitter:
        return Splitter(self.normalizer is not None, self.special, self.normalizer)


@lru_cache(maxsize=2)
def vocabulary(text: str) -> Vocabulary:
    """Kept by the process, so a Python worker reads the file once."""
    return Vocabulary(text)


def file_text(path: str) -> str:
    """The tokenizer's file, read by the driver; its size is bounded by the vocabulary."""
    with open(path, encoding="utf-8") as f:
        return f.read()


class Store:
    """Ids of the words met by this task, looked up by key. Beyond ``limit`` words it starts anew."""

    def __init__(self, encode, special: dict[str, int], limit: int = 400_000):
        self.encode, self.limit = encode, limit
        self.fixed = {special_key(i): i for i in special.values()}
        self._clear()

    def _clear(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.values, self.offsets = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def places(self, keys: np.ndarray, pieces: Pieces, at: np.ndarray) -> np.ndarray:
        """Rows of the ragged ``values`` for sorted distinct keys, whose words begin at pieces ``at``."""
        if len(self.keys) > self.limit:
            self._clear()
        where = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[where] == keys if len(self.keys) else np.zeros(len(keys), bool)
        new = np.flatnonzero(~known)
        if len(new):
            plain = [i for i in new.tolist() if int(keys[i]) not in self.fixed] if self.fixed else new.tolist()
            values, offsets = self.encode([pieces.word(int(at[i])).encode() for i in plain])
            if len(plain) < len(new):
                sizes = np.ones(len(new), np.int64)
                ordinary = np.isin(new, plain)
                sizes[ordinary] = np.diff(offsets)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                every = np.zeros(offsets[-1], np.int64)
                mask = np.repeat(ordinary, sizes)
                every[mask] = values
                every[~mask] = [self.fixed[int(keys[i])] for i in new[~ordinary].tolist()]
                values = every
            rows = len(self.offsets) - 1 + np.arange(len(new))
            self.values = np.concatenate([self.values, values])
            self.offsets = np.concatenate([self.offsets, offsets[1:] + self.offsets[-1]])
            merged = np.concatenate([self.keys, keys[new]])
            order = np.argsort(merged, kind="stable")
            self.keys, self.place = merged[order], np.concatenate([self.place, rows])[order]
            where = np.searchsorted(self.keys, keys)
        return self.place[where]
