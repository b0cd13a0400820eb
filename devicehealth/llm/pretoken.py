"""Splitting of texts into the pieces that a BPE tokenizer merges within, for many texts at once.

What counts as a letter, a number, white space or the lower case of a character is asked of the tokenizers library,
once for each code point met.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
from tokenizers import Regex, normalizers, pre_tokenizers

from devicehealth.llm import arrays

LETTER, NUMBER, OTHER, WHITE, UNKNOWN = 1, 2, 3, 4, 255
#: Set for code points whose normal form depends on their neighbours or is not one code point.
_DELICATE = 8
_APOSTROPHE = 39
#: Endings split off behind an apostrophe, fixed by the tokenizers' pattern.
_ENDINGS_1, _ENDINGS_2 = "stmd", ("re", "ve", "ll")


class _Characters:
    """Class and lower case of each code point met so far."""

    def __init__(self):
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self.lower = np.arange(0x110000, dtype=np.uint32)

    def learn(self, points: np.ndarray) -> None:
        met = [chr(c) for c in points.tolist()]
        text = "".join(met)
        self.kind[points] = OTHER
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
            split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
            found = [ord(c) for w, _ in split.pre_tokenize_str(text) for c in w]
            self.kind[found] = kind
        lower = normalizers.Lowercase()
        for c in met:
            low = lower.normalize_str(c)
            if len(low) == 1:
                self.lower[ord(c)] = ord(low)
            if len(low) != 1 or unicodedata.category(c) == "Cn":
                self.kind[ord(c)] |= _DELICATE

    def kinds(self, units: np.ndarray) -> np.ndarray:
        kind = self.kind[units]
        if (kind == UNKNOWN).any():
            self.learn(np.unique(units[kind == UNKNOWN]))
            kind = self.kind[units]
        return kind


CHARACTERS = _Characters()


@dataclass
class Pieces:
    """Pieces of some texts: spans of ``units`` (code points), a key for each, the first piece of each text, and
    where each text begins."""

    units: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    def word(self, i: int) -> str:
        return self.units[self.starts[i]:self.ends[i]].astype("<u4").tobytes().decode("utf-32-le")


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def special_key(number: int) -> int:
    """Key of a special token, whose string is no ordinary piece."""
    return int(arrays.mix(np.array([number + (1 << 60)], np.uint64))[0])


class Splitter:
    """``lower``: normalise as the word-end tokenizer does; its pattern drops white space and takes numbers singly.
    Otherwise the byte-level pattern: a space belongs to the piece behind it. ``special``: string to id."""

    def __init__(self, lower: bool, special: dict[str, int], normalizer=None):
        self.lower, self.special, self.normalizer = lower, special, normalizer
        self.special_re = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def split(self, data: np.ndarray, offsets: np.ndarray) -> Pieces:
        """Pieces of the texts in one buffer of UTF-8."""
        raw = data.tobytes()
        spans: list[tuple[int, int, int]] = []
        marked = bool(self.special) and any(s.encode() in raw for s in self.special)
        if not marked and raw.isascii():
            units = arrays.LOWER[data] if self.lower else data
            return self._cut(units, CHARACTERS.kinds(units), offsets, spans)
        text = raw.decode("utf-8")
        lead = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
        at = lead[offsets]
        units = _points(text)
        kind = CHARACTERS.kinds(units)
        if self.lower:
            if not (kind & _DELICATE).any() and unicodedata.is_normalized("NFC", text):
                if marked:
                    spans = [(m.start(), m.end(), self.special[m.group()]) for m in self.special_re.finditer(text)]
                units = CHARACTERS.lower[units]
            else:
                units, at, spans = self._slow(text, at)
            kind = CHARACTERS.kinds(units)
        elif marked:
            spans = [(m.start(), m.end(), self.special[m.group()]) for m in self.special_re.finditer(text)]
        inside = set(at.tolist())
        spans = [s for s in spans if not any(c in inside for c in range(s[0] + 1, s[1]))]
        return self._cut(units, kind & 7, at, spans)

    def _slow(self, text: str, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """Each text by itself, by the library's normaliser where it matters; special strings are kept as they are."""
        parts, offsets, spans, n = [], [0], [], 0
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            one = text[a:b]
            found = list(self.special_re.finditer(one)) if self.special_re else []
            cuts = [0, *(x for m in found for x in m.span()), len(one)]
            for k in range(len(cuts) - 1):
                piece = one[cuts[k]:cuts[k + 1]]
                if k % 2:
                    spans.append((n, n + len(piece), self.special[piece]))
                elif piece and not piece.isascii():
                    piece = self.normalizer.normalize_str(piece)
                else:
                    piece = piece.lower()
                parts.append(piece)
                n += len(piece)
            offsets.append(n)
        return _points("".join(parts)), np.array(offsets, np.int64), spans

    def _cut(self, units: np.ndarray, kind: np.ndarray, offsets: np.ndarray, spans: list) -> Pieces:
        n = len(units)
        none = np.zeros(0, np.int64)
        if not n:
            return Pieces(units, none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), offsets)
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        for a, b, _ in spans:
            cut[[a, b]] = True
        edge = np.ones(n + 1, bool)
        edge[1:-1] = (kind[1:] != kind[:-1]) | cut[1:-1]
        start = edge[:-1].copy()
        white = kind == WHITE
        if not self.lower:
            # The last white character before another piece is cut off its run; a space goes to the piece behind it.
            last = white & edge[1:] & ~cut[1:]
            start[last] = True
            behind = np.flatnonzero(last & (units == 32)) + 1
            start[behind] = False
        else:
            start |= kind == NUMBER
        # An apostrophe that begins a piece takes one of the fixed endings with it.
        for p in np.flatnonzero((units == _APOSTROPHE) & start).tolist():
            tail = "".join(map(chr, units[p + 1:p + 3].tolist()))
            size = 2 if tail[:1] and tail[0] in _ENDINGS_1 else 3 if tail in _ENDINGS_2 else 0
            if size and not cut[p + 1:p + size].any():
                start[p + 1:p + size] = False
                if p + size < n:
                    start[p + size] = True
        for a, b, _ in spans:
            start[a + 1:b] = False
            start[a] = True
            if b < n:
                start[b] = True
            white[a:b] = False
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], n)
        if self.lower:
            kept = ~white[starts]
            starts, ends = starts[kept], ends[kept]
        keys = arrays.spans_hash(units, starts, ends)
        for a, _, number in spans:
            keys[np.searchsorted(starts, a)] = special_key(number)
        return Pieces(units, starts, ends, keys, np.searchsorted(starts, offsets), offsets)
