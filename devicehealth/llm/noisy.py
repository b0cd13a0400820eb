"""Noisy-channel restoration of disguised words: character lattices decoded under a character language model."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from devicehealth.llm import arrays

#: Letters that a sign can stand for; fixed values of common substitutions.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l"}
#: Bits for a substitution, for dropping a separator, for ending a word at one, for dropping a sign that can be a letter, for shortening a run of a letter, for leaving it,
#: for taking a letter for a repeat of the one before it.
SUBSTITUTED, DROPPED, CLOSED, IGNORED, SHORTENED, LEFT, REPEATED = 1.0, 1.0, 2.0, 10.0, 1.0, 8.0, 2.0
#: Tokens whose words are held.
HELD = 50_000
#: Symbols of the language model: 0 is a word's edge, 1-26 the letters, 27 any other letter.
SYMBOLS = 28
_OF_BYTE = np.zeros(256, np.int64)
_OF_BYTE[97:123] = np.arange(1, 27)
_OF_BYTE[128:] = 27


def trigrams(data: np.ndarray) -> np.ndarray:
    """Counts of neighbouring symbols in lowered bytes, as a flat cube."""
    s = _OF_BYTE[arrays.LOWER[data]]
    if len(s) < 3:
        return np.zeros(SYMBOLS ** 3, np.int64)
    return np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS ** 3)


def costs(counts: np.ndarray) -> np.ndarray:
    """Bits of a symbol behind two others; shares mixed with those behind one and behind none."""
    cube = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    none = (cube.sum(axis=(0, 1)) + 1) / (cube.sum() + SYMBOLS)
    pair = cube.sum(axis=0)
    one = (pair + 5 * none) / (pair.sum(axis=1, keepdims=True) + 5)
    return -np.log2((cube + 5 * one[None]) / (cube.sum(axis=2, keepdims=True) + 5))


def _symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 0 if c == " " else 27


_STATES = SYMBOLS ** 2
_SEPARATOR = [("", [], DROPPED), (" ", [0], CLOSED)]


class Restorer:
    """Most likely plain words of a disguised token, with a blank between two."""

    def __init__(self, cost: np.ndarray):
        self.cost = cost.reshape(-1).tolist()
        self._runs: dict[tuple[str, int, bool], list] = {}
        #: By the symbols before, of and behind a double: whether one letter of it is likelier than both.
        double = cost[np.arange(SYMBOLS), np.arange(SYMBOLS)]
        self.single = np.einsum("bcc->bc", cost)[:, :, None] + double[None] > cost + REPEATED
        self.hidden = lru_cache(maxsize=HELD)(self._hidden)
        self._known: dict[int, tuple[list[str], str]] = {}

    def known(self, key: int, token: Callable[[], str]) -> tuple[list[str], str]:
        """``hidden`` of the token with this 64-bit hash, whose letters are asked for only if it has not been met."""
        found = self._known.get(key)
        if found is None:
            if len(self._known) >= HELD:
                self._known.clear()
            found = self._known[key] = self.hidden(token())
        return found

    def _arcs(self, c: str, n: int, last: bool) -> list[tuple[str, list[int], float]]:
        """What a run of ``n`` equal signs can stand for, its symbols, and the bits of that."""
        if c.isalpha():
            out = [(c, 0.0)] if n < 2 else [(c, REPEATED), (c * 2, 0.0)] if n < 3 else [(c, SHORTENED), (c * 2, SHORTENED), (c * n, LEFT)]
        else:
            runs = {1, min(n, 2)}
            # An exclamation mark at the end may be just that.
            out = [(x * r, SUBSTITUTED * n) for x in LEET[c] for r in runs] + [("", DROPPED if c == "!" and last else IGNORED * n)]
        return [(letters, [_symbol(x) for x in letters], bits) for letters, bits in out]

    def _lattice(self, token: str) -> list[list[tuple[str, list[int], float]]]:
        """For each sign or run of a sign: what it can stand for, its symbols, and the bits of that."""
        out, i = [], 0
        while i < len(token):
            c, j = token[i], i + 1
            while j < len(token) and token[j] == c:
                j += 1
            if c.isalpha() or c in LEET:
                run = c, j - i, j == len(token)
                arcs = self._runs.get(run)
                if arcs is None:
                    arcs = self._arcs(*run)
                    if j - i <= 4 and c.isascii():
                        self._runs[run] = arcs
                out.append(arcs)
            else:
                # A stretch of separators stands between two letters or between two words.
                while j < len(token) and not token[j].isalpha() and token[j] not in LEET:
                    j += 1
                out.append(_SEPARATOR)
            i = j
        return out

    def _hidden(self, token: str) -> tuple[list[str], str]:
        """``(words, whole)``: what the token stands for beside the words written in it; the token itself if it is letters only."""
        whole = token if token.isalpha() else ""
        written = Counter([whole] if whole else "".join(c if c.isalpha() else " " for c in token).split())
        words = []
        for w in self.restore(token).split():
            if written[w]:
                written[w] -= 1
            else:
                words.append(w)
        return words, whole

    def restore(self, token: str) -> str:
        # What is said so far is a chain of letters, each with those before it; a state is the last two symbols.
        cost = self.cost
        best: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for arcs in self._lattice(token):
            step: dict[int, tuple[float, tuple | None]] = {}
            for letters, symbols, channel in arcs:
                first = symbols[0] if symbols and 1 <= symbols[0] <= 26 else -1
                for start, (bits, said) in best.items():
                    state, total = start, bits + channel
                    for s in symbols:
                        at = state * SYMBOLS + s
                        total += cost[at]
                        state = at % _STATES
                    old = step.get(state)
                    if old is None or total < old[0]:
                        step[state] = total, (said, letters) if letters else said
                    if start % SYMBOLS == first:
                        state, total = start, bits + channel + REPEATED
                        for s in symbols[1:]:
                            at = state * SYMBOLS + s
                            total += cost[at]
                            state = at % _STATES
                        old = step.get(state)
                        if old is None or total < old[0]:
                            step[state] = total, (said, letters[1:]) if letters[1:] else said
            best = step
        _, said = min(((bits + cost[state * SYMBOLS], said) for state, (bits, said) in best.items()), key=lambda x: x[0])
        out = []
        while said is not None:
            said, letters = said
            out.append(letters)
        return "".join(reversed(out)).strip()


_last: tuple[bytes, Restorer] | None = None


def restorer(cost: np.ndarray) -> Restorer:
    """The restorer of these costs; tasks that a Python worker runs one after another share it and the tokens it knows."""
    global _last
    name = cost.tobytes()
    if _last is None or _last[0] != name:
        _last = name, Restorer(cost)
    return _last[1]
