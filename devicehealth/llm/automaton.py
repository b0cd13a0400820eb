"""A minimal acyclic transducer from words to id lists: shared prefixes and suffixes, mapped from one file."""

from __future__ import annotations

import numpy as np

_PARTS = ("first", "label", "target", "skip", "final", "offsets", "values")


def build(words: list[bytes], ids: list[list[int]]) -> dict[str, np.ndarray]:
    """Arrays of the automaton of distinct words in byte order, each with its ids.

    Words are added in order; what the next word can no longer change is replaced by an equal state already registered,
    so the automaton is minimal at the end. An arc carries how many words lie before it among its state's words; the sum
    along a path, with the words that end on the way, is the word's number, which leads to its ids.
    """
    # A state: [final, labels, targets]; registered states are known by their content.
    states: list[tuple[bool, tuple[int, ...], tuple[int, ...]]] = []
    registry: dict[tuple, int] = {}
    path: list[list] = [[False, [], []]]
    before = b""

    def freeze(depth: int) -> None:
        while len(path) > depth + 1:
            final, labels, targets = path.pop()
            content = (final, tuple(labels), tuple(targets))
            if content not in registry:
                registry[content] = len(states)
                states.append(content)
            path[-1][2].append(registry[content])

    for word in words:
        shared = 0
        while shared < min(len(word), len(before)) and word[shared] == before[shared]:
            shared += 1
        freeze(shared)
        for c in word[shared:]:
            path[-1][1].append(c)
            path.append([False, [], []])
        path[-1][0] = True
        before = word
    freeze(0)
    states.append((path[0][0], tuple(path[0][1]), tuple(path[0][2])))

    below = [0] * len(states)  # words that can be read from a state; targets come before their sources
    first, label, target, skip = [0], [], [], []
    for s, (final, labels, targets) in enumerate(states):
        n = int(final)
        for c, t in zip(labels, targets):
            label.append(c)
            target.append(t)
            skip.append(n)
            n += below[t]
        below[s] = n
        first.append(len(label))
    return {"first": np.array(first, np.int64), "label": np.array(label, np.int64), "target": np.array(target, np.int64), "skip": np.array(skip, np.int64),
            "final": np.array([s[0] for s in states], np.int64), "offsets": np.cumsum([0, *map(len, ids)]).astype(np.int64),
            "values": np.array([i for one in ids for i in one], np.int64)}


def save(arrays: dict[str, np.ndarray], path: str) -> None:
    """One file: the sizes of the arrays, then the arrays."""
    with open(path, "wb") as f:
        np.array([len(arrays[p]) for p in _PARTS], np.int64).tofile(f)
        for p in _PARTS:
            arrays[p].astype(np.int64).tofile(f)


class Lexicon:
    """The automaton of a file, mapped into memory, so that workers of one machine share its pages."""

    def __init__(self, path: str):
        data = np.memmap(path, np.int64, "r")
        sizes = data[:len(_PARTS)]
        ends = len(_PARTS) + np.cumsum(sizes)
        for p, a, b in zip(_PARTS, ends - sizes, ends):
            setattr(self, p, data[a:b])
        states = len(self.first) - 1
        self.root = states - 1
        # Arcs in the order of (state, label), so one search finds the arc of any state and byte.
        self.key = np.repeat(np.arange(states), np.diff(self.first)) << 8 | self.label

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for one that the lexicon has not; all words advance a byte at a time together."""
        out = np.full(len(words), -1, np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        if not len(self.key):
            return out
        begin = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        live = np.flatnonzero(sizes > 0)
        state, number = np.full(len(live), self.root), np.zeros(len(live), np.int64)
        depth = 0
        while len(live):
            key = state << 8 | data[begin[live] + depth]
            arc = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            go = self.key[arc] == key
            live, arc = live[go], arc[go]
            state, number = self.target[arc], number[go] + self.skip[arc]
            depth += 1
            ended = sizes[live] == depth
            hit = ended & (self.final[state] == 1)
            out[live[hit]] = number[hit]
            live, state, number = live[~ended], state[~ended], number[~ended]
        return out
