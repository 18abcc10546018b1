"""A minimal acyclic transducer from byte strings to lists of ids, in flat arrays that can be memory-mapped.

Equal suffixes share states. Arcs carry additive outputs: their sum along a word is the word's rank,
and the rank indexes the lists of ids.
"""

from __future__ import annotations

import mmap

import numpy as np

_MAGIC = 0x4C554D31


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The transducer of some words and their ids (words must not be empty)."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, list[tuple[int, int]]]] = []  # final, arcs (label, target), children first

    def close(final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, tuple(arcs))
        at = register.get(key)
        if at is None:
            at = register[key] = len(states)
            states.append((final, arcs))
        return at

    order = sorted(entries)
    path: list[tuple[list[bool], list[tuple[int, int]]]] = [([False], [])]
    last = b""
    for word in order:
        common = 0
        while common < min(len(last), len(word)) and last[common] == word[common]:
            common += 1
        for k in range(len(last), common, -1):
            final, arcs = path.pop()
            path[-1][1].append((last[k - 1], close(final[0], arcs)))
        for _ in range(common, len(word)):
            path.append(([False], []))
        path[-1][0][0] = True
        last = word
    for k in range(len(last), 0, -1):
        final, arcs = path.pop()
        path[-1][1].append((last[k - 1], close(final[0], arcs)))
    root = close(path[0][0][0], path[0][1])

    count = [0] * len(states)  # words that can be ended from a state
    first = np.zeros(len(states) + 1, np.uint32)
    final = np.zeros(len(states), np.uint32)
    label, target, output = [], [], []
    for s, (is_final, arcs) in enumerate(states):
        n = int(is_final)
        final[s] = is_final
        for c, t in arcs:
            label.append(c)
            target.append(t)
            output.append(n)
            n += count[t]
        count[s] = n
        first[s + 1] = len(label)
    ids = [entries[w] for w in order]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.uint32)
    label += [0] * (-len(label) % 4)
    arrays = [first, final, np.array(label, np.uint8).view(np.uint32), np.array(target, np.uint32), np.array(output, np.uint32), ends, np.array([i for x in ids for i in x], np.uint32)]
    head = np.array([_MAGIC, root, *map(len, arrays)], np.uint32)
    return b"".join(x.tobytes() for x in (head, *arrays))


class Lexicon:
    """Look words up in a compiled transducer, in a mapped file or in bytes."""

    def __init__(self, data: bytes | mmap.mmap) -> None:
        view = memoryview(data).cast("I")
        if view[0] != _MAGIC:
            raise ValueError("not a lexicon")
        self.root, at, parts = view[1], 9, []
        self.data, self.labels = data, 4 * (9 + view[2] + view[3])  # labels are searched as bytes
        for n in view[2:9]:
            parts.append(view[at : at + n])
            at += n
        self.first, self.final, _, self.target, self.output, self.ends, self.ids = parts

    @classmethod
    def map(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    @property
    def n_states(self) -> int:
        return len(self.final)

    def get(self, word: bytes) -> list[int] | None:
        first, target, output, find, base, s, rank = self.first, self.target, self.output, self.data.find, self.labels, self.root, 0
        for k in range(len(word)):
            at = find(word[k : k + 1], base + first[s], base + first[s + 1]) - base
            if at < 0:
                return None
            rank += output[at]
            s = target[at]
        return list(self.ids[self.ends[rank] : self.ends[rank + 1]]) if self.final[s] else None
