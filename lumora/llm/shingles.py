"""Word hashes and word shingles of whole texts, by array operations on UTF-8 bytes.

Words are runs of bytes other than space and \\t \\n \\v \\f \\r, with A-Z lower-cased. The hash of a word is the sum, modulo
2**64, of a pseudo-random number for each of its bytes and their places in the word: no rule of the bytes, as in a
polynomial, can make the hashes of two words equal, and two different words share one with a chance of about 2**-64. Shingles are
64-bit hashes of the words' hashes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from lumora.llm.common import mix

_STEP = 1 << 20
#: Places in a word whose numbers are in a table; those of later ones are computed.
_PLACES = 64


@lru_cache(1)
def _table() -> np.ndarray:
    """The number of each byte (A-Z as a-z, 0 for separators) at each of the first places of a word."""
    out = _number(np.repeat(np.arange(_PLACES), 256), np.tile(np.arange(256), _PLACES)).reshape(_PLACES, 256)
    return out.ravel()


def _number(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    byte = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
    with np.errstate(over="ignore"):
        out = mix((place.astype(np.uint64) * np.uint64(256) + byte.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
    out[(byte == 32) | ((byte >= 9) & (byte <= 13))] = 0
    return out


def _is_word(data: np.ndarray) -> np.ndarray:
    return ~((data == 32) | ((data >= 9) & (data <= 13)))


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of a block, and the index of its text."""
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    word = _is_word(data)
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = offs[:-1]
    edges = edges[edges < len(data)]
    first[edges] = word[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # parts of at most _STEP bytes that begin with a word
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(starts, base + _STEP)) - 1) if len(data) - base > _STEP else len(starts)
        end = int(starts[to]) if to < len(starts) else len(data)
        s = starts[at:to] - base
        if end - base <= _STEP:
            place = np.arange(end - base) - np.repeat(s, np.diff(s, append=end - base))
            out[at:to] = np.add.reduceat(_numbers(data[base:end], place), s)
        else:  # one word, longer than a part
            out[at] = np.add.reduce([np.add.reduce(_numbers(data[k : min(end, k + _STEP)], np.arange(k - base, min(end, k + _STEP) - base))) for k in range(base, end, _STEP)])
        at = to
    return mix(out), np.searchsorted(offs, starts, "right") - 1


def _numbers(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    table = _table()
    far = np.flatnonzero(place >= _PLACES)
    if not len(far):
        return table[place * 256 + data]
    out = table[np.minimum(place, _PLACES - 1) * 256 + data]
    out[far] = _number(place[far], data[far])
    return out


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text of a block its sorted set of hashed k-word shingles.

    A text with 1 to k-1 words has its whole sequence as the one shingle; a text without words has none.
    """
    w, _ = words(data, offs)
    n = len(offs) - 1
    with np.errstate(over="ignore"):
        of = np.zeros(n + 1, np.int64)
        np.cumsum(np.bincount(_, minlength=n), out=of[1:])
        h = w[: max(0, len(w) - k + 1)].copy()
        for j in range(1, k):
            h = mix(h) * np.uint64(3) + w[j : len(w) - k + 1 + j]
        h = mix(h)
        out = []
        for i in range(n):
            a, b = of[i], of[i + 1]
            if b - a >= k:
                out.append(np.unique(h[a : b - k + 1]))
            elif b > a:
                x = np.uint64(b - a)
                for y in w[a:b]:
                    x = mix(x * np.uint64(5) + y)
                out.append(np.array([x], np.uint64))
            else:
                out.append(np.empty(0, np.uint64))
    return out
