"""Presence of character n-grams in whole texts, in hashed buckets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from lumora.llm.common import codepoints

_PART = 1 << 18
_WORD = re.compile(r"\b[^\W\d_]+\b")


class Grams:
    """Distinct buckets of the n-grams of lower-cased texts, n in ``orders``. One text at a time, in parts."""

    def __init__(self, orders: tuple[int, ...], bits: int) -> None:
        self.orders, self.bits, self.size = tuple(sorted(orders)), bits, 1 << bits
        self.stamp = np.full(self.size, -1, np.int64)  # where a bucket was last seen, counted over all texts
        self.at = 0

    def presence(self, text: str | None, out: np.ndarray) -> None:
        """Set ``out`` to 1 in the buckets of a text and to 0 elsewhere."""
        out[:] = 0
        for h in self._buckets(text):
            out[h] = 1

    def ids(self, text: str | None) -> np.ndarray:
        """The buckets of a text, each once, in the order of their last places."""
        first, got = self.at, []
        for h in self._buckets(text):
            here = np.arange(self.at, self.at + len(h))
            self.at += len(h)
            new = self.stamp[h] < first
            self.stamp[h] = here
            got.append(h[new & (self.stamp[h] == here)])  # of repeated ones the last
        return np.concatenate(got) if got else np.empty(0, np.uint32)

    def _buckets(self, text: str | None) -> Iterator[np.ndarray]:
        if text:
            c = codepoints(text.lower())
            for at in range(0, len(c), _PART):
                yield from self._part(c[at : at + _PART + self.orders[-1] - 1])

    def _part(self, c: np.ndarray) -> Iterator[np.ndarray]:
        h, n = c * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15), 1
        shift = np.uint32(32 - self.bits)
        for order in self.orders:
            while n < order:
                if len(c) <= n:
                    return
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + c[n:] * np.uint32(0xC2B2AE3D)
                n += 1
            yield ((h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F)) >> shift


def word_trigrams(text: str, bits: int) -> Iterator[np.ndarray]:
    """Buckets of all trigrams, repeated ones too, of the words that are letters only with a blank around each; of the whole text if it has none."""
    low = text.lower()
    c = codepoints(f" {' '.join(_WORD.findall(low)) or low} ")
    for at in range(0, len(c) - 2, _PART):
        h = c[at : at + _PART + 2] * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
        for n in (1, 2):
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + c[at + n : at + n + len(h) - 1] * np.uint32(0xC2B2AE3D)
        yield ((h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - bits)
