"""The subword lattice of a word: all its segmentations into vocabulary pieces, by array operations on many words.

Log-space forward and backward recursions run over the ends of pieces; pieces are looked up by a hash of
their characters. A character that is no piece is spelled by the vocabulary's byte pieces, and so is the mark of a
word's start inside a word: no segmentation of a word is one of two words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from lumora.llm.common import codepoints, mix

_P = 0xBF58476D1CE4E5B9 | 1
_LONG = 64
_ROWS = 4096
_SLOTS = 1 << 20
#: Words less likely than this are worked out by logarithms.
_FAINT = 1e-200
WORD_START = "▁"
#: Stands for a word-start character inside a word, which no piece holds there: it is spelled by bytes.
_INNER = 0x110000


def _powers(x: int, n: int) -> np.ndarray:
    out = np.full(n, x, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _strings(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters of all strings, where each one starts and how long it is."""
    lens = np.fromiter(map(len, strings), np.int64, len(strings))
    return codepoints("".join(strings)), np.cumsum(lens) - lens, lens


class Lattice:
    def __init__(self, pieces: list[str], logp: np.ndarray, bytes_at: np.ndarray) -> None:
        """``pieces``: strings, empty for those that spell nothing (control and byte pieces); ``bytes_at``: index of each byte's piece."""
        self.logp, self.bytes_at = np.asarray(logp, float), bytes_at
        self.p = np.exp(self.logp)
        self.longest = max((len(p) for p in pieces), default=1)
        self.up, self.down = _powers(_P, _LONG + 2), _powers(pow(_P, -1, 2**64), _LONG + 2)
        of = np.flatnonzero([0 < len(p) <= _LONG for p in pieces])
        chars, starts, lens = _strings([pieces[i] for i in of])
        values, h, begins = self._value(chars), np.zeros(len(of), np.uint64), []
        with np.errstate(over="ignore"):
            for size in range(1, self.longest + 1):  # the hashes of the pieces' first characters
                some = np.flatnonzero(lens >= size)
                h[some] += values[starts[some] + size - 1] * self.up[size - 1]
                begins.append((h[some], np.where(lens[some] == size, of[some], -1)))
            self._fill(*map(np.concatenate, zip(*begins, strict=True)))
        self.rare: dict[int, float] = {}

    @staticmethod
    def _value(c: np.ndarray) -> np.ndarray:
        return mix(c.astype(np.uint64) + np.uint64(0x1234567))

    def _fill(self, h: np.ndarray, ids: np.ndarray) -> None:
        """A table of all beginnings of pieces by hash; ``piece`` has the piece that a beginning is, or -1."""
        order = np.lexsort((-ids, h))  # the piece of a beginning first
        h, ids = h[order], ids[order]
        first = np.append(True, h[1:] != h[:-1])[: len(h)]
        h, ids = h[first], ids[first]
        self.piece = np.append(ids, -1).astype(np.int32)
        self.slot, self.keys = np.full(_SLOTS + 64, -1, np.int32), np.zeros(_SLOTS + 64, np.uint64)
        at, left = (mix(h) >> np.uint64(44)).astype(np.int64), np.arange(len(h))
        while len(left):
            free = left[self.slot[at[left]] < 0]
            _, one = np.unique(at[free], return_index=True)
            self.slot[at[free[one]]], self.keys[at[free[one]]] = free[one], h[free[one]]
            left = left[self.slot[at[left]] != left]
            at[left] += 1

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The place in ``piece`` of each hash, or -1: no piece begins so."""
        at = (mix(h) >> np.uint64(44)).astype(np.int64)
        out = self.slot[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[at] != h))
        while len(open_):
            at[open_] += 1
            out[open_] = self.slot[at[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[at[open_]] != h[open_])]
        return out

    def _byte_pieces(self, c: int) -> np.ndarray:
        return self.bytes_at[list((WORD_START if c == _INNER else chr(c)).encode("utf-8", "replace"))]

    def _spelled(self, c: int) -> float:
        got = self.rare.get(c)
        if got is None:
            got = self.rare[c] = float(self.logp[self._byte_pieces(c)].sum())
        return got

    def _arcs(self, c: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each start and end the rows with an arc, its pieces (-1: spelled) and their log-probabilities; only rows whose
        characters from the start begin a piece are looked at further."""
        n, length = c.shape
        h = np.zeros((length + 1, n), np.uint64)
        np.cumsum((self._value(c) * self.up[:length]).T, axis=0, out=h[1:])
        for start in range(length):
            live = np.arange(n)
            for end in range(start + 1, min(length, start + self.longest) + 1):
                found = self._find((h[end, live] - h[start, live]) * self.down[start])
                ids = self.piece[found]
                on = ids >= 0
                if end - start == 1:
                    lp = self.logp[ids]
                    for i in np.flatnonzero(~on):
                        lp[i] = self._spelled(int(c[i, start]))
                    yield end, start, live, ids, lp
                elif on.any():
                    yield end, start, live[on], ids[on], self.logp[ids[on]]
                live = live[found >= 0]
                if not len(live):
                    break

    def _forward(self, c: np.ndarray, arcs: list | None) -> np.ndarray:
        alpha = np.full((c.shape[1] + 1, c.shape[0]), -np.inf)
        alpha[0] = 0.0
        for end, start, rows, ids, lp in self._arcs(c):
            alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[start, rows] + lp)
            if arcs is not None:
                arcs.append((end, start, rows, ids, lp))
        return alpha

    def _long(self, c: np.ndarray, count: float = 0.0, into: np.ndarray | None = None) -> float:
        """One long word; arcs by array operations, the recursions over its positions."""
        n = len(c)
        v = self._value(c)
        table = []
        for size in range(1, min(n, self.longest) + 1):
            h = np.zeros(n - size + 1, np.uint64)
            for k in range(size):
                h += v[k : n - size + 1 + k] * self.up[k]
            ids = self.piece[self._find(h)]
            lp = np.append(self.logp, -np.inf)[ids]
            if size == 1:
                for i in np.flatnonzero(ids < 0):
                    lp[i] = self._spelled(int(c[i]))
            table.append((ids, lp))
        alpha = np.full(n + 1, -np.inf)
        alpha[0] = 0.0
        for end in range(1, n + 1):
            alpha[end] = np.logaddexp.reduce([alpha[end - s] + table[s - 1][1][end - s] for s in range(1, min(end, len(table)) + 1)])
        if into is not None:
            beta = np.full(n + 1, -np.inf)
            beta[n] = 0.0
            for at in range(n - 1, -1, -1):
                beta[at] = np.logaddexp.reduce([beta[at + s] + table[s - 1][1][at] for s in range(1, min(n - at, len(table)) + 1)])
            for s, (ids, lp) in enumerate(table, 1):
                post = count * np.exp(alpha[: n - s + 1] + lp + beta[s:] - alpha[n])
                into += np.bincount(ids[ids >= 0], post[ids >= 0], len(into))
                if s == 1:
                    for i in np.flatnonzero(ids < 0):
                        np.add.at(into, self._byte_pieces(int(c[i])), post[i])
        return float(alpha[n])

    def _groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of words of one length and their characters."""
        chars, starts, lens = _strings([w.decode("utf-8", "replace") for w in words])
        chars = np.where(chars == ord(WORD_START), np.uint32(_INNER), chars)
        for length in np.unique(lens):
            rows = np.flatnonzero(lens == length)
            for k in range(0, len(rows), _ROWS):
                part = rows[k : k + _ROWS]
                c = np.full((len(part), length + 1), ord(WORD_START), np.uint32)
                c[:, 1:] = chars[starts[part][:, None] + np.arange(length)]
                yield part, c

    def log_prob(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's marginal probability over all segmentations."""
        out = np.zeros(len(words))
        with np.errstate(over="ignore", invalid="ignore"):
            for rows, c in self._groups(words):
                out[rows] = self._forward(c, None)[-1] if c.shape[1] <= _LONG else [self._long(x) for x in c]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected number of each piece in words that occur ``counts`` times."""
        out = np.zeros(len(self.logp))
        with np.errstate(over="ignore", invalid="ignore"):
            for rows, c in self._groups(words):
                n = counts[rows].astype(float)
                if c.shape[1] > _LONG:
                    for x, k in zip(c, n, strict=True):
                        self._long(x, k, out)
                    continue
                # probabilities as they are: logarithms only for words that are too unlikely for them
                faint = self._expected(c, n, out)
                if not len(faint):
                    continue
                c, n = c[faint], n[faint]
                arcs, found, weight = [], [], []
                alpha = self._forward(c, arcs)
                beta = np.full(alpha.shape, -np.inf)
                beta[-1] = 0.0
                for end, start, at, ids, lp in reversed(arcs):
                    through = lp + beta[end, at]
                    post = n[at] * np.exp(alpha[start, at] + through - alpha[-1, at])
                    on = ids >= 0
                    found.append(ids[on])
                    weight.append(post[on])
                    for i in np.flatnonzero(~on):
                        np.add.at(out, self._byte_pieces(int(c[at[i], start])), post[i])
                    beta[start, at] = np.logaddexp(beta[start, at], through)
                out += np.bincount(np.concatenate(found), np.concatenate(weight), len(out))
        return out

    def _expected(self, c: np.ndarray, n: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Adds the expected pieces of words of one length that occur ``n`` times; the rows of those under ``_FAINT`` are left out and returned."""
        arcs, found, weight = [], [], []
        alpha = np.zeros((c.shape[1] + 1, c.shape[0]))
        alpha[0] = 1.0
        for end, start, rows, ids, lp in self._arcs(c):
            p = np.exp(lp) if end - start == 1 else self.p[ids]
            alpha[end, rows] += alpha[start, rows] * p
            arcs.append((end, start, rows, ids, p))
        fine = alpha[-1] > _FAINT
        beta = np.zeros(alpha.shape)
        beta[-1, fine] = n[fine] / alpha[-1, fine]  # 0 for the others: they give nothing
        for end, start, at, ids, p in reversed(arcs):
            through = p * beta[end, at]
            post = alpha[start, at] * through
            if end - start == 1:
                off = np.flatnonzero(ids < 0)
                for i in off:
                    np.add.at(out, self._byte_pieces(int(c[at[i], start])), post[i])
                if len(off):
                    ids, post = ids[ids >= 0], post[ids >= 0]
            found.append(ids)
            weight.append(post)
            beta[start, at] += through
        out += np.bincount(np.concatenate(found), np.concatenate(weight), len(out))
        return np.flatnonzero(~fine)
