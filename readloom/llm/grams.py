"""Fingerprints of runs of words by prefix polynomials (Rabin-Karp), for blocks of texts."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd

_BASES = (0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15)
ALL = (1 << 64) - 1


#: Masks of the first 0 to 8 bytes of a number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2 ** 64, for i below n."""
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(n, b, np.uint64)
        steps[0] = 1
        both.append(np.cumprod(steps))
    return both[0], both[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix polynomials of ``values``, and what brings a difference of two back to power 0."""
    room = 1 << max(len(values), 1).bit_length()
    power, inverse = _powers(base, room)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=out[1:])
    return out, inverse


class Block:
    """The words of some texts: where they stand, their piece and document, and the fingerprints of their runs.

    ``kind`` says of every byte whether it is part of a word (0), a blank (1) or ends a piece (2); the byte
    between texts, a newline, must not be part of a word. ``keys`` are added to the fingerprints of a text;
    ``mask`` keeps only some bits of them, to make collisions in tests.
    """

    def __init__(self, texts: list[bytes], kind: bytes, keys: np.ndarray | None = None, mask: int = ALL) -> None:
        self.text = b"\n".join(texts).lower()
        kinds = np.frombuffer(self.text.translate(kind), np.uint8)
        inside = np.concatenate(([False], kinds == 0, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        self.doc = np.searchsorted(begins, self.starts, "right") - 1
        self.piece = np.cumsum(kinds == 2, dtype=np.int32)[self.starts] if 2 in kind else self.doc
        letters, inverse = _sums(np.frombuffer(self.text, np.uint8).astype(np.uint64) + np.uint64(1), _BASES[0])
        self.words = _mixed((letters[self.ends] - letters[self.starts]) * inverse[self.starts] + (self.ends - self.starts).astype(np.uint64))
        self._words, self._inverse = _sums(self.words, _BASES[1])
        self.key = None if keys is None else keys[self.doc]
        self._mask = np.uint64(mask)

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and fingerprint of every run of ``n`` words inside a piece."""
        if len(self.starts) < n:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        first = np.flatnonzero(self.piece[: len(self.piece) - n + 1] == self.piece[n - 1 :])
        return first, self.prints(first, n)

    def prints(self, first: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        """Fingerprints of the runs of ``n`` words from ``first`` on."""
        raw = (self._words[first + n] - self._words[first]) * self._inverse[first] + np.asarray(n).astype(np.uint64)
        return _mixed(raw if self.key is None else raw + self.key[first]) & self._mask

    def letters(self, words: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8k to 8k + 7 of words, zeros after their ends."""
        at = self.starts[words] + 8 * k
        size = np.clip(self.ends[words] - at, 0, 8)
        whole = self.text + bytes(8)
        every = np.ndarray(len(self.text) + 1, "<u8", whole, strides=(1,))
        return every[np.minimum(at, len(self.text))] & _FIRST[size]

    def distinct(self) -> tuple[np.ndarray, list[bytes]]:
        """A number for every word of the block, and the words that the numbers stand for; equal fingerprints are compared byte by byte."""
        codes, values = pd.factorize(self.words)
        head = np.empty(len(values), np.int64)
        head[codes[::-1]] = np.arange(len(codes))[::-1]
        size = self.ends - self.starts
        same = size == size[head[codes]]
        todo = np.flatnonzero(same & (head[codes] != np.arange(len(codes))))
        k = 0
        while len(todo):
            same[todo] = self.letters(todo, k) == self.letters(head[codes[todo]], k)
            k += 1
            todo = todo[same[todo] & (size[todo] > 8 * k)]
        texts = [self.text[s:e] for s, e in zip(self.starts[head].tolist(), self.ends[head].tolist(), strict=True)]
        others: dict[bytes, int] = {}
        for i in np.flatnonzero(~same).tolist():
            codes[i] = others.setdefault(self.text[self.starts[i] : self.ends[i]], len(texts) + len(others))
        return codes, texts + list(others)
