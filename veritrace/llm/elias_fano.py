"""Elias-Fano coded monotone sequences, searched many at once.

n non-decreasing values below u take about log2(u/n) + 3 bits each: the low bits packed, the high bits in unary (a one a
value, a zero a step), with a count of ones before each 64-bit word. Arrays are plain and can be memory-mapped.
"""

from __future__ import annotations

import io
import json
from dataclasses import dataclass

import numpy as np

_ONE = np.uint64(1)
_CHUNK = 1 << 16


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Values of `width` bits one after another in 64-bit words, and one word more."""
    if not width:
        return np.zeros(1, np.uint64)
    parts = []
    shifts = np.arange(width, dtype=np.uint64)
    for at in range(0, len(values), _CHUNK):  # 2^16 values end on a word
        bits = ((values[at : at + _CHUNK, None] >> shifts) & _ONE).astype(np.uint8)
        parts.append(np.packbits(bits.ravel(), bitorder="little"))
    raw = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    return np.concatenate((raw, np.zeros(8 + -len(raw) % 8, np.uint8))).view("<u8")


def _in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Position of the one of the given rank (from 0) in each word."""
    at = np.zeros(len(words), np.uint64)
    rank = rank.astype(np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        part = (words >> at) & np.uint64((1 << width) - 1)
        ones = np.bitwise_count(part).astype(np.int64)
        over = rank >= ones
        at += np.where(over, np.uint64(width), np.uint64(0))
        rank -= np.where(over, ones, 0)
    return at.astype(np.int64)


@dataclass
class EliasFano:
    n: int
    width: int
    low: np.ndarray
    high: np.ndarray
    ones: np.ndarray  # before each word of high, and in all
    zeros: np.ndarray  # likewise

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        """Of non-decreasing unsigned values below universe (at most 2^64)."""
        n = len(values)
        values = values.astype(np.uint64)
        width = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        top = (values >> np.uint64(width)).astype(np.int64) if width < 64 else np.zeros(n, np.int64)
        last = (universe - 1 >> width) + 1 if universe else 0
        size = n + last + 1
        places = top + np.arange(n)
        high = np.zeros(size // 64 + 1, np.uint64)
        where, first = np.unique(places >> 6, return_index=True)
        if n:
            high[where] = np.bitwise_or.reduceat(_ONE << (places & 63).astype(np.uint64), first)
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.int64)))
        zeros = np.arange(len(ones)) * 64 - ones
        return cls(n, width, _pack(values & np.uint64((1 << width) - 1), width), high, ones, zeros)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        bit = i * self.width
        word, off = bit >> 6, (bit & 63).astype(np.uint64)
        # the second word counts only where the value goes on in it
        right, left = self.low[word] >> off, np.where(off > 0, self.low[word + 1] << (np.uint64(64) - off & np.uint64(63)), 0)
        return (right | left) & np.uint64((1 << self.width) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at positions i."""
        word = np.searchsorted(self.ones, i, "right") - 1
        place = (word << 6) + _in_word(self.high[word], i - self.ones[word])
        return (place - i).astype(np.uint64) << np.uint64(self.width) | self._lows(i)

    def _zeros_end(self, k: np.ndarray) -> np.ndarray:
        """How many values have a high part of at most k (k from -1): the ones before the zero of rank k."""
        word = np.minimum(np.searchsorted(self.zeros, np.maximum(k, 0), "right") - 1, len(self.high) - 1)
        place = (word << 6) + _in_word(~self.high[word], np.maximum(k, 0) - self.zeros[word])
        return np.where(k < 0, 0, place - k)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Positions of values, -1 where absent: the successor of each within the values of its high part."""
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        top = (values >> np.uint64(self.width)).astype(np.int64)
        at, end = self._zeros_end(top - 1), self._zeros_end(top)
        low = values & np.uint64((1 << self.width) - 1)
        live = np.flatnonzero(at < end)
        at, last, low = at[live], end[live] - 1, low[live]
        # values of one high part lie dense where a context has many children: halve what is left
        while True:
            open_ = np.flatnonzero(at < last)
            if not len(open_):
                break
            mid = (at[open_] + last[open_]) >> 1
            below = self._lows(mid) < low[open_]
            at[open_] = np.where(below, mid + 1, at[open_])
            last[open_] = np.where(below, last[open_], mid)
        same = self._lows(at) == low
        out[live[same]] = at[same]
        return out

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.ones": self.ones, f"{name}.zeros": self.zeros, f"{name}.shape": np.array([self.n, self.width], np.int64)}

    @classmethod
    def read(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, width = arrays[f"{name}.shape"].tolist()
        return cls(n, width, *(arrays[f"{name}.{x}"] for x in ("low", "high", "ones", "zeros")))


def to_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays in one block, each at a multiple of 8 bytes, after a line that says where."""
    said, body = {}, io.BytesIO()
    for name, a in arrays.items():
        body.write(bytes(-body.tell() % 8))
        said[name] = [a.dtype.str, len(a), body.tell()]
        body.write(np.ascontiguousarray(a).tobytes())
    line = json.dumps(said).encode()
    line += b" " * (-(len(line) + 1) % 8) + b"\n"
    return line + body.getvalue()


def mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file that holds to_bytes(), memory-mapped."""
    with open(path, "rb") as f:
        line = f.readline()
    whole = np.asarray(np.memmap(path, np.uint8, "r"))
    return {name: whole[len(line) + at : len(line) + at + np.dtype(kind).itemsize * n].view(kind) for name, (kind, n, at) in json.loads(line).items()}
