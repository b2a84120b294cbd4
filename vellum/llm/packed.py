"""Words of texts as hashes, and sorted 64-bit hashes as compact binary columns: a shuffle moves blocks of them, not rows."""

from __future__ import annotations

import numpy as np
import xxhash

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: The six bytes that part words.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Words of more bytes than this are hashed one by one.
LONG = 64
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def planes(values: np.ndarray) -> bytes:
    """Little-endian integers, first bytes first: the codec of the shuffle then removes the empty high bytes."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def unplanes(raw: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def pack(ordered: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit integers by their differences."""
    return planes(np.diff(ordered, prepend=np.uint64(0)).astype("<u8"))


def unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw, np.uint64), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def part_of(x: np.ndarray, parts: int) -> np.ndarray:
    """Which of `parts` equal ranges of the 64-bit integers holds x."""
    return (((x >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


class Lookup:
    """Places of distinct integers that aren't negative, by open addressing with linear probing."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.places = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        places, at = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(keys):
            free = self.keys[at] == -1
            first = np.zeros(len(keys), bool)
            first[np.unique(at, return_index=True)[1]] = True  # one key may take a slot in a round
            put = free & first
            self.keys[at[put]], self.places[at[put]] = keys[put], places[put]
            keys, places, at = keys[~put], places[~put], (at[~put] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys.astype(np.uint64) ^ (keys.astype(np.uint64) >> np.uint64(29))) * GOLDEN
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; -1 for others."""
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.places[at], -1)
        todo = np.flatnonzero((out < 0) & (self.keys[at] != -1))
        at = at[todo]
        while len(todo):
            at = (at + 1) & (len(self.keys) - 1)
            there = self.keys[at]
            hit = there == keys[todo]
            out[todo[hit]] = self.places[at[hit]]
            on = ~hit & (there != -1)
            todo, at = todo[on], at[on]
        return out


class Words:
    """The words of some texts in order: `first` and `last` byte in `raw`, `hashes`, the text `doc` of each; `at` where each text begins."""

    def __init__(self, texts: list[bytes | None]):
        texts = [t or b"" for t in texts]
        joined = b" ".join(texts)
        # Blanks around the whole: each word has an edge on both sides, and 8 bytes can be read from anywhere in it.
        self.raw = np.frombuffer(b" " + joined + b" " * 9, np.uint8)
        edge = np.flatnonzero(np.diff(BLANK[self.raw].view(np.int8)))
        self.first, self.last = edge[::2] + 1, edge[1::2]
        ends = 1 + np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) if texts else np.empty(0, np.int64)
        self.at = np.concatenate([[0], np.searchsorted(self.first, ends)]).astype(np.int64)
        self.sizes = np.diff(self.at)
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        self.hashes = self._hash()
        self._plain: tuple[bytes, np.ndarray] | None = None

    def _hash(self) -> np.ndarray:
        length = self.last - self.first + 1
        eights = np.ndarray(max(0, len(self.raw) - 7), "<u8", self.raw, strides=(1,))
        out = mix(length.astype(np.uint64) * GOLDEN + (eights[self.first] & MASKS[np.minimum(length, 8)]))
        on = np.flatnonzero(length > 8)
        for k in range(8, LONG, 8):
            if not len(on):
                return out
            out[on] = mix(out[on] * GOLDEN + (eights[self.first[on] + k] & MASKS[np.minimum(length[on] - k, 8)]))
            on = on[length[on] > k + 8]
        for i in on.tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.raw[self.first[i] : self.last[i] + 1])
        return out

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """A hash for each place where `size` words of one text follow each other, and the places."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        total = np.zeros(n, np.uint64)
        for j in range(size):
            total = total * GOLDEN + self.hashes[j : j + n]
        places = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        return mix(total[places] + np.uint64(size)), places

    def plain(self) -> tuple[bytes, np.ndarray]:
        """The words of all texts, each with a space after it, and where each begins (with the end of the last)."""
        if self._plain is None:
            keep = ~BLANK[self.raw]
            keep[self.last + 1] = True
            out = self.raw[keep]
            out[BLANK[out]] = 0x20
            self._plain = out.tobytes(), np.append(np.cumsum(keep)[self.first] - 1, len(out))
        return self._plain
