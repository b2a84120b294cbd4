"""Byte-level BPE: encoding by merge ranks in padded numpy matrices, and decoding.

Distinct pieces are grouped by byte length into padded matrices. In every round each row merges its leftmost pair of
minimum rank; pair ranks come from an open-addressing hash table, merged rows are compacted to the left and finished
rows leave the matrix. Pieces of over `LONG_BYTES` bytes, for which a matrix would cost the square of the length, take
the same merges from a heap.

Cases: a null or empty text has no ids and decodes to nothing; other columns are carried where asked for; rows are
independent, so repeated rows and ids, null ids and empty tables need nothing special.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm import common

CACHE_ENTRIES, CACHE_CHARS, LONG_BYTES = 200_000, 48, 256
NONE = np.int32(2**31 - 1)
#: White space but for the plain space.
SPACES = [c for c in map(chr, range(1, 0x3001)) if c.isspace() and c != " "]
OUTPUT = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class PairTable:
    """Rank of the token that two adjacent tokens make, by open addressing with linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.bits = max(4, (2 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        keys, values = np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] == -1
            first = np.zeros(len(keys), bool)
            first[np.unique(at, return_index=True)[1]] = True  # one key may take a slot in a round
            put = free & first
            self.keys[at[put]], self.ranks[at[put]] = keys[put], values[put]
            keys, values, at = keys[~put], values[~put], (at[~put] + 1) & (len(self.keys) - 1)
        self.pairs = pairs

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys.astype(np.uint64) ^ (keys.astype(np.uint64) >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        shape = left.shape
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        out = np.full(len(keys), NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        at = self._slot(keys[todo])
        while len(todo):
            there = self.keys[at]
            hit = there == keys[todo]
            out[todo[hit]] = self.ranks[at[hit]]
            on = ~hit & (there != -1)
            todo, at = todo[on], (at[on] + 1) & (len(self.keys) - 1)
        return out.reshape(shape)


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.table, self.pattern = PairTable(ranks), regex.compile(pattern)
        self.of_byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.of_byte < 0).any():
            raise ValueError("the vocabulary lacks a single byte")
        self.vocabulary: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.vocabulary[rank] = token
        self.cache: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for i in np.flatnonzero(sizes > LONG_BYTES):
            out[i] = self._merge_long(pieces[i])
        width = 1
        while width <= LONG_BYTES:
            rows = np.flatnonzero((sizes > width // 2) & (sizes <= width)) if width > 1 else np.flatnonzero(sizes == 1)
            for part in np.array_split(rows, max(1, len(rows) * width >> 20)):
                if len(part):
                    self._merge_matrix([pieces[i] for i in part], part, width, out)
            width *= 2
        return out

    def _merge_matrix(self, pieces: list[bytes], rows: np.ndarray, width: int, out: list[bytes]) -> None:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.where(np.arange(width) < size[:, None], self.of_byte[raw], np.int32(-1))
        while True:
            if ids.shape[1] < 2:
                done = np.ones(len(ids), bool)
            else:
                pair = self.table.look_up(ids[:, :-1], ids[:, 1:])
                at = pair.argmin(axis=1)  # the first of equal minima: the leftmost
                best = pair[np.arange(len(ids)), at]
                done = best == NONE
            for r, row, n in zip(rows[done], ids[done].astype("<u4"), size[done], strict=True):
                out[r] = row[:n].tobytes()
            if done.all():
                return
            ids, rows, size, at, best = ids[~done], rows[~done], size[~done] - 1, at[~done], best[~done]
            columns = np.arange(ids.shape[1] - 1)
            moved = np.take_along_axis(ids, columns + (columns > at[:, None]), axis=1)
            moved[np.arange(len(ids)), at] = best
            ids = moved[:, : size.max()]

    def _merge_long(self, piece: bytes) -> bytes:
        ids = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        n, get = len(ids), self.table.pairs.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := get(rank << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            if (h := before[i]) >= 0 and (r := get(ids[h] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def _chunks(self, text: str) -> list[str]:
        """Parts that no match of the pattern crosses: cut before a single space that touches no other white space."""
        parts = text.split(" ")
        if "  " not in text and not any(c in text and (f" {c}" in text or f"{c} " in text) for c in SPACES):
            return [parts[0], *[" " + p for p in parts[1:]]]
        chunks, white = [parts[0]], not parts[0] or parts[0][-1].isspace()
        for p in parts[1:]:
            if white or not p or p[0].isspace():
                chunks[-1] += " " + p
            else:
                chunks.append(" " + p)
            white = not p or p[-1].isspace()
        return chunks

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.cache) > CACHE_ENTRIES:
            self.older, self.cache = self.cache, {"": b""}
        cache, passing = self.cache, {}
        rows = [self._chunks(t) if t else [] for t in texts]
        new = common.unseen(rows, cache, self.older)
        split = [self.pattern.findall(c) for c in new]
        pieces = list({p for ps in split for p in ps if p not in cache})
        made = dict(zip(pieces, self.merge([p.encode("utf-8", "replace") for p in pieces]), strict=True))
        for c, ps in zip(new, split, strict=True):
            ids = b"".join([made[p] if p in made else cache[p] for p in ps])
            (cache if len(c) <= CACHE_CHARS else passing)[c] = ids
        if passing:
            return [b"".join([cache[c] if c in cache else passing[c] for c in chunks]) for chunks in rows]
        return [b"".join(map(cache.__getitem__, chunks)) for chunks in rows]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def bpe_of(ranks_path: str, pattern: str) -> ByteBpe:
    """One a Python worker: what a task has learnt serves the next."""
    return common.held(("byte_bpe", ranks_path, pattern), lambda: ByteBpe(read_ranks(ranks_path), pattern))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Appends n_tokens and ids (little-endian unsigned 32-bit integers) to the carried columns (doc_id)."""

    def make():
        bpe = bpe_of(ranks_path, pattern)

        def work(texts):
            ids = bpe.encode(texts)
            return [len(x) // 4 for x in ids], ids

        return work

    return common.arrow_map(docs, ["doc_id"] if carry is None else carry, text_col, OUTPUT, make)


def decode(tokens: DataFrame, ranks_path: str, pattern: str, carry: list[str]) -> DataFrame:
    """Appends decoded (binary) to the carried columns; null ids decode to nothing."""

    def make():
        bpe = bpe_of(ranks_path, pattern)
        return lambda ids: ([bpe.decode(x or b"") for x in ids],)

    return common.arrow_map(tokens, carry, "ids", T.StructType([T.StructField("decoded", T.BinaryType())]), make)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Appends n_tokens, ids_sha256 and decoded_sha256: encodes, then decodes the ids, in one pass over the texts."""
    out = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def make():
        bpe = bpe_of(ranks_path, pattern)

        def work(texts):
            ids = bpe.encode(texts)
            return [len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]

        return work

    return common.arrow_map(docs, ["doc_id"] if carry is None else carry, text_col, out, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
