"""Token-ID output: ORC files of encoded documents, ordered by document id, with stripe, row and Bloom indexes.

ORC stores the ids as a list of integers in run-length encoding; every stripe carries minimum and maximum of the
document id per row group and a Bloom filter on it, so a reader prunes stripes and row groups from metadata alone
and reads stripes in parallel.

Cases: a null or empty text is the end id alone; null doc_ids are numbered first (in blocks below 0, by the hash of the text) and keep their rows; repeated ids
are all kept, ordered by text; an empty table gives empty files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm import common, packed

#: Units a worker keeps the ids of before it forgets those that didn't recur, and 64-bit integers of the units kept.
KEPT, WIDTHS = 700_000, (1, 3, 8)
#: About how many bytes of text are looked up at once.
CHUNK = 1 << 20
#: Rows of an ORC row group, bytes of a stripe, false positives of the Bloom filter.
ROW_GROUP, STRIPE_BYTES, BLOOM_FPP = 1000, 16 << 20, 0.01

FILE_SCHEMA = T.StructType([
    T.StructField("block", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("block_start", T.LongType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
])


#: Letters, digits and marks of Latin-1 as the vocabulary's own pattern parts them (fixed: it is the file's).
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\s\w²³¹¼½¾]|_)+")
#: Characters that Python's classes and the vocabulary's see differently.
ODD = "\x1c\x1d\x1e\x1f"
#: Classes of bytes: white space, letters, digits, marks, and what holds on to its neighbours: apostrophes, NULs, bytes that Python and
#: the vocabulary might read differently, and all that isn't ASCII until it is known to be a letter.
SPACE, LETTER, DIGIT, MARK, HOLD = range(5)
CLASS = bytes(HOLD if c > 127 or chr(c) in ODD + "'\0" else SPACE if chr(c).isspace() else LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else MARK for c in range(256))
#: The same where a special token may be.
CLASS_SPECIAL = bytes(HOLD if chr(c) in "<|>" else k for c, k in enumerate(CLASS))


def _edges(a: int, b: int) -> int:
    """Between bytes of two classes: 1 where a unit begins, 2 where one ends."""
    if SPACE in (a, b):
        return (b != SPACE) + 2 * (a != SPACE)
    return 0 if HOLD in (a, b) or a == b != DIGIT else 3


#: By the classes of both sides, eight times the left one plus the right one.
EDGES = bytes(_edges(i >> 3, i & 7) for i in range(5 << 3)).ljust(256, b"\0")
#: Pieces that one call of the library encodes together, and such calls at a time.
RUN, RUNS = 500, 16


class Units:
    """Places of byte strings of at most 8 * width bytes, of which none ends with a NUL: a string is its bytes as `width`
    integers, all of which are compared, so no two share a place. Open addressing with linear probing."""

    def __init__(self, width: int):
        self.width, self.n = width, 0
        self._room(1 << 12)

    def _room(self, room: int) -> None:
        keys = getattr(self, "keys", np.empty((self.width, 0), np.uint64))[:, : self.n]
        self.keys = np.empty((self.width, room), np.uint64)
        self.keys[:, : self.n] = keys
        for name, kind in (("start", np.int64), ("count", np.int64), ("hit", bool)):
            old = getattr(self, name, np.empty(0, kind))[: self.n]
            setattr(self, name, np.zeros(room, kind))
            getattr(self, name)[: self.n] = old
        self.shift = np.uint64(64 - (2 * room - 1).bit_length())
        self.slots = np.full(1 << (2 * room - 1).bit_length(), -1, np.int32)
        self._place(np.arange(self.n, dtype=np.int32))

    def mixed(self, keys: np.ndarray) -> np.ndarray:
        out = keys[0]
        for k in keys[1:]:
            out = (out ^ (out >> np.uint64(32))) * packed.GOLDEN + k
        return (out ^ (out >> np.uint64(29))) * packed.GOLDEN

    def _place(self, places: np.ndarray) -> None:
        at = (self.mixed(self.keys[:, places]) >> self.shift).astype(np.int64)
        while len(places):
            free = self.slots[at] < 0
            self.slots[at[free]] = places[free]  # of those that want one slot the last stays
            put = self.slots[at] == places
            places, at = places[~put], (at[~put] + 1) & (len(self.slots) - 1)

    def find(self, keys: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """The place of each string; -1 for others."""
        at = (mixed >> self.shift).astype(np.int64)
        out = self.slots[at]
        there = self.keys[0][out] == keys[0]
        for own, k in zip(self.keys[1:], keys[1:], strict=True):
            there &= own[out] == k
        todo = np.flatnonzero(~there & (out >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.slots) - 1)
            out[todo] = place = self.slots[at[todo]]
            there = (self.keys[:, place] == keys[:, todo]).all(0)
            todo = todo[~there & (place >= 0)]
        return out

    def add(self, keys: np.ndarray, start: np.ndarray, count: np.ndarray) -> None:
        """Distinct strings that have no place yet get the next places; their ids begin at `start` of the store."""
        n = self.n + keys.shape[1]
        while n > self.keys.shape[1]:
            self._room(2 * self.keys.shape[1])
        self.keys[:, self.n : n], self.start[self.n : n], self.count[self.n : n] = keys, start, count
        places = np.arange(self.n, n, dtype=np.int32)
        self.n = n
        self._place(places)


def _runs(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The integers start..start+count-1 of each pair, one after another."""
    ends = np.cumsum(count)
    return np.repeat(start - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


class UnitEncoder:
    """Whole texts through the `tokenizers` library, a unit at a time.

    A unit is a stretch of a text at whose ends the vocabulary's pre-tokeniser always parts: a run of letters or of marks, a
    digit, or more where an apostrophe or a character beyond the known ones is involved. A text's ids are its units' ids
    in order; each distinct unit is encoded once and remembered by its bytes, many of them looked up at once. The library
    gets the pieces of units of Latin-1 as the vocabulary's normaliser and pattern would leave them; such a piece ends where
    a token with the end-of-word suffix is. Other units go to the whole of the library one by one.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # Pieces come in lower case, composed and parted: done again for each, that is most of the library's time.
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if suffix and t.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.tables = [Units(w) for w in WIDTHS]
        self.store, self.stored = np.empty(1 << 16, np.uint32), 0

    def _forget(self) -> None:
        """Keeps the units that were met again since the last time, or none if they are too many."""
        old, store = self.tables, self.store
        self.clear()
        again = [np.flatnonzero(t.hit[: t.n]) for t in old]
        if sum(map(len, again)) < 0.75 * KEPT:
            for new, t, at in zip(self.tables, old, again, strict=True):
                new.add(t.keys[:, at], self._put(store[_runs(t.start[at], t.count[at])], t.count[at]), t.count[at])

    def _put(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Where in the store the ids of each unit begin, once they are all there."""
        if self.stored + len(ids) > len(self.store):
            store = np.empty(2 * (self.stored + len(ids)), np.uint32)
            store[: self.stored] = self.store[: self.stored]
            self.store = store
        self.store[self.stored : self.stored + len(ids)] = ids
        self.stored += len(ids)
        return self.stored - len(ids) + np.cumsum(counts) - counts

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, and where those of each end."""
        out, ends, n = [np.empty(0, np.uint32)], [np.empty(0, np.int64)], 0
        for a in range(0, len(pieces), RUN * RUNS):
            runs = [pieces[i : i + RUN] for i in range(a, min(a + RUN * RUNS, len(pieces)), RUN)]
            for run, e in zip(runs, self.plain.encode_batch_fast([" ".join(r) for r in runs], add_special_tokens=False), strict=True):
                out.append(np.asarray(e.ids, np.uint32))
                ends.append(np.flatnonzero(self.ends[out[-1]]) + 1 + n)
                if len(ends[-1]) != len(run):
                    raise ValueError("a piece doesn't end with the end-of-word suffix")
                n += len(out[-1])
        return np.concatenate(out), np.concatenate(ends)

    def _learn(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where in the store the ids of units are, and how many."""
        odd = [i for i, u in enumerate(units) if _is_odd(u)] if _is_odd(" ".join(units)) else []
        parts = [[u.lower()] if u.isascii() and u.isalpha() else PIECES.findall(u.lower()) for u in units]
        for i in odd:
            parts[i] = []
        ids, ends = self._encode_pieces([p for ps in parts for p in ps])
        bounds = np.concatenate([[0], ends])[np.cumsum([0, *map(len, parts)])]
        counts = np.diff(bounds)
        start = self._put(ids, counts)
        for a in range(0, len(odd), RUN):
            at = odd[a : a + RUN]
            made = [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([units[i] for i in at], add_special_tokens=False)]
            counts[at] = list(map(len, made))
            start[at] = self._put(np.concatenate(made), counts[at])
        return start, counts

    def _look_up(self, table: Units, data: bytes, keys: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the store the ids of units of one table are, and how many."""
        mixed = table.mixed(keys)
        place = table.find(keys, mixed)
        new = np.flatnonzero(place < 0)
        table.hit[place] = True  # with the last place for -1: one unit may be kept for nothing
        while len(new):  # more than once only if different units have one hash
            one = new[np.unique(mixed[new], return_index=True)[1]]
            table.add(keys[:, one], *self._learn(_units(data, first[one], length[one])))
            place[new] = table.find(keys[:, new], mixed[new])
            new = new[place[new] < 0]
        return table.start[place], table.count[place]

    def _encode_chunk(self, data: bytes, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units of a chunk of UTF-8, and how many of them lie before each of the ascending `cuts`, at which units end."""
        if sum(t.n for t in self.tables) > KEPT:
            self._forget()
        raw = np.frombuffer(data, np.uint8)
        kinds = np.zeros(len(data) + 2, np.uint8)
        special = b"<|" in data
        kinds[1:-1] = np.frombuffer(data.translate(CLASS_SPECIAL if special else CLASS), np.uint8)
        c3 = np.flatnonzero(raw == 0xC3)
        c3 = c3[(raw[c3 + 1] != 0x97) & (raw[c3 + 1] != 0xB7)] + 1  # Latin-1 but the signs of multiplication and division
        kinds[c3] = kinds[c3 + 1] = LETTER
        edges = np.frombuffer(((kinds[:-1] << 3) | kinds[1:]).tobytes().translate(EDGES), np.uint8)
        begins, ends = (edges & 1).view(bool), (edges & 2).view(bool)
        begins[cuts] |= kinds[cuts + 1] != SPACE
        ends[cuts] |= kinds[cuts] != SPACE
        first = np.flatnonzero(begins)
        length = np.flatnonzero(ends) - first
        # The vocabulary ignores case; capitals stay where they may belong to a special token or a mark may join them.
        low = np.zeros(len(data) + 8 * WIDTHS[-1] + 8, np.uint8)
        low[: len(data)] = raw if special else np.frombuffer(data.lower(), np.uint8)
        beyond = np.flatnonzero(raw >= 0xC4)
        beyond = beyond[beyond > 0] - 1
        low[beyond] = raw[beyond]
        text = low.tobytes()
        eights = np.ndarray(len(low) - 7, "<u8", low, strides=(1,))
        start, count = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
        words = (length + 7) >> 3
        if b"\0" in data:
            at = np.concatenate([[0], np.cumsum(raw == 0)])
            words[at[first + length] > at[first]] = WIDTHS[-1] + 1
        narrow = 0
        for width, table in zip(WIDTHS, self.tables, strict=True):
            at = np.flatnonzero((words > narrow) & (words <= width))
            if len(at):
                f, n = first[at], length[at]
                keys = np.stack([eights[f + 8 * k] & packed.MASKS[np.clip(n - 8 * k, 0, 8)] for k in range(width)])
                start[at], count[at] = self._look_up(table, text, keys, f, n)
            narrow = width
        at = np.flatnonzero(words > narrow)  # too long to be kept
        held = self.stored
        if len(at):
            units, of = np.unique(np.array(_units(text, first[at], length[at]), object), return_inverse=True)
            made = self._learn(units.tolist())
            start[at], count[at] = made[0][of], made[1][of]
        ids = self.store[_runs(start, count)]
        self.stored = held
        return ids, np.concatenate([[0], np.cumsum(count)])[np.searchsorted(first, cuts)]

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by the id `end`, and how many each has with it. A null is an empty text."""
        texts = texts.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        whole, offsets = memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]], offsets - offsets[0]
        out, before, a, n = [np.empty(0, np.uint32)], np.zeros(len(offsets), np.int64), 0, 0
        while a < len(whole):
            b = _cut_after(whole, a + CHUNK)
            inside = slice(*np.searchsorted(offsets, [a, b], "left"))
            ids, before[inside] = self._encode_chunk(bytes(whole[a:b]), offsets[inside] - a)
            before[inside] += n
            out.append(ids)
            a, n = b, n + len(ids)
        before[np.searchsorted(offsets, a) :] = n
        return np.insert(np.concatenate(out), before[1:], end), np.diff(before) + 1


def _units(data: bytes, first: np.ndarray, length: np.ndarray) -> list[str]:
    """Units as strings: none holds a blank."""
    return b" ".join([data[a : a + n] for a, n in zip(first.tolist(), length.tolist(), strict=True)]).decode().split(" ")


def _cut_after(data: memoryview, at: int) -> int:
    """The next place from `at` on where a text can be cut: at a space or a line's end, or after a digit before a letter or digit; or the end."""
    while at < len(data):
        found = re.search(rb"[ \n]|(?<=[0-9])(?=[0-9A-Za-z])", data[at : at + CHUNK])
        if found:
            return at + found.start()
        at += CHUNK
    return len(data)


def _is_odd(unit: str) -> bool:
    """Whether a unit isn't of Latin-1, may hold a special token, or has characters that are read differently."""
    if "<|" in unit or any(c in unit for c in ODD):
        return True
    try:
        return not unit.isascii() and not unit.encode("latin-1")
    except UnicodeEncodeError:
        return True


def encoder_of(path: str) -> UnitEncoder:
    """One a Python worker: what a task has learnt serves the next."""
    return common.held(("tokens", path), lambda: UnitEncoder(path))


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, blocks: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes (block, doc_id, block_start, n_tokens, ids) as ORC, files and rows in ascending order of the id.

    `blocks` ranges of ids (four a shuffle partition if not given) are the unit of the offsets: block_start counts the
    ids of the block's earlier documents, so no task needs another's total.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = blocks or 4 * common.partitions(spark)

    def encode(batches):
        encoder, block, total = encoder_of(vocabulary), None, 0
        for batch in batches:
            texts = batch.column("text")
            lengths = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
            for a, b in common.slices(lengths):
                ids, counts = encoder.encode(texts.slice(a, b - a), end_id)
                starts = []
                for k, n in zip(batch.column("block").slice(a, b - a).to_pylist(), counts.tolist(), strict=True):
                    if k != block:
                        block, total = k, 0
                    starts.append(total)
                    total += n
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                flat = pa.array(ids.view(np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(a, b - a), batch.column("doc_id").slice(a, b - a), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(offsets, flat)], names=FILE_SCHEMA.names)

    placed = rows.withColumn("block", common.ordered_blocks(rows, "doc_id", blocks, spread="text")).select("block", "doc_id", "text")
    # Blocks are even already, so neighbouring ones go to a file by their number: no sample has to be read to part them.
    files = min(blocks, common.partitions(spark))
    file = F.when(F.col("block") < 0, F.pmod(F.col("block"), F.lit(files))).otherwise(F.floor(F.col("block") * F.lit(files) / blocks)).cast("int")
    ordered = placed.repartitionById(files, file).sortWithinPartitions("block", "doc_id", "text")
    encoded = ordered.mapInArrow(encode, FILE_SCHEMA)
    (encoded.write.option("compression", "zstd").option("orc.stripe.size", STRIPE_BYTES).option("orc.row.index.stride", ROW_GROUP)
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", BLOOM_FPP).option("orc.create.index", True).orc(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of `write_tokens` with `start`, the number of ids before the document in the whole collection."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    totals = rows.groupBy("block").agg(F.sum("n_tokens").alias("n"))
    # One row a block, whose number is a parameter: small enough for one task and for a broadcast.
    base = totals.selectExpr("block AS of_block", "coalesce(sum(n) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base")
    joined = rows.join(F.broadcast(base), rows["block"] == base["of_block"])
    return joined.select("doc_id", (F.col("base") + F.col("block_start")).alias("start"), "n_tokens", "ids")


def lookup_tokens(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Documents by id; the predicate reaches the ORC reader, which skips by statistics and Bloom filters."""
    return spark.read.schema(FILE_SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows as `read_tokens` gives them."""
    schema = T.StructType([*tokens.schema.fields[:3], T.StructField("ids_crc32", T.LongType())])

    def crc(batches):
        common.let_go()
        for batch in batches:
            ids = batch.column("ids")
            flat = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
            at = ids.offsets.to_numpy() * 4
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], names=schema.names)

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(crc, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = common.shared_path(spark, "tokens")
    write_tokens(common.documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return checksums(read_tokens(spark, path))
