"""Substring deduplication: removal of passages that an earlier document already holds, by repeated-phrase automata.

1. Documents are dealt by ascending id into blocks of a few MB, so that a smaller block has only smaller ids.
2. Every block sends the hashes of its distinct windows (13 words), packed and dealt by hash range: a window counts once a
   block however often it occurs. Each range names, for a window that several blocks have, to each the one before it.
3. These earlier blocks send the recurring passages in words, each maximal run of windows once. A passage goes from block
   to block, so none sends it to many.
4. A later block confirms, word by word, which of its own passages were sent or occur earlier in itself, compiles them (in
   windows that cover them) into an Aho-Corasick automaton over word numbers: a shard. All its documents are streamed
   through it to locate every occurrence.

Hashes only propose: nothing is removed whose words are not equal to an earlier document's.

Cases: null, empty and blank texts have no words and lose none; texts of fewer words than a window lose none; of
repeated rows with one id none is earlier than another; rows with a null id are neither earlier nor later than others:
they lose nothing and cost others nothing; an empty table gives an empty result; carried columns that are named like an
output give way to it.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm import common, packed

WINDOW, BLOCK_BYTES, PART_BYTES = 13, 4 << 20, 16 << 20
OUTPUT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()),
    T.StructField("kept_text", T.StringType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))),
])


def _ask(window: int, parts: int):
    """A block's distinct windows, one row for each range of hashes."""

    def ask(table: pa.Table) -> pa.Table:
        common.let_go()
        block = table.column("__block")[0].as_py()
        hashes = np.unique(packed.Words(table.column("__text").to_pylist()).windows(window)[0]) if block >= 0 else np.empty(0, np.uint64)
        edges = np.searchsorted(packed.part_of(hashes, parts), np.arange(parts + 1))
        full = np.flatnonzero(np.diff(edges))
        return pa.table({"block": pa.array([block] * len(full), pa.int32()), "part": pa.array(full, pa.int32()), "hashes": pa.array([packed.pack(hashes[edges[p] : edges[p + 1]]) for p in full], pa.binary())})

    return ask


def _recurring(table: pa.Table) -> pa.Table:
    """Of one range of hashes: windows that a block shares with an earlier one, a row for each such nearest holder."""
    table = table.sort_by("block")
    lists = [packed.unpack(x) for x in table.column("hashes").to_pylist()]
    flat, block = np.concatenate(lists), np.repeat(table.column("block").to_numpy(), [len(x) for x in lists])
    order = np.argsort(flat, kind="stable")
    flat, block = flat[order], block[order]
    first = np.append(True, flat[1:] != flat[:-1])
    holder = np.roll(block, 1)[~first]
    flat, block = flat[~first], block[~first]
    order = np.argsort(holder, kind="stable")
    flat, block, holder = flat[order], block[order], holder[order]
    edge = np.flatnonzero(np.diff(holder, prepend=-2)) if len(flat) else np.empty(0, np.int64)
    spans = list(zip(edge.tolist(), [*edge[1:].tolist(), len(flat)], strict=True)) if len(edge) else []
    return pa.table({"holder": pa.array(holder[edge], pa.int32()), "blocks": pa.array([packed.planes(block[a:b].astype("<i4")) for a, b in spans], pa.binary()), "hashes": pa.array([packed.planes(flat[a:b]) for a, b in spans], pa.binary())})


def _runs(places: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Ascending places of windows, cut wherever the next window of the same text is missing."""
    return np.split(places, np.flatnonzero((np.diff(places) != 1) | (doc[places[1:]] != doc[places[:-1]])) + 1)


def _hold(window: int):
    """The passages that later blocks have asked a block for: words parted by spaces, passages by line ends."""

    def hold(docs: pa.Table, asked: pa.Table) -> pa.Table:
        blocks, passages = np.empty(0, np.int32), []
        if len(asked):
            block = np.concatenate([packed.unplanes(x, np.int32) for x in asked.column("blocks").to_pylist()])
            asking = np.concatenate([packed.unplanes(x, np.uint64) for x in asked.column("hashes").to_pylist()])
            order = np.argsort(block, kind="stable")
            blocks, first = np.unique(block[order], return_index=True)
            asking = np.split(asking[order], first[1:])
            words = packed.Words(docs.column("__text").to_pylist())
            hashes, places = words.windows(window)
            distinct, first = np.unique(hashes, return_index=True)
            plain, start = words.plain()
            for wanted in asking:
                at = np.sort(places[first[np.searchsorted(distinct, wanted)]])
                passages.append(b"\n".join(plain[start[run[0]] : start[run[-1] + window] - 1] for run in _runs(at, words.doc)))
        return pa.table({"block": pa.array(blocks, pa.int32()), "passages": pa.array(passages, pa.binary())})

    return hold


def _same(p: np.ndarray, words: packed.Words, q: np.ndarray, others: packed.Words, window: int) -> np.ndarray:
    """Whether the windows at p and at q have equal words. Neighbouring windows are compared as one passage."""
    (x, x_at), (y, y_at) = words.plain(), others.plain()
    cut = np.flatnonzero((np.diff(p) != 1) | (np.diff(q) != 1)) + 1
    out = np.zeros(len(p), bool)
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(p)], strict=True):
        if b > a:
            out[a:b] = x[x_at[p[a]] : x_at[p[b - 1] + window]] == y[y_at[q[a]] : y_at[q[b - 1] + window]]
            if not out[a]:
                out[a:b] = [x[x_at[i] : x_at[i + window]] == y[y_at[j] : y_at[j + window]] for i, j in zip(p[a:b], q[a:b], strict=True)]
    return out


def _again(words: packed.Words, ranks: np.ndarray, given: packed.Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of windows that an earlier text has, and the rank of the earliest one (-1: in an earlier block)."""
    hashes, places = words.windows(window)
    distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    seen, sent = ranks[words.doc[places[first]]], np.full(len(distinct), -1)
    others, others_at = given.windows(window)
    if len(others) and len(distinct):
        at = np.minimum(np.searchsorted(distinct, others), len(distinct) - 1)
        hit = distinct[at] == others
        seen[at[hit]], sent[at[hit]] = -1, others_at[hit]
    on = np.flatnonzero(seen[inverse] < ranks[words.doc[places]])
    again, which = places[on], inverse[on]
    near = sent[which] < 0
    equal = np.empty(len(on), bool)
    equal[near] = _same(again[near], words, places[first[which[near]]], words, window)
    equal[~near] = _same(again[~near], words, sent[which[~near]], given, window)
    return again[equal], seen[which[equal]]


def _compile(again: np.ndarray, earliest: np.ndarray, words: packed.Words, window: int) -> tuple[ahocorasick.Automaton | None, np.ndarray]:
    """An automaton of windows that cover all recurring passages (every `window`-th of a run, and its last), and word numbers: 0 is no word of it."""
    if not len(again):
        return None, np.empty(0, np.int64)
    runs = _runs(again, words.doc)
    used = np.zeros(len(words.hashes) + 1, np.int64)
    for run in runs:
        used[run[0]] += 1
        used[run[-1] + window] -= 1
    known = np.unique(words.hashes[np.cumsum(used[:-1]) > 0])
    at = np.minimum(np.searchsorted(known, words.hashes), len(known) - 1)
    numbers = np.where(known[at] == words.hashes, at + 1, 0)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    begin = 0
    for run in runs:
        for k in {*range(0, len(run), window), len(run) - 1}:
            automaton.add_word(tuple(numbers[run[k] : run[k] + window].tolist()), int(earliest[begin + k]))
        begin += len(run)
    automaton.make_automaton()
    return automaton, numbers


def _locate(window: int, carry: list[str], text: bool):
    """Streams a block's documents through its automaton; rows of the carried columns and `OUTPUT`."""

    def locate(docs: pa.Table, sent: pa.Table) -> pa.Table:
        common.let_go()
        docs = docs.sort_by("__id")
        ids, n = docs.column("__id").to_pylist(), len(docs)
        words = packed.Words(docs.column("__text").to_pylist())
        ranks = np.concatenate([[0], np.cumsum([a != b for a, b in zip(ids, ids[1:])])])[:n].astype(np.int64)
        given = packed.Words([p for x in sent.column("passages").to_pylist() for p in x.split(b"\n")])
        automaton, numbers = _compile(*_again(words, ranks, given, window), words, window) if n and ids[0] is not None else (None, None)
        plain, start = words.plain()
        removed, sums, kept, spans, count = np.zeros(n, np.int64), [], [], [], np.zeros(n, np.int32)
        for i, (a, b) in enumerate(zip(words.at[:-1].tolist(), words.at[1:].tolist(), strict=True)):
            edge = []
            if automaton is not None:
                gone, rank = np.zeros(b - a + 1, np.int64), ranks[i]
                for end, earliest in automaton.iter(tuple(numbers[a:b].tolist())):
                    if earliest < rank:
                        gone[end - window + 1] += 1
                        gone[end + 1] -= 1
                dead = np.cumsum(gone[:-1]) > 0
                edge = np.flatnonzero(np.diff(dead, prepend=False, append=False)).tolist()
                removed[i] = dead.sum()
            stay = zip([0, *edge[1::2]], [*edge[::2], b - a], strict=True)  # runs of words that stay
            whole = b" ".join([plain[start[a + x] : start[a + y] - 1] for x, y in stay if y > x])
            sums.append(hashlib.sha256(whole).hexdigest())
            kept.append(whole.decode("utf-8", "replace") if text and edge else None)
            spans += edge
            count[i] = len(edge) // 2
        spans = np.array(spans, np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(spans[::2]), pa.array(spans[1::2] - 1)], ["first", "last"])
        runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pairs)
        made = dict(zip([f.name for f in OUTPUT.fields], [pa.array(words.sizes), pa.array(removed), pa.array(sums, pa.string()), pa.array(kept, pa.string()), runs], strict=True))
        return pa.table({**{c: docs.column(c) for c in carry}, **{f.name: pa.chunked_array([made[f.name].cast(f.type)]) for f in common.arrow_schema(OUTPUT)}})

    return locate


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep_text: bool = False) -> DataFrame:
    """Appends n_words, n_removed, kept_sha256, kept_text (null where nothing goes, or unless asked for) and removed
    (runs of word positions) to the carried columns (the id): every word goes that a window covers which also starts in a
    document with a smaller id."""
    taken = {f.name.lower() for f in OUTPUT.fields}
    carry = [c for c in ([id_col] if carry is None else carry) if c.lower() not in taken]
    rows = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").cast("binary").alias("__text"))
    size = F.coalesce(F.octet_length("__text"), F.lit(0))
    least = common.partitions(docs.sparkSession)
    parts = max(2 * least, common.input_bytes(docs) // PART_BYTES)
    dealt = rows.withColumn("__block", common.ordered_blocks(rows, "__id", 2 * least, size, block_bytes, spread="__text"))
    # All three uses group the same rows by block, so Spark shuffles the texts once and reads that exchange again.
    asked = dealt.groupBy("__block").applyInArrow(_ask(window, parts), "block int, part int, hashes binary")
    recurring = asked.groupBy("part").applyInArrow(_recurring, "holder int, blocks binary, hashes binary")
    sent = dealt.groupBy("__block").cogroup(recurring.groupBy("holder")).applyInArrow(_hold(window), "block int, passages binary")
    schema = T.StructType([*docs.select(*[F.col(f"`{c}`") for c in carry]).schema.fields, *OUTPUT.fields])
    return dealt.groupBy("__block").cogroup(sent.groupBy("block")).applyInArrow(_locate(window, carry, keep_text), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
