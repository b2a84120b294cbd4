"""Exact n-gram Jaccard self-join by PartEnum signatures, and the classes that its links form.

Documents are sets of hashed word shingles. Equal sets form a class by digest, so copies cost one row each.

1. Signatures. Two sets of Jaccard likeness p differ in at most k elements, in proportion to their sizes. Sizes are cut
   into bands; a set signs in its own band's group and in the next one's. A group parts the shingle domain into cells
   and each cell into `parts` subcells. By the pigeonhole principle similar sets differ in at most `most` elements
   within some cell, so they agree on some subset of `parts - most` of its subcells: each such subset is a signature.
   Subsets without elements would be shared by everybody; sets of which so many cells have one that no other cell is
   bound to agree sign those by their place as well. So similar sets always share a signature.
2. Signatures travel packed. A slice of the table sends each distinct signature once with one of its sets, and its other
   sets apart, so a signature of very many sets costs a row a slice.
3. Sets of a signature are compared by parity bitmaps whose distance never exceeds the sets' own. A search through what
   is near gives a forest, at most one edge a set, whatever the size of the group; signatures of equal lists of sets count
   once. The components of these edges hold all links.
4. Within each such component every pair of sets is compared exactly, in blocks of bounded rows and elements, by products
   of incidence matrices. That gives each set's links and a forest of them, whose components are the result.

Links between copies are counted from the sizes of classes; no copy is expanded into pairs and no link is left out.

Cases: null, empty and blank texts have the empty set and link with nothing; shorter texts than a shingle have one
element; a null id has the component null, and a set that only rows without an id have links with nothing (such rows are
no one's links, and have null ones); repeated rows share a class and count as its copies; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm import common, packed
from vellum.llm.components import connected_components

SLICE_BYTES, PART_BYTES = 2 << 20, 8 << 20
#: Sets that one task pairs of a signature's; least and most bits of a bitmap (fewer bits rule out less, and change no result).
BLOCK, BITS, MOST_BITS = 2000, 256, 4096
#: Sets and elements of a block of a component; columns of an incidence matrix at a time.
LINK_ROWS, LINK_ELEMENTS, LINK_COLUMNS = 1000, 1 << 20, 4096
#: Documents picked by id are found by a broadcast of their ids up to this many rows (16 bytes each), else by a shuffled join.
BROADCAST_IDS = 1_000_000


class Shingles:
    """Distinct shingles of some texts: `values` ascending within `doc`, `size` by document."""

    def __init__(self, texts: list[bytes | None], n: int):
        words = packed.Words([t.lower() if t else t for t in texts])  # bytes.lower() changes A to Z only
        hashes, _ = words.windows(n)
        short = np.flatnonzero((words.sizes > 0) & (words.sizes < n))
        count = np.maximum(words.sizes - n + 1, 0)
        count[short] = 1
        at = np.concatenate([[0], np.cumsum(count)])
        doc = np.repeat(np.arange(len(texts)), count)
        values = np.empty(len(doc), np.uint64)
        whole = np.zeros(len(doc), bool)
        whole[at[short]] = True
        values[~whole] = hashes
        values[at[short]] = [hash_short(words.hashes[words.at[i] : words.at[i + 1]]) for i in short]
        for i in np.flatnonzero(count > 1).tolist():
            values[at[i] : at[i + 1]].sort()
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
        self.doc, self.values = doc[new], values[new]
        self.size = np.bincount(self.doc, minlength=len(texts))
        self.at = np.concatenate([[0], np.cumsum(self.size)])

    def set(self, i: int) -> np.ndarray:
        return self.values[self.at[i] : self.at[i + 1]]

    def key(self, i: int) -> bytes:
        """A 128-bit digest of the set; empty for the empty set."""
        return hashlib.blake2b(self.set(i).tobytes(), digest_size=16).digest() if self.size[i] else b""

    def bitmaps(self) -> tuple[np.ndarray, np.ndarray]:
        """(words of 64 bits of all texts, words by text): the parity of the elements that fall on each bit."""
        bits = widths(self.size)
        start = np.concatenate([[0], np.cumsum(bits)])
        bit = (packed.mix(self.values ^ np.uint64(BITS)) & (bits[self.doc] - 1).astype(np.uint64)).astype(np.int64)
        odd = np.bincount(start[self.doc] + bit, minlength=start[-1]) & 1
        return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64), bits // 64


def widths(size: np.ndarray) -> np.ndarray:
    """Bits of the bitmaps of sets: a power of two, their size or more within limits. Half of a bitmap laid on the other is the next smaller one."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64), BITS, MOST_BITS)


def hash_short(words: np.ndarray) -> int:
    total = 0
    for w in words.tolist():
        total = (total * int(packed.GOLDEN) + w) & (1 << 64) - 1
    return int(packed.mix(np.array([total + len(words) & (1 << 64) - 1], np.uint64))[0])


def bands(largest: int, percent: int) -> np.ndarray:
    """Smallest size of each band; a band's largest size is as many times its smallest as similar sets may differ."""
    low = [1]
    while low[-1] <= largest:
        low.append(low[-1] * 100 // percent + 1)
    return np.array([*low, low[-1] * 100 // percent + 1], np.int64)


def scheme(k: int, percent: int) -> tuple[int, int, int]:
    """(cells, subcells of a cell, elements in which the sets may differ within a cell) for sets that differ in at most k.

    Sets that may differ in very few elements are small, and have a single cell with more subcells, as subcells should
    not be empty. In others the expected number of cells with an empty subset, and three deviations, is added.
    """
    if k <= 3:
        return (1, k + (2 if k == 1 else 3), k)
    if k <= 5:
        return (2, 5, 2)
    load = (100 + percent) / (2 * (100 - percent))
    empty = (k // 2 + 1) * 3 * math.exp(-4 / 3 * load)
    return (k // 2 + 2 + int(2 * empty + 3 * math.sqrt(empty)), 3, 1)


def signatures(values: np.ndarray, doc: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, document) of sets given as elements, ascending, by document."""
    sigs, docs = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    low = bands(int(size.max(initial=1)), percent)
    most = (100 - percent) * 2 * (low[1:] - 1) // (100 + percent)
    plans = np.array([scheme(int(k), percent) if k else (0, 0, 0) for k in most])
    own = np.searchsorted(low, size, side="right") - 1
    for step in (0, 1):
        group = own + step
        differ = (100 - percent) * (size + np.minimum(size * 100 // percent, low[group + 1] - 1)) // (100 + percent)
        for parts, within in {(int(p), int(w)) for _, p, w in plans[group[(size > 0) & (differ > 0)]]}:
            cells = np.where((size > 0) & (differ > 0) & (plans[group, 1] == parts) & (plans[group, 2] == within), plans[group, 0], 0)
            made = _sign(values, doc, cells, parts, within, group, differ)
            sigs += made[0]
            docs += made[1]
    return np.concatenate(sigs), np.concatenate(docs)


def _sign(values: np.ndarray, doc: np.ndarray, cells: np.ndarray, parts: int, within: int, group: np.ndarray, differ: np.ndarray) -> tuple[list, list]:
    """Signatures in one group of the sets that have `cells` there."""
    on = cells[doc] > 0
    v, d = values[on], doc[on]
    start = np.concatenate([[0], np.cumsum(cells * parts)])
    # Elements ascend within a document, and so do their subcells.
    at = start[d] + (((v >> np.uint64(32)) * (cells[d] * parts).astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    edge = np.flatnonzero(np.diff(at, prepend=-1))
    sums, full = np.zeros(start[-1], np.uint64), np.zeros(start[-1], bool)
    sums[at[edge]], full[at[edge]] = np.add.reduceat(packed.mix(v * packed.GOLDEN), edge) if len(edge) else 0, True
    sums, full = packed.mix(sums).reshape(-1, parts), full.reshape(-1, parts)
    owner = np.repeat(np.arange(len(cells)), cells)
    cell = np.arange(len(owner)) - start[owner] // parts
    place = packed.mix((group[owner] << 40 | cell).astype(np.uint64))
    bad = np.bincount(owner[full.sum(axis=1) <= within], minlength=len(cells))
    lost = (bad >= cells - differ // (within + 1))[owner]  # similar sets may agree on nothing but empty subsets
    sigs, docs = [], []
    for j, subset in enumerate(itertools.combinations(range(parts), parts - within)):
        code = place + np.uint64(j + 1)
        for s in subset:
            code = (code ^ sums[:, s]) * packed.GOLDEN
            code ^= code >> np.uint64(29)
        held = full[:, list(subset)].any(axis=1)
        keep = held | lost
        sigs.append(packed.mix(code[keep]))
        docs.append(owner[keep])
    return sigs, docs


ROWS = "part int, kind int, one binary, two binary, three binary, four binary"
#: Rows of documents have no sig, those of memberships no key.
FOUND = "doc_id long, size int, key binary, bitmap binary, sig long, short long"
ASKED, DONE, DOCUMENTS = range(3)


def _request(n: int, percent: int, parts: int):
    """Rows of `ROWS` of each slice: its documents; distinct signatures with one set each; further sets, which are sent apart."""

    def signed(sig, short, size, salt):
        order = np.argsort(sig)
        sig, short, size = sig[order], short[order], size[order]
        first = np.ones(len(sig), bool)
        first[1:] = sig[1:] != sig[:-1]
        alone = first & np.append(first[1:], True)
        for kind, chosen in ((ASKED, first), (DONE, ~alone)):
            s, k, z = sig[chosen], short[chosen], size[chosen]
            part = packed.part_of(s, parts) if kind == ASKED else np.full(len(s), salt % parts)
            edges = np.searchsorted(part, np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(edges)):
                own = slice(edges[p], edges[p + 1])
                keys, at = np.unique(k[own], return_inverse=True)
                sizes = np.zeros(len(keys), np.int32)
                sizes[at] = z[own]
                yield int(p), kind, packed.pack(s[own]), packed.planes(at.astype("<u4")), keys.tobytes(), sizes.tobytes()

    def run(batches):
        common.let_go()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            lengths = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
            for a, b in common.slices(lengths, SLICE_BYTES, 1 << 20):
                sets = Shingles(texts.slice(a, b - a).to_pylist(), n)
                keys = [sets.key(i) for i in range(b - a)]
                short = np.array([int.from_bytes(k[:8], "little", signed=True) for k in keys], np.int64)
                bits, width = sets.bitmaps()
                own = ids.slice(a, b - a)
                named = pa.compute.is_valid(own).to_numpy(zero_copy_only=False)
                salt = int(packed.mix(np.array([sets.values.sum() + np.uint64(b)], np.uint64))[0] >> np.uint64(1))
                wide = np.repeat(sets.size > 0, width)
                made = [(salt % parts, DOCUMENTS, pa.compute.fill_null(own, 0).to_numpy().tobytes() + named.tobytes(), sets.size.astype(np.int32).tobytes(), b"".join(keys), bits[wide].tobytes())]
                seen = {k: i for i, k in reversed(list(enumerate(keys))) if k}  # one document of each set
                chosen = np.zeros(b - a, bool)
                chosen[list(seen.values())] = True
                on = chosen[sets.doc]
                sig, doc = signatures(sets.values[on], sets.doc[on], np.where(chosen, sets.size, 0), percent)
                made += signed(sig, short[doc], sets.size[doc].astype(np.int32), salt)
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names=[x.split()[0] for x in ROWS.split(", ")])

    return run


def _answer(table: pa.Table) -> pa.Table:
    """The documents, and the memberships of signatures that at least two sets have, as rows of `FOUND`."""
    kinds = table.column("kind").to_pylist()
    columns = [table.column(c).to_pylist() for c in ("one", "two", "three", "four")]
    rows = list(zip(kinds, *columns, strict=True))
    made = [_documents(*r[1:]) for r in rows if r[0] == DOCUMENTS]
    if any(r[0] != DOCUMENTS for r in rows):
        made.append(_members([r for r in rows if r[0] != DOCUMENTS]))
    return pa.concat_tables(made)


def _found(n: int, **columns) -> pa.Table:
    kinds = {"doc_id": pa.int64(), "size": pa.int32(), "key": pa.binary(), "bitmap": pa.binary(), "sig": pa.int64(), "short": pa.int64()}
    return pa.table({c: columns[c] if c in columns else pa.nulls(n, t) for c, t in kinds.items()})


def _documents(one: bytes, two: bytes, three: bytes, four: bytes) -> pa.Table:
    size = np.frombuffer(two, np.int32)
    n, some = len(size), size > 0
    ids = pa.array(np.frombuffer(one, np.int64, n), mask=np.frombuffer(one, bool, n, 8 * n) == 0)

    def spans(length, data):  # nothing for empty sets
        ends = np.concatenate([[0], np.cumsum(np.where(some, length, 0))]).astype(np.int32)
        whole = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])
        return pa.compute.if_else(pa.array(some), whole, pa.scalar(None, pa.binary()))

    return _found(n, doc_id=ids, size=pa.array(size), key=spans(16, three), bitmap=spans(widths(size) // 8, four))


def _members(rows: list[tuple]) -> pa.Table:
    sig, short, size, done = [], [], [], []
    for kind, s, a, k, z in rows:
        at = packed.unplanes(a, np.uint32)
        sig.append(packed.unpack(s))
        short.append(np.frombuffer(k, np.int64)[at])
        size.append(np.frombuffer(z, np.int32)[at])
        done.append(np.full(len(at), kind == DONE))
    sig, short, size, done = (np.concatenate(x) for x in (sig, short, size, done))
    order = np.argsort(sig)
    again = np.zeros(len(sig), bool)  # signatures that occur once go before the finer sort
    same = sig[order[1:]] == sig[order[:-1]]
    again[1:] = same
    again[:-1] |= same
    order = order[again | done[order]]
    sig, short, size, done = sig[order], short[order], size[order], done[order]
    order = np.lexsort((done, short, sig))
    sig, short, size, done = sig[order], short[order], size[order], done[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (short[1:] != short[:-1])
    group = np.cumsum(np.append(True, sig[1:] != sig[:-1])[: len(sig)]) - 1
    # Asked ones count as distinct sets; done ones pass in any case.
    asked = np.bincount(group[new & ~done], minlength=group[-1] + 1 if len(group) else 0)
    keep = done | (new & (asked[group] > 1))
    return _found(int(keep.sum()), size=pa.array(size[keep]), sig=pa.array(sig[keep].view(np.int64)), short=pa.array(short[keep]))


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    far = np.zeros(np.broadcast_shapes(x.shape[:-1], y.shape[:-1]), np.int32)
    for w in range(x.shape[-1]):
        far += np.bitwise_count(x[..., w] ^ y[..., w])
    return far


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    while bits.shape[-1] > width:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _may(far: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes x and y whose bitmaps are so far apart can be similar."""
    return (far <= (100 - percent) * (x + y) // (100 + percent)) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))


def _forest(bits: np.ndarray, size: np.ndarray, block: np.ndarray, across: bool, percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges (places) that join all near sets of a signature, or of two of its blocks: then only sets of different ones."""
    edges, left = [], np.arange(len(size))
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            part, front = front[:256], front[256:]
            near = _may(_distance(bits[part][:, None], bits[left]), size[part][:, None], size[left], percent)
            if across:
                near &= block[part][:, None] != block[left]
            hit = near.any(axis=0)
            edges.append((part[near.argmax(axis=0)[hit]], left[hit]))
            front, left = np.concatenate([front, left[hit]]), left[~hit]
    return edges


def _near(percent: int):
    """Edges (a, b) between sets whose bitmaps are near, of rows that are sorted by signature and pair of blocks."""

    def groups(table):
        short, size, block = (table.column(c).to_numpy() for c in ("short", "size", "block"))
        maps = table.column("bitmap").combine_chunks()
        _, offsets, data = maps.buffers()
        first = np.frombuffer(offsets, np.int32, len(maps) + 1, 4 * maps.offset) // 8
        words = np.frombuffer(data, np.uint64, len(data) // 8)
        width = np.diff(first)
        at = np.stack([table.column(c).to_numpy() for c in ("sig", "i", "j")])
        start = np.flatnonzero(np.append(True, (at[:, 1:] != at[:, :-1]).any(axis=0)))
        count = np.diff(np.append(start, len(short)))
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        two = start[count == 2]
        for x, y in {(int(x), int(y)) for x, y in zip(width[two], width[two + 1], strict=True)}:
            pairs = two[(width[two] == x) & (width[two + 1] == y)]
            one, other = words[first[pairs][:, None] + np.arange(x)], words[first[pairs + 1][:, None] + np.arange(y)]
            keep = pairs[_may(_distance(_folded(one, min(x, y)), _folded(other, min(x, y))), size[pairs].astype(np.int64), size[pairs + 1].astype(np.int64), percent)]
            a.append(short[keep])
            b.append(short[keep + 1])
        for s, c in zip(start[count > 2].tolist(), count[count > 2].tolist(), strict=True):
            least = int(width[s : s + c].min())
            bits = np.stack([_folded(words[first[r] : first[r + 1]], least) for r in range(s, s + c)])
            for x, y in _forest(bits, size[s : s + c].astype(np.int64), block[s : s + c], bool(at[1, s] != at[2, s]), percent):
                a.append(short[s + x])
                b.append(short[s + y])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], names=["a", "b"])

    def run(batches):
        common.let_go()
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            at = np.stack([held.column(c).to_numpy() for c in ("sig", "i", "j")])
            last = int(np.flatnonzero(np.append(True, (at[:, 1:] != at[:, :-1]).any(axis=0)))[-1])  # the last group may go on
            if last:
                yield groups(held.slice(0, last).combine_chunks())
                held = held.slice(last)
        if held is not None:
            yield groups(held.combine_chunks())

    return run


def _near_edges(members: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """(a, b): edges that join all sets which share a signature and may be similar."""
    sums = [F.sum(F.shiftrightunsigned(F.xxhash64("short", F.lit(k)), 28)).alias(c) for k, c in enumerate("xyz")]
    lists = members.groupBy("sig").agg(F.count("*").alias("n"), *sums)
    once = lists.where("n > 1").groupBy("n", "x", "y", "z").agg(F.min("sig").alias("sig")).select("sig", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    live = members.join(once, "sig").join(bitmaps, "short").withColumn("block", F.pmod(F.xxhash64("short"), F.col("blocks")).cast("int"))
    dealt = live.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("sig", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "short", "size", "bitmap")
    dealt = dealt.repartition(common.partitions(members.sparkSession), "sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    return dealt.mapInArrow(_near(percent), "a long, b long").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _common(doc: np.ndarray, values: np.ndarray, left: int, n: int) -> np.ndarray:
    """(left, n - left): elements that each of the first `left` sets shares with each of the others."""
    out = np.zeros((left, n - left), np.float64)
    order = np.argsort(values, kind="stable")
    doc, values = doc[order], values[order]
    column = np.cumsum(np.append(True, values[1:] != values[:-1])) - 1 if len(values) else np.empty(0, np.int64)
    # Only elements on both sides count; those that the same sets have are one column with a weight.
    sums = [np.bincount(column, weights=w, minlength=column[-1] + 1 if len(column) else 0) for w in (doc < left, doc >= left)]
    both = (sums[0] > 0) & (sums[1] > 0)
    on = both[column]
    doc, column = doc[on], (np.cumsum(both) - 1)[column[on]]
    if not len(doc):
        return out
    edge = np.flatnonzero(np.diff(column, prepend=-1))
    patterns: dict[bytes, int] = {}
    chosen, weight = [], []
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(doc)], strict=True):
        at = patterns.setdefault(doc[a:b].tobytes(), len(chosen))
        if at == len(chosen):
            chosen.append((a, b))
            weight.append(0)
        weight[at] += 1
    weight = np.array(weight, np.float64)
    for start in range(0, len(chosen), LINK_COLUMNS):
        part = chosen[start : start + LINK_COLUMNS]
        cells = np.zeros((n, len(part)), np.float32)
        cells[np.concatenate([doc[a:b] for a, b in part]), np.repeat(np.arange(len(part)), [b - a for a, b in part])] = 1
        out += (cells[:left] * weight[start : start + len(part)].astype(np.float32)) @ cells[left:].T
    return out


def _similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which of the sets `left` and `right` (places in `sets`) are similar; elements ascend."""
    if len(left) == len(right) == 1:
        x, y = sets[left[0]], sets[right[0]]
        both = len(np.intersect1d(x, y, assume_unique=True))
        return np.array([[100 * both >= percent * (len(x) + len(y) - both)]])
    values = [sets[i] for i in (*left, *right)]
    size = np.array([len(v) for v in values])
    both = _common(np.repeat(np.arange(len(values)), size), np.concatenate(values), len(left), len(values))
    return 100 * both >= percent * (size[: len(left), None] + size[len(left) :] - both)


def _joins(like: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (left, right) of a forest that joins whatever the links `like` join."""
    rows, columns = like.shape
    edges, free_rows, free_columns = [], like.any(axis=1), like.any(axis=0)
    while free_rows.any():
        front = np.flatnonzero(free_rows)[:1]
        free_rows[front] = False
        while len(front):
            near = like[front] & free_columns
            hit = near.any(axis=0)
            edges.append((front[near.argmax(axis=0)[hit]], np.flatnonzero(hit)))
            free_columns &= ~hit
            back = np.flatnonzero(hit)
            near = like[:, back] & free_rows[:, None]
            hit = near.any(axis=1)
            edges.append((np.flatnonzero(hit), back[near.argmax(axis=1)[hit]] if len(back) else back))
            free_rows &= ~hit
            front = np.flatnonzero(hit)
    return tuple(np.concatenate([e[k] for e in edges]) if edges else np.empty(0, np.int64) for k in (0, 1))


def _link_blocks(percent: int, pairs: bool):
    """Of each run of rows of one (comp, i, j): (key, copies that it links with), and linked keys (a, b), all or a forest of them."""

    def links(i, j, key, copies, block, sets):
        block = np.array(block)
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        if not len(left) or not len(right):
            return [], [], []
        if len(key) == 2 and right is left:
            left, right = np.array([0]), np.array([1])
        like = _similar(sets, left, right, percent)
        if right is left:
            np.fill_diagonal(like, False)
        x, y = (np.nonzero(np.triu(like) if right is left else like)) if pairs else _joins(like)
        copies = np.array(copies, np.int64)
        counts = np.zeros(len(key), np.int64)
        counts[left] += like @ copies[right]
        if right is not left:
            counts[right] += like.T @ copies[left]
        some = np.flatnonzero(counts).tolist()
        a, b = [key[i] for i in left[x]], [key[i] for i in right[y]]
        return [key[i] for i in some] + a, [None] * len(some) + b, counts[some].tolist() + [None] * len(a)

    def run(batches):
        kinds = (pa.binary(), pa.binary(), pa.int64())
        last, held, made = None, ([], [], [], []), ([], [], [])

        def add():
            for column, values in zip(made, links(*last[1:], *held), strict=True):
                column.extend(values)

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(made, kinds, strict=True)], names=["a", "b", "n"])

        for batch in batches:
            at = list(zip(*(batch.column(c).to_pylist() for c in ("comp", "i", "j")), strict=True))
            for r, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "copies", "block", "set")), strict=True)):
                if at[r] != last:
                    if last is not None:
                        add()
                    last, held = at[r], ([], [], [], [])
                elif row[0] == held[0][-1]:  # the text of a repeated id
                    continue
                for column, value in zip(held, (*row[:3], np.frombuffer(row[3], np.uint64)), strict=True):
                    column.append(value)
            yield batch_of()
            made = ([], [], [])
        if last is not None:
            add()
            yield batch_of()

    return run


CARRIED = ["key", "copies", "comp", "blocks", "block"]


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """`wanted` (`CARRIED`, smallest) with `set`: the elements, ascending, of one document of each class."""
    ids = wanted.select(*CARRIED, F.col("smallest").alias("doc_id"))
    if wanted.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def own(batches):  # ids may be repeated: only the text that has the set
        for batch in batches:
            texts = batch.column("text")
            lengths = pa.compute.binary_length(texts).to_pylist()
            for a, b in common.slices(lengths, SLICE_BYTES, 1 << 20):
                part = batch.slice(a, b - a)
                sets = Shingles(part.column("text").to_pylist(), n)
                found = [i for i, k in enumerate(part.column("key").to_pylist()) if sets.key(i) == k]
                chosen = part.take(pa.array(found, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(chosen.column(c) for c in CARRIED), pa.array([sets.set(i).tobytes() for i in found], pa.binary())], names=[*CARRIED, "set"])

    found = docs.where("text IS NOT NULL").join(ids, "doc_id").select(*CARRIED, F.col("text").cast("binary").alias("text"))
    return found.mapInArrow(own, T.StructType([*ids.select(*CARRIED).schema.fields, T.StructField("set", T.BinaryType())]))


def _links(docs: DataFrame, groups: DataFrame, n: int, percent: int, pairs: bool) -> DataFrame:
    """(a, null, n): class a links with n copies of other classes; (a, b, null): linked classes, all of them or a forest."""
    sizes = groups.groupBy("comp").agg(F.count("*").alias("classes"), F.sum("size").alias("elements")).where("classes > 1")
    blocks = F.ceil(F.greatest(F.col("classes") / LINK_ROWS, F.col("elements") / LINK_ELEMENTS)).cast("int")
    live = groups.join(sizes.select("comp", blocks.alias("blocks")), "comp").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = _sets(docs, common.materialise(live, "live"), n).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "copies", "block", "set")
    dealt = dealt.repartition(common.partitions(docs.sparkSession), "comp", "i", "j").sortWithinPartitions("comp", "i", "j", "key")
    return common.materialise(dealt.mapInArrow(_link_blocks(percent, pairs), "a binary, b binary, n long"), "links")


def _classes(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, pairs: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (doc_id, size, key), the classes of equal sets (key, smallest, copies), and the classes' links."""
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    parts = max(2 * common.partitions(spark), common.input_bytes(docs) // PART_BYTES)
    asked = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_request(n, percent, parts), ROWS)
    found = common.materialise(asked.groupBy("part").applyInArrow(_answer, FOUND), "found")
    sets = found.where("sig IS NULL").select("doc_id", "size", "key", "bitmap")
    classes = sets.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("smallest"), F.count("doc_id").alias("copies"), F.first("size").alias("size"), F.max("bitmap").alias("bitmap"))
    classes = common.materialise(classes.where("smallest IS NOT NULL").withColumn("short", _short(F.col("key"))), "classes")
    members = found.where("sig IS NOT NULL").select("sig", "short", "size")
    labels = connected_components(common.materialise(_near_edges(members, classes.select("short", "bitmap"), percent), "near"))
    groups = classes.select("key", "smallest", "copies", "size", "short").join(labels.withColumnsRenamed({"node": "short", "component": "comp"}), "short")
    return sets.drop("bitmap"), classes.select("key", "smallest", "copies"), _links(docs, groups, n, percent, pairs)


def similar_classes(docs: DataFrame, n: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links): documents link when 100 * intersection >= percent * union of their shingle sets."""
    sets, classes, links = _classes(docs, n, percent, id_col, text_col)
    counts = links.where("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("others"))
    labels = connected_components(links.where("b IS NOT NULL").select("a", "b")).withColumnsRenamed({"node": "key", "component": "root"})
    named = classes.join(labels.join(counts, "key"), "key", "left")
    linked = common.materialise(named.where("root IS NOT NULL"), "linked")
    lowest = linked.groupBy("root").agg(F.min("smallest").alias("component"))
    linked = linked.join(lowest, "root").select("key", "component", "others")
    named = classes.join(linked, "key", "left").select("key", F.coalesce("component", "smallest").alias("component"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    known = F.col("doc_id").isNotNull()
    joined = sets.join(named, "key", "left")
    return joined.select(
        "doc_id", F.col("size").cast("long").alias("n_shingles"), F.when(known, F.coalesce("component", "doc_id")).alias("component_id"), F.when(known, F.coalesce("n_links", F.lit(0))).alias("n_links")
    )


def similar_pairs(docs: DataFrame, n: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between the smallest ids of different classes of equal sets, a < b; and the classes' members (doc_id, class_id)."""
    sets, classes, links = _classes(docs, n, percent, id_col, text_col, pairs=True)
    found = links.where("b IS NOT NULL")
    found = found.join(classes.select(F.col("key").alias("a"), F.col("smallest").alias("x")), "a").join(classes.select(F.col("key").alias("b"), F.col("smallest").alias("y")), "b")
    members = sets.where("doc_id IS NOT NULL").join(classes, "key").select("doc_id", F.col("smallest").alias("class_id"))
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), members


def _short(key):
    """The first 8 bytes of a key as a little-endian signed integer."""
    pairs = F.hex(F.substring(key, 1, 8))
    swapped = F.concat(*[F.substring(pairs, 2 * i + 1, 2) for i in reversed(range(8))])
    return F.conv(swapped, 16, -10).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(common.documents(spark, sf_dir), n=4, percent=85)
