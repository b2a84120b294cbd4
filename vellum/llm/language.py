"""Language identification of mixed text: script ranges narrow the candidates, a Viterbi pass over words labels spans.

Words are parted where the script changes, and runs of over `PIECE` letters into even pieces, so texts in scripts without
spaces are read whole. Fitting counts character n-grams (1 to 3 letters, with edges) of the pieces of a bounded sample of labelled
documents; the counts are summed on the executors and only the most frequent n-grams of each language reach the driver.
A piece's score in a language is its mean log-probability times a weight; scripts in which a language is hardly ever
written rule it out. The best path through the pieces pays `SWITCH` for every change of language.

The score says how sure the language is against the others, and falls to 0 where hardly an n-gram of the text is one that
the learnt languages have: a text in a script or language that none was learnt of is labelled, but not believed.

Cases: a null text or one without letters is `und` with score 0 and no spans; rows are independent, so repeated rows and
ids, null ids and empty tables need nothing special; without any labelled row all is `und`; carried columns that are
named like an output give way to it.
"""

from __future__ import annotations

import functools
import itertools
import math
import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm import common, packed

#: Documents a fit reads at most, and n-grams it keeps for a language.
FIT_DOCUMENTS, FIT_GRAMS = 2000, 20_000
SWITCH, CACHE_ENTRIES, SLICE_WORDS = 6.0, 150_000, 60_000
#: Letters of a piece at most; pieces of a longer run have at least half as many.
PIECE = 40
#: The share of a text's n-grams that the learnt languages know from which it counts as in one of them for certain.
FAMILIAR = 0.5
#: Share of a language's training letters that a script must have to admit it.
SCRIPT_SHARE = 0.005

# First and last code points of the letters of scripts (Unicode blocks).
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)], "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)], "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)], "hebrew": [(0x590, 0x5FF)], "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)], "bengali": [(0x980, 0x9FF)], "tamil": [(0xB80, 0xBFF)], "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)], "kana": [(0x3040, 0x30FF)], "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)], "hangul": [(0xAC00, 0xD7AF)],
}


#: The first code point above those of the Latin script's first blocks.
BEYOND_LATIN = chr(SCRIPTS["latin"][0][1] + 1)


@functools.cache
def script_of(letter: str) -> str:
    code = ord(letter)
    return next((name for name, ranges in SCRIPTS.items() if any(a <= code <= b for a, b in ranges)), "other")


def letters_of(word: str) -> str:
    """The word's letters, lower-case."""
    return word.lower() if word.isalpha() else "".join(filter(str.isalpha, word)).lower()


def pieces(word: str) -> list[str]:
    """The word's letters, parted where the script changes and into even pieces of at most `PIECE` letters."""
    letters = letters_of(word)
    if len(letters) <= PIECE and (letters.isascii() or max(letters) < BEYOND_LATIN):
        return [letters] if letters else []
    out = []
    for _, run in itertools.groupby(letters, script_of):
        run = "".join(run)
        n = -(-len(run) // PIECE)
        out += [run[len(run) * i // n : len(run) * (i + 1) // n] for i in range(n)]
    return out


def grams(letters: str) -> list[str]:
    edged = f"\x02{letters}\x03"
    return [edged[i : i + n] for n in (1, 2, 3) for i in range(len(edged) - n + 1)]


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> dict:
    """A model from `docs`, all of whose rows may be learnt from. A sample by hash of the id bounds the rows read."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("h"))
    chosen = rows.select("h").orderBy("h").limit(FIT_DOCUMENTS).agg(F.max("h")).first()[0]
    empty = {"langs": [], "grams": {}, "floor": np.empty(0, np.float32), "scripts": {}}
    if chosen is None:
        return empty

    def count(batches):
        words: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words[lang].update(text.split())
        found: Counter = Counter()
        for lang, counter in words.items():
            own: Counter = Counter()
            scripts: Counter = Counter()
            for w, n in counter.items():
                for letters in pieces(w):
                    for g in grams(letters):
                        own[g] += n
                    scripts[script_of(letters[0])] += n * len(letters)
            found.update({(lang, "g", g): n for g, n in own.items()} | {(lang, "s", x): n for x, n in scripts.items()})
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in found], pa.string()) for i in range(3)] + [pa.array(list(found.values()), pa.int64())], names=["lang", "kind", "item", "n"])

    counts = rows.where(F.col("h") <= chosen).select("lang", "text").mapInArrow(count, "lang string, kind string, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= FIT_GRAMS).select("lang", "kind", "item", "n").collect()
    langs = sorted({r.lang for r in top})
    if not langs:
        return empty
    at = {x: i for i, x in enumerate(langs)}
    scripts: dict[str, np.ndarray] = {}
    items: dict[str, np.ndarray] = {}
    for r in top:
        (items if r.kind == "g" else scripts).setdefault(r.item, np.zeros(len(langs)))[at[r.lang]] += r.n
    total = sum(items.values())
    floor = np.log(0.1 / (total + 0.1 * len(items))).astype(np.float32)
    of_lang = sum(scripts.values())
    return {
        "langs": langs,
        "grams": {g: np.log((n + 0.1) / (total + 0.1 * len(items))).astype(np.float32) for g, n in items.items()},
        "floor": floor,
        "scripts": {s: n / of_lang >= SCRIPT_SHARE for s, n in scripts.items()},
    }


def gram_keys(letters: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(key, piece) of all n-grams of some pieces, each between its edges: the code points of an n-gram as one integer."""
    code = np.frombuffer("".join(f"\x02{x}\x03" for x in letters).encode("utf-32-le"), "<u4").astype(np.int64)
    piece = np.repeat(np.arange(len(letters)), np.fromiter(map(len, letters), np.int64, len(letters)) + 2)
    inner = code != 3  # no n-gram goes on beyond an edge
    two = np.flatnonzero(inner[:-1])
    three = two[inner[np.minimum(two + 1, len(code) - 1)]]
    return np.concatenate([code, code[two] << 21 | code[two + 1], code[three] << 42 | code[three + 1] << 21 | code[three + 2]]), np.concatenate([piece, piece[two], piece[three]])


class Labeller:
    def __init__(self, model: dict):
        self.model, self.width = model, len(model["langs"])
        whole = lambda g: sum(ord(c) << 21 * i for i, c in enumerate(reversed(g)))
        self.table = packed.Lookup(np.fromiter(map(whole, model["grams"]), np.int64, len(model["grams"])))
        self.gram_scores = np.array([*model["grams"].values(), model["floor"]], np.float64).reshape(len(model["grams"]) + 1, self.width)
        self.scripts = list(model["scripts"])
        self.admitted = np.array([*model["scripts"].values(), np.ones(self.width, bool)], bool).reshape(len(self.scripts) + 1, self.width)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of a word's pieces in `scores`
        self.scores, self.letters, self.known = np.zeros((1024, self.width), np.float32), np.zeros(1024, np.int32), np.zeros(1024, np.float32)

    def _learn(self, words: list[str]) -> None:
        """Scores of the pieces of words not seen before: mean log-probability times a weight, relative to the best language."""
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words)), strict=True))
        parts = [pieces(w) or [""] for w in words]  # a word without letters is an empty piece
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        start = int(self.count.sum())
        self.first, self.count = np.concatenate([self.first, start + np.cumsum(counts) - counts]), np.concatenate([self.count, counts])
        letters = [x for p in parts for x in p]
        while len(self.scores) < start + len(letters):
            self.scores, self.letters, self.known = (np.concatenate([x, np.zeros_like(x)]) for x in (self.scores, self.letters, self.known))
        full = [i for i, x in enumerate(letters) if x]
        for a in range(0, len(full), 20_000):
            part = full[a : a + 20_000]
            held = [letters[i] for i in part]
            keys, piece = gram_keys(held)
            ids = self.table.find(keys)  # the floor's row, the last, for an n-gram that the model doesn't have
            sizes = np.bincount(piece, minlength=len(part))
            sums = np.stack([np.bincount(piece, weights=self.gram_scores[ids, k], minlength=len(part)) for k in range(self.width)], axis=1)
            n = np.fromiter(map(len, held), np.int64, len(held))
            score = sums / sizes[:, None] * np.minimum(n + 1, 8)[:, None]
            script = np.array([self.scripts.index(x) if (x := script_of(h[0])) in self.model["scripts"] else -1 for h in held])
            score = np.where(script[:, None] < 0, 0, score - score.max(axis=1, keepdims=True))
            at = start + np.array(part)
            self.scores[at], self.letters[at] = np.where(self.admitted[script], score, np.float32(-30)), n
            self.known[at] = np.maximum(0, np.bincount(piece, weights=ids >= 0, minlength=len(part)) - 2) / np.maximum(1, sizes - 2)  # but for the edges

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[dict]]]:
        """Language, score and spans (of word positions) of each text."""
        out: list = [("und", 0.0, [])] * len(texts)
        words = [t.split() if t else [] for t in texts]
        rows = [i for i, ws in enumerate(words) if ws]
        if not self.width or not rows:
            return out
        if self.count.sum() > CACHE_ENTRIES:
            self.clear()
        self._learn(list(set().union(*words).difference(self.index)))
        index = self.index
        n_words = np.array([len(words[i]) for i in rows])
        starts = np.concatenate([[0], np.cumsum(n_words)])
        ids = np.fromiter(map(index.__getitem__, itertools.chain.from_iterable(words[i] for i in rows)), np.int64, starts[-1])
        counts = self.count[ids]
        ends = np.concatenate([[0], np.cumsum(counts)])
        place = np.repeat(np.arange(starts[-1]) - np.repeat(starts[:-1], n_words), counts)  # a piece's word within its text
        ids = np.repeat(self.first[ids] - ends[:-1], counts) + np.arange(ends[-1])
        at = ends[starts]
        sizes = np.diff(at)
        scores, letters, known = self.scores[ids], self.letters[ids], self.known[ids]
        whole = np.add.reduceat(scores, at[:-1], axis=0)
        first = whole.argmax(axis=1)
        mixed = self._may_switch(scores, at, sizes, first)
        paths: dict[int, np.ndarray] = {}
        order = np.flatnonzero(mixed)[np.argsort(-sizes[mixed], kind="stable")]
        start = 0
        while start < len(order):  # documents of like length run in step
            part = order[start : start + max(1, 4 * SLICE_WORDS // int(sizes[order[start]]))]
            paths |= dict(zip(part.tolist(), self._paths([scores[at[i] : at[i + 1]] for i in part]), strict=True))
            start += len(part)
        for j, i in enumerate(rows):
            a, b = at[j], at[j + 1]
            out[i] = self._sum_up(paths.get(j), int(first[j]), letters[a:b], known[a:b], whole[j], place[a:b])
        return out

    def _may_switch(self, scores: np.ndarray, at: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """False where the best path stays in the best single language throughout.

        That is so if no other language gains more than one switch costs over it in any run of words, and taking each
        word's best other language doesn't beat it in sum: then a path's every run elsewhere costs at least what it gains.
        """
        doc = np.repeat(np.arange(len(sizes)), sizes)
        gain = (scores - scores[np.arange(len(scores)), first[doc]][:, None]).astype(np.float64)
        others = gain.copy()
        others[np.arange(len(gain)), first[doc]] = -np.inf
        may = np.add.reduceat(others.max(axis=1), at[:-1]) > 0 if self.width > 1 else np.zeros(len(sizes), bool)
        places = np.arange(len(scores)) + doc + 1
        for k in range(self.width):
            level = np.zeros(len(scores) + len(sizes))
            level[places] = gain[:, k]
            level[at[:-1] + np.arange(len(sizes))] = 0
            total = np.cumsum(level)
            drop = np.repeat(np.arange(len(sizes)), sizes + 1) * (2 * np.abs(total).max() + 1)  # a document's lowest is below all before it
            run = total - drop
            best = np.maximum.reduceat(run - np.minimum.accumulate(run), at[:-1] + np.arange(len(sizes)))
            may |= best > SWITCH - 1e-6
        return may

    def _paths(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Best language by word for texts in falling order of length, one step for all texts at a time."""
        sizes = np.array([len(s) for s in scores])
        steps, n = int(sizes[0]), len(scores)
        padded = np.zeros((steps, n, self.width), np.float32)
        for i, s in enumerate(scores):
            padded[: len(s), i] = s
        live = np.searchsorted(-sizes, -np.arange(1, steps + 1), side="right")
        best = np.zeros((steps, n), np.int16)
        jump = np.zeros((steps, n, self.width), bool)
        state = padded[0].copy()
        for t in range(1, steps):
            k = live[t]
            now = state[:k]
            top = now.argmax(axis=1)
            reach = now[np.arange(k), top] - np.float32(SWITCH)
            best[t, :k] = top
            jump[t, :k] = now < reach[:, None]
            state[:k] = np.maximum(now, reach[:, None]) + padded[t, :k]
        at = state.argmax(axis=1)
        paths = np.zeros((steps, n), np.int16)
        every = np.arange(n)
        for t in range(steps - 1, -1, -1):
            k = live[t]
            paths[t, :k] = at[:k]
            if t:
                at[:k] = np.where(jump[t, every[:k], at[:k]], best[t, :k], at[:k])
        return [paths[: sizes[i], i] for i in range(n)]

    def _sum_up(self, path: np.ndarray | None, first: int, letters: np.ndarray, known: np.ndarray, whole: np.ndarray, place: np.ndarray) -> tuple[str, float, list[dict]]:
        total = int(letters.sum())
        if not total:
            return "und", 0.0, []
        langs, share, spans = self.model["langs"], 1.0, [{"first": 0, "last": int(place[-1]), "lang": self.model["langs"][first]}]
        if path is not None:
            shares = np.bincount(path, weights=letters, minlength=self.width) / total
            first = int(shares.argmax())
            share = float(shares[first])
            edge = (np.flatnonzero(np.diff(path)) + 1).tolist()
            spans = [{"first": int(place[a]), "last": int(place[b - 1]), "lang": langs[path[a]]} for a, b in zip([0, *edge], [*edge, len(path)], strict=True)]
        rival = max([x for i, x in enumerate(whole.tolist()) if i != first], default=-math.inf)
        sure = 1 / (1 + math.exp(min(50.0, max(-50.0, rival - float(whole[first])))))
        # A text whose n-grams no learnt language has is in none of them, however it compares.
        familiar = min(1.0, float(known @ letters) / total / FAMILIAR)
        return langs[first], min(1.0, share * sure * familiar), spans


OUTPUT = T.StructType([
    T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("lang", T.StringType())]))),
])


def identify(docs: DataFrame, model: dict, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Appends lang_pred, score (0 to 1) and spans (runs of white-space-separated words; two that
    meet inside a word both name it) to the carried columns (doc_id)."""
    sent, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # bounded by FIT_GRAMS a language

    def make():
        # What a task has learnt serves the next one with the same model.
        labeller = common.held(("language", name), lambda: Labeller(sent.value))
        return lambda texts: tuple(zip(*labeller.label(texts), strict=True))

    return common.arrow_map(docs, ["doc_id"] if carry is None else carry, text_col, OUTPUT, make)


def train(docs: DataFrame) -> dict:
    return fit(docs.where(~common.held_out()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = train(docs)
    rows = docs.withColumn("held_out", common.held_out())
    return identify(rows, model, carry=["doc_id", "held_out"]).drop("spans")
