"""Toxicity scores by weak supervision: many voters, a generative label model, a linear classifier on its labels.

Voters are a lexicon of insults in several languages and patterns (words and word beginnings, each with a least density).
The label model is a two-class mixture fitted by expectation maximisation: every round estimates each voter's rates of
firing by class and the correlations of voters within a class, which discount voters that repeat each other. A given label
is one more voter, whose own accuracy is estimated with the others': no label overrules what the voters say together. A
logistic regression on item densities learns the posterior labels and scores every whole text.

The fit reads at most `FIT_LABELLED` labelled documents; nothing else is sampled.

Cases: null and empty texts score as a text without any item; rows are independent, so repeated rows and ids and empty
tables need nothing special; a null id counts as held out; without any labelled row of both classes the lexicon alone
decides; carried columns that are named like an output give way to it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm import common

#: Labelled documents that a fit reads at most; pattern voters, and items of the classifier.
FIT_LABELLED, VOTERS, ITEMS = 4000, 60, 300
THRESHOLD, BUCKETS, CACHE_ENTRIES = 0.3, 1 << 22, 300_000
#: How often a label is taken to be right before anything is known, and how many labels that belief weighs.
LABEL_TRUST, LABEL_WEIGHT = 0.97, 50
#: Densities (share of a text's words) from which a pattern voter may fire; 0 stands for any occurrence.
DENSITIES = (0.0, 0.004, 0.008, 0.015, 0.03)

# Words of insult, by language.
LEXICON = [
    *"bastard clown coward creep despicable disgusting dumb fool freak garbage hate hated idiot idiots idiotic imbecile jerk kill liar loser losers lunatic moron morons nasty pathetic pig pigs retard scum stupid trash ugly useless vermin vile worthless".split(),
    *"abschaum blöd dumm dumme dummkopf ekelhaft hass hässlich idioten mistkerl müll nutzlos schwachkopf schwein versager wertlos widerlich".split(),
    *"abruti bête crétin dégoûtant débile haine imbécile laid merde nul ordure porc pathétique salaud stupide vermine".split(),
    *"asco asqueroso basura cerdo escoria estúpido fracasado idiota imbécil inútil odio patético repugnante tonto".split(),
]

WORD = re.compile(r"[^\W\d_]+")


def items_of(word: str) -> list[int]:
    """Numbers of a word's items: itself and its first 4 to 7 letters."""
    return [zlib.crc32(f"{n}{word[:n]}".encode()) % BUCKETS for n in (4, 5, 6, 7) if len(word) >= n] + [zlib.crc32(f"={word}".encode()) % BUCKETS]


def _sample(docs: DataFrame, labels: DataFrame, label_col: str) -> DataFrame:
    """(text, label) of the labelled documents, at most `FIT_LABELLED` of them, by hash of the id."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    known = marks.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_LABELLED)
    return docs.join(F.broadcast(known), "doc_id").select("text", "label")  # at most FIT_LABELLED rows


def _counts(sample: DataFrame) -> list[tuple[int | None, int, np.ndarray, np.ndarray]]:
    def count(batches):
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                words = Counter(WORD.findall(text.lower()) if text else ())
                items: Counter = Counter()
                for w, n in words.items():
                    for i in set(items_of(w)):
                        items[i] += n
                out.append((sum(words.values()), np.fromiter(items, "<i4", len(items)).tobytes(), np.fromiter(items.values(), "<i4", len(items)).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("label"), *(pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary())))], names=["label", "size", "items", "n"])

    rows = sample.mapInArrow(count, "label int, size int, items binary, n binary").collect()
    rows.sort(key=lambda r: (bytes(r["items"]), -1 if r["label"] is None else r["label"]))  # whatever order tasks end in
    return [(r["label"], r["size"], np.frombuffer(r["items"], "<i4"), np.frombuffer(r["n"], "<i4")) for r in rows]


def label_model(votes: np.ndarray, known: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each row, rates of firing by class (voters, 2), correlations within classes, and how often a label is 1 by class.

    votes: (rows, voters) of 0 and 1; known: 1, 0 or -1 by row, the label voter's word (-1: it says nothing).
    """
    # Texts hold few of the items, and those of one language at most: a voter that doesn't fire abstains, and that none does is
    # one more voter's word.
    v, says = np.concatenate([votes, ~votes.any(axis=1, keepdims=True)], axis=1).astype(np.float64), known >= 0
    p = np.where(says, known, np.clip(votes.mean(axis=1) * 2, 0.01, 0.9)).astype(np.float64)
    weight, correlation = np.ones(v.shape[1]), np.zeros((v.shape[1],) * 2)
    believed = (1 - LABEL_TRUST, LABEL_TRUST)
    rates, trust = np.zeros((v.shape[1], 2)), np.array(believed)
    for step in range(rounds):
        # The share of the class, as the labels tell it by their accuracy.
        prior = np.clip((known[says].mean() - trust[0]) / (trust[1] - trust[0]) if says.any() else p.mean(), 1e-3, 0.5)
        spread = np.zeros_like(correlation)
        for c, q in enumerate((1 - p, p)):
            rates[:, c] = (q @ v + (0.1, 0.5)[c]) / (q.sum() + 1)
            trust[c] = (q[known == 1].sum() + LABEL_WEIGHT * believed[c]) / (q[says].sum() + LABEL_WEIGHT)
            d = (v - rates[:, c]) * np.sqrt(q)[:, None]
            spread += d.T @ d
        if step >= rounds // 4:  # once the classes have begun to settle
            scale = np.sqrt(np.maximum(np.diag(spread), 1e-9))
            correlation = spread / scale[:, None] / scale
            weight = 1 / (1 + np.clip(correlation - np.eye(len(scale)) - 0.1, 0, None).sum(axis=1))
        z = np.log(prior / (1 - prior)) + v @ (np.log(rates[:, 1] / rates[:, 0]) * weight)
        z += np.where(known == 1, np.log(trust[1] / trust[0]), np.where(known == 0, np.log((1 - trust[1]) / (1 - trust[0])), 0.0))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return p, rates[:-1], correlation[:-1, :-1], trust


def _voters(known: np.ndarray, density: dict[int, np.ndarray]) -> list[tuple[int, float]]:
    """(item, least density) of the lexicon, and of the patterns that most often come with a label and seldom without."""
    found = []
    for item, x in density.items():
        for least in DENSITIES:
            fires = x > 0 if least == 0 else x >= least
            hit, miss = int((fires & (known == 1)).sum()), int((fires & (known == 0)).sum())
            if hit >= 3 and hit > 4 * miss:
                found.append((hit * hit / (hit + 4 * miss), -least, item))
    best: dict[int, float] = {}
    for _, least, item in sorted(found, reverse=True):
        best.setdefault(item, -least)
    lexicon = {items_of(w)[-1]: 0.0 for w in LEXICON}
    return list((lexicon | dict(list(best.items())[:VOTERS])).items())


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic") -> dict:
    """A model from `docs`, of which all labels may be learnt."""
    rows = _counts(_sample(docs, labels, label_col))
    known = np.array([-1 if r[0] is None else r[0] for r in rows])
    seen: Counter = Counter()
    toxic: Counter = Counter()
    for r in rows:
        seen.update(r[2].tolist())
        if r[0] == 1:
            toxic.update(r[2].tolist())
    lexicon = {items_of(w)[-1] for w in LEXICON}
    wanted = {i for i, n in toxic.most_common() if n >= 3 and n * 6 > seen[i]} | lexicon
    density: dict[int, np.ndarray] = {}
    for j, (_, size, items, n) in enumerate(rows):
        for i, k in zip(items.tolist(), n.tolist(), strict=True):
            if i in wanted:
                density.setdefault(i, np.zeros(len(rows), np.float32))[j] = k / size
    voters = _voters(known, density)
    none = np.zeros(len(rows), np.float32)
    votes = np.array([(x > 0 if least == 0 else x >= least) for item, least in voters for x in [density.get(item, none)]], bool).T if len(rows) else np.zeros((0, len(voters)), bool)
    if len(rows) == 0 or len(set(known[known >= 0])) < 2:
        return {"items": sorted(lexicon), "weights": np.full((len(lexicon), len(DENSITIES)), 3.0) * (np.arange(len(DENSITIES)) == 0), "bias": -3.5}
    p = label_model(votes, known)[0]
    gain = {i: max(p[f].sum() ** 2 / (f.sum() + 1) for f in _fires(x[:, None]).T) for i, x in density.items()}
    kept = sorted(sorted(gain, key=lambda i: (-gain[i], i))[:ITEMS] + [i for i in lexicon if i not in gain])
    kept = list(dict.fromkeys(kept))
    x = np.array([density.get(i, none) for i in kept], np.float32).T
    w, bias = _regress(_fires(x[:, :, None]).reshape(len(x), -1).astype(np.float32), p)
    return {"items": kept, "weights": w.reshape(len(kept), -1), "bias": bias}


def _fires(density: np.ndarray) -> np.ndarray:
    """Whether the last axis's single density reaches each of `DENSITIES`."""
    return np.concatenate([density > 0, density >= np.array(DENSITIES[1:], np.float32)], axis=-1)


def _regress(x: np.ndarray, p: np.ndarray, penalty: float = 1.0, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on probabilities as labels, by accelerated gradient steps."""
    w, bias, n = np.zeros(x.shape[1]), float(np.log(np.clip(p.mean(), 1e-3, 0.999) / (1 - np.clip(p.mean(), 1e-3, 0.999)))), len(x)
    v = np.append(w, bias)
    last, step = v.copy(), 4 * n / (np.linalg.norm(x, 2) ** 2 + n + 4 * penalty)
    for t in range(rounds):
        u = v + t / (t + 3) * (v - last)
        slope = 1 / (1 + np.exp(-np.clip(x @ u[:-1] + u[-1], -30, 30))) - p
        last, v = v, u - step / n * np.append(x.T @ slope + penalty * u[:-1], slope.sum())
    return v[:-1], float(v[-1])


class Scorer:
    def __init__(self, model: dict):
        self.model = model
        self.place = {item: i for i, item in enumerate(model["items"])}
        self.cache: dict[str, tuple[int, ...]] = {}

    def score(self, texts: list[str | None]) -> list[float]:
        if len(self.cache) > CACHE_ENTRIES:
            self.cache = {}
        cache, place, out = self.cache, self.place, []
        weights = self.model["weights"]
        for text in texts:
            words = WORD.findall(text.lower()) if text else []
            for w in set(words).difference(cache):
                cache[w] = tuple({place[i] for i in items_of(w) if i in place})
            hits = [i for w in words if (c := cache[w]) for i in c]
            z = self.model["bias"]
            if hits:
                at, n = np.unique(hits, return_counts=True)
                z += float(weights[at][_fires((n / len(words)).astype(np.float32)[:, None])].sum())
            out.append(float(1 / (1 + np.exp(-min(30.0, max(-30.0, z))))))
        return out


def score(docs: DataFrame, model: dict, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Appends score (0 to 1, higher: likelier toxic) and predicted (1 from `THRESHOLD` on) to the carried columns (doc_id)."""
    out = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most ITEMS weights

    def make():
        scorer = Scorer(sent.value)

        def work(texts):
            scores = scorer.score(texts)
            return scores, [int(s >= THRESHOLD) for s in scores]

        return work

    return common.arrow_map(docs, ["doc_id"] if carry is None else carry, text_col, out, make, slice_bytes=8 << 20)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    model = fit(docs.where(~common.held_out()), labels)
    return score(docs.withColumn("held_out", common.held_out()), model, carry=["doc_id", "held_out"])
