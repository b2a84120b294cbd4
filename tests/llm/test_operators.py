"""Operators against brute force on a small fixture with nulls, empties, ties, copies and very long texts."""

import hashlib
import re
import time
import zlib

import numpy as np
import pytest

from vellum.llm import byte_bpe, common, components, fingerprints, jaccard, language, licences, media, mixing, substrings, token_files, toxicity

P = pytest.importorskip("public_tokenizers")


def _sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def test_token_files(spark, make, texts, tmp_path):
    from tokenizers import Tokenizer

    path = f"file://{tmp_path}/ids"
    token_files.write_tokens(make(texts), path, P.path("word_bpe_49k.json"), 2, blocks=5)
    rows = {r.doc_id: r for r in token_files.read_tokens(spark, path).collect()}
    tokenizer, start = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids) == (start, len(ids), ids)
        start += len(ids)
    sums = {r.doc_id: r.ids_crc32 for r in token_files.checksums(token_files.read_tokens(spark, path)).collect()}
    assert sums[1] == zlib.crc32(np.array([2], "<u4").tobytes())
    found = token_files.lookup_tokens(spark, path, [3, 99])
    assert [r.doc_id for r in found.collect()] == [3]
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString()


def test_token_units_equal_the_library(monkeypatch):
    """Pairs of Latin-1, marks that join capitals, special tokens, NULs and long units, across chunks and forgotten units."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng, known = np.random.default_rng(7), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    odd = [*"abzJHTWYIK019 \n\t.,'\"_-|<>É×÷²ªµ«\xa0\x85\0\x1cİıΣςKÅ中😀ﬁ;\u2028가", *"\u0301\u0307\u030c\u0331\u0338", "'s", "'LL", "ДОМ", "<|endoftext|>", "<|ENDOFTEXT|>", "z" * 30, "Q" * 70]
    texts = [None, "", *(chr(a) + chr(b) for a in range(256) for b in range(256)), *("".join(rng.choice(odd, n)) for n in rng.integers(1, 25, 4000)), None, ""]
    want = [[*e.ids, 2] for e in known.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    for kept, chunk in ((token_files.KEPT, token_files.CHUNK), (500, 2000), (500, 1)):
        monkeypatch.setattr(token_files, "KEPT", kept)
        monkeypatch.setattr(token_files, "CHUNK", chunk)
        encoder, step = token_files.UnitEncoder(P.path("word_bpe_49k.json")), 7000
        for a in range(0, len(texts), step) if chunk > 1 else [len(texts) - 800]:
            ids, counts = encoder.encode(pa.array(["before", *texts[a : a + step]]).slice(1), 2)
            assert counts.tolist() == [len(w) for w in want[a : a + step]]
            assert ids.tolist() == [i for w in want[a : a + step] for i in w]


def test_known_words_are_not_taken_one_by_one():
    """Texts of known words take less time than parting them into words in Python would: it was about twice that."""
    import pyarrow as pa

    rng, encoder = np.random.default_rng(1), token_files.UnitEncoder(P.path("word_bpe_49k.json"))
    parts = ["an", "ter", "of", "ing", "re", "th", "on", "is", "ed", "al", "per", "com"]
    words = ["".join(rng.choice(parts, rng.integers(1, 5))) for _ in range(30000)]
    texts = [" ".join(w + "," * (k % 9 == 0) for k, w in enumerate(rng.choice(words, 3000))) for _ in range(100)]
    column = pa.array(texts)
    encoder.encode(column, 2)

    def least(run):
        took = []
        for _ in range(5):
            began = time.process_time()
            run()
            took.append(time.process_time() - began)
        return min(took)

    assert least(lambda: encoder.encode(column, 2)) < least(lambda: [re.findall(r"\w+|[^\w\s]+", t) for t in texts])


def test_byte_bpe(make, texts):
    import tiktoken

    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = {r.doc_id: r for r in byte_bpe.encode(make(texts), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, carry=["doc_id", "N_Tokens"]).collect()}
    bpe = byte_bpe.ByteBpe(ranks, P.PATTERN)
    both = {r.doc_id: r for r in byte_bpe.round_trip(make(texts), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = np.array(own.encode_ordinary(t or ""), "<u4")
        assert (both[i].n_tokens, both[i].ids_sha256, both[i].decoded_sha256) == (len(ids), _sha(ids.tobytes()), _sha((t or "").encode()))
        assert np.frombuffer(rows[i].ids, "<u4").tolist() == own.encode_ordinary(t or "")
        assert bpe.decode(rows[i].ids) == (t or "").encode()


def test_substrings(make, texts):
    rows = {r.doc_id: r for r in substrings.remove_repeats(make(texts), keep_text=True, block_bytes=2000).collect()}
    words, first = [(t or "").encode().split() for t in texts], {}
    for i, w in enumerate(words):
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    for i, w in enumerate(words):
        dead = set()
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                dead |= set(range(j, j + 13))
        kept = b" ".join(x for j, x in enumerate(w) if j not in dead)
        assert (rows[i].n_words, rows[i].n_removed, rows[i].kept_sha256) == (len(w), len(dead), _sha(kept))
        assert sum(s.last - s.first + 1 for s in rows[i].removed) == len(dead)


def _classes(sets, percent):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard(make, texts, n, percent):
    # A chain of edits: neighbours are similar, its ends are not; and a crowd that shares most of a passage without being similar.
    chain = [" ".join(f"c{i}{'x' if i < 3 * k else ''}" for i in range(90)) for k in range(12)]
    crowd = [" ".join([f"p{i}" for i in range(40)] + [f"q{k}-{i}" for i in range(14)]) for k in range(40)]
    every = texts + chain + crowd
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for t in every]
    sets = [frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset() for w in words]
    want = _classes(sets, percent)
    rows = {r.doc_id: r for r in jaccard.similar_classes(make(every), n, percent).collect()}
    assert [(rows[i].n_shingles, rows[i].component_id) for i in range(len(every))] == [(len(s), c) for s, c in zip(sets, want, strict=True)]


@pytest.mark.parametrize("rows", [5, 1000])
def test_jaccard_links(make, monkeypatch, rows):
    """Every link of a cluster, also between texts that a third one joins already, in one block and in several."""
    monkeypatch.setattr(jaccard, "LINK_ROWS", rows)
    texts = [" ".join(f"c{i}{'x' if i < k else ''}" for i in range(90)) for k in range(12)] + [" ".join(f"two{i}{'y' if i < k else ''}" for i in range(90)) for k in range(2)]
    texts += [texts[0], texts[3], texts[3].upper(), "alone", "alone", "", None]
    sets = [frozenset(zip(*[(t or "").lower().split()[i:] for i in range(4)], strict=False)) or frozenset((t or "").split()) for t in texts]
    alike = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 85 * len(a | b)
    got = {r.doc_id: r.n_links for r in jaccard.similar_classes(make(texts), 4, 85).collect()}
    assert got == {i: sum(alike(a, b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)}
    pairs, members = jaccard.similar_pairs(make(texts), 4, 85)
    first = {s: i for i, s in reversed(list(enumerate(sets)))}
    assert sorted(map(tuple, pairs.collect())) == sorted((i, j) for a, i in first.items() for b, j in first.items() if i < j and alike(a, b))
    assert dict(map(tuple, members.collect())) == {i: first[s] for i, s in enumerate(sets) if s}


@pytest.mark.parametrize("percent", [80, 85])
def test_signatures_are_complete_and_few(percent):
    """The least similar pairs share a signature; no set, however large and wherever in its band, has many more than cells."""
    rng = np.random.default_rng(7)

    def signed(sets):
        values, doc = np.concatenate([np.sort(s) for s in sets]), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        sig, owner = jaccard.signatures(values, doc, np.array([len(s) for s in sets]), percent)
        return [set(sig[owner == i].tolist()) for i in range(len(sets))]

    fresh = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)
    for size in [*range(4, 60), *rng.integers(60, 3000, 60).tolist()]:
        base = fresh(size)
        gone = int(rng.integers(0, size))
        added = 0
        while gone and 100 * (size - gone) < percent * size:
            gone -= 1
        while 100 * (size - gone) >= percent * (size + added + 1):
            added += 1
        one, two = signed([base, np.concatenate([base[gone:], fresh(added)])])
        assert one & two or not gone + added
    for size in [1000, 1100, 1250, 1400, 1600, 1800, 50_000, 90_000, 100_000, 110_000, 120_000]:
        assert len(signed([fresh(size)])[0]) < 2 * size


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100 + k: 100 for k in range(30)}


def _leaves(text):
    """The tree's leaves by their definition: every line's words, cut at 0, 1, 2, 4, 8, 16, 24, ..."""
    out = []
    for line in (x for section in text.split("\n\n") for x in section.split("\n")):
        words = line.split(" ")
        cuts = [c for c in [0, 1, 2, 4, *range(8, len(words) + 8, 8)] if c < len(words)]
        out += [_sha(" ".join(words[a:b]).encode())[:8] for a, b in zip(cuts, [*cuts[1:], len(words)], strict=True)]
    return out


def test_fingerprints(make, texts):
    rows = {r.doc_id: r for r in fingerprints.compare_with_next(make(texts)).collect()}
    dice = lambda a, b: 2 * len(set(_leaves(a)) & set(_leaves(b))) / (len(set(_leaves(a))) + len(set(_leaves(b))))
    for i, t in enumerate(texts):
        t, after = t or "", texts[i - 1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert (rows[i].n_chars, rows[i].edited_sha256) == (len(t), _sha(edited.encode()))
        assert rows[i].near_next == pytest.approx(dice(t, after)) and rows[i].near_edited == pytest.approx(dice(t, edited))
        printed = rows[i].fingerprint.split("|")[1]
        assert "".join(re.findall(r":([0-9a-f]+)", printed)) == "".join(_leaves(t))
        for j, other in enumerate(texts):
            assert (rows[i].fingerprint == rows[j].fingerprint) == (t == (other or ""))


def test_changed_paragraphs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a\nb\n\nc\nd", "a\nX\n\nc\nd"), ("a", "a"), ("a\n\nb", "a")], "x string, y string")
    got = [[tuple(p) for p in r.c] for r in df.select(fingerprints.changed_paragraphs(fingerprints.tree(F.col("x")), fingerprints.tree(F.col("y"))).alias("c")).collect()]
    assert got == [[(0, 1)], [], [(1, 0)]]


def test_media(make, texts):
    rows = {r.doc_id: r for r in media.features(media.store(make(texts))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = media.pad(raw)
        assert (rows[i].n_bytes, rows[i].payload_bytes, rows[i].payload_sha256, rows[i].tail_crc32) == (len(raw), len(payload), _sha(payload), zlib.crc32(payload[-16:]))
    assert rows[3].feature == rows[4].feature and rows[3].media_sha256 == rows[4].media_sha256


@pytest.mark.parametrize("high", [1, 3, 31, 33, 700, 5000])
def test_media_hash(high):
    """The hash by its definition: samples averaged to 32 by 32 cells, low frequencies against their median."""
    samples = np.random.default_rng(high).integers(0, 256, (high, 64, 3), np.uint8)
    grey = samples.mean(axis=2)
    share = lambda n: np.array([[max(0.0, min((c + 1) * n / 32, i + 1) - max(c * n / 32, i)) * 32 / n for i in range(n)] for c in range(32)])
    cells = share(high) @ grey @ share(64).T
    k = np.arange(media.HASH)[:, None]
    cosines = np.cos(np.pi * (np.arange(32) + 0.5) * k / 32)
    low = np.round(cosines @ cells @ cosines.T, 6).ravel()
    assert media.perceptual_hash(samples) == np.packbits(low > np.median(low[1:])).tobytes().hex()


def test_png_damage_and_filters():
    image = bytearray(media.to_png(b"a" * 192))
    image[60] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(image))
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 256, (10, 12), np.uint8)
    lines = np.zeros((10, 13), np.uint8)
    for r in range(10):  # all five filters, by their definition
        kind = r % 5
        lines[r, 0] = kind
        for x in range(12):
            left, up = (int(rows[r, x - 3]) if x >= 3 else 0), (int(rows[r - 1, x]) if r else 0)
            corner = int(rows[r - 1, x - 3]) if r and x >= 3 else 0
            p = left + up - corner
            paeth = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            lines[r, x + 1] = (int(rows[r, x]) - (0, left, up, (left + up) // 2, paeth)[kind]) % 256
    assert (media.unfilter(lines, 3) == rows).all()


def test_licences(spark, make):
    mit = licences.TEXTS[0][1]
    docs = make(["Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " , "), "text\nreleased under the M.I.T license", "text\n - Released under the MIT Licence!\nAll rights reserved", None, ""])
    rows = {r.doc_id: r for r in licences.scan(docs, licences.known_licences(spark)).collect()}
    assert [rows[i].text_licence for i in range(5)] == ["MIT", None, None, None, None]
    assert [rows[i].line_licences for i in range(5)] == ["", "", "MIT,all-rights-reserved", "", ""]
    assert rows[3].digest is None and rows[2].n_licence_lines == 2


def test_licence_files_as_people_keep_them(spark, make):
    """Titles, statements, wrapped lines, other marks of lists and spellings don't hide a licence; other words do."""
    import textwrap

    known = dict(licences.TEXTS)
    files = ["\n\n".join(textwrap.fill(p, 60, break_on_hyphens=False) for p in text.split("\n\n")) for text in known.values()]
    titled = ["MIT License\n\nCopyright (c) 2020 Jan Nowak <j@x.pl>\nCopyright 2021 Others\n\n" + known["MIT"], "BSD 3-Clause License\n\nCopyright (c) 2020, X\nAll rights reserved.\n\n" + known["BSD-3-Clause"].replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")]
    other = [known["ISC"] + " and more", known["MIT"].replace("without limitation", "with limitation"), "Copyright (c) 2020 X", "MIT License"]
    rows = {r.doc_id: r for r in licences.scan(make(files + titled + other), licences.known_licences(spark)).collect()}
    assert [rows[i].text_licence for i in range(len(rows))] == [*known, "MIT", "BSD-3-Clause", None, None, None, None]
    assert "copyright notice and this permission" in textwrap.fill(known["ISC"], 60).lower().replace("\n", " ")


def test_mixing(make):
    docs = make([f"{'w ' * (i % 7 + 1)}" for i in range(90)])
    rows = mixing.plan(docs, repetition_limit=1.5, block_tokens=50).collect()
    assert {r.doc_id for r in rows} == set(range(90)) and max(r.epoch for r in rows) <= 1
    again = mixing.plan(docs, repetition_limit=1.5, block_tokens=50).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
    assert mixing.mix(docs, repetition_limit=None, target_entropy=1.0).columns == docs.columns


def test_language(spark, make):
    en, ru = "the of and that with from this have been which", "что как это было для него она они только все"
    fit = [(i, (en if i % 2 else ru) + f" {'and that' if i % 2 else 'как это'}", "en" if i % 2 else "ru") for i in range(40)]
    model = language.fit(spark.createDataFrame(fit, "doc_id long, text string, lang string"))
    rows = {r.doc_id: r for r in language.identify(make([en, ru, None, "123 ...", en + " " + ru]), model).collect()}
    assert [rows[i].lang_pred for i in range(4)] == ["en", "ru", "und", "und"]
    assert [s.lang for s in rows[4].spans] == ["en", "ru"] and rows[4].spans[1].first == 10


def test_language_without_spaces(spark, make):
    """Long runs are read to their end, and a language or script may change inside a word."""
    one, two = ("".join(chr(0x4E00 + k + (7 * i) % 50) for i in range(200)) for k in (0, 100))
    ru = "чтокакэтобылодлянеговсеониивсетолькоещеначалосьзатемснова"
    fit = [(i, (one, two, ru)[i % 3][i % 20 :], ("aa", "bb", "ru")[i % 3]) for i in range(90)]
    model = language.fit(spark.createDataFrame(fit, "doc_id long, text string, lang string"))
    rows = {r.doc_id: r for r in language.identify(make([one[:60] + two, two[:50] + ru, "1 " + one + " " + two[:100]]), model).collect()}
    assert [rows[i].lang_pred for i in range(3)] == ["bb", "ru", "aa"]
    assert [[s.lang for s in rows[i].spans] for i in range(3)] == [["aa", "bb"], ["bb", "ru"], ["aa", "bb"]]
    assert [(s.first, s.last) for i in (0, 2) for s in rows[i].spans] == [(0, 0), (0, 0), (0, 1), (2, 2)]
    assert [len(x) for x in language.pieces("漢" * 100)] == [33, 33, 34] and language.pieces("abcде中") == ["abc", "де", "中"]


def test_viterbi_shortcut_is_exact():
    rng = np.random.default_rng(3)
    labeller = language.Labeller({"langs": ["a", "b", "c"], "grams": {}, "floor": np.zeros(3, np.float32), "scripts": {}})
    sizes = rng.integers(1, 60, 200)
    at = np.concatenate([[0], np.cumsum(sizes)])
    scores = -rng.exponential(1.5, (at[-1], 3)).astype(np.float32)
    first = np.add.reduceat(scores, at[:-1], axis=0).argmax(axis=1)
    may = labeller._may_switch(scores, at, sizes, first)
    for i in np.flatnonzero(~may):
        assert set(labeller._paths([scores[at[i] : at[i + 1]]])[0].tolist()) == {first[i]}
    assert 0 < may.sum() < len(may)


def test_toxicity(spark, make):
    rng = np.random.default_rng(5)
    words = [f"plain{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choice(words, 30)) + (" idiot zzzworst stupid" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(make(["plain1 plain2 idiot zzzworst", "plain1 plain2", None, ""]), model).collect()}
    assert [got[i].predicted for i in range(4)] == [1, 0, 0, 0]
    none = toxicity.fit(docs.limit(0), labels)
    assert toxicity.Scorer(none).score(["an idiot", "a plant"])[0] > 0.3


def _written(docs):
    path = common.shared_path(docs.sparkSession, "tokens")
    token_files.write_tokens(docs, path, P.path("word_bpe_49k.json"), 2, blocks=3)
    return token_files.read_tokens(docs.sparkSession, path)


@pytest.mark.parametrize("run", [
    lambda d: substrings.remove_repeats(d), lambda d: jaccard.similar_classes(d, 4, 85), lambda d: fingerprints.compare_with_next(d), lambda d: media.features(media.store(d)),
    lambda d: mixing.plan(d), lambda d: licences.scan(d, licences.known_licences(d.sparkSession)), lambda d: language.identify(d, language.fit(d)),
    lambda d: byte_bpe.round_trip(d, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), lambda d: toxicity.score(d, toxicity.fit(d, d.selectExpr("doc_id", "1 AS toxic"))),
    lambda d: token_files.checksums(_written(d)),
])
@pytest.mark.parametrize("rows", [0, 3])
def test_empty_tables_and_null_ids(make, run, rows):
    assert run(make(["a b", None, "a b"][:rows], [None, None, 4][:rows])).count() == (rows if rows == 0 else run(make(["a b", None, "a b"], [None, None, 4])).count())


def test_blocks_of_ids_with_outliers_and_nulls(spark):
    """A few ids far from all others don't put the rest into one block; nulls are dealt by their text."""
    from pyspark.sql import functions as F

    ids = [*range(4000), 1 << 60, -(1 << 50)] + [None] * 2000
    docs = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string")
    rows = docs.withColumn("b", common.ordered_blocks(docs, "doc_id", 24, spread="text")).collect()
    known = sorted((r.doc_id, r.b) for r in rows if r.doc_id is not None)
    assert [b for _, b in known] == sorted(b for _, b in known) and min(b for _, b in known) >= 0
    sizes = [sum(r.b == b for r in rows) for b in {r.b for r in rows}]
    assert len(sizes) > 18 and max(sizes) < 500 and len({r.b for r in rows if r.doc_id is None}) > 4
    assert {r.b for r in docs.where("doc_id IS NULL").withColumn("b", common.ordered_blocks(docs.where("doc_id IS NULL"), "doc_id", 1)).collect()} == {-1}
    assert docs.limit(0).withColumn("b", common.ordered_blocks(docs.limit(0), "doc_id", 5, spread="text")).count() == 0
    assert F is not None


def test_nulls_take_and_lose_nothing(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(None, text), (None, text), (5, text), (6, text), (6, text)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in substrings.remove_repeats(docs).collect())
    assert got == [(0, 0), (0, 0), (5, 0), (6, 40), (6, 40)]


def test_label_model_finds_accuracies():
    """Voters fire far more in the class that they tell, in the order in which they do; doubtful labels are doubted; copies show."""
    rng = np.random.default_rng(11)
    truth = rng.random(4000) < 0.2
    rates = [(0.02, 0.6), (0.01, 0.5), (0.05, 0.4), (0.01, 0.3)]
    votes = np.stack([rng.random(4000) < np.where(truth, a, b) for b, a in rates], axis=1)
    votes = np.concatenate([votes, votes[:, :1]], axis=1)
    wrong = rng.random(4000) < 0.1
    known = np.where(rng.random(4000) < 0.7, truth ^ wrong, -1).astype(int)
    p, found, correlation, trust = toxicity.label_model(votes, known)
    assert (found[:, 1] > 10 * found[:, 0]).all() and found[0, 1] > found[3, 1] and correlation[0, 4] > 0.9 and abs(correlation[0, 1]) < 0.3
    assert ((p > 0.5) == truth).mean() > 0.85 and trust[1] < 0.95


def test_mixing_shares(spark):
    """Each block holds each source in its share; a target entropy gives the exponent that reaches it."""
    sizes = {"a": 6400, "b": 1600, "c": 400}
    docs = spark.createDataFrame([(i, s, "w " * 10) for s, n in sizes.items() for i in range(n // 10)], "doc_id long, source string, text string")
    rows = mixing.plan(docs, repetition_limit=2.0, block_tokens=1000).collect()
    times = {s: (6400 / n) ** (np.log(2) / np.log(16)) for s, n in sizes.items()}
    total = sum(times[s] * n for s, n in sizes.items())
    for b in {r.block for r in rows}:
        inside = [r for r in rows if r.block == b]
        for s, n in sizes.items():
            assert abs(sum(r.source == s for r in inside) / len(inside) - times[s] * n / total) < 0.05
    by_source = spark.createDataFrame([(n,) for n in sizes.values()], "tokens long")
    for target in (0.7, 1.0):
        a = mixing.entropy_exponent(by_source, target)
        w = np.array([n**a for n in sizes.values()])
        w /= w.sum()
        assert abs(-(w * np.log(w)).sum() - target) < 1e-6


def test_unfamiliar_scripts_are_not_believed(spark, make):
    fit = [(i, "the of and that with from this have been which", "en") for i in range(10)] + [(i + 10, "der die und das mit von dieser haben sein", "de") for i in range(10)]
    model = language.fit(spark.createDataFrame(fit, "doc_id long, text string, lang string"))
    rows = {r.doc_id: r.score for r in language.identify(make(["что как это было", "漢字仮名", "with this and that from which"]), model).collect()}
    assert rows[0] == rows[1] == 0 and rows[2] > 0.9


def test_row_groups_are_skipped(spark, make, tmp_path):
    """A look-up by id reads a fraction of the rows: statistics and Bloom filters pass the others over."""
    path = f"file://{tmp_path}/many"
    token_files.write_tokens(make([f"text {i}" for i in range(6000)]).select("doc_id", "text").coalesce(1), path, P.path("word_bpe_49k.json"), 2, blocks=1)
    found = token_files.lookup_tokens(spark, path, [10])
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan()
    found.collect()
    scans = [m for m in _metrics(found._jdf.queryExecution().executedPlan(), "numOutputRows")]
    assert plan is not None and min(scans) < 6000


def _metrics(plan, name):
    out, open_ = [], [plan]
    while open_:
        node = open_.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            open_.append(node.executedPlan())
            continue
        held = node.metrics().get(name)
        if held.isDefined() and node.children().isEmpty():
            out.append(held.get().value())
        for i in range(node.children().size()):
            open_.append(node.children().apply(i))
    return out
