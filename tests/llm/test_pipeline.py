"""Stages of the pipeline against brute force, each fed with what the stage before gave."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402


def _shingles(text, n=5):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def test_stages(spark, make):
    rng = np.random.default_rng(3)
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    base = rng.choice(words, 120).tolist()
    texts = [" ".join(["zzz"] * k + base[k:]) for k in (0, 3, 6, 9)] + [" ".join(rng.choice(words, 80).tolist() + base[20:50]) for _ in range(3)]
    texts += [" ".join(rng.choice(words, 60)) for _ in range(6)] + [texts[0], "123 ...", "", None]
    docs = make(texts).select("doc_id", "text", "lang", "source", "n_chars")
    stages = dict(corpus_pipeline.STAGES)

    known = stages["language"](spark, docs, "").localCheckpoint()
    assert sorted(r.doc_id for r in known.collect()) == [i for i, t in enumerate(texts) if any(c.isalpha() for c in t or "")]

    rows = sorted(r.doc_id for r in known.collect())
    sets, root = {i: _shingles(texts[i]) for i in rows}, {i: i for i in rows}
    for i in rows:
        for j in rows:
            if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    single = stages["near_duplicates"](spark, known, "").localCheckpoint()
    kept = sorted(r.doc_id for r in single.collect())
    assert kept == [i for i in rows if root[i] == i] and len(kept) < len(rows)

    first: dict = {}
    for i in kept:
        w = texts[i].split()
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    left = {}
    for i in kept:
        w, dead = texts[i].split(), set()
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                dead |= set(range(j, j + 13))
        if len(dead) < len(w):
            left[i] = " ".join(x for j, x in enumerate(w) if j not in dead)
    cut = stages["substrings"](spark, single, "").localCheckpoint()
    assert {r.doc_id: r.text for r in cut.collect()} == left and any(left[i] != texts[i] for i in left)

    mixed = stages["mixing"](spark, cut, "").localCheckpoint()
    assert {r.doc_id: r.text for r in mixed.collect()} == left

    import public_tokenizers
    import tiktoken

    from vellum.llm import byte_bpe

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in stages["token_ids"](spark, mixed, "").collect()]
    assert sorted(got) == sorted((r.doc_id, own.encode_ordinary(r.text)) for r in mixed.collect())


def test_clashing_columns_repeated_rows_and_nulls(spark):
    """Further columns keep their values under names that operators use; of identical rows one stays."""
    text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [(1, text), (1, text), (1, text), (2, None), (3, ""), (None, "some other words of a text"), (None, "some other words of a text"), (4, "other words of a short text")]
    docs = spark.createDataFrame([(i, t, "en", None if k % 2 else "s", len(t or ""), float(k), k, f"i{k}", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, score double, n_words long, i string, block int")
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language"](spark, docs, "")
    assert known.columns == docs.columns
    assert sorted((r.doc_id or 0, r.score, r.n_words, r.i, r.block) for r in known.collect()) == sorted((i or 0, float(k), k, f"i{k}", k) for k, (i, t) in enumerate(rows) if t)
    single = stages["near_duplicates"](spark, docs, "")
    assert single.columns == docs.columns
    assert sorted((r.doc_id or 0 for r in single.collect())) == [0, 0, 1, 2, 3, 4]
    cut = stages["substrings"](spark, docs, "")
    assert sorted(map(str, cut.collect())) == sorted(map(str, docs.collect()))
    mixed = stages["mixing"](spark, docs, "")
    assert mixed.columns == docs.columns and {r.i for r in mixed.collect()} == {f"i{k}" for k in range(len(rows))}
    assert sorted(r.doc_id or 0 for r in stages["token_ids"](spark, docs, "").collect()) == [0, 0, 1, 1, 1, 2, 3, 4]
    for stage in stages.values():
        assert stage(spark, docs.limit(0), "").count() == 0
