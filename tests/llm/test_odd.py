"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for operators and stages."""

import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from aptaflow.llm import decontaminate, embeddings, langid, ngram_join, packing, pii, toxicity

DOCS = "doc_id long, text string"
LONG = "lorem ipsum dolor " * 70_000


def prose(rng, n, vocabulary=10**6):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def more(df, *names):
    return df.withColumns({x: F.lit("z") for x in names})


def test_join(spark):
    rows = [(1, LONG), (2, LONG + "x"), (2, LONG + "x"), (3, None), (4, ""), (5, "a b"), (None, "a b"), (6, "A  b"), (-9, "c")]
    docs = more(spark.createDataFrame(rows, DOCS), "n", "class", "check", "bucket", "keys", "block", "component", "first", "part", "stray")
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(docs, 3, Fraction(9, 10)).collect()), key=str)
    assert out == sorted([(1, 3, 1), (2, 4, 2), (2, 4, 2), (3, 0, 3), (4, 0, 4), (5, 1, 5), (None, 1, 5), (6, 1, 5), (-9, 1, -9)], key=str)


def test_join_meets_the_threshold_exactly(spark):
    words = [f"w{i}" for i in range(100)]
    nine, less = words[:90], words[:89]  # of one-word shingles 90 and 89 of 100
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(nine)), (3, "x " + prose(random.Random(1), 99)), (4, " ".join(less))], DOCS)
    out = {r.doc_id: r.component_id for r in ngram_join.join(docs, 1, Fraction(9, 10)).collect()}
    assert out == {1: 1, 2: 1, 3: 3, 4: 1}  # 89 of 90
    out = {r.doc_id: r.component_id for r in ngram_join.join(docs.filter("doc_id <> 2"), 1, Fraction(9, 10)).collect()}
    assert out == {1: 1, 3: 3, 4: 4}


def test_strays_of_large_blocks(spark, monkeypatch):
    """A chain of small changes through many tiles, beside a large group of near copies."""
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 5)
    rng = random.Random(2)
    base = prose(rng, 60).split()
    rows, now = [], list(base)
    for i in range(40):  # each a step from the one before
        now[rng.randrange(60)] = f"y{i}"
        rows.append((i, " ".join(now)))
    for i in range(40, 110):  # all close to the first
        w = list(base)
        w[i % 60] = f"z{i}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(58)} for i, t in rows}
    label = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                both = len(sets[i] & sets[j])
                if 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                    label[i] = label[j] = min(label[i], label[j])
    out = {r.doc_id: r.component_id for r in ngram_join.join(spark.createDataFrame(rows, DOCS), 3, Fraction(4, 5)).collect()}
    assert out == label


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.9, float(np.sqrt(1 - 0.81))]), (4, [1e-300, 0.0]), (4, [1e-300, 0.0]), (5, [1e300, 0.0]), (None, [1.0, 0.0]), (6, [0.0, float("inf")]), (7, [-1.0, 0.0])]
    df = more(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "label", "id", "exact", "tile", "block", "weight", "dim", "wide", "pivot")
    out = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()), key=str)
    with_ids = {i: [x for x in out if x[0] == i] for i in (1, 2, 4, 5, 6, 7)}
    assert all(x[2] == 1 for i in (1, 2, 4, 5) for x in with_ids[i]) and with_ids[6] == [(6, 0, 6, True)] and with_ids[7] == [(7, 0, 7, True)]
    assert len(out) == len(rows) and with_ids[1][0][3] and not with_ids[2][0][3]
    assert {x for x in out if x[0] is None} == {(None, 0, None, False)}


def test_blocks_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 16)
    monkeypatch.setattr(embeddings, "BLOCK_BYTES", 16 * 8 * 4 * 3)
    rng = np.random.default_rng(4)
    x = np.concatenate([c + 0.3 * rng.normal(size=(20, 8)) for c in rng.normal(size=(25, 8))]).astype(np.float32)
    y = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(axis=1))[:, None]
    near = (y @ y.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    for centres in (embeddings.CENTRES_BYTES, 0):
        monkeypatch.setattr(embeddings, "CENTRES_BYTES", centres)
        out = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()}
        assert [out[i] for i in range(len(x))] == near.sum(axis=1).tolist()


def test_languages(spark):
    model = langid.Model({"en": {"the": 9, "cat": 3}, "fr": {"le": 9, "chat": 3}})
    rows = [(1, "²  ½"), (2, "Ⅷ ①"), (3, None), (4, ""), (5, "x² the"), (6, "the " * 300_000), (7, "le le the the"), (7, "le le the the"), (None, "le chat"), (8, "١٢٣ ___ 12")]
    docs = more(spark.createDataFrame(rows, DOCS), "lang", "k", "t", "l", "score", "lang_pred", "_lang", "_score")
    out = sorted(((r.doc_id, r.lang_pred, r.lang_score == 0.0) for r in langid.predict(docs, model).collect()), key=str)
    assert out == sorted([(1, "und", True), (2, "und", True), (3, "und", True), (4, "und", True), (5, "en", False), (6, "en", False), (7, "en", False), (7, "en", False), (None, "fr", False), (8, "und", True)], key=str)
    kept = langid.keep(docs, model)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [5, 6, None] and kept.first()._lang == "z"
    assert [r.doc_id for r in langid.keep(docs, model, languages=("fr",)).collect()] == [None]
    assert langid.keep(docs, model, least=0.9999).count() < 5
    assert langid.words_of("Straße x²y don't Ⅷ") == ["straße", "x", "y", "don", "t"]


def test_scores_against_plain_python(spark):
    """The prediction from the definitions: words first, then n-grams from long to short."""
    train = [("en", "the cat sat on the mat"), ("de", "die katze sass auf der matte"), ("fr", "le chat sur la table")]
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(train * 3)], "doc_id long, text string, lang string")
    model = langid.fit(docs, support=2)
    langs = sorted({x for x, _ in train})
    words = {x: defaultdict(int) for x in langs}
    for x, t in train * 3:
        for w in t.split():
            words[x][w] += 1

    def table(counts):
        keys = sorted({k for c in counts.values() for k in c})
        total = {x: sum(counts[x].values()) + 0.5 * len(keys) for x in langs}
        return {k: np.array([np.log((counts[x].get(k, 0) + 0.5) / total[x]) for x in langs]) for k in keys}

    cut = lambda w, n: [m[i : i + n] for m in [f"^{w}$" if n > 1 else w] for i in range(len(m) - n + 1)]
    tables = {0: table(words)}
    for n in range(1, 6):
        grams = {x: defaultdict(int) for x in langs}
        for x in langs:
            for w, c in words[x].items():
                for g in cut(w, n):
                    grams[x][g] += c
        tables[n] = table(grams)

    def score(w):
        if w in tables[0]:
            return tables[0][w]
        for n in range(5, 0, -1):
            if known := [tables[n][g] for g in cut(w, n) if g in tables[n]]:
                return np.mean(known, axis=0)
        return np.zeros(len(langs))

    tests = ["the dog", "katzen", "chats et tables", "sass", "qqq", "mat matte", "xyz the der"]
    got = {r.text: r for r in langid.predict(spark.createDataFrame(enumerate(tests), DOCS), model).collect()}
    for t in tests:
        mean = np.mean([score(w) for w in t.split()], axis=0)
        z = np.exp((mean - mean.max()) * min(len(t.split()), langid.EVIDENCE))
        assert got[t].lang_pred == langs[int(mean.argmax())] and got[t].lang_score == pytest.approx(z.max() / z.sum(), abs=1e-4), t


def test_toxicity(spark):
    lexicon = toxicity.Lexicon({"idiot": 5.0, "trash": 4.0}, {"trash can", "idiot box"}, (-3.0, 1.0))
    rows = [(1, None), (2, ""), (3, "idiot trash can " * 50_000), (4, "an 1d1ot"), (4, "an 1d1ot"), (None, "idiot"), (5, "trash can idiot box")]
    docs = more(spark.createDataFrame(rows, DOCS), "score", "toxic", "word", "end")
    out = toxicity.score(docs, lexicon)
    assert set(out.columns) == set(docs.columns)
    got = sorted((str(r.doc_id), round(r.score, 6)) for r in out.collect())
    plain = round(lexicon.score(""), 6)
    assert [x for x in got if x[0] in "125"] == [("1", plain), ("2", plain), ("5", plain)]
    assert got.count(("4", round(lexicon.score("an idiot"), 6))) == 2 and dict(got)["3"] > 0.99
    assert toxicity.score(docs.limit(0), lexicon).count() == 0


def test_matches_against_plain_python():
    """Sums of weights by looking at every place of every word and exception."""
    rng = random.Random(12)
    weights, exceptions = {"ab": 1.0, "ba": 2.0, "abba": 4.0}, {"ab ba", "x abba", "ba ba ba"}
    lexicon = toxicity.Lexicon(weights, exceptions)
    for _ in range(300):
        text = " ".join(rng.choice(["ab", "ba", "abba", "x", "a", "ab!", "(ba"]) for _ in range(rng.randint(0, 9)))
        free = lambda s, e: not (s and text[s - 1].isalnum()) and not (e < len(text) and text[e].isalnum())  # noqa: E731, B023
        at = lambda w: [i for i in range(len(text)) if text.startswith(w, i) and free(i, i + len(w))]  # noqa: E731, B023
        void = [(i, i + len(p)) for p in exceptions for i in at(p)]
        assert lexicon.total(text) == sum(w for x, w in weights.items() for i in at(x) if not any(a <= i and i + len(x) <= b for a, b in void)), text


def test_learned_lexicon(spark):
    rng = random.Random(13)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [f"w{rng.randrange(50)}" for _ in range(20)] + (["vile", f"c{i}"] if bad else []) + (["vile", "smell"] if i % 4 == 1 else [])
        rows.append((i, " ".join(words)))
        labels += [(i, int(bad)), (i, 0), (i, None)]
    rows += [(0, rows[0][1]), (900, None), (None, "vile")]
    lexicon = toxicity.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels + [(None, 1), (900, 1)], "doc_id long, toxic int"), support=4)
    assert lexicon.score(rows[0][1]) > lexicon.score("w1 w2") and lexicon.total("w1 w2 w3") == 0.0


def test_packing(spark):
    rows = [(1, None), (2, ""), (3, "word " * 30_000), (3, "word " * 30_000), (None, "a b"), (4, "é " * 5000)]
    docs = more(spark.createDataFrame(rows, DOCS), "piece", "start", "length", "offset", "sequence_id", "_salt", "_rank", "n")
    out = packing.packed(docs, cache=100).select(*packing.COLUMNS).collect()
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert sum(r.length for r in out if r.doc_id == 3) == 2 * 30_001 and sum(r.length for r in out if r.doc_id in (1, 2)) == 2
    pieces = sorted((r.piece, r.start, r.length) for r in out if r.doc_id == 4)
    assert [s for _, s, _ in pieces] == [i * packing.CAPACITY for i in range(len(pieces))] and all(n == packing.CAPACITY for _, _, n in pieces[:-1])
    assert packing.packed(docs.limit(0)).count() == 0


def test_few_sequences_against_the_best():
    """Against every way to pack small histograms."""
    rng = random.Random(14)

    def best(pieces, room):
        pieces = sorted(pieces, reverse=True)
        least = [len(pieces)]

        def put(i, bins):
            if len(bins) >= least[0]:
                return
            if i == len(pieces):
                least[0] = len(bins)
                return
            for free in sorted(set(bins)):
                if free >= pieces[i]:
                    j = bins.index(free)
                    put(i + 1, bins[:j] + [free - pieces[i]] + bins[j + 1 :])
            put(i + 1, [*bins, room - pieces[i]])

        put(0, [])
        return least[0]

    for _ in range(40):
        pieces = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        histogram = {x: pieces.count(x) for x in set(pieces)}
        planned = packing.plan(histogram, 20)
        assert sum(n for _, n in planned) <= best(pieces, 20) + 1


@pytest.mark.parametrize("stage", [langid.stage, ngram_join.stage, decontaminate.stage, pii.stage])
def test_stages(spark, stage, tmp_path):
    """A table with nulls, repeated rows and odd columns goes through each stage, as does an empty one."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(None, None, None, None, None), (None, "der the la", None, "s", 3), (70001, "", "en", None, 0), (70002, None, "en", "s", None), (70003, "the of and in", "en", "s", 13), (70003, "the of and in", "en", "s", 13), (70004, LONG, "en", "s", len(LONG))]
    every = more(docs.unionByName(spark.createDataFrame(odd, docs.schema)), "score", "found", "item_id", "component_id", "kind", "share", "n", "value")
    out = stage(spark, every, sf)
    assert out.columns == every.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    rows = out.collect()
    assert docs.count() * 0.5 < len(rows) <= docs.count() + len(odd)
    assert sum(r.doc_id == 70003 for r in rows) == 2 and all(r.score == "z" for r in rows)
    assert stage(spark, every.limit(0), sf).count() == 0
