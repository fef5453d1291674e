"""The llm operators: brute force, round trips, held-out accuracy and odd inputs."""

import hashlib
import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aptaflow.llm import _text, chat, decontaminate, embeddings, langid, ngram_join, packing, pii, queries, substring, toxicity, urls
from aptaflow.llm._components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# --- text hashes and components ------------------------------------------------------------------------------------------


def test_word_hashes():
    texts = ["The cat  the CAT", "", None, "a\nb c", " é\u00a0é x ", "x" * 50]
    h, first = _text.words(pa.array(texts))
    words = [w for t in texts for w in split(t)]
    assert len(h) == len(words) and np.diff(first).tolist() == [len(split(t)) for t in texts]
    assert len(set(zip(h.tolist(), words, strict=True))) == len(set(words)) == len(set(h.tolist()))


def test_word_hashes_over_windows(monkeypatch):
    rng = random.Random(2)
    texts = [prose(rng, rng.randrange(40)) for _ in range(50)] + ["y" * 500]
    whole = _text.words(pa.array(texts))
    monkeypatch.setattr(_text, "WINDOW", 64)
    small = _text.words(pa.array(texts))
    assert all((a == b).all() for a, b in zip(whole, small, strict=True))


def test_portions(monkeypatch):
    texts = pa.array(["abc", None, "", "x" * 50, "de fg", "h" * 9])
    assert list(_text.portions(texts, 10)) == [(0, 3), (3, 4), (4, 5), (5, 6)] and list(_text.portions(texts[:0])) == []
    whole = [x.tolist() for x in _text.shingle_sets(texts, 2)]
    monkeypatch.setattr(_text, "PORTION", 1)
    assert [x.tolist() for x in _text.shingle_sets(texts, 2)] == whole


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    group = {x: x for e in edges for x in e}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        group[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == root(x) for x in group)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- op 1 ----------------------------------------------------------------------------------------------------------------


def test_passages(spark):
    rng = random.Random(1)
    shared = [f"p{i}" for i in range(80)]
    changed = [f"q{i}" if i in (20, 45) else w for i, w in enumerate(shared)]
    rows = [(i, prose(rng, 100, 10**6)) for i in range(20)]
    rows += [(100, prose(rng, 30, 10**6) + " " + " ".join(shared) + " " + prose(rng, 30, 10**6)), (101, " ".join(changed)), (102, " ".join(shared[:30])), (103, None), (104, ""), (101, " ".join(changed)), (None, " ".join(shared))]
    out = substring.passages(spark.createDataFrame(rows, DOCS).withColumn("start", F.lit(1))).collect()
    assert {(r.doc_id, r.other_id, r.start, r.n_words, r.other_start, r.matches) for r in out} == {(101, 100, 0, 80, 30, 78)}
    assert substring.passages(spark.createDataFrame([], DOCS)).count() == 0


def test_chains():
    assert substring.chains([(0, 0, 10), (12, 12, 10), (5, 40, 3)]) == [[(0, 0, 10), (12, 12, 10)], [(5, 40, 3)]]
    assert substring._gap([1, 2, 3], [1, 3]) == (2, 1)


def test_every_repeated_window_is_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    rows = {r.doc_id: split(r.text) for r in docs.collect()}
    seen = {}
    for i, w in rows.items():
        for k in range(len(w) - 59):
            if len(set(w[k : k + 60])) > 30:
                seen.setdefault(tuple(w[k : k + 60]), set()).add(i)
    want = set().union(*[v for v in seen.values() if len(v) > 1])
    got = {x for r in substring.passages(docs).collect() for x in (r.doc_id, r.other_id)}
    assert want <= got


# --- op 2 ----------------------------------------------------------------------------------------------------------------


def shingles(text, k):
    w = split(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize(("k", "t"), [(3, Fraction(9, 10)), (5, Fraction(4, 5)), (1, Fraction(9, 10))])
def test_join_against_brute_force(spark, k, t):
    rng = random.Random(k)
    rows, n = [], 0
    for _ in range(12):
        base = prose(rng, rng.choice([3, 12, 60, 250])).split()
        for _ in range(rng.randrange(1, 12)):
            now = [f"z{rng.randrange(99)}" if rng.random() < rng.choice([0, 0.01, 0.03, 0.06]) else w for w in base]
            rows.append((n, " ".join(now)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one"), (n + 4, "ONE"), (n + 4, "ONE"), (None, "one")]
    sets = {i: shingles(x, k) for i, x in rows if i is not None}
    group = {i: i for i in sets}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and both * t.denominator >= (len(sets[i]) + len(sets[j]) - both) * t.numerator:
                a, b = root(i), root(j)
                group[max(a, b)] = min(a, b)
    out = ngram_join.join(spark.createDataFrame(rows, DOCS).withColumn("n", F.lit(1)), k, t).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is None:
            assert r.component_id == n + 3
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), root(r.doc_id))


def test_tiles_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 7)
    test_join_against_brute_force(spark, 3, Fraction(9, 10))


def test_join_of_nothing(spark):
    assert ngram_join.join(spark.createDataFrame([], DOCS)).count() == 0


# --- op 3 ----------------------------------------------------------------------------------------------------------------


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 40)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 24))
    x = np.concatenate([b + s * rng.normal(size=(6, 24)) for b, s in zip(base, np.linspace(0.05, 0.8, 30), strict=True)]).astype(np.float32)
    x[7] = x[8] = x[9]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 24), (902, [float("nan")] + [1.0] * 23), (903, [None] + [1.0] * 23), (904, []), (905, [1.0, 2.0]), (906, [1.0, 2.0])]
    y = x.astype(np.float64)
    y /= np.sqrt((y * y).sum(axis=1))[:, None]
    near = y @ y.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while (new := np.minimum(label, np.where(near, label[None], 10**6).min(axis=1))).tolist() != label.tolist():
        label = new
    out = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")).collect()}
    assert len(out) == len(rows) + len(odd)
    for i in range(len(x)):
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (near[i].sum(), label[i], label[i] == i)
    assert all((out[i].n_links, out[i].component_id) == (0, i) for i in range(900, 905))
    assert (out[906].n_links, out[906].component_id) == (1, 905)
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_error_bounds_hold():
    rng = np.random.default_rng(5)
    x = embeddings._unit(rng.normal(size=(200, 100)) * rng.exponential(size=100))
    q, scale, rest = embeddings.quantised(x)
    near = (q.astype(np.int64) @ q.T.astype(np.int64)) * scale[:, None] * scale
    assert (np.abs(near - x @ x.T) <= rest[:, None] + (1 + rest)[:, None] * rest).all()


# --- op 4, op 10 ---------------------------------------------------------------------------------------------------------


def test_language(spark):
    out = langid.op4(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out)
    model = langid.fit(spark.createDataFrame([(1, "the cat", "en"), (2, "le chat", "fr"), (3, "x", None), (4, None, "en")], "doc_id long, text string, lang string"))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 ++"), (4, "the cats"), (5, "Ω"), (4, "the cats")], DOCS).withColumn("lang_score", F.lit("x"))
    got = sorted((r.doc_id, r.lang_pred, round(r.lang_score, 3)) for r in langid.predict(odd, model).collect())
    assert got[:3] == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)] and got[3][1] == "en" and got[3] == got[4] and got[5][1] == "en"
    none = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert langid.predict(odd, none).filter("lang_pred <> 'und'").count() == 0


def test_toxicity(spark):
    d = "/root/testdata/sf0.1"
    out = toxicity.op10(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    clean = [r for r in out if not r.toxic]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert sum(r.predicted for r in out if r.toxic) >= 0.5 * sum(r.toxic for r in out)
    assert all(0 <= r.score <= 1 for r in out)


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({"idiot": 5.0, "trash": 4.0}, {"trash can"}, (-3.0, 2.0))
    for text in ("an idiot", "IDI0T!", "іԁіоt", "1d1ot$$$", "ïdïöt"):
        assert lexicon.total(text) == 5.0, text
    assert lexicon.total("idiotic") == lexicon.total("") == 0.0
    assert lexicon.total("the trash can") == 0.0 and lexicon.total("trash, can") == 4.0
    assert lexicon.score("") < 0.5 < lexicon.score("idiot " * 3)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], DOCS)
    lexicon = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.score(docs, lexicon).collect()][0] <= 0.5


# --- op 5 ----------------------------------------------------------------------------------------------------------------


def test_templates(spark):
    items = spark.createDataFrame([(1, "Yesterday Tom Miller bought 12 apples for 3 kg of sugar. Then Tom Miller gave 5 apples to Anna and kept the other ones."), (2, "a b c d e f"), (3, None), (4, "x y")], "item_id long, text string")
    told = "so it was: Yesterday Bob Smith bought 40 apples for 9 kg of sugar. Then Bob Smith gave 7 apples to Cleo and kept the other ones. bye"
    docs = [(1, told), (2, told.replace("Then Bob Smith", "Then Ed Jones")), (3, None), (4, ""), (5, "z a b c d e f z"), (6, "1 2 3 4 5 6 7 8 9 10 11 12"), (5, "z a b c d e f z")]
    out = {(r.doc_id, r.item_id): r for r in decontaminate.find(spark.createDataFrame(docs, DOCS), items).collect()}
    assert set(out) == {(1, 1), (2, 1), (5, 2)}
    assert not out[1, 1].exact and out[5, 2].exact and out[5, 2].share == 1.0 and out[2, 1].share < out[1, 1].share
    assert decontaminate.find(spark.createDataFrame(docs, DOCS), items.limit(0)).count() == 0
    assert decontaminate.find(spark.createDataFrame([], DOCS), items).count() == 0


def test_plain_leaks_are_found(spark):
    d = "/root/testdata/sf0.01"
    items = {r.item_id: split(r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    docs = {r.doc_id: " ".join(split(r.text)) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    want = {(i, k) for i, t in docs.items() for k, w in items.items() if len(w) >= 12 and f" {' '.join(w[1:])} " in f" {t} "}
    got = {(r.doc_id, r.item_id) for r in decontaminate.op5(spark, d).collect()}
    assert want and want <= got


# --- op 6 ----------------------------------------------------------------------------------------------------------------


def test_surrogates(spark):
    text = "Mail a.Bc9@mail4.example.com or A.BC9@mail4.example.com, call +1 (017) 555-7713 or +1-017-555-7713. Card 4111 1111 1111 1111, 9807915762804490é ip 10.0.0.1. Dr. Mary Smith met John Doe and Mary Smith; Анна Петрова. v1.2.3.4.5"
    docs = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "", "z"), (4, "nothing", "q"), (4, "nothing", "q"), (5, 'k = "' + "ab12" * 10 + '"', "r")], "doc_id long, text string, new string")
    out = pii.replace(docs, key="k", count="n").collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 6 and by[2].text is None and by[3].text == "" and by[4].text == "nothing" and by[5].new == "r"
    new = by[1].text
    for gone in ("a.Bc9", "555-7713", "4111", "9807915762804490", "10.0.0.1", "Smith", "Doe", "Петрова"):
        assert gone not in new
    mails = re.findall(r"\S+@\S+?(?=[ ,])", new)
    assert mails[0].lower() == mails[1].lower()
    phones = [re.sub(r"\D", "", x) for x in re.findall(r"\+1[ -][^ ]* ?\d{3}-\d{4}|\+1-[\d-]+", new)]
    assert len(set(phones)) == 1
    card = re.search(r"Card ([\d ]{19})", new)[1].replace(" ", "")
    assert sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(card)) % 10 == 0
    women = re.findall(r"Dr\. (\w+ \w+)|and (\w+ \w+);", new)
    assert women[0][0] == women[1][1] and women[0][0].split()[0] in pii.LATIN_FEMALE
    assert re.search(r"; (\w+) ", new)[1] in pii.CYRILLIC_FEMALE and "v1.2.3.4.5" in new
    assert len(by[5].text) == len('k = "' + "ab12" * 10 + '"') and pii.replace(docs, key="k").columns == docs.columns
    assert pii.replace(docs.limit(0), key="k").count() == 0


# --- op 7 ----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_encoder_equals_the_tokenizer(tokenizer):
    encoder = packing.Encoder(tokenizer[0])
    for x in ["a<|endoftext|>b c", "  x\n\ny é é ́q", "İ'S don't   z\x1cq　k", "", "\n", "The end. THE, end.. 5. é, &&&,", "ﬁ Σας ΣΑΣ ẛ̣ 한국 ᄒ ᅡ"] * 2:
        assert encoder.ids(x).tolist() == tokenizer[1].encode(x, add_special_tokens=False).ids


def test_packing(spark, tokenizer):
    docs = spark.createDataFrame([(1, None), (2, "a b c"), (3, "word " * 9000), (4, ""), (2, "a b c")], DOCS)
    out = sorted(packing.packed(docs).collect(), key=lambda r: (r.sequence_id, r.offset))
    assert sum(r.length for r in out) == 1 + 4 + 9001 + 1 + 4
    for a, b in zip([None, *out], out, strict=False):
        assert b.offset == (a.offset + a.length if a and a.sequence_id == b.sequence_id else 0) and b.offset + b.length <= 4096
    assert len({r.sequence_id for r in out}) == 3
    assert packing.packed(docs.limit(0)).count() == 0


def test_plan_is_near_the_bound():
    rng = random.Random(7)
    histogram = {}
    for _ in range(5000):
        n = min(4096, int(rng.lognormvariate(6, 1)) + 1)
        histogram[n] = histogram.get(n, 0) + 1
    planned = packing.plan(histogram)
    held = {}
    for config, times in planned:
        assert sum(x * k for x, k in config.items()) <= 4096
        for x, k in config.items():
            held[x] = held.get(x, 0) + k * times
    assert held == histogram
    assert sum(t for _, t in planned) <= 1.01 * sum(x * n for x, n in histogram.items()) / 4096 + 1
    assert packing.plan({}) == []


# --- op 8 ----------------------------------------------------------------------------------------------------------------


def test_url_rules(spark):
    rows = [(1, "http://A.com/en/x?q"), (2, "https://www.example.com/en/77"), (3, "http://xexample.com/en/7"), (4, "http://b.example.net/de/8#x"), (5, "ftp://q.net/de/8"), (6, None), (7, "no url"), (8, "http://org/es/"), (9, "://com/en/"), (10, "http://com?x/en/"), (11, "x://a.net/de/é\nz"), (1, "http://A.com/en/x?q")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("old"))
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, urls.rules_frame(spark, urls.RULES)).collect()}
    assert out == {
        1: ("a.com", "/en/x", "com/en/", "block"), 2: ("www.example.com", "/en/77", "example.com/en/7", "allow"), 3: ("xexample.com", "/en/7", "com/en/", "block"),
        4: ("b.example.net", "/de/8", "example.net/de/8", "block"), 5: ("q.net", "/de/8", "net/de/", "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("org", "/es/", "org/es/", "block"), 9: ("com", "/en/", "com/en/", "block"), 10: ("com", "", None, "allow"), 11: ("a.net", "/de/é\nz", "net/de/", "allow"),
    }
    assert urls.judge(df, urls.rules_frame(spark, [])).filter("rule is not null").count() == 0
    assert urls.judge(df.limit(0), urls.rules_frame(spark, urls.RULES)).count() == 0


def test_url_rules_against_brute_force(spark):
    rng = random.Random(9)
    name = lambda: ".".join(rng.choice("ab") for _ in range(rng.randint(1, 4)))
    path = lambda: "".join(rng.choice("/xy") for _ in range(rng.randint(0, 5)))
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in ((name(), path()) for _ in range(40))}.values())
    pages = [(i, f"http://{name()}/{path()}") for i in range(300)]
    out = {r.page_id: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), urls.rules_frame(spark, rules)).collect()}
    for r in out.values():
        fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        assert (r.rule, r.verdict) == (max(fits)[2:] if fits else (None, "allow"))


# --- op 9 ----------------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|turn|>user\nx<|end|>", "&lt;&amp;&#91;&#10;", "", "a\n\nb<|", None, "é🙂"]
    rows = [(c, i, "user" if i % 2 == 0 else "assistant", t) for c, ts in enumerate([nasty, nasty[::-1], nasty[:1]]) for i, t in enumerate(ts)] + [(9, 0, "odd\nrole<", "x"), (9, 0, "odd\nrole<", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(3))
    made = chat.render(chat.fold(chat.as_events(df)))
    assert sorted(made.drop("mask").collect()) == sorted(chat.render(chat.fold(chat.as_log(df))).drop("mask").collect())
    for r in made.collect():  # spans of the mask as places in the whole text
        at = [m.start() + len(chat.TURN) for m in re.finditer(re.escape(chat.TURN), r.formatted)]
        texts = [r.formatted[at[m.turn] + m.start : at[m.turn] + m.start + m.length] for m in r["mask"]]
        assert all(r.formatted[at[m.turn] + m.start + m.length :].startswith(chat.END) for m in r["mask"]) and not any(chat.TURN in x or chat.END in x for x in texts)
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in made.select("conv_id", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    want = {c: [(r, t or "") for d, _, r, t in sorted(rows, key=lambda x: x[1]) if d == c] for c in {x[0] for x in rows}}
    assert back == want
    for r in chat.digest(made).collect():
        loss = "".join(t for role, t in want[r.conv_id] if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(want[r.conv_id]), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want[r.conv_id]).encode()).hexdigest()
    assert chat.render(chat.fold(chat.as_events(df.limit(0)))).count() == 0


def test_chat_events(spark):
    log = [
        (1, 1, "message", 1, "user", "Hi"), (1, 2, "message", 2, "assistant", ""), (1, 3, "delta", 2, None, "Hel"), (1, 5, "delta", 2, None, "lo"), (1, 4, "delta", 2, None, "l"),
        (1, 6, "edit", 1, None, "Hi!"), (1, 7, "regenerate", 2, None, None), (1, 8, "delta", 2, None, "Hey"), (1, 9, "message", 3, "user", "bye"), (1, 10, "delete", 3, None, None), (1, 11, None, 4, "user", "x"),
    ]
    out = chat.fold(spark.createDataFrame(log, "conv_id long, seq long, kind string, target long, role string, text string")).orderBy("place").collect()
    assert [(r.role, r.text) for r in out] == [("user", "Hi!"), ("assistant", "Hey")]


# --- the pipeline and the queries ----------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).collect()
    kept = {r.doc_id for r in out}
    near = ngram_join.join(docs)
    leaks = {r.doc_id for r in decontaminate.find(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    lone = {r.doc_id for r in near.filter("doc_id = component_id").collect()}
    assert kept == lone - leaks
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_native_queries_run_no_python(spark):
    for name in ("op5_benchmark_decontamination", "op6_pii_surrogates", "op8_url_rules", "op9_chat_format"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name
