"""Decontamination against a plain Python version, re-parameterised items, short items and odd rows."""

from collections import Counter, defaultdict

import regex
from pyspark.sql import functions as F

from aptaflow.llm import decontaminate as D

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
SF = "/root/testdata/sf0.01"


def words_of(text):
    return [w for w in regex.split(r"[\x20\x09-\x0D]+", text or "") if w]


def core(w):
    return regex.sub(r"^[^\p{L}\p{N}$€£%+-]+|[^\p{L}\p{N}$€£%]+$", "", w)


def kind(words, i, before):
    w, c = words[i], core(words[i])
    if c.lower() in D.NUMBER_WORDS or regex.search(D._NUMBER, c):
        return D.NUMBER
    if regex.search(r"^[0-9][0-9.,]*[\p{L}%°]{1,4}$", c):
        return D.QUANTITY
    if before is not None and (regex.search(r"^[^\p{L}\p{N}]*[0-9][0-9.,:/]*$", before) or before.lower() in D.NUMBER_WORDS) and c.lower() in D.UNITS:
        return D.UNIT
    if before is not None and regex.search(r"^\p{Lu}\p{Ll}+$", c) and regex.search(r"[^.!?:;|]$", before):
        return D.NAME
    return w if c == "" else c.lower()


def shape(words):
    return [kind(words, i, words[i - 1] if i else None) for i in range(len(words))]


def bare(w):
    return regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}%]+$", "", w)


def plain(docs, items):
    """{(doc, item): (n_windows, n_words, share, exact)} by comparing every window with every window."""
    out = {}
    table = defaultdict(list)
    whole = {}
    for item, text in items:
        w = words_of(text)
        if not w or item is None:
            continue
        size, s = min(len(w), D.WINDOW), shape(w)
        rows = []
        for at in range(len(w) - size + 1):
            part = s[at : at + size]
            if size >= D.LITERALS and sum(not x.startswith("\x01") for x in part) >= min(D.LITERALS, size):
                rows.append((at, tuple(part)))
                if at == 0:
                    first = core(w[0])
                    more = [D.NAME] * bool(regex.search(r"^\p{Lu}\p{Ll}+$", first)) + [D.UNIT] * (first.lower() in D.UNITS)
                    if part[0] == first.lower():
                        rows += [(0, (x, *part[1:])) for x in more if sum(not y.startswith("\x01") for y in part) >= min(D.LITERALS, size)]
        for at, part in rows:
            table[size, part].append((item, w, at, part[0] != s[at]))
        if not rows:
            own = tuple(core(x).lower() or x for x in w)
            if size < D.LITERALS:
                whole.setdefault(own, []).append((item, w))
            else:
                for at in range(len(w) - size + 1):
                    table[size, ("plain", *own[at : at + size])].append((item, w, at, False))
    for doc, text in docs:
        w = words_of(text)
        if doc is None or not w:
            continue
        s, own = shape(w), tuple(core(x).lower() or x for x in w)
        lines = defaultdict(set)
        for size in {k[0] for k in table}:
            for at in range(len(w) - size + 1):
                for key, slots in ((tuple(s[at : at + size]), True), (("plain", *own[at : at + size]), False)):
                    for item, iw, i, other in table.get((size, key), ()):
                        if other and core(iw[0]).lower() != core(w[at]).lower():
                            continue
                        z = tuple((i + j, key[j], bare(iw[i + j]), bare(w[at + j])) for j in range(size) if slots and key[j].startswith("\x01"))
                        lines[item, at - i, len(iw)].add((i, size, z))
        for item, iw in whole.get(own, ()):
            lines[item, 0, len(iw)].add((0, len(iw), ()))
        by_item = defaultdict(lambda: [set(), set(), 0, True, 0])
        for (item, _, n), windows in lines.items():
            votes = Counter((k, a, b) for _, k, a, b in {x for _, _, z in windows for x in z})
            best = {}
            for (k, a, b), m in votes.items():
                best[k, a] = max(best.get((k, a), (0, "")), (m, b))
            good = [x for x in windows if all(best[k, a][1] == b for _, k, a, b in x[2])]
            if good:
                covered = {p for i, size, _ in good for p in range(i, i + size)}
                e = by_item[item]
                e[0] |= {i for i, _, _ in good}
                e[1] |= covered
                e[2], e[4] = max(e[2], len(covered)), n
                e[3] &= all(a == b for _, _, z in good for _, _, a, b in z)
        for item, (at, covered, longest, exact, n) in by_item.items():
            if len(covered) / n >= D.SHARE or longest >= D.RUN:
                out[doc, item] = (len(at), len(covered), round(min(1.0, len(covered) / n), 9), exact)
    return out


def found(docs, items):
    rows = D.find(docs, items).collect()
    got = {(r.doc_id, r.item_id): (r.n_windows, r.n_words, round(r.share, 9), r.exact) for r in rows}
    assert len(got) == len(rows)
    return got


def test_query_against_plain_python(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = plain([tuple(r) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = {(r.doc_id, r.item_id): (r.n_windows, r.n_words, round(r.share, 9), r.exact) for r in D.op5(spark, SF).collect()}
    assert want and got == want


ITEM = "Yesterday Tom Miller bought 12 apples for 3 kg of sugar. Then Tom Miller gave 5 apples to Anna and kept the other ones."


def test_items_told_anew(spark):
    told = "so: Yesterday Bob Smith bought forty apples for 9 kg of sugar. Then Bob Smith gave forty apples to Cleo and kept the other ones. bye"
    rows = [(1, told), (2, told.replace("Then Bob Smith", "Then Ed Jones")), (3, "x " + ITEM + " y"), (4, "x " + " ".join(ITEM.split()[:11])), (5, "Ada 1 Bob 2 Cleo 3 Dan 4 Eve 5 kg"), (6, told.replace("bought", "sold"))]
    items = [(1, ITEM), (2, "She ate 3 pears, gave 2 apples and slept.")]
    rows += [(7, "Oh: She ate 4 pears, gave 4 apples and slept."), (8, "well " + ITEM.replace("bought", "took").replace("Anna", "Mia"))]
    docs = spark.createDataFrame(rows, DOCS)
    got = found(docs, spark.createDataFrame(items, ITEMS))
    assert got == plain(rows, items)
    assert set(got) == {(1, 1), (2, 1), (3, 1), (6, 1), (7, 2), (8, 1)}
    assert got[3, 1][3] and not got[1, 1][3] and got[2, 1][1] < got[1, 1][1] == 24


def test_slots_of_many_values_do_not_count(spark):
    item = "the price of " + " ".join(f"{w} is 5 euros today and" for w in ("tea", "milk", "bread", "salt")) + " that is all"
    same, other = item.replace(" 5 ", " 8 "), item
    for n in (3, 4, 6, 9):
        other = other.replace(" 5 ", f" {n} ", 1)
    rows, items = [(1, same), (2, other)], [(1, item)]
    got = found(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS))
    assert got == plain(rows, items) and got[1, 1][1] == len(item.split())
    assert (2, 1) not in got or got[2, 1][1] < got[1, 1][1]


def test_short_and_bare_items(spark):
    items = [(1, "Paris"), (2, "42 is it"), (3, "1 2 3 4 5 6 7 8 9"), (4, "one two three four"), (5, ""), (6, None), (None, "a b c d e"), (7, "..."), (1, "Paris")]
    rows = [(1, "paris!"), (2, "Paris is big"), (3, "42 is it"), (4, "so 1 2 3 4 5 6 7 8 9 end"), (5, "1 2 3 4 5 6 7 9 8"), (6, None), (7, ""), (None, "Paris"), (8, "count: one two three four"), (9, "..."), (1, "paris!"), (10, "a b c d e")]
    got = found(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS))
    assert got == plain(rows, items)
    assert set(got) == {(1, 1), (3, 2), (4, 3), (8, 4), (9, 7)}


def test_odd_tables(spark):
    rows = [(1, ITEM), (1, ITEM), (2, "word " * 200_000 + ITEM), (None, ITEM), (3, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({x: F.lit("z") for x in ("item_id", "share", "size", "at", "key", "words", "hashes", "n_words")})
    items = spark.createDataFrame([(1, ITEM)], ITEMS).withColumns({x: F.lit("z") for x in ("doc_id", "shape", "first")})
    assert found(docs, items) == {(1, 1): (16, 24, 1.0, True), (2, 1): (16, 24, 1.0, True)}
    assert found(docs.limit(0), items) == found(docs, items.limit(0)) == {}
