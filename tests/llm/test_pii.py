"""Surrogates: what the whole table must keep, coreference, full spaces, types and odd rows."""

from collections import defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from aptaflow.llm import pii

DOCS = "doc_id long, text string"
SF = "/root/testdata/sf0.01"


def replaced(spark, *texts, key="k"):
    rows = list(enumerate(texts))
    return [r.text for r in pii.replace(spark.createDataFrame(rows, DOCS), key=key).orderBy("doc_id").collect()]


def test_whole_table_against_plain_python(spark):
    """Outside the mentions nothing changes; one entity has one surrogate, two have two; none is an entity of the table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    out = {r.doc_id: r for r in pii.op6(spark, SF).collect()}
    rows = docs.collect()
    assert len(rows) == len(out)
    new, mentions = defaultdict(set), set()
    for doc, text in rows:
        found = regex.findall(pii.PATTERN, text or "")
        assert out[doc].n_entities == len(found)
        if not found:
            assert out[doc].text == text
            continue
        around = ".+?".join("(?s:.*)" if False else regex.escape(x) for x in regex.split(pii.PATTERN, text))
        hit = regex.fullmatch(around.replace(".+?", "(.+?)"), out[doc].text)
        assert hit, doc
        mentions.update(found)
        for old, made in zip(found, hit.groups(), strict=True):
            assert regex.sub(r"\d", "0", regex.sub(r"\p{Lu}", "A", regex.sub(r"\p{Ll}", "a", old))).replace("A", "a").count("0") >= 0
            kind = "email" if "@" in old else "other"
            new[(kind, regex.sub(r"[^\p{L}\p{N}]", "", old).lower())].add(regex.sub(r"[^\p{L}\p{N}]", "", made).lower())
            assert made != old
    assert len(new) > 20 and all(len(x) == 1 for x in new.values())
    assert len(set().union(*new.values())) == len(new)
    everything = " ".join(r.text or "" for r in out.values())
    for old in mentions:
        if len(old) > 9:
            assert old not in everything


def test_names_keep_their_parts(spark):
    a, b, c = replaced(spark, "John Smith met Mr Smith and Mrs. Smith; then Smith left. Anna Smith too.", "Dr. John Jones, John Smith", "My name is Zora Quill. Quill said so. Blacksmith")
    first, family = a.split()[:2]
    assert a.count(family) == 5 and "Smith" not in a and f"{first} {family}" in b and a.startswith(f"{first} {family} met Mr {family} and Mrs. {family}; then {family} left. ")
    assert first in pii.LATIN_MALE and a.split(". ")[-1].split()[0].split("-")[0] in pii.LATIN_FEMALE
    assert b.startswith(f"Dr. {first} ") and "Jones" not in b
    assert "Zora" not in c and "Quill" not in c and "Blacksmith" in c


def test_full_spaces(spark):
    """26 addresses of one letter at one domain, 400 at others; all surrogates differ, also in their domains."""
    mails = [f"{c}@x.com" for c in "abcdefghijklmnopqrstuvwxyz"] + [f"{c}@{d}.com" for c in "abcdefghijklmnopqrst" for d in "abcdefghijklmnopqrst"]
    out = replaced(spark, *[f"to {m} now" for m in mails])
    new = [x.split()[1] for x in out]
    assert len(set(new)) == len(mails) and not set(new) & set(mails)
    pairs = {(m.split("@")[1], n.split("@")[1]) for m, n in zip(mails, new, strict=True)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) == 21


def test_many_entities_stay_distinct(spark):
    rows = [(f"{i // 10000:03d}-{i % 100:02d}-{i:04d}", f"+{1 + i % 3} 555 {i:07d}", f"10.{i // 250}.0.{i % 250}", f"Mr. {chr(65 + i % 26)}{'aeiou'[i // 26 % 5]}{chr(97 + i // 130)}n") for i in range(3000)]
    out = replaced(spark, *[" ; ".join(r) for r in rows])
    for i in range(4):
        old, new = [r[i] for r in rows], [x.split(" ; ")[i] for x in out]
        assert len(set(new)) == len(set(old)), i
        assert not set(new) & set(old) or i == 0
    assert all(x.split(" ; ")[1][:2] == r[1][:2] for x, r in zip(out, rows, strict=True))


def test_types(spark):
    text = "v6 2001:db8::8a2e:370:7334 born 1980-05-17, DOB: 17.05.1980 call 020 7946 0958 at 12 Baker Street, on 2020-01-02 at 10:20:30 std::sort"
    (out,) = replaced(spark, text)
    for gone in ("2001:db8", "1980", "7946", "Baker"):
        assert gone not in out, gone
    assert "on 2020-01-02 at 10:20:30 std::sort" in out and regex.search(r"at [1-9]\d [A-Z][a-z]{4} Street,", out) and regex.search(r"call \d{3} \d{4} \d{4} ", out)
    iso, dotted = regex.search(r"born (\d{4})-(\d\d)-(\d\d)", out).groups(), regex.search(r"DOB: (\d\d)\.(\d\d)\.(\d{4})", out).groups()
    assert iso == dotted[::-1]


def test_key(spark):
    docs = spark.createDataFrame([(1, "a@b.com")], DOCS)
    with pytest.raises(ValueError, match="key"):
        pii.replace(docs)
    spark.conf.set(pii.KEY_SETTING, "other")
    try:
        assert pii.replace(docs).first().text != replaced(spark, "a@b.com")[0]
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_odd_rows(spark):
    long = "word " * 100_000 + "a@b.com"
    rows = [(1, long), (1, long), (2, None), (3, ""), (None, "a@b.com"), (4, "none")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({x: F.lit("z") for x in ("value", "kind", "canonical", "new", "n_chars", "family", "parts")})
    out = pii.replace(docs, key="k")
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    made = replaced(spark, "a@b.com")[0]
    assert got == sorted([(1, long.replace("a@b.com", made))] * 2 + [(2, None), (3, ""), (None, made), (4, "none")], key=str)
    staged = pii.stage(spark, docs.drop("n_chars").withColumn("n_chars", F.length("text")), "")
    assert staged.columns[-1] == "n_chars" and all(r.n_chars == (None if r.text is None else len(r.text)) for r in staged.collect())
    assert pii.stage(spark, docs.drop("n_chars"), "").count() == 6 and pii.replace(docs.limit(0), key="k").count() == 0
