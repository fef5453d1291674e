"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

fold() maps look-alike letters of other scripts, letters with marks, digits and signs that stand for letters onto a-z, one
character for one, so that places in the folded text are places in the text. A match counts if the text has no letter or
digit right before and after it, and if it is not inside an exception phrase.

fit() learns from a bounded sample of labelled documents: words that occur in far more toxic documents than others (log odds
with their standard error), in enough different contexts (copies of one document are one context), their weights, and the
exceptions: phrases of a lexicon word with a neighbour that mostly stand in documents that are not toxic. The score is a
logistic function of the sum of weights over a slowly growing function of the number of words.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._model import bounded_sample, remainder
from ._store import cut, map_arrow

# Look-alikes of Latin letters.
LOOKALIKES = {
    "a": "аαɑ@4", "b": "ьβ8", "c": "сϲ¢", "d": "ԁ", "e": "еε€3", "g": "ɡ", "h": "һн", "i": "іιı1|", "j": "ј", "k": "кκ", "l": "ӏ",
    "m": "м", "n": "ηп", "o": "оο0", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ$5", "t": "тτ+7", "u": "υս", "v": "νѵ", "w": "ѡԝ", "x": "хχ", "y": "уγ", "z": "ʐ",
}


def _folding() -> dict[int, str]:
    table = {ord(c): base for base, all_of in LOOKALIKES.items() for c in all_of}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        plain = unicodedata.normalize("NFKD", chr(code))[0].lower()
        if "a" <= plain <= "z":
            table[code] = plain
    return table


FOLDING = _folding()
WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower()[0] for c in text)
    return low.translate(FOLDING)


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: set[str], fit: tuple[float, float] = (0.0, 1.0)):
        self.weights, self.exceptions, self.line = weights, exceptions, fit
        self.found = None

    def __getstate__(self):
        return self.__dict__ | {"found": None}

    def automaton(self):
        if self.found is None:
            import ahocorasick

            self.found = ahocorasick.Automaton()
            for word, w in self.weights.items():
                self.found.add_word(word, (len(word), w))
            for phrase in self.exceptions:
                self.found.add_word(phrase, (len(phrase), None))
            self.found.make_automaton()
        return self.found

    def total(self, text: str) -> float:
        """The sum of the weights of what is found."""
        if not self.weights:
            return 0.0
        hits, void, n = [], [], len(text)
        for end, (size, w) in self.automaton().iter(fold(text)):
            start = end - size + 1
            if (start and text[start - 1].isalnum()) or (end + 1 < n and text[end + 1].isalnum()):
                continue
            if w is None:
                void.append((start, end))
            else:
                hits.append((start, end, w))
        if not void:
            return sum(w for _, _, w in hits)
        # by their starts, each with the furthest end of those up to it: the one that may hold a hit
        void.sort()
        starts, ends = [a for a, _ in void], list(accumulate((b for _, b in void), max))
        return sum(w for s, e, w in hits if not (k := bisect_right(starts, s)) or ends[k - 1] < e)

    def strength(self, text: str) -> float:
        total = self.total(text)
        return total / (1 + math.log1p((text.count(" ") + 1) / 1000)) if total else 0.0

    def score(self, text: str) -> float:
        a, b = self.line
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, a + b * self.strength(text)))))


def _pairs(words: list[str]) -> Iterator[tuple[str, str, str]]:
    return zip(["", *words[:-1]], words, [*words[1:], ""], strict=True)


def _line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one feature, lightly held back."""
    a, b = -2.0, 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -50, 50)))
        g = np.array([(p - y).sum() + 0.01 * a, ((p - y) * x).sum() + 0.01 * b])
        v = p * (1 - p)
        h = np.array([[v.sum() + 0.01, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 16_000, support: int = 8) -> Lexicon:
    """A lexicon from about max_docs labelled documents (by a hash of doc_id).

    Every word is taken whose log odds of standing in a toxic document are at least 3, two standard errors taken off, and that
    stands in ``support`` toxic documents and three times as many contexts; every phrase around such a word is an exception
    that stands in ``support`` contexts of documents that are not toxic, and in toxic ones no more often than chance. The
    sample bounds both, no further limit is set.

    labels: doc_id, toxic; of several labels of a document the highest counts, null labels do not. Rows with a null text or
    doc_id are passed over, repeated rows count each time. Without toxic documents the lexicon is empty and every score is
    the same.
    """
    rows = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = F.broadcast(bounded_sample(rows, "doc_id", max_docs))  # at most max_docs pairs of numbers, but for chance
    known = docs.filter("text is not null").select("doc_id", "text").join(rows, "doc_id").select("text", "toxic")
    known = cut(known)  # read by each step below
    spark = docs.sparkSession

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [Counter(), Counter()]
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n[y > 0].update(set(WORD.findall(fold(t))))
            every = [*n[0].keys() | n[1].keys()]
            yield pa.RecordBatch.from_pydict({"word": every, "bad": pa.array([n[1][w] for w in every], pa.int64()), "good": pa.array([n[0][w] for w in every], pa.int64())})

    totals = {r["bad"]: r["n"] for r in known.groupBy((F.col("toxic") > 0).alias("bad")).agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(True, 0), totals.get(False, 0)
    odds = F.log((F.col("bad") + 0.5) / (bad - F.col("bad") + 0.5)) - F.log((F.col("good") + 0.5) / (good - F.col("good") + 0.5))
    error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    words = map_arrow(known, spread, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    words = words.filter(F.col("bad") >= support).withColumn("w", odds).withColumn("z", F.col("w") / error).filter("w - 2 * w / z >= 3 and z >= 4")
    weights = {r["word"]: r["w"] for r in words.collect()} if bad and good else {}
    shared = spark.sparkContext.broadcast(set(weights))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = set()
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out.update((w, p, q, int(y > 0)) for p, w, q in _pairs(WORD.findall(fold(t))) if w in shared.value)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.string(), pa.string(), pa.string(), pa.int32()))], names=["word", "before", "after", "bad"])

    seen = map_arrow(known, contexts, "word string, before string, after string, bad int").distinct()
    enough = {r["word"] for r in seen.groupBy("word").agg(F.sum("bad").alias("n")).filter(F.col("n") >= 3 * support).collect()}
    weights = {w: x for w, x in weights.items() if w in enough}
    rate = bad / max(1, bad + good)
    phrases = seen.select("word", "bad", F.explode(F.array(F.concat_ws(" ", "before", "word"), F.concat_ws(" ", "word", "after"))).alias("phrase")).filter("phrase <> word")
    phrases = phrases.groupBy("word", "phrase").agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good")).filter((F.col("good") >= support) & (F.col("bad") <= rate * (F.col("good") + F.col("bad"))))
    lexicon = Lexicon(weights, {r["phrase"].strip() for r in phrases.collect() if r["word"] in weights})
    again = spark.sparkContext.broadcast(lexicon)

    def feature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([again.value.strength(t) for t in b.column(0).to_pylist()], pa.float64()), b.column(1)], names=["x", "y"])

    points = map_arrow(known, feature, "x double, y int").toPandas()
    if len(points):
        lexicon.line = _line(points["x"].to_numpy(), (points["y"].to_numpy() > 0).astype(float))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", into: str = "score") -> DataFrame:
    """docs with the column ``into``, 0 to 1.

    Null and empty texts score as texts in which nothing is found. A column of the name ``into`` is replaced, other columns and
    repeated rows stay, an empty table gives an empty one. Texts are read whole; time is linear in their length but for a
    logarithm of the number of exceptions met.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    docs = docs.drop(into)
    fields = [f.name for f in docs.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.score(t.as_py() or "") for t in b.column(fields.index(text))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], names=[*fields, into])

    return map_arrow(docs, run, T.StructType([*docs.schema.fields]).add(into, "double"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    lexicon = fit(docs, labels.filter(remainder(F.col("doc_id"), 5) != 0))
    out = score(docs.withColumn("held_out", remainder(F.col("doc_id"), 5) == 0), lexicon)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
