"""Language identification: known words first, shorter and shorter character n-grams for the others.

fit() counts the words of a bounded sample of labelled documents in Spark and keeps those that occur often enough in a
language; the n-gram tables come from these words. The sample bounds the model, so that it fits any executor.
A known word scores its log frequency in each language. An unseen word scores the mean of its known 5-grams (with marks at
its ends), or if it has none, of its 4-grams, and so on down to single letters. The language of the highest sum wins.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._model import bounded_sample, remainder
from ._store import map_arrow

WORD = re.compile(r"[^\W\d_]+")
LONGEST = 5
#: The sample of labelled documents, and how often a word must occur in it to be a known word of its language.
MAX_DOCS, SUPPORT = 8000, 3
#: Calibration of the score only, not of the language: words of a text are not independent, so a text of more words counts as
#: one of so many. With each word counted all scores were 0 or 1.
EVIDENCE = 20
#: Entries of an executor's table of words met; it starts anew beyond that.
CACHE = 100_000


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case; number signs such as superscripts and Roman numerals are not letters."""
    words = WORD.findall(text.lower())
    if text.isascii():
        return words
    return [w for x in words for w in ((x,) if x.isalpha() else "".join(c if c.isalpha() else " " for c in x).split())]


class Model:
    """Log frequencies of words and n-grams by language."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.langs = sorted(counts)
        self.words = self._table({k: counts[k] for k in self.langs})
        self.grams = []
        for n in range(LONGEST, 0, -1):
            by_lang: dict[str, dict[str, int]] = {}
            for lang in self.langs:
                by_lang[lang] = defaultdict(int)
                for word, c in counts[lang].items():
                    for g in self._cut(word, n):
                        by_lang[lang][g] += c
            self.grams.append((n, self._table(by_lang)))

    @staticmethod
    def _cut(word: str, n: int) -> list[str]:
        marked = f"^{word}$" if n > 1 else word
        return [marked[i : i + n] for i in range(len(marked) - n + 1)]

    def _table(self, by_lang: dict[str, dict[str, int]]) -> tuple[dict[str, int], np.ndarray]:
        """(row of each key, log frequencies by row and language)."""
        keys = sorted(set().union(*by_lang.values())) if by_lang else []
        rows = np.array([[by_lang[x].get(k, 0) for x in self.langs] for k in keys], np.float64).reshape(len(keys), len(self.langs))
        return dict(zip(keys, range(len(keys)), strict=True)), np.log((rows + 0.5) / (rows.sum(axis=0) + 0.5 * max(1, len(keys)))).astype(np.float32)

    def word(self, word: str) -> np.ndarray:
        table, rows = self.words
        if (k := table.get(word)) is not None:
            return rows[k]
        for n, (table, rows) in self.grams:
            if known := [k for g in self._cut(word, n) if (k := table.get(g)) is not None]:
                return rows[known].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)


class Scores(dict):
    """word -> row of self.rows, filled as words are met."""

    def __init__(self, model: Model):
        self.model, self.rows = model, np.zeros((1024, len(model.langs)), np.float32)

    def __missing__(self, word: str) -> int:
        if (k := len(self)) == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[k] = self.model.word(word)
        self[word] = k
        return k


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_docs: int = MAX_DOCS, support: int = SUPPORT) -> Model:
    """A model of about max_docs of the labelled documents, by a hash of their key.

    A word is known in a language in which it occurs ``support`` times or more in these; no further bound is set on words.
    Rows whose text or language is null are passed over, repeated rows count each time.
    """
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = Counter()
            for t, label in zip(b.column("t"), b.column("l").to_pylist(), strict=True):
                seen.update((label, w) for w in words_of(t.as_py()))
            yield pa.RecordBatch.from_pydict({"l": [x[0] for x in seen], "w": [x[1] for x in seen], "n": pa.array(seen.values(), pa.int64())})

    words = map_arrow(bounded_sample(labelled, "k", max_docs), count, "l string, w string, n long").groupBy("l", "w").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for r in words.filter(F.col("n") >= support).toLocalIterator():
        counts[r["l"]][r["w"]] = r["n"]
    return Model(counts)


def predict(docs: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """docs with the columns pred and score (replaced if docs has such).

    Texts that are null or hold no letter get ``und`` and 0.0, as do all texts under a model without languages. A text whose
    letters all are unknown gets the first language with an even score. Ties go to the first language by name. score is the
    softmax of the mean word scores times the number of words, EVIDENCE at most. Very long texts are read whole, one text in
    memory at a time. Other columns and repeated rows stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(pred, score)
    fields = [f.name for f in docs.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        met = Scores(m)
        for b in batches:
            best, conf = [], []
            for t in b.column(fields.index(text)):
                words = words_of(t.as_py() or "")
                if not words or not m.langs:
                    best.append("und")
                    conf.append(0.0)
                    continue
                rows = np.fromiter(map(met.__getitem__, words), np.int32, len(words))
                mean = met.rows[rows].sum(axis=0, dtype=np.float64) / len(words)
                z = np.exp((mean - mean.max()) * min(len(words), EVIDENCE))
                k = int(mean.argmax())
                best.append(m.langs[k])
                conf.append(float(z[k] / z.sum()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best, pa.string()), pa.array(conf, pa.float64())], names=[*fields, pred, score])
            if len(met) > CACHE:
                met = Scores(m)

    out = T.StructType([*docs.schema.fields]).add(pred, "string").add(score, "double")
    return map_arrow(docs, run, out)


def train_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(remainder(F.col("doc_id"), 4) != 2)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(train_rows(docs))
    out = predict(docs.select("doc_id", "text", (remainder(F.col("doc_id"), 4) == 2).alias("held_out")), model, score="score")
    return out.select("doc_id", "held_out", "lang_pred", "score")


def keep(docs: DataFrame, model: Model, languages: tuple[str, ...] | None = None, least: float | None = None, text: str = "text") -> DataFrame:
    """The rows of docs in one of ``languages`` (None: of all learned ones) with a score of ``least`` or more.

    Texts that are null or without a letter go. By default ``least`` is just above an even score, which is what a text gets of
    which no word and no n-gram is known; short texts of a learned language stay. Repeated rows stay or go together; all columns
    of docs are kept whatever their names, null ones too. An empty table gives an empty one.
    """
    if least is None:
        least = 1.001 / len(model.langs) if len(model.langs) > 1 else 0.0
    pred, score = (f"{x}_{uuid.uuid4().hex}" for x in ("lang", "score"))
    rows = predict(docs, model, text, pred, score).filter((F.col(pred) != "und") & (F.col(score) >= least))
    if languages is not None:
        rows = rows.filter(F.col(pred).isin(*languages))
    return rows.drop(pred, score)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages, see keep()."""
    return keep(docs, fit(train_rows(docs)))
