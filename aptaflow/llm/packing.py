"""Packing of token sequences by a configuration linear program.

Documents are tokenised, each ended by one separator id, and only those longer than the capacity are cut. A configuration is
a multiset of piece lengths that fits into one sequence; the program asks for the fewest configurations that cover the
histogram of piece lengths. plan() solves it by multiplicative weights: each length has a weight, a knapsack dynamic program
prices the best configuration under these weights, it is taken in part, and the weights of the lengths that it covers shrink.
Rounding takes the whole part of each configuration as long as its lengths last; the rest is filled greedily, the longest
piece first, each configuration repeated while the histogram holds it. All this is done on the histogram, which has at most
``capacity`` entries at any size of the corpus, on the driver.

Pieces then get their places in parallel: rank r of the pieces of a length belongs to the r-th place for this length.
Ranks are counted within salted parts of a length, so a length that a third of all pieces have is spread over many tasks.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import cut, kept, map_arrow, partitions

CAPACITY = 4096
SEPARATOR = 1
#: Words of which a worker keeps the ids in each of two generations; the older one goes when the younger is full. About 200 MB.
CACHE = 500_000
#: The same where other operators' tables stand in the same workers. Results do not depend on it.
SMALL_CACHE = 200_000


#: Lower-case letters that no normal form changes; the match of a word of nothing else, in UTF-8.
PLAIN = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100), 0x153]))
_PLAIN = re.compile(b"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf]|\xc5\x93)+").fullmatch
#: The letter for each byte in byte-level tokenizers: printable bytes stand for themselves, the others for letters from 256 on.
_BYTES = {x: 256 + n for n, x in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}


def _leaves_whole(tokenizer) -> bool:
    """Whether words of PLAIN letters reach the model of the tokenizer whole, byte by byte in the letters of _BYTES."""
    if tokenizer.truncation or tokenizer.padding or not tokenizer.pre_tokenizer or any(set(x.content) <= set(PLAIN) for x in tokenizer.get_added_tokens_decoder().values()):
        return False
    for word in (PLAIN, PLAIN[::-1], *PLAIN):
        pieces = tokenizer.pre_tokenizer.pre_tokenize_str(word)
        if (tokenizer.normalizer and tokenizer.normalizer.normalize_str(word) != word) or [x for x, _ in pieces] != [word.encode().decode("latin-1").translate(_BYTES)]:
            return False
    return True


class Encoder:
    """A tokenizer whose ids of words between spaces are kept.

    The tokenizer must lower-case, and treat what stands between spaces and line feeds independently, as those whose
    pre-tokenizer drops white space and parts letters from signs, and whose normalizer does not look across white space. Its
    added tokens must hold no white space; a text with ``<|`` is not lower-cased beforehand, as such tokens are matched first.

    Words of PLAIN letters go to the tokenizer's model itself where its other steps leave such words whole, as byte-level ones
    do; the steps cost several times what the model does. All other words go through the whole tokenizer.
    """

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.cache = cache
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model if _leaves_whole(self.tokenizer) else None
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        raw = text.encode("utf-8", "replace").replace(b"\n", b" ")
        words = (raw if b"<|" in raw else raw.lower()).split(b" ")
        if new := set(words).difference(self.known):
            if len(self.known) >= self.cache:
                self.older, self.known = self.known, {}
                new = set(words)
            self._learn(new)
        return np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<u4")

    def _learn(self, words: set[bytes]) -> None:
        known, older = self.known, self.older
        known.update((w, older[w]) for w in words if w in older)
        new = words.difference(known)
        # a full stop or comma after an ASCII letter or a plain word is a token of its own
        ended = [w for w in new if w[-1:] in (b".", b",") and (w[-2:-1].isalpha() or _PLAIN(w[:-1]))]
        stems = new.difference(ended)
        stems.update((b".", b","), (w[:-1] for w in ended))
        known.update((w, older[w]) for w in stems if w in older)
        todo = stems.difference(known)
        if self.model:
            tokenize, plain = self.model.tokenize, [w for w in todo if _PLAIN(w)]
            for w in plain:
                letters = w.decode() if w.isascii() else w.decode("latin-1").translate(_BYTES)
                known[w] = array("I", [x.id for x in tokenize(letters)]).tobytes()
            todo.difference_update(plain)
        todo = list(todo)
        for w, e in zip(todo, self.tokenizer.encode_batch_fast([w.decode() for w in todo], add_special_tokens=False), strict=True):
            known[w] = array("I", e.ids).tobytes()
        for w in ended:
            known[w] = known[w[:-1]] + known[w[-1:]]


def encoder_of(path: str, cache: int) -> Encoder:
    """The worker's encoder; what it has met serves the worker's later tasks of this operator."""
    encoders = kept("packing")
    if (path, cache) not in encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoders[path, cache] = Encoder(path, cache)
    return encoders[path, cache]


def tokenised(docs: DataFrame, path: str, text: str = "text", capacity: int = CAPACITY, separator: int = SEPARATOR, cache: int = CACHE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. A null text is empty and gives one piece of one id."""
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, cache)
        end = np.array([separator], "<u4")
        for b in batches:
            out = []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.concatenate([encoder.ids(t.as_py()), end])
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    out.append((doc, k, start, len(part), zlib.crc32(part.tobytes())))
            kinds = (b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long", owner="packing")


def _price(weight: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
    """The configuration of the highest weight: an unbounded knapsack by dynamic programming over the capacity."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int32)
    sizes = np.zeros(capacity + 1)
    sizes[lengths] = weight
    for c in range(1, capacity + 1):
        value = best[c - 1 :: -1][:c] + sizes[1 : c + 1]  # a piece of length 1..c after c-1..0
        k = int(value.argmax())
        if value[k] > best[c - 1]:
            best[c], last[c] = value[k], k + 1
        else:
            best[c], last[c] = best[c - 1], 0
    found: dict[int, int] = {}
    c = capacity
    while c > 0:
        if size := int(last[c]):
            found[size] = found.get(size, 0) + 1
            c -= size
        else:
            c -= 1
    return found


def fractional(histogram: dict[int, int], capacity: int, rounds: int, rate: float = 2.0) -> list[tuple[dict[int, int], float]]:
    """Configurations and how often each is taken, together about covering the histogram."""
    lengths = np.array(sorted(histogram), np.int64)
    need = np.array([histogram[x] for x in lengths.tolist()], float)
    row = {x: k for k, x in enumerate(lengths.tolist())}
    covered = np.zeros(len(lengths))
    total, done, taken = float(need @ lengths), 0.0, []
    for _ in range(rounds):
        if done >= total:
            break
        # a length covered above the average loses weight, one below it gains
        lag = np.clip(rate * (done / total - covered / need), -30, 3)
        config = _price(lengths * np.exp(lag), lengths, capacity)
        step = min(need[row[x]] / n for x, n in config.items())
        step = min(step, max(1.0, total / capacity / rounds * 1.5))
        for x, n in config.items():
            covered[row[x]] += n * step
            done += n * step * x
        taken.append((config, step))
    return taken


def _fill(lengths: list[int], left: dict[int, int], capacity: int) -> dict[int, int]:
    """The longest piece that is left, then again and again the longest that fits."""
    config: dict[int, int] = {}
    room = capacity
    for x in lengths:
        if x <= room and (n := min(left[x], room // x)):
            config[x] = n
            room -= n * x
            if not room:
                break
    return config


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 150) -> list[tuple[dict[int, int], int]]:
    """Whole numbers of configurations that hold every piece exactly once."""
    left = dict(histogram)
    out = []
    for config, times in fractional(histogram, capacity, rounds) if histogram else []:
        if n := min(int(times + 0.5), *(left[x] // k for x, k in config.items())):
            out.append((config, n))
            for x, k in config.items():
                left[x] -= n * k
    while lengths := sorted((x for x, n in left.items() if n), reverse=True):
        config = _fill(lengths, left, capacity)
        n = min(left[x] // k for x, k in config.items())
        out.append((config, n))
        for x, k in config.items():
            left[x] -= n * k
    return out


def _places(planned: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first ranks of runs of places, the sequences these begin at, the offsets in them."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for config, times in planned:
        offset = 0
        for x, k in sorted(config.items(), reverse=True):
            for _ in range(k):
                runs.setdefault(x, []).append((ranks.get(x, 0), sequence, offset))
                ranks[x] = ranks.get(x, 0) + times
                offset += x
        sequence += times
    return {x: tuple(np.array(v, np.int64) for v in zip(*r, strict=True)) for x, r in runs.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY, key: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """pieces (with a column length, 1 to capacity) and the columns sequence_id and offset.

    Every row is placed, repeated rows too (they are told apart by their place in their salted part). An empty table gives
    none. pieces is read three times, so it should be a written table.
    """
    spark = pieces.sparkSession
    salts = max(8, 2 * partitions(spark))
    pieces = pieces.drop("sequence_id", "offset").withColumn("_salt", F.pmod(F.xxhash64(*key), F.lit(salts)).cast("int"))
    counts = pieces.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    counts = cut(counts)  # at most capacity times salts rows
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(_places(plan(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("length", "_salt").orderBy(*key)
    ranked = pieces.withColumn("_rank", F.row_number().over(within) - 1).join(first, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_first")).drop("_first", "_salt")
    names = [c for c in ranked.columns if c != "_rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for x in np.unique(size).tolist():
                start, seq, off = places.value[x]
                at = np.flatnonzero(size == x)
                k = np.searchsorted(start, rank[at], "right") - 1
                sequence[at], offset[at] = seq[k] + rank[at] - start[k], off[k]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ranked.drop("_rank").schema.add("sequence_id", "long").add("offset", "long")
    return map_arrow(ranked, run, schema)


def packed(docs: DataFrame, path: str | None = None, cache: int = CACHE) -> DataFrame:
    """Tokenised and packed documents. path: a tokenizer's file, on every machine."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return pack(cut(tokenised(docs, path, cache=cache)))


COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select(*COLUMNS)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packed(docs, cache=SMALL_CACHE).select(*COLUMNS)
