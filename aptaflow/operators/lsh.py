"""Clustering of regions by locality-sensitive hashing.

A hash samples places of the region; regions with equal samples share a bucket. In the first round the most abundant sequence of
a bucket without a cluster founds one, which all of the bucket within the cutoff join, and so on. In later rounds, with other
places, the most abundant sequence of a bucket draws the others within the cutoff into its cluster.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq
from ..ship import ship
from ..store import cut, numbered
from . import pool


@dataclass(frozen=True)
class Config:
    region_size: int
    dimension: int
    iterations: int = 5
    edit_distance: int = 5
    kmer: int = 3
    cutoff: float | None = None
    cutoff_parents: int = 10_000
    cutoff_mutants: int = 100
    seed: int = 1


def sampled_places(size: int, dimension: int, start: int, step: int) -> list[int]:
    """The sorted places of a hash. One place fewer than the dimension is sampled."""
    return sorted((start + v * step) % size for v in range(dimension - 1))


def steps(size: int) -> list[int]:
    """The steps of hashes of regions of a size: prime to it and neither 1 nor size - 1. There are none for 2, 3, 4 and 6."""
    return [1] if size == 1 else [a for a in range(2, size - 1) if math.gcd(a, size) == 1]


def places(config: Config) -> list[list[int]]:
    """The places of each iteration's hash, from (start, step) pairs that do not repeat."""
    m = config.region_size
    if not steps(m):
        raise ValueError(f"no hash for regions of {m} places")
    pairs = [(s, a) for s in range(m) for a in steps(m)]
    if len(pairs) < config.iterations:
        raise ValueError("more iterations than hashes")
    return [sampled_places(m, config.dimension, *p) for p in random.Random(config.seed).sample(pairs, config.iterations)]


_CODE = np.full(256, 4, np.int64)
_CODE[[ord(c) for c in "ACGT"]] = range(4)


def kmer_frequencies(sequences: list[str], k: int) -> np.ndarray:
    """A row for each sequence: its k-mer counts without the last k-mer, by the number of k-mers. Signs but A, C, G, T are one."""
    out = np.zeros((len(sequences), 5**k))
    by_length: dict[int, list[int]] = {}
    for i, s in enumerate(sequences):
        by_length.setdefault(len(s), []).append(i)
    for n, rows in by_length.items():
        if n <= k:
            continue
        code = _CODE[np.frombuffer("".join(sequences[i] for i in rows).encode("ascii", "replace"), np.uint8)].reshape(len(rows), n)
        at = sum(code[:, j : n - k + j] * 5 ** (k - 1 - j) for j in range(k))
        np.add.at(out, (np.repeat(rows, n - k), at.ravel()), 1.0)
        out[rows] /= n - k + 1
    return out


def _small(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches of which the frequencies take about 32 MB."""
    step = max(1, (1 << 22) // 5**k)
    for b in batches:
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The k-mer distance of the rows of a from those of b (or from one row): functions.seq.kmer_distance of frequencies."""
    out = ((a - b) ** 2).sum(axis=-1)
    return np.where(((a > 0) | (b > 0)).sum(axis=-1) <= 1, 2.0, out)


def mutants(sequences: DataFrame, config: Config) -> DataFrame:
    """(parent, mutant): cutoff_parents draws from sequences (a column), each with cutoff_mutants mutants.

    A mutant has edit_distance places drawn anew, which may be one place twice and the letter that stood there. Draws come from
    md5 sums of the seed and their numbers, so they are the same on every run.
    """
    spark = sequences.sparkSession
    pool_ = numbered(sequences.select("sequence").distinct(), "sequence", "n")
    number = lambda h, i, size: F.conv(F.substring(h, i, size), 16, 10).cast("long")
    digest = lambda *of: F.md5(F.concat_ws(":", F.lit(str(config.seed)), *of).cast("binary"))
    size = pool_.count()
    if not size:
        return spark.createDataFrame([], "parent string, mutant string")
    drawn = spark.range(config.cutoff_parents).select(F.col("id").alias("x"), (F.pmod(number(digest(F.col("id").cast("string")), 1, 8), F.lit(size)) + 1).cast("int").alias("n"))
    out = drawn.join(pool_, "n").withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(config.cutoff_mutants - 1)))).withColumn("mutant", F.col("sequence"))
    for z in range(config.edit_distance):
        out = out.withColumn("h", digest(F.col("x").cast("string"), F.col("y").cast("string"), F.lit(str(z))))
        letter = F.substring(F.lit("ACGT"), (F.pmod(number(F.col("h"), 9, 1), F.lit(4)) + 1).cast("int"), F.lit(1))
        out = out.withColumn("mutant", F.overlay("mutant", letter, (F.pmod(number(F.col("h"), 1, 8), F.length("sequence")) + 1).cast("int"), F.lit(1)))
    return out.select(F.col("sequence").alias("parent"), "mutant")


def cutoff(counts: DataFrame, config: Config) -> float:
    """Mean distance of mutants from their parents; parents are drawn from the sequences whose region has the configured size."""
    if config.cutoff is not None:
        return config.cutoff
    ship(counts.sparkSession)
    k = config.kmer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches, k):
            d = distances(kmer_frequencies(b.column(0).to_pylist(), k), kmer_frequencies(b.column(1).to_pylist(), k))
            yield pa.RecordBatch.from_pydict({"d": d})

    return mutants(counts.filter(F.length("region") == config.region_size), config).mapInArrow(run, "d double").agg(F.avg("d")).first()[0] or 0.0


def buckets(ranked: DataFrame, at: list[int]) -> DataFrame:
    return ranked.withColumn("bucket", seq.project(F.col("region"), at))


def found(ranked: DataFrame, at: list[int], limit: float, k: int) -> DataFrame:
    """The first round: (sequence, region, abundance_rank, cluster_id), ids unique by bucket and founder's rank.

    A bucket is read as a stream in the order of ranks; only its founders are kept, as rows of k-mer frequencies, the others
    pass by.
    """
    ship(ranked.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ranks, held = None, [], np.zeros((0, 5**k))
        for b in _small(batches, k):
            ids = []
            own = kmer_frequencies(b.column("sequence").to_pylist(), k)
            for i, (bucket, rank) in enumerate(zip(b.column("bucket").to_pylist(), b.column("abundance_rank").to_pylist(), strict=True)):
                if bucket != now:
                    now, ranks = bucket, []
                # the founder of the least rank within the cutoff: the one whose turn would have come first
                near = np.flatnonzero(distances(held[: len(ranks)], own[i]) <= limit) if ranks else ()
                if len(near):
                    ids.append(ranks[near[0]])
                    continue
                if len(ranks) == len(held):
                    held = np.concatenate([held, np.zeros((max(16, len(held)), 5**k))])
                held[len(ranks)] = own[i]
                ranks.append(rank)
                ids.append(rank)
            yield pa.RecordBatch.from_arrays([b.column("sequence"), b.column("region"), b.column("abundance_rank"), pa.array(ids, pa.int64())], names=["sequence", "region", "abundance_rank", "cluster_id"])

    rows = buckets(ranked, at).select("bucket", "sequence", "region", F.col("abundance_rank").cast("long").alias("abundance_rank"))
    return rows.repartition("bucket").sortWithinPartitions("bucket", "abundance_rank").mapInArrow(run, "sequence string, region string, abundance_rank long, cluster_id long")


def reassigned(clustered: DataFrame, at: list[int], limit: float, k: int) -> DataFrame:
    """A later round: members of a bucket within the cutoff of its most abundant one go over to that one's cluster."""
    head = buckets(clustered, at).groupBy("bucket").agg(F.min(F.struct("abundance_rank", "sequence", "cluster_id")).alias("head"))
    rows = buckets(clustered, at).join(head, "bucket")
    near = seq.kmer_distance(F.col("head.sequence"), F.col("sequence"), k) <= limit
    moves = (F.col("cluster_id") != F.col("head.cluster_id")) & near
    return rows.select("sequence", "region", "abundance_rank", F.when(moves, F.col("head.cluster_id")).otherwise(F.col("cluster_id")).alias("cluster_id"))


def renumbered(clustered: DataFrame) -> DataFrame:
    """cluster_id as 0, 1, ... in the order of the old ids."""
    ids = numbered(clustered.select("cluster_id").distinct(), "cluster_id", "n")
    return clustered.join(ids, "cluster_id").withColumn("cluster_id", F.col("n") - 1).drop("n")


def cluster(counts: DataFrame, config: Config) -> DataFrame:
    """(sequence, cluster_id) of the sequences whose region has the configured size. counts: sequence, region, count."""
    limit = cutoff(counts, config)
    regions = counts.select("sequence", "region").distinct()
    ranked = cut(pool.abundance_rank(counts).join(regions, "sequence").filter(F.length("region") == config.region_size))
    hashes = places(config)
    out = cut(found(ranked, hashes[0], limit, config.kmer))
    for at in hashes[1:]:
        out = cut(reassigned(out, at, limit, config.kmer))
    return renumbered(out).select("sequence", "cluster_id")


def sizes(clustered: DataFrame) -> DataFrame:
    """(cluster_id, n_sequences): one row for each cluster."""
    return clustered.groupBy("cluster_id").agg(F.count("*").alias("n_sequences"))
