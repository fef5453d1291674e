"""Frequency-based clustering by over-represented substrings.

Candidates of each length are scored by how far the reads that hold them exceed what base ratios let expect; survivors are
lengthened by a base as long as the score grows. All candidates are ranked together; in the order of ranks each takes the
sequences that hold it and removes the later candidates that contain it. As containment is transitive, what remains is the
candidates without an earlier candidate inside, and a sequence belongs to the first remaining one that it holds, so the
clustering is a set of joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seq
from ..store import cut, numbered
from . import metadata

DNA = ["A", "T", "C", "G"]


def normalised(counts: DataFrame, rna: bool = False) -> DataFrame:
    """(aptamer key columns, region, count): upper case, T and U unified, other letters and empty or bad regions dropped."""
    region = F.translate(F.upper("region"), "T" if rna else "U", "U" if rna else "T")
    return counts.withColumn("region", region).filter((F.col("count") > 0) & (F.length("region") > 0) & F.col("region").rlike("^[ACGU]+$" if rna else "^[ACGT]+$"))


#: Candidates up to which they are sent to all executors.
BROADCAST_ROWS = 500_000


def support(counts: DataFrame, k: int, candidates: DataFrame | None = None) -> DataFrame:
    """(subsequence, observed_count): reads that hold a k-mer, each sequence once; of candidates (subsequence) alone if given."""
    rows = counts.groupBy("region").agg(F.sum("count").alias("count")).select("count", F.explode(F.array_distinct(seq.kmers(F.col("region"), k))).alias("subsequence"))
    if candidates is not None:
        rows = rows.join(_sent(candidates.select("subsequence")), "subsequence", "left_semi")
    return rows.groupBy("subsequence").agg(F.sum("count").alias("observed_count"))


def _sent(df: DataFrame) -> DataFrame:
    """df for a join, broadcast if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def every_string(spark, alphabet: list[str], k: int) -> DataFrame:
    """All strings of a length (subsequence), in parallel."""
    n = len(alphabet)
    letters = F.array(*[F.lit(x) for x in alphabet])
    digit = lambda i: F.get(letters, (F.floor(F.col("id") / F.lit(n**i)) % n).cast("int"))
    return spark.range(n**k).select(F.concat(*[digit(i) for i in range(k - 1, -1, -1)]).alias("subsequence"))


def _expected(ratios: Column, lengths: list[tuple[int, int]], total: int) -> Column:
    """The expected share of reads that hold a subsequence."""
    most = max(n for n, _ in lengths)
    p = seq.inclusion_probabilities(F.col("subsequence"), ratios, most)
    return sum((F.get(F.col("_p"), F.lit(n - 1)) * c for n, c in lengths), F.lit(0.0)) / total, p


def scored(candidates: DataFrame, observed: DataFrame, ratios: Column, lengths: list[tuple[int, int]], total: int) -> DataFrame:
    """subsequence, length, observed_count, expected_fraction, z_score."""
    share, p = _expected(ratios, lengths, total)
    # written, as the figures below read the share several times
    out = cut(candidates.join(observed, "subsequence", "left").withColumn("_p", p).withColumn("expected_fraction", share).drop("_p"))
    variance = F.col("expected_fraction") * (1 - F.col("expected_fraction")) * total
    seen = F.coalesce("observed_count", F.lit(0)).cast("long")
    z = F.when(variance > 0, (seen - total * F.col("expected_fraction")) / F.sqrt(variance)).otherwise(0.0)
    return out.select("subsequence", F.length("subsequence").alias("length"), seen.alias("observed_count"), "expected_fraction", z.alias("z_score"))


def standardised(level: DataFrame) -> DataFrame:
    """z scores in population deviations of their length's mean. level should be a written table, as it is read twice."""
    figures = level.groupBy("length").agg(F.avg("z_score").alias("_mean"), F.stddev_pop("z_score").alias("_sd"))  # a row for each length
    out = level.join(F.broadcast(figures), "length")
    z = F.when(F.col("_sd") == 0, 0.0).otherwise((F.col("z_score") - F.col("_mean")) / F.col("_sd"))
    return out.withColumn("normalized_z_score", z).drop("_mean", "_sd")


def inputs(counts: DataFrame) -> tuple[Column, list[tuple[int, int]], int]:
    """(base ratios as a map, length distribution, total): a handful of numbers."""
    ratios = [(r["base"], r["ratio"]) for r in metadata.base_ratios(counts).orderBy("base").collect()]
    lengths = [(r["length"], r["count"]) for r in metadata.lengths(counts).orderBy("length").collect()]
    table = F.create_map(*[F.lit(x) for pair in ratios for x in pair])
    return table, lengths, sum(c for _, c in lengths)


def search(counts: DataFrame, min_length: int = 5, max_length: int = 10, rna: bool = False) -> DataFrame:
    """The ranked candidates: rank, subsequence, length, observed_count, expected_fraction, z_score, normalized_z_score."""
    spark = counts.sparkSession
    counts = cut(normalised(counts, rna))
    alphabet = [("U" if rna and x == "T" else x) for x in DNA]
    if counts.isEmpty():
        ratios, lengths, total = F.create_map(F.lit("A"), F.lit(0.0)), [(1, 0)], 1
        return ranked(standardised(scored(every_string(spark, alphabet, 1).limit(0), support(counts, 1), ratios, lengths, total)))
    ratios, lengths, total = inputs(counts)
    candidates, levels = every_string(spark, alphabet, min_length), []
    for k in range(min_length, max_length + 1):
        level = scored(candidates.select("subsequence"), support(counts, k, candidates if levels else None), ratios, lengths, total)
        if levels:
            level = level.join(_sent(candidates), "subsequence").filter(F.col("z_score") > F.col("parent")).drop("parent")
        level = cut(standardised(cut(level.filter("z_score > 0"))))
        if level.isEmpty():
            break
        levels.append(level)
        longer = level.select("subsequence", F.col("z_score").alias("parent"), F.explode(F.array(*[F.lit(x) for x in alphabet])).alias("base"))
        candidates = cut(longer.select(F.concat("subsequence", "base").alias("subsequence"), "parent"))
    out = levels[0] if levels else cut(standardised(scored(candidates.limit(0).select("subsequence"), support(counts, min_length), ratios, lengths, total)))
    for level in levels[1:]:
        out = out.unionByName(level)
    return ranked(out)


def ranked(level: DataFrame) -> DataFrame:
    """Candidates with their rank. Scores count to nine places, as the last digits depend on the order of addition. Ranks come
    from a range-partitioned sort, not from one task."""
    order = F.struct((-F.round("normalized_z_score", 9)).alias("n"), (-F.round("z_score", 9)).alias("z"), (-F.col("observed_count")).alias("o"), F.col("subsequence").alias("s"))
    out = numbered(level.withColumn("_by", order), "_by", "rank")
    return out.select("rank", "subsequence", "length", "observed_count", "expected_fraction", "z_score", "normalized_z_score")


def seeds(candidates: DataFrame) -> DataFrame:
    """The ranked candidates that hold no earlier-ranked one.

    Every substring of a candidate is looked up by an equi-join instead of comparing all pairs.
    """
    inner = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("subsequence")), lambda n: F.transform(F.sequence(F.lit(1), F.length("subsequence") - n + 1), lambda i: F.substring("subsequence", i, n)))))
    parts = candidates.select(F.col("rank").alias("of"), F.explode(inner).alias("subsequence"))
    beaten = parts.join(candidates.select("subsequence", "rank"), "subsequence").filter("rank < of").select(F.col("of").alias("rank")).distinct()
    return candidates.join(beaten, "rank", "left_anti")


def assign(counts: DataFrame, candidates: DataFrame, key: str = "sequence") -> DataFrame:
    """(key, seed_rank, count): each sequence with the first remaining candidate that its region holds.

    Regions are cut into the lengths that occur among the candidates and joined on the strings.
    """
    left = seeds(candidates).select("rank", "subsequence")
    sizes = sorted(r["n"] for r in left.select(F.length("subsequence").alias("n")).distinct().collect())  # a few lengths
    pieces = F.array_distinct(F.concat(*[seq.kmers(F.col("region"), n) for n in sizes])) if sizes else F.array().cast("array<string>")
    held = counts.select(key, "count", F.explode(pieces).alias("subsequence")).join(left, "subsequence")
    return held.groupBy(key, "count").agg(F.min("rank").alias("seed_rank"))


def clusters(counts: DataFrame, candidates: DataFrame, key: str = "sequence") -> tuple[DataFrame, DataFrame]:
    """(assignments: key, cluster_id; seeds: cluster_id, seed_string, member_count, total_count). Ids follow the ranks."""
    given = cut(assign(counts, candidates, key))
    stats = given.groupBy("seed_rank").agg(F.count("*").alias("member_count"), F.sum("count").alias("total_count"))
    stats = stats.withColumn("cluster_id", F.row_number().over(Window.orderBy("seed_rank")) - 1)  # one row per seed
    out = given.join(_sent(stats.select("seed_rank", "cluster_id")), "seed_rank").select(key, "cluster_id")
    named = stats.join(candidates.select(F.col("rank").alias("seed_rank"), F.col("subsequence").alias("seed_string")), "seed_rank")
    return out, named.select("cluster_id", "seed_string", "member_count", "total_count")
