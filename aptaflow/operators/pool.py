"""The pool of unique sequences and their counts by selection round."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import numbered


def sequence_counts(accepted: DataFrame) -> DataFrame:
    """cycle_name, round, sequence, start_index, end_index, count of accepted reads."""
    return accepted.groupBy("cycle_name", "round", "sequence", "start_index", "end_index").agg(F.count("*").alias("count"))


def aptamers(accepted: DataFrame) -> DataFrame:
    """aptamer_id (1, 2, ... by sequence), sequence, start_index, end_index; of several bounds the smallest holds."""
    unique = accepted.groupBy("sequence").agg(F.min(F.struct("start_index", "end_index")).alias("b")).select("sequence", "b.start_index", "b.end_index")
    return numbered(unique, "sequence", "aptamer_id").select("aptamer_id", "sequence", "start_index", "end_index")


def cycle_counts(accepted: DataFrame, pool: DataFrame) -> DataFrame:
    """cycle_name, round, aptamer_id, count."""
    counted = accepted.groupBy("cycle_name", "round", "sequence").agg(F.count("*").alias("count"))
    return counted.join(pool.select("sequence", "aptamer_id"), "sequence").select("cycle_name", "round", "aptamer_id", "count")


def sizes(counts: DataFrame) -> DataFrame:
    """cycle_name, round, total_size, unique_size."""
    return counts.groupBy("cycle_name", "round").agg(F.sum("count").alias("total_size"), F.count("*").alias("unique_size"))


def abundance(counts: DataFrame, key: str = "sequence") -> DataFrame:
    """key with its count over all rounds."""
    return counts.groupBy(key).agg(F.sum("count").alias("total"))


def abundance_rank(counts: DataFrame, key: str = "sequence") -> DataFrame:
    """key, total and its rank from 1 by total, then key. Ranks come from a range-partitioned sort, not from one task."""
    total = abundance(counts, key).withColumn("_by", F.struct((-F.col("total")).alias("t"), F.col(key).alias("k")))
    return numbered(total, "_by", "abundance_rank").select(key, "total", "abundance_rank")


def cardinality(pool: DataFrame, counts: DataFrame, cycle_name: str, key: str = "sequence") -> DataFrame:
    """Each aptamer with its count in a round, 0 if it isn't there."""
    there = counts.filter(F.col("cycle_name") == cycle_name).groupBy(key).agg(F.sum("count").alias("count"))
    return pool.join(there, key, "left").select(key, F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def members(pool: DataFrame, counts: DataFrame, cycle_name: str, key: str = "sequence") -> DataFrame:
    """The aptamers that a round holds."""
    return pool.join(counts.filter(F.col("cycle_name") == cycle_name), key, "left_semi")


def lookup(sequences: DataFrame, pool: DataFrame) -> DataFrame:
    """sequences with the aptamer_id, -1 if the pool does not hold them."""
    return sequences.join(pool.select("sequence", "aptamer_id"), "sequence", "left").withColumn("aptamer_id", F.coalesce("aptamer_id", F.lit(-1)))


def neighbours(cycles: DataFrame) -> DataFrame:
    """Each round with the next and the previous one. There is one row per round, so one task holds them all."""
    rounds = cycles.select("round").distinct()
    w = Window.orderBy("round")
    return cycles.join(F.broadcast(rounds.select("round", F.lead("round").over(w).alias("next_round"), F.lag("round").over(w).alias("previous_round"))), "round")


def enrichment(counts: DataFrame, key: str = "sequence") -> DataFrame:
    """Count and share of each aptamer by round, and its fold change to the round before (null if it wasn't there)."""
    total = counts.groupBy("round").agg(F.sum("count").alias("size"))
    shares = counts.join(F.broadcast(total), "round").withColumn("proportion", F.col("count") / F.col("size"))
    before = F.broadcast(neighbours(total.select("round")).select("round", "previous_round"))
    now = shares.join(before, "round").select("cycle_name", "round", key, "count", "proportion", "previous_round")
    old = shares.select(F.col("round").alias("previous_round"), key, F.col("proportion").alias("old"))
    return now.join(old, [key, "previous_round"], "left").select("cycle_name", "round", key, "count", "proportion", (F.col("proportion") / F.col("old")).alias("fold_change"))


def observed_rounds(counts: DataFrame, key: str = "sequence") -> DataFrame:
    """Each aptamer with its (round, count) pairs in the order of rounds."""
    return counts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("round", "count"))).alias("observed"))
