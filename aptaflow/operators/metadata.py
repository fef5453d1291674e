"""Read metadata: quality and base distributions by position, lengths, base ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seq


def _letters(df: DataFrame, column: str, keep: list[str], name: str) -> DataFrame:
    letters = F.filter(F.split(F.col(column), "", -1), lambda c: c != "")
    return df.select(*keep, F.posexplode(letters).alias("position", name))


def quality(accepted: DataFrame, column: str = "fwd_qual") -> DataFrame:
    """Mean, sample variance and deviation of the quality by cycle and position (null for one read)."""
    q = _letters(accepted, column, ["cycle_name"], "q").withColumn("q", seq.phred(F.col("q")).cast("double"))
    return q.groupBy("cycle_name", "position").agg(F.avg("q").alias("mean"), F.var_samp("q").alias("variance"), F.stddev_samp("q").alias("stddev"), F.count("*").alias("count"))


def bases(accepted: DataFrame, column: str = "fwd", seeded: bool = False) -> DataFrame:
    """Reads by cycle, position and base. seeded: A, C, G, T and N have rows of 0 where they do not occur."""
    out = _letters(accepted, column, ["cycle_name"], "base").groupBy("cycle_name", "position", "base").agg(F.count("*").alias("count"))
    if not seeded:
        return out
    every = out.select("cycle_name", "position", F.explode(F.array(*[F.lit(x) for x in "ACGTN"])).alias("base"), F.lit(0).cast("long").alias("count"))
    return out.unionByName(every).groupBy("cycle_name", "position", "base").agg(F.sum("count").alias("count"))


def transcribed(reads: DataFrame) -> DataFrame:
    """reads with the reverse reads as they stand on the forward strand: rev as its reverse complement, rev_qual reversed."""
    return reads.withColumns({"rev": seq.reverse_complement(F.col("rev")), "rev_qual": F.reverse("rev_qual")})


def region_bases(counts: DataFrame) -> DataFrame:
    """Accepted reads by cycle, region size, position and base, from counted sequences (cycle_name, region, count)."""
    rows = _letters(counts.withColumn("region_size", F.length("region")), "region", ["cycle_name", "region_size", "count"], "base")
    return rows.groupBy("cycle_name", "region_size", "position", "base").agg(F.sum("count").alias("count"))


def lengths(counts: DataFrame, column: str = "region") -> DataFrame:
    return counts.groupBy(F.length(column).alias("length")).agg(F.sum("count").alias("count"))


def base_ratios(counts: DataFrame, column: str = "region") -> DataFrame:
    """(base, ratio): the share of each base, weighted by counts. The bases are counted within each row first."""
    kinds = F.array(*[F.struct(F.lit(b).alias("base"), (F.length(column) - F.length(F.replace(F.col(column), F.lit(b), F.lit("")))).alias("n")) for b in "ACGTU"])
    rows = counts.select("count", F.explode(kinds).alias("b")).groupBy("b.base").agg(F.sum(F.col("b.n") * F.col("count")).alias("n")).filter("n > 0")
    return rows.select("base", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("ratio"))  # five rows at most
