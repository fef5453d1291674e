"""A selection experiment derived from the TPC-H-like tables, the same in Spark and in SQL.

A line item is a read of the sequence of its part, its ship year the selection round. Reads are spoiled by order key in ways
that each lead to another outcome. See FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seq
from ..operators import importer, pool
from ..store import memo

P5, P3 = "GATACGCATT", "CTTGACCAGT"
MOTIF = "TTGGAACC"
SIZE = 20
FIRST_YEAR = 1995
CONFIG = importer.Config(five_prime=P5, three_prime=P3, exact_size=SIZE, primer_tolerance=0)


def sequence_of(key) -> F.Column:
    return F.translate(F.md5(key.cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_partkey, l_orderkey, cycle_name, round, region, fwd, fwd_qual: a table of its own, made once in an application."""
    return memo(spark, ("reads", sf_dir), lambda: _reads(spark, sf_dir))


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_orderkey", F.year("l_shipdate").alias("cyc"))
    whole = sequence_of(F.col("l_partkey"))
    items = items.withColumns({"whole": whole, "cycle_name": F.col("cyc").cast("string"), "round": (F.col("cyc") - FIRST_YEAR).cast("int")})
    region = F.when(F.col("l_partkey") % 5 == 0, F.concat(F.substring("whole", 1, 6), F.lit(MOTIF), F.substring("whole", 15, 6))).otherwise(F.substring("whole", 1, SIZE))
    r, kind = F.col("region"), F.col("l_orderkey") % 10
    fwd = (
        F.when(kind == 0, F.concat(F.lit(P5 + "N"), F.substring("region", 2, SIZE), F.lit(P3)))
        .when(kind == 1, F.concat(r, F.lit(P3)))
        .when(kind == 2, F.concat(F.lit(P5), r))
        .when(kind == 3, F.concat(F.lit(P5), F.substring("region", 1, 15), F.lit(P3)))
        .when(kind == 4, seq.reverse_complement(F.concat(F.lit(P5), r, F.lit(P3))))
        .otherwise(F.concat(F.lit(P5), r, F.lit(P3)))
    )
    m = F.md5(F.col("l_orderkey").cast("string").cast("binary"))
    out = items.withColumn("region", region).withColumn("fwd", fwd)
    return out.withColumn("fwd_qual", F.substring(F.concat(m, m), F.lit(1), F.length("fwd"))).select("l_partkey", "l_orderkey", "cycle_name", "round", "region", "fwd", "fwd_qual")


def parsed(spark: SparkSession, sf_dir: str, config: importer.Config = CONFIG) -> DataFrame:
    return importer.parse_exact(reads(spark, sf_dir), config)


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).filter(F.col("outcome") == importer.ACCEPTED)


def aptamers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memo(spark, ("aptamers", sf_dir), lambda: pool.aptamers(accepted(spark, sf_dir)))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cycle_name, round, sequence, start_index, end_index, region, count, made once in an application."""
    region = F.expr("substring(sequence, start_index + 1, end_index - start_index)")
    return memo(spark, ("counts", sf_dir), lambda: pool.sequence_counts(accepted(spark, sf_dir)).withColumn("region", region))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct regions with their profiles."""
    return memo(spark, ("regions", sf_dir), lambda: structures(counts(spark, sf_dir).select("region").distinct()))


def structures(distinct_regions: DataFrame) -> DataFrame:
    """region with a profile of five values for each place, drawn from md5 (context-major, length of the region)."""
    value = lambda c: F.transform(F.sequence(F.lit(1), F.length("region")), lambda p: (F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(F.concat("region", F.lit(c)).cast("binary")), p, F.lit(1))) - 1) / 100.0)
    return distinct_regions.withColumn("profile", F.flatten(F.array(*[value(c) for c in seq.CONTEXTS])))


# The same in SQL: a prefix of common table expressions for the twins of the queries.
SQL = f"""
base AS (
  SELECT l_partkey, l_orderkey, year(l_shipdate)::INT AS cyc, year(l_shipdate)::VARCHAR AS cycle_name, (year(l_shipdate) - {FIRST_YEAR})::INT AS round,
         translate(md5(l_partkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT') AS whole FROM lineitem),
regions AS (SELECT *, CASE WHEN l_partkey % 5 = 0 THEN substr(whole, 1, 6) || '{MOTIF}' || substr(whole, 15, 6) ELSE substr(whole, 1, {SIZE}) END AS region FROM base),
raw AS (
  SELECT *, CASE l_orderkey % 10
      WHEN 0 THEN '{P5}N' || substr(region, 2, {SIZE}) || '{P3}'
      WHEN 1 THEN region || '{P3}'
      WHEN 2 THEN '{P5}' || region
      WHEN 3 THEN '{P5}' || substr(region, 1, 15) || '{P3}'
      WHEN 4 THEN translate(reverse('{P5}' || region || '{P3}'), 'ACGT', 'TGCA')
      ELSE '{P5}' || region || '{P3}' END AS fwd, md5(l_orderkey::VARCHAR) AS m FROM regions),
reads AS (SELECT l_partkey, l_orderkey, cycle_name, round, region, fwd, substr(m || m, 1, length(fwd)) AS fwd_qual FROM raw),
accepted AS (SELECT *, fwd AS sequence FROM reads WHERE l_orderkey % 10 >= 5),
counts AS (SELECT cycle_name, round, sequence, substr(sequence, 11, {SIZE}) AS region, count(*) AS count FROM accepted GROUP BY ALL),
aptamers AS (SELECT row_number() OVER (ORDER BY sequence)::INT AS aptamer_id, sequence, 10 AS start_index, 30 AS end_index FROM (SELECT DISTINCT sequence FROM accepted))
"""


def twin(select: str, *more: str, recursive: bool = False) -> str:
    """SQL over the derived experiment: further common table expressions, then the SELECT."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{','.join([SQL.strip(), *(m.strip() for m in more)])}\n{select.strip()}"
