"""Experiments as Parquet tables, partitioned by experiment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("aptamers", "cycle_counts", "parser_stats", "structures", "cluster_assignments", "fsbc_strings", "motifs")


def write(df: DataFrame, base: str, table: str, experiment_id: int) -> None:
    """Replace one experiment's part of a table."""
    if table not in TABLES:
        raise ValueError(f"unknown table {table}")
    df.write.mode("overwrite").parquet(f"{base}/{table}/experiment_id={experiment_id}")


def read(spark: SparkSession, base: str, table: str, experiment_id: int | None = None) -> DataFrame:
    """A table, of one experiment if its id is given; other experiments' files are then not read."""
    df = spark.read.option("basePath", f"{base}/{table}").parquet(f"{base}/{table}")
    return df if experiment_id is None else df.filter(F.col("experiment_id") == experiment_id)
