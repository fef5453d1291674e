"""Running counts of sequences while reads arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import importer


def running_counts(reads: DataFrame, config: importer.Config) -> DataFrame:
    """Counts by cycle and sequence of a stream of reads (cycle_name, fwd), for update or complete mode."""
    parsed = importer.parse_exact(reads, config).filter(F.col("outcome") == importer.ACCEPTED)
    return parsed.groupBy("cycle_name", "sequence").agg(F.count("*").alias("count"))
