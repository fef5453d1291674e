"""A corpus pipeline: language, near copies, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to the folder that the cluster
shares and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aptaflow.llm import decontaminate, langid, ngram_join, packing, pii
from aptaflow.llm._store import cut

STAGES = [
    ("language_id", langid.stage),
    ("near_copies", ngram_join.stage),
    ("decontamination", decontaminate.stage),
    ("pii", pii.stage),
    ("packing", packing.stage),
]

#: SQL can express neither the learned language model nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
