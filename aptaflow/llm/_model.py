"""Helpers of the learned operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GRAIN = 1 << 30


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo by."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(by))


def bounded_sample(df: DataFrame, key: str, bound: int, seed: int = 11) -> DataFrame:
    """Rows of df by a hash of key, about bound of them, or all if there are no more than that."""
    n = df.count()
    if n <= bound:
        return df
    return df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(_GRAIN)) < F.lit(int(_GRAIN * bound / n)))
