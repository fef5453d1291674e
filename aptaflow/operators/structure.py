"""Secondary structure of distinct sequences in Arrow functions: minimum energy, pair probabilities, context profiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import folding
from ..ship import ship

#: Sequences folded together at most, and numbers in one of their tables; each cell of a table holds one for each sequence.
BATCH, NUMBERS = 512, 1 << 22


def _by_length(df: DataFrame, column: str, run: Callable[[list[str]], list[tuple]], kinds: dict[str, pa.DataType], schema: str) -> DataFrame:
    """run over batches of distinct sequences of one length, which sorting by length brings together.

    Sequences with other letters than A, C, G, T and U have no structure here and give no row, nor do null and empty ones.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(column).alias("sequence")).filter(F.col(column).rlike("^[ACGTUacgtu]+$")).distinct()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups: dict[int, list[str]] = {}
            for s in b.column(0).to_pylist():
                groups.setdefault(len(s), []).append(s)
            for same in groups.values():
                step = max(1, min(BATCH, NUMBERS // len(same[0]) ** 2))
                for k in range(0, len(same), step):
                    some = same[k : k + step]
                    made = run(some)
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *[pa.array([x[i] for x in made], t) for i, t in enumerate(kinds.values())]], names=["sequence", *kinds])

    return rows.repartition("sequence").sortWithinPartitions(F.length("sequence")).mapInArrow(each, f"sequence string, {schema}")


def mfe(df: DataFrame, column: str = "sequence", dangles: int = 1) -> DataFrame:
    """sequence, structure, mfe. dangles: see functions.folding."""
    return _by_length(df, column, lambda s: folding.mfe(s, dangles), {"structure": pa.string(), "mfe": pa.float64()}, "structure string, mfe double")


def bppm(df: DataFrame, column: str = "sequence", dangles: int = 2) -> DataFrame:
    """sequence and the upper triangle of its pair probabilities without the diagonal, row by row."""
    import numpy as np

    def run(some: list[str]) -> list[tuple]:
        pairs, _ = folding.probabilities(some, dangles)
        at = np.triu_indices(pairs.shape[1], 1)
        return [(x[at].tolist(),) for x in pairs]

    return _by_length(df, column, run, {"bppm": pa.list_(pa.float64())}, "bppm array<double>")


def profiles(df: DataFrame, column: str = "sequence", dangles: int = 2) -> DataFrame:
    """sequence and its profile: hairpin, bulge, interior, multiple loop, outside, each for all places."""

    def run(some: list[str]) -> list[tuple]:
        return [(x.ravel().tolist(),) for x in folding.probabilities(some, dangles)[1]]

    return _by_length(df, column, run, {"profile": pa.list_(pa.float64())}, "profile array<double>")
