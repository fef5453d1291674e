"""What the operators share: the folder of intermediate tables, and Arrow functions that leave a worker's memory clean."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..ship import ship
from ..store import cut, drop, shared_dir  # noqa: F401

#: Tables that a Python worker keeps from task to task, by owner. A task of another owner drops them.
_KEPT: dict[str, dict] = {}


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets(df: DataFrame) -> int:
    """How many parts to deal df to, by the planner's figure of its size: 512 at most of 8 MB, then of 64 MB. A source that does
    not know its size is dealt to twice the shuffle partitions.

    Each batch of rows sends a row to each part, so parts follow the data, not the number of tasks that a session likes.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        return 2 * partitions(df.sparkSession)
    return max(12, min(512, size >> 23), size >> 26)


def kept(owner: str) -> dict:
    """The worker's table of an owner."""
    return _KEPT.setdefault(owner, {})


def _drop_others(owner: str | None) -> None:
    for name in [x for x in _KEPT if x != owner]:
        del _KEPT[name]


def _release() -> None:
    """Give free memory back to the system, which else keeps counting against the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        import ctypes

        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, owner: str | None = None) -> DataFrame:
    """mapInArrow with this package on the executors.

    Workers serve many tasks: what another owner's tasks have kept goes before this one begins, and what it has freed is
    given back after it ends, so that the operators of a pipeline do not add up in one worker.
    """
    ship(df.sparkSession)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _drop_others(owner)
        try:
            yield from run(batches)
        finally:
            _release()

    return df.mapInArrow(clean, schema)
