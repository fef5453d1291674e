"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only in a local session that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="aptaflow-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def _folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when the application ends."""
    context = spark.sparkContext
    path = f"{shared_dir(spark)}/aptaflow-{context.applicationId}"
    if path not in context.__dict__.setdefault("_aptaflow_folders", set()):
        context._aptaflow_folders.add(path)
        there = context._jvm.org.apache.hadoop.fs.Path(path)
        files = there.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(there)
        files.deleteOnExit(there)
    return path


def _written(df: DataFrame) -> str:
    path = f"{_folder(df.sparkSession)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again; it ends the lineage and survives lost executors."""
    path = _written(df)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._aptaflow_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the table of cut() that df reads, once nothing is to read it again."""
    there = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._aptaflow_path)
    there.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(there, True)


def memo(spark: SparkSession, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """make() written the first time that a key is asked for in an application, and read from then on."""
    kept = spark.sparkContext.__dict__.setdefault("_aptaflow_tables", {})
    if key not in kept:
        df = make()
        kept[key] = _written(df), df.schema
    path, schema = kept[key]
    return spark.read.schema(schema).parquet(path)


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """df with 1, 2, ... in the order of ``by``, whose values are distinct, without a sort in one task.

    Rows are range-partitioned and sorted; the number is the rank within the partition plus the sizes of the partitions before
    it, a table of one row per partition. The sorted rows are written first, as another run could draw other bounds.
    """
    names = df.columns
    ordered = df.repartitionByRange(by).sortWithinPartitions(by).withColumn("_at", F.monotonically_increasing_id())
    ordered = cut(ordered.withColumns({"_part": F.shiftright("_at", 33), "_rank": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return ordered.join(F.broadcast(offsets), "_part").select(*names, (F.col("_before") + F.col("_rank") + 1).cast("int").alias(name))
