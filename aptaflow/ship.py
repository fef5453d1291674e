"""Python code of this package for the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).parent


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each Spark context; they need no installed copy and no common folder."""
    context = spark.sparkContext
    if getattr(context, "_aptaflow_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="aptaflow-")) / "aptaflow.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(_PACKAGE.rglob("*.py")):
            out.write(file, Path(_PACKAGE.name) / file.relative_to(_PACKAGE))
    context.addPyFile(str(path))
    context._aptaflow_shipped = True
