"""The package's code on the executors, where it is not installed there."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import merchantry

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers once per application, through Spark's own files."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(merchantry.__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="code-"), "merchantry.zip")  # the driver serves it
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)
