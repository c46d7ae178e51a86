"""Getting this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once for a context, so that they need no path of ours."""
    context = spark.sparkContext
    if getattr(context, "_webloom_shipped", False):
        return
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="webloom-")), "webloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(_PACKAGE.rglob("*.py")):
            archive.write(file, file.relative_to(_PACKAGE.parent))
    context.addPyFile(path)
    context._webloom_shipped = True
