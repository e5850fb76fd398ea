"""Makes the package importable in Python workers, wherever the driver was started."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the session's Python files, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_presswork_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    package = os.path.basename(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), f"{package}.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(os.path.join(root, package)):
            for name in names:
                if not name.endswith((".pyc", ".pyo")):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, root))
    context.addPyFile(path)
    context._presswork_shipped = True
