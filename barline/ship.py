"""The package on Python workers: functions in it are pickled by reference, so workers must be able to import it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def archive() -> str:
    """The package's sources as a ZIP file on the driver."""
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="barline-ship-"), "barline.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    return path


def ship(spark: SparkSession) -> None:
    """Hand the package to the session's workers, once per application; installed clusters don't need it."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        spark.sparkContext.addPyFile(archive())
        _SHIPPED.add(app)
