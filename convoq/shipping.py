"""Python workers get this package from the driver, so that nothing has to be installed on executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="convoq-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors fetch it as long as the application runs
    path = os.path.join(folder, "convoq.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for where, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(where, n)
                    z.write(full, os.path.join("convoq", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
