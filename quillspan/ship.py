"""Sends the package to the executors, so that their Python workers can import it wherever the driver runs."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Once for each application; the driver's file server hands the archive to new executors too."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return spark
    root = os.path.dirname(os.path.abspath(__file__))
    fd, name = tempfile.mkstemp(prefix="quillspan-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join("quillspan", os.path.relpath(path, root)))
    sc.addPyFile(name)
    atexit.register(lambda: os.path.exists(name) and os.remove(name))  # served from there until then
    _SENT.add(sc.applicationId)
    return spark
