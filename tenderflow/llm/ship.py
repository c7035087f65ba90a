"""The library's own code, sent to the tasks that run its Python functions."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

import tenderflow

#: by application the folder its tasks fetch the code from, which goes when the driver ends
_sent: dict[str, tempfile.TemporaryDirectory] = {}


def ship_code(spark: SparkSession) -> None:
    """Let the workers of this application import the library, wherever it lies."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(tenderflow.__file__)))
    folder = tempfile.TemporaryDirectory(prefix="run-")
    packed = os.path.join(folder.name, "tenderflow")
    context.addPyFile(shutil.make_archive(packed, "zip", root, "tenderflow"))
    _sent[context.applicationId] = folder
