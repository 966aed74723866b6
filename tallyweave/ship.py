"""Makes this package importable for Python workers that start elsewhere."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers once a context, unless their PYTHONPATH has it already."""
    context = spark.sparkContext
    if context.applicationId in _sent or str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    # Executors fetch the archive from the driver when they need it, so it stays until the driver ends.
    folder = tempfile.mkdtemp(prefix="tallyweave-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{folder}/tallyweave", "zip", ROOT, "tallyweave"))
    _sent.add(context.applicationId)
