"""Sending the package to Python workers, which need not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once a context: a zip of the package goes to all workers."""
    context = spark.sparkContext
    if not getattr(context, "_skein_sent", False):
        package = Path(__file__).resolve().parent.parent
        with zipfile.ZipFile(Path(tempfile.mkdtemp()) / "skein.zip", "w") as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, source.relative_to(package.parent))
        context.addPyFile(z.filename)
        context._skein_sent = True
