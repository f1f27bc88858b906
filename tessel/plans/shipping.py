"""Sending this package to the executors, so that a job needs no installation on them."""

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add the package to the session's Python files, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="tessel-package-")) / "tessel.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for f in sorted(root.rglob("*.py")):
                out.write(f, f"{root.name}/{f.relative_to(root)}")
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)
    return spark
