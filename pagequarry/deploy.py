"""Ships the package to the executors of a session that was not started with it on its path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package as a zip, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="pagequarry-code-")) / "pagequarry.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"pagequarry/{f.relative_to(root)}")
    sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)
