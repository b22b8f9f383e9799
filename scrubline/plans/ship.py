"""Make this package importable on executors that don't have it on their Python path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_SENT: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package as a zip file, once for each application, unless PYTHONPATH already names its folder."""
    context = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or context.applicationId in _SENT:
        return spark
    to = Path(tempfile.mkdtemp(prefix="scrubline-")) / "scrubline.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted((ROOT / "scrubline").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    context.addPyFile(str(to))
    _SENT.add(context.applicationId)
    return spark
