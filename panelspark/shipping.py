"""Makes this package importable in Python workers."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once for each application, unless PYTHONPATH already gives it to them."""
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    context = spark.sparkContext
    if getattr(context, "_panelspark_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="panelspark-code-")
    name = Path(folder) / "panelspark_code.zip"
    with zipfile.ZipFile(name, "w") as z:
        for path in sorted(Path(__file__).resolve().parent.rglob("*.py")):
            z.write(path, path.relative_to(ROOT))
    here = list(sys.path)
    context.addPyFile(str(name))
    sys.path[:] = here  # the driver goes on with the sources
    context._panelspark_shipped = True
