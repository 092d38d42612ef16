"""Send this package to the executors, so that Python tasks run from any folder."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path
from threading import Lock

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()
_adding = Lock()


def ship(spark: SparkSession) -> None:
    """Add the package's modules to the session, once per application."""
    context = spark.sparkContext
    with _adding:
        if context.applicationId in _shipped:
            return
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as out:
            for path in sorted(PACKAGE.rglob("*.py")):
                out.write(path, path.relative_to(PACKAGE.parent))
        path = Path(tempfile.mkdtemp(prefix="run-")) / f"{PACKAGE.name}.zip"
        path.write_bytes(packed.getvalue())
        context.addPyFile(str(path))
        _shipped.add(context.applicationId)
