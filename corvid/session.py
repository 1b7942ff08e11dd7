"""Making this library importable where Spark runs its Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, so that workers can import it from anywhere."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    path = Path(tempfile.mkdtemp(prefix="corvid-ship-")) / "corvid_package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(_ROOT.rglob("*.py")):
            out.write(file, str(file.relative_to(_ROOT.parent)))
    spark.sparkContext.addPyFile(str(path))
