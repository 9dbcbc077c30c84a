"""Makes this package importable on executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors of the application, once.

    Python functions of a plan refer to their module by name, so workers must be able to import it, wherever the
    driver was started and whatever their own search path is.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="terralift-")) / "terralift.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
        if (pipeline := root.parent / "corpus_pipeline.py").exists():
            out.write(pipeline, pipeline.name)
    context.addPyFile(str(path))
    _SHIPPED.add(context.applicationId)
