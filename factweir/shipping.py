"""Gives executors this package, for functions that run in Python workers."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_NAME = "factweir-package.zip"
#: Rows and bytes of an Arrow batch of whole texts.
TEXT_ROWS, TEXT_BYTES = 500, 8 << 20


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once; Spark's file server hands it to executors."""
    context = spark.sparkContext
    if any(str(f).endswith(_NAME) for f in context._python_includes):
        return
    archive = Path(tempfile.mkdtemp(prefix="factweir-ship-")) / _NAME
    top = Path(__file__).resolve().parent
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(str(archive))


def ship_for_texts(spark: SparkSession) -> None:
    """`ship`, for functions over whole texts: bounds Arrow batches by rows and bytes, so that a worker's memory doesn't
    grow with a partition. Smaller bounds of the session stay; the settings stay, as results are computed later.
    """
    for name, most in (("maxRecordsPerBatch", TEXT_ROWS), ("maxBytesPerBatch", TEXT_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        size = re.fullmatch(r"(-?[0-9]+)([kmgtp]?)b?", spark.conf.get(name).strip().lower())
        if not size or not 0 < int(size[1]) << 10 * " kmgtp".index(size[2] or " ") <= most:
            spark.conf.set(name, str(most))
    ship(spark)
