"""Python workers need this package too: send it along once per application."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Add the package's modules to the session's Python files, so that executors need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_textassay_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="textassay-"), "textassay_modules.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(_ROOT.rglob("*.py")):
            z.write(file, f"{_ROOT.name}/{file.relative_to(_ROOT)}")
    context.addPyFile(path)
    context._textassay_shipped = True


#: Rows that go to a Python worker at once: whole texts can be long.
BATCH_ROWS = 512


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Ready a session for operators in Python: send the modules along, keep Arrow batches of whole texts small.

    A smaller batch size that is set already is left alone.
    """
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    current = int(spark.conf.get(key, "0") or 0)
    if current <= 0 or current > rows:
        spark.conf.set(key, str(rows))
