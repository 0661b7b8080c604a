"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import cut, shared_folder
from ..functions.ship import BATCH_ROWS, bounded_batches, ship

__all__ = ["BATCH_ROWS", "batches_of", "bounded_batches", "cut", "literal_rows", "shared_folder", "ship", "table", "text_of"]

@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows at most for what runs inside; the session's own setting stands again behind it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_of(name: str = "text") -> Column:
    """A text column where null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_rows(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small constant table as a JVM-side relation (SQL VALUES)."""

    def lit(x) -> str:
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(x, str) else repr(x)

    values = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")
