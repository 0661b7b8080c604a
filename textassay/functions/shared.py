"""Results that are used more than once, kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    ``spark.checkpoint.dir`` is taken from the session; only where it is unset,
    as in tests on one machine, a temporary folder is named instead.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = getattr(spark.sparkContext, "_textassay_folder", None) or tempfile.mkdtemp(prefix="textassay-")
        spark.sparkContext._textassay_folder = folder
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and cut its lineage (reliable checkpoint)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: Bytes a core below which a table's rows are dealt out anew before costly work on each.
SPREAD_BYTES = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table's rows over all cores: a file of one row group is read by one task, however many cores there are.

    Larger tables are read by many tasks as they are, and are not moved.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df
