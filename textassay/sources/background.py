"""Background tables as files: a file, a folder of files named by language, or Parquet by language."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fs import Folder
from ..operators.language import LanguageSet
from ..operators.layers import CountTable
from . import codec


def load(spark: SparkSession, path: str, languages: list[str] | None = None, alpha: float = 0.2) -> LanguageSet:
    """A set of languages from a table file or a folder of them, in the order of their names."""
    rows = codec.read_backgrounds(spark, path, languages)
    heads = rows.where("slot < 0").select("lang", "bits", "total").collect()
    if not heads:
        raise FileNotFoundError(f"no background tables at {path}")
    meta = {r["lang"]: (r["bits"], r["total"]) for r in sorted(heads, key=lambda r: r["lang"])}
    return LanguageSet(rows.where("slot >= 0").select("lang", "slot", "cnt"), meta, alpha)


_held: dict[str, tuple[float, CountTable]] = {}


def cached(spark: SparkSession, path: str) -> CountTable:
    """As ``read``, and kept until the file changes."""
    changed, key = os.stat(path).st_mtime, os.path.realpath(path)
    if key not in _held or _held[key][0] != changed or _held[key][1].counts.sparkSession is not spark:
        _held[key] = (changed, read(spark, path))
        _held[key][1].counts.persist()
    return _held[key][1]


def read(spark: SparkSession, path: str) -> CountTable:
    with open(path, "rb") as f:
        return codec.table_of(spark, codec.decode_background(f.read()))


def write(table: CountTable, path: str) -> None:
    """One table file, complete or not at all."""
    os.makedirs(os.path.dirname(path) or ".", 0o755, exist_ok=True)
    data, temp = codec.encode_background(table), f"{path}.part"
    try:
        with open(temp, "wb") as f:
            f.write(data)
        os.replace(temp, path)
    finally:
        if os.path.exists(temp):
            os.unlink(temp)


def publish(languages: LanguageSet, path: str) -> None:
    """A table file for each language, in a folder that Spark reads."""
    folder = Folder(languages.tables.sparkSession, path)
    folder.make()
    for lang in languages.meta:
        folder.put(f"{lang}.bin", codec.encode_background(languages.select(lang)))


def write_parquet(languages: LanguageSet, path: str) -> None:
    """Tables in a folder a language, so a reader of a few languages opens only theirs."""
    meta = languages.tables.sparkSession.createDataFrame([(k, n, b, t) for n, (k, (b, t)) in enumerate(languages.meta.items())], "lang string, place int, bits int, total long")
    meta.coalesce(1).write.parquet(f"{path}/meta")
    languages.tables.repartition("lang").write.partitionBy("lang").parquet(f"{path}/tables")


def read_parquet(spark: SparkSession, path: str, languages: list[str] | None = None, alpha: float = 0.2) -> LanguageSet:
    meta = spark.read.parquet(f"{path}/meta")
    tables: DataFrame = spark.read.schema("slot long, cnt long, lang string").parquet(f"{path}/tables").select("lang", "slot", "cnt")
    if languages is not None:
        meta, tables = meta.where(F.col("lang").isin(languages)), tables.where(F.col("lang").isin(languages))
    rows = meta.orderBy("place").collect()
    return LanguageSet(tables, {r["lang"]: (r["bits"], r["total"]) for r in rows}, alpha)
