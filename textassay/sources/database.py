"""Counts kept in a database: read over JDBC into a store, and written back.

Two tables, as other implementations keep them: ``<prefix>counts`` (feature, count_ham,
count_spam, archive_ham, archive_spam), where feature is a slot, and ``<prefix>meta``
(name, value). Any database whose driver Spark has works; rows are read in parallel by
ranges of slots.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import HASH_VERSION
from .store import COUNTERS, SCHEMA_VERSION, CountStore

#: Parts in which a count table is read.
PARTS = 8
_NUMBERS = ("texts_ham", "texts_spam", "archive_texts_ham", "archive_texts_spam", "learned_ham", "learned_spam", "generation", "version")


class Database:
    """Tables with a prefix at a JDBC address; ``options`` go to Spark's reader and writer (driver, user, password)."""

    def __init__(self, spark: SparkSession, url: str, prefix: str = "", **options: str) -> None:
        if not re.fullmatch(r"\w*", prefix, re.ASCII):
            raise ValueError("a prefix is made of letters, digits and underscores")
        self.spark, self.url, self.prefix, self.options = spark, url, prefix, options

    def _name(self, table: str) -> str:
        return f"{self.prefix}{table}"

    def meta(self) -> dict[str, int]:
        """The whole numbers of the meta table, schema and hash version checked."""
        rows = self.spark.read.format("jdbc").options(url=self.url, dbtable=self._name("meta"), **self.options).load().collect()
        meta = {str(r[0]).strip(): str(r[1]).strip() for r in rows}
        for name, wanted in (("schema", SCHEMA_VERSION), ("hash", HASH_VERSION)):
            if meta.get(name) != str(wanted):
                raise RuntimeError(f"the tables have {name} {meta.get(name)}, this is {wanted}")
        return {name: int(meta.get(name, 0)) for name in ("bits", *_NUMBERS)}

    def counts(self, bits: int) -> DataFrame:
        """(slot, count_ham, count_spam, archive_ham, archive_spam), read by ranges of slots."""
        reader = self.spark.read.format("jdbc").options(url=self.url, dbtable=self._name("counts"), **self.options)
        rows = reader.options(partitionColumn="feature", lowerBound="0", upperBound=str(1 << bits), numPartitions=str(PARTS)).load()
        rows = rows.toDF(*[c.lower() for c in rows.columns])
        return rows.select(F.col("feature").cast("long").alias("slot"), *[F.greatest(F.col(c).cast("long"), F.lit(0)).alias(c) for c in COUNTERS])

    def load_into(self, path: str) -> CountStore:
        """A new store in a folder with the counters and numbers of the tables."""
        meta = self.meta()
        store = CountStore(self.spark, path).install(meta["bits"])
        return store.take_over(self.counts(meta["bits"]), {name: meta[name] for name in _NUMBERS})

    def save(self, store: CountStore) -> None:
        """The newest version of a store, in place of what the tables hold."""
        meta = store.meta()
        rows = [(name, str(meta[name])) for name in ("bits", "schema", "hash", *_NUMBERS)]
        write = lambda df, table, types: df.write.format("jdbc").mode("overwrite").options(url=self.url, dbtable=self._name(table), createTableColumnTypes=types, **self.options).save()
        write(store.counts(meta).withColumnRenamed("slot", "feature"), "counts", "feature BIGINT")
        write(self.spark.createDataFrame(rows, "name string, value string"), "meta", "name VARCHAR(32), value VARCHAR(64)")
