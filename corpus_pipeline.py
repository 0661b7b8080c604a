"""A training-data pipeline over ``documents``, from stages of textassay.llm.

toxicity -> near duplicates -> secrets -> mixing -> packing. Each stage takes
(spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents, so a stage can be left out or run alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textassay.functions.fs import Folder
from textassay.llm import mixing, packing, secret_scan, similar, toxicity
from textassay.llm.common import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model calls toxic go; all others stay unchanged."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest id stays: texts that SimHash links, and those whose five-word shingles overlap by 0.8."""
    return similar.one_of_each(docs, fingerprints=True)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; every document stays, n_chars follows its text."""
    masked = secret_scan.mask(docs)
    return masked.withColumn("n_chars", F.coalesce(F.char_length("text"), F.col("n_chars")).cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, cut at each source's budget."""
    return mixing.copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length; no sequence crosses documents. row_id tells the copies of a document apart."""
    packed = packing.pieces(docs)
    return packed.select("doc_id", "row_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("secrets", mask_secrets), ("mixing", mix_sources), ("packing", pack)]

#: Fitting a model and encoding tokens are beyond SQL; a brute-force version stands in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again.

    A stage's folder goes when the next one stands, the last one's at the end of the application.
    """
    folder = Folder(spark, f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}")
    folder.delete_on_exit()
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder.path}/{name}")
        docs = spark.read.parquet(f"{folder.path}/{name}")
        if before:
            folder.delete(before)
        before = name
    return docs
