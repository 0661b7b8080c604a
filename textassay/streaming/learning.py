"""Learning from and scoring of streams of texts, in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.shared import cut
from ..operators.features import packed
from ..params import ExtractParams
from ..plans.model import EvidenceModel
from ..sources.store import CountStore


def labelled_events(batch: DataFrame, params: ExtractParams, mode: str, last_rotation: str | None = None, time: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Steps and texts for ``CountStore.apply_events`` of (doc_id, text, label[, sign][, ts]) rows.

    Every row is a step of its own, rows of one id and equal rows too: rows are numbered in
    the order of their ids (of one id: learning first, then by class; those alike in all this
    move the same counters the same way, so their order changes nothing), and the
    number goes through extraction with them. Events have packed bags. Texts dated before the last rotation go to the
    archive.
    """
    sign = F.col("sign") if "sign" in batch.columns else F.lit(1)
    late = (F.col(time) < F.lit(last_rotation).cast("timestamp")) if last_rotation and time in batch.columns else F.lit(False)
    rows = batch.select("doc_id", "text", "label", sign.cast("int").alias("sign"), F.coalesce(late, F.lit(False)).alias("archive"))
    rows = cut(rows.orderBy("doc_id", F.desc("sign"), "label", "archive").withColumn("seq", F.monotonically_increasing_id()))
    return packed(rows, "seq", "label", "sign", "archive", params=params, mode=mode), rows.drop("text")


def learn_batch(store: CountStore, params: ExtractParams | None = None, mode: str = "xxh3", last_rotation: str | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch is one commit, marked with its number, so a batch that is sent again changes nothing."""

    def run(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            if not held.isEmpty():
                events, rows = labelled_events(held, params or ExtractParams(), mode, last_rotation)
                store.apply_events(events, number, rows)
        finally:
            held.unpersist()

    return run


def learn_stream(texts: DataFrame, store: CountStore, checkpoint: str, params: ExtractParams | None = None, mode: str = "xxh3", last_rotation: str | None = None) -> StreamingQuery:
    """Learn a stream of (doc_id, text, label) into a store until the stream has no more."""
    return texts.writeStream.foreachBatch(learn_batch(store, params, mode, last_rotation)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def classify_stream(texts: DataFrame, model: Callable[[], EvidenceModel], path: str, checkpoint: str) -> StreamingQuery:
    """Score a stream with the newest model at each batch, into Parquet folders by batch number, which a repeated batch replaces."""

    def run(batch: DataFrame, number: int) -> None:
        model().classify(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return texts.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
