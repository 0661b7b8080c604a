"""A versioned store of counts with learning, exact unlearning and a two-generation decay.

A store is a folder: ``counts/v=N`` holds the counters of version N as Parquet,
``meta/N.json`` its text counts and generation. A version is complete once its
meta file stands, which is written last and never replaced, so readers see a whole
version and of two writers that start from the same version one is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.fs import Folder
from ..functions.hashing import HASH_VERSION, slot
from ..functions.ranges import place_among, quantiles
from ..functions.shared import cut
from ..functions.ship import bounded_batches
from ..operators.features import unpacked
from ..operators.layers import Layer
from ..params import MIN_STORE_BITS, check_bits

SCHEMA_VERSION = 1
COUNTERS = ("count_ham", "count_spam", "archive_ham", "archive_spam")
_TEXTS = ("texts_ham", "texts_spam", "archive_texts_ham", "archive_texts_spam", "learned_ham", "learned_spam")
#: Texts of a part in the running sums of ``apply_events``, about, and most parts.
PART, MOST_PARTS = 4096, 256
#: Texts of a part, at least, where whole bags are folded in order: a part gives a row a slot and counter at most.
BAGS_A_PART = 16384


@dataclass(frozen=True)
class Tally:
    """Rotations so far, texts in the recent generation, and texts ever learned."""

    generation: int
    recent_spam: int
    recent_ham: int
    learned_spam: int
    learned_ham: int


class Storage(Protocol):
    """What learning needs of a store."""

    def load(self) -> Layer: ...
    def apply(self, hashed: DataFrame, label: str, sign: int, texts: int, archive: bool) -> int: ...
    def rotate(self) -> None: ...
    def tally(self) -> Tally: ...
    def version(self) -> int: ...
    def identity(self) -> str: ...


class ConcurrentWriteError(RuntimeError):
    """Another writer was faster; read the new version and try again."""


def moved(x0, total, low):
    """The counter after a run of clamped steps: ``total`` is the sum of all, ``low`` the lowest running sum."""
    return F.greatest(x0 + total, total - low)


def rotated(counts: DataFrame) -> DataFrame:
    """The archive halves and takes in the recent counters, which start again at 0; empty rows go."""
    aged = {f"archive_{c}": (F.shiftright(f"archive_{c}", 1) + F.col(f"count_{c}")) for c in ("ham", "spam")}
    out = counts.select("slot", F.lit(0).cast("long").alias("count_ham"), F.lit(0).cast("long").alias("count_spam"), *[v.alias(k) for k, v in aged.items()])
    return out.where("archive_ham > 0 OR archive_spam > 0")


def parts_of(texts: DataFrame, seq: str = "seq") -> Column:
    """A number that rises with ``seq`` and stands for about so many texts, however their numbers are spread."""
    bounds = quantiles(texts, seq, max(1, min(MOST_PARTS, texts.count() // PART)))
    return place_among(F.col(seq).cast("double"), bounds) if len(bounds) > 1 else F.lit(0)


def running(events: DataFrame, keys: list[str], part_of: Column, seq: str = "seq", delta: str = "delta") -> DataFrame:
    """keys, total, low of clamped steps in order, in two levels, so a key with many events is spread over tasks."""
    part = [*keys, "__part"]
    inside = W.partitionBy(*part).orderBy(seq)
    e = events.withColumn("__part", part_of).withColumn("__run", F.sum(delta).over(inside))
    return composed(e.groupBy(*part).agg(F.sum(delta).alias("__sum"), F.min("__run").alias("__low")), keys)


def composed(parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, total, low from (keys, __part, __sum, __low): the sums and lowest running sums of parts, one after the other."""
    before = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    return parts.groupBy(*keys).agg(F.sum("__sum").alias("total"), F.min(F.col("__before") + F.col("__low")).alias("low"))


class Fold:
    """Sums and lowest running sums by key of steps that come in order, batch by batch; dense in the keys."""

    def __init__(self, size: int) -> None:
        self.sums, self.lows, self.met = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, bool)

    def add(self, keys: np.ndarray, deltas: np.ndarray) -> None:
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        keys, deltas = keys[order], deltas[order]
        starts = np.flatnonzero(np.diff(keys, prepend=-1))
        run = np.cumsum(deltas)
        run -= np.repeat(run[starts] - deltas[starts], np.diff(starts, append=len(keys)))
        k, low, total = keys[starts], np.minimum.reduceat(run, starts), np.add.reduceat(deltas, starts)
        self.lows[k] = np.where(self.met[k], np.minimum(self.lows[k], self.sums[k] + low), low)
        self.sums[k] += total
        self.met[k] = True


def folded_bags(bags: DataFrame, bits: int) -> DataFrame:
    """slot, counter, total, low of (seq, counter, sign, bag) rows with packed bags.

    Rows are dealt out in ranges of ``seq`` and sorted there, so a task folds whole bags in
    order and gives a row a slot; ranges are then composed. Steps that all add need no order.
    """
    if bags.where("sign < 0").isEmpty():
        sums = unpacked(bags, "counter").groupBy(slot(F.col("h"), bits).alias("slot"), "counter").agg(F.sum("cnt").alias("total"))
        return sums.withColumn("low", F.col("total"))
    size, spark = 1 << bits, bags.sparkSession
    parts = min(max(1, bags.count() // PART), max(spark.sparkContext.defaultParallelism, bags.count() // BAGS_A_PART))
    place = F.array_position(F.array(*map(F.lit, COUNTERS)), F.col("counter")) - 1
    rows = bags.select("seq", place.alias("place"), "sign", "bag").repartitionByRange(parts, "seq").sortWithinPartitions("seq")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folds: dict[int, Fold] = {}
        first = None
        for batch in batches:
            if not batch.num_rows:
                continue
            seq, places, signs = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("seq", "place", "sign"))
            first = int(seq[0]) if first is None else first
            bag = batch.column("bag")
            lengths = np.diff(bag.offsets.to_numpy())
            values = bag.flatten().to_numpy()
            of = np.repeat(np.arange(len(lengths)), lengths)
            slots, deltas = (values >> 32) & (size - 1), (values & 0xFFFFFFFF) * signs[of]
            for n in np.unique(places).tolist():
                mine = places[of] == n
                folds.setdefault(n, Fold(size)).add(slots[mine], deltas[mine])
        for n, fold in folds.items():
            at = np.flatnonzero(fold.met)
            for k in range(0, len(at), 1 << 16):
                part = at[k : k + (1 << 16)]
                columns = [np.full(len(part), first, np.int64), part, np.full(len(part), n, np.int64), fold.sums[part], fold.lows[part]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["__part", "slot", "place", "__sum", "__low"])

    bounded_batches(spark)
    found = rows.mapInArrow(task, "__part long, slot long, place long, __sum long, __low long")
    counter = F.element_at(F.array(*map(F.lit, COUNTERS)), (F.col("place") + 1).cast("int"))
    return composed(found, ["slot", "place"]).select("slot", counter.alias("counter"), "total", "low")


def replayed(counts: DataFrame, steps: DataFrame) -> DataFrame:
    """Counters after (slot, counter, total, low); empty rows go."""
    wide = steps.groupBy("slot").agg(*[F.max(F.when(F.col("counter") == c, F.struct("total", "low"))).alias(f"s_{c}") for c in COUNTERS])
    both = counts.join(wide, "slot", "full_outer")
    new = lambda c: F.when(F.col(f"s_{c}").isNull(), F.coalesce(c, F.lit(0))).otherwise(moved(F.coalesce(c, F.lit(0)), F.col(f"s_{c}.total"), F.col(f"s_{c}.low"))).cast("long").alias(c)
    return both.select("slot", *[new(c) for c in COUNTERS]).where(" OR ".join(f"{c} > 0" for c in COUNTERS))


class CountStore:
    """The store in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        if not path.strip("/") or any(c in path for c in "\0\r\n*?{}[]"):
            raise ValueError("a store needs the path of a folder, without wildcards")
        self.spark, self.path, self._folder = spark, path.rstrip("/"), Folder(spark, path)

    def install(self, bits: int = 20) -> CountStore:
        """Make the store; on one that stands this only checks its size."""
        check_bits(bits, MIN_STORE_BITS)
        self._folder.make("meta")
        meta = dict.fromkeys(_TEXTS, 0) | {"bits": bits, "hash": HASH_VERSION, "schema": SCHEMA_VERSION, "generation": 0, "version": 0, "install_id": uuid.uuid4().hex, "counts": None, "batch": None}
        if not self._folder.names("meta"):
            self._folder.create("meta/00000000000000000000.json", json.dumps(meta))
        held = self.meta()["bits"]
        if held != bits:
            raise ValueError(f"the store has {held} bits and cannot have {bits}; learn into a new one")
        return self

    def meta(self) -> dict:
        """The newest version's meta values, read afresh."""
        names = [n for n in self._folder.names("meta") if n.endswith(".json") and not n.startswith(".")]
        if not names:
            raise RuntimeError("the store is not installed")
        meta = json.loads(self._folder.read(f"meta/{names[-1]}"))
        if meta["schema"] != SCHEMA_VERSION:
            raise RuntimeError(f"the store has schema {meta['schema']}, this is {SCHEMA_VERSION}")
        if meta["hash"] != HASH_VERSION:
            raise RuntimeError(f"the store was made with hash version {meta['hash']}, this is {HASH_VERSION}")
        return meta | {"__name": names[-1]}

    def counts(self, meta: dict | None = None) -> DataFrame:
        """(slot, count_ham, count_spam, archive_ham, archive_spam) of a version."""
        meta = meta or self.meta()
        if meta["counts"] is None:
            zero = ", ".join(f"CAST(0 AS BIGINT) AS {c}" for c in ("slot", *COUNTERS))
            return self.spark.sql(f"SELECT {zero} WHERE false")
        return self.spark.read.schema("slot long, " + ", ".join(f"{c} long" for c in COUNTERS)).parquet(f"{self.path}/counts/{meta['counts']}")

    def _commit(self, meta: dict, counts: DataFrame | None, **changes) -> dict:
        new = {k: v for k, v in meta.items() if k != "__name"} | changes
        if counts is not None:
            new["counts"] = f"v={new['version']}-{uuid.uuid4().hex}"
            counts.write.parquet(f"{self.path}/counts/{new['counts']}")
        number = int(meta["__name"].removesuffix(".json")) + 1
        if not self._folder.create(f"meta/{number:020d}.json", json.dumps(new)):
            raise ConcurrentWriteError("the store has changed meanwhile")
        return new

    def take_over(self, counts: DataFrame, numbers: dict[str, int]) -> CountStore:
        """Counters and numbers from elsewhere, as the next version of a store that is still empty."""
        meta = self.meta()
        if meta["version"] or meta["counts"]:
            raise RuntimeError("only an empty store can take over counts")
        slots = counts.where(F.col("slot").between(0, (1 << meta["bits"]) - 1)).where(" OR ".join(f"{c} > 0" for c in COUNTERS))
        self._commit(meta, slots.select("slot", *COUNTERS), **numbers)
        return self

    def load(self) -> Layer:
        """Both generations as one layer; counters and text counts are of one version."""
        meta = self.meta()
        rows = self.counts(meta).select("slot", (F.col("count_ham") + F.col("archive_ham")).alias("count_ham"), (F.col("count_spam") + F.col("archive_spam")).alias("count_spam"))
        return Layer.of(rows, meta["bits"], meta["texts_ham"] + meta["archive_texts_ham"], meta["texts_spam"] + meta["archive_texts_spam"])

    def apply(self, hashed: DataFrame, label: str, sign: int, texts: int = 1, archive: bool = False, batch: int | None = None) -> int:
        """Learn (1) or unlearn (-1) the bags (h, cnt) of texts of one class and sign; the generation now.

        Steps of one sign may be added up before they are clamped. The version moves by
        the number of texts. A ``batch`` number that was applied already changes nothing.
        """
        if label not in ("ham", "spam") or sign not in (1, -1):
            raise ValueError("label must be ham or spam and sign 1 or -1")
        meta = self.meta()
        if batch is not None and meta["batch"] is not None and batch <= meta["batch"]:
            return meta["generation"]
        counter = ("archive_" if archive else "count_") + label
        deltas = hashed.groupBy(slot(F.col("h"), meta["bits"]).alias("slot")).agg((F.sum("cnt") * sign).alias("total"))
        steps = deltas.select("slot", F.lit(counter).alias("counter"), "total", F.col("total").alias("low"))
        kind = f"{'archive_' if archive else ''}texts_{label}"
        bump = {k: max(0, meta[k] + sign * texts) for k in (kind, f"learned_{label}")}
        return self._commit(meta, replayed(self.counts(meta), steps), version=meta["version"] + texts, batch=meta["batch"] if batch is None else batch, **bump)["generation"]

    def apply_events(self, events: DataFrame, batch: int | None = None, texts: DataFrame | None = None) -> int:
        """A batch of ordered steps (seq, h, cnt, label, sign, archive), as if applied one by one; the generation now.

        ``seq`` tells the texts apart and orders them. A text without features has a row whose
        h is null, or stands in ``texts`` only: (seq, label, sign, archive) of all texts, which
        spares reading the events for them. In place of h and cnt, events may have packed bags,
        a row a text, as ``features.packed`` gives them.
        """
        meta = self.meta()
        if batch is not None and meta["batch"] is not None and batch <= meta["batch"]:
            return meta["generation"]
        where = F.concat(F.when(F.col("archive"), F.lit("archive_")).otherwise(F.lit("count_")), F.col("label"))
        texts = events.select("seq", "label", "sign", "archive").distinct() if texts is None else texts.select("seq", "label", "sign", "archive")
        texts = cut(texts.withColumn("delta", F.col("sign").cast("long")))
        part = parts_of(texts)
        kind = F.explode(F.array(F.concat(F.when(F.col("archive"), F.lit("archive_")).otherwise(F.lit("")), F.lit("texts_"), F.col("label")), F.concat(F.lit("learned_"), F.col("label"))))
        moves = running(texts.withColumn("kind", kind), ["kind"], part).collect()  # a row a text counter
        n = texts.count()
        bump = {r["kind"]: max(meta[r["kind"]] + r["total"], r["total"] - r["low"]) for r in moves}
        if "bag" in events.columns:
            steps = folded_bags(events.select("seq", where.alias("counter"), "sign", "bag"), meta["bits"])
        else:
            folded = events.where("h IS NOT NULL").groupBy("seq", slot(F.col("h"), meta["bits"]).alias("slot"), where.alias("counter")).agg(F.sum(F.col("cnt") * F.col("sign")).alias("delta"))
            steps = running(folded, ["slot", "counter"], part)
        return self._commit(meta, replayed(self.counts(meta), steps), version=meta["version"] + n, batch=meta["batch"] if batch is None else batch, **bump)["generation"]

    def rotate(self) -> None:
        """Age by a generation: archives halve and take in what is recent; lifetime counts stay."""
        meta = self.meta()
        texts = {f"archive_texts_{c}": (meta[f"archive_texts_{c}"] >> 1) + meta[f"texts_{c}"] for c in ("ham", "spam")} | {f"texts_{c}": 0 for c in ("ham", "spam")}
        self._commit(meta, rotated(self.counts(meta)), version=meta["version"] + 1, generation=meta["generation"] + 1, **texts)

    def tally(self) -> Tally:
        m = self.meta()
        return Tally(m["generation"], m["texts_spam"], m["texts_ham"], m["learned_spam"], m["learned_ham"])

    def version(self) -> int:
        return self.meta()["version"]

    def identity(self) -> str:
        return f"{self.path}:{self.meta()['install_id']}"


class SnapshotCache:
    """Loaded layers by store identity and version: a layer is read again only after a change."""

    def __init__(self) -> None:
        self._held: dict[str, tuple[int, Layer]] = {}

    def load(self, store: CountStore) -> Layer:
        key, version = store.identity(), store.version()
        held = self._held.get(key)
        if held is None or held[0] != version:
            if held:
                held[1].counts.unpersist()
            layer = store.load()
            layer.counts.persist()
            self._held[key] = held = (version, layer)
        return held[1]
