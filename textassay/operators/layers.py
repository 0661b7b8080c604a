"""Count tables and layers as sparse relations.

A table is a relation (slot, cnt) without zero rows; a layer is (slot, count_ham,
count_spam) with the number of texts of each class. Sizes, totals and text
counts travel beside the relation, so nothing is counted again to score a text.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import slot
from ..params import MAX_COUNT, check_bits

CLASSES = ("ham", "spam")


def clamp(c: Column) -> Column:
    """Into the range of an unsigned 32-bit counter."""
    return F.least(F.greatest(c, F.lit(0)), F.lit(MAX_COUNT)).cast("long")


def label_of(value: Column) -> Column:
    """1 is spam; anything else, null too, is ham."""
    return F.when(F.coalesce(value.cast("string") == "1", F.lit(False)), F.lit("spam")).otherwise(F.lit("ham"))


@dataclass(frozen=True)
class CountTable:
    """(slot, cnt) over 2 ** bits slots; total is the sum of the counters."""

    counts: DataFrame
    bits: int
    total: int

    def __post_init__(self) -> None:
        check_bits(self.bits)

    @property
    def size(self) -> int:
        return 1 << self.bits

    @staticmethod
    def of(rows: DataFrame, bits: int) -> CountTable:
        """From (h or slot, cnt) rows: slots fold and add up; counters that end at 0 or less go."""
        check_bits(bits)
        key = "h" if "h" in rows.columns else "slot"
        counts = rows.groupBy(slot(F.col(key), bits).alias("slot")).agg(F.sum("cnt").alias("cnt")).select("slot", clamp(F.col("cnt")).alias("cnt")).where("cnt > 0")
        return CountTable(counts, bits, total_of(counts))

    def get(self, h: Column) -> Column:
        return slot(h, self.bits)

    def occupied(self) -> int:
        return self.counts.count()

    def add(self, deltas: DataFrame) -> CountTable:
        """One change a slot at most, as (slot, delta): clamped at 0 and at the ceiling, total moves by what took effect."""
        both = self.counts.join(deltas, "slot", "full_outer")
        counts = both.select("slot", clamp(F.coalesce("cnt", F.lit(0)) + F.coalesce("delta", F.lit(0))).alias("cnt")).where("cnt > 0")
        return CountTable(counts, self.bits, total_of(counts))

    def halve(self) -> CountTable:
        counts = self.counts.select("slot", F.shiftright("cnt", 1).alias("cnt")).where("cnt > 0")
        return CountTable(counts, self.bits, total_of(counts))

    def plus(self, other: CountTable) -> CountTable:
        if self.bits != other.bits:
            raise ValueError("tables of different sizes cannot be added")
        counts = self.counts.unionByName(other.counts).groupBy("slot").agg(F.sum("cnt").alias("cnt")).select("slot", clamp(F.col("cnt")).alias("cnt"))
        return CountTable(counts, self.bits, total_of(counts))


def total_of(counts: DataFrame, column: str = "cnt") -> int:
    return int(counts.agg(F.coalesce(F.sum(column), F.lit(0))).first()[0])


@dataclass(frozen=True)
class Layer:
    """Counts of both classes, with the texts they came from."""

    counts: DataFrame
    bits: int
    texts_ham: int = 0
    texts_spam: int = 0
    total_ham: int = 0
    total_spam: int = 0

    def __post_init__(self) -> None:
        check_bits(self.bits)

    @staticmethod
    def empty(spark: SparkSession, bits: int) -> Layer:
        return Layer(spark.sql("SELECT CAST(0 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS count_ham, CAST(0 AS BIGINT) AS count_spam WHERE false"), bits)

    @staticmethod
    def of(counts: DataFrame, bits: int, texts_ham: int, texts_spam: int) -> Layer:
        """From (slot, count_ham, count_spam) rows: slots fold and add, what is not above 0 is ignored."""
        up = lambda c: F.sum(F.greatest(F.col(c), F.lit(0)))
        folded = counts.groupBy(slot(F.col("slot"), bits).alias("slot")).agg(up("count_ham").alias("count_ham"), up("count_spam").alias("count_spam"))
        folded = folded.select("slot", clamp(F.col("count_ham")).alias("count_ham"), clamp(F.col("count_spam")).alias("count_spam")).where("count_ham > 0 OR count_spam > 0")
        return Layer(folded, bits, max(0, texts_ham), max(0, texts_spam)).counted()

    def counted(self) -> Layer:
        t = self.counts.agg(F.coalesce(F.sum("count_ham"), F.lit(0)).alias("h"), F.coalesce(F.sum("count_spam"), F.lit(0)).alias("s")).first()
        return replace(self, total_ham=int(t["h"]), total_spam=int(t["s"]))

    @staticmethod
    def from_hashed(hashed: DataFrame, bits: int) -> Layer:
        """Learn from (doc_id, h, cnt, label); texts are counted by distinct (doc_id, label), empty ones must be added by the caller."""
        counts = layer_counts(hashed, bits)
        texts = {r["label"]: r["n"] for r in hashed.select("doc_id", "label").distinct().groupBy("label").agg(F.count("*").alias("n")).collect()}
        return Layer(counts, bits, texts.get("ham", 0), texts.get("spam", 0)).counted()

    def total(self) -> int:
        return self.total_ham + self.total_spam

    def table(self, label: str) -> CountTable:
        counts = self.counts.select("slot", F.col(f"count_{label}").alias("cnt")).where("cnt > 0")
        return CountTable(counts, self.bits, self.total_ham if label == "ham" else self.total_spam)

    def halve(self) -> Layer:
        half = [F.shiftright(f"count_{c}", 1).alias(f"count_{c}") for c in CLASSES]
        counts = self.counts.select("slot", *half).where("count_ham > 0 OR count_spam > 0")
        return Layer(counts, self.bits, self.texts_ham >> 1, self.texts_spam >> 1).counted()

    def plus(self, other: Layer) -> Layer:
        if self.bits != other.bits:
            raise ValueError("layers of different sizes cannot be added")
        both = self.counts.unionByName(other.counts)
        return Layer.of(both, self.bits, self.texts_ham + other.texts_ham, self.texts_spam + other.texts_spam)

    def marginal(self) -> CountTable:
        counts = self.counts.select("slot", clamp(F.col("count_ham") + F.col("count_spam")).alias("cnt"))
        return CountTable(counts, self.bits, total_of(counts))

    def apply(self, hashed: DataFrame, label: str, sign: int, texts: int = 1) -> Layer:
        """Learn (sign 1) or unlearn (-1) a bag (h, cnt) of ``texts`` texts of one class; each counter is clamped once."""
        deltas = hashed.groupBy(slot(F.col("h"), self.bits).alias("slot")).agg((F.sum("cnt") * sign).alias("delta"))
        both = self.counts.join(deltas, "slot", "full_outer")
        moved = lambda c: clamp(F.coalesce(f"count_{c}", F.lit(0)) + (F.coalesce("delta", F.lit(0)) if c == label else F.lit(0))).alias(f"count_{c}")
        counts = both.select("slot", *[moved(c) for c in CLASSES]).where("count_ham > 0 OR count_spam > 0")
        n = {c: max(0, getattr(self, f"texts_{c}") + (sign * texts if c == label else 0)) for c in CLASSES}
        return Layer(counts, self.bits, n["ham"], n["spam"]).counted()

    def learn(self, hashed: DataFrame, label: str, texts: int = 1) -> Layer:
        return self.apply(hashed, label, 1, texts)

    def unlearn(self, hashed: DataFrame, label: str, texts: int = 1) -> Layer:
        return self.apply(hashed, label, -1, texts)


def layer_counts(hashed: DataFrame, bits: int) -> DataFrame:
    """(slot, count_ham, count_spam) of (h, cnt, label) rows."""
    of = lambda c: F.sum(F.when(F.col("label") == c, F.col("cnt")).otherwise(0))
    counts = hashed.groupBy(slot(F.col("h"), bits).alias("slot")).agg(of("ham").alias("count_ham"), of("spam").alias("count_spam"))
    return counts.select("slot", clamp(F.col("count_ham")).alias("count_ham"), clamp(F.col("count_spam")).alias("count_spam")).where("count_ham > 0 OR count_spam > 0")
