"""Language backgrounds: one count table a language, and detection by likelihood."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import slot
from .layers import CountTable
from .scoring import BROADCAST_ROWS, small, smoothed

#: Entries of all languages together up to which their tables are broadcast (about 100 MB).
BROADCAST_ENTRIES = 4 * BROADCAST_ROWS
#: Languages up to which each has a column of gains; beyond, most columns would be empty for most slots.
COLUMNS = 16


@dataclass(frozen=True)
class LanguageSet:
    """tables: (lang, slot, cnt); meta: language -> (bits, total), in the order that decides ties."""

    tables: DataFrame
    meta: dict[str, tuple[int, int]]
    alpha: float = 0.2

    def __post_init__(self) -> None:
        if not self.meta:
            raise ValueError("a language set needs a table at least")
        if self.alpha <= 0:
            raise ValueError("alpha must be above 0")

    @staticmethod
    def of(tables: dict[str, CountTable], alpha: float = 0.2) -> LanguageSet:
        rows = None
        for lang, t in tables.items():
            one = t.counts.select(F.lit(lang).alias("lang"), "slot", "cnt")
            rows = one if rows is None else rows.unionByName(one)
        return LanguageSet(rows, {k: (t.bits, t.total) for k, t in tables.items()}, alpha)

    @staticmethod
    def build(hashed: DataFrame, bits: int, alpha: float = 0.2, languages: list[str] | None = None) -> LanguageSet:
        """From (lang, h, cnt) rows; languages in the order of their names."""
        rows = hashed if languages is None else hashed.where(F.col("lang").isin(languages))
        tables = rows.where("lang IS NOT NULL").groupBy("lang", slot(F.col("h"), bits).alias("slot")).agg(F.sum("cnt").alias("cnt"))
        totals = {r["lang"]: int(r["n"]) for r in tables.groupBy("lang").agg(F.sum("cnt").alias("n")).collect()}
        return LanguageSet(tables, {k: (bits, totals[k]) for k in sorted(totals)}, alpha)

    def occupied(self) -> int:
        return sum(min(1 << bits, total) for bits, total in self.meta.values())

    def _small(self, df: DataFrame) -> DataFrame:
        return small(df, 0 if self.occupied() <= BROADCAST_ENTRIES else BROADCAST_ROWS + 1)

    def _meta(self, spark: SparkSession) -> DataFrame:
        rows = [(lang, n, bits, float(1 << bits), float(total)) for n, (lang, (bits, total)) in enumerate(self.meta.items())]
        return F.broadcast(spark.createDataFrame(rows, "lang string, place int, bits int, size double, total double"))  # a row a language

    def select(self, lang: str) -> CountTable:
        bits, total = self.meta[lang]
        return CountTable(self.tables.where(F.col("lang") == lang).select("slot", "cnt"), bits, total)

    def likelihoods(self, hashed: DataFrame) -> DataFrame:
        """doc_id, lang, place, score: the log likelihood of each text with features under each language.

        ``hashed`` has (doc_id, h, cnt) rows, added up or as they are met. A slot that a
        table does not hold adds the same for all features, so only the hits are joined;
        what misses would have added follows from the number of occurrences, which is
        summed along with the hits. One shuffled row a text and language.
        """
        meta = self._meta(hashed.sparkSession)
        base = F.ln(smoothed(F.lit(0), F.col("total"), F.col("size"), self.alpha))
        gain = F.ln(smoothed(F.col("cnt"), F.col("total"), F.col("size"), self.alpha)) - base
        gains = self.tables.join(meta, "lang").where("total > 0").select("lang", "bits", "slot", gain.alias("gain"))
        texts = self._in_columns(hashed, gains) if len(self.meta) <= COLUMNS else self._in_rows(hashed, gains)
        langs = [(lang, n, math.log(((self.alpha * t / (1 << b)) / (t * (1 + self.alpha))) if t > 0 else 1 / (1 << b))) for n, (lang, (b, t)) in enumerate(self.meta.items())]
        every = F.array(*[F.struct(F.lit(k).alias("lang"), F.lit(n).alias("place"), F.lit(x).alias("base")) for k, n, x in langs])
        tail = texts.select("doc_id", "occ", "won", F.inline(every))
        return tail.select("doc_id", "lang", "place", (F.col("occ") * F.col("base") + F.coalesce(F.get("won", F.col("place")), F.lit(0.0))).alias("score"))

    def _in_columns(self, hashed: DataFrame, gains: DataFrame) -> DataFrame:
        """doc_id, occ, won (by place) of a few languages: a column each, so a feature stays one row and a text's sums are one."""
        rows, sums = hashed, []
        for bits in sorted({b for b, _ in self.meta.values()}):
            places = [(n, lang) for n, (lang, (b, _)) in enumerate(self.meta.items()) if b == bits]
            wide = gains.where(F.col("bits") == bits).groupBy(F.col("slot").alias("__slot")).agg(*[F.max(F.when(F.col("lang") == lang, F.col("gain"))).alias(f"__g{n}") for n, lang in places])
            rows = rows.join(self._small(wide), slot(F.col("h"), bits) == F.col("__slot"), "left").drop("__slot")
            sums += [(n, F.coalesce(F.sum(F.col("cnt") * F.col(f"__g{n}")), F.lit(0.0))) for n, _ in places]
        return rows.groupBy("doc_id").agg(F.sum(F.col("cnt").cast("double")).alias("occ"), F.array(*[s for _, s in sorted(sums, key=lambda x: x[0])]).alias("won"))

    def _in_rows(self, hashed: DataFrame, gains: DataFrame) -> DataFrame:
        """The same of many languages: a feature brings along the gains that there are."""
        rows, found = hashed, []
        for bits in sorted({b for b, _ in self.meta.values()}):
            per_slot = gains.where(F.col("bits") == bits).groupBy(F.col("slot").alias("__slot")).agg(F.collect_list(F.struct("lang", "gain")).alias(f"__hits{bits}"))
            rows = rows.join(self._small(per_slot), slot(F.col("h"), bits) == F.col("__slot"), "left").drop("__slot")
            found.append(F.coalesce(f"__hits{bits}", F.array().cast("array<struct<lang:string,gain:double>>")))
        own = F.array(F.struct(F.lit(None).cast("string").alias("lang"), F.col("cnt").cast("double").alias("x")))
        hits = F.transform(F.concat(*found), lambda g: F.struct(g["lang"].alias("lang"), (F.col("cnt") * g["gain"]).alias("x")))
        sums = rows.select("doc_id", F.inline(F.concat(own, hits))).groupBy("doc_id", "lang").agg(F.sum("x").alias("x"))
        won = F.map_from_entries(F.collect_list(F.when(F.col("lang").isNotNull(), F.struct("lang", "x"))))
        texts = sums.groupBy("doc_id").agg(F.max(F.when(F.col("lang").isNull(), F.col("x"))).alias("occ"), won.alias("won"))
        return texts.select("doc_id", "occ", F.transform(F.array(*map(F.lit, self.meta)), lambda k: F.coalesce(F.try_element_at("won", k), F.lit(0.0))).alias("won"))

    def detect(self, hashed: DataFrame, texts: DataFrame) -> DataFrame:
        """doc_id, language for every row of ``texts``: the first of the most likely; the first of all for a text without features."""
        best = self.likelihoods(hashed).groupBy("doc_id").agg(F.max_by("lang", F.struct("score", -F.col("place"))).alias("language"))
        first = next(iter(self.meta))
        return texts.select("doc_id").join(best, "doc_id", "left").select("doc_id", F.coalesce("language", F.lit(first)).alias("language"))

    def lookup(self, alpha: float):
        """A function that adds ``background``, the smoothed probability under the row's ``language``."""

        def run(df: DataFrame) -> DataFrame:
            meta = self._meta(df.sparkSession).withColumnRenamed("lang", "language")
            table = self._small(self.tables.select(F.col("lang").alias("language"), F.col("slot").alias("__slot"), F.col("cnt").alias("__bg")))
            out = df.join(meta, "language").withColumn("__slot", F.col("h").bitwiseAND(F.col("size").cast("long") - 1)).join(table, ["language", "__slot"], "left")
            return out.withColumn("background", smoothed(F.coalesce("__bg", F.lit(0)), F.col("total"), F.col("size"), alpha)).drop("__slot", "__bg", "place", "bits", "size", "total")

        return run
