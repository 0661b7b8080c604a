"""The evidence model: classify, explain, detect languages, learn and unlearn."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import feature_hash
from ..operators.features import bags, hashed_bags, merged, packed, repeats, strongest, unpacked
from ..operators.language import LanguageSet
from ..operators.layers import CountTable, Layer
from ..operators.scoring import contributions, rated, ratios, score_sums, slot_ratios, weight, with_score_columns
from ..params import ExtractParams, ModelParams

if TYPE_CHECKING:
    from ..sources.store import CountStore


#: Feature spaces up to which the ratios of all slots are sent to the tasks (8 MB).
SENT_BITS = 20


@dataclass(frozen=True)
class EvidenceModel:
    """Layers and parameters, bundled.

    site: counts of the own texts. pretrained: counts from elsewhere, or none.
    background: one table, a set of languages, or none (then the marginal of the
    layers stands in). store: where learning goes, or none (then it stays in memory).
    """

    site: Layer
    pretrained: Layer | None = None
    background: CountTable | LanguageSet | None = None
    extract: ExtractParams = field(default_factory=ExtractParams)
    params: ModelParams = field(default_factory=ModelParams)
    store: CountStore | None = None
    hash_mode: str = "xxh3"

    def hashed(self, texts: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        return hashed_bags(texts, doc_id, text, self.extract, self.hash_mode)

    def packed(self, texts: DataFrame, *keep: str, text: str = "text") -> DataFrame:
        """The columns ``keep`` and the packed bag of each row, extracted at once."""
        return packed(texts, *keep, text=text, params=self.extract, mode=self.hash_mode)

    def _rated(self, bag: DataFrame, texts: DataFrame) -> DataFrame:
        if isinstance(self.background, LanguageSet):
            spoken = self.background.detect(bag.select("doc_id", "h", "cnt"), texts)
            bag = bag.join(spoken, "doc_id")
            return ratios(bag, self.site, self.pretrained, self.params, self.background.lookup(self.params.alpha))
        return rated(bag, self.site, self.pretrained, self.params, self.background)

    def classify(self, texts: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """doc_id, log_odds, occurrences, mean_log_odds, evidence, probability: a row per id, empty texts too."""
        return self.classify_packed(self.packed(texts.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id"))

    def explained_sums(self, bags: DataFrame) -> DataFrame:
        """doc_id, log_odds of (doc_id, bag) rows with an entry for each feature: its contributions, added up; texts without any give no row."""
        parts = contributions(self._rated(unpacked(bags, "doc_id").withColumns({"feature": F.lit(""), "ord": F.lit(0)}), bags.select("doc_id")), self.params.log_counts)
        return parts.groupBy("doc_id").agg(F.sum("total").alias("log_odds"))

    def classify_packed(self, bags: DataFrame) -> DataFrame:
        """The same of (doc_id, bag) rows.

        With plain counts the bags of an id need not meet, so only one row a text is
        shuffled; damped counts need them added up. Languages join whole bags.
        """
        ids = bags.select("doc_id")
        if self.params.log_counts:
            scored = self._rated(merged(bags), ids)
        elif isinstance(self.background, LanguageSet):
            spoken = self.background.detect(unpacked(bags, "doc_id"), ids.distinct())
            scored = ratios(unpacked(bags.join(spoken, "doc_id"), "doc_id", "language"), self.site, self.pretrained, self.params, self.background.lookup(self.params.alpha))
        else:
            scored = self._rated(unpacked(bags, "doc_id"), ids)
        sums = score_sums(scored, self.params.log_counts)
        out = ids.join(sums, "doc_id", "left").select("doc_id", F.coalesce("log_odds", F.lit(0.0)).alias("log_odds"), F.coalesce("occurrences", F.lit(0)).cast("long").alias("occurrences"))
        return with_score_columns(out)

    def explain(self, texts: DataFrame, doc_id: str = "doc_id", text: str = "text", top: int | None = None) -> DataFrame:
        """doc_id, feature, cnt, log_ratio, weight, total, rank; ``top`` keeps the first ranks of each text."""
        bag = bags(texts, doc_id, text, self.extract).withColumn("h", feature_hash(F.col("feature"), self.hash_mode))
        return contributions(self._rated(bag, texts.select(F.col(doc_id).alias("doc_id"))), self.params.log_counts, top)

    def strongest(self, texts: DataFrame, k: int) -> DataFrame:
        """doc_id, feature, cnt, log_ratio, weight, total, a row for each feature that may be among the ``k`` of its text that weigh most.

        For (doc_id, text) rows: a part of what ``explain`` gives that any order by falling size of the rounded total,
        and by feature among equals, starts with. Where the ratio does not follow from the slot alone, or an id repeats, it is all.
        """
        alike = not isinstance(self.background, LanguageSet) and len({t.bits for t in (self.site, self.pretrained, self.background) if t is not None}) == 1
        if not alike or self.site.bits > SENT_BITS or repeats(texts):
            return self.explain(texts).drop("rank")
        rates = np.zeros(1 << self.site.bits)
        rows = slot_ratios(self.site, self.pretrained, self.params, self.background).toPandas()
        rates[rows["h"].to_numpy(np.int64)] = rows["r"]
        found = strongest(texts, rates, k, self.extract, self.hash_mode, self.params.log_counts)
        of = rated(found.withColumn("h", feature_hash(F.col("feature"), self.hash_mode)), self.site, self.pretrained, self.params, self.background)
        w = weight(F.col("cnt"), self.params.log_counts)
        return of.select("doc_id", "feature", "cnt", F.col("r").alias("log_ratio"), w.alias("weight"), (w * F.col("r")).alias("total"))

    def language(self, texts: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """doc_id, language; null unless the background is a set of languages."""
        ids = texts.select(F.col(doc_id).alias("doc_id"))
        if not isinstance(self.background, LanguageSet):
            return ids.withColumn("language", F.lit(None).cast("string"))
        bags = self.packed(texts.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id")
        return self.background.detect(unpacked(bags, "doc_id"), ids)

    def generation(self) -> int:
        """Rotations so far; 0 without a store."""
        return self.store.tally().generation if self.store else 0

    def learn(self, texts: DataFrame, label: str, archive: bool = False, doc_id: str = "doc_id", text: str = "text") -> tuple[EvidenceModel, int]:
        """Learn all rows as texts of one class; the model that knows them, and the generation they went to."""
        bag, n = self.hashed(texts, doc_id, text), texts.count()
        if self.store is None:
            return replace(self, site=self.site.learn(bag, label, n)), -1 if archive else 0
        generation = self.store.apply(bag, label, 1, n, archive)
        return replace(self, site=self.store.load()), generation - (1 if archive else 0)

    def unlearn(self, texts: DataFrame, label: str, learned_in: int, doc_id: str = "doc_id", text: str = "text") -> tuple[EvidenceModel, bool]:
        """Take back texts learned in a generation; False, and no change, if that one has decayed."""
        now = self.generation()
        if learned_in > now:
            raise ValueError(f"generation {learned_in} is still to come, this is {now}")
        if learned_in < now - 1:
            return self, False
        bag, n = self.hashed(texts, doc_id, text), texts.count()
        if self.store is None:
            return replace(self, site=self.site.unlearn(bag, label, n)), True
        self.store.apply(bag, label, -1, n, archive=learned_in == now - 1)
        return replace(self, site=self.store.load()), True

    def rotate(self) -> EvidenceModel:
        """Age the store by a generation and load it again."""
        if self.store is None:
            raise ValueError("only a model with a store can rotate")
        self.store.rotate()
        return replace(self, site=self.store.load())
