"""Lifts over a background, scores and explanations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.hashing import slot
from ..params import ModelParams
from .layers import CountTable, Layer

#: Rows of a lookup table up to which it is broadcast (about 64 MB); larger ones are shuffled.
#: Tables of the usual 20 bits never exceed it.
BROADCAST_ROWS = 1 << 20


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a lookup table only if it is known to be small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def most_rows(layer: Layer | None) -> int:
    """A bound on a layer's rows: it has no more than slots, and no more than counts."""
    return 0 if layer is None else min(1 << layer.bits, layer.total())


def smoothed(cnt: Column, total: Column | float, size: Column | float, alpha: float) -> Column:
    """(c + alpha T / size) / (T (1 + alpha)); 1 / size where the table is empty."""
    total, size = (x if isinstance(x, Column) else F.lit(float(x)) for x in (total, size))
    total, size = total.cast("double"), size.cast("double")
    some = F.when(total > 0, total)
    return F.coalesce((cnt.cast("double") + some * alpha / size) / (some * (1.0 + alpha)), F.lit(1.0) / size)


def frequency(site: Column, pre: Column, site_total: float, pre_total: float, weight: float) -> Column:
    total = float(site_total) + weight * float(pre_total)
    if total <= 0:
        return F.lit(0.0)
    return (site.cast("double") + F.lit(weight) * pre.cast("double")) / F.lit(total)


def log_ratio(f_spam: Column, f_ham: Column, background: Column, mu: float) -> Column:
    return F.ln((f_spam / background + F.lit(mu)) / (f_ham / background + F.lit(mu)))


def weight(cnt: Column, log_counts: bool) -> Column:
    return F.lit(1.0) + F.ln(cnt.cast("double")) if log_counts else cnt.cast("double")


def with_counts(bag: DataFrame, layer: Layer | None, prefix: str, occupied: int) -> DataFrame:
    """``bag`` with {prefix}_ham and {prefix}_spam of its hash; 0 where a slot is empty. Each layer folds by its own size."""
    names = [f"{prefix}_ham", f"{prefix}_spam"]
    if layer is None:
        return bag.withColumns({n: F.lit(0).cast("long") for n in names})
    table = small(layer.counts.select(F.col("slot").alias("__slot"), F.col("count_ham").alias(names[0]), F.col("count_spam").alias(names[1])), occupied)
    out = bag.join(table, slot(F.col("h"), layer.bits) == F.col("__slot"), "left").drop("__slot")
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n in names})


def ratios(bag: DataFrame, site: Layer | None, pretrained: Layer | None, params: ModelParams, background: CountTable | Callable[[DataFrame], DataFrame] | None = None, occupied: dict[str, int] | None = None) -> DataFrame:
    """``bag`` (with h) and its log ratio ``r``.

    background: one table; a function that adds the column ``background`` by the
    chosen language; or none, and then the marginal of both layers is taken, over the
    slots of the site.
    """
    n = occupied or {}
    lam = params.pretrained_weight
    df = with_counts(bag, site, "site", n.get("site", most_rows(site)))
    df = with_counts(df, pretrained, "pre", n.get("pre", most_rows(pretrained)))
    totals = {c: (getattr(site, f"total_{c}") if site else 0, getattr(pretrained, f"total_{c}") if pretrained else 0) for c in ("ham", "spam")}
    f = {c: frequency(F.col(f"site_{c}"), F.col(f"pre_{c}"), *totals[c], lam) for c in ("ham", "spam")}
    if background is None:
        bits = (site or pretrained).bits
        seen = sum((F.col(f"site_{c}").cast("double") + F.lit(lam) * F.col(f"pre_{c}").cast("double") for c in ("ham", "spam")), F.lit(0.0))
        total = sum(s + lam * p for s, p in totals.values())
        p = smoothed(seen, float(total), float(1 << bits), params.alpha)
    elif isinstance(background, CountTable):
        table = small(background.counts.select(F.col("slot").alias("__slot"), F.col("cnt").alias("__bg")), n.get("background", min(background.size, background.total)))
        df = df.join(table, slot(F.col("h"), background.bits) == F.col("__slot"), "left").drop("__slot")
        p = smoothed(F.coalesce("__bg", F.lit(0)), float(background.total), float(background.size), params.alpha)
    else:
        df = background(df)
        p = F.col("background")
    known = (F.col("site_ham") + F.col("site_spam") + F.col("pre_ham") + F.col("pre_spam")) > 0
    r = F.when(known, log_ratio(f["spam"], f["ham"], p, params.background_weight)).otherwise(F.lit(0.0))
    return df.withColumn("r", r)


def rated(bag: DataFrame, site: Layer, pretrained: Layer | None, params: ModelParams, background: CountTable | None = None) -> DataFrame:
    """As ``ratios`` without a background by language, but the ratio is worked out once a slot where all tables fold alike."""
    tables = [t for t in (site, pretrained, background) if t is not None]
    if len({t.bits for t in tables}) > 1:
        return ratios(bag, site, pretrained, params, background)
    rates = slot_ratios(site, pretrained, params, background).select(F.col("h").alias("__slot"), "r")
    out = bag.join(small(rates, most_rows(site) + most_rows(pretrained)), slot(F.col("h"), site.bits) == F.col("__slot"), "left").drop("__slot")
    return out.withColumn("r", F.coalesce("r", F.lit(0.0)))


def slot_ratios(site: Layer, pretrained: Layer | None, params: ModelParams, background: CountTable | None = None) -> DataFrame:
    """h and r of all slots that a layer holds, h being the slot; the ratio of all others is 0."""
    slots = site.counts.select(F.col("slot").alias("h"))
    if pretrained is not None:
        slots = slots.unionByName(pretrained.counts.select(F.col("slot").alias("h"))).distinct()
    return ratios(slots, site, pretrained, params, background).select("h", "r")


def score_sums(rated: DataFrame, log_counts: bool) -> DataFrame:
    """doc_id, log_odds, occurrences of (doc_id, h, cnt, r) rows."""
    return rated.groupBy("doc_id").agg(F.sum(weight(F.col("cnt"), log_counts) * F.col("r")).alias("log_odds"), F.sum("cnt").cast("long").alias("occurrences"))


def with_score_columns(scores: DataFrame) -> DataFrame:
    """mean_log_odds, evidence and probability of (log_odds, occurrences); 0, 0 and a half without occurrences."""
    some = F.col("occurrences") > 0
    out = scores.withColumn("mean_log_odds", F.when(some, F.col("log_odds") / F.col("occurrences")).otherwise(F.lit(0.0)))
    out = out.withColumn("evidence", F.when(some, F.col("log_odds") / F.sqrt(F.col("occurrences").cast("double"))).otherwise(F.lit(0.0)))
    return out.withColumn("probability", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("evidence"))))


def verdict(evidence: Column, review: float = 0.0, hold: float = 1.0) -> Column:
    return F.when(evidence < review, F.lit("deliver")).when(evidence < hold, F.lit("review")).otherwise(F.lit("hold"))


def contributions(rated: DataFrame, log_counts: bool, top: int | None = None) -> DataFrame:
    """doc_id, feature, cnt, log_ratio, weight, total, rank: by falling size of total, then first place in the text."""
    w = weight(F.col("cnt"), log_counts)
    out = rated.select("doc_id", "feature", "cnt", "ord", F.col("r").alias("log_ratio"), w.alias("weight"), (w * F.col("r")).alias("total"))
    order = W.partitionBy("doc_id").orderBy(F.abs("total").desc(), "ord")
    out = out.withColumn("rank", F.row_number().over(order))
    return (out if top is None else out.where(F.col("rank") <= top)).drop("ord")
