import math

import pytest
from pyspark.sql import functions as F

from textassay import EvidenceModel, ModelParams
from textassay.operators.language import LanguageSet
from textassay.operators.layers import CountTable, Layer
from textassay.operators.scoring import ratios, verdict, with_score_columns

from .test_layers import layer


def rate(spark, hashes, *args, **kw):
    bag = spark.createDataFrame([(h,) for h in hashes], "h long")
    return {r["h"]: r["r"] for r in ratios(bag, *args, **kw).collect()}


def test_known_values(spark):
    r = rate(spark, [1, 2, 3, 9], layer(spark, {1: 5, 3: 5}, {2: 5, 3: 5}), None, ModelParams())
    assert r[1] == pytest.approx(0.21450824328985593) and r[2] == pytest.approx(-r[1]) and r[3] == 0 and r[9] == 0
    r = rate(spark, [1, 2], layer(spark, {1: 100, 2: 1}, {}), None, ModelParams(alpha=1e-4))
    assert r[1] == pytest.approx(0.09531923480236933) and r[2] == pytest.approx(0.09531568383338966)


def test_background(spark):
    bg = CountTable.of(spark.createDataFrame([(1, 1000), (2, 1), (3, 10)], "h long, cnt long"), 8)
    r = rate(spark, [1, 2, 3], layer(spark, {1: 10, 2: 10}, {}), None, ModelParams(), bg)
    assert r[1] == pytest.approx(0.05884621870399012) and r[2] == pytest.approx(3.5522354090270225) and r[3] == 0


def test_pretrained_weight_is_monotone(spark):
    pre = layer(spark, {1: 10, 3: 90}, {2: 10, 3: 90})
    site = layer(spark, {3: 100}, {1: 10, 3: 90})
    r = [rate(spark, [1], site, pre, ModelParams(pretrained_weight=w))[1] for w in (0.0, 0.5, 1.0)]
    assert r == sorted(r) and r[0] < r[2]
    assert rate(spark, [1], Layer.empty(spark, 8), pre, ModelParams())[1] > 0
    assert rate(spark, [1], layer(spark, {}, {1: 50, 3: 50}), pre, ModelParams())[1] < 0


def test_masks_differ_by_table(spark):
    bg = CountTable.of(spark.createDataFrame([(257, 9), (1, 1)], "h long, cnt long"), 12)
    r = rate(spark, [1, 257], layer(spark, {1: 10}, {}), None, ModelParams(), bg)
    assert r[1] > r[257] > 0


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def test_end_to_end(spark):
    model = EvidenceModel(Layer.empty(spark, 12), hash_mode="md5")
    assert model.generation() == 0
    model, generation = model.learn(texts(spark, "cheap seo audit, buy links now", "free seo offer, buy views"), "spam")
    assert generation == 0
    model, _ = model.learn(texts(spark, "hello, I would like a quote for a garden wall", "thanks for the quick answer"), "ham")
    rows = texts(spark, "buy seo links", "a quote for a wall", "", None)
    got = {r["doc_id"]: r for r in model.classify(rows).collect()}
    assert got[0]["log_odds"] > 0 > got[1]["log_odds"] and got[2]["occurrences"] == 0 and got[3]["probability"] == 0.5
    parts = {r["doc_id"]: r["s"] for r in model.explain(rows).groupBy("doc_id").agg(F.sum("total").alias("s")).collect()}
    assert parts[0] == pytest.approx(got[0]["log_odds"]) and parts[1] == pytest.approx(got[1]["log_odds"])
    top = model.explain(rows, top=2).where("doc_id = 0").orderBy("rank").collect()
    assert [r["rank"] for r in top] == [1, 2] and abs(top[0]["total"]) >= abs(top[1]["total"])
    assert [r["language"] for r in model.language(rows).collect()] == [None] * 4
    back, accepted = model.unlearn(texts(spark, "free seo offer, buy views"), "spam", 0)
    assert accepted and back.site.texts_spam == 1
    with pytest.raises(ValueError):
        model.unlearn(rows, "spam", 1)
    assert model.unlearn(rows, "spam", -2)[1] is False
    with pytest.raises(ValueError):
        model.rotate()


def test_log_counts_damp(spark):
    site = EvidenceModel(Layer.empty(spark, 12), hash_mode="md5").learn(texts(spark, "spam spam"), "spam")[0].site
    rows = texts(spark, "spam " * 8)
    plain = EvidenceModel(site, hash_mode="md5").classify(rows).first()["log_odds"]
    damped = EvidenceModel(site, hash_mode="md5", params=ModelParams(log_counts=True))
    total = damped.explain(rows).agg(F.sum("total")).first()[0]
    assert 0 < damped.classify(rows).first()["log_odds"] < plain
    assert total == pytest.approx(damped.classify(rows).first()["log_odds"])


FR = ["le chat dort sur le canapé", "nous allons à la plage demain", "merci pour votre message"]
EN = ["the cat sleeps on the sofa", "we are going to the beach tomorrow", "thanks for your message"]


def spoken(spark):
    from textassay.operators.features import hashed_bags

    tables = {}
    for lang, rows in (("en", EN), ("fr", FR)):
        bag = hashed_bags(texts(spark, *rows), mode="md5").select("h", "cnt")
        tables[lang] = CountTable.of(bag, 12)
    return LanguageSet.of(tables)


def test_languages(spark):
    langs = spoken(spark)
    model = EvidenceModel(layer(spark, {1: 1}, {2: 1}, 12), background=langs, hash_mode="md5")
    rows = texts(spark, "le chat est sur la plage", "the cat is on the beach", "", None)
    assert [r["language"] for r in model.language(rows).orderBy("doc_id").collect()] == ["fr", "en", "en", "en"]
    site = EvidenceModel(Layer.empty(spark, 12), hash_mode="md5").learn(texts(spark, "le chat", "the cat"), "spam")[0].site
    by_set = {r["doc_id"]: r["log_odds"] for r in EvidenceModel(site, background=langs, hash_mode="md5").classify(rows).collect()}
    for k, lang in ((0, "fr"), (1, "en")):
        one = EvidenceModel(site, background=langs.select(lang), hash_mode="md5").classify(rows).where(F.col("doc_id") == k).first()
        assert one["log_odds"] == pytest.approx(by_set[k])
    with pytest.raises(ValueError):
        LanguageSet(langs.tables, {})


def test_likelihood_equals_the_long_form(spark):
    from textassay.operators.features import hashed_bags

    langs = spoken(spark)
    bag = hashed_bags(texts(spark, "the cat dort"), mode="md5")
    got = {r["lang"]: r["score"] for r in langs.likelihoods(bag).collect()}
    for lang, (bits, total) in langs.meta.items():
        counts = {r["slot"]: r["cnt"] for r in langs.select(lang).counts.collect()}
        want = sum(r["cnt"] * math.log((counts.get(r["h"] & ((1 << bits) - 1), 0) + 0.2 * total / (1 << bits)) / (total * 1.2)) for r in bag.collect())
        assert got[lang] == pytest.approx(want)


def test_score_columns_and_verdict(spark):
    rows = spark.createDataFrame([(1, 2.0, 4), (2, 0.0, 0), (3, -1.0, 1)], "doc_id long, log_odds double, occurrences long")
    got = {r["doc_id"]: r for r in with_score_columns(rows).withColumn("v", verdict(F.col("evidence"))).collect()}
    assert (got[1]["mean_log_odds"], got[1]["evidence"], got[1]["v"]) == (0.5, 1.0, "hold")
    assert (got[2]["evidence"], got[2]["probability"], got[2]["v"]) == (0.0, 0.5, "review")
    assert got[3]["v"] == "deliver"
