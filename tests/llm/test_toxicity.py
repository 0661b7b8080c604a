import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textassay.llm.queries import QUERIES
from textassay.llm.toxicity import PER, PRIOR, OrdinalModel, clean, features_of, fit, fit_rows, grade_documents, objective, row_of, within

from .helpers import clashing, documents, rows


def synthetic():
    rng = np.random.default_rng(0)
    texts, toxic = [], []
    for k in range(600):
        bad = k % 4 == 0
        words = [f"{rng.choice(list('abcdefgh'))}{rng.choice(list('klmnop'))}{n}x" for n in range(20)]
        texts.append(" ".join(words + ["vile"] * (1 + k % 3) * bad + ["nasty"] * (k % 5) * bad))
        toxic.append(int(bad))
    kept = np.array(sorted({f for w in ("vile", "nasty") for f in features_of(w)}), np.int64)
    return kept, [within(*row_of(t), kept) for t in texts], np.array(toxic)


def brute_score(model, text):
    """Each word by itself, in floating point."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    return sum(model.weights.get(f, 0.0) for w in words for f in features_of(w)) * PER / (len(words) + PRIOR)


def test_fit_recovers_an_order():
    model = fit_rows(*synthetic())
    assert list(model.theta) == sorted(model.theta) and len(model.theta) == 3
    filler = "ak bl cm dn eo fp gk hl am bn"
    above = model.above(np.array([brute_score(model, f"{filler} {t}") for t in ("", "vile", "vile vile nasty", "vile vile vile nasty nasty nasty nasty")]))
    severity = above.sum(axis=1)
    assert above[0, 0] < 0.1 and above[1, 0] > 0.5 and (np.diff(severity) > 0).all()
    assert (np.diff(above, axis=1) <= 0).all()


def test_gradient_against_differences():
    """The loss by its definition, row by row, and its gradient by differences."""
    rng = np.random.default_rng(1)
    kept, rows_, toxic = synthetic()
    f = objective(kept, rows_[:80], toxic[:80], 1e-3)
    p = rng.normal(size=len(kept) + 3) * 0.3
    w, theta = f.unpack(p)
    sig = lambda z: 1 / (1 + np.exp(-z))
    total = 0.0
    for (at, x), g in zip(rows_[:80], f.grade, strict=True):
        s = float((w[at] * x).sum())
        total -= np.log((1.0 if g == 3 else sig(theta[g] - s)) - (0.0 if g == 0 else sig(theta[g - 1] - s)))
    assert f.value(p) == pytest.approx(total / 80 + 1e-3 / 2 * (w * w).sum(), rel=1e-9)
    for k in range(len(p)):
        step = np.zeros(len(p))
        step[k] = 1e-6
        assert f.gradient(p)[k] == pytest.approx((f.value(p + step) - f.value(p - step)) / 2e-6, abs=1e-6)


def test_the_fit_is_near_the_least_loss():
    kept, rows_, toxic = synthetic()
    f = objective(kept, rows_, toxic, 2e-5)
    model, longer = fit_rows(kept, rows_, toxic), fit_rows(kept, rows_, toxic, steps=4000)
    pack = lambda m: np.concatenate([[m.weights.get(int(k), 0.0) for k in kept], m.theta[:1], np.log(np.diff(m.theta))])
    start = np.concatenate([np.zeros(len(kept)), [1.0, 0.0, 0.0]])
    assert f.value(pack(model)) < f.value(pack(longer)) + 0.05 * f.value(start)


def test_one_class_tells_nothing_apart():
    for toxic in ([0, 0], [1, 1], []):
        model = fit_rows(np.array([1]), [(np.array([0]), np.array([1.0]))] * len(toxic), np.array(toxic, int))
        assert not model.weights and model.above(np.zeros(1))[0, 0] < 0.5


def test_held_out_accuracy_in_every_language(spark):
    """Fit on the labelled rows of one half by hash, judged on the other; labels themselves are about one percent wrong."""
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    half = labels.selectExpr("*", "pmod(xxhash64(doc_id), 2) AS half")
    model = fit(docs, half.where("half = 0"))
    got = grade_documents(docs, model).join(half.where("half = 1").select("doc_id", "toxic"), "doc_id").select("toxic", "__toxicity.toxic", "lang").toDF("label", "toxic", "lang").collect()
    for lang in ("en", "fr", "de", "es"):
        clean_, bad = ([r["toxic"] for r in got if r["lang"] == lang and r["label"] == label] for label in (0, 1))
        assert sum(clean_) <= 0.02 * len(clean_), lang
        assert len(bad) >= 15 and sum(bad) >= 0.85 * len(bad), lang


def test_query(spark, small):
    got = QUERIES["op3_toxicity"](spark, small)
    n = spark.read.parquet(f"{small}/documents.parquet").count()
    seen = got.collect()
    assert got.columns == ["doc_id", "grade", "expected_severity", "p_toxic", "toxic"] and len(seen) == n
    assert all(0 <= r["expected_severity"] <= 3 and r["toxic"] == (r["p_toxic"] >= 0.5) for r in seen)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model, texts = fit(docs, spark.read.parquet(f"{small}/labels.parquet")), {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert model.weights
    for r in seen:
        above = model.above(np.array([brute_score(model, texts[r["doc_id"]])]))[0]
        assert (r["p_toxic"], r["expected_severity"]) == (pytest.approx(above[0], abs=1e-9), pytest.approx(above.sum(), abs=1e-9))


def test_awkward_rows(spark):
    model = OrdinalModel({}, np.array([2.0, 3.0, 4.0]))
    df = clashing(documents(spark, [(1, None), (1, None), (None, ""), (2, "x" * 100_000)]))
    out = grade_documents(df, model)
    assert out.columns == [*df.columns, "__toxicity"]
    assert [r["__toxicity"]["p_toxic"] for r in out.collect()] == [pytest.approx(0.1192, abs=1e-4)] * 4
    assert grade_documents(df.limit(0), model).count() == 0
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    assert not fit(df, labels).weights and not fit(df.limit(0), labels.limit(0)).weights
    assert rows(df.limit(0)) == []
    named = df.withColumn("__toxicity", F.lit("own"))
    assert rows(clean(named, model)) == rows(named) and rows(clean(named, OrdinalModel({}, np.array([-2.0, 0, 1])))) == []


def test_ids_of_any_type_and_a_bound_on_rows(spark):
    docs = spark.createDataFrame([(f"d{k % 7}", f"{'vile nasty ' * (k % 7 % 2)}some words w{k}") for k in range(400)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{k}", k % 2) for k in range(7)], "doc_id string, toxic int")
    model = fit(docs, labels)
    assert model.weights and fit(docs, labels, max_rows=60).weights == fit(docs, labels, max_rows=60).weights
    assert [r["toxic"] for r in grade_documents(docs.limit(2), model).select("__toxicity.toxic").collect()] == [False, True]
