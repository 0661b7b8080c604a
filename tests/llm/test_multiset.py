import hashlib
import math

import pytest
from pyspark.sql import functions as F

from textassay.llm import multiset as ms
from textassay.llm.queries import QUERIES

from .helpers import clashing, documents, rows


def strong(text):
    out = [0] * 8
    for p in (p for p in text.split("\n") if p):
        d = hashlib.sha256(p.encode()).hexdigest()
        out = [(x + int(d[8 * k : 8 * k + 8], 16)) % 2**32 for k, x in enumerate(out)]
    return out


def lanes(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").select("k", ms.strong_part(F.col("text")).alias("s"), ms.sketch_part(F.col("text")).alias("w"))
    return [(r["s"], r["w"]) for r in df.orderBy("k").collect()]


def test_homomorphic(spark):
    a, b, ab, ba, twice = lanes(spark, ["one. two", "three\nfour. five", "one. two\nthree\nfour. five", "four. five\nthree\none. two", "one. two\n\none. two"])
    assert a[0] == strong("one. two") and ab == ba and ab != a
    assert [(x + y) % 2**32 for x, y in zip(a[0], b[0], strict=True)] == ab[0]
    assert [x + y for x, y in zip(a[1], b[1], strict=True)] == ab[1]
    assert twice[0] == [2 * x % 2**32 for x in a[0]] and twice[0] != a[0]
    df = spark.createDataFrame([(ab[0], b[0])], "x array<bigint>, y array<bigint>")
    assert df.select(ms.subtract(F.col("x"), F.col("y"))).first()[0] == a[0]
    assert df.select(ms.add(ms.subtract(F.col("x"), F.col("y")), F.col("y"))).first()[0] == ab[0]


def test_a_whole_fingerprint_follows_when_paragraphs_come_and_go(spark):
    """From strings alone, both parts equal those of the changed text; counts that wrap too."""
    cases = [("one. two", "three\nfour. five"), ("", "x. y"), ("a. b\na. b", "a. b"), ("same. " * 40_000, "same. " * 30_000)]
    df = spark.createDataFrame([(a, b, f"{a}\n{b}") for a, b in cases], "a string, b string, ab string")
    of = lambda c: ms.as_string(ms.strong_part(F.col(c)), ms.sketch_part(F.col(c)))
    df = df.select(*[of(c).alias(c) for c in df.columns])
    for r in df.select("*", ms.inserted(F.col("a"), F.col("b")).alias("grown"), ms.deleted(F.col("ab"), F.col("b")).alias("back")).collect():
        assert r["grown"] == r["ab"] and r["back"] == r["a"]


def test_ids_must_be_whole_numbers(spark):
    with pytest.raises(TypeError):
        ms.edited_pairs(documents(spark, [(1, "x")]).withColumn("doc_id", F.col("doc_id").cast("string")))


def test_long_repetition_wraps(spark):
    (_, w), = lanes(spark, ["same. " * 70_000])
    assert sorted(set(w)) in ([0, 70_000 - 65_536], [-(70_000 - 65_536), 0])


def brute(docs):
    order = sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 3
        out.append((i, len(t), hashlib.sha256((t[: len(t) - m] + nxt[:m]).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("group", [200, 3])
def test_next_and_edited_text(spark, group):
    docs = [(7 * k, f"text {k} " * (k % 5)) for k in range(40)] + [(10**12, "far away"), (None, "no id"), (None, None), (14, "twice"), (14, "twice"), (-5, "é🙂" * 9)]
    size, ms.GROUP_ROWS = ms.GROUP_ROWS, group
    try:
        got = ms.edited_pairs(clashing(documents(spark, docs)))
        assert rows(got, "doc_id", "n_chars", "edited_sha256") == brute(docs)
    finally:
        ms.GROUP_ROWS = size


def test_few_rows(spark):
    for docs in ([(1, "alone here")], [(1, "a"), (1, "b")], [(None, None)], [(1, None), (2, "")]):
        assert rows(ms.edited_pairs(documents(spark, docs)), "doc_id", "n_chars", "edited_sha256") == brute(docs)
    assert ms.edited_pairs(documents(spark, []).limit(0)).count() == 0


def test_likeness_tells_near_from_far(spark, small):
    got = QUERIES["op7_multiset_hash"](spark, small).collect()
    prints = {}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in got:
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 and len(r["fingerprint"]) == 64 + 256
        prints.setdefault(texts[r["doc_id"]], set()).add(r["fingerprint"])
        if r["fingerprint"] == r["edited_fingerprint"]:
            assert r["near_edited"] == 1
    assert all(len(f) == 1 for f in prints.values()) and len({f for x in prints.values() for f in x}) == len(prints)
    long_ = [r for r in got if r["n_chars"] > 1500]
    mean = lambda name: math.fsum(r[name] for r in long_) / len(long_)
    assert mean("near_edited") > 0.55 and mean("near_next") < 0.25


def test_no_python_on_the_executors(spark, small):
    plan = QUERIES["op7_multiset_hash"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
