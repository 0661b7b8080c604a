import random
from contextlib import contextmanager

import numpy as np

from textassay.llm import topk


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute(rows, queries, k):
    fine = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    seen = {(i, tuple(np.float32(v).tolist())) for i, v in rows if i is not None and fine(v)}
    asked = {(i, tuple(np.float32(v).tolist())) for i, v in queries if i is not None and fine(v)}
    ints = lambda v: [int(np.floor(256 * x)) for x in v]
    out = []
    for q in sorted({i for i, _ in asked}):
        found = sorted((-sum(a * b for a, b in zip(ints(v), ints(w), strict=False)), i) for qi, v in asked if qi == q for i, w in seen if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return out


@contextmanager
def sizes(**new):
    old = {n: getattr(topk, n) for n in new}
    for n, x in new.items():
        setattr(topk, n, x)
    try:
        yield
    finally:
        for n, x in old.items():
            setattr(topk, n, x)


def run(spark, rows, queries, k=5):
    got = topk.search(frame(spark, rows), frame(spark, queries), k)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect())


def test_against_brute_force_in_many_blocks(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(13)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(20)]  # ties beyond k
    queries = [r for r in rows if r[0] % 10 == 0]
    with sizes(QUERY_BLOCK=8, ROW_BLOCK=50, AT_ONCE=100):
        assert run(spark, rows, queries) == brute(rows, queries, 5)


def test_few_scores_are_resolved(spark):
    """Behind the safe cutoff most entries lie below the threshold in every list."""
    rng = np.random.default_rng(2)
    m = rng.normal(size=(1200, 64))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(m)]
    queries = rows[::50]
    with sizes(ROW_BLOCK=400):
        found, work = topk.counted(frame(spark, rows), frame(spark, queries))
        resolved, pairs = work.groupBy().sum().first()
        assert pairs == len(rows) * len(queries) and 0 < resolved < 0.3 * pairs
        assert found.count() < 0.05 * pairs
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert run(spark, rows, queries) == brute(rows, queries, 5)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_components_beyond_any_product(spark):
    rows = [(0, [1e307, 1.0]), (1, [1.0, 2.0]), (2, [-1e307, 0.5]), (3, [0.0, 0.25]), (50, [1e307, -1e307])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.search(df, df.where("vec_id % 50 = 0")).collect()))
    ints = {i: [int(x) * 256 if abs(x) > 1e300 else int(np.floor(256 * x)) for x in v] for i, v in rows}
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = []
    for q in (0, 50):
        found = sorted((-clip(sum(a * b for a, b in zip(ints[q], w, strict=True))), i) for i, w in ints.items() if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    assert got == want


def test_awkward_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [0.5, 0.5]), (0, [0.5, 0.5]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (None, [9.0, 9.0]), (5, [1.0]), (6, []), (7, [1.0, -1.0]), (50, [1.0, 1.0])]
    assert run(spark, rows, rows) == brute(rows, rows, 5)
    assert run(spark, rows[:1], rows[:1]) == [] and run(spark, [], []) == [] and run(spark, rows, []) == []


def test_large_components_are_exact(spark):
    big = float(2**40)
    rows = [(k, [big, float(k)]) for k in range(4)]
    wide = [(i, [int(256 * x) for x in v]) for i, v in rows]
    got = run(spark, rows, rows[:1])
    assert [r[2] for r in got] == [1, 2, 3]
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    assert [r[3] for r in got] == [clip(sum(a * b for a, b in zip(wide[0][1], w, strict=True))) for _, w in wide[1:]]


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = [(k, [float(k), 1.0]) for k in range(6)]
    df = frame(spark, rows).withColumns({"rank": F.lit("x"), "score": F.lit(None), "block": F.lit(1), "v": F.lit(2), "query_id": F.lit(3)})
    assert sorted(map(tuple, topk.search(df, df.where("vec_id = 0"), 2).collect())) == [r for r in brute(rows, rows[:1], 2)]
