import hashlib
import zlib

import numpy as np
import pytest

from textassay.llm import sharding
from textassay.llm.queries import QUERIES

from .helpers import clashing, documents


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000, 4096, 4097])
def test_permutation(n):
    for seed in (0, 5):
        p = sharding.permute(np.arange(n), n, seed)
        assert sorted(p) == list(range(n)) and (sharding.restore(p, n, seed) == np.arange(n)).all()
    if n >= 1000:
        assert (sharding.permute(np.arange(n), n, 1) != sharding.permute(np.arange(n), n, 2)).mean() > 0.9


def test_large_domains_stay_in_range():
    n = (1 << 40) + 12345
    some = np.arange(0, n, n // 1000)
    p = sharding.permute(some, n)
    assert ((p >= 0) & (p < n)).all() and (sharding.restore(p, n) == some).all() and len(set(p.tolist())) == len(some)
    with pytest.raises(ValueError):
        sharding.half_bits((1 << 48) + 1)


def test_order_is_mixed():
    n = 10_000
    shard = sharding.permute(np.arange(n), n) % 8
    same = (shard[1:] == shard[:-1]).mean()
    assert 0.1 < same < 0.15
    halves = np.bincount(shard[: n // 2], minlength=8)
    assert abs(halves - n / 16).max() < 120


def brute(docs, n_shards=8):
    """Number the rows by digest, permute, deal."""
    made = []
    for i, t in docs:
        raw = (t or "").encode()
        crc, size = zlib.crc32(raw), len(raw) + 1
        made.append((hashlib.md5(f"{'' if i is None else i}:{crc}:{size}".encode()).hexdigest(), i, crc, size))
    made.sort(key=lambda r: (r[0], r[1] is not None, r[1] or 0))
    at = sharding.permute(np.arange(len(made)), max(1, len(made)))
    return sorted(((i, size, crc, int(p % n_shards), int(p // n_shards)) for (_, i, crc, size), p in zip(made, at, strict=True)), key=repr)


def got(df, n_shards=8):
    return sorted(((r["key"], r["__size"], r["__crc32"], r["shard"], r["slot"]) for r in sharding.shards(df, n_shards).collect()), key=repr)


def test_query(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = QUERIES["op10_sharding"](spark, small).collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in rows), key=repr) == brute(docs)
    slots = {}
    for r in rows:
        assert r["law"] == "rows" and r["grown_shard"] is None
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_awkward_rows(spark):
    docs = [(1, None), (1, None), (1, "é"), (None, "x"), (None, None), (2, "y" * 100_000)]
    assert got(clashing(documents(spark, docs)), 3) == brute(docs, 3)
    assert got(clashing(documents(spark, docs)).repartition(4), 3) == brute(docs, 3)
    assert got(documents(spark, docs[:1])) == brute(docs[:1])
    assert sharding.shards(documents(spark, docs).limit(0)).count() == 0


def test_a_row_that_stands_often(spark, monkeypatch):
    docs = [(7, "same")] * 500 + [(k, f"text {k}") for k in range(200)]
    want = brute(docs)
    assert got(documents(spark, docs)) == want
    monkeypatch.setattr(sharding, "COPIES", 64)
    monkeypatch.setattr(sharding, "RANGE_ROWS", 1)
    assert got(documents(spark, docs)) == want
