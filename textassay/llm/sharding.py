"""Reproducible shuffle and sharding by a Feistel permutation with cycle walking.

Rows are numbered 0 .. N-1 in the order of a digest of their id, content
telling equal ids apart: ranges of the digest are counted first, so a row's
number is its range's offset plus its place in the range, and no task sees all
rows. Equal rows are counted before they meet and dealt out again behind, so a row
that stands a million times weighs on no task. A Feistel network over the smallest even-bit domain that holds N permutes
the numbers; results of N or more walk on through the network until they fall
below N. Shard is the permuted number modulo the shard count, slot its
quotient, so both can be computed from a row number alone, and read back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut, ship, text_of

# Multipliers and increments of the rounds, and the prime they work under.
MULTIPLIERS = (1103515245, 1664525 * 647, 22695477 * 89, 69069 * 15401)
INCREMENTS = (12345, 1013904223, 1442695041, 1234567891)
PRIME = (1 << 31) - 1

#: Rows of a range of digests, about, and most hexadecimal digits of the ranges (their offsets meet in one task).
RANGE_ROWS, DIGITS = 5_000, 5
#: Copies of a row that one task deals out at once.
COPIES = 1 << 16


def half_bits(n: int) -> int:
    """Bits of each half of the smallest balanced domain that holds n numbers."""
    if n > 1 << 48:
        raise ValueError("at most 2**48 rows")
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _round(right, k: int, seed: int, mask):
    t = (right * MULTIPLIERS[k] + INCREMENTS[k] + seed) % PRIME
    t = (t * t + MULTIPLIERS[-1 - k]) % PRIME
    return (t >> 5) & mask if mask < (1 << 24) else t & mask


def permute(numbers: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A bijection of 0 .. n-1, the same on every machine."""
    h = half_bits(n)
    mask = (1 << h) - 1
    out = numbers.astype(np.int64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> h, out[todo] & mask
        for k in range(len(MULTIPLIERS)):
            left, right = right, left ^ _round(right, k, seed, mask)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n]
    return out


def restore(numbers: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The inverse of ``permute``."""
    h = half_bits(n)
    mask = (1 << h) - 1
    out = numbers.astype(np.int64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> h, out[todo] & mask
        for k in reversed(range(len(MULTIPLIERS))):
            left, right = right ^ _round(left, k, seed, mask), left
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n]
    return out


def digest(key: str, *content: Column) -> Column:
    return F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), *[c.cast("string") for c in content]))


def _before(window):
    return window.rowsBetween(W.unboundedPreceding, -1)


def shards(documents: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """key, __size, __crc32, __row (number before the shuffle), shard and slot for each row.

    Sizes of shards differ by one row at most. A null key or text counts as empty in
    the digest. Repeated rows get numbers of their own; which copy gets which does not
    show. An empty table gives none. Other columns are left out.
    """
    ship(documents.sparkSession)
    body = text_of(text)
    rows = documents.select(F.col(key).alias("key"), (F.octet_length(body) + 1).cast("long").alias("__size"), F.crc32(F.encode(body, "UTF-8")).alias("__crc32"))
    rows = cut(rows.withColumn("__digest", digest("key", F.col("__crc32"), F.col("__size"))))
    n = rows.count()
    digits = next(d for d in range(1, DIGITS + 1) if n <= RANGE_ROWS * 16**d or d == DIGITS)
    held = rows.groupBy("__digest", "key", "__crc32", "__size").agg(F.count("*").alias("members")).withColumn("__range", F.substring("__digest", 1, digits))
    held = cut(held)
    per_range = held.groupBy("__range").agg(F.sum("members").alias("members"))
    start = per_range.select("__range", F.coalesce(F.sum("members").over(_before(W.orderBy("__range"))), F.lit(0)).alias("__start"))  # at most 16 ** DIGITS rows
    inside = W.partitionBy("__range").orderBy("__digest", F.col("key").asc_nulls_first(), "__crc32", "__size")
    held = held.withColumn("__within", F.coalesce(F.sum("members").over(_before(inside)), F.lit(0))).join(start, "__range")
    # copies are alike: a row's block of them, then each of a block
    held = held.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("members") - 1) / COPIES))))
    if n > COPIES and not held.where("__block > 0").isEmpty():
        held = held.repartition("__digest", "__block")
    last = F.least(F.col("members") - F.col("__block") * COPIES, F.lit(COPIES)) - 1
    rows = held.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    rows = rows.withColumn("__row", (F.col("__start") + F.col("__within") + F.col("__block") * COPIES + F.col("__copy")).cast("long"))

    @F.pandas_udf("bigint")
    def shuffled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(permute(batch.to_numpy(np.int64), max(n, 1), seed))

    rows = rows.withColumn("__at", shuffled.asNondeterministic()("__row"))
    return rows.select("key", "__size", "__crc32", "__row", F.pmod("__at", F.lit(n_shards)).cast("int").alias("shard"), F.floor(F.col("__at") / n_shards).cast("long").alias("slot"))
