"""Feature hashes: XXH3 as other implementations have it, and MD5 that every SQL engine has."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Version of the feature hash; tables of another version are refused.
HASH_VERSION = 1
MODES = ("xxh3", "md5")


def xxh3_32(feature: str) -> int:
    """The high 32 bits of XXH3-64 with seed 0."""
    import xxhash

    return xxhash.xxh3_64_intdigest(feature.encode("utf-8", "surrogatepass")) >> 32


@F.arrow_udf(T.LongType())
def _xxh3(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Each distinct feature of a batch is hashed once; the rows themselves stay in Arrow."""
    from xxhash import xxh3_64_intdigest

    for batch in batches:
        coded = batch.cast(pa.binary()).dictionary_encode()
        yield pa.array([xxh3_64_intdigest(f) >> 32 for f in coded.dictionary.to_pylist()], pa.int64()).take(coded.indices)


def feature_hash(feature: Column, mode: str = "xxh3") -> Column:
    """Unsigned 32-bit hash of a feature as a long."""
    if mode == "xxh3":
        return _xxh3(feature)
    if mode == "md5":
        return F.conv(F.substring(F.md5(feature), 1, 8), 16, 10).cast("long")
    raise ValueError(f"unknown hash {mode!r}: {', '.join(MODES)} are known")


def slot(h: Column, bits: int) -> Column:
    """The slot of a hash in a space of 2 ** bits."""
    return h.bitwiseAND((1 << bits) - 1)
