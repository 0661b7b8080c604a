import pytest
from pyspark.sql import functions as F

from textassay.functions.hashing import feature_hash, slot, xxh3_32

VECTORS = {"w:bonjour": (913534137, 224441), "w:bonsoir": (1860736085, 562261), "c3:_bo": (3874848596, 360276), "host:example.com": (2997819620, 989412), "": (755400709, 425989), "sym:€": (3793197212, 497820)}


def test_vectors(spark):
    assert {f: xxh3_32(f) for f in VECTORS} == {f: h for f, (h, _) in VECTORS.items()}
    rows = spark.createDataFrame([(f,) for f in VECTORS], "feature string")
    got = rows.select("feature", feature_hash(F.col("feature")).alias("h")).withColumn("s", slot(F.col("h"), 20)).collect()
    assert {r["feature"]: (r["h"], r["s"]) for r in got} == VECTORS


def test_md5_has_32_bits_and_modes_are_checked(spark):
    h = spark.range(1).select(feature_hash(F.lit("w:a"), "md5").alias("h")).first()["h"]
    assert 0 <= h < 2**32
    with pytest.raises(ValueError):
        feature_hash(F.lit("x"), "crc")
