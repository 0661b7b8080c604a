import __spark_entry__ as entry
import pytest

from textassay.plans.oracles import ORACLES
from textassay.plans.queries import QUERIES


def test_every_query_but_one_has_a_twin():
    assert set(QUERIES) - set(ORACLES) == {"hash_xxh3"} and set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, small, same, name):
    same(QUERIES[name](spark, small), ORACLES[name])


def test_hash_xxh3(spark, small):
    from textassay.functions.hashing import xxh3_32

    rows = QUERIES["hash_xxh3"](spark, small).limit(200).collect()
    assert rows and all(r["h"] == xxh3_32(r["feature"]) and r["slot"] == r["h"] % (1 << 20) for r in rows)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["doc_id", "log_odds", "occurrences"] and df.count() == 200
