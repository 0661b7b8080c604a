import pytest

from textassay.sources.database import Database
from textassay.sources.store import CountStore


def held(store):
    return sorted(map(tuple, store.counts().collect()))


def test_a_store_goes_through_a_database(spark, tmp_path):
    url = f"jdbc:derby:memory:{tmp_path.name};create=true"
    options = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    store = CountStore(spark, f"file://{tmp_path}/one").install(10)
    bag = spark.createDataFrame([(1, 5), (900, 2), (1025, 1)], "h long, cnt long")
    store.apply(bag, "spam", 1, 3)
    store.rotate()
    store.apply(bag, "ham", 1, 2)
    db = Database(spark, url, "site_", **options)
    db.save(store)
    assert db.meta()["bits"] == 10 and db.meta()["generation"] == 1
    again = db.load_into(f"file://{tmp_path}/two")
    assert held(again) == held(store) and again.tally() == store.tally() and again.version() == store.version()
    again.apply(bag, "ham", -1, 2)
    assert again.tally().recent_ham == 0
    db.save(again)
    assert held(db.load_into(f"file://{tmp_path}/three")) == held(again)
    with pytest.raises(RuntimeError):
        again.take_over(store.counts(), {})


def test_tables_of_other_versions_are_refused(spark, tmp_path):
    url = f"jdbc:derby:memory:{tmp_path.name};create=true"
    options = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = spark.createDataFrame([("schema", "9"), ("hash", "1"), ("bits", "10")], "name string, value string")
    rows.write.format("jdbc").options(url=url, dbtable="meta", createTableColumnTypes="name VARCHAR(32), value VARCHAR(64)", **options).save()
    with pytest.raises(RuntimeError):
        Database(spark, url, **options).meta()
    with pytest.raises(ValueError):
        Database(spark, url, "a;b")
