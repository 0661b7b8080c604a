from textassay import EvidenceModel
from textassay.sources.store import CountStore
from textassay.streaming.learning import classify_stream, learn_batch, learn_stream

SCHEMA = "doc_id long, text string, label string, ts timestamp"


def test_learn_and_classify_streams(spark, tmp_path):
    rows = [(k, text, label, None) for k, (text, label) in enumerate([("buy links now", "spam"), ("a quote please", "ham"), ("", "ham"), ("buy views", "spam")])]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/in")
    store = CountStore(spark, f"file://{tmp_path}/store").install(12)
    texts = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    learn_stream(texts, store, f"{tmp_path}/c1", mode="md5").awaitTermination()
    t = store.tally()
    assert (t.learned_spam, t.learned_ham) == (2, 2) and store.load().total_spam == 8
    learn_stream(texts, store, f"{tmp_path}/c1", mode="md5").awaitTermination()
    assert store.tally() == t
    model = EvidenceModel(store.load(), hash_mode="md5")
    classify_stream(texts, lambda: model, f"{tmp_path}/out", f"{tmp_path}/c2").awaitTermination()
    got = {r["doc_id"]: r["log_odds"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(got) == 4 and got[0] > 0 > got[1] and got[2] == 0


def test_late_texts_go_to_the_archive(spark, tmp_path):
    store = CountStore(spark, f"file://{tmp_path}/store").install(12)
    rows = spark.sql("SELECT 1L AS doc_id, 'old one' AS text, 'ham' AS label, timestamp '2024-01-01' AS ts UNION ALL SELECT 2L, 'new one', 'ham', timestamp '2025-06-01'")
    learn_batch(store, mode="md5", last_rotation="2025-01-01 00:00:00")(rows, 0)
    meta = store.meta()
    assert (meta["texts_ham"], meta["archive_texts_ham"], meta["learned_ham"]) == (1, 1, 2)


def test_a_batch_is_the_fold_of_its_rows(spark, tmp_path):
    """Rows of one id, of one class or several, equal ones too, each count; learning one by one gives the same store."""
    rows = [(1, "buy links now", "spam", 1), (1, "buy links now", "spam", 1), (2, "a quote please", "ham", 1), (2, "buy it", "spam", 1), (2, None, "ham", 1), (3, "a quote", "ham", -1), (3, "a quote", "ham", -1), (3, "a quote", "ham", 1)]
    schema = "doc_id long, text string, label string, sign int"
    whole, single = (CountStore(spark, f"file://{tmp_path}/{name}").install(12) for name in ("whole", "single"))
    learn_batch(whole, mode="md5")(spark.createDataFrame(rows, schema).repartition(3), 0)
    order = sorted(rows, key=lambda r: (r[0], -r[3], r[2], r[1] is not None, r[1] or ""))
    for k, row in enumerate(order):
        learn_batch(single, mode="md5")(spark.createDataFrame([row], schema), k)
    held = lambda s: sorted(map(tuple, s.counts().collect()))
    assert held(whole) == held(single) and whole.tally() == single.tally() and whole.version() == single.version() == len(rows)
    twice = CountStore(spark, f"file://{tmp_path}/twice").install(12)
    learn_batch(twice, mode="md5")(spark.createDataFrame([(7, "one two", "ham", 1)] * 2, schema), 0)
    assert twice.tally().learned_ham == 2 and twice.load().total_ham == 6
