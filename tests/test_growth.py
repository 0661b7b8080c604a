"""What keeps tasks, shuffles and the driver small on large tables."""

import random

from pyspark.sql import functions as F

from textassay.operators import features as fx
from textassay.operators.layers import Layer
from textassay.plans import queries
from textassay.plans.model import EvidenceModel
from textassay.sources import store as stores
from textassay.streaming.learning import labelled_events


def test_folded_bags_match_a_literal_fold(spark, monkeypatch):
    """Store steps (F6, F18, F19, F20): bags are folded in order in several parts, no row an occurrence is sorted."""
    monkeypatch.setattr(stores, "PART", 4)
    rng = random.Random(3)
    steps = [(seq, rng.choice(["count_ham", "count_spam"]), rng.choice([1, 1, -1]), [(rng.randrange(6), rng.randrange(1, 4)) for _ in range(rng.randrange(4))]) for seq in range(60)]
    rows = [(seq, counter, sign, [(h << 32) | n for h, n in bag]) for seq, counter, sign, bag in rng.sample(steps, len(steps))]
    found = stores.folded_bags(spark.createDataFrame(rows, "seq long, counter string, sign int, bag array<long>"), 8).collect()
    for start in (0, 2):
        wanted = {}
        for _, counter, sign, bag in steps:
            for h, n in bag:
                wanted[h, counter] = max(0, wanted.get((h, counter), start) + sign * n)
        assert {(r["slot"], r["counter"]): max(start + r["total"], r["total"] - r["low"]) for r in found} == wanted


def test_a_stream_batch_is_numbered_without_its_texts(spark):
    """sorting samples its keys to the driver, so texts are none of them; events are a row a text."""
    batch = spark.createDataFrame([(2, "b " * 50, "ham"), (1, "tea tea", "spam"), (1, "tea", "ham")], "doc_id long, text string, label string")
    events, rows = labelled_events(batch, fx.ExtractParams(), "md5")
    assert events.count() == rows.count() == 3 and "bag" in events.columns
    assert [r["label"] for r in rows.orderBy("seq").collect()] == ["ham", "spam", "ham"]


def test_the_strongest_features_are_the_first_of_all(spark):
    """few features of a text are left to be sorted, ties broken by name."""
    learned = spark.createDataFrame([(1, "spam", "buy cheap pills now"), (2, "ham", "see you at the office now")], "doc_id long, label string, text string")
    m = EvidenceModel(Layer.empty(spark, 12), hash_mode="md5")
    for label in ("ham", "spam"):
        m, _ = m.learn(learned.where(F.col("label") == label), label)
    rng = random.Random(1)
    words = "buy cheap pills now see you at the office zeta eta theta iota kappa lambda".split()
    texts = spark.createDataFrame([(n, " ".join(rng.choices(words, k=40)) + (" a@b.example" if n % 5 == 0 else "")) for n in range(40)] + [(99, "one two three four five six seven")], "doc_id long, text string")

    def top(rows):
        out = {}
        for r in rows:
            out.setdefault(r["doc_id"], []).append((-abs(round(r["total"], 6)), r["feature"], r["cnt"], round(r["log_ratio"], 6)))
        return {k: sorted(v)[:5] for k, v in out.items()}

    all_, some = m.explain(texts).collect(), m.strongest(texts, 5).collect()
    assert top(all_) == top(some) and len(some) < len(all_) / 2
    assert len(m.strongest(texts.union(texts), 5).collect()) == len(all_)


def test_rows_of_a_task_are_bounded(spark, small, monkeypatch):
    """more hashes are told apart in more tasks."""
    monkeypatch.setattr(queries, "HASH_ROWS", 1000)
    assert queries.by_hash(spark, small).rdd.getNumPartitions() > 20


def test_texts_go_to_python_a_few_at_a_time(spark, small):
    """Arrow batches of whole texts are bounded."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10000")
    queries.feat_compatible(spark, small)
    assert int(spark.conf.get(key)) <= 512


def test_bags_are_not_shuffled_for_their_sizes_and_totals(spark, small):
    """no exchange holds a row a text and feature."""
    for name in ("feat_bag", "feat_family_totals"):
        plan = queries.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [doc_id" not in plan or "__row" in plan


def test_corpora_are_extracted_once(spark, small, monkeypatch):
    """What is learned and what is scored come from the same bags."""
    runs, real = [], fx.packed
    monkeypatch.setattr(fx, "packed", lambda *a, **k: runs.append(1) or real(*a, **k))
    for name in ("language_confusion", "classify_background", "explain_sums", "background_files"):
        runs.clear()
        queries.QUERIES[name](spark, small)
        assert len(runs) == 1
