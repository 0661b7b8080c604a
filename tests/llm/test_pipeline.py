import random
from itertools import combinations

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textassay.llm import secret_scan, toxicity
from textassay.llm.packing import default_vocabulary

from .helpers import clashing, documents
from .test_simhash import brute_fingerprint
from .test_similar import all_pairs, components, edited

BASE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows after each stage, written and read as the pipeline does."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        stage(spark, out[-1], BASE).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_names_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "simhash", "secrets", "mixing", "packing"]
    assert all(df.columns == stages[0].columns for df in stages[1:-1])


def test_toxicity_drops_what_the_model_calls_toxic(spark, stages):
    model = toxicity.fit(stages[0], spark.read.parquet(f"{BASE}/labels.parquet"))
    clean = toxicity.grade_documents(stages[0], model).where(~F.col("__toxicity.toxic"))
    assert texts(stages[1]) == texts(clean) and 0 < stages[1].count() < stages[0].count()


def test_copies_go_and_the_first_stays(stages):
    before, after = texts(stages[1]), texts(stages[2])
    assert set(after.items()) <= set(before.items())
    assert len(set(after.values())) == len(after)
    first = {}
    for i in sorted(before):
        first.setdefault(before[i], i)
    assert {before[i] for i in after} <= set(first) and all(first[t] == i for i, t in after.items())


def test_near_copies_by_simhash_and_by_shingles_are_one_set_of_groups(spark):
    """By brute force: pairs within two bits, pairs at 0.8 or more, and chains of both; the smallest id of each group stays."""
    rng = random.Random(6)
    texts = {}
    for k in range(12):
        base = [f"b{k}w{n}" for n in range(200)]
        tail = [f"t{k}w{n}" for n in range(25)]
        few = "again " * 60
        # one fingerprint, few shingles in common; then a copy of the second by shingles
        texts |= {10 * k: few + " ".join(tail), 10 * k + 1: few + " ".join(tail[:10] + tail[18:]), 10 * k + 2: few + " ".join(tail[:10] + tail[18:] + ["end"])}
        texts |= {10 * k + 3 + n: edited(base, rng, f"{k}x{n}", n) for n in range(5)}
    texts |= {200: None, 201: "", 202: " \n", 203: "only here"}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    by_bits = {(a, b) for a, b in combinations(texts, 2) if (prints[a] ^ prints[b]).bit_count() <= 2}
    by_shingles = all_pairs({i: t or "" for i, t in texts.items()})
    assert len(by_bits - by_shingles) > 10 and len(by_shingles - by_bits) > 10
    alone = [set(components(texts, p).values()) for p in (by_bits, by_shingles)]
    want = set(components(texts, by_bits | by_shingles).values())
    assert want < alone[0] and want < alone[1]
    got = cp.drop_near_copies(spark, documents(spark, [(i, t) for i, t in texts.items()] + [(300 + i, t) for i, t in texts.items()]), BASE)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(want)
    assert all(r["text"] == texts[r["doc_id"]] for r in got.collect())


def test_secrets_are_masked(stages):
    before, after = texts(stages[2]), texts(stages[3])
    vocab = secret_scan.default_vocabulary()
    assert set(before) == set(after)
    for i, t in before.items():
        assert after[i] == secret_scan.masked(t, secret_scan.spans(t, vocab))
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3].collect())


def test_the_mix_and_its_pieces(spark, stages):
    """Packing gives back the ids of each copy that the mix holds."""
    t = Tokenizer.from_file(default_vocabulary())
    want = sorted((r["doc_id"], len(t.encode(r["text"]).ids) + 1) for r in stages[4].collect())
    got = sorted((r["doc_id"], r["doc_tokens"]) for r in stages[5].where("start = 0").collect())
    assert got == want
    assert stages[5].agg(F.sum("length")).first()[0] == sum(n for _, n in want)
    sizes = {}
    for r in stages[3].collect():
        sizes[r["doc_id"]] = len(r["text"].split())
    taken = {}
    for r in stages[4].collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(r["text"].split())
    assert all(taken[i] <= 3 * sizes[i] for i in taken)
    assert abs(sum(taken.values()) - sum(sizes.values())) <= 20


def test_run_gives_the_last_stage(spark, stages):
    key = lambda df: sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in df.collect())
    assert key(cp.run(spark, BASE)) == key(stages[-1])


def test_awkward_rows(spark, tmp_path):
    docs = clashing(documents(spark, [(1, None), (1, None), (None, ""), (2, "word " * 30000), (3, "a token = abcdefgh1 b")]))
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, BASE).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == len(cp.STAGES) - 1 or "shard" in docs.columns
        assert cp.STAGES[k][1](spark, documents(spark, []).limit(0), BASE).count() == 0
    assert docs.count() > 0
