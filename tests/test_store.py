import os
import random
from itertools import count

import pytest

from textassay import EvidenceModel
from textassay.sources.contract import RULES, ContractError, check
from textassay.sources.snapshot import FileSnapshot
from textassay.sources.store import ConcurrentWriteError, CountStore, SnapshotCache

COLUMNS = ("count_ham", "count_spam", "archive_ham", "archive_spam")


@pytest.fixture
def store(spark, tmp_path):
    return CountStore(spark, f"file://{tmp_path}/store").install(10)


def bag(spark, counts):
    return spark.createDataFrame(list(counts.items()), "h long, cnt long")


def held(store):
    return {r["slot"]: tuple(r[c] for c in COLUMNS) for r in store.counts().collect()}


def test_empty_and_identity(spark, store, tmp_path):
    assert store.load().total() == 0 and store.load().bits == 10 and store.tally().generation == 0
    assert store.install(10).identity() == store.identity()
    assert CountStore(spark, f"file://{tmp_path}/other").install(10).identity() != store.identity()
    with pytest.raises(ValueError):
        store.install(12)
    for path in ("", "/", "a/*"):
        with pytest.raises(ValueError):
            CountStore(spark, path)
    for bits in (7, 25):
        with pytest.raises(ValueError):
            CountStore(spark, f"file://{tmp_path}/x{bits}").install(bits)
    with pytest.raises(RuntimeError):
        CountStore(spark, f"file://{tmp_path}/none").tally()


def test_accumulate_clamp_recover_fold(spark, store):
    store.apply(bag(spark, {1: 2, 5: 1}), "spam", 1)
    store.apply(bag(spark, {1: 3}), "spam", 1)
    assert held(store) == {1: (0, 5, 0, 0), 5: (0, 1, 0, 0)}
    store.apply(bag(spark, {1: 3}), "spam", -1)
    assert held(store)[1] == (0, 2, 0, 0)
    store.apply(bag(spark, {1: 2}), "ham", 1)
    store.apply(bag(spark, {1: 10, 2: 5}), "ham", -1)
    assert held(store)[1] == (0, 2, 0, 0) and 2 not in held(store) and store.tally().recent_ham == 0
    store.apply(bag(spark, {9: 3}), "spam", -1)
    store.apply(bag(spark, {9: 3}), "spam", 1)
    assert held(store)[9] == (0, 3, 0, 0)
    store.apply(bag(spark, {7: 1, 7 + 1024: 2, 7 + 3 * 1024: 4}), "ham", 1)
    assert held(store)[7] == (7, 0, 0, 0)


def test_version_moves(spark, store):
    seen = [store.version()]
    for args in ((1, False), (-1, False), (1, True)):
        store.apply(bag(spark, {1: 1}), "ham", args[0], archive=args[1])
        seen.append(store.version())
    store.rotate()
    seen.append(store.version())
    assert seen == sorted(set(seen))


def test_generations_and_rotation(spark, store):
    store.apply(bag(spark, {1: 4}), "spam", 1)
    store.apply(bag(spark, {1: 6, 4: 5}), "spam", 1, archive=True)
    assert {r["slot"]: r["count_spam"] for r in store.load().counts.collect()} == {1: 10, 4: 5}
    store.rotate()
    assert held(store) == {1: (0, 0, 0, 7), 4: (0, 0, 0, 2)}
    t = store.tally()
    assert (t.generation, t.recent_spam, t.learned_spam) == (1, 0, 2) and store.meta()["archive_texts_spam"] == 1
    store.rotate()
    assert held(store) == {1: (0, 0, 0, 3), 4: (0, 0, 0, 1)}
    store.rotate()
    store.rotate()
    assert held(store) == {}
    assert store.tally().learned_spam == 2
    store.apply(bag(spark, {1: 9}), "spam", -1, texts=5, archive=True)
    assert store.tally().learned_spam == 0


def literal(events, bits=10):
    rows, meta = {}, dict.fromkeys(("texts_ham", "texts_spam", "archive_texts_ham", "archive_texts_spam", "learned_ham", "learned_spam"), 0)
    for e in events:
        c = ("archive_" if e["archive"] else "count_") + e["label"]
        folded = {}
        for h, n in e["bag"].items():
            folded[h % (1 << bits)] = folded.get(h % (1 << bits), 0) + n * e["sign"]
        for s, d in folded.items():
            row = rows.setdefault(s, dict.fromkeys(COLUMNS, 0))
            row[c] = max(0, row[c] + d)
        for k in (("archive_" if e["archive"] else "") + "texts_" + e["label"], "learned_" + e["label"]):
            meta[k] = max(0, meta[k] + e["sign"])
    return {s: tuple(r[c] for c in COLUMNS) for s, r in rows.items() if any(r.values())}, meta


@pytest.mark.parametrize("seed", range(3))
def test_ordered_events_match_a_literal_fold(spark, tmp_path, seed):
    rng = random.Random(seed)
    store = CountStore(spark, f"file://{tmp_path}/s").install(10)
    first = [{"seq": 0, "label": "ham", "sign": 1, "archive": False, "bag": {1: 3, 2: 1}}]
    far = rng.choice([1, 10**12])  # numbers need not be dense
    events = first + [
        {"seq": k * far, "label": rng.choice(["ham", "spam"]), "sign": rng.choice([1, 1, -1]), "archive": rng.random() < 0.2, "bag": {rng.randrange(2048): rng.randrange(1, 5) for _ in range(rng.randrange(6))} | {1: 1}} for k in range(1, 40)
    ]
    store.apply(bag(spark, first[0]["bag"]), "ham", 1)
    rows = [(e["seq"], h, n, e["label"], e["sign"], e["archive"]) for e in events[1:] for h, n in e["bag"].items()]
    schema = "seq long, h long, cnt long, label string, sign int, archive boolean"
    import textassay.sources.store as module

    part, module.PART = module.PART, 7
    try:
        store.apply_events(spark.createDataFrame(rows, schema), batch=0)
    finally:
        module.PART = part
    want, texts = literal(events)
    assert held(store) == want
    assert {k: store.meta()[k] for k in texts} == texts
    version = store.version()
    store.apply_events(spark.createDataFrame(rows, schema), batch=0)
    assert store.version() == version


def test_second_writer_is_refused(spark, store):
    old = store.meta()
    store.apply(bag(spark, {1: 1}), "ham", 1)
    with pytest.raises(ConcurrentWriteError):
        store._commit(old, None, version=99)
    assert held(store) == {1: (1, 0, 0, 0)}


def test_snapshot_cache(spark, store):
    cache = SnapshotCache()
    a = cache.load(store)
    assert cache.load(store) is a
    store.apply(bag(spark, {1: 1}), "ham", 1)
    assert cache.load(store) is not a and cache.load(store).total_ham == 1


def test_model_with_store(spark, store):
    texts = spark.createDataFrame([(1, "buy links")], "doc_id long, text string")
    model = EvidenceModel(store.load(), store=store, hash_mode="md5")
    model, at = model.learn(texts, "spam")
    assert at == 0 and model.site.total_spam == 3
    model, at = model.learn(texts, "spam", archive=True)
    assert at == -1
    model = model.rotate()
    assert model.generation() == 1
    model, ok = model.unlearn(texts, "spam", 0)
    assert ok and store.tally().generation == 1
    model, ok = model.unlearn(texts, "spam", -1)
    assert not ok
    with pytest.raises(ValueError):
        model.unlearn(texts, "spam", 2)


@pytest.fixture
def make(spark, tmp_path):
    numbers = count()
    return lambda kind=CountStore: kind(spark, f"file://{tmp_path}/made{next(numbers)}").install(10)


def test_contract_holds(spark, make):
    check(spark, make)


class Unclamped(CountStore):
    def apply(self, hashed, label, sign, texts=1, archive=False, batch=None):
        return super().apply(hashed, label, sign, texts, archive) if sign > 0 else self.tally().generation


class OneGeneration(CountStore):
    def apply(self, hashed, label, sign, texts=1, archive=False, batch=None):
        return super().apply(hashed, label, sign, texts)


class Still(CountStore):
    def version(self):
        return 0


class Forgetful(CountStore):
    def rotate(self):
        meta = self.meta()
        self._commit(meta, self.counts(meta).where("false"), version=meta["version"] + 1, generation=meta["generation"] + 1)


class Nameless(CountStore):
    def identity(self):
        return "store"


@pytest.mark.parametrize(("kind", "rule"), [(Unclamped, "accumulate"), (OneGeneration, "generations apart"), (Still, "version"), (Forgetful, "rotate"), (Nameless, "identity")])
def test_broken_stores_are_found(spark, make, kind, rule):
    assert rule in RULES
    with pytest.raises(ContractError):
        check(spark, lambda: make(kind), [rule])


def test_file_snapshot(spark, store, tmp_path):
    path = f"{tmp_path}/snap/one"
    snapshot = FileSnapshot(path)
    store.apply(bag(spark, {1: 2}), "spam", 1)
    assert snapshot.load(store).total_spam == 2 and oct(os.stat(path).st_mode & 0o777) == "0o600"
    version, identity = store.version(), store.identity()
    assert snapshot.read(spark, version, identity).total_spam == 2
    assert snapshot.read(spark, version + 1, identity) is None and snapshot.read(spark, version, "other") is None
    store.apply(bag(spark, {1: 2}), "spam", 1)
    assert snapshot.load(store).total_spam == 4
    os.chmod(path, 0o666)
    assert snapshot.read(spark, store.version(), identity) is None
    assert FileSnapshot(path, strict=False).read(spark, store.version(), identity).total_spam == 4
    shared = FileSnapshot(f"{path}-shared", strict=False, mode=0o664)
    shared.write(store.load(), store.version(), identity)
    assert oct(os.stat(f"{path}-shared").st_mode & 0o777) == "0o664" and shared.read(spark, store.version(), identity).total_spam == 4
    assert FileSnapshot(f"{path}-shared").read(spark, store.version(), identity) is None
    FileSnapshot(f"{path}-group", mode=0o640).write(store.load(), store.version(), identity)
    assert FileSnapshot(f"{path}-group").read(spark, store.version(), identity).total_spam == 4
    with pytest.raises(ValueError):
        FileSnapshot(path, mode=0o666)
    os.chmod(path, 0o600)
    os.symlink(path, f"{path}-link")
    assert FileSnapshot(f"{path}-link").read(spark, store.version(), identity) is None
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-2])
    assert snapshot.read(spark, store.version(), identity) is None and snapshot.load(store).total_spam == 4
