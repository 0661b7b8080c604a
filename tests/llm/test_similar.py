import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from textassay.llm import similar
from textassay.llm.simhash import shingle_hashes

from .helpers import clashing, documents


def jaccard(a, b, words=5):
    x, y = set(shingle_hashes(a, words).tolist()), set(shingle_hashes(b, words).tolist())
    return len(x & y) / len(x | y) if x | y else 0.0


def corpus():
    """Originals, copies with some words changed, and unlike texts that share openings."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    texts = {}
    for k in range(40):
        w = [word() for _ in range(rng.randrange(60, 300))]
        texts[10 * k] = " ".join(w)
        for c in range(1, 4):
            v = list(w)
            for _ in range(max(1, len(v) // 120) * c):
                v[rng.randrange(len(v))] = word()
            texts[10 * k + c] = " ".join(v)
        texts[10 * k + 5] = " ".join(w[:30] + [word() for _ in range(100)])
    return texts


def test_groups_against_brute_force(spark):
    texts = corpus()
    got = {r["doc_id"]: r["root"] for r in similar.groups(documents(spark, list(texts.items()))).collect()}
    ids = sorted(texts)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 : k + 8]]
    near = [(a, b) for a, b in pairs if jaccard(texts[a], texts[b]) >= 0.8]
    assert len(near) > 80 and sum(got[a] == got[b] for a, b in near) >= 0.95 * len(near)
    apart = [(a, b) for a in ids for b in ids if a // 10 != b // 10 or b % 10 == 5 and a != b]
    assert not any(got[a] == got[b] for a, b in apart)


def test_one_of_each_group_stays_unchanged(spark):
    texts = corpus()
    df = clashing(documents(spark, [(i, t, f"s{i % 3}") for i, t in texts.items()] + [(1000, texts[0]), (1000, texts[0]), (1001, None), (1002, ""), (None, texts[10]), (None, "only here"), (None, "only here")]))
    got = similar.one_of_each(df)
    assert got.columns == df.columns
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert len(set(kept)) == len(kept)
    assert (0, texts[0]) in kept and (None, "only here") in kept and (None, texts[10]) not in kept and (1000, texts[0]) not in kept
    assert sum(t in (None, "") for _, t in kept) == 1 and (1001, None) in kept
    assert all((10 * k + 5, texts[10 * k + 5]) in kept for k in range(40))
    assert similar.one_of_each(df.limit(0)).count() == 0


def test_a_large_group_of_near_copies_is_one(spark):
    rng = random.Random(2)
    base = [f"word{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for k in range(300):
        w = list(base)
        w[rng.randrange(200)] = f"own{k}"
        rows.append((k, " ".join(w)))
    got = similar.groups(documents(spark, rows)).select("root").distinct().count()
    assert got == 1


def all_pairs(texts, similarity=0.8):
    """Every pair that reaches the similarity, from the sets themselves."""
    sets = {i: set(shingle_hashes(t or "", 5).tolist()) for i, t in texts.items()}
    holders, pairs = {}, set()
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    shared = Counter(p for some in holders.values() for p in combinations(sorted(some), 2))
    for (a, b), n in shared.items():
        if n >= similarity * (len(sets[a]) + len(sets[b]) - n):
            pairs.add((a, b))
    first = {}
    return pairs | {(first[t], i) for i, t in sorted(texts.items()) if first.setdefault(t, i) != i}


def components(ids, pairs):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {i: find(i) for i in ids}


def same_groups(got, want):
    return {frozenset(i for i in got if got[i] == g) for g in set(got.values())} == {frozenset(i for i in want if want[i] == g) for g in set(want.values())}


@pytest.mark.parametrize("limits", [{}, {"SHORT": 2, "BLOCK": 3, "PART": 4, "OFTEN": 1}, {"SHORT": 2, "COMMON": 1}])
def test_documents_against_all_pairs(spark, monkeypatch, limits):
    """Recall and precision by brute force: every pair at 0.8 or more is in a group, and no group holds more, also if most lists count as long."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    pairs = all_pairs({i: t or "" for i, t in texts.items()})
    for name, x in limits.items():
        monkeypatch.setattr(similar, name, x)
    got = {r["doc_id"]: r["root"] for r in similar.groups(docs).collect()}
    assert len(pairs) > 50 and all(got[a] == got[b] for a, b in pairs)
    assert same_groups(got, components(texts, pairs))


def test_columns_of_any_name_survive(spark):
    df = documents(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, None)])
    names = {c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in ("__key", "__id", "__slot", "key", "slot", "row", "root")}
    got = similar.one_of_each(df.withColumns(names)).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 3]
    assert all(r[c] == f"{c}{r['doc_id']}" for r in got for c in names)


def edited(base, rng, k, share):
    """A copy with its own words in some places."""
    w = list(base)
    for n, at in enumerate(rng.sample(range(len(w)), share)):
        w[at] = f"own{k}x{n}"
    return " ".join(w)


def test_copies_that_are_linked_through_their_original_only(spark):
    """The original stands in the middle of the ids; copies are like it and unlike one another."""
    rng = random.Random(7)
    rows, k = [], 0
    for size in (30, 200):
        base = [f"w{size}v{n}" for n in range(400)]
        texts = [edited(base, rng, f"{size}c{k}", 8) for k in range(size)]
        texts.insert(size // 2, " ".join(base))
        assert all(jaccard(t, " ".join(base)) >= 0.8 for t in texts) and jaccard(texts[0], texts[1]) < 0.8
        rows += [(k + n, t, f"g{size}") for n, t in enumerate(texts)]
        k += len(texts)
    found = similar.groups(documents(spark, rows)).collect()
    group = {i: s for i, _, s in rows}
    assert len(found) == len(rows) and len({(group[r["doc_id"]], r["root"]) for r in found}) == 2


def test_every_pair_at_the_threshold_is_found(spark):
    """Also among many texts with one long passage in common, where lists are long."""
    rng = random.Random(9)
    common = [f"c{n}" for n in range(60)]
    texts = []
    for k in range(120):
        base = common + [f"t{k}v{n}" for n in range(rng.randrange(10, 60))]
        texts += [" ".join(base), edited(base, rng, k, rng.randrange(1, 3))]
    got = {r["doc_id"]: r["root"] for r in similar.groups(documents(spark, list(enumerate(texts)))).collect()}
    near = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if jaccard(texts[a], texts[b]) >= 0.8]
    assert len(near) > 60 and all(got[a] == got[b] for a, b in near)
    up = {a: a for a in got}
    for _ in range(len(texts)):
        low = {a: min([up[a]] + [up[y if x == a else x] for x, y in near if a in (x, y)]) for a in up}
        if low == up:
            break
        up = low
    assert len(set(got.values())) == len(set(up.values()))
