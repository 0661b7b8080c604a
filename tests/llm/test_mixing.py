from fractions import Fraction

from textassay.llm import mixing
from textassay.llm.queries import QUERIES

from .helpers import clashing, documents


def brute_targets(sizes):
    """Share by weight, stop at three times a source's size, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction((5, 2, 1)[k % 3]) for k, s in enumerate(order)}
    target, free, pool = dict.fromkeys(order, Fraction(0)), set(order), Fraction(sum(sizes.values()))
    while pool > 0 and free:
        total = sum(weight[s] for s in free)
        share = {s: pool * weight[s] / total for s in free}
        pool = Fraction(0)
        for s, x in share.items():
            target[s] += x
            over = target[s] - 3 * sizes[s]
            if over >= 0:
                target[s] -= over
                pool += over
                free.discard(s)
    return {s: float(t) for s, t in target.items()}


def check(rows):
    sizes, taken, target = {}, {}, {}
    for r in rows:
        s = r["source"]
        sizes[s] = sizes.get(s, 0) + r["__size"]
        taken[s] = taken.get(s, 0) + r["__taken"]
        target[s] = r["__target"]
        assert 0 <= r["__taken"] <= 3 * r["__size"]
    want = brute_targets(sizes)
    assert all(abs(target[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)
    assert all(r["__source_size"] == sizes[r["source"]] for r in rows)
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)


def test_targets_and_budgets(spark):
    rows = [(k, "w " * (k % 17), f"s{k % 7}") for k in range(200)] + [(500 + k, "a b c", None) for k in range(9)] + [(600, "x" * 10, "zz"), (601, None, "empty"), (602, " \t", "empty")]
    df = clashing(documents(spark, rows))
    first, again = mixing.mix(df).collect(), mixing.mix(df.repartition(5)).collect()
    check(first)
    key = lambda r: (r["doc_id"], r["__taken"])
    assert sorted(map(key, first)) == sorted(map(key, again)) and len(first) == len(rows)


def test_ranges_do_not_show(spark):
    df = documents(spark, [(k, "w " * (1 + k % 5), "one" if k % 3 else "two") for k in range(300)])
    whole = sorted((r["doc_id"], r["__taken"]) for r in mixing.mix(df).collect())
    for size in (1, 10):
        old, mixing.RANGE_ROWS = mixing.RANGE_ROWS, size
        try:
            assert sorted((r["doc_id"], r["__taken"]) for r in mixing.mix(df).collect()) == whole
        finally:
            mixing.RANGE_ROWS = old


def test_copies_are_what_was_taken(spark):
    rows = [(k, f"word{k} " * (3 + k % 9), f"s{k % 5}") for k in range(80)] + [(None, None, "s1"), (81, "", "s2")]
    df = clashing(documents(spark, rows))
    out = mixing.copies(df)
    assert out.columns == df.columns
    words, whole = {}, {r[0]: r[1] for r in rows}
    for r in out.collect():
        n = len(r["text"].split())
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + n
        assert r["text"] == whole[r["doc_id"]] or whole[r["doc_id"]].split()[:n] == r["text"].split() and r["n_chars"] == len(r["text"])
    assert words == {r["doc_id"]: r["__taken"] for r in mixing.mix(df).collect() if r["__taken"]}


def test_awkward_rows(spark):
    df = documents(spark, [(1, "a b c", "x")] * 5 + [(None, "a b c", "x"), (None, "d", "x"), (2, None, None)])
    check(mixing.mix(df).collect())
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.copies(df.limit(0)).count() == 0
    assert mixing.copies(documents(spark, [(1, None, "x"), (2, "", None)])).count() == 0


def test_no_python_on_the_executors(spark, small):
    plan = QUERIES["op9_mixing"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
