import pytest

from textassay.operators.layers import CountTable, Layer
from textassay.params import MAX_COUNT, ModelParams, check_bits


def table(spark, rows, bits=4):
    return CountTable.of(spark.createDataFrame(rows, "h long, cnt long"), bits)


def layer(spark, spam, ham, bits=8, texts=(1, 1)):
    rows = [(s, 0, n) for s, n in spam.items()] + [(s, n, 0) for s, n in ham.items()]
    return Layer.of(spark.createDataFrame(rows, "slot long, count_ham long, count_spam long"), bits, *texts)


def held(df, *names):
    return {r["slot"]: tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()}


def test_table_counts_and_folds(spark):
    t = table(spark, [(3, 5), (3, 2), (9, 1)])
    assert held(t.counts, "cnt") == {3: 7, 9: 1} and t.total == 8 and t.occupied() == 2
    t = t.add(spark.createDataFrame([(3, -7)], "slot long, delta long"))
    assert held(t.counts, "cnt") == {9: 1} and t.total == 1
    assert held(table(spark, [(5, 1), (21, 1), (32005, 1)]).counts, "cnt") == {5: 3}


def test_table_clamps(spark):
    t = table(spark, [(1, 1)], 2).add(spark.createDataFrame([(1, -10), (2, MAX_COUNT + 10)], "slot long, delta long"))
    assert held(t.counts, "cnt") == {2: MAX_COUNT} and t.total == MAX_COUNT


def test_halve_and_plus(spark):
    t = table(spark, [(1, 7), (2, 1), (3, MAX_COUNT)])
    half = t.halve()
    assert held(half.counts, "cnt") == {1: 3, 3: 2147483647} and half.occupied() == 2
    assert held(t.plus(half).counts, "cnt") == {1: 10, 2: 1, 3: MAX_COUNT}
    with pytest.raises(ValueError):
        t.plus(table(spark, [(1, 1)], 5))


def test_sizes_are_checked():
    for bits in (-1, 25):
        with pytest.raises(ValueError):
            check_bits(bits)
    for bad in ({"pretrained_weight": -1.0}, {"background_weight": 0.0}, {"alpha": 0.0}):
        with pytest.raises(ValueError):
            ModelParams(**bad)


def test_marginal_and_learning(spark):
    site = layer(spark, {1: 2, 3: 1}, {1: 5, 2: 4})
    assert held(site.marginal().counts, "cnt") == {1: 7, 2: 4, 3: 1} and site.total() == 12
    bag = spark.createDataFrame([(1, 3), (257, 1), (9, 2)], "h long, cnt long")
    more = site.learn(bag, "spam")
    assert held(more.counts, "count_ham", "count_spam") == {1: (5, 6), 2: (4, 0), 3: (0, 1), 9: (0, 2)} and more.texts_spam == 2
    back = more.unlearn(bag, "spam")
    assert held(back.counts, "count_ham", "count_spam") == held(site.counts, "count_ham", "count_spam") and back.texts_spam == 1
    less = site.unlearn(spark.createDataFrame([(2, 10)], "h long, cnt long"), "ham", 5)
    assert 2 not in held(less.counts, "count_ham") and less.texts_ham == 0


def test_layer_halves_and_adds(spark):
    a = layer(spark, {1: 4, 2: 1}, {1: 3, 3: 2}, texts=(2, 1)).halve()
    assert held(a.counts, "count_ham", "count_spam") == {1: (1, 2), 3: (1, 0)} and (a.texts_ham, a.texts_spam) == (1, 0)
    both = a.plus(a)
    assert held(both.counts, "count_ham", "count_spam") == {1: (2, 4), 3: (2, 0)} and both.total_ham == 4
    assert Layer.empty(spark, 8).counted().total() == 0
