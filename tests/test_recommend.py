"""The best items of every user: against all pairs, and what the bounds save."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.operators.recommend import Leaves, _factors, _possible, recommend, search
from factorloom.plans.lineage import cut
from factorloom.plans.model import FactorModel, predict

FACTORS = "id long, features array<double>"


def factors(spark, x, first=0, schema=FACTORS):
    return spark.createDataFrame([(first + i, row.tolist()) for i, row in enumerate(x)], schema)


def by_force(x, y, n, seen=()):
    """Scores added in the order of the components; ties to the smaller item."""
    out = set()
    for u, a in enumerate(x):
        scores = []
        for i, b in enumerate(y):
            s = a[0] * b[0]
            for c in range(1, len(a)):
                s = s + a[c] * b[c]
            if (u, i) not in seen:
                scores.append((-s, i))
        out |= {(u, i, rank, -s) for rank, (s, i) in enumerate(sorted(scores)[:n], 1)}
    return out


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("block,user_block", [(4096, 1024), (16, 7)])
def test_equals_all_pairs(spark, block, user_block):
    random = np.random.default_rng(3)
    x, y = random.standard_normal((40, 4)), random.standard_normal((300, 4))
    seen = {(u, i) for u in range(40) for i in random.choice(300, 30, replace=False).tolist()}
    pairs = spark.createDataFrame([*seen, *list(seen)[:50], (7, 10**6), (10**6, 7)], "user long, item long")
    users, items = factors(spark, x), factors(spark, y)
    assert rows(recommend(users, items, 4, 6, block=block, user_block=user_block)) == sorted(by_force(x, y, 6))
    found = recommend(users, items, 4, 6, pairs, block=block, user_block=user_block)
    assert rows(found) == sorted(by_force(x, y, 6, seen))
    again = predict(found.drop("prediction"), users, items, 4)
    assert rows(again.select("user", "item", "rank", "prediction")) == rows(found)  # to the last bit


def test_ties_and_one_leaf_of_equal_items(spark):
    """All items but two are equal, so a leaf can't be split and is compared in parts; ties go to the smaller item."""
    y = np.ones((200, 2))
    y[120], y[7] = 3, -5
    x = np.array([[1.0, 2.0], [0.0, 0.0], [-1.0, -1.0]])
    assert rows(recommend(factors(spark, x), factors(spark, y), 2, 4, block=8)) == sorted(by_force(x, y, 4))


def test_seen_pairs_of_a_whole_table(spark):
    x, y = np.array([[1.0], [2.0]]), np.arange(1.0, 21.0)[:, None]
    seen = {(0, i) for i in range(20)} | {(1, i) for i in range(3, 20)}
    found = recommend(factors(spark, x), factors(spark, y), 1, 5, spark.createDataFrame(list(seen), "user long, item long"), block=4)
    assert rows(found) == [(1, 0, 3, 2.0), (1, 1, 2, 4.0), (1, 2, 1, 6.0)]


def test_leaves_are_skipped(spark):
    random = np.random.default_rng(5)
    x, y = random.standard_normal((100, 3)), random.standard_normal((4000, 3))
    best, done = search(factors(spark, x), factors(spark, y), 3, 5, block=64)
    assert set(rows(best.select("user", "item", "rank", "score"))) == by_force(x, y, 5)
    assert done["leaves"] >= 50
    assert done["visits"] < 0.25 * 100 * done["leaves"]


def test_bounds_hold():
    random = np.random.default_rng(9)
    y = random.standard_normal((50, 3)) * 10.0 ** random.integers(-8, 9, (50, 1))
    leaves = Leaves(np.arange(1), y.min(axis=0)[None], y.max(axis=0)[None], np.linalg.norm(y, axis=1).max()[None])
    x = random.standard_normal((200, 3)) * 10.0 ** random.integers(-8, 9, (200, 1))
    assert (leaves.bounds(x)[:, 0] >= (x @ y.T).max(axis=1)).all()


def test_a_wave_sorts_only_leaves_that_may_reach_the_least(monkeypatch):
    """The leaves of a wave are those of the whole order, ties in their order too, without sorting every leaf of every user."""
    random = np.random.default_rng(4)
    centre = np.round(random.standard_normal((300, 3)), 1)
    leaves = Leaves(np.arange(300)[::-1].copy(), centre - 0.1, centre + 0.1, np.linalg.norm(np.abs(centre) + 0.1, axis=1))
    users = np.round(random.standard_normal((60, 3)), 1)
    bound = leaves.bounds(users)
    whole = np.argsort(-bound, axis=1, kind="stable")
    monkeypatch.setattr(np, "argsort", None)
    for least in (np.full(60, -np.inf), np.median(bound, axis=1), np.sort(bound, axis=1)[:, -3], np.full(60, np.inf)):
        for first, last in ((0, 1), (1, 3), (3, 7), (255, 511)):
            expected = {(u, int(leaves.ids[j])) for u in range(60) for j in whole[u, first:last] if bound[u, j] >= least[u]}
            i, leaf = leaves.wave(users, least, first, last)
            assert set(zip(i.tolist(), leaf.tolist(), strict=True)) == expected and len(i) == len(expected)


def test_odd_rows(spark):
    users = spark.createDataFrame([(1, [1.0, 1.0], "a"), (2, None, "b"), (3, [1.0, None], "c"), (4, [float("nan"), 1.0], "d"), (None, [1.0, 1.0], "e"), (5, [1.0], "f")], "id long, features array<double>, item string")
    items = spark.createDataFrame([(1, [2.0, 1.0]), (2, [float("inf"), 1.0]), (3, None), (4, [0.0, 0.5]), (None, [9.0, 9.0])], FACTORS)
    assert rows(recommend(users, items, 2, 3)) == [(1, 1, 1, 3.0), (1, 4, 2, 0.5)]
    none = spark.createDataFrame([], FACTORS)
    assert rows(recommend(users, none, 2, 3)) == rows(recommend(none, items, 2, 3)) == rows(recommend(none, none, 2, 3)) == []
    assert rows(recommend(users, items, 2, 3, spark.createDataFrame([], "user long, item long"))) == [(1, 1, 1, 3.0), (1, 4, 2, 0.5)]
    with pytest.raises(ValueError):
        recommend(users, items, 2, 0)


def test_model_recommends_both_ways(spark):
    random = np.random.default_rng(2)
    x, y = (random.standard_normal(s).astype(np.float32) for s in ((6, 3), (9, 3)))
    floats = "id long, features array<float>"
    model = FactorModel(3, factors(spark, x, schema=floats), factors(spark, y, schema=floats), spark.createDataFrame([], "iter int"))
    x, y = x.astype(float), y.astype(float)
    assert rows(model.recommend_items(2)) == sorted(by_force(x, y, 2))
    assert rows(model.recommend_users(2)) == sorted(by_force(y, x, 2))
    some = model.recommend_users(2, spark.createDataFrame([(4,), (4,), (99,)], "id long"), spark.createDataFrame([(0, 4)], "user long, item long"))
    assert rows(some) == sorted(r for r in by_force(y, x, 2, {(4, 0)}) if r[0] == 4)
    assert some.filter(F.col("item") != 4).isEmpty()


def test_of_equal_items_only_those_that_anyone_can_get_are_compared(spark):
    """200 items of each of three vectors, 0 and -0 being equal: a user who has seen 30 of one gets the next, the rest stays out."""
    y = np.tile([[1.0, 0.5], [0.0, 2.0], [-1.0, 1.0]], (200, 1))
    y[1::6, 0] = -0.0
    x = np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, -1.0], [1.0, 1.0]])
    seen = {(1, i) for i in range(1, 91, 3)} | {(0, 3), (3, 1), (3, 7)}
    pairs = spark.createDataFrame([*seen, *seen, (2, 10**6), (None, 4), (3, None)], "user long, item long")
    goods, gone = _possible(cut(_factors(factors(spark, y), "item", 2)), pairs, 4)
    kinds = [sorted(r.item for r in goods.collect() if r.item % 3 == k) for k in range(3)]
    assert kinds == [[*range(k, 3 * most, 3)] for k, most in ((0, 5), (1, 34), (2, 4))]
    assert {(r.user, r.item) for r in gone.collect() if r.user is not None} == seen and gone.count() == len(seen) + 1
    assert rows(recommend(factors(spark, x), factors(spark, y), 2, 4, pairs, block=8)) == sorted(by_force(x, y, 4, seen))
    assert rows(recommend(factors(spark, x), factors(spark, y), 2, 4, block=8)) == sorted(by_force(x, y, 4))
