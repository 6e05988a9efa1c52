"""Pairwise factorisation: held-out ranking against alternating least squares, the same result again, gradients by hand."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import pairwise, rankers


def ratings(seed=11, users=60, items=40):
    """Each user likes items of their own taste far more often; (user, item, held out)."""
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(users, 3)), rng.normal(size=(items, 3))
    likely = 1 / (1 + np.exp(-(4 * a @ b.T - 3)))
    liked = rng.random((users, items)) < likely
    return [(u, i, bool(rng.random() < 0.25)) for u in range(users) for i in range(items) if liked[u, i]]


@pytest.fixture(scope="module")
def split(spark):
    rows = ratings()
    train = spark.createDataFrame([(u, i, 1.0) for u, i, held in rows if not held], "u int, i int, r double")
    seen = {(u, i) for u, i, held in rows if not held}
    test = spark.createDataFrame([(u, i, (u, i, True) in set(rows)) for u in range(60) for i in range(40) if (u, i) not in seen], "u int, i int, liked boolean")
    return train, test


def mean_auc(scored):
    return pairwise.auc(scored, "u", "score", "liked").agg(F.avg("auc")).first()[0]


def test_above_least_squares(spark, split):
    train, test = split
    als = rankers.ranker(train, "u", "i", "r", rank=8, rounds=10)
    least = mean_auc(als.transform(test).withColumnRenamed("prediction", "score"))
    found = pairwise.fit(train, "u", "i", rank=8, blocks=3)
    ranked = mean_auc(found.scores(test, "u", "i"))
    assert ranked > least and ranked > 0.75


def test_same_again_and_strata(spark, split):
    """The same seed gives the same factors, however the rows are dealt; blocks share no user and no item."""
    train, _ = split
    one = pairwise.fit(train, "u", "i", rank=4, rounds=1, blocks=2, loss="bpr")
    two = pairwise.fit(train.repartition(7).union(train), "u", "i", rank=4, rounds=1, blocks=2, loss="bpr")
    told = lambda f: sorted(map(tuple, f.users.collect())) + sorted(map(tuple, f.items.collect()))
    assert told(one) == told(two)
    assert one.users.count() == train.select("u").distinct().count() and one.items.count() == train.select("i").distinct().count()


def test_unknown_and_null(spark):
    train = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1), ("a", None)], "u string, i int")
    found = pairwise.fit(train, "u", "i", rank=2, rounds=1, blocks=2)
    got = {(r.u, r.i): r.score for r in found.scores(spark.createDataFrame([("a", 1), ("zz", 1), ("a", 9)], "u string, i int"), "u", "i").collect()}
    assert got["a", 1] is not None and got["zz", 1] is None and got["a", 9] is None
    with pytest.raises(ValueError, match="no such loss"):
        pairwise.fit(train, "u", "i", loss="x")


def test_gradient_by_hand():
    """One rating, one other item: the step of the logistic loss."""
    u, v, bias = np.array([[1.0, 0.0]]), np.array([[0.5, 0.0], [0.0, 1.0]]), np.zeros(2)
    pairwise.descended(u, v, bias, np.array([0]), np.array([0]), rate=0.1, decay=0.0, loss="bpr", rng=np.random.default_rng(0))
    w = 1 / (1 + np.exp(0.5))
    assert np.allclose(u, [[1 + 0.1 * w * 0.5, -0.1 * w]]) and np.allclose(v, [[0.5 + 0.1 * w, 0], [-0.1 * w, 1]]) and np.allclose(bias, [0.1 * w, -0.1 * w])


def test_auc_by_hand(spark):
    rows = [(1, 0.9, True), (1, 0.5, False), (1, 0.5, True), (1, 0.1, False), (2, 0.3, True), (3, None, True), (3, 0.1, False)]
    got = {r.u: r.auc for r in pairwise.auc(spark.createDataFrame(rows, "u int, s double, liked boolean"), "u", "s", "liked").collect()}
    assert got == {1: (2 + 1.5) / 4}
