"""Factors of users and items by the ranking of pairs: stochastic gradients over strata that share no factor.

Users and items are dealt to as many blocks each.  A sweep of the blocks goes by
diagonals: on one, every user block meets one item block and no two pairs share
a block, so all pairs' gradients run side by side without seeing each other's
factors; after as many diagonals as blocks every rating had its turn.  Each
rating is set against items of its block that the user did not rate, drawn anew
until one ranks too high (a warp loss) or once (a Bayesian pairwise loss).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.shared import Kept, shipped

TRIES = 10


@dataclass(frozen=True)
class Factors:
    """(block, id, factor, bias) of users and of items; users have no bias."""

    users: DataFrame
    items: DataFrame

    def scores(self, pairs: DataFrame, user: str, item: str) -> DataFrame:
        """pairs with ``score``, null where the user or the item is unknown."""
        u = self.users.select(F.col("id").alias(user), F.col("factor").alias("__u"))
        i = self.items.select(F.col("id").alias(item), F.col("factor").alias("__i"), F.col("bias").alias("__b"))
        dot = F.aggregate(F.zip_with("__u", "__i", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        return pairs.join(u, user, "left").join(i, item, "left").withColumn("score", dot + F.col("__b")).drop("__u", "__i", "__b")


def _start(ids: DataFrame, blocks: int, rank: int, seed: int) -> DataFrame:
    """(block, id, factor, bias): small numbers that a hash of seed, id and place gives."""
    number = lambda k: (F.pmod(F.xxhash64(F.lit(seed), "id", k), F.lit(1 << 20)) / float(1 << 20) - 0.5) / rank
    block = F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(-1)), F.lit(blocks)).cast("int")
    return ids.select(block.alias("block"), "id", F.transform(F.sequence(F.lit(1), F.lit(rank)), number).alias("factor"), F.lit(0.0).alias("bias"))


def descended(u: np.ndarray, v: np.ndarray, bias: np.ndarray, rows: np.ndarray, cols: np.ndarray, *, rate: float, decay: float, loss: str, rng: np.random.Generator) -> None:
    """One pass of gradients over the ratings (rows[i], cols[i]) of a stratum, in a drawn order; u, v and bias change in place."""
    rated: dict[int, set[int]] = {}
    for r, c in zip(rows.tolist(), cols.tolist(), strict=True):
        rated.setdefault(r, set()).add(c)
    n = len(v)
    order, drawn = rng.permutation(len(rows)), rng.integers(0, n, (len(rows), TRIES))
    for step, i in enumerate(order.tolist()):
        r, c = int(rows[i]), int(cols[i])
        own, x = rated[r], u[r].copy()
        good, weight = x @ v[c] + bias[c], 0.0
        for tried, j in enumerate(drawn[step].tolist(), 1):
            if j in own:
                continue
            gap = good - x @ v[j] - bias[j]
            if loss == "bpr":
                weight = 1.0 / (1.0 + np.exp(gap))
                break
            if gap < 1.0:  # the rank that so many draws let expect
                weight = np.log1p(n // tried) / np.log1p(n)
                break
        if weight:
            step_size = rate * weight
            u[r] += step_size * (v[c] - v[j]) - rate * decay * x
            v[c] += step_size * x - rate * decay * v[c]
            v[j] -= step_size * x + rate * decay * v[j]
            bias[c] += step_size - rate * decay * bias[c]
            bias[j] -= step_size + rate * decay * bias[j]


def fit(ratings: DataFrame, user: str, item: str, *, rank: int = 16, rounds: int = 10, blocks: int = 4, rate: float = 0.1, decay: float = 0.05, loss: str = "warp", seed: int = 7) -> Factors:
    """Factors of the users and items of ratings (what was liked; how much isn't looked at).

    blocks: of users and of items; a task holds the factors of one of each and
    their ratings, so take as many as make these fit.  Repeated ratings count
    once, rows with a null go.  The same seed and blocks give the same factors.
    Every diagonal is a job that writes all factors to the shared folder, where
    only the last ones stay.
    """
    if loss not in ("warp", "bpr"):
        raise ValueError(f"no such loss: {loss}")
    spark = shipped(ratings.sparkSession)
    with Kept(spark) as kept:
        pairs = ratings.select(F.col(user).alias("u"), F.col(item).alias("i")).where("u IS NOT NULL AND i IS NOT NULL").distinct()
        users = kept.table(_start(pairs.select(F.col("u").alias("id")).distinct(), blocks, rank, seed), "users")
        items = kept.table(_start(pairs.select(F.col("i").alias("id")).distinct(), blocks, rank, seed + 1), "items")
        of = lambda df, name: df.select(F.col("id").alias(name), F.col("block").alias(f"{name}_block"))
        dealt = kept.table(pairs.join(of(users, "u"), "u").join(of(items, "i"), "i"), "ratings")
        kinds = dict(users.dtypes)["id"], dict(items.dtypes)["id"]
        side = {"user": kinds[0], "item": kinds[1]}
        schema = f"kind string, block int, u {side['user']}, i {side['item']}, factor array<double>, bias double"
        for turn in range(rounds):
            for diagonal in range(blocks):
                told = users.select(F.col("block").alias("stratum"), F.lit("user").alias("kind"), "block", F.col("id").alias("u"), F.lit(None).cast(kinds[1]).alias("i"), "factor", "bias")
                told = told.union(items.select(F.pmod(F.col("block") - diagonal, F.lit(blocks)).alias("stratum"), F.lit("item"), "block", F.lit(None).cast(kinds[0]), F.col("id"), "factor", "bias"))
                here = dealt.where(F.pmod(F.col("u_block") + diagonal, F.lit(blocks)) == F.col("i_block"))
                told = told.union(here.select(F.col("u_block"), F.lit("rating"), F.col("u_block"), "u", "i", F.lit(None).cast("array<double>"), F.lit(None).cast("double")))
                run = _gradients(rank, (turn, diagonal, seed), rate, decay, loss)
                after = kept.table(told.groupBy("stratum").applyInArrow(run, schema), "factors")
                users = after.where("kind = 'user'").select("block", F.col("u").alias("id"), "factor", "bias")
                items = after.where("kind = 'item'").select("block", F.col("i").alias("id"), "factor", "bias")
                kept.forget(2, spared=3)  # the ratings and the first factors stay
        return Factors(kept.table(users, "users", stays=True), kept.table(items, "items", stays=True))


def _gradients(rank: int, turn: tuple[int, ...], rate: float, decay: float, loss: str):
    """The task of a stratum: its users' and items' factors and ratings come as one group, the factors leave changed."""

    def run(group: pa.Table) -> pa.Table:
        kind = group.column("kind").to_numpy()
        part = {k: group.filter(pa.array(kind == k)) for k in ("user", "item", "rating")}
        users, items = part["user"].sort_by("u"), part["item"].sort_by("i")
        if not users.num_rows or not items.num_rows:
            return pa.concat_tables([users, items]).drop_columns("stratum")
        matrix = lambda t: t.column("factor").combine_chunks().flatten().to_numpy().reshape(-1, rank).copy()
        u, v, bias = matrix(users), matrix(items), items.column("bias").to_numpy().copy()
        at = lambda names, asked: np.searchsorted(names.to_numpy(zero_copy_only=False), asked.to_numpy(zero_copy_only=False))
        ratings = part["rating"].sort_by([("u", "ascending"), ("i", "ascending")])
        if ratings.num_rows:
            rng = np.random.default_rng([*turn, group.column("stratum")[0].as_py()])
            rows, cols = (at(names.combine_chunks(), asked.combine_chunks()) for names, asked in ((users.column("u"), ratings.column("u")), (items.column("i"), ratings.column("i"))))
            descended(u, v, bias, rows, cols, rate=rate, decay=decay, loss=loss, rng=rng)
        lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * rank, pa.int32()), pa.array(m.ravel()))
        users = users.set_column(users.schema.get_field_index("factor"), "factor", lists(u))
        items = items.set_column(items.schema.get_field_index("factor"), "factor", lists(v))
        items = items.set_column(items.schema.get_field_index("bias"), "bias", pa.array(bias))
        return pa.concat_tables([users, items]).drop_columns("stratum")

    return run


def auc(scored: DataFrame, user: str, score: str, liked: str) -> DataFrame:
    """(user, auc): the share of a user's pairs of a liked and another item that are in order, ties by half; from ranks, no pair is made.  Users without both kinds have no row."""
    rows = scored.where(F.col(score).isNotNull())
    by_score = Window.partitionBy(user, score)
    rank = F.rank().over(Window.partitionBy(user).orderBy(score)) + (F.count("*").over(by_score) - 1) / 2
    each = rows.withColumn("__rank", rank).groupBy(user).agg(F.sum(F.when(F.col(liked), F.col("__rank"))).alias("s"), F.count_if(F.col(liked)).alias("p"), F.count_if(~F.col(liked)).alias("q"))
    return each.where("p > 0 AND q > 0").select(user, ((F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"))
