"""Bounded histories and profiles, as batch operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.clean import top_per_group

HISTORY = 20


def history(turns: DataFrame, user: str, order: str, n: int = HISTORY) -> DataFrame:
    """The last n turns of each user, most recent first (rank 1)."""
    return top_per_group(turns, [user], [F.desc(order)], n)


def prompt_turns(turns: DataFrame, user: str, order: str, n: int = 5, compat: bool = False) -> DataFrame:
    """The last n turns; compat: the oldest n of the history that is kept."""
    kept = history(turns, user, order)
    if not compat:
        return kept.where(F.col("rank") <= n)
    return top_per_group(kept.drop("rank"), [user], [F.col(order)], n)


def merged_profile(changes: DataFrame, user: str, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """The last value of each key of each user."""
    return changes.groupBy(user, key).agg(F.max_by(value, F.struct(*order)).alias(value))


def merged_filters(old: str, new: str):
    """A map with the keys of another laid over it."""
    return F.map_from_entries(F.concat(F.filter(F.map_entries(old), lambda e: ~F.array_contains(F.map_keys(new), e["key"])), F.map_entries(new)))
