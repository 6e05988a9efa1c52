"""Cleaning: field aliases, filters, thresholds, top rows of groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Column names under which ids may come.
ITEM_NAMES = ("asin", "ASIN", "productId", "item_id", "parent_asin")
USER_NAMES = ("user_id", "userId", "reviewer_id", "customerId")


def first_present(df: DataFrame, names: Sequence[str], out: str) -> DataFrame:
    """``out`` from the first of the names that a row has a value for; an error if the table has none of them."""
    there = [n for n in names if n in df.columns]
    if not there:
        raise ValueError(f"none of {', '.join(names)} is a column")
    return df.withColumn(out, F.coalesce(*(F.col(f"`{n}`") for n in there)))


def optional_select(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that the table has."""
    return df.select(*(f"`{c}`" for c in wanted if c in df.columns))


def time_window(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Rows between two instants, both included; bare literals reach the scan."""
    kind = df.schema[column].dataType.simpleString()
    return df.where(F.col(column).between(F.lit(start).cast(kind), F.lit(end).cast(kind)))


def latest(df: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    return df.orderBy(*order).limit(limit)


def at_least(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Rows whose value in each column occurs as often as its limit says, in the table as it comes: one pass, not a core.

    Each key set is a semi join; the counts are small beside the rows and are
    broadcast only if adaptive execution finds them so.
    """
    out = df
    for column, least in limits.items():
        keys = df.groupBy(column).count().where(F.col("count") >= least).select(column)
        out = out.join(keys, column, "left_semi")
    return out


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each group with their rank; order must be total.  All rows if n is not positive."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked if n <= 0 else ranked.where(F.col(name) <= n)


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_per_group(df, key, order, 1).drop("rank")


def semi(df: DataFrame, keys: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows with a partner; on: column of df to column of keys."""
    renamed = keys.select(*(F.col(k).alias(f"__{k}") for k in on.values()))
    condition = None
    for a, b in on.items():
        c = F.col(a) == F.col(f"__{b}")
        condition = c if condition is None else condition & c
    return df.join(renamed, condition, "left_semi")
