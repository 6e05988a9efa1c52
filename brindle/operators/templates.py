"""Query templates with named parameters, bound by Spark."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LIMIT = 10
_NAME = re.compile(r"\$(\w+)")


def bound(text: str, params: Mapping[str, object] | None) -> dict[str, object]:
    """The parameters with a limit, and with an empty list for each ``$name`` of the text that has none."""
    known = {"limit": LIMIT, **(params or {})}
    return known | {name: [] for name in _NAME.findall(text) if name not in known}


def _argument(value: object) -> object:
    if isinstance(value, list | tuple):
        return F.array(*map(_as_column, value))
    return F.create_map(*(x for k, v in value.items() for x in (F.lit(k), _as_column(v)))) if isinstance(value, Mapping) else value


def _as_column(value: object) -> Column:
    made = _argument(value)
    return made if isinstance(made, Column) else F.lit(made)


def _arguments(text: str, params: Mapping[str, object] | None) -> dict[str, object]:
    used = set(_NAME.findall(text))
    return {name: _argument(value) for name, value in bound(text, params).items() if name in used}


def rendered(spark: SparkSession, text: str, params: Mapping[str, object] | None) -> str:
    """The text with each parameter as the literal that Spark binds for it, in Spark's own writing: for logs."""
    args = _arguments(text, params)
    if not args:
        return text
    row = spark.sql("SELECT " + ", ".join(f":{name} AS `{name}`" for name in args), args=args)
    plan = row._jdf.queryExecution().analyzed().expressions()
    told = {name: plan.apply(k).child().sql() for k, name in enumerate(args)}
    return _NAME.sub(lambda m: told[m[1]], text)


def run(spark: SparkSession, text: str, params: Mapping[str, object] | None, **tables: DataFrame) -> DataFrame:
    """A template over tables (``{name}``) with its parameters bound by Spark, never pasted in; lists are arrays, and an empty one fits any element."""
    return spark.sql(_NAME.sub(r":\1", text), args=_arguments(text, params), **tables)
