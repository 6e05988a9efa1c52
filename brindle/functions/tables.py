"""Models that make several rows of one, as table functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A model: for each of several texts its (name, value) parts.
Model = Callable[[Sequence[str]], Sequence[Sequence[tuple[str, str]]]]
#: Texts that a model gets at a time.
BATCH = 10


def sentences(texts: Sequence[str]) -> list[list[tuple[str, str]]]:
    """A stand-in that needs no network: a part for each sentence or line, named by what stands before a colon, else ``note``."""
    out = []
    for text in texts:
        rows = []
        for part in re.split(r"[.\n]+", text):
            name, colon, value = part.partition(": ")
            name, value = (name.strip(" "), value.strip(" ")) if colon else ("note", part.strip(" "))
            if name and value:
                rows.append((name, value))
        out.append(rows)
    return out


def of_batch(model: Model, texts: Sequence[str], batch: int = BATCH) -> list[list[tuple[str, str]]]:
    """The model's parts of each text: a batch that fails, or that is answered for some texts only, is asked text by text, a text that fails in halves; one word that fails has none."""

    def alone(text: str) -> list[tuple[str, str]]:
        try:
            return list(model([text])[0])
        except Exception:
            words = text.split()
            half = len(words) // 2
            return alone(" ".join(words[:half])) + alone(" ".join(words[half:])) if half else []

    out: list[list[tuple[str, str]]] = []
    for at in range(0, len(texts), batch):
        some = texts[at : at + batch]
        try:
            found = [list(x) for x in model(some)]
        except Exception:
            found = []
        out += found if len(found) == len(some) else [alone(t) for t in some]
    return out


def parts_of(model: Model = sentences):
    """A table function for lateral joins: ``df.lateralJoin(parts_of(model)(F.col("text").outer()))`` gives each row its (name, value) parts.

    Spark takes no Arrow table function there, so this one goes by rows; for
    tables see ``decomposed``.
    """

    class Parts:
        def eval(self, text: str) -> Iterator[tuple[str, str]]:
            yield from of_batch(model, [text], 1)[0] if text else ()

    return F.udtf(Parts, returnType="name string, value string")


def decomposed(df: DataFrame, key: str, text: str, model: Model = sentences, batch: int = BATCH) -> DataFrame:
    """(key, name, value): the parts of each row's whole text; null and empty texts have none.

    An Arrow table function over batches of rows, so that a model is asked for several
    texts at once; keys need not be different.
    """
    kind = df.schema[key].dataType.simpleString()

    class Decompose:
        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            texts = rows.column(1).to_pylist()
            asked = [k for k, t in enumerate(texts) if t]
            found = of_batch(model, [texts[k] for k in asked], batch)
            of = pa.array([k for k, parts in zip(asked, found, strict=True) for _ in parts], pa.int64())
            rows_out = [p for parts in found for p in parts]
            yield pa.table({key: rows.column(0).take(of), "name": pa.array([n for n, _ in rows_out], pa.string()), "value": pa.array([v for _, v in rows_out], pa.string())})

    return F.arrow_udtf(Decompose, returnType=f"`{key}` {kind}, name string, value string")(df.select(key, text).asTable())
