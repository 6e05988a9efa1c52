"""Pluggable models as Arrow-batched UDFs, with deterministic stand-ins that need no network."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashed_embedding(texts: pd.Series, size: int = 64) -> pd.Series:
    """Unit vectors of hashed words; an empty text gives an empty vector."""
    import hashlib
    import math

    def one(text: str | None) -> list[float]:
        words = (text or "").lower().split()
        out = [0.0] * size
        for w in words:
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            out[h % size] += 1.0 if h >> 63 else -1.0
        norm = math.sqrt(sum(x * x for x in out))
        return [x / norm for x in out] if norm else []

    return texts.map(one)


def embedder(model: Callable[[pd.Series], pd.Series] = hashed_embedding):
    """A Column function text -> array<float> from a model that takes batches of texts."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield model(texts)

    return embed


def filled_embeddings(nodes: DataFrame, text: str, column: str, model: Callable[[pd.Series], pd.Series] = hashed_embedding) -> DataFrame:
    """nodes with the missing embeddings computed; only rows without one go through the model."""
    there = nodes.where(F.col(column).isNotNull())
    return there.unionByName(nodes.where(F.col(column).isNull()).withColumn(column, embedder(model)(F.col(text))))


def triplets(reviews: DataFrame, key: str, text: str, model: Callable[[list[str]], list[list[tuple[str, str, str]]]], batch: int = 8) -> DataFrame:
    """(key, aspect, opinion, sentiment) of a model over batches; a batch that fails is tried text by text, a text that fails in halves."""
    kind = reviews.schema[key].dataType.simpleString()

    def of(text_: str) -> list[tuple[str, str, str]]:
        try:
            return model([text_])[0]
        except Exception:
            words = text_.split()
            if len(words) < 2:
                return []
            middle = len(words) // 2
            return of(" ".join(words[:middle])) + of(" ".join(words[middle:]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for lo in range(0, len(df), batch):
                part = df.iloc[lo : lo + batch]
                texts = part[text].tolist()
                try:
                    found = model(texts)
                    found = (found + [[]] * len(texts))[: len(texts)]
                except Exception:
                    found = [of(t) for t in texts]
                rows += [(k, *t) for k, each in zip(part[key], found, strict=True) for t in each]
            yield pd.DataFrame(rows, columns=[key, "aspect", "opinion", "sentiment"])

    return reviews.where(F.length(text) > 0).select(key, text).mapInPandas(run, f"{key} {kind}, aspect string, opinion string, sentiment string")
