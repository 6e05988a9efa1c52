"""Aspects, sentiments and preferences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import scalars as fn

LIKE, DISLIKE = 0.8, -0.7


def cleaned_mentions(triplets: DataFrame) -> DataFrame:
    """Aspect triplets with their defaults; such without aspect and opinion are dropped."""
    t = triplets.where((F.coalesce(F.trim("aspect"), F.lit("")) != "") | (F.coalesce(F.trim("opinion"), F.lit("")) != ""))
    aspect = F.lower(F.trim(F.coalesce(F.when(F.trim("aspect") != "", F.col("aspect")), F.col("opinion"))))
    return t.withColumns({
        "aspect": aspect, "surface_form": F.coalesce("surface_form", aspect), "opinion": F.coalesce("opinion", F.lit("")), "sentiment": fn.sentiment(F.coalesce("sentiment", F.lit("neutral"))),
        "confidence": F.coalesce("confidence", F.lit(1.0)), "model_version": F.coalesce("model_version", F.lit("unknown")),
    })


def parsed_triplets(outputs: DataFrame, key: str, column: str, canonical: Callable[[Column], Column] = fn.slugify) -> DataFrame:
    """(key, aspect, surface_form, opinion, sentiment, confidence) from a model's JSON texts.

    A text is a list, or an object with a list under Triplets or triplets; its
    elements are objects, with keys in either case, or lists of aspect, opinion
    and sentiment.  Elements of another kind, and such without aspect and
    opinion, are dropped.
    """
    c = F.col(column)
    inner = F.coalesce(*(F.get_json_object(c, f"$.{k}") for k in ("Triplets", "triplets")), F.when(c.rlike(r"^\s*\["), c))
    rows = outputs.select(key, F.explode(F.from_json(inner, "array<string>")).alias("e"))
    t, field = F.from_json("e", "array<string>"), lambda *names: F.coalesce(*(F.nullif(F.get_json_object("e", f"$.{n}"), F.lit("")) for n in names), F.lit(""))
    listed = F.col("e").startswith("[")
    rows = rows.where(F.col("e").startswith("{") | (listed & (F.size(t) >= 3)))
    part = lambda k, *names: F.when(listed, F.coalesce(F.get(t, F.lit(k)), F.lit(""))).otherwise(field(*names))
    aspect, opinion, mood = part(0, "aspect", "Aspect", "target", "Target"), part(1, "opinion", "Opinion"), part(2, "sentiment", "Sentiment", "Polarity")
    sure = F.when(listed, 1.0).otherwise(F.coalesce(F.get_json_object("e", "$.confidence").try_cast("double"), F.lit(1.0)))
    rows = rows.select(key, aspect.alias("a"), opinion.alias("o"), mood.alias("m"), sure.alias("confidence")).where((F.trim("a") != "") | (F.trim("o") != ""))
    surface = F.when(F.col("a") == "", F.col("o")).otherwise(F.col("a"))
    return rows.select(key, canonical(surface).alias("aspect"), F.trim(surface).alias("surface_form"), F.trim("o").alias("opinion"), fn.sentiment("m").alias("sentiment"), "confidence")


def aspect_forms(mentions: DataFrame) -> DataFrame:
    """(aspect, surface_form, mention_count): a row for each form, so that an aspect of very many forms is rows and no array."""
    return mentions.where(F.col("surface_form").isNotNull()).groupBy("aspect", "surface_form").agg(F.count("*").alias("mention_count"))


def aspect_nodes(mentions: DataFrame) -> DataFrame:
    """(aspect, surface_forms, mention_count): the forms in one sorted array, for aspects of few; see ``aspect_forms``."""
    return mentions.groupBy("aspect").agg(F.array_sort(F.collect_set("surface_form")).alias("surface_forms"), F.count("*").alias("mention_count"))


def sentiment_counts(mentions: DataFrame) -> DataFrame:
    """Positive, negative and neutral mentions of each (user, aspect), in one aggregation."""
    of = lambda s: F.count_if(F.col("sentiment") == s)
    return mentions.groupBy("user_id", "aspect").agg(of("Positive").alias("positive"), of("Negative").alias("negative"), of("Neutral").alias("neutral"))


def preferences(counts: DataFrame, min_opinions: int = 3, prefer: float = 0.7, dislike: float = 0.7) -> DataFrame:
    """PREFERS and DISLIKES edges; neutral mentions don't count, and both may hold under low thresholds."""
    total = F.col("positive") + F.col("negative")
    rows = counts.withColumn("support", total).where((total >= min_opinions) & (total > 0))
    kinds = F.array(
        F.struct(F.lit("PREFERS").alias("kind"), (F.col("positive") / F.col("support")).alias("score"), F.lit(prefer).alias("least")),
        F.struct(F.lit("DISLIKES").alias("kind"), (F.col("negative") / F.col("support")).alias("score"), F.lit(dislike).alias("least")),
    )
    return rows.select("user_id", "aspect", "positive", "negative", "support", F.inline(kinds)).where("score >= least").drop("least")


def quantified(payload: dict) -> dict:
    """A preference payload with weights: likes and dislikes get theirs, constraints and the rest pass through."""
    weighted = {k: [{"value": v, "weight": w} for v in payload.get(k) or []] for k, w in (("likes", LIKE), ("dislikes", DISLIKE))}
    return {"weighted_preferences": weighted | {"constraints": payload.get("constraints") or {}}, "intent": payload.get("intent", "recommendation"), "notes": payload.get("notes", "")}
