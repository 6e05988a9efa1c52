"""Tables as the lines that a model reads, and a model's answers as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.clean import top_per_group

#: The lines of an item, each with its label, its form, the columns that may give it, and what stands for none.
ITEM_LINES = (
    ("Title", "%s", ("title",), "Unknown"),
    ("Category", "%s", ("main_category", "category"), "Unknown"),
    ("Brand", "%s", ("store", "brand", "detail_brand", "detail_manufacturer"), "Unknown"),
    ("Price", "$%s", ("price",), "Unknown"),
    ("Rating", "%s/5.0", ("rating",), "Unknown"),
    ("Features", "%s", ("features",), "None specified"),
    ("Match score", "%.2f", ("score",), 0.0),
)
#: The heading and the line of each kind of preference, in this order, and what is told without any.
PREFERENCE_LINES = (("like", "Positive signals:", "- %s (weight=%.2f)"), ("dislike", "Negative signals:", "- %s (weight=%.2f)"), ("constraint", "Constraints:", "- %s: %s"))
NO_PREFERENCES = "No structured preferences captured yet."
#: The headings of a profile, and what stands for an item without a title.
PROFILE_HEADINGS = ("User preferences:", "Previously interacted with:")
UNTITLED = "Unknown product"
TURNS = ITEMS = 5


def _lines(rows: DataFrame, key: str, order: Sequence[str], line: str, out: str, between: str = "\n") -> DataFrame:
    """(key, out): the lines of each key in one text, in order.  For rows of which a key has few."""
    held = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, line))).alias("held"))
    return held.select(key, F.array_join(F.transform("held", lambda r: r[line]), between).alias(out))


def item_block(df: DataFrame, number: Column | str = "rank") -> Column:
    """An item's block of lines, under its number; columns that the table lacks are passed over, as are empty texts."""
    parts = [F.format_string("Item %d:", number)]
    for label, form, columns, none in ITEM_LINES:
        there = [c for c in columns if c in df.columns]
        if isinstance(none, str):
            value = F.coalesce(*(F.when(F.col(c).cast("string") != "", F.col(c).cast("string")) for c in there), F.lit(none))
        else:
            value = F.coalesce(*(F.col(c).cast("string").try_cast("double") for c in there), F.lit(none))
        parts.append(F.format_string(f"- {label}: {form}", value))
    return F.concat_ws("\n", *parts, F.lit(""))


def item_texts(items: DataFrame, key: str, order: Sequence[Column], most: int = 10) -> DataFrame:
    """(key, text): the first ``most`` items of each key as numbered blocks."""
    top = top_per_group(items, [key], order, most)
    return _lines(top.select(key, "rank", item_block(top).alias("block")), key, ["rank"], "block", "text")


def preference_texts(keys: DataFrame, preferences: DataFrame, key: str, most: int = 20) -> DataFrame:
    """(key, text) of every key: its weighted preferences under their headings.

    preferences: (key, kind, name, value, weight); a like or dislike tells value
    and weight (none counts as 0), a constraint name and value.  The first
    ``most`` of a kind are told, by weight, name and value.
    """
    kinds = {kind: k for k, (kind, _, _) in enumerate(PREFERENCE_LINES)}
    place = F.coalesce(*(F.when(F.col("kind") == kind, k) for kind, k in kinds.items()))
    rows = preferences.withColumn("place", place).where("place IS NOT NULL")
    top = top_per_group(rows, [key, "place"], [F.desc("weight"), F.col("name"), F.col("value")], most)
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(0.0))
    line = F.coalesce(*(F.when(F.col("kind") == kind, F.format_string(form, F.col("name"), F.col("value")) if kind == "constraint" else F.format_string(form, F.col("value"), weight)) for kind, _, form in PREFERENCE_LINES))
    of_kind = top.select(key, "place", "rank", line.alias("line")).groupBy(key, "place").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("held"))
    heading = F.element_at(F.array(*(F.lit(h) for _, h, _ in PREFERENCE_LINES)), F.col("place") + 1)
    block = F.concat_ws("\n", heading, F.array_join(F.transform("held", lambda r: r["line"]), "\n"))
    told = _lines(of_kind.select(key, "place", block.alias("block")), key, ["place"], "block", "text", "\n\n")
    return keys.select(key).distinct().join(told, key, "left").select(key, F.coalesce("text", F.lit(NO_PREFERENCES)).alias("text"))


def profile_texts(preferences: DataFrame, history: DataFrame, key: str, order: Sequence[Column], most: int = ITEMS) -> DataFrame:
    """(key, text): what a user prefers (key, name, value: values of a name on one line) and the last ``most`` titles of their history (key, title), as ``order`` says."""
    named = preferences.groupBy(key, "name").agg(F.array_join(F.array_sort(F.collect_set("value")), ", ").alias("values"))
    liked = _lines(named.select(key, "name", F.format_string("- %s: %s", "name", "values").alias("line")), key, ["name"], "line", "liked")
    seen = top_per_group(history, [key], order, most).select(key, "rank", F.format_string("- %s", F.coalesce("title", F.lit(UNTITLED))).alias("line"))
    both = liked.join(_lines(seen, key, ["rank"], "line", "seen"), key, "full_outer")
    parts = (F.when(F.col(c).isNotNull(), F.concat_ws("\n", F.lit(h), F.col(c))) for h, c in zip(PROFILE_HEADINGS, ("liked", "seen"), strict=True))
    return both.select(key, F.concat_ws("\n\n", *parts).alias("text"))


def turn_texts(turns: DataFrame, key: str, order: str, role: str, text: str, most: int = TURNS) -> DataFrame:
    """(key, text): the last ``most`` turns of each conversation, the oldest first, each after who said it."""
    last = top_per_group(turns, [key], [F.desc(order)], most)
    said = last.select(key, F.col(order).alias("at"), F.format_string("%s: %s", F.initcap(role), F.coalesce(F.col(text), F.lit(""))).alias("line"))
    return _lines(said, key, ["at"], "line", "text")


# --- answers ---------------------------------------------------------------------------

CALLS = "array<struct<name: string, args: string>>"
#: An answer's payload; what is no object gives none of it.
PAYLOAD = "likes array<string>, dislikes array<string>, constraints map<string, string>, intent string, notes string"
INTENT = "recommendation"


def answer(c: Column | str, tool: str) -> Column:
    """What a model's answer (JSON) tells: the arguments of its call of the tool, else those of a message's, else its output or content, else the answer itself."""
    raw = F.col(c) if isinstance(c, str) else c
    called = lambda json: F.get(F.filter(F.from_json(json, CALLS), lambda x: x["name"] == tool), F.lit(0))["args"]
    messages = F.from_json(F.get_json_object(raw, "$.messages"), "array<struct<name: string, content: string, tool_calls: string>>")
    told = F.transform(messages, lambda m: F.coalesce(F.when((m["name"] == tool) & (m["content"] != ""), m["content"]), called(m["tool_calls"])))
    first = F.get(F.filter(told, lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(called(F.get_json_object(raw, "$.tool_calls")), first, F.get_json_object(raw, "$.output"), F.get_json_object(raw, "$.content"), raw)


def preference_payloads(answers: DataFrame, key: str, text: str) -> DataFrame:
    """(key, likes, dislikes, constraints, intent, notes) of answers; one that is no JSON object is an empty payload with the answer as its note."""
    raw = F.coalesce(F.col(text), F.lit(""))
    parsed = answers.select(key, raw.alias("raw"), F.when(raw.rlike(r"^\s*\{"), F.from_json(raw, PAYLOAD + ", bad string", {"columnNameOfCorruptRecord": "bad"})).alias("p"))
    good = F.col("p").isNotNull() & F.col("p.bad").isNull()
    of = lambda name, none: F.coalesce(F.when(good, F.col(f"p.{name}")), none)
    none = F.array().cast("array<string>")
    return parsed.select(
        key, of("likes", none).alias("likes"), of("dislikes", none).alias("dislikes"), of("constraints", F.create_map().cast("map<string, string>")).alias("constraints"),
        of("intent", F.lit(INTENT)).alias("intent"), F.when(good, F.coalesce("p.notes", F.lit(""))).otherwise(F.trim("raw")).alias("notes"),
    )
