"""Records: defaults, filling, de-duplication, batches, collects and mappings."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import scalars as fn
from brindle.functions import texts

# --- cleaning ------------------------------------------------------------------


def absent_filled(df: DataFrame, raw: str, defaults: dict[str, object]) -> DataFrame:
    """Defaults for the fields that a record's JSON text lacks; a null that is written out stays null."""
    keys = F.json_object_keys(F.col(raw))
    return df.withColumns({c: F.when(~F.array_contains(keys, c), F.lit(v)).otherwise(F.col(c)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a value in each of the columns."""
    return df.dropna(subset=list(columns))


def filled(df: DataFrame, columns: Sequence[str], value: str = "") -> DataFrame:
    return df.fillna(value, subset=list(columns))


def distinct_by(df: DataFrame, columns: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """One row for each value of the columns over the whole table: the first by order, any without one."""
    if not order:
        return df.dropDuplicates(list(columns))
    ranked = df.withColumn("__k", F.row_number().over(Window.partitionBy(*columns).orderBy(*order)))
    return ranked.where("__k = 1").drop("__k")


def narrowed(df: DataFrame, most: int, window: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df as it is up to so many rows, else what the window leaves of it.  Counting is a pass of its own."""
    return window(df) if df.limit(most + 1).count() > most else df


def encoded(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nested columns as JSON texts."""
    return df.withColumns({c: F.to_json(c) for c in columns})


def key_shapes(df: DataFrame, n: int = 5) -> DataFrame:
    """(key, kind, sizes) of the first n records: each column's type, and how long its lists, maps or texts are there."""
    first = df.limit(n)
    sized = lambda c: F.size(c) if df.schema[c].dataType.typeName() in ("array", "map") else F.length(F.col(c).cast("string")) if df.schema[c].dataType.typeName() != "struct" else F.lit(None).cast("int")
    rows = F.array(*(F.struct(F.lit(c).alias("key"), F.lit(df.schema[c].dataType.simpleString()).alias("kind"), sized(c).alias("size")) for c in df.columns))
    return first.select(F.inline(rows)).groupBy("key", "kind").agg(F.array_sort(F.collect_list("size")).alias("sizes"))


def in_batches(df: DataFrame, n: int, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """work over batches of n rows at most, within each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), n):
                yield work(whole.iloc[at : at + n])

    return df.mapInPandas(run, schema)


def unmarked_long(attributes: DataFrame, marked: DataFrame, key: str, least: int = 50) -> DataFrame:
    """Attributes to be taken apart: of a generic name, longer than ``least``, with a source other than derived, and not yet marked.

    marked: a table of one column, the keys done.
    """
    rows = attributes.where(F.lower("name").isin(*fn.GENERIC_KEYS) & (F.length("value") > least) & (F.col("source") != "derived"))
    return rows.join(marked.select(F.col(marked.columns[0]).alias(key)), key, "left_anti")


def derived_attributes(parts: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(attributes, edges) from the parts (key, name, value) that a model took attributes apart into, each once.

    An attribute's id is the md5 of its name and normalised value.
    """
    name, value = F.lower(F.trim("name")), fn.normalized_attribute("value")
    rows = parts.select(key, name.alias("attribute_name"), F.col("value").alias("attribute_value"), value.alias("normalized_value"))
    rows = rows.withColumns({"attribute_id": F.md5(F.concat_ws("|", "attribute_name", "normalized_value").cast("binary")), "source": F.lit("derived")})
    nodes = rows.groupBy("attribute_id", "attribute_name", "normalized_value", "source").agg(F.min("attribute_value").alias("attribute_value"))
    return nodes, rows.select(key, "attribute_id").distinct()


# --- collects --------------------------------------------------------------------


def first_of_group(df: DataFrame, by: Sequence[str], value: Column, order: Sequence[Column], n: int, out: str) -> DataFrame:
    """(by, out): the first n values of each group in order.  Only n rows a group are gathered, however many it has."""
    ranked = df.select(*by, value.alias(out), F.row_number().over(Window.partitionBy(*by).orderBy(*order)).alias("__k")).where(F.col("__k") <= n)
    gathered = ranked.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__k", out))).alias("rows"))
    return gathered.select(*by, F.transform("rows", lambda r: r[out]).alias(out))


def pair_rows(attributes: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """(key, name, value, n): a row for each distinct pair of a key and how often it comes; a key of very many pairs is rows and no array."""
    return attributes.groupBy(key, F.col(name).alias("name"), F.col(value).alias("value")).agg(F.count("*").alias("n"))


def distinct_pairs(attributes: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """(key, pairs): the distinct (name, value) of each key in one sorted array, for keys of few; see ``pair_rows``."""
    pair = F.struct(F.col(name).alias("name"), F.col(value).alias("value"))
    return attributes.groupBy(key).agg(F.array_sort(F.collect_set(pair)).alias("pairs"))


def feature_texts(attributes: DataFrame, key: str, name: str, value: str, n: int = 5) -> DataFrame:
    """(key, features): the first n ``name: value`` of each key, sorted."""
    text = F.concat(F.col(name), F.lit(": "), F.col(value))
    rows = attributes.select(key, text.alias("t")).where("t IS NOT NULL")
    return first_of_group(rows, [key], F.col("t"), [F.col("t")], n, "features")


def review_texts(reviews: DataFrame, item: str, order: Sequence[Column], n: int = 20) -> DataFrame:
    """(item, text): the texts of each item's first n reviews in order, in one; each as often as its weight is whole."""
    times = F.floor(fn.review_weight("helpful", "verified")).cast("int")
    shown = reviews.withColumn("__text", texts.review_text("title", "text")).where("__text IS NOT NULL")
    repeated = F.array_join(F.array_repeat("__text", times), " ")
    return first_of_group(shown, [item], repeated, order, n, "parts").select(item, F.array_join("parts", " ").alias("text"))


def item_details(items: DataFrame, reviews: DataFrame, key: str, order: Sequence[Column], n: int = 1000, details: str | None = None) -> DataFrame:
    """Items with their reviews as an array of (user_id, rating, text, helpful_votes), the first n of each; details: a map whose keys become ``detail_`` columns of the keys that are told."""
    row = F.struct("user_id", "rating", "text", F.col("helpful").alias("helpful_votes"))
    out = items.join(first_of_group(reviews, [key], row, order, n, "reviews"), key, "left")
    if details is None:
        return out
    return out.withColumns({f"detail_{k.lower()}": F.col(details)[k] for k in texts.TOLD_DETAILS}).drop(details)


def mentions_of_users(mentions: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """Mentions with the user of their review; mentions of unknown reviews go."""
    return mentions.join(reviews.select(key, "user_id").distinct(), key)


def min_max(df: DataFrame, column: str, out: str) -> DataFrame:
    """column scaled to 0 to 1 over the whole table, 0 where all values are equal: one aggregation of one row, joined back."""
    ends = df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    x = (F.col(column) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))
    return df.join(F.broadcast(ends)).withColumn(out, F.when(F.col("__hi") > F.col("__lo"), x).otherwise(F.lit(0.0))).drop("__lo", "__hi")


def combined(first: DataFrame, then: DataFrame, position: str) -> DataFrame | None:
    """The items of both, those of the first before the others, numbered anew by ``rank``; None if there are none.  For a result's few items."""
    both = first.withColumn("__from", F.lit(0)).unionByName(then.withColumn("__from", F.lit(1)), allowMissingColumns=True)
    if both.isEmpty():
        return None
    return both.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy("__from", position))).drop("__from")


# --- mappings ----------------------------------------------------------------------


def _given(c: Column, kind: str) -> Column:
    """c as text, or null for what counts as nothing: an empty text, and zero where it is a number."""
    return F.when(c != (0 if kind not in ("string", "void") else ""), c).cast("string")


def result_items(records: DataFrame, node: str | None = None) -> DataFrame:
    """Records of a search in one shape: title, main_category, store, price, rating, features, score, as texts but for the score.

    A field of the record comes before the node's (a struct column); what counts
    as nothing in either is passed over, but a price or rating of zero that the
    node gives last stays.  What is nowhere is ``Unknown``, the category the
    first of the record's.
    """
    inner = {f.name: f.dataType.simpleString() for f in records.schema[node].dataType.fields} if node else {}
    own = dict(records.dtypes)

    def pick(names: Sequence[str], last: Column, of_node: Sequence[str] | None = None, zero: bool = False) -> Column:
        found = [_given(F.col(n), own[n]) for n in names if n in own]
        for n in of_node or names:
            if n in inner:
                found.append(F.col(node)[n].cast("string") if zero else _given(F.col(node)[n], inner[n]))
        return F.coalesce(*found, last)

    unknown = F.lit("Unknown")
    lists = [n for n in ("categories", "category") if own.get(n, "").startswith("array")]
    first = F.coalesce(*(F.get(F.col(n), F.lit(0)) for n in lists), unknown)
    features = [F.when(F.size(n) > 0, F.array_join(n, ", ")) for n in ("attributes", "features") if own.get(n, "").startswith("array")]
    score = F.coalesce(F.col("score").cast("string").try_cast("double"), F.lit(0.0)) if "score" in own else F.lit(0.0)
    columns = {
        "title": pick(["title"], unknown), "main_category": pick(["main_category"], first), "store": pick(["brand"], unknown), "price": pick(["price"], unknown, zero=True),
        "rating": pick(["avg_rating", "rating"], unknown, ["avg_rating"], zero=True), "features": F.coalesce(*features, F.lit("None specified")), "score": score,
    }
    return records.select(*(c.alias(n) for n, c in columns.items()))


def labelled(df: DataFrame, label: str, key: Sequence[str]) -> DataFrame:
    """Rows of a table as records of a graph: with its label, a surrogate key and the time of the query."""
    return df.withColumns({"label": F.lit(label), "element_id": F.sha1(F.concat_ws("|", F.lit(label), *(F.col(k).cast("string") for k in key))), "at": F.current_timestamp()})
