"""Vector and filter search, grounding, scoring and evidence."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import scalars as fn
from brindle.operators import similarity
from brindle.operators.clean import top_per_group

OVERFETCH = 30
BRAND_SCORE, CATEGORY_SCORE, LINK_SCORE = 0.6, 0.75, 0.55


def nearest(vectors: DataFrame, key: str, column: str, query: Sequence[float], k: int) -> DataFrame:
    """The k rows nearest to a query by the index score, ties by key: one scan with a top-k in each task."""
    literal = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(key, F.round(fn.index_score(F.col(column), literal), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def linked(queries: DataFrame, entities: DataFrame, query_key: str, entity_key: str, column: str, least: float = LINK_SCORE, k: int = 1, *, apart: bool = False, **how) -> DataFrame:
    """(query, entity, score, rank): the k best entities of each query with at least that score; apart: but for the row with the query's own key.

    A join by cells, exact unless ``exact=False``; see ``similarity.top_matches``.
    """
    return similarity.top_matches(queries, entities, query_key, entity_key, column, k, least=least, apart=apart, **how)


def conditions(filters: dict, products: DataFrame, brands: DataFrame, categories: DataFrame, key: str) -> DataFrame:
    """Products that meet structured filters: price_max, price_min, brand, exclude_brand, category.

    None and empty values, and unknown names, don't filter.  brands and
    categories: (key, name) edges.
    """
    given = {k: v for k, v in filters.items() if v is not None and v != ""}
    if "price_max" in given:
        products = products.where(F.col("price") <= given["price_max"])
    if "price_min" in given:
        products = products.where(F.col("price") >= given["price_min"])
    if "brand" in given:
        products = products.join(brands.where(F.col("name") == given["brand"]).select(key), key, "left_semi")
    if "exclude_brand" in given:
        products = products.join(brands.where(F.col("name") == given["exclude_brand"]).select(key), key, "left_anti")
    if "category" in given:
        products = products.join(categories.where(F.lower("name").contains(given["category"].lower())).select(key), key, "left_semi")
    return products


def has_filters(filters: dict) -> bool:
    """Whether any filter is given; an empty text counts."""
    return any(v is not None for v in filters.values())


def presented(products: DataFrame, brands: DataFrame, categories: DataFrame, key: str, order: Sequence[Column], limit: int) -> DataFrame:
    """Products cut to the limit, then with their brand and sorted distinct categories: only what is shown is joined."""
    top = products.orderBy(*order).limit(limit)
    b = brands.select(key, F.col("name").alias("brand"))
    c = categories.join(top.select(key), key, "left_semi").groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("name")), "|").alias("categories"))
    return top.join(b, key, "left").join(c, key, "left")


def search(
    products: DataFrame, brands: DataFrame, categories: DataFrame, vectors: DataFrame, key: str, column: str, *, query: Sequence[float] | None = None, filters: dict | None = None, limit: int = 5
) -> DataFrame:
    """Hybrid, vector or filter search, as query and filters are given.

    A hybrid search filters the ``30 * limit`` nearest, so it may return fewer
    than the limit.  A filter search scores 1 and goes by key.
    """
    filters = filters or {}
    if query is None and not has_filters(filters):
        raise ValueError("neither a query nor filters are given")
    if query is None:
        found = conditions(filters, products, brands, categories, key).withColumn("score", F.lit(1.0))
    else:
        near = nearest(vectors, key, column, query, limit * (OVERFETCH if has_filters(filters) else 1))
        found = products.join(near, key)
        if has_filters(filters):
            found = conditions(filters, found, brands, categories, key)
    return presented(found, brands, categories, key, [F.desc("score"), F.col(key)], limit)


def grounded(filters: dict, ground: Callable[[str, str, int], Sequence[tuple[str, float]]]) -> dict:
    """Filters with brand and category names replaced by the best that they are grounded to; those that aren't are dropped.

    ground: (filter, text, k) -> up to k (name, score); brands are asked for one, categories for three.
    """
    out = dict(filters)
    for name, least, k in (("brand", BRAND_SCORE, 1), ("exclude_brand", BRAND_SCORE, 1), ("category", CATEGORY_SCORE, 3)):
        if out.get(name):
            hit = max(ground(name, out[name], k), key=lambda h: h[1], default=None)
            out[name] = hit[0] if hit and hit[1] >= least else None
    return out


def grounded_requests(requests: DataFrame, brands: DataFrame, categories: DataFrame, *, request: str = "request_id", name: str = "name", column: str = "vector") -> DataFrame:
    """(request, kind, resolved, score): names in the filters of many requests, each by its nearest entity or null.

    requests: (request, kind, vector), kind one of brand, exclude_brand and
    category; brands and categories: (name, vector).  A brand is taken from a
    score of 0.6 on, a category from 0.75; the best of several is the nearest.
    A row of requests is known by its request and kind.
    """
    keyed = requests.select(F.struct(request, "kind").alias("ask"), column)
    found = None
    for kinds, entities, least in ((("brand", "exclude_brand"), brands, BRAND_SCORE), (("category",), categories, CATEGORY_SCORE)):
        near = linked(keyed.where(F.col("ask.kind").isin(*kinds)), entities.select(name, column), "ask", name, column, least).drop("rank")
        found = near if found is None else found.unionByName(near)
    answers = found.select(F.col(f"query.{request}").alias(request), F.col("query.kind").alias("kind"), F.col("entity").alias("resolved"), "score")
    return requests.select(request, "kind").join(answers, [request, "kind"], "left")


def grounded_preferences(terms: DataFrame, entities: DataFrame, key: str, entity_key: str, column: str, *, least: float = LINK_SCORE, apart: bool = False) -> DataFrame:
    """(key, resolved, score): each term's nearest entity by name, or its own text where none is near enough.

    terms: (key, text, vector); entities: (entity_key, name, vector).
    """
    near = linked(terms, entities, key, entity_key, column, least, 1, apart=apart)
    named = near.join(entities.select(F.col(entity_key).alias("entity"), "name"), "entity").select(F.col("query").alias(key), "name", "score")
    return terms.join(named, key, "left").select(key, F.coalesce("name", "text").alias("resolved"), "score")


def recommended(found: DataFrame, attributes: DataFrame, reviews: DataFrame, key: str, scorer: Callable[[DataFrame], DataFrame], *, n: int = 3) -> DataFrame:
    """The n best of a search's items by a scorer that sees their evidence.

    scorer: gets the items with ``position`` and ``evidence`` (an array of
    (kind, name, value)) and adds ``fit_score`` and ``is_recommended``; a model
    behind an Arrow UDF, or expressions.  found is a result of bounded size.
    """
    told = evidence(reviews, attributes, key, found).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("kind", "name", "value"))).alias("evidence"))
    placed = found.withColumn("position", F.row_number().over(Window.partitionBy().orderBy(F.desc("score"), key)))
    return reranked(scorer(placed.join(told, key, "left")), n)


def in_price_range(products: DataFrame, ranges: DataFrame, edges: DataFrame, key: str, words: Sequence[str]) -> DataFrame:
    """Products whose price range has a label with one of the words.  Labels are amounts, so words like ``cheap`` find nothing."""
    wanted = edges.join(ranges.where(any_contains("label", words)).select("range_id"), "range_id", "left_semi")
    return products.join(wanted.select(key), key, "left_semi")


def any_contains(column: Column | str, terms: Sequence[str]) -> Column:
    """Whether a text has any of the terms, in any case; false without terms."""
    out = F.lit(False)
    for t in terms:
        out = out | F.lower(fn.col(column)).contains(t.lower())
    return out


def preference_score(products: DataFrame, attributes: DataFrame, key: str, likes: Sequence[str], dislikes: Sequence[str], base: Column | None = None) -> DataFrame:
    """Products with ``score``: matching attributes liked less those disliked, above a base value (null base: null score).

    attributes: (key, value); each counts once, however many categories a product matched.
    """
    hit = attributes.groupBy(key).agg((F.count_if(any_contains("value", likes)) - F.count_if(any_contains("value", dislikes))).alias("hits"))
    score = F.coalesce("hits", F.lit(0))
    return products.join(hit, key, "left").withColumn("score", score if base is None else base + score).drop("hits")


def reranked(items: DataFrame, n: int = 3) -> DataFrame:
    """Recommended items by fit score, then original rank; a missing verdict is yes and a missing score a hundred times the vector score."""
    fit = F.coalesce("fit_score", F.col("score") * 100)
    return items.withColumn("fit", fit).where(F.coalesce("is_recommended", F.lit(True))).orderBy(F.desc("fit"), "position").limit(n)


def evidence(reviews: DataFrame, attributes: DataFrame, key: str, products: DataFrame, most: int = 20, each: int = 5) -> DataFrame:
    """(key, kind, name, value): attributes of the products, and of their reviews the ``most`` best overall, ``each`` at most of one product; texts are cut."""
    keys = products.select(key)
    a = attributes.join(keys, key, "left_semi").select(key, F.lit("attribute").alias("kind"), "name", F.substring("value", 1, 200).alias("value"))
    best = reviews.join(keys, key, "left_semi").orderBy(F.desc("helpful"), F.desc("event_time"), "review_id").limit(most)
    r = top_per_group(best, [key], [F.desc("helpful"), F.desc("event_time"), F.col("review_id")], each)
    return a.union(r.select(key, F.lit("review"), F.concat(F.lit("Review: "), F.coalesce("title", F.lit(""))), F.substring("text", 1, 300)))


def similar_items(vectors: DataFrame, key: str, column: str, rated: DataFrame, user: str, item: str, neighbours: int = 3, n: int = 10) -> DataFrame:
    """(user, item, score, rank): for each user the n best of the items nearest to theirs, without what they have.

    Each rated item is looked up once, however many users rated it.
    """
    pairs = rated.select(F.col(user).alias("user"), F.col(item).alias("item")).where("user IS NOT NULL AND item IS NOT NULL").distinct()
    seeds = vectors.join(pairs.select(F.col("item").alias(key)).distinct(), key, "left_semi")
    near = linked(seeds, vectors, key, key, column, least=0.0, k=neighbours, apart=True).select(F.col("query").alias("item"), "entity", "score")
    offered = pairs.join(near, "item").groupBy("user", F.col("entity").alias("item")).agg(F.max("score").alias("score"))
    return top_per_group(offered.join(pairs, ["user", "item"], "left_anti"), ["user"], [F.desc("score"), F.col("item")], n)
