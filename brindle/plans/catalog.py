"""Every query of the library over the driver's tables, with its reference SQL.

Reviews are order lines: the customer rates the part.  Products are parts,
their brand and type the brand and category path; events are aspect mentions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import scalars as fn
from brindle.operators import clean, graph, preferences, search, state, stats, vector_index
from brindle.shared import base_dir, remove

ORDER = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
QUERY = [((k * 37) % 19 - 9) / 10 for k in range(64)]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql.replace("{REV}", REV).replace("{MENTION}", MENTION).replace("{PATH}", PATH).replace("{Q}", str(QUERY))
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


REV = "rev AS (SELECT o_custkey AS user_id, l_partkey AS asin, l_suppkey AS variant, 1 + (CAST(l_quantity AS BIGINT) % 5) AS rating, l_linenumber AS helpful, l_returnflag = 'N' AS verified, l_shipdate AS event_time, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
MENTION = "men AS (SELECT event_id, user_id, event_type AS aspect, CASE WHEN value >= 100 THEN 'Positive' WHEN value < 30 THEN 'Negative' ELSE 'Neutral' END AS sentiment, props FROM events)"
PATH = "pth AS (SELECT p_partkey AS asin, [p_type, p_brand] AS path FROM part), pre AS (SELECT asin, path[i] AS name, CAST(i - 1 AS INTEGER) AS level, sha1(array_to_string(path[1:i], ' > ')) AS category_id, CASE WHEN i > 1 THEN sha1(array_to_string(path[1:i - 1], ' > ')) END AS parent_id, i = 2 AS is_primary FROM (SELECT asin, path, unnest([1, 2]) AS i FROM pth))"


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("asin"), F.col("l_suppkey").alias("variant"), (1 + (F.col("l_quantity").cast("bigint") % 5)).alias("rating"),
        F.col("l_linenumber").alias("helpful"), (F.col("l_returnflag") == "N").alias("verified"), F.col("l_shipdate").alias("event_time"), *ORDER,
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asin"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"))


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asin"), F.col("p_brand").alias("name"))


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("asin"), F.explode(F.array("p_type", "p_brand")).alias("name"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("asin"), "embedding")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    mood = F.when(value >= 100, "Positive").when(value < 30, "Negative").otherwise("Neutral")
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("aspect"), mood.alias("sentiment"), "props")


def prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asin"), F.array("p_type", "p_brand").alias("path"))
    return graph.category_prefixes(part, "asin", "path")


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("asin"), F.explode(F.array(F.struct(F.lit("size").alias("name"), F.col("p_size").cast("string").alias("value")), F.struct(F.lit("type").alias("name"), F.col("p_type").alias("value")))).alias("a")).select("asin", "a.*")


# --- search ----------------------------------------------------------------------

SHOWN = "SELECT t.asin, t.title, t.price, t.score, p.p_brand AS brand, array_to_string(list_sort(list_distinct([p.p_type, p.p_brand])), '|') AS categories FROM t JOIN part p ON p.p_partkey = t.asin"
SCORE = "round((1 + list_dot_product(CAST(embedding AS DOUBLE[]), CAST({Q} AS DOUBLE[])) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_dot_product(CAST({Q} AS DOUBLE[]), CAST({Q} AS DOUBLE[])))) / 2, 6)"


def _search(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return search.search(products(spark, sf_dir), brands(spark, sf_dir), categories(spark, sf_dir), vectors(spark, sf_dir), "asin", "embedding", **how)


@query(f"WITH near AS (SELECT vec_id, {SCORE} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 150), t AS (SELECT vec_id AS asin, p_name AS title, p_retailprice AS price, score FROM near JOIN part ON p_partkey = vec_id WHERE p_retailprice <= 1500 AND p_brand <> 'Brand#11' ORDER BY score DESC, asin LIMIT 5) " + SHOWN)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, query=QUERY, filters={"price_max": 1500, "exclude_brand": "Brand#11"}, limit=5)


@query(f"WITH near AS (SELECT vec_id, {SCORE} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10), t AS (SELECT vec_id AS asin, p_name AS title, p_retailprice AS price, score FROM near JOIN part ON p_partkey = vec_id) " + SHOWN)
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, query=QUERY, limit=10)


@query("WITH t AS (SELECT p_partkey AS asin, p_name AS title, p_retailprice AS price, 1.0::DOUBLE AS score FROM part WHERE p_retailprice BETWEEN 900 AND 950 AND p_brand <> 'Brand#11' ORDER BY asin LIMIT 20) " + SHOWN)
def filter_only_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, filters={"price_min": 900, "price_max": 950, "exclude_brand": "Brand#11", "category": ""}, limit=20)


@query("WITH s AS (SELECT a.vec_id AS query, b.vec_id AS entity, round((1 + list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))) / 2, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) SELECT query, entity, score FROM s WHERE score >= 0.55 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, entity) = 1")
def entity_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id 20 divides, against all other rows."""
    v = table(spark, sf_dir, "embeddings")
    return search.linked(v.where("vec_id % 20 = 0"), v, "vec_id", "vec_id", "embedding", apart=True).drop("rank")


@query("WITH {REV}, top AS (SELECT asin, rating, helpful, event_time, l_orderkey, l_suppkey FROM rev ORDER BY helpful DESC, event_time DESC, l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-' || CAST(CAST(l_extendedprice * 100 AS BIGINT) AS VARCHAR) LIMIT 20), r AS (SELECT asin, 'review' AS kind, 'Review: ' || l_orderkey AS name, 'rated ' || rating AS value FROM (SELECT rev.*, l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-' || CAST(CAST(l_extendedprice * 100 AS BIGINT) AS VARCHAR) AS review_id FROM rev ORDER BY helpful DESC, event_time DESC, review_id LIMIT 20) QUALIFY row_number() OVER (PARTITION BY asin ORDER BY helpful DESC, event_time DESC, review_id) <= 5) SELECT p_partkey AS asin, 'attribute' AS kind, 'size' AS name, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT p_partkey, 'attribute', 'type', p_type FROM part UNION ALL SELECT * FROM r")
def product_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    r = reviews(spark, sf_dir).select("asin", "helpful", "event_time", key.alias("review_id"), F.col("l_orderkey").cast("string").alias("title"), F.concat(F.lit("rated "), F.col("rating").cast("string")).alias("text"))
    return search.evidence(r, attributes(spark, sf_dir), "asin", products(spark, sf_dir))


@query("SELECT vec_id AS asin, position, fit FROM (SELECT vec_id, CAST(vec_id AS INTEGER) AS position, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE CAST(label * 10 AS DOUBLE) END AS f, 0.5 + label / 20.0 AS score, CASE WHEN vec_id % 4 = 0 THEN NULL ELSE label > 3 END AS ok FROM embeddings) CROSS JOIN LATERAL (SELECT coalesce(f, score * 100) AS fit) WHERE coalesce(ok, true) ORDER BY fit DESC, position LIMIT 3")
def critic_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, label = table(spark, sf_dir, "embeddings"), F.col("label")
    items = v.select(F.col("vec_id").alias("asin"), F.col("vec_id").cast("int").alias("position"), F.when(F.col("vec_id") % 3 != 0, (label * 10).cast("double")).alias("fit_score"), (0.5 + label / 20.0).alias("score"), F.when(F.col("vec_id") % 4 != 0, label > 3).alias("is_recommended"))
    return search.reranked(items).select("asin", "position", "fit")


@query("SELECT p_partkey AS asin, p_retailprice AS price, CAST((CASE WHEN contains(lower(p_type), 'a') THEN 1 ELSE 0 END) - (CASE WHEN contains(lower(p_type), 'e') THEN 1 ELSE 0 END) + (CASE WHEN contains(CAST(p_size AS VARCHAR), '1') THEN 1 ELSE 0 END) AS BIGINT) AS score FROM part WHERE p_retailprice <= 950 ORDER BY score DESC, asin LIMIT 25")
def like_dislike_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.preference_score(products(spark, sf_dir).where("price <= 950"), attributes(spark, sf_dir), "asin", ["a", "1"], ["E"])
    # A value with both a liked and a disliked part counts for both.
    return found.select("asin", "price", "score").orderBy(F.desc("score"), "asin").limit(25)


AVG = "av AS (SELECT l_partkey AS asin, avg(1 + (CAST(l_quantity AS BIGINT) % 5)) AS a FROM lineitem GROUP BY 1)"


@query(f"WITH {AVG} SELECT p_partkey AS asin, round(a + (CASE WHEN contains(lower(p_type), 'steel') THEN 1 ELSE 0 END), 6) AS score FROM part LEFT JOIN av ON asin = p_partkey")
def avg_rating_soft_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = reviews(spark, sf_dir).groupBy("asin").agg(F.avg("rating").alias("avg_rating"))
    base = products(spark, sf_dir).join(rated, "asin", "left")
    found = search.preference_score(base, attributes(spark, sf_dir).where("name = 'type'"), "asin", ["STEEL"], [], F.col("avg_rating"))
    return found.select("asin", F.round("score", 6).alias("score"))


RECENT = "av AS (SELECT asin, avg(rating) AS a FROM (SELECT asin, rating FROM rev QUALIFY row_number() OVER (PARTITION BY asin ORDER BY event_time DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) <= 3) GROUP BY 1)"


def recently_rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asin, avg_rating): the mean of each product's three last ratings."""
    last = clean.top_per_group(reviews(spark, sf_dir), ["asin"], [F.desc("event_time"), *map(F.col, ORDER)], 3)
    return stats.mean_and_count(last, ["asin"], "rating").select("asin", "avg_rating")


@query(f"WITH {{REV}}, {RECENT} SELECT p_partkey AS asin, p_retailprice AS price, round(a, 6) AS avg_rating, p_brand AS brand, p_type || '|' || p_brand AS categories, round(a, 6) AS score FROM part JOIN av ON asin = p_partkey WHERE round(a, 6) >= 4.0 AND p_retailprice <= 1500 AND (contains(lower(p_type), 'pro') OR contains(lower(p_brand), 'pro')) ORDER BY score DESC, p_partkey LIMIT 10")
def top_rated_under_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Well rated products of a category under a price."""
    rated = recently_rated(spark, sf_dir).where("avg_rating >= 4.0")
    found = search.conditions({"price_max": 1500, "category": "Pro"}, products(spark, sf_dir).join(rated, "asin"), brands(spark, sf_dir), categories(spark, sf_dir), "asin")
    paths = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asin"), F.col("p_brand").alias("brand"), F.concat_ws("|", "p_type", "p_brand").alias("categories"))
    top = found.orderBy(F.desc("avg_rating"), "asin").limit(10)
    return top.join(paths, "asin").select("asin", "price", "avg_rating", "brand", "categories", F.col("avg_rating").alias("score"))


@query(f"WITH {{REV}}, {RECENT}, {{PATH}}, up AS (SELECT DISTINCT category_id AS c, parent_id AS p FROM pre WHERE parent_id IS NOT NULL), name AS (SELECT DISTINCT category_id, name FROM pre), reach AS (SELECT category_id AS c, category_id AS target FROM name UNION SELECT c, p FROM up), hit AS (SELECT DISTINCT asin FROM pre JOIN reach ON reach.c = category_id JOIN name ON name.category_id = target WHERE is_primary AND (contains(lower(name.name), 'pro') OR contains(lower(name.name), 'eco'))), att AS (SELECT p_partkey AS asin, 'size' AS name, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part), likes AS (SELECT asin, count(*) FILTER (contains(lower(value), '1') OR contains(lower(value), 'eco')) AS n, array_to_string(list(name || '=' || value ORDER BY name), '|') AS attributes FROM att GROUP BY 1) SELECT p_partkey AS asin, p_retailprice AS price, round(a, 6) AS avg_rating, p_brand AS brand, p_brand AS categories, attributes, round(round(a, 6) + n, 6) AS score FROM part JOIN hit ON hit.asin = p_partkey JOIN likes ON likes.asin = p_partkey LEFT JOIN av ON av.asin = p_partkey WHERE p_retailprice <= 1500 AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') ORDER BY price, p_partkey LIMIT 30")
def hierarchy_brand_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of some brands under a price, whose category or the one above it has one of the names, the cheapest first; the score is the rating and what is liked."""
    paths = prefixes(spark, sf_dir)
    named = paths.select("category_id", "name").distinct()
    reach = graph.self_or_parent(paths.select("category_id", "parent_id").distinct(), "category_id", "parent_id", named.select("category_id")).where("reached IS NOT NULL")
    wanted = reach.join(named.where(search.any_contains("name", ["Pro", "Eco"])).select(F.col("category_id").alias("reached")), "reached", "left_semi")
    own = paths.where("primary")
    hit = own.join(wanted.select(F.col("node").alias("category_id")).distinct(), "category_id", "left_semi").select("asin").distinct()
    of_brand = brands(spark, sf_dir).where(F.col("name").isin("Brand#1", "Brand#2", "Brand#3")).withColumnRenamed("name", "brand")
    found = products(spark, sf_dir).where("price <= 1500").join(of_brand, "asin").join(hit, "asin", "left_semi").join(recently_rated(spark, sf_dir), "asin", "left")
    scored = search.preference_score(found, attributes(spark, sf_dir), "asin", ["1", "eco"], [], F.col("avg_rating")).orderBy("price", "asin").limit(30)
    told = attributes(spark, sf_dir).join(scored.select("asin"), "asin", "left_semi").groupBy("asin").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "name", "value"))), "|").alias("attributes"))
    kinds = own.join(scored.select("asin"), "asin", "left_semi").groupBy("asin").agg(F.array_join(F.array_sort(F.collect_set("name")), "|").alias("categories"))
    return scored.join(told, "asin").join(kinds, "asin").select("asin", "price", "avg_rating", "brand", "categories", "attributes", F.round("score", 6).alias("score"))


COSINE = "round((1 + list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))) / 2, 6)"


@query(f"WITH {{REV}}, rated AS (SELECT DISTINCT user_id, asin FROM rev WHERE user_id % 20 = 0), s AS (SELECT a.vec_id AS q, b.vec_id AS item, {COSINE} AS score FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id AND a.vec_id IN (SELECT asin FROM rated)), k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, item) <= 3), o AS (SELECT user_id, k.item, max(score) AS score FROM rated JOIN k ON q = asin GROUP BY ALL) SELECT user_id, item, score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item) AS INTEGER) AS rank FROM o WHERE NOT EXISTS (SELECT 1 FROM rated WHERE rated.user_id = o.user_id AND rated.asin = o.item) QUALIFY rank <= 10")
def similar_items_reco(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every user whose id 20 divides."""
    rated = reviews(spark, sf_dir).where("user_id % 20 = 0")
    return search.similar_items(vectors(spark, sf_dir), "asin", "embedding", rated, "user_id", "asin").withColumnRenamed("user", "user_id")


@query(f"WITH r AS (SELECT vec_id, embedding, ['brand', 'exclude_brand', 'category'][CAST(vec_id // 20 % 3 + 1 AS INTEGER)] AS kind FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT a.vec_id, a.kind, (CASE WHEN a.kind = 'category' THEN 'c' ELSE 'b' END) || b.vec_id AS name, {COSINE} AS score FROM r a, embeddings b WHERE CASE WHEN a.kind = 'category' THEN b.label % 2 = 1 ELSE b.label % 2 = 0 END AND b.vec_id % 20 <> 0), k AS (SELECT * FROM s WHERE score >= CASE WHEN kind = 'category' THEN 0.75 ELSE 0.6 END QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, name) = 1) SELECT r.vec_id AS request_id, r.kind, k.name AS resolved, k.score FROM r LEFT JOIN k USING (vec_id)")
def filter_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of brands and categories in filters, grounded by vectors: rows that 20 divides ask, the others are brands (even label) and categories."""
    v = table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")
    kind = F.get(F.array(*map(F.lit, ("brand", "exclude_brand", "category"))), F.expr("cast(vec_id div 20 % 3 as int)"))
    named = lambda rows, letter: rows.select(F.concat(F.lit(letter), F.col("vec_id").cast("string")).alias("name"), "vector")
    known = v.where("vec_id % 20 <> 0")
    return search.grounded_requests(v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("request_id"), kind.alias("kind"), "vector"), named(known.where("label % 2 = 0"), "b"), named(known.where("label % 2 = 1"), "c"))


@query(f"SELECT a.vec_id AS query, b.vec_id AS entity, {COSINE} AS score, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY {COSINE} DESC, b.vec_id) AS INTEGER) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 QUALIFY rank <= 10")
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of all vectors, written and searched exactly by every row whose id 20 divides."""
    v, path = table(spark, sf_dir, "embeddings"), f"{base_dir(spark)}/vector-index-{uuid.uuid4().hex}"
    vector_index.build(v, "vec_id", "embedding", path, measure=False)
    found = vector_index.search_all(spark, path, v.where("vec_id % 20 = 0"), "vec_id", "embedding", 10, exact=True)
    remove(spark, path)
    return found


# --- cleaning ----------------------------------------------------------------------


@query("WITH {REV}, u AS (SELECT user_id FROM rev GROUP BY 1 HAVING count(*) >= 2), i AS (SELECT asin FROM rev GROUP BY 1 HAVING count(*) >= 5) SELECT user_id, count(*) AS n, CAST(sum(rating) AS BIGINT) AS ratings FROM rev WHERE user_id IN (SELECT user_id FROM u) AND asin IN (SELECT asin FROM i) GROUP BY user_id")
def kthreshold_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.at_least(reviews(spark, sf_dir), {"user_id": 2, "asin": 5}).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("rating").alias("ratings"))


@query("WITH {REV} SELECT asin, CAST(rank AS INTEGER) AS rank, l_orderkey, helpful, verified FROM (SELECT *, row_number() OVER (PARTITION BY asin ORDER BY helpful DESC, verified DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS rank FROM rev) WHERE rank <= 20")
def topn_per_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("helpful"), F.desc("verified"), *map(F.col, ORDER)]
    return clean.top_per_group(reviews(spark, sf_dir), ["asin"], order, 20).select("asin", "rank", "l_orderkey", "helpful", "verified")


@query("WITH {REV} SELECT user_id, asin, event_time, l_orderkey FROM rev WHERE event_time BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31' ORDER BY event_time DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice LIMIT 100")
def time_window_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clean.time_window(reviews(spark, sf_dir), "event_time", "1995-01-01", "1995-12-31")
    return clean.latest(found, [F.desc("event_time"), *map(F.col, ORDER)], 100).select("user_id", "asin", "event_time", "l_orderkey")


@query("WITH {REV} SELECT rating, count(*) AS n FROM rev WHERE rating >= 3 GROUP BY rating")
def low_rating_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir).where("rating >= 3").groupBy("rating").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS asin FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def metadata_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.semi(products(spark, sf_dir), table(spark, sf_dir, "lineitem").where("l_quantity > 45"), {"asin": "l_partkey"}).select("asin")


@query("SELECT p_partkey AS asin, coalesce(n, 0) AS reviews, s AS first_reviews FROM part LEFT JOIN (SELECT asin, count(*) AS n, array_to_string(list(CAST(l_orderkey AS VARCHAR) ORDER BY k) FILTER (k <= 3), ' ') AS s FROM (SELECT l_partkey AS asin, l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS k FROM lineitem) GROUP BY asin) ON asin = p_partkey")
def item_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    counts = line.groupBy(F.col("l_partkey").alias("asin")).agg(F.count("*").alias("n"))
    top = clean.top_per_group(line, ["l_partkey"], list(map(F.col, ORDER)), 3)
    text = top.groupBy(F.col("l_partkey").alias("asin")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("l_orderkey").cast("string").alias("t")))), lambda x: x["t"]), " ").alias("first_reviews"))
    return products(spark, sf_dir).join(counts, "asin", "left").join(text, "asin", "left").select("asin", F.coalesce("n", F.lit(0)).alias("reviews"), "first_reviews")


# --- aggregates and statistics ---------------------------------------------------------


@query("WITH {REV} SELECT user_id, count(asin) AS review_count, CAST(sum(CASE WHEN verified THEN 1 ELSE 0 END) AS BIGINT) AS verified_count, CAST(sum(helpful) AS BIGINT) AS helpful_votes FROM rev WHERE user_id IS NOT NULL GROUP BY user_id")
def user_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.user_nodes(reviews(spark, sf_dir))


@query("WITH {REV} SELECT asin, round(avg(rating), 6) AS avg_rating, count(rating) AS review_count FROM rev GROUP BY asin")
def product_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mean_and_count(reviews(spark, sf_dir), ["asin"], "rating")


@query("WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1), t AS (SELECT p_type, n, sum(n) OVER (ORDER BY n DESC, p_type) AS running FROM (SELECT * FROM c ORDER BY n DESC, p_type LIMIT 15)) SELECT p_type, n, round(100.0::DOUBLE * n / (SELECT sum(n) FROM c), 6) AS share, round(100.0::DOUBLE * running / (SELECT sum(n) FROM c), 6) AS cumulative FROM t")
def category_top15_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.shares(table(spark, sf_dir, "part"), "p_type")


@query("WITH {REV} SELECT rating, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM rev), 6) AS share FROM rev GROUP BY rating")
def rating_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(reviews(spark, sf_dir), "rating")


@query("WITH {REV} SELECT count(rating) AS n, round(avg(rating), 6) AS mean, median(rating) AS median, min(rating) AS least, max(rating) AS most FROM rev")
def rating_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.summary(reviews(spark, sf_dir), "rating")


@query("WITH {REV} SELECT bucket, count(*) AS users FROM (SELECT CASE WHEN count(*) = 1 THEN '1' WHEN count(*) <= 5 THEN '2-5' WHEN count(*) <= 10 THEN '6-10' WHEN count(*) <= 50 THEN '11-50' ELSE '51+' END AS bucket FROM rev GROUP BY user_id) GROUP BY bucket")
def activity_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.activity_buckets(reviews(spark, sf_dir), "user_id")


@query("WITH {REV} SELECT user_id, count(*) AS reviews, count(DISTINCT asin) AS products FROM rev GROUP BY user_id ORDER BY reviews DESC, user_id LIMIT 1")
def top_reviewer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_reviewer(reviews(spark, sf_dir), "user_id", "asin")


@query("WITH {REV} SELECT count(*) AS reviews, count(DISTINCT asin) AS products, count(DISTINCT user_id) AS users, round(count(*)::DOUBLE / count(DISTINCT asin), 6) AS per_product, round(count(*)::DOUBLE / count(DISTINCT user_id), 6) AS per_user FROM rev")
def review_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.coverage(reviews(spark, sf_dir), "user_id", "asin")


@query("SELECT DISTINCT unnest(json_keys(props)) AS key FROM events")
def detail_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.from_json("props", "map<string,string>").alias("details"))
    return stats.detail_keys(events, "details")


# --- graph -------------------------------------------------------------------------


@query("WITH {REV} SELECT sha256(user_id || '|' || asin || '|' || CAST(epoch(event_time) AS BIGINT) || '|' || 'None') AS review_id, l_orderkey, l_linenumber, rating FROM rev")
def review_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reviews(spark, sf_dir)
    epoch = F.unix_timestamp(F.col("event_time").cast("timestamp"))
    return r.select(fn.review_id("user_id", "asin", epoch, F.lit(None)).alias("review_id"), "l_orderkey", "l_linenumber", "rating")


@query("WITH {PATH} SELECT category_id, max(name) AS name, max(level) AS level FROM pre GROUP BY category_id")
def category_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.category_nodes(prefixes(spark, sf_dir))


@query("WITH {PATH} SELECT DISTINCT category_id, parent_id, level AS depth FROM pre WHERE level > 0")
def subcategory_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.subcategory_edges(prefixes(spark, sf_dir))


@query('WITH {PATH} SELECT asin, category_id, max(is_primary) AS "primary" FROM pre GROUP BY asin, category_id')
def category_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.category_memberships(prefixes(spark, sf_dir), "asin")


@query("SELECT event_id, sha1('k|' || json_extract_string(props, '$.k')) AS attribute_id, 'k' AS attribute_name, json_extract_string(props, '$.k') AS attribute_value, lower(json_extract_string(props, '$.k')) AS normalized_value, 'categorical' AS value_type, 0.8::DOUBLE AS confidence FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def detail_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").alias("details"))
    return graph.detail_attributes(events, "event_id", "details")


@query("SELECT p_partkey AS asin, sha1('size|' || p_size) AS attribute_id, 'size' AS attribute_name, CAST(p_size AS VARCHAR) AS attribute_value, CAST(p_size AS VARCHAR) AS normalized_value, 'text' AS value_type, 0.6::DOUBLE AS confidence FROM part UNION ALL SELECT p_partkey, sha1('feature|' || trim(p_type)), 'feature', trim(p_type), lower(trim(p_type)), 'text', 0.6::DOUBLE FROM part")
def feature_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asin"), F.array(F.concat(F.lit("Size: "), F.col("p_size").cast("string")), F.col("p_type")).alias("features"))
    return graph.feature_attributes(part, "asin", "features")


@query("SELECT sha1(lower(p_brand)) AS brand_id, min(p_brand) AS name FROM part GROUP BY 1")
def brand_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.brand_nodes(table(spark, sf_dir, "part"), "p_brand", ["p_partkey"])


@query("SELECT event_id, CASE WHEN value < 50 THEN 'USD_0.00_50.00' WHEN value < 150 THEN 'USD_50.00_150.00' WHEN value < 400 THEN 'USD_150.00_400.00' WHEN value < 1000 THEN 'USD_400.00_1000.00' WHEN value < 1500 THEN 'USD_1000.00_1500.00' ELSE 'USD_1500.00_inf' END AS range_id FROM events WHERE value >= 0")
def price_bucket_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.price_edges(table(spark, sf_dir, "events"), "event_id", "value")


BASKET = "bas AS (SELECT l_orderkey, list(DISTINCT l_partkey ORDER BY l_partkey) AS parts FROM lineitem GROUP BY 1), st AS (SELECT l_orderkey, parts[1] AS asin, parts[2:] AS members FROM bas WHERE len(parts) > 1), cs AS (SELECT sha1(CAST(asin AS VARCHAR) || '|' || array_to_string(members, '|')) AS set_id, asin, members, CAST(len(members) AS INTEGER) AS size FROM st)"


def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    baskets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("parts")).where("size(parts) > 1")
    return graph.copurchase_sets(baskets.select(F.col("parts")[0].alias("asin"), F.slice("parts", F.lit(2), F.size("parts")).alias("members")), "asin", "members")


@query(f"WITH {BASKET} SELECT set_id, asin, size FROM cs")
def copurchase_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets(spark, sf_dir).select("set_id", "asin", "size")


@query(f"WITH {BASKET} SELECT set_id, CAST(i - 1 AS INTEGER) AS position, members[i] AS member FROM (SELECT set_id, members, unnest(range(1, len(members) + 1)) AS i FROM cs)")
def copurchase_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.set_members(sets(spark, sf_dir))


@query(f"WITH {BASKET} SELECT src, dst, count(*) AS n FROM (SELECT asin AS src, unnest(members) AS dst FROM cs) WHERE src <> dst GROUP BY ALL")
def copurchase_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bought_together(sets(spark, sf_dir), "asin").groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("WITH {REV} SELECT user_id, asin, rating FROM rev WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND asin IN (SELECT p_partkey FROM part WHERE p_size > 5) QUALIFY row_number() OVER (PARTITION BY user_id, asin ORDER BY l_orderkey DESC, l_partkey DESC, l_suppkey DESC, l_linenumber DESC, l_quantity DESC, l_extendedprice DESC) = 1")
def rated_edges_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey")
    items = table(spark, sf_dir, "part").where("p_size > 5").select("p_partkey")
    return graph.upsert_edges(reviews(spark, sf_dir), users, items, "user_id", "asin", ORDER).select("user_id", "asin", "rating")


@query("SELECT coalesce(o.k, n.k) AS asin, o.title, CASE WHEN n.k IS NOT NULL THEN n.price ELSE o.price END AS price, n.size FROM (SELECT p_partkey AS k, p_name AS title, p_retailprice AS price FROM part) o FULL JOIN (SELECT p_partkey AS k, CASE WHEN p_size > 10 THEN p_retailprice + 1 END AS price, CAST(p_size AS DOUBLE) AS size FROM part) n ON o.k = n.k")
def node_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with all products on both sides."""
    part = table(spark, sf_dir, "part")
    new = part.select(F.col("p_partkey").alias("asin"), F.when(F.col("p_size") > 10, F.col("p_retailprice") + 1).alias("price"), F.col("p_size").cast("double").alias("size"))
    return graph.upsert_nodes(products(spark, sf_dir), new, "asin")


@query("SELECT target_kind, count(*) AS n, CAST(sum(target) AS BIGINT) AS targets FROM (SELECT CASE WHEN l_suppkey IS NOT NULL AND l_partkey IS NOT NULL AND l_suppkey <> l_partkey THEN 'variant' ELSE 'parent' END AS target_kind, CASE WHEN l_suppkey <> l_partkey THEN l_suppkey ELSE coalesce(l_partkey, l_suppkey) END AS target FROM lineitem) GROUP BY 1")
def variant_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.split_targets(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey")
    return found.groupBy("target_kind").agg(F.count("*").alias("n"), F.sum("target").alias("targets"))


@query("SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_suppkey <> l_partkey")
def variant_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.variant_edges(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey")


@query("SELECT l_partkey, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS variants FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY 1")
def variants_of_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.variant_edges(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey")
    return edges.groupBy("l_partkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_suppkey")), lambda x: x.cast("string")), ",").alias("variants"))


@query("SELECT p_partkey AS member, p_brand AS dst, count(*) OVER (PARTITION BY p_brand) AS size FROM part WHERE p_brand IS NOT NULL QUALIFY size > 1")
def same_brand_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All products by brand, as groups with membership: the pairs are those of two members of a group."""
    return graph.same_groups(table(spark, sf_dir, "part"), "p_partkey", "p_brand")


@query(f"WITH {BASKET}, p AS (SELECT DISTINCT asin AS src, unnest(members) AS dst FROM cs) SELECT src, dst, CASE WHEN p_retailprice < 1000 THEN 'USD_400.00_1000.00' WHEN p_retailprice < 1500 THEN 'USD_1000.00_1500.00' WHEN p_retailprice >= 1500 THEN 'USD_1500.00_inf' END AS range_id FROM p LEFT JOIN part ON p_partkey = dst WHERE src <> dst")
def bought_together_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = graph.bought_together(sets(spark, sf_dir), "asin").distinct()
    priced = graph.price_edges(products(spark, sf_dir), "asin", "price")
    return pairs.join(priced, F.col("dst") == F.col("asin"), "left").select("src", "dst", "range_id")


REGION = "ed AS (SELECT DISTINCT c, p FROM (SELECT 's' || s_suppkey AS c, 'n' || s_nationkey AS p FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation))"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    return table(spark, sf_dir, "supplier").select(name("s", "s_suppkey").alias("c"), name("n", "s_nationkey").alias("p")).union(table(spark, sf_dir, "nation").select(name("n", "n_nationkey"), name("r", "n_regionkey")))


@query(f"WITH RECURSIVE {REGION}, r AS (SELECT c AS node, p AS ancestor, 1 AS hops FROM ed UNION ALL SELECT r.node, ed.p, r.hops + 1 FROM r JOIN ed ON ed.c = r.ancestor WHERE r.hops < 5) SELECT node, ancestor, hops, count(*) AS n_paths FROM r GROUP BY ALL")
def ancestor_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ancestors(places(spark, sf_dir), "c", "p", 5)


@query(f"WITH {REGION}, w AS (SELECT 's' || s_suppkey AS node FROM supplier WHERE s_acctbal > 0) SELECT node, node AS reached FROM w UNION SELECT node, p FROM w JOIN ed ON c = node")
def hierarchy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")))
    return graph.self_or_parent(places(spark, sf_dir), "c", "p", own)


@query("WITH RECURSIVE e AS (SELECT l_orderkey AS e, arg_min(l_partkey, {'a': l_linenumber, 'b': l_partkey}) AS s, arg_max(l_partkey, {'a': l_linenumber, 'b': l_partkey}) AS d FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1 HAVING count(*) > 1), t AS (SELECT s AS start, d AS en, [e] AS used, 1 AS hops FROM e UNION ALL SELECT t.start, e.d, list_append(t.used, e.e), t.hops + 1 FROM t JOIN e ON e.s = t.en WHERE t.hops < 5 AND NOT list_contains(t.used, e.e)) SELECT start, en AS reached, CAST(hops AS INTEGER) AS hops, count(*) AS n_paths FROM t GROUP BY ALL")
def bought_later_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From an urgent order's first product to its last, and on from there by other orders: up to five of them, none twice."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    place = F.struct("l_linenumber", "l_partkey")
    ends = table(spark, sf_dir, "lineitem").join(urgent, "l_orderkey").groupBy("l_orderkey").agg(F.min_by("l_partkey", place).alias("src"), F.max_by("l_partkey", place).alias("dst"), F.count("*").alias("n"))
    return graph.trails(ends.where("n > 1"), "src", "dst", 5).withColumnRenamed("end", "reached")


@query("SELECT 'Brand' AS label, count(DISTINCT p_brand) AS n FROM part UNION ALL SELECT 'ParentProduct', count(*) FROM part UNION ALL SELECT 'User', count(*) FROM customer UNION ALL SELECT 'WROTE', count(*) FROM lineitem")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return graph.counts({"Brand": part.select("p_brand").distinct(), "ParentProduct": part, "User": table(spark, sf_dir, "customer"), "WROTE": table(spark, sf_dir, "lineitem")})


@query("SELECT count(embedding) AS embedded, count(*) - count(embedding) AS missing FROM part LEFT JOIN embeddings ON vec_id = p_partkey")
def embedding_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.embedded_counts(products(spark, sf_dir).join(vectors(spark, sf_dir), "asin", "left"), "embedding")


@query("SELECT l_partkey AS asin, l_orderkey, l_shipdate, CAST(k AS INTEGER) AS k FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS k FROM lineitem) WHERE k <= 3")
def recent_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    order = [F.desc("l_shipdate"), *(F.col(c) for c in ORDER if c != "l_partkey")]
    return graph.recent(line, ["l_partkey"], order, 3).select(F.col("l_partkey").alias("asin"), "l_orderkey", "l_shipdate", "k")


@query("SELECT p_partkey AS asin FROM part WHERE contains(lower(p_type), 'a') AND p_size = 10")
def category_and_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = categories(spark, sf_dir).where(search.any_contains("name", ["a"]) & ~F.col("name").startswith("Brand")).select("asin").distinct()
    sized = attributes(spark, sf_dir).where("name = 'size' AND value = '10'").select("asin")
    return typed.join(sized, "asin", "left_semi")


# --- aspects and preferences ----------------------------------------------------------


@query("WITH {MENTION} SELECT aspect, array_to_string(list_sort(list(DISTINCT upper(aspect) || '-' || sentiment)), '|') AS surface_forms, count(*) AS mention_count FROM men GROUP BY aspect")
def aspect_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mentions(spark, sf_dir).withColumn("surface_form", F.concat_ws("-", F.upper("aspect"), "sentiment"))
    return preferences.aspect_nodes(m).withColumn("surface_forms", F.array_join("surface_forms", "|"))


PIVOT = "piv AS (SELECT user_id, aspect, count(*) FILTER (sentiment = 'Positive') AS positive, count(*) FILTER (sentiment = 'Negative') AS negative, count(*) FILTER (sentiment = 'Neutral') AS neutral FROM men GROUP BY ALL)"


@query("WITH {MENTION}, " + PIVOT + " SELECT * FROM piv")
def sentiment_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.sentiment_counts(mentions(spark, sf_dir))


@query("WITH {MENTION}, " + PIVOT + ", t AS (SELECT *, positive + negative AS support FROM piv WHERE positive + negative >= 3), k AS (SELECT user_id, aspect, positive, negative, support, 'PREFERS' AS kind, positive / support AS score FROM t UNION ALL SELECT user_id, aspect, positive, negative, support, 'DISLIKES', negative / support FROM t) SELECT user_id, aspect, positive, negative, support, kind, round(score, 6) AS score FROM k WHERE score >= 0.7")
def preference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.preferences(preferences.sentiment_counts(mentions(spark, sf_dir))).withColumn("score", F.round("score", 6))


@query("WITH {MENTION} SELECT sentiment, count(*) AS n FROM men GROUP BY sentiment")
def sentiment_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(spark, sf_dir).groupBy("sentiment").agg(F.count("*").alias("n"))


# --- text ---------------------------------------------------------------------------


@query(r"SELECT p_partkey AS asin, CASE WHEN s = '' THEN 'unknown' ELSE replace(s, ' ', '_') END AS slug FROM (SELECT p_partkey, trim(lower(regexp_replace(p_name || ' ' || p_brand, '[^\p{L}\p{N}]+', ' ', 'g'))) AS s FROM part)")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asin"), fn.slugify(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


FORMS = "[p_size || '\"', p_size || ' x ' || (p_size + 1) || ' inches', p_size || 'gb RAM', p_size || '.5 lbs', p_size || '5cm', 'plain ' || p_type]"


@query(rf"""WITH v AS (SELECT p_partkey AS asin, lower(trim(unnest({FORMS}))) AS x FROM part),
d AS (SELECT asin, x, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(\d+)\s*("|'''')', '\1 inch', 'g'), '\b(in|inches)\b', 'inch', 'g'), '(\d+)\s*(cm|mm)\b', '\1 \2', 'g'), '\s*x\s*', ' x ', 'g')) AS dim,
regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(\d+)\s*gb\b', '\1 GB', 'g'), '(\d+)\s*mb\b', '\1 MB', 'g'), '(\d+)\s*tb\b', '\1 TB', 'g'), '(\d+)\s*kb\b', '\1 KB', 'g') AS sto FROM v)
SELECT asin, x AS raw, CASE WHEN regexp_matches(x, '\d+\s*("|''''|in\b|inch|cm\b|mm\b)|\d+\s*x\s*\d+') THEN dim WHEN regexp_matches(x, '\d+\s*(gb|mb|tb|kb)\b') THEN sto WHEN regexp_matches(x, '\d+\s*(lbs|lb|kg|g|oz)\b') THEN regexp_replace(x, '\blbs\b', 'lb', 'g') ELSE x END AS normal FROM d""")
def normalize_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    forms = F.array(F.concat(size, F.lit('"')), F.concat(size, F.lit(" x "), (F.col("p_size") + 1).cast("string"), F.lit(" inches")), F.concat(size, F.lit("gb RAM")), F.concat(size, F.lit(".5 lbs")), F.concat(size, F.lit("5cm")), F.concat(F.lit("plain "), F.col("p_type")))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asin"), F.explode(forms).alias("raw"))
    return rows.select("asin", F.lower(F.trim("raw")).alias("raw"), fn.normalized_attribute("raw").alias("normal"))


@query("SELECT p_partkey AS asin, p_name || ' ' || p_name || ' ' || p_type AS text FROM part")
def weighted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asin"), fn.weighted_text("p_name", "p_type").alias("text"))


@query("WITH {REV} SELECT helpful, verified, CAST(round(1.0 + CASE WHEN helpful > 5 THEN 0.5 WHEN helpful > 0 THEN 0.2 ELSE 0.0 END + CASE WHEN verified THEN 0.3 ELSE 0.0 END, 6) AS DOUBLE) AS weight, count(*) AS n FROM rev GROUP BY ALL")
def review_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reviews(spark, sf_dir).withColumn("weight", F.round(fn.review_weight("helpful", "verified"), 6))
    return r.groupBy("helpful", "verified", "weight").agg(F.count("*").alias("n"))


# --- state and sets --------------------------------------------------------------------


@query("SELECT conv_id, turn, CAST(rank AS INTEGER) AS rank FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM conversations) WHERE rank <= 20")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.history(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "rank")


@query("SELECT conv_id, turn, CAST(rank AS INTEGER) AS rank FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM conversations) WHERE rank <= 5")
def prompt_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.prompt_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "rank")


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def profile_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.merged_profile(table(spark, sf_dir, "events"), "user_id", "event_type", "value", ["event_id"])


@query("SELECT p_partkey AS asin FROM part INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def intersect_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).select("asin").intersect(table(spark, sf_dir, "lineitem").where("l_quantity > 40").select("l_partkey"))


@query("SELECT p_partkey AS asin FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40) ORDER BY asin LIMIT 10")
def except_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("asin"))
    return products(spark, sf_dir).select("asin").join(seen, "asin", "left_anti").orderBy("asin").limit(10)


@query("SELECT p_partkey AS asin, p_retailprice AS price FROM part ORDER BY price, asin LIMIT 20 OFFSET 40")
def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).select("asin", "price").orderBy("price", "asin").offset(40).limit(20)


from brindle.plans import records, storage  # noqa: E402, F401  their queries are registered here
