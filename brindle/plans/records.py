"""Queries on texts, records, collects and retrieval; they join those of ``catalog``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import scalars as fn
from brindle.functions import tables, texts
from brindle.operators import clean, gazetteer, graph, preferences, prompts, rankers, records, search, stats, templates
from brindle.plans.catalog import ORDER, QUERY, SCORE, attributes, brands, categories, mentions, places, products, query, reviews, table, vectors

# --- texts ---------------------------------------------------------------------------


@query("SELECT p_partkey AS asin, 'Brand: ' || p_brand || '. Domain: consumer electronics' AS brand_text, 'Category: ' || p_brand || '. Parent: ' || p_type AS category_text, 'Category: ' || p_type || '. Parent: Root' AS root_text, 'size: ' || p_size AS attribute_text, lower(trim(p_type)) AS generic_text FROM part")
def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("asin"), texts.brand_text("p_brand", none).alias("brand_text"), texts.category_text("p_brand", "p_type").alias("category_text"), texts.category_text("p_type", none).alias("root_text"),
        texts.attribute_text(F.lit("size"), F.col("p_size").cast("string")).alias("attribute_text"), texts.attribute_text(F.lit(" Feature "), "p_type").alias("generic_text"),
    )


@query("WITH t AS (SELECT p_type, p_brand, list(p_name ORDER BY p_partkey) AS names FROM part GROUP BY ALL) SELECT p_type, p_brand, 'Category: ' || p_brand || '. Context: ' || p_type || '. Related items: ' || array_to_string(list_transform(names[1:5], lambda x: array_to_string(string_split(x, ' ')[1:10], ' ')), ', ') || '.' AS text FROM t")
def category_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = records.first_of_group(table(spark, sf_dir, "part"), ["p_type", "p_brand"], F.col("p_name"), [F.col("p_partkey")], 5, "titles")
    return titles.select("p_type", "p_brand", texts.category_context_text("p_brand", F.array("p_type", "p_brand"), "titles").alias("text"))


@query("SELECT p_partkey AS asin, 'Product: ' || p_name || '. Category: ' || p_type || '. Features: size: ' || p_size || ', type: ' || p_type || '. Description: ' AS text FROM part")
def product_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = records.feature_texts(attributes(spark, sf_dir), "asin", "name", "value")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asin"), "p_name", "p_type").join(features, "asin", "left")
    return part.select("asin", texts.product_text("p_name", "p_type", "features", F.lit(None).cast("string")).alias("text"))


@query("SELECT p_partkey AS asin, p_name || ' ' || p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_type || ' Brand: ' || p_brand || ' Size: ' || p_size || ' Size: ' || p_size || ' Make: ' || p_brand AS text, p_type || ' | ' || p_brand AS listed FROM part")
def metadata_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    details = F.create_map(F.lit("Size"), F.col("p_size").cast("string"), F.lit("Make"), F.col("p_brand"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asin"), "p_name", "p_type", "p_brand", details.alias("details"), F.array("p_type", "p_brand").alias("path"), F.array().cast("array<string>").alias("none"))
    return part.select("asin", texts.metadata_text("p_name", "none", "none", "path", "p_type", "p_brand", "details").alias("text"), texts.list_text("path").alias("listed"))


REVIEW_ORDER = "helpful DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice"


@query(f"WITH {{REV}}, t AS (SELECT asin, row_number() OVER (PARTITION BY asin ORDER BY {REVIEW_ORDER}) AS k, 'order ' || l_orderkey || ' rated ' || rating AS t FROM rev) SELECT asin, array_to_string(list(t ORDER BY k), ' ') AS text FROM t WHERE k <= 5 GROUP BY asin")
def review_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reviews(spark, sf_dir).withColumns({"title": F.concat(F.lit("order "), F.col("l_orderkey").cast("string")), "text": F.concat(F.lit("rated "), F.col("rating").cast("string"))})
    return records.review_texts(r, "asin", [F.desc("helpful"), *map(F.col, ORDER)], 5)


@query(r"WITH s AS (SELECT doc_id, substr(trim(regexp_replace(text, '[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')), 1, 512) AS s FROM documents), w AS (SELECT doc_id, s, list_filter(string_split(s, ' '), lambda x: x <> '') AS w FROM s) SELECT doc_id, CASE WHEN len(w) > 200 THEN array_to_string(w[1:200], ' ') WHEN len(w) > 0 THEN s END AS clean, CASE WHEN s IS NULL THEN 'non-string text' WHEN s = '' THEN 'empty after strip' END AS reason FROM w")
def sanitize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.sanitize(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").drop("text")


@query(r"SELECT p_partkey AS asin, coalesce(lower(nullif(regexp_extract(p_type, '\b(STEEL|COPPER|TIN)\b'), '')), replace(trim(lower(regexp_replace(p_type, '[^\p{L}\p{N}]+', ' ', 'g'))), ' ', '_')) AS aspect FROM part")
def canonical_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asin"), texts.canonical_aspect("p_type", ["STEEL", "COPPER", "TIN"]).alias("aspect"))


@query(r"""WITH terms AS (SELECT DISTINCT array_to_string(w[j:j + 2], ' ') AS term FROM (SELECT w, unnest(range(1, len(w) - 1)) AS j FROM (SELECT string_split(text, ' ') AS w FROM benchmark)) UNION SELECT DISTINCT array_to_string(string_split(text, ' ')[1:2], ' ') FROM documents WHERE text <> ''),
sized AS (SELECT term, len(t) AS n, t[1] AS first FROM (SELECT term, regexp_extract_all(term, '(?s)[\p{L}\p{N}]+|[^\p{L}\p{N}]') AS t FROM terms)), d AS (SELECT doc_id, regexp_extract_all(text, '(?s)[\p{L}\p{N}]+|[^\p{L}\p{N}]') AS t FROM documents),
w AS (SELECT doc_id, unnest(t) AS token, unnest(range(1, len(t) + 1)) AS i FROM d), p AS (SELECT w.*, n FROM w JOIN (SELECT DISTINCT first AS token, n FROM sized) USING (token)), s AS (SELECT doc_id, i, n, array_to_string(t[i:i + n - 1], '') AS term, t[i + n - 1] AS last, t[i + n] AS after FROM p JOIN d USING (doc_id) WHERE i + n - 1 <= len(t) AND (i = 1 OR regexp_matches(t[i], '^[\p{L}\p{N}]') OR NOT regexp_matches(t[i - 1], '^[\p{L}\p{N}]'))),
m AS (SELECT s.* FROM s JOIN sized USING (term, n) WHERE regexp_matches(last, '^[\p{L}\p{N}]') OR after IS NULL OR NOT regexp_matches(after, '^[\p{L}\p{N}]')),
f AS (SELECT doc_id, count(DISTINCT i) AS starts FROM m GROUP BY 1), l AS (SELECT doc_id, i, term FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i, n DESC) = 1)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS position, term, starts FROM l JOIN f USING (doc_id)""")
def gazetteer_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document the first mention of a gazetteer, and at how many places one begins.  Terms: three words that follow each other in the benchmark, and how documents begin."""
    docs, words = table(spark, sf_dir, "documents").select("doc_id", "text"), F.split("text", " ", -1)
    three = table(spark, sf_dir, "benchmark").select(words.alias("w")).select(F.explode(F.transform(F.filter(F.sequence(F.lit(1), F.size("w")), lambda j: j <= F.size("w") - 2), lambda j: F.array_join(F.slice("w", j, F.lit(3)), " "))).alias("term"))
    two = docs.where("text <> ''").select(F.array_join(F.slice(words, 1, 2), " ").alias("term"))
    met = gazetteer.starts(docs, "doc_id", "text", three.union(two))
    return met.groupBy("doc_id").agg(F.min("position").alias("position"), F.min_by("term", "position").alias("term"), F.count("*").alias("starts"))


# --- cleaning ------------------------------------------------------------------------


@query("SELECT event_id, event_type, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN -1 ELSE value END AS value, 'none' AS kind FROM events")
def absent_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    full = records.absent_filled(events, "props", {"k": "-1", "kind": "none"})
    return full.select("event_id", "event_type", F.when(F.col("k") == "-1", F.lit(-1.0)).otherwise(F.col("value")).alias("value"), "kind")


@query("SELECT event_id, coalesce(CASE WHEN event_type <> 'view' THEN event_type END, '') AS kind FROM events WHERE value > 100")
def complete_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.when(F.col("value") > 100, F.col("value")).alias("v"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"))
    return records.filled(records.complete(events, ["v"]), ["kind"]).select("event_id", "kind")


@query("WITH {REV} SELECT user_id, asin, rating, min(l_orderkey) AS l_orderkey FROM rev GROUP BY ALL")
def distinct_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.distinct_by(reviews(spark, sf_dir), ["user_id", "asin", "rating"], [F.col("l_orderkey")]).select("user_id", "asin", "rating", "l_orderkey")


@query("SELECT event_id FROM events WHERE value >= 100")
def fallback_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.narrowed(table(spark, sf_dir, "events"), 100, lambda df: df.where("value >= 100")).select("event_id")


@query("""SELECT p_partkey AS asin, '["' || p_type || '","' || p_brand || '"]' AS path FROM part""")
def json_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.encoded(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asin"), F.array("p_type", "p_brand").alias("path")), ["path"])


@query("SELECT p_partkey AS asin, sha1(lower(trim(p_brand))) AS brand_id, trim(p_brand) AS name, 0.95::DOUBLE AS confidence FROM part")
def brand_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asin"), F.lit(" ").alias("brand"), F.create_map(F.lit("Brand"), F.lit(""), F.lit("Brand Name"), F.col("p_brand")).alias("details"))
    return graph.brand_edges(part, "asin", "brand", "details").withColumn("confidence", F.col("confidence").cast("double"))


@query(r"""WITH c AS (SELECT DISTINCT doc_id, unnest(string_split_regex(text, '[.\n]+')) AS part FROM documents WHERE length(text) > 50 AND doc_id % 3 <> 0), p AS (SELECT doc_id, CASE WHEN contains(part, ': ') THEN trim(split_part(part, ': ', 1)) ELSE 'note' END AS name, CASE WHEN contains(part, ': ') THEN trim(substr(part, strpos(part, ': ') + 2)) ELSE trim(part) END AS value FROM c),
x AS (SELECT doc_id, lower(trim(name)) AS name, lower(trim(value)) AS x FROM p WHERE name <> '' AND value <> ''),
v AS (SELECT doc_id, name, CASE WHEN regexp_matches(x, '\d+\s*("|''|in\b|inch|cm\b|mm\b)|\d+\s*x\s*\d+') THEN trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(\d+)\s*("|'')', '\1 inch', 'g'), '\b(in|inches)\b', 'inch', 'g'), '(\d+)\s*(cm|mm)\b', '\1 \2', 'g'), '\s*x\s*', ' x ', 'g'))
WHEN regexp_matches(x, '\d+\s*(gb|mb|tb|kb)\b') THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(\d+)\s*gb\b', '\1 GB', 'g'), '(\d+)\s*mb\b', '\1 MB', 'g'), '(\d+)\s*tb\b', '\1 TB', 'g'), '(\d+)\s*kb\b', '\1 KB', 'g') WHEN regexp_matches(x, '\d+\s*(lbs|lb|kg|g|oz)\b') THEN regexp_replace(x, '\blbs\b', 'lb', 'g') ELSE x END AS value FROM x)
SELECT md5(name || '|' || value) AS attribute_id, count(DISTINCT doc_id) AS n FROM v GROUP BY 1""")
def derived_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long generic attributes that aren't marked yet, whole, taken apart by a stand-in for a model, as derived attributes with their use."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(" Feature").alias("name"), F.col("text").alias("value"), F.lit("details").alias("source"))
    todo = records.unmarked_long(docs.withColumn("name", F.trim("name")), docs.where("doc_id % 3 = 0").select("doc_id"), "doc_id")
    _, edges = records.derived_attributes(tables.decomposed(todo, "doc_id", "value"), "doc_id")
    return edges.groupBy("attribute_id").agg(F.count("*").alias("n"))


# --- collects ------------------------------------------------------------------------


@query("SELECT p_brand AS brand, array_to_string(list_sort(list(DISTINCT p_type || '=' || p_size)), '|') AS pairs FROM part GROUP BY 1")
def distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), "p_type", F.col("p_size").cast("string").alias("size"))
    found = records.distinct_pairs(part, "brand", "p_type", "size")
    return found.select("brand", F.array_join(F.array_sort(F.transform("pairs", lambda p: F.concat(p["name"], F.lit("="), p["value"]))), "|").alias("pairs"))


@query("SELECT p_brand AS brand, array_to_string(list(p_name ORDER BY p_retailprice DESC, p_partkey)[1:5], '|') AS titles FROM part GROUP BY 1")
def first_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "brand")
    return records.first_of_group(part, ["brand"], F.col("p_name"), [F.desc("p_retailprice"), F.col("p_partkey")], 5, "titles").select("brand", F.array_join("titles", "|").alias("titles"))


@query("WITH f AS (SELECT p_brand AS brand, 'type: ' || p_type AS t FROM part UNION ALL SELECT p_brand, 'size: ' || p_size FROM part) SELECT brand, array_to_string(list(t ORDER BY t)[1:5], '|') AS features FROM f GROUP BY 1")
def feature_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attributes(spark, sf_dir).join(brands(spark, sf_dir).withColumnRenamed("name", "brand"), "asin")
    return records.feature_texts(rows, "brand", "name", "value").select("brand", F.array_join("features", "|").alias("features"))


@query("WITH {REV}, m AS (SELECT l_orderkey AS review_id, 'a' || l_linenumber AS aspect FROM lineitem WHERE l_quantity > 45), u AS (SELECT DISTINCT l_orderkey AS review_id, user_id FROM rev WHERE l_quantity > 5) SELECT review_id, aspect, user_id FROM m JOIN u USING (review_id)")
def mentions_of_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("review_id"), F.concat(F.lit("a"), F.col("l_linenumber").cast("string")).alias("aspect"))
    return records.mentions_of_users(m, reviews(spark, sf_dir).where("l_quantity > 5").withColumnRenamed("l_orderkey", "review_id"), "review_id")


@query("WITH {REV} SELECT CAST(l_orderkey AS VARCHAR) AS review_id, asin FROM rev WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def known_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return clean.semi(reviews(spark, sf_dir), known, {"l_orderkey": "o_orderkey"}).select(F.col("l_orderkey").cast("string").alias("review_id"), "asin")


@query("WITH {REV}, k AS (SELECT *, row_number() OVER (PARTITION BY asin ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS k FROM rev) SELECT p_partkey AS asin, CAST(p_size AS VARCHAR) AS detail_size, CAST(count(k.k) AS INTEGER) AS reviews, CAST(sum(rating) AS BIGINT) AS ratings, max(user_id) AS last_user FROM part LEFT JOIN k ON k.asin = p_partkey AND k.k <= 50 GROUP BY ALL")
def nested_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = products(spark, sf_dir).select("asin").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asin"), F.create_map(F.lit("Size"), F.col("p_size").cast("string")).alias("details")), "asin")
    full = records.item_details(items, reviews(spark, sf_dir).withColumn("text", F.lit("")), "asin", list(map(F.col, ORDER)), 50, "details")
    total = F.aggregate("reviews", F.lit(0).cast("bigint"), lambda s, r: s + r["rating"])
    return full.select("asin", "detail_size", F.when(F.col("reviews").isNull(), 0).otherwise(F.size("reviews")).alias("reviews"), total.alias("ratings"), F.array_max(F.transform("reviews", lambda r: r["user_id"])).alias("last_user"))


@query("SELECT event_id, round((value - lo) / (hi - lo), 9) AS scaled FROM events CROSS JOIN (SELECT min(value) AS lo, max(value) AS hi FROM events)")
def min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.min_max(table(spark, sf_dir, "events"), "value", "scaled").select("event_id", F.round("scaled", 9).alias("scaled"))


@query("SELECT user_id, event_id, value - 200 AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value - 200 DESC, event_id) AS rank FROM events WHERE value - 200 > 0) WHERE rank <= 3")
def top_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") - 200).alias("score"))
    return rankers.top_positive(scores, ["user_id"], "event_id", "score", 3)


@query("WITH a AS (SELECT l_partkey, avg(1 + (CAST(l_quantity AS BIGINT) % 5)) AS a FROM lineitem GROUP BY 1), b AS (SELECT least(floor((round(a, 6) - 1) / 0.2) + 1, 20) AS bin FROM a) SELECT CAST(bin AS INTEGER) AS bin, round(1 + (bin - 1) * 0.2, 6) AS least, count(*) AS n FROM b GROUP BY ALL")
def mean_rating_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.binned(stats.mean_and_count(reviews(spark, sf_dir), ["asin"], "rating"), "avg_rating", 1.0, 5.0)


@query("WITH {REV} SELECT p_brand AS brand, round(avg(rating), 6) AS avg_rating, count(*) AS review_count FROM rev JOIN part ON p_partkey = asin GROUP BY 1 ORDER BY review_count DESC, brand LIMIT 15")
def top_category_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reviews(spark, sf_dir).select("asin", "rating").join(brands(spark, sf_dir).withColumnRenamed("name", "brand"), "asin")
    return stats.top_means(rows, "brand", "rating")


@query("WITH a AS (SELECT p_partkey AS asin, p_name AS title, row_number() OVER (ORDER BY p_partkey) AS k FROM part ORDER BY p_partkey LIMIT 3), b AS (SELECT p_partkey AS asin, p_name AS title, row_number() OVER (ORDER BY p_partkey DESC) AS k FROM part ORDER BY p_partkey DESC LIMIT 3), u AS (SELECT 0 AS f, * FROM a UNION ALL SELECT 1, * FROM b) SELECT asin, title, CAST(row_number() OVER (ORDER BY f, k) AS INTEGER) AS rank FROM u")
def combined_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = products(spark, sf_dir).select("asin", "title")
    first, then = p.orderBy("asin").limit(3).withColumn("position", F.col("asin")), p.orderBy(F.desc("asin")).limit(3).withColumn("position", -F.col("asin"))
    return records.combined(first, then, "position").drop("position")


@query("SELECT l_partkey AS asin, 'line' AS kind FROM lineitem WHERE l_quantity > 49 UNION ALL SELECT p_partkey, 'part' FROM part WHERE p_size = 1")
def union_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("asin"), F.lit("line").alias("kind"))
    return lines.unionByName(table(spark, sf_dir, "part").where("p_size = 1").select(F.col("p_partkey").alias("asin"), F.lit("part").alias("kind")), allowMissingColumns=True)


# --- retrieval -----------------------------------------------------------------------

COSINE = "round((1 + list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))) / 2, 6)"


@query(f"WITH s AS (SELECT a.vec_id, b.label, b.vec_id AS entity, {COSINE} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id), k AS (SELECT * FROM s WHERE score >= 0.72 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, entity) = 1) SELECT e.vec_id, coalesce('attribute ' || k.entity, 'like ' || e.vec_id) AS resolved, k.score FROM embeddings e LEFT JOIN k USING (vec_id) WHERE e.vec_id % 20 = 0")
def preference_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id 20 divides as a liked term, against all other rows as attributes."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    terms = v.where("vec_id % 20 = 0").withColumn("text", F.concat(F.lit("like "), F.col("vec_id").cast("string")))
    named = v.select("vec_id", F.concat(F.lit("attribute "), F.col("vec_id").cast("string")).alias("name"), "embedding")
    return search.grounded_preferences(terms, named, "vec_id", "vec_id", "embedding", least=0.72, apart=True)


@query(f"WITH near AS (SELECT vec_id, {SCORE} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 150), f AS (SELECT vec_id AS asin, p_type, score FROM near JOIN part ON p_partkey = vec_id WHERE p_retailprice <= 1500 ORDER BY score DESC, asin LIMIT 5), n AS (SELECT *, row_number() OVER (ORDER BY score DESC, asin) AS position FROM f), s AS (SELECT asin, CAST(position AS INTEGER) AS position, CASE WHEN asin % 3 <> 0 THEN CAST(length(p_type) AS DOUBLE) ELSE score * 100 END AS fit FROM n WHERE asin % 5 <> 0) SELECT * FROM s ORDER BY fit DESC, position LIMIT 3")
def recommendation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search, evidence, a deterministic scorer in the model's place, the best three."""

    def scorer(items: DataFrame) -> DataFrame:
        told = F.filter("evidence", lambda e: e["name"] == "type")
        length = F.length(F.get(told, F.lit(0))["value"]).cast("double")
        return items.withColumns({"fit_score": F.when(F.col("asin") % 3 != 0, length), "is_recommended": F.col("asin") % 5 != 0})

    found = search.search(products(spark, sf_dir), brands(spark, sf_dir), categories(spark, sf_dir), vectors(spark, sf_dir), "asin", "embedding", query=QUERY, filters={"price_max": 1500}, limit=5)
    r = reviews(spark, sf_dir).select("asin", "helpful", "event_time", F.col("l_orderkey").cast("string").alias("review_id"), F.lit("t").alias("title"), F.lit("x").alias("text"))
    return search.recommended(found, attributes(spark, sf_dir), r, "asin", scorer).select("asin", "position", "fit")


@query("SELECT p_partkey AS asin, p_brand AS brand FROM part WHERE p_retailprice <= 950 AND p_brand IN ('Brand#12', 'Brand#23') ORDER BY asin LIMIT 10")
def template_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template with two of its parameters missing: a list that then filters nothing, and the limit."""
    text = "SELECT p_partkey AS asin, p_brand AS brand FROM {part} WHERE p_retailprice <= $most AND array_contains($brands, p_brand) AND NOT coalesce(array_contains($without, p_brand), false) ORDER BY asin LIMIT $limit"
    return templates.run(spark, text, {"most": 950, "brands": ["Brand#12", "Brand#23"]}, part=table(spark, sf_dir, "part"))


@query("SELECT p_name AS title, p_type AS main_category, CASE WHEN p_size % 3 = 0 THEN 'Unknown' ELSE p_brand END AS store, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) || '.00' WHEN p_size % 5 = 0 THEN '0.00' ELSE '7.00' END AS price, 'Unknown' AS rating, p_type || ', ' || p_brand AS features, 0.0::DOUBLE AS score FROM part")
def result_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty texts of the record and of the node, and decimal zeros of the record, count as nothing; the node's own price does not."""
    part, amount = table(spark, sf_dir, "part"), lambda c: c.cast("decimal(10,2)")
    blank = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand"))
    node = F.struct(F.col("p_name").alias("title"), amount(F.when(F.col("p_size") % 5 == 0, 0).otherwise(7)).alias("price"), blank.alias("brand"), F.lit("").alias("main_category"))
    price = amount(F.when(F.col("p_size") % 2 == 0, F.col("p_size")).otherwise(0))
    found = part.select(F.lit("").alias("title"), price.alias("price"), F.lit("").alias("brand"), F.array("p_type", "p_brand").alias("categories"), F.array("p_type", "p_brand").alias("features"), F.lit(0.0).alias("avg_rating"), F.lit("x").alias("score"), node.alias("pp"))
    return records.result_items(found, "pp")


@query("SELECT p_partkey AS asin FROM part WHERE p_retailprice < 0")
def budget_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of price ranges are amounts, so the words find nothing: an empty result."""
    p = products(spark, sf_dir)
    return search.in_price_range(p, graph.price_ranges(spark), graph.price_edges(p, "asin", "price"), "asin", ["cheap", "budget"]).select("asin")


@query("SELECT p_partkey AS asin, p_retailprice AS price FROM part WHERE p_retailprice >= 150 AND p_retailprice < 1000")
def range_label_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a word that labels have: a bound of two of the ranges."""
    p = products(spark, sf_dir)
    return search.in_price_range(p, graph.price_ranges(spark), graph.price_edges(p, "asin", "price"), "asin", ["$400", "nothing"]).select("asin", "price")


@query("SELECT p_partkey AS asin, p_name AS title FROM part WHERE contains(lower(p_type), 'steel') OR contains(lower(p_brand), 'steel')")
def category_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, none = products(spark, sf_dir), brands(spark, sf_dir)
    return search.conditions({"category": "Steel"}, p, none, categories(spark, sf_dir), "asin").select("asin", "title")


@query("WITH av AS (SELECT l_partkey AS asin, avg(1 + (CAST(l_quantity AS BIGINT) % 5)) AS a FROM lineitem GROUP BY 1) SELECT p_partkey AS asin, round(a - (CASE WHEN contains(lower(p_type), 'tin') THEN 1 ELSE 0 END), 6) AS score FROM part LEFT JOIN av ON asin = p_partkey")
def dislike_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = reviews(spark, sf_dir).groupBy("asin").agg(F.avg("rating").alias("avg_rating"))
    found = search.preference_score(products(spark, sf_dir).join(rated, "asin", "left"), attributes(spark, sf_dir), "asin", [], ["tin"], F.col("avg_rating"))
    return found.select("asin", F.round("score", 6).alias("score"))


@query("WITH RECURSIVE ed AS (SELECT 's' || s_suppkey AS c, 'n' || s_nationkey AS p FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation), r AS (SELECT c AS node, p AS ancestor, 1 AS hops FROM ed UNION ALL SELECT r.node, ed.p, r.hops + 1 FROM r JOIN ed ON ed.c = r.ancestor) SELECT node, ancestor, hops, count(*) AS n_paths FROM r GROUP BY ALL")
def all_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.path_counts(places(spark, sf_dir), "c", "p")


@query("SELECT 'Product' AS label, sha1('Product|' || p_partkey) AS element_id, p_name AS title FROM part")
def labelled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.labelled(products(spark, sf_dir), "Product", ["asin"]).select("label", "element_id", "title")


@query("WITH {MENTION} SELECT event_id, lower(aspect) AS aspect, aspect AS surface_form, 'o' AS opinion, sentiment, CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence FROM men")
def parsed_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's output in both forms: objects with keys in either case, and lists."""
    named = F.to_json(F.struct(F.array(F.struct(F.col("aspect").alias("Target"), F.lit("o").alias("opinion"), F.col("sentiment").alias("Polarity"), F.lit(0.5).alias("confidence"))).alias("Triplets")))
    listed = F.to_json(F.array(F.array("aspect", F.lit(" o "), F.lower("sentiment")), F.array(F.lit(""), F.lit(" "), F.lit("positive"))))
    out = mentions(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 2 == 0, named).otherwise(listed).alias("out"))
    return preferences.parsed_triplets(out, "event_id", "out", fn.slugify)


# --- prompts and answers -------------------------------------------------------------------


@query("WITH k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) SELECT p_brand, array_to_string(list('Item ' || rank || E':\n- Title: ' || p_name || E'\n- Category: ' || p_type || E'\n- Brand: ' || p_brand || E'\n- Price: $' || CAST(p_retailprice AS DECIMAL(18, 2)) || E'\n- Rating: Unknown/5.0\n- Features: None specified\n- Match score: ' || CAST(p_size / 100 AS DECIMAL(9, 2)) || E'\n' ORDER BY rank), E'\n') AS text FROM k WHERE rank <= 3 GROUP BY p_brand")
def item_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest products of each brand as numbered blocks."""
    items = table(spark, sf_dir, "part").select("p_brand", F.col("p_name").alias("title"), F.lit("").alias("main_category"), F.col("p_type").alias("category"), F.col("p_brand").alias("store"), F.col("p_retailprice").cast("decimal(18,2)").alias("price"), (F.col("p_size") / 100).cast("string").alias("score"), "p_partkey")
    return prompts.item_texts(items, "p_brand", [F.desc("price"), F.col("p_partkey")], 3)


@query("WITH {MENTION}, " + """piv AS (SELECT user_id, aspect, count(*) FILTER (sentiment = 'Positive') AS p, count(*) FILTER (sentiment = 'Negative') AS n FROM men GROUP BY ALL), w AS (SELECT user_id, aspect, 0 AS place, p / 10 AS weight FROM piv WHERE p > n UNION ALL SELECT user_id, aspect, 1, n / 10 FROM piv WHERE n > p UNION ALL SELECT c_custkey, c_mktsegment, 2, 0 FROM customer WHERE c_acctbal > 5000),
l AS (SELECT user_id, place, row_number() OVER (PARTITION BY user_id, place ORDER BY weight DESC, aspect) AS rank, CASE place WHEN 2 THEN '- segment: ' || aspect ELSE '- ' || aspect || ' (weight=' || CAST(weight AS DECIMAL(9, 2)) || ')' END AS line FROM w),
b AS (SELECT user_id, place, ['Positive signals:', 'Negative signals:', 'Constraints:'][place + 1] || E'\n' || array_to_string(list(line ORDER BY rank), E'\n') AS block FROM l GROUP BY user_id, place), t AS (SELECT user_id, array_to_string(list(block ORDER BY place), E'\n\n') AS text FROM b GROUP BY 1)
SELECT c_custkey AS user_id, coalesce(text, 'No structured preferences captured yet.') AS text FROM customer LEFT JOIN t ON user_id = c_custkey""")
def preference_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each customer's events say for and against, and a constraint of the well-off ones."""
    moods = preferences.sentiment_counts(mentions(spark, sf_dir))
    row = lambda kind, a, b: moods.where(f"{a} > {b}").select("user_id", F.lit(kind).alias("kind"), F.lit("").alias("name"), F.col("aspect").alias("value"), (F.col(a) / 10).alias("weight"))
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "user_id")
    bound = customers.where("c_acctbal > 5000").select("user_id", F.lit("constraint").alias("kind"), F.lit("segment").alias("name"), F.col("c_mktsegment").alias("value"), F.lit(0.0).alias("weight"))
    return prompts.preference_texts(customers, row("like", "positive", "negative").unionByName(row("dislike", "negative", "positive")).unionByName(bound), "user_id")


@query("SELECT conv_id, array_to_string(list(upper(role[1]) || role[2:] || ': ' || coalesce(text, '') ORDER BY turn), E'\n') AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 5 GROUP BY conv_id")
def turn_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.turn_texts(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN '' ELSE event_type END AS likes, CASE WHEN event_id % 4 = 3 THEN 'recommendation' ELSE 'find' END AS intent, CASE WHEN event_id % 4 = 3 THEN 'no json ' || event_type ELSE '' END AS notes FROM events")
def answer_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in four shapes: a call of the tool, a message's call, an output, and a text that is no JSON."""
    arguments = F.to_json(F.struct(F.array("event_type").alias("likes"), F.lit("find").alias("intent")))
    call = F.array(F.struct(F.lit("other").alias("name"), F.lit("{}").alias("args")), F.struct(F.lit("tell").alias("name"), arguments.alias("args")))
    shapes = (F.to_json(F.struct(call.alias("tool_calls"))), F.to_json(F.struct(F.array(F.struct(F.lit("other").alias("name"), F.lit("m").alias("content")), F.struct(F.lit("tell").alias("name"), arguments.alias("content"))).alias("messages"))), F.to_json(F.struct(arguments.alias("output"))), F.concat(F.lit(" no json "), F.col("event_type")))
    raw = F.coalesce(*(F.when(F.col("event_id") % 4 == k, s) for k, s in enumerate(shapes)))
    told = table(spark, sf_dir, "events").select("event_id", prompts.answer(raw, "tell").alias("text"))
    return prompts.preference_payloads(told, "event_id", "text").select("event_id", F.array_join("likes", ",").alias("likes"), "intent", "notes")
