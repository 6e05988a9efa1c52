"""The property graph as node and edge tables: derivation, upserts, patterns and paths."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import scalars as fn
from brindle.operators.clean import first_per_key
from brindle.shared import Kept

# --- upserts -----------------------------------------------------------------


def last_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: that which comes last."""
    return first_per_key(df, key, [F.col(c).desc() for c in order])


def upsert_nodes(old: DataFrame, new: DataFrame, key: str, order: Sequence[str] = ()) -> DataFrame:
    """old with the rows of new merged in by key.

    Columns that new has are set, nulls too; columns that it lacks stay.  Of new
    rows with one key the last by order counts.  One shuffle of each side by key.
    """
    if order:
        new = last_wins(new, [key], order).drop(*order)
    a, b = old.alias("a"), new.withColumn("__new", F.lit(True)).alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    columns = []
    for c in dict.fromkeys([*old.columns, *new.columns]):
        mine, theirs = F.col(f"a.{c}") if c in old.columns else F.lit(None), F.col(f"b.{c}") if c in new.columns else None
        if c == key:
            columns.append(F.coalesce(theirs, mine).alias(c))
        elif theirs is None:
            columns.append(mine.alias(c))
        else:
            columns.append(F.when(F.col("b.__new"), theirs).otherwise(mine).alias(c))
    return joined.select(*columns)


def upsert_edges(edges: DataFrame, sources: DataFrame, targets: DataFrame, src: str, dst: str, order: Sequence[str]) -> DataFrame:
    """One edge for each (src, dst), the last by order; edges without both nodes are dropped.

    sources and targets have their key as the first column.
    """
    for column, nodes in ((src, sources), (dst, targets)):
        keys = nodes.select(F.col(nodes.columns[0]).alias("__key"))
        edges = edges.join(keys, F.col(column) == F.col("__key"), "left_semi")
    return last_wins(edges, [src, dst], order)


def duplicate_keys(nodes: DataFrame, key: str) -> DataFrame:
    """Keys that break uniqueness; empty for a sound table."""
    return nodes.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull())


# --- derivations ---------------------------------------------------------------


def user_nodes(reviews: DataFrame) -> DataFrame:
    """Users with their counts; rows without a user don't count."""
    return reviews.where("user_id IS NOT NULL").groupBy("user_id").agg(
        F.count("asin").alias("review_count"), F.sum(F.col("verified").cast("int")).alias("verified_count"), F.sum("helpful").alias("helpful_votes")
    )


def split_targets(reviews: DataFrame, child: str, parent: str) -> DataFrame:
    """Each review's target: its variant if child and parent differ, else the parent product (or what there is)."""
    variant = F.col(child).isNotNull() & F.col(parent).isNotNull() & (F.col(child) != F.col(parent))
    return reviews.withColumns({"target": F.when(variant, F.col(child)).otherwise(F.coalesce(parent, child)), "target_kind": F.when(variant, "variant").otherwise("parent")})


def variant_edges(products: DataFrame, child: str, parent: str) -> DataFrame:
    return products.where(F.col(child).isNotNull() & F.col(parent).isNotNull() & (F.col(child) != F.col(parent))).select(child, parent).distinct()


def category_prefixes(products: DataFrame, key: str, path: str) -> DataFrame:
    """A row for each prefix of each path: product, name, level, path, ids of itself and of its parent, and whether it is the whole path."""
    at = products.where(F.size(path) > 0).select(key, path, F.posexplode(path).alias("level", "name"))
    level, p = F.col("level"), F.col(path)
    return at.select(
        key, "name", "level", F.slice(p, F.lit(1), level + 1).alias("path"), fn.category_id(path, level + 1).alias("category_id"),
        F.when(level > 0, fn.category_id(path, level)).alias("parent_id"), (level == F.size(p) - 1).alias("primary"),
    )


def category_nodes(prefixes: DataFrame) -> DataFrame:
    return prefixes.groupBy("category_id").agg(F.max("name").alias("name"), F.max("level").alias("level"))


def subcategory_edges(prefixes: DataFrame) -> DataFrame:
    return prefixes.where("level > 0").select("category_id", "parent_id", F.col("level").alias("depth")).distinct()


def category_memberships(prefixes: DataFrame, key: str) -> DataFrame:
    return prefixes.groupBy(key, "category_id").agg(F.max("primary").alias("primary"))


def detail_attributes(items: DataFrame, key: str, details: str) -> DataFrame:
    """Attributes from a map of details; blank and missing values don't count."""
    rows = items.select(key, F.explode(details).alias("raw_key", "raw_value")).where(F.col("raw_value").isNotNull() & ~F.trim("raw_value").isin("", fn.MISSING_DETAIL))
    name, value = fn.attribute_key("raw_key"), F.trim("raw_value")
    return _attributes(rows, key, name, value, "categorical", 0.8)


def _attributes(rows: DataFrame, key: str, name: Column, value: Column, kind: str, confidence: float) -> DataFrame:
    columns = {"attribute_id": F.sha1(F.concat_ws("|", name, value)), "attribute_name": name, "attribute_value": value, "normalized_value": F.lower(value), "value_type": F.lit(kind), "confidence": F.lit(confidence)}
    return rows.select(key, *(c.alias(n) for n, c in columns.items()))


def feature_attributes(items: DataFrame, key: str, features: str) -> DataFrame:
    """Attributes from bullets like ``Color: Black``; others are features."""
    rows = items.select(key, F.explode(features).alias("f")).where(F.trim("f") != "")
    parts = F.split("f", ":", 2)
    name = F.when(F.size(parts) == 2, fn.attribute_key(parts[0])).otherwise("feature")
    value = F.trim(F.when(F.size(parts) == 2, parts[1]).otherwise(F.col("f")))
    return _attributes(rows, key, name, value, "text", 0.6)


def brand_of(brand: str | None, details: str | None) -> Column:
    """The brand's name: of the field, else of the first key of the details that has one."""
    options = [F.col(brand)] if brand else []
    options += [F.col(details)[k] for k in fn.BRAND_KEYS] if details else []
    return F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in options))


def brand_nodes(items: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """Brands, the same in any case; the first spelling stays."""
    found = items.where(F.col(name).isNotNull()).withColumn("brand_id", F.sha1(F.lower(name)))
    return first_per_key(found, ["brand_id"], [F.col(c) for c in order]).select("brand_id", F.col(name).alias("name"))


def brand_edges(items: DataFrame, key: str, brand: str | None, details: str | None, confidence: float = 0.95) -> DataFrame:
    """(key, brand_id, name, confidence) of the items that name a brand."""
    named = items.select(key, brand_of(brand, details).alias("name")).where("name IS NOT NULL")
    return named.select(key, F.sha1(F.lower("name")).alias("brand_id"), "name", F.lit(confidence).alias("confidence"))


def price_edges(items: DataFrame, key: str, price: str) -> DataFrame:
    return items.select(key, fn.bucket_id(price).alias("range_id")).where("range_id IS NOT NULL")


def price_ranges(spark) -> DataFrame:
    rows = [(fn.bucket_name(lo, hi), f"${lo}+" if hi is None else f"${lo}-${hi}", float(lo), None if hi is None else float(hi)) for lo, hi in fn.PRICE_RANGES]
    return spark.createDataFrame(rows, "range_id string, label string, lower_bound double, upper_bound double")


def copurchase_sets(baskets: DataFrame, key: str, members: str) -> DataFrame:
    """Sets of items bought with one, with their size; blank members don't count."""
    clean = baskets.select(key, F.filter(members, lambda m: m.isNotNull() & (m.cast("string") != "")).alias("members")).where("size(members) > 0")
    return clean.select(F.sha1(F.concat_ws("|", F.col(key).cast("string"), F.transform("members", lambda m: m.cast("string")))).alias("set_id"), key, "members", F.size("members").alias("size"))


def set_members(sets: DataFrame) -> DataFrame:
    return sets.select("set_id", F.posexplode("members").alias("position", "member"))


def bought_together(sets: DataFrame, key: str, compat: bool = False) -> DataFrame:
    """Pairs of an item and each member; compat: the last member only."""
    if compat:
        return sets.select(F.col(key).alias("src"), F.element_at("members", -1).alias("dst")).where("src <> dst")
    return sets.select(F.col(key).alias("src"), F.explode("members").alias("dst")).where("src <> dst")


# --- patterns and paths ---------------------------------------------------------


def same_groups(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Sources that share a target, as (member, dst, size of the group) instead of pairs, whose number is the square of a group's size."""
    members = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("member"), F.col(dst).alias("dst")).distinct()
    sizes = members.groupBy("dst").agg(F.count("*").alias("size")).where("size > 1")
    return members.join(sizes, "dst").select("member", "dst", "size")


def ancestors(edges: DataFrame, child: str, parent: str, most: int = 5) -> DataFrame:
    """(node, ancestor, hops, n_paths) for paths of 1 to ``most`` steps.

    A bounded chain of joins; counts are summed after each step, so a node that
    many paths reach is one row.
    """
    step = edges.select(F.col(child).alias("c"), F.col(parent).alias("p")).distinct()
    now = step.select(F.col("c").alias("node"), F.col("p").alias("ancestor"), F.lit(1).cast("bigint").alias("n_paths"))
    out = now.withColumn("hops", F.lit(1))
    for hop in range(2, most + 1):
        now = now.join(step, F.col("ancestor") == F.col("c")).groupBy("node", F.col("p").alias("ancestor")).agg(F.sum("n_paths").alias("n_paths"))
        out = out.unionByName(now.withColumn("hops", F.lit(hop)))
    return out.select("node", "ancestor", "hops", "n_paths")


def path_counts(edges: DataFrame, child: str, parent: str, most: int = 100) -> DataFrame:
    """(node, ancestor, hops, n_paths) for paths of any length in edges without a cycle.

    A step at a time until none is left, each written to the shared folder and
    read for the next; more than ``most`` steps are taken for a cycle and are an
    error, as then a path would need to know its edges: see ``trails``.
    """
    with Kept(edges.sparkSession) as kept:
        step = edges.select(F.col(child).alias("c"), F.col(parent).alias("p")).distinct()
        now, out = step.select(F.col("c").alias("node"), F.col("p").alias("ancestor"), F.lit(1).cast("bigint").alias("n_paths")), []
        for hop in range(1, most + 1):
            now = kept.table(now, "paths")
            if out and now.isEmpty():
                break
            out.append(now.select("node", "ancestor", F.lit(hop).alias("hops"), "n_paths"))
            now = now.join(step, F.col("ancestor") == F.col("c")).groupBy("node", F.col("p").alias("ancestor")).agg(F.sum("n_paths").alias("n_paths"))
        else:
            raise ValueError(f"paths of more than {most} steps: the edges have a cycle")
        return kept.table(reduce(DataFrame.unionByName, out), "paths", stays=True)


def trails(edges: DataFrame, src: str, dst: str, most: int | None = None, starts: DataFrame | None = None) -> DataFrame:
    """(start, end, hops, n_paths): paths of 1 to ``most`` steps (any number if None) that use no edge twice, as patterns of a variable length count them; nodes may come again.

    Parallel edges are edges each; nulls are no nodes.  starts: a table of one
    column, where paths may begin.  An edge that lies on no cycle can't come
    again, so a row carries only the edges that do: without cycles rows are sums
    over all paths between two nodes, as in ``path_counts``.  Each round joins
    what is new with the edges by node and is written to the shared folder.
    Without ``most`` it ends when no trail goes on; a dense cycle has more trails
    than can be counted so.
    """
    with Kept(edges.sparkSession) as kept:
        known = edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).where("s IS NOT NULL AND d IS NOT NULL").withColumn("e", F.monotonically_increasing_id())
        known = kept.table(known, "edges")
        again = on_cycles(known.select("s", "d"), kept)
        known = kept.table(known.join(again.withColumn("again", F.lit(True)), ["s", "d"], "left").withColumn("again", F.coalesce("again", F.lit(False))), "edges")
        held = lambda used: F.when(F.col("again"), F.array_sort(F.concat(used, F.array("e")))).otherwise(used)
        first = known if starts is None else known.join(starts.select(F.col(starts.columns[0]).alias("s")).distinct(), "s", "left_semi")
        now = first.select(F.col("s").alias("start"), F.col("d").alias("end"), held(F.array().cast("array<bigint>")).alias("used"))
        now, out, hop = now.groupBy("start", "end", "used").agg(F.count("*").alias("n_paths")), [], 1
        while True:
            now = kept.table(now, "trails")
            if out and now.isEmpty():
                break
            out.append(now.groupBy("start", "end").agg(F.sum("n_paths").alias("n_paths")).withColumn("hops", F.lit(hop)).select("start", "end", "hops", "n_paths"))
            if hop == most:
                break
            on = now.join(known, F.col("end") == F.col("s")).where(~F.array_contains("used", F.col("e")))
            now = on.select("start", F.col("d").alias("end"), held(F.col("used")).alias("used"), "n_paths").groupBy("start", "end", "used").agg(F.sum("n_paths").alias("n_paths"))
            hop += 1
        return kept.table(reduce(DataFrame.unionByName, out), "trails", stays=True)


def on_cycles(edges: DataFrame, kept: Kept, rounds: int = 3) -> DataFrame:
    """(s, d): edges, each once, that may lie on a cycle.

    Edges from nodes that none leads to, and to nodes that none leaves, lie on
    none; these are peeled off, again and again while some are found and for
    ``rounds`` at most: what stays holds all edges on cycles, and may hold more.
    """
    left = kept.table(edges.distinct(), "core")
    n = left.count()
    for _ in range(rounds):
        if not n:
            break
        ends, begins = left.select(F.col("d").alias("s")).distinct(), left.select(F.col("s").alias("d")).distinct()
        left = kept.table(left.join(ends, "s", "left_semi").join(begins, "d", "left_semi").select("s", "d"), "core")
        before, n = n, left.count()
        if n == before:
            break
    return left


def self_or_parent(edges: DataFrame, child: str, parent: str, nodes: DataFrame) -> DataFrame:
    """(node, reached) over paths of no or one step from the nodes, a table of one column."""
    own = nodes.select(F.col(nodes.columns[0]).alias("node")).where("node IS NOT NULL").distinct()
    up = edges.select(F.col(child).alias("node"), F.col(parent).alias("reached")).join(own, "node", "left_semi")
    return own.select("node", F.col("node").alias("reached")).union(up).distinct()


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(label, n) of each table."""
    out = None
    for label, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "n")
        out = one if out is None else out.union(one)
    return out


def embedded_counts(nodes: DataFrame, column: str) -> DataFrame:
    return nodes.agg(F.count_if(F.col(column).isNotNull()).alias("embedded"), F.count_if(F.col(column).isNull()).alias("missing"))


def recent(reviews: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    window = Window.partitionBy(*by).orderBy(*order)
    return reviews.withColumn("k", F.row_number().over(window)).where(F.col("k") <= n)
