"""URL filters with redirect equivalence.

A page is judged by the longest rule that fits its url.  Pages without a rule
follow their aliases: urls joined by redirects or canonical links are one
component, found by distributed connected components, and a component with an
explicitly allowed member is allowed, else one with a blocked member is
blocked.  DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.components import connected_components
from brindle.llm.scratch import save

#: Up to so many rules are literals of an expression; more are joined by host.
LITERAL_RULES = 500
DEFAULT_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
_A_Z, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for a null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _A_Z, _LOW)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def with_rule(urls: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """urls with ``rule`` (like ``net/es/``, or null) and ``rule_verdict``: the longest rule that fits, of equally long ones that of the longer host.

    rules: (verdict, host, path) as a list, or as a DataFrame if there are very many.
    """
    if not isinstance(rules, DataFrame) and len(rules) > LITERAL_RULES:
        rules = urls.sparkSession.createDataFrame(rules, "verdict string, host string, path string")
    if not isinstance(rules, DataFrame):
        best = F.lit(None).cast("string")
        verdict = F.lit(None).cast("string")
        h, p = F.col(host), F.col(path)
        for v, rh, rp in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r)):
            fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
            best, verdict = F.when(fits, rh + rp).otherwise(best), F.when(fits, v).otherwise(verdict)
        return urls.withColumns({"rule": best, "rule_verdict": verdict})
    hosts = urls.select(F.col(host).alias("__host")).distinct()
    suffix = F.explode(F.expr(r"transform(sequence(1, size(split(__host, '\\.'))), i -> array_join(slice(split(__host, '\\.'), i, 1000000), '.'))"))
    listed = hosts.select("__host", suffix.alias("__suffix")).join(rules.select(F.col("host").alias("__suffix"), F.col("path").alias("p"), F.col("verdict").alias("v")), "__suffix")
    listed = listed.groupBy("__host").agg(F.collect_list(F.struct((F.length("__suffix") + F.length("p")).alias("length"), F.length("__suffix").alias("in_host"), F.col("__suffix").alias("h"), "p", "v")).alias("__rules"))
    joined = urls.join(listed, F.col(host) == F.col("__host"), "left")
    top = F.array_max(F.filter("__rules", lambda r: F.col(path).startswith(r["p"])))
    return joined.withColumn("__top", top).withColumns({"rule": F.concat(F.col("__top.h"), F.col("__top.p")), "rule_verdict": F.col("__top.v")}).drop("__host", "__rules", "__top")


def _unescaped(x: Column) -> Column:
    for a, b in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.trim(x)


def _tag_value(tag: Column, name: str) -> Column:
    pattern = rf"(?is)\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.concat(*(F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)))


def node_of(url: Column) -> Column:
    """The url as a node: without fragment, scheme and host in lower case; null stays null."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    front = F.regexp_extract(bare, r"(?s)^[^:/?#]*://[^/?#]*", 0)
    return F.concat(F.translate(front, _A_Z, _LOW), F.substr(bare, F.length(front) + 1))


def _resolved(target: Column, url: Column) -> Column:
    """A link's target against its page's url."""
    scheme = F.regexp_extract(url, r"^([^:/?#]+):", 1)
    site = F.regexp_extract(url, r"(?s)^[^:/?#]*://[^/?#]*", 0)
    folder = F.regexp_replace(path_of(url), r"(?s)[^/]*$", "")
    return (
        F.when(target == "", None)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("?"), F.concat(site, path_of(url), target))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), target))
    )


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) of canonical links and immediate redirects that the pages' markup states."""
    u, h = F.col(f"`{url}`"), F.col(f"`{html}`")
    canonical = F.regexp_extract(h, r"(?is)<link\b[^<>]*\brel\s*=\s*[\"']?canonical\b[^<>]*>", 0)
    refresh = F.regexp_extract(h, r"(?is)<meta\b[^<>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^<>]*>", 0)
    target = F.regexp_extract(_tag_value(refresh, "content"), r"(?is)\burl\s*=\s*['\"]?([^'\"]+)", 1)
    found = pages.where(u.isNotNull() & h.rlike("(?i)canonical|refresh")).select(u.alias("url"), F.explode(F.array(_unescaped(_tag_value(canonical, "href")), _unescaped(target))).alias("target"))
    return found.select(node_of(F.col("url")).alias("src"), node_of(_resolved(F.col("target"), F.col("url"))).alias("dst")).where("src <> dst")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = DEFAULT_RULES, *, redirects: DataFrame | None = None, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, component) of each row.

    A page's own rule decides; else its component, with allow before block; else
    it is allowed.  component is the least url of the aliases, null for a page
    without any.  redirects: known (src, dst) urls besides the markup's.  Null
    urls, and such without ``://``, have an empty host and path; no rule fits
    them unless it is for an empty host.  Rows are judged each for itself, so
    repeats and null ids stay; an empty table gives no rows.  No column but the
    three named is read.
    """
    base = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"))
    own = with_rule(base.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}), rules)
    edges = links(pages, url, html)
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("src")), node_of(F.col("dst"))).where("src <> dst"))
    edges = save(edges.distinct(), "aliases")
    comp = connected_components(edges, "src", "dst")
    ruled = with_rule(comp.withColumns({"host": host_of(F.col("node")), "path": path_of(F.col("node"))}), rules)
    decided = ruled.groupBy("component").agg(F.max(F.col("rule_verdict") == "allow").alias("allowed"), F.max(F.col("rule_verdict") == "block").alias("blocked"))
    passed = save(comp.join(decided, "component").select("node", "component", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("passed")), "passed")
    joined = own.withColumn("node", node_of(F.col("url"))).join(passed, "node", "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "passed", F.lit("allow")).alias("verdict"), "component")
