"""The queries of this subpackage over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import complement_pack, dual_tree, fill_middle, label_sharding, language_id, license_scan, ngram_join, pii_bootstrap, repair_tokens, suffix_decontam, url_filter, warc_index, weak_quality
from brindle.llm.scratch import ship

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_decontam.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", *(F.col(f"__found.{c}") for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")))


def op2_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_index.roundtrip(table(spark, sf_dir, "pages"))


def op4_repair_token_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_tokens.archive(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_bootstrap.find_pii(table(spark, sf_dir, "documents"))
    counts = (pii_bootstrap.count_of(kind, "base").alias(f"n_{kind}") for kind in pii_bootstrap.KINDS)
    every = pii_bootstrap.in_order(F.concat("base", "added"))
    return found.select("doc_id", *counts, F.sha2(pii_bootstrap.as_text(F.col("base")), 256).alias("base_sha256"), pii_bootstrap.as_text(every).alias("spans"))


def op6_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = weak_quality.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(table(spark, sf_dir, "documents"), k=4, num=85, den=100)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op8_exact_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complement_pack.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_balanced_label_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = label_sharding.label_propagation(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op11_hierarchical_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = language_id.fit(docs.where(~held_out))
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op12_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dual_tree.lloyd(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op13_automaton_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha256 = lambda text: F.sha2(text, 256)
    told = (F.col(f"fim.{c}") for c in ("n", "form", "prefix_chars", "middle_chars"))
    return found.select("doc_id", *told, sha256(F.col("fim.output")).alias("output_sha256"), sha256(fill_middle.restored(F.col("fim.output"), F.col("fim.form"))).alias("restored_sha256"))


OP1_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(13, len(w)) AS l FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, l, array_to_string(w[j:j + l - 1], ' ') AS k FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS j FROM bl)),
dw AS (SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS k FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT l FROM win) WHERE len(w) >= l)),
h AS (SELECT doc_id, i, l, item_id FROM dw JOIN win USING (l, k)),
p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS q FROM (SELECT DISTINCT doc_id, i, l FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP2_SQL = r"""
WITH RECURSIVE rules(v, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
pg AS (SELECT page_id, url, html, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1) AS h0, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
u AS (SELECT page_id, url, html, path, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM pg),
fit AS (SELECT page_id, rules.v, rules.h || rules.p AS rule, row_number() OVER (PARTITION BY page_id ORDER BY length(rules.h || rules.p) DESC, length(rules.h) DESC) AS k FROM u JOIN rules ON (u.host = rules.h OR ends_with(u.host, '.' || rules.h)) AND starts_with(u.path, rules.p)),
own AS (SELECT u.page_id, u.host, u.path, fit.rule, fit.v, regexp_replace(u.url, '(?s)#.*$', '') AS node, regexp_extract(regexp_extract(u.html, '(?is)<link\b[^<>]*\brel\s*=\s*["'']?canonical\b[^<>]*>', 0), '(?is)\bhref\s*=\s*["'']?([^\s"''>]+)', 1) AS target FROM u LEFT JOIN fit ON fit.page_id = u.page_id AND fit.k = 1),
e AS (SELECT node AS a, target AS b FROM own WHERE target LIKE '%://%' AND target <> node UNION SELECT target, node FROM own WHERE target LIKE '%://%' AND target <> node),
r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT r.a AS node, min(r.b) AS component, bool_or(own.v = 'allow') AS allowed, bool_or(own.v = 'block') AS blocked FROM r LEFT JOIN own ON own.node = r.b GROUP BY r.a)
SELECT own.page_id, own.host, own.path, own.rule, coalesce(own.v, CASE WHEN c.allowed THEN 'allow' WHEN c.blocked THEN 'block' END, 'allow') AS verdict, c.component
FROM own LEFT JOIN c USING (node)
"""

OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS keeper FROM p WHERE strlen(html) >= 1000 GROUP BY html HAVING count(*) > 1)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest, CASE WHEN keeper IS NULL OR keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN g ON g.html = p.html
"""

OP7_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) m USING (doc_id)
"""


def _lloyd_sql(rounds: int = 5, k: int = 40) -> str:
    """The rounds written out one after another."""
    parts = [
        "k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v AS c FROM (SELECT sha256('2:' || vec_id) AS h, v FROM k ORDER BY h, v LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        dot = lambda a, b: f"list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, min({{'d': CAST({dot('v', 'v')} + {dot('c', 'c')} - 2 * {dot('v', 'c')} AS BIGINT), 'cluster': cluster}}) AS best FROM k CROSS JOIN c{i} GROUP BY r)")
        if i < rounds:
            parts.append(
                f"c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m, c) AS c FROM c{i} LEFT JOIN (SELECT cluster, list(m ORDER BY pos) AS m FROM (SELECT best.cluster AS cluster, pos, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m "
                f"FROM (SELECT best, unnest(v) AS x, unnest(range(64)) AS pos FROM a{i} JOIN k USING (r)) GROUP BY 1, 2) GROUP BY cluster) USING (cluster))"
            )
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, CAST(best.cluster AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN k USING (r) JOIN c{rounds} c ON c.cluster = best.cluster"
    )


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS h FROM documents),
x AS (SELECT *, len(u) AS n, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS g FROM d),
y AS (SELECT *, least(g[1] % (n + 1), g[2] % (n + 1)) AS a, greatest(g[1] % (n + 1), g[2] % (n + 1)) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR g[3] % 100 >= 100 THEN 'plain' WHEN g[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM x),
z AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM y)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM z
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_decontamination": op1_suffix_decontamination,
    "op2_redirect_equivalence": op2_redirect_equivalence,
    "op3_warc_capture_index": op3_warc_capture_index,
    "op4_repair_token_archive": op4_repair_token_archive,
    "op5_bootstrapped_pii": op5_bootstrapped_pii,
    "op6_weak_supervision": op6_weak_supervision,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_exact_complement_packing": op8_exact_complement_packing,
    "op9_balanced_label_sharding": op9_balanced_label_sharding,
    "op10_license_windows": op10_license_windows,
    "op11_hierarchical_language": op11_hierarchical_language,
    "op12_dual_tree_lloyd": op12_dual_tree_lloyd,
    "op13_automaton_fill_middle": op13_automaton_fill_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_decontamination": OP1_SQL,
    "op2_redirect_equivalence": OP2_SQL,
    "op3_warc_capture_index": OP3_SQL,
    "op7_ngram_jaccard": OP7_SQL,
    "op12_dual_tree_lloyd": _lloyd_sql(),
    "op13_automaton_fill_middle": OP13_SQL,
}
