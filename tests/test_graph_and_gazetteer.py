"""Trails in graphs with cycles, phrases of large gazetteers, mended mappings: each against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brindle.functions import texts
from brindle.operators import gazetteer, graph, records
from brindle.shared import Kept


def trails_by_hand(edges, most, starts=None):
    out, now = Counter(), [(a, b, {i}) for i, (a, b) in enumerate(edges) if a is not None and b is not None and (starts is None or a in starts)]
    hop = 1
    while now and (most is None or hop <= most):
        out.update((a, b, hop) for a, b, _ in now)
        now = [(a, d, used | {i}) for a, b, used in now for i, (s, d) in enumerate(edges) if s == b and d is not None and i not in used]
        hop += 1
    return out


GRAPHS = {
    "cycle": [(1, 2), (2, 3), (3, 1), (3, 4)],
    "loop and parallel": [(1, 1), (1, 2), (1, 2), (2, 1), (2, 5), (None, 1), (1, None)],
    "tree": [(i, i // 2) for i in range(2, 20)],
    "none": [],
    "random": [(a, b) for a, b in (random.Random(3).choices(range(7), k=2) for _ in range(12))],
}


@pytest.mark.parametrize("name", GRAPHS)
@pytest.mark.parametrize("most", [1, 4, None])
def test_trails(spark, name, most):
    if name == "random" and most is None:
        most = 6
    df = spark.createDataFrame(GRAPHS[name], "a int, b int")
    got = graph.trails(df, "a", "b", most).collect()
    assert {(r.start, r.end, r.hops): r.n_paths for r in got} == dict(trails_by_hand(GRAPHS[name], most)) and len(got) == len({r[:3] for r in got})


def test_trails_from_some(spark):
    df = spark.createDataFrame(GRAPHS["cycle"], "a int, b int")
    got = graph.trails(df, "a", "b", None, spark.createDataFrame([(2,), (9,), (None,)], "n int"))
    assert {(r.start, r.end, r.hops): r.n_paths for r in got.collect()} == dict(trails_by_hand(GRAPHS["cycle"], None, {2}))


def test_edges_on_cycles(spark):
    with Kept(spark) as kept:
        found = graph.on_cycles(spark.createDataFrame([(0, 1), (1, 2), (2, 1), (2, 3), (3, 4), (5, 5), (6, 5), (7, 8)], "s int, d int"), kept)
        assert {tuple(r) for r in found.collect()} == {(1, 2), (2, 1), (5, 5)}  # two rounds are enough here


def test_self_or_parent_of_some(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "c string, p string")
    got = graph.self_or_parent(edges, "c", "p", spark.createDataFrame([("a",), ("z",), ("a",), (None,)], "n string"))
    assert sorted(map(tuple, got.collect())) == [("a", "a"), ("a", "b"), ("z", "z")]


def test_result_items_of_empty_fields(spark):
    rows = [("", "", 0, "", ["c"], "n", "", 0.0), (None, None, None, None, [], "", "m", 7.5), ("t", "k", 5, "b", None, "n", "m", 1.0)]
    df = spark.createDataFrame(rows, "title string, main_category string, price int, brand string, categories array<string>, nt string, nc string, np double")
    df = df.withColumn("pp", F.struct(F.col("nt").alias("title"), F.col("nc").alias("main_category"), F.col("np").cast("decimal(10,2)").alias("price"), F.lit("").alias("brand")))
    got = sorted(tuple(r)[:4] for r in records.result_items(df, "pp").collect())
    assert got == [("Unknown", "m", "Unknown", "7.50"), ("n", "c", "Unknown", "0.00"), ("t", "k", "b", "5")]


def test_sanitize_is_the_functions(spark):
    given = [None, "", "  ", "a  b\n", "x" * 600, " ".join(["ab"] * 300), "w " * 250]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
    a = texts.sanitize(df, "t").select("i", "clean", "reason")
    assert a.orderBy("i").collect() == df.select("i", texts.sanitized("t").alias("clean"), texts.rejection("t").alias("reason")).orderBy("i").collect()


# --- gazetteers ----------------------------------------------------------------------


def met_by_hand(text, terms):
    """(char, term) of the longest term at each place where one stands alone."""
    word = lambda c: re.match(r"[^\W_]", c) is not None
    out = []
    for i in range(len(text)):
        if i and word(text[i - 1]):
            continue
        fits = [t for t in terms if text.startswith(t, i) and not (i + len(t) < len(text) and word(text[i + len(t)]))]
        if fits:
            out.append((i, max(fits, key=len)))
    return out


def test_phrases_by_hand(spark):
    rng = random.Random(4)
    words = ["usb", "USB", "c", "-", " ", "  ", "é1", "漢字", ".", "+", "x", "\n", "😀"]
    terms = {"".join(rng.choices(words, k=rng.randrange(1, 6))).strip() for _ in range(60)} | {"usb-c", "+x", "c."}
    terms.discard("")
    rows = [(i, "".join(rng.choices(words, k=rng.randrange(30)))) for i in range(200)] + [(500, None), (501, ""), (502, "usb-c cable usb-c. usb-cx")]
    df = spark.createDataFrame(rows, "id int, t string")
    table = spark.createDataFrame([(t,) for t in [*terms, *list(terms)[:3], None, ""]], "term string")
    token = re.compile(r"[^\W_]+|[\W_]")
    got = {}
    for r in gazetteer.starts(df, "id", "t", table).collect():
        got.setdefault(r.id, []).append((r.position, r.n, r.term))
    for i, t in rows:
        if not t:
            assert i not in got
            continue
        places = [m.start() for m in token.finditer(t)]
        assert sorted((places[p], term) for p, _, term in got.get(i, [])) == met_by_hand(t, terms)
        assert all("".join(token.findall(t)[p : p + n]) == term for p, n, term in got.get(i, []))
    first = {r.id: r.term for r in gazetteer.leftmost(df, "id", "t", table).collect()}
    assert first == {i: met_by_hand(t, terms)[0][1] for i, t in rows if t and met_by_hand(t, terms)}
    free = {}
    for r in gazetteer.apart(gazetteer.starts(df, "id", "t", table), "id").collect():
        free.setdefault(r.id, []).append((r.position, r.n))
    for i, found in got.items():
        want, at = [], 0
        for p, n, _ in sorted(found):
            if p >= at:
                want.append((p, n))
                at = p + n
        assert sorted(free[i]) == want


def test_canonical_is_the_expression(spark):
    """What one regular expression gives for a short list, and slugs without a term."""
    rows = ["The Battery-life rocks", "Battery", "battery life", "new-Screen!", "Battery-lifes", None, "  ", "***", "Screen Battery"] * 3
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, x string")
    terms = ["Battery", "Battery-life", "Screen"]
    got = gazetteer.canonical(df, "x", spark.createDataFrame([(t,) for t in terms], "term string"))
    assert got.orderBy("i").select("aspect").collect() == df.orderBy("i").select(texts.canonical_aspect("x", terms).alias("aspect")).collect()
    assert [r.aspect for r in gazetteer.canonical(df.where("i = 2"), "x", spark.createDataFrame([], "term string")).collect()] == ["battery_life"]


def test_large_gazetteer(spark):
    """120,000 terms, of which 20,000 begin with the most frequent word of the texts; a third of the texts are the same."""
    terms = spark.range(100_000).select(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" v"), (F.col("id") % 7).cast("string")).alias("term"))
    terms = terms.union(spark.range(20_000).select(F.concat(F.lit("the t"), F.col("id").cast("string")).alias("term")))
    body = F.when(F.col("id") % 3 == 0, "the the w5 v5 the t19999 end").otherwise(F.concat(F.lit("see w"), F.col("id").cast("string"), F.lit(" v"), (F.col("id") % 7).cast("string"), F.lit(", the t"), F.col("id").cast("string"), F.lit("x")))
    met = gazetteer.starts(spark.range(9_000).select("id", body.alias("t")), "id", "t", terms)
    assert met.where("id % 3 = 0").groupBy("term").count().orderBy("term").collect() == [("the t19999", 3000), ("w5 v5", 3000)]
    assert met.where("id % 3 <> 0 AND term = concat('w', id, ' v', id % 7)").count() == met.where("id % 3 <> 0").count() == 6000


def test_places_stay_with_their_texts(spark, monkeypatch):
    """No place of a text is shuffled before a term is likely there; large gazetteers go in parts, and where first tokens are too many every length is tried."""
    rng = random.Random(9)
    words = ["a", "b", "cd", "-", " ", "e", "."]
    rows = [(i, "".join(rng.choices(words, k=40))) for i in range(100)]
    terms = {"".join(rng.choices(words, k=rng.randrange(1, 6))).strip() for _ in range(40)} - {""}
    df, table = spark.createDataFrame(rows, "id int, t string"), spark.createDataFrame([(t,) for t in terms], "term string")
    token = re.compile(r"[^\W_]+|[\W_]")
    want = {(i, p, term) for i, t in rows for p, term in met_by_hand(t, terms)}
    starts_of = {i: [m.start() for m in token.finditer(t)] for i, t in rows}
    limit = "spark.sql.autoBroadcastJoinThreshold"
    held = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        for sent, hashes in ((1 << 20, 1000), (1 << 20, 7), (0, 7)):
            monkeypatch.setattr(gazetteer, "SENT_BYTES", sent)
            monkeypatch.setattr(gazetteer, "SENT_HASHES", hashes)
            met = gazetteer.starts(df, "id", "t", table)
            assert {(r.id, starts_of[r.id][r.position], r.term) for r in met.collect()} == want
            plan = met._jdf.queryExecution().sparkPlan().toString().split("\n")
            assert sum("posexplode" in x for x in plan) == -(-len(terms) // hashes)
            plan = gazetteer.starts(df, "id", "t", table)._jdf.queryExecution().executedPlan().toString().split("\n")
            for at in (k for k, x in enumerate(plan) if "posexplode" in x):
                above = [x for x in plan[:at] if "Exchange hashpartitioning" in x or "LeftSemi" in x]
                assert "BroadcastHashJoin" in above[-1]
    finally:
        spark.conf.set(limit, held)
