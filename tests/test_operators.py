from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from brindle.functions import models
from brindle.functions import scalars as fn
from brindle.functions import texts
from brindle.operators import clean, graph, preferences, rankers, records, search, state, templates
from brindle.plans import catalog
from brindle.sources import files
from brindle.streaming import state as streams


def values(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [r[0] for r in df.select("i", f("x").alias("y")).orderBy("i").select("y").collect()]


def test_units(spark):
    given = ['14"', "15.6''", "10 x 20 x 5 inches", "16gb", "16 GB RAM", "512 SSD", "2.5 lbs", "5lbs", "max 10in box"]
    want = ["14 inch", "15.6 inch", "10 x 20 x 5 inch", "16 GB", "16 GB ram", "512 ssd", "2.5 lb", "5lbs", "ma x 10in bo x"]
    assert values(spark, given, fn.normalized_attribute) == want


def test_price_edges(spark):
    df = spark.createDataFrame([(0.0,), (49.99,), (50.0,), (1500.0,), (None,), (float("nan"),), (-1.0,)], "p double")
    assert [r[0] for r in df.select(fn.bucket_index("p")).collect()] == [1, 1, 2, 6, None, None, None]
    assert fn.bucket_name(1500, None) == "USD_1500.00_inf"


def test_category_path(spark):
    df = spark.createDataFrame([(1, ["Electronics", "Audio"]), (2, [])], "asin int, path array<string>")
    rows = graph.category_prefixes(df, "asin", "path").orderBy("level").collect()
    assert [(r.name, r.level, r.primary) for r in rows] == [("Electronics", 0, False), ("Audio", 1, True)]
    assert rows[1].category_id == "4ffa3ea2e6d25aef9b83c515bd82ccd55b28b437" and rows[1].parent_id == rows[0].category_id


def test_details_and_features(spark):
    df = spark.createDataFrame([(1, {"Color": "Black", "X": "Not Available", "Y": ""}, ["Color: Black: matte", "Waterproof", " "])], "asin int, d map<string,string>, f array<string>")
    assert [(r.attribute_name, r.normalized_value) for r in graph.detail_attributes(df, "asin", "d").collect()] == [("color", "black")]
    assert {(r.attribute_name, r.attribute_value) for r in graph.feature_attributes(df, "asin", "f").collect()} == {("color", "Black: matte"), ("feature", "Waterproof")}


def test_preferences(spark):
    rows = [("u", "a", 3, 1, 0), ("u", "b", 2, 0, 9), ("u", "c", 2, 2, 0)]
    df = spark.createDataFrame(rows, "user_id string, aspect string, positive bigint, negative bigint, neutral bigint")
    assert [(r.aspect, r.kind, r.score) for r in preferences.preferences(df).collect()] == [("a", "PREFERS", 0.75)]


def test_text(spark):
    assert values(spark, [None, "  ", "x" * 600, " ".join("ab" for _ in range(150))], texts.sanitized)[:3] == [None, None, "x" * 512]
    assert values(spark, ["Battery-Life!", "***"], fn.slugify) == ["battery_life", "unknown"]
    assert values(spark, [None, " \u00a0\u2003 ", "ok"], texts.rejection) == ["non-string text", "empty after strip", None]
    assert values(spark, ['```json\n{"a": 1, // c\n}\n```'], fn.json_cleaned)[0].replace(" ", "").replace("\n", "") == '{"a":1}'
    assert values(spark, ['so: [{"k": "v"}] done'], lambda c: fn.json_list(c, "array<struct<k:string>>")) == [[("v",)]]
    assert [r[0] for r in spark.range(1).select(fn.weighted_text(F.lit("m"), F.lit("r"))).collect()] == ["m m r"]


def test_edges_merge(spark):
    edges = spark.createDataFrame([("u", "p", 5, 1), ("u", "p", 2, 2), ("u", "gone", 4, 3)], "src string, dst string, rating int, seq int")
    nodes = lambda k: spark.createDataFrame([(k,)], "k string")
    assert [(r.dst, r.rating) for r in graph.upsert_edges(edges, nodes("u"), nodes("p"), "src", "dst", ["seq"]).collect()] == [("p", 2)]


def test_nodes_merge(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, name string, kept string")
    new = spark.createDataFrame([(2, None, 7, 1), (3, "c", 8, 1), (3, "d", 9, 2)], "id int, name string, extra int, seq int")
    rows = {r.id: tuple(r)[1:] for r in graph.upsert_nodes(old, new, "id", ["seq"]).collect()}
    assert rows == {1: ("a", "x", None), 2: (None, "y", 7), 3: ("d", None, 9)}
    assert graph.duplicate_keys(old, "id").isEmpty()


def test_copurchase(spark):
    sets = graph.copurchase_sets(spark.createDataFrame([("A", ["B", "", "C", None])], "asin string, m array<string>"), "asin", "m")
    assert [(r.position, r.member) for r in graph.set_members(sets).orderBy("position").collect()] == [(0, "B"), (1, "C")]
    assert {tuple(r) for r in graph.bought_together(sets, "asin").collect()} == {("A", "B"), ("A", "C")}
    assert {tuple(r) for r in graph.bought_together(sets, "asin", compat=True).collect()} == {("A", "C")}


def test_filters():
    assert not search.has_filters({}) and not search.has_filters({"brand": None}) and search.has_filters({"brand": ""})
    assert search.grounded({"brand": "x", "category": "y"}, lambda f, v, k: [("low", 0.1), (v.upper(), 0.7)][-k:]) == {"brand": "X", "category": None}


def test_quantified():
    got = preferences.quantified({"likes": ["a"], "constraints": {"brands": ["B"]}})
    assert got["weighted_preferences"] == {"likes": [{"value": "a", "weight": 0.8}], "dislikes": [], "constraints": {"brands": ["B"]}} and got["intent"] == "recommendation"


def test_state(spark):
    turns = spark.createDataFrame([("u", t) for t in range(30)], "u string, t int")
    assert [r.t for r in state.history(turns, "u", "t").orderBy("rank").collect()] == list(range(29, 9, -1))
    assert sorted(r.t for r in state.prompt_turns(turns, "u", "t", 5, compat=True).collect()) == [10, 11, 12, 13, 14]
    maps = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"})], "x map<string,string>, y map<string,string>")
    assert maps.select(state.merged_filters("x", "y")).first()[0] == {"a": "1", "b": "3"}


def test_files(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    good, bad = files.read_jsonl_tolerant(spark, str(p), "a int")
    assert sorted(r.a for r in good.collect()) == [1, 2] and bad.collect()[0].line == "not json"
    assert files.line_count(spark, str(p)) == 3 and files.first_lines(spark, str(p), 0.7).count() == 2
    with pytest.raises(Exception, match="(?i)malformed|corrupt|bad record|FAILFAST"):
        files.read_jsonl(spark, str(p), "a int").collect()
    with pytest.raises(ValueError, match="missing"):
        files.read_jsonl(spark, str(p), "a int", ["b"])
    df = spark.createDataFrame([("x, \"y\"\nz", 1)], "t string, n int")
    files.write_csv(df, str(tmp_path / "c"))
    assert files.read_csv(spark, str(tmp_path / "c"), "t string, n int").collect() == df.collect()
    (tmp_path / "g").write_text(" b \n\na\nb\n")
    assert [r.term for r in files.read_terms(spark, str(tmp_path / "g")).collect()] == ["a", "b"]
    assert files.statements("// c\nA b;\n\nC\nd;\n") == ["A b", "C\nd"]
    lists = spark.createDataFrame([('["a","b"]',), ('[["a"],["b"]]',), ("plain",), (None,)], "c string")
    assert [r[0] for r in lists.select(files.string_lists("c")).collect()] == [[["a", "b"]], [["a"], ["b"]], [["plain"]], []]


def test_models(spark):
    df = spark.createDataFrame([(1, "good battery", None), (2, "x", [1.0])], "id int, t string, e array<float>")
    got = {r.id: r.e for r in models.filled_embeddings(df, "t", "e").collect()}
    assert got[2] == [1.0] and abs(sum(x * x for x in got[1]) - 1) < 1e-5

    def model(texts):
        if len(texts) > 1 or len(texts[0].split()) > 1:
            raise RuntimeError
        return [[(t, "o", "Positive")] for t in texts]

    assert {r.aspect for r in models.triplets(df, "id", "t", model).collect()} == {"good", "battery", "x"}


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("u", 1, "a"), ("u", 2, "b"), ("v", 1, "c"), ("u", 3, "d")], "k string, t bigint, v string").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("k string, t bigint, v string").parquet(str(source))
    q = streams.bounded_history(stream, "k", "t", "v", 2).writeStream.outputMode("update").format("memory").queryName("histories").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.k: r.history for r in spark.table("histories").collect()} == {"u": ["d", "b"], "v": ["c"]}
    q = stream.writeStream.foreachBatch(streams.upserting(str(tmp_path / "out"), "k", ["t"])).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.k: r.v for r in streams.upserted(spark, str(tmp_path / "out")).collect()} == {"u": "d", "v": "c"}


def test_clean(spark):
    df = spark.createDataFrame([(None, "b"), ("a", "c")], "asin string, productId string")
    assert [r.item for r in clean.first_present(df, clean.ITEM_NAMES, "item").collect()] == ["b", "a"]
    with pytest.raises(ValueError):
        clean.first_present(df, clean.USER_NAMES, "user")


@pytest.mark.parametrize("block", [4096, 2])
def test_linked_whole(spark, block):
    """Every query against all rows but itself, copies and low ids among them, in one block and in several."""
    rng = random.Random(3)
    v = {i: [rng.uniform(-1, 1) for _ in range(4)] for i in range(120)}
    v[60] = v[3] = v[0]
    df = spark.createDataFrame(list(v.items()), "vec_id bigint, embedding array<double>")
    score = lambda a, b: round((1 + sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))) / 2, 6)
    want = {}
    for q in range(0, 120, 20):
        s, e = min((-score(v[q], v[i]), i) for i in v if i != q)
        want[q] = (e, -s)
    got = search.linked(df.where("vec_id % 20 = 0"), df, "vec_id", "vec_id", "embedding", apart=True, block=block)
    assert {r["query"]: (r.entity, pytest.approx(r.score)) for r in got.collect()} == want
    assert want[0][0] == 3 and want[60][0] == 0


def test_same_groups(spark):
    """Groups with membership stand for the very pairs that brute force finds, in a hot group too."""
    rng = random.Random(5)
    edges = [(i, "hot" if i < 60 else rng.choice("abcdefgh")) for i in range(100)] + [(1, "hot"), (100, "alone"), (101, None)]
    got = graph.same_groups(spark.createDataFrame(edges, "p bigint, b string"), "p", "b").collect()
    groups = {}
    for r in got:
        groups.setdefault(r.dst, []).append(r)
    assert all(len(g) == r.size for g in groups.values() for r in g)
    assert {(x.member, y.member, d) for d, g in groups.items() for x in g for y in g if x.member != y.member} == {(x, y, b) for x, b in edges for y, c in edges if b is not None and b == c and x != y}


@pytest.mark.parametrize("name", ["product_evidence", "avg_rating_soft_score", "node_upsert", "same_brand_products", "bought_together_buckets", "recent_reviews"])
def test_no_product_is_left_out(spark, name):
    """Every product that the tables speak of has a row, not only those with low ids."""
    found = catalog.QUERIES[name](spark, "/root/testdata/sf0.01")
    key = "member" if name.startswith("same") else "src" if name.startswith("bought") else "asin"
    table = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    if name.startswith("bought"):
        want = table("lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("k"), F.max("l_partkey").alias("m")).where("k < m").select("k")
    else:
        want = table("lineitem").select("l_partkey") if name.startswith("recent") else table("part").select("p_partkey")
    assert {r[0] for r in found.select(key).distinct().collect()} == {r[0] for r in want.distinct().collect()}


def test_unicode_blanks_and_texts(spark):
    assert values(spark, ["a  b\x1cc", None], texts.collapsed) == ["a b c", None]
    long = " ".join(["ab"] * 150)
    assert values(spark, ["x" * 600, long + " tail", " ".join(["a"] * 250), " ".join(["b"] * 150) + " " * 9], texts.sanitized) == ["x" * 512, (long + " tail")[:512], " ".join(["a"] * 200), " ".join(["b"] * 150)]
    assert values(spark, ["The Battery-life rocks", "Battery", "battery life", "new-Screen!"], lambda c: texts.canonical_aspect(c, ["Battery", "Battery-life", "Screen"])) == ["battery-life", "battery", "battery_life", "screen"]
    assert values(spark, ["x y"], lambda c: texts.canonical_aspect(c, [])) == ["x_y"]
    row = spark.createDataFrame([("T", ["d1", None], [], ["A", "B"], None, "S")], "t string, d array<string>, f array<string>, c array<string>, m string, s string")
    row = row.withColumn("k", F.create_map(*map(F.lit, ("Color", "red", "Other", "x", "Size", ""))))
    assert row.select(texts.metadata_text("t", "d", "f", "c", "m", "s", "k")).first()[0] == "T T d1 A B Brand: S Color: red Color: red Other: x Size: "
    assert row.select(texts.category_context_text("t", "c", F.array(F.lit(" ".join(map(str, range(12)))), F.lit(None), F.lit("")))).first()[0] == "Category: T. Context: A. Related items: 0 1 2 3 4 5 6 7 8 9."
    assert row.select(texts.category_context_text("t", F.array(F.lit("A")), F.array().cast("array<string>"))).first()[0] == "Category: T. Context: Root Category. Related items: None."
    assert row.select(texts.attribute_text(F.lit(" Bullet_Point"), F.lit('14"')), texts.attribute_text(F.lit("Size"), F.lit("16gb"))).first()[:] == ("14 inch", "Size: 16 GB")


def test_small_operators(spark):
    """Those that had no test: optional columns, numbers, mentions, price ranges, windows, batches, shapes."""
    df = spark.createDataFrame([("1.5", "NaN", "x", None)], "a string, b string, c string, d string")
    assert clean.optional_select(df, ["z", "c", "a"]).columns == ["c", "a"]
    assert df.select(*(fn.safe_float(c) for c in "abcd")).first()[:] == (1.5, None, None, None)
    m = spark.createDataFrame([(" Fit ", None, None, "POSITIVE", None, None), (" ", None, "nice", "odd", 0.5, "m"), ("", " ", None, None, None, None)], "aspect string, surface_form string, opinion string, sentiment string, confidence double, model_version string")
    assert [tuple(r) for r in preferences.cleaned_mentions(m).collect()] == [("fit", "fit", "", "Positive", 1.0, "unknown"), ("nice", "nice", "nice", "Neutral", 0.5, "m")]
    assert [r.label for r in graph.price_ranges(spark).orderBy("lower_bound").collect()] == ["$0-$50", "$50-$150", "$150-$400", "$400-$1000", "$1000-$1500", "$1500+"]
    events = spark.createDataFrame([("2024-01-01 00:01:00", "a"), ("2024-01-01 00:09:00", "a"), ("2024-01-01 00:11:00", "a")], "t string, k string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r.n for r in streams.windowed_counts(events, "t", "k").collect()) == [1, 2]
    sizes = records.in_batches(spark.range(25).coalesce(1), 10, lambda part: part.assign(id=len(part)).iloc[:1], "id bigint")
    assert sorted(r.id for r in sizes.collect()) == [5, 10, 10]
    shapes = {r.key: (r.kind, r.sizes) for r in records.key_shapes(spark.createDataFrame([([1, 2], "abc")], "l array<int>, s string")).collect()}
    assert shapes == {"l": ("array<int>", [2]), "s": ("string", [3])}
    full = records.absent_filled(spark.createDataFrame([('{"a": null}', None), ("{}", None)], "raw string, a string"), "raw", {"a": "d", "b": 0})
    assert [(r.a, r.b) for r in full.collect()] == [(None, 0), ("d", 0)]
    assert records.combined(spark.range(0).withColumn("p", F.lit(1)), spark.range(0).withColumn("p", F.lit(1)), "p") is None
    with pytest.raises(ValueError):
        graph.path_counts(spark.createDataFrame([(1, 2), (2, 1)], "c int, p int"), "c", "p", 5)


def test_stored_tables(spark, tmp_path):
    root, other = str(tmp_path / "a"), str(tmp_path / "b")
    files.store({"n": spark.range(3), "e": spark.range(2)}, root)
    assert files.registered(spark, root) == ["e", "n"] and spark.sql("SELECT count(*) FROM n").first()[0] == 3
    assert files.dump(spark, root, other) == ["e", "n"] and files.load(spark, other, "e").count() == 2
    files.clear(spark, root)
    assert files.tables(spark, root) == [] and not spark.catalog.tableExists("n")
    m, r = spark.createDataFrame([("a", "t")], "asin string, title string"), spark.createDataFrame([("a", "u")], "asin string, user_id string")
    files.write_outputs(m, r, m, other)
    schemas = {"processed_metadata": "asin string, title string", "processed_reviews": "asin string, user_id string", "combined_product_data": "asin string, title string"}
    assert files.read_outputs(spark, other, schemas, lambda a, b: a)["combined_product_data"].count() == 1
    files.write_outputs(m, r, m, str(tmp_path / "c"))
    import shutil

    shutil.rmtree(tmp_path / "c/combined_product_data")
    assert files.read_outputs(spark, str(tmp_path / "c"), schemas, lambda a, b: a.join(b, "asin"))["combined_product_data"].columns == ["asin", "title", "user_id"]
    with pytest.raises(FileNotFoundError):
        files.read_outputs(spark, str(tmp_path / "d"), schemas, lambda a, b: a)
    for k in range(4):
        (tmp_path / f"l{k}.txt").write_text("".join(f"{k}-{i}\n" for i in range(25)))
    got = [x.value for x in files.first_lines(spark, str(tmp_path / "l*.txt"), 0.4).collect()]
    assert sorted(got) == sorted([f"0-{i}" for i in range(25)] + [f"1-{i}" for i in range(15)])
    good, counts = files.load_report(spark.createDataFrame([("a",), ("",), (None,)], "asin string"), spark.range(2), ["x", "asin"])
    assert good.count() == 1 and counts.first()[:] == (1, 2, 2)


def test_upserting_keeps_what_is_there(spark, tmp_path):
    """A batch that comes again, one whose id was skipped, and a new checkpoint that starts at 0."""
    path, merge = str(tmp_path / "t"), streams.upserting(str(tmp_path / "t"), "k", ["t"], parts=4)
    for batch_id, rows in ((0, [("a", "1", 0), ("b", "2", 0)]), (5, [("b", "3", 1)]), (5, [("b", "3", 1)]), (0, [("c", "4", 2)]), (1, [])):
        merge(spark.createDataFrame(rows, "k string, v string, t int"), batch_id)
    assert {r.k: r.v for r in streams.upserted(spark, path).collect()} == {"a": "1", "b": "3", "c": "4"}


def test_rankers(spark):
    items = spark.createDataFrame([("red shoe and hat", "a"), ("the blue hat", "b"), (None, None)], "text string, kind string")
    for kind in ("hashed", "tfidf"):
        out = rankers.item_features(items, ["kind"], kind).transform(items).select("features").collect()
        assert len({len(r.features) for r in out}) == 1 and out[0].features.numNonzeros() >= 3
    ratings = spark.createDataFrame([(u, i, 1.0) for u in range(20) for i in range(20) if (u + i) % 2 == 0 and (u, i) != (0, 0)], "u int, i int, r double")
    model = rankers.ranker(ratings, "u", "i", "r", rank=4, rounds=5)
    cold = spark.createDataFrame([(7, 0.5)], "i int, score double")
    best = rankers.ranked_for(model, spark.createDataFrame([(0,), (99,)], "u int"), 10, cold).collect()
    assert {r.i for r in best if r.u == 0} == set(range(0, 20, 2)) and [(r.i, r.score) for r in best if r.u == 99] == [(7, 0.5)]
