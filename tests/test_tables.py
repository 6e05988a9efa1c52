"""Table functions: batches, fallbacks, nulls, and the lateral join against a plain loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import tables


def picky(texts):
    """Fails on a batch with ``bad`` in it, and on any text of more than two words that holds it; of four texts it answers three."""
    if any("bad" in t.split() for t in texts) and (len(texts) > 1 or len(texts[0].split()) > 2):
        raise RuntimeError
    return [[("w", x) for x in t.split()] for t in texts][: 3 if len(texts) == 4 else None]


def test_fallbacks():
    assert tables.of_batch(picky, ["a b", "c bad d e", "f"], 10) == [[("w", "a"), ("w", "b")], [("w", "c"), ("w", "bad"), ("w", "d"), ("w", "e")], [("w", "f")]]
    assert tables.of_batch(picky, ["a", "b", "c", "d"], 4) == [[("w", x)] for x in "abcd"]

    def never(texts):
        raise RuntimeError

    assert tables.of_batch(never, ["a b c", ""], 2) == [[], []] and tables.of_batch(picky, [], 2) == []


def test_sentences():
    assert tables.sentences(["Size: big. plain\n: none. x:y", ""]) == [[("Size", "big"), ("note", "plain"), ("note", "x:y")], []]


def test_decomposed(spark):
    texts = [f"a{i} bad c. d" if i % 7 == 0 else f"x{i} y{i}" for i in range(50)] + [None, "", "one"]
    df = spark.createDataFrame([(i % 40, t) for i, t in enumerate(texts)], "k int, t string").repartition(3)
    want = sorted((i % 40, "w", x) for i, t in enumerate(texts) for x in (t or "").split())
    assert sorted(map(tuple, tables.decomposed(df, "k", "t", picky, 5).collect())) == want
    assert tables.decomposed(df.where("false"), "k", "t").isEmpty()


def test_lateral_join(spark):
    df = spark.createDataFrame([(1, "Size: big. plain"), (2, None), (3, ""), (4, "x")], "k int, t string")
    got = df.lateralJoin(tables.parts_of()(F.col("t").outer()))
    assert sorted((r.k, r.name, r.value) for r in got.collect()) == [(1, "Size", "big"), (1, "note", "plain"), (4, "note", "x")]
