"""Keyed tables, line numbers and counts taken while reading."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from brindle.sources import files, keyed


def plan(df):
    return df._jdf.queryExecution().toString()


def rows(spark, n, start=0):
    return spark.range(start, start + n).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"), F.col("id").alias("v"), F.lit("x").alias("w"))


def test_keyed_table(spark, tmp_path):
    t = keyed.KeyedTable(spark, str(tmp_path / "t"), "k", 8)
    with pytest.raises(FileNotFoundError):
        t.read()
    assert t.write(rows(spark, 500)) == 1 and t.read().count() == 500
    found = t.lookup(["k17"])
    (own,) = [r[0].rsplit("/", 1)[1] for r in found.select(F.input_file_name()).collect()]
    for p in (tmp_path / "t" / "v1").glob("part-*.parquet"):
        p.rename(p.with_suffix(".aside")) if p.name != own else None
    assert [r.v for r in t.lookup(["k17"]).collect()] == [17]  # the other files aren't there to be opened
    for p in (tmp_path / "t" / "v1").glob("part-*.aside"):
        p.rename(p.with_suffix(".parquet"))
    # A merge shuffles the new rows alone, once.
    new = rows(spark, 5, 498).withColumn("w", F.lit("new"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        told = plan(t.plan(new)).split("== Physical Plan ==")[1]
        assert told.count("Exchange hashpartitioning") == 1
        assert t.merge(new) == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = {r.k: (r.v, r.w) for r in t.read().collect()}
    assert len(got) == 503 and got["k498"] == (498, "new") and got["k497"] == (497, "x")
    assert len(list((tmp_path / "t" / "v2").glob("part-*.parquet"))) <= 8
    again = keyed.KeyedTable(spark.newSession(), str(tmp_path / "t"), "k", 8)
    assert again.read().count() == 503 and [r.w for r in again.lookup(["k499", "nope"]).collect()] == ["new"]
    for n in range(3):
        t.merge(rows(spark, 1, n).withColumn("w", F.lit(str(n))))
    assert t.versions() == [4, 5] and {r.k: r.w for r in t.lookup(["k0", "k1", "k2"]).collect()} == {"k0": "0", "k1": "1", "k2": "2"}


def test_keys_that_repeat_stop_a_write(spark, tmp_path):
    t = keyed.KeyedTable(spark, str(tmp_path / "t"), "k", 4)
    twice = rows(spark, 5).union(rows(spark, 2))
    with pytest.raises(keyed.NotUnique, match=r"k0 \(2 rows\), k1 \(2 rows\)"):
        t.write(twice)
    assert t.versions() == []
    with pytest.raises(keyed.NotUnique, match="None"):
        t.write(rows(spark, 2).withColumn("k", F.lit(None).cast("string")).limit(1))
    t.write(rows(spark, 5))
    with pytest.raises(keyed.NotUnique):
        t.merge(twice)
    assert t.versions() == [1]
    t.merge(rows(spark, 2).withColumn("at", F.lit(1)).union(rows(spark, 2).withColumns({"v": F.col("v") + 100, "at": F.lit(2)})), ["at"])
    assert {r.k: r.v for r in t.read().collect()} == {"k0": 100, "k1": 101, "k2": 2, "k3": 3, "k4": 4}


@pytest.mark.parametrize("most", ["100", "1000000"])
def test_line_numbers(spark, tmp_path, most):
    """Files of several splits each, of one, and an empty one: numbers go by file and line, without a global order."""
    rng, want = random.Random(1), []
    for name, n in (("b.txt", 60), ("a.txt", 97), ("c.txt", 0), ("d.txt", 1)):
        lines = [f"{name} {i} " + "x" * rng.randrange(40) for i in range(n)]
        (tmp_path / name).write_text("".join(x + "\n" for x in lines))
        want.append((name, lines))
    want = [x for _, lines in sorted(want) for x in lines]
    spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    try:
        df = files.numbered_lines(spark, str(tmp_path))
        assert (df.rdd.getNumPartitions() > 3) == (most == "100")
        assert [r.value for r in sorted(df.collect(), key=lambda r: r.n)] == want and sorted(r.n for r in df.collect()) == list(range(158))
        for part in (0.0, 0.35, 1.0):
            first = files.first_lines(spark, str(tmp_path), part)
            assert sorted(r.value for r in first.collect()) == sorted(want[: int(158 * part)])
            assert "rangepartitioning" not in plan(first) and "Limit" not in plan(first)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_counts_in_the_same_pass(spark, tmp_path):
    lines = [json.dumps({"asin": f"a{i}", "v": i}) for i in range(20)] + ["", "  ", "{broken", "[1", json.dumps({"v": 1}), json.dumps({"asin": "", "v": 2})]
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    scan = files.Scan(spark, str(tmp_path / "x.jsonl"), "asin string, v int", ["asin", "parent_asin"])
    told = plan(scan.rows).split("== Physical Plan ==")[1]
    assert told.count("Scan text") == 1 and scan.rows.columns == ["asin", "v"]
    assert sum(r.v for r in scan.rows.collect()) == sum(range(20))
    good, bad = files.read_jsonl_tolerant(spark, str(tmp_path / "x.jsonl"), "asin string, v int")
    assert scan.counts() == files.load_report(good, bad, ["asin"])[1].first().asDict() == {"kept": 20, "without_key": 2, "bad": 2}
    with pytest.raises(ValueError, match="none of"):
        files.Scan(spark, str(tmp_path / "x.jsonl"), "v int", ["asin"])
