"""Templates, the lines that a model reads, and its answers as rows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from brindle.operators import preferences, prompts, templates


def test_templates(spark):
    text = "MATCH $brands $limit $x1 $x"
    assert templates.bound(text, {"x": None}) == {"x": None, "limit": 10, "brands": [], "x1": []}
    shown = templates.rendered(spark, text, {"brands": ["a'b", "c"], "x": None, "x1": {"k": 1}})
    assert shown == "MATCH array('a\\'b', 'c') 10 map('k', 1) NULL"
    assert templates.rendered(spark, "nothing", {"x": 1}) == "nothing"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert templates.run(spark, "SELECT k FROM {t} WHERE array_contains($wanted, v) LIMIT $limit", {"wanted": ["b"]}, t=df).collect() == [(2,)]


def test_items(spark):
    df = spark.createDataFrame([(1, "t", "", "c", None, "9.5", "x"), (1, None, "m", "c", "b", None, "0.5")], "k int, title string, main_category string, category string, brand string, price string, score string")
    want = "Item 1:\n- Title: t\n- Category: c\n- Brand: Unknown\n- Price: $9.5\n- Rating: Unknown/5.0\n- Features: None specified\n- Match score: 0.00\n"
    want += "\nItem 2:\n- Title: Unknown\n- Category: m\n- Brand: b\n- Price: $Unknown\n- Rating: Unknown/5.0\n- Features: None specified\n- Match score: 0.50\n"
    assert prompts.item_texts(df, "k", [F.desc("title")]).collect() == [(1, want)]


def test_preferences_and_profiles(spark):
    weights = preferences.quantified({"likes": ["a"], "dislikes": ["z"]})["weighted_preferences"]
    rows = [(1, kind[:-1], "", e["value"], float(e["weight"])) for kind in ("likes", "dislikes") for e in weights[kind]] + [(1, "constraint", "price", "< 5", 0.0), (2, "like", "", "q", None), (2, "other", "", "q", 1.0)]
    got = prompts.preference_texts(spark.createDataFrame([(1,), (2,), (3,), (3,)], "u int"), spark.createDataFrame(rows, "u int, kind string, name string, value string, weight double"), "u")
    told = {r.u: r.text for r in got.collect()}
    assert told[1].splitlines()[0] == "Positive signals:" and "- a (weight=" in told[1] and told[1].endswith("\n\nConstraints:\n- price: < 5") and "\n\nNegative signals:\n- z (weight=" in told[1]
    assert told[2] == "Positive signals:\n- q (weight=0.00)" and told[3] == prompts.NO_PREFERENCES and len(told) == 3
    liked = spark.createDataFrame([(1, "color", "red"), (1, "color", "blue"), (1, "brand", "x")], "u int, name string, value string")
    seen = spark.createDataFrame([(1, str(k), k) for k in range(9)] + [(2, None, 1)], "u int, title string, at int")
    told = {r.u: r.text for r in prompts.profile_texts(liked, seen, "u", [F.desc("at")]).collect()}
    assert told[1] == "User preferences:\n- brand: x\n- color: blue, red\n\nPreviously interacted with:\n- 8\n- 7\n- 6\n- 5\n- 4"
    assert told[2] == "Previously interacted with:\n- Unknown product"


def test_turns(spark):
    df = spark.createDataFrame([(1, k, "user" if k % 2 == 0 else "assistant", None if k == 6 else f"t{k}") for k in range(7)], "c int, n int, who string, t string")
    assert prompts.turn_texts(df, "c", "n", "who", "t").first().text == "User: t2\nAssistant: t3\nUser: t4\nAssistant: t5\nUser: "


def test_answers(spark):
    args = {"likes": ["x"], "constraints": {"p": 1}, "notes": "n"}
    call = [{"name": "o", "args": {}}, {"name": "t", "args": args}]
    raws = [{"tool_calls": call, "output": "no"}, {"messages": [{"content": "no"}, {"tool_calls": call}]}, {"messages": [{"name": "t", "content": json.dumps(args)}], "content": "no"}, {"output": json.dumps(args)}, {"content": json.dumps(args)}]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(raws)] + [(10, " no json "), (11, "[1]"), (12, None), (13, "{broken"), (14, "{}")], "k int, raw string")
    rows = {r.k: r for r in prompts.preference_payloads(df.select("k", prompts.answer("raw", "t").alias("text")), "k", "text").collect()}
    for k in range(len(raws)):
        assert (rows[k].likes, rows[k].dislikes, rows[k].constraints, rows[k].intent, rows[k].notes) == (["x"], [], {"p": "1"}, "recommendation", "n")
    assert [rows[k].notes for k in (10, 11, 12, 13, 14)] == ["no json", "[1]", "", "{broken", ""] and all(rows[k].likes == [] and rows[k].constraints == {} for k in (10, 11, 12, 13, 14))
