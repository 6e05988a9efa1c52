"""Keyed state, event time and transactions over several batches and restarts, against the batch operators."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brindle.operators import state
from brindle.sources import files
from brindle.streaming import graph_store
from brindle.streaming import state as streams
from brindle.streaming.graph_store import Edges, GraphStore, Nodes

START = datetime(2024, 1, 1)


def at(minutes):
    return START + timedelta(minutes=minutes)


class Feed:
    """A folder that a stream reads a file at a time, and the rows that a query has told so far."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.runs = spark, path, schema, 0

    def add(self, *batches):
        for rows in batches:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in")

    def run(self, df, mode="update"):
        """A run over what is new, from the same checkpoint: the rows told, by batch."""
        self.runs += 1
        told = []
        q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True)
        q = q.foreachBatch(lambda batch, n: told.append([tuple(r) for r in batch.collect()])).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return told


@pytest.fixture
def feed(spark, tmp_path):
    return lambda schema: Feed(spark, str(tmp_path), schema)


def test_history_is_the_batch_operator(spark, feed):
    """Whole numbers with nulls keep their type; the state goes on after a restart."""
    f = feed("k string, o bigint, v bigint")
    rng, seen, held = random.Random(5), [], {}
    for part in range(2):
        batches = [[(rng.choice("abc"), o, rng.choice([None, o * 7])) for o in range(100 * part + 10 * b, 100 * part + 10 * b + 10)] for b in range(3)]
        f.add(*batches)
        for rows in f.run(streams.bounded_history(f.stream(), "k", "o", "v", 4)):
            held.update(dict(rows))
        seen += [r for rows in batches for r in rows]
        want = state.history(spark.createDataFrame(seen, f.schema), "k", "o", 4).orderBy("rank").collect()
        assert held == {k: [r.v for r in want if r.k == k] for k in {r.k for r in want}}


def test_history_of_null_orders(feed):
    f = feed("k int, o bigint, v double")
    f.add([(1, None, 0.5), (1, 3, None)], [(1, 1, 2.5), (None, 1, 1.0)])
    told = f.run(streams.bounded_history(f.stream(), "k", "o", "v", 2))
    assert sorted((r for rows in told for r in rows), key=str) == [(1, [None, 0.5]), (1, [None, 2.5]), (None, [1.0])]


def test_idle_keys_go(feed):
    """A key is told empty when the watermark is past its last news by more than the time allowed, and starts anew later."""
    f = feed("k string, o bigint, t timestamp, v string")
    f.add([("a", 1, at(0), "x"), ("b", 1, at(0), "y")])
    history = lambda: streams.bounded_history(f.stream().withWatermark("t", "0 minutes"), "k", "o", "v", 5, time="t", idle_ms=60_000)
    assert sorted(r for rows in f.run(history()) for r in rows) == [("a", ["x"]), ("b", ["y"])]
    f.add([("b", 2, at(0.5), "z")])
    assert ("b", ["z", "y"]) in [r for rows in f.run(history()) for r in rows]
    f.add([("c", 3, at(90), "q")], [("a", 4, at(91), "new")])
    told = [r for rows in f.run(history()) for r in rows]
    assert ("b", []) in told and ("a", ["new"]) in told and ("c", ["q"]) in told


def test_profile_is_the_batch_operator(spark, feed):
    f = feed("u int, name string, o bigint, v double")
    rng, seen, held = random.Random(6), [], {}
    for part in range(2):
        batches = [[(rng.randrange(3), rng.choice("pqr"), rng.randrange(10_000), rng.choice([None, rng.random()])) for _ in range(12)] for _ in range(2)]
        batches[0] += [(1, None, 5, 1.0), (1, "p", None, 1.0)]
        f.add(*batches)
        for rows in f.run(streams.profiles(f.stream(), "u", "name", "v", "o")):
            held.update({(u, name): v for u, name, v in rows})
        seen += [r for rows in batches for r in rows if r[1] is not None and r[2] is not None]
        last = {}
        for u, name, o, v in sorted(seen, key=lambda r: r[2]):
            last[u, name] = v
        assert held == last
        merged = state.merged_profile(spark.createDataFrame(seen, f.schema).where("v IS NOT NULL"), "u", "name", "v", ["o"])
        assert {(r.u, r.name) for r in merged.collect()} <= set(held)


def test_late_rows_are_left_out(feed):
    """The second batch moves the watermark; rows that come after the next are left out if they are later than that."""
    f = feed("k string, t timestamp")
    f.add([("a", at(1)), ("a", at(2))], [("a", at(200))], [("z", at(200))], [("a", at(3)), ("a", at(195))])
    told = [r for rows in f.run(streams.windowed_counts(f.stream(), "t", "k", "10 minutes", "20 minutes")) for r in rows]
    last = {r[0].start: r[2] for r in told if r[1] == "a"}
    assert last == {at(0): 2, at(200): 1, at(190): 1}


def test_sessions(feed):
    f = feed("k string, t timestamp")
    f.add([("a", at(0)), ("a", at(4)), ("b", at(2))], [("a", at(8)), ("a", at(100))], [("x", at(100))], [("a", at(5)), ("c", at(300))], [("d", at(600))])
    told = [(k, s.start, s.end, n) for rows in f.run(streams.session_counts(f.stream(), "t", ["k"], "5 minutes", "10 minutes"), "append") for k, s, n in rows]
    # The row of minute 5 comes after the watermark of minute 90 and is left out.
    assert sorted(told) == [("a", at(0), at(13), 3), ("a", at(100), at(105), 1), ("b", at(2), at(7), 1), ("c", at(300), at(305), 1), ("x", at(100), at(105), 1)]


def test_repeats_within_the_watermark(feed):
    f = feed("k string, t timestamp, v int")
    f.add([("a", at(0), 1), ("a", at(1), 2), ("b", at(1), 3)], [("b", at(5), 4), ("z", at(500), 5)], [("z", at(500), 8)], [("a", at(2), 6), ("a", at(501), 7)])
    told = [(k, v) for rows in f.run(streams.distinct_within(f.stream(), ["k"], "t", "30 minutes"), "append") for k, t, v in rows]
    assert sorted(k for k, _ in told) == ["a", "a", "b", "z"] and ("a", 7) in told and ("a", 6) not in told and ("b", 4) not in told


def test_span_of_event_time(feed):
    f = feed("k string, t timestamp")
    f.add([("a", at(0)), ("b", at(5)), ("c", at(11)), ("d", None)])
    told = f.run(streams.between(f.stream(), "t", str(at(0)), str(at(5))), "append")
    assert sorted(r[0] for rows in told for r in rows) == ["a", "b"]


# --- transactions --------------------------------------------------------------------


def store(spark, path, parts=4):
    return GraphStore(spark, str(path), {"user": Nodes("u", ("t",)), "item": Nodes("i", ("t",))}, {"rated": Edges(("u", "user"), ("i", "item"), ("t",))}, parts)


def batch(spark, users=(), items=(), rated=()):
    kinds = {"user": "u string, name string, t int", "item": "i int, price double, t int", "rated": "u string, i int, stars int, t int"}
    return {name: spark.createDataFrame(list(rows), kinds[name]) for name, rows in (("user", users), ("item", items), ("rated", rated)) if rows}


def told(s, table):
    df = s.read(table)
    return set() if df is None else {tuple(r) for r in df.drop("t", "__part").collect()}


def test_nodes_and_edges_at_once(spark, tmp_path):
    """An edge finds the nodes of its own batch; one without both ends is dropped; of one key the last counts; a batch that comes again changes nothing."""
    s = store(spark, tmp_path)
    assert s.commit({}) == 0 and told(s, "user") == set()
    one = batch(spark, [("a", "A", 1), ("a", "A2", 2)], [(1, 1.0, 1)], [("a", 1, 3, 1), ("a", 1, 4, 2), ("a", 9, 5, 1), ("zz", 1, 5, 1), (None, 1, 1, 1)])
    assert s.commit(one) == 1
    assert (told(s, "user"), told(s, "item"), told(s, "rated")) == ({("a", "A2")}, {(1, 1.0)}, {("a", 1, 4)})
    s.commit(one)
    assert told(s, "rated") == {("a", 1, 4)}
    s.commit(batch(spark, [("b", None, 1)], (), [("b", 1, 1, 1), ("a", 1, 2, 9)]))
    assert told(s, "user") == {("a", "A2"), ("b", None)} and told(s, "rated") == {("a", 1, 2), ("b", 1, 1)}


@pytest.mark.parametrize("broken", ["edges", "manifest"])
def test_crash_leaves_the_old_state(spark, tmp_path, monkeypatch, broken):
    s = store(spark, tmp_path)
    s.commit(batch(spark, [("a", "A", 1)], [(1, 1.0, 1)], [("a", 1, 3, 1)]))

    def fail(*_, **__):
        raise RuntimeError("crash")

    with monkeypatch.context() as m:
        if broken == "edges":
            m.setattr(GraphStore, "_known", fail)
        else:
            m.setattr(graph_store, "MANIFEST", "broken")
        with pytest.raises(Exception):  # noqa: B017
            s.commit(batch(spark, [("a", "changed", 2), ("b", "B", 2)], (), [("b", 1, 1, 2)]))
    assert (told(s, "user"), told(s, "rated"), s.version()) == ({("a", "A")}, {("a", 1, 3)}, 1)
    s.commit(batch(spark, [("b", "B", 2)]))
    assert told(s, "user") == {("a", "A"), ("b", "B")}


def test_folders_stay_bounded(spark, tmp_path):
    """A hundred commits: as many manifests as are kept, and no more folders than their parts."""
    s = store(spark, tmp_path, 2)
    for n in range(100):
        s.commit(batch(spark, [(f"u{n % 7}", str(n), n)]))
    assert s.version() == 100 and len(files.tables(spark, f"{tmp_path}/manifest")) == graph_store.KEPT
    assert len(files.tables(spark, f"{tmp_path}/data")) <= 2 * graph_store.KEPT
    assert told(s, "user") == {(f"u{n % 7}", str(n)) for n in range(93, 100)}


def test_stream_into_the_graph(spark, feed, tmp_path):
    f = feed("u string, i int, stars int, t int")
    s = store(spark, tmp_path / "graph")
    split = lambda df: {"user": df.select("u", F.upper("u").alias("name"), "t"), "item": df.select("i", F.lit(1.0).alias("price"), "t"), "rated": df}
    f.add([("a", 1, 5, 1), ("b", 1, 4, 1)], [("a", 2, 3, 2), ("a", 1, 1, 2)])
    q = f.stream().writeStream.foreachBatch(s.upserting(split)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None and told(s, "rated") == {("a", 1, 1), ("b", 1, 4), ("a", 2, 3)} and told(s, "user") == {("a", "A"), ("b", "B")}
