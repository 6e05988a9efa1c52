"""The similarity join and the index on it against all pairs."""

from __future__ import annotations

import types

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.operators import search, similarity, vector_index
from brindle.shared import Kept, shipped

EMBEDDINGS = "/root/testdata/sf0.1/embeddings.parquet"


def all_pairs(queries, entities, k, least=None, apart=False):
    good = lambda v: v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v) and any(v)
    out = []
    for q, a in queries:
        if q is None or not good(a):
            continue
        scored = [(-round((1 + float(np.dot(a, b)) / float(np.sqrt(np.dot(a, a) * np.dot(b, b)))) / 2, 6), e) for e, b in entities if e is not None and good(b)]
        found = sorted((s, e) for s, e in scored if (least is None or -s >= least) and not (apart and e == q))[:k]
        out += [(q, e, pytest.approx(-s, abs=1.1e-6), i + 1) for i, (s, e) in enumerate(found)]
    return sorted(out, key=lambda r: (r[0], r[3]))


def clustered(n=400, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(9, 4))
    return [(i, [float(x) for x in middle[i % 9] + 0.1 * rng.normal(size=4)]) for i in range(n)]


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[3]))


@pytest.mark.parametrize(("cells", "block", "k", "least", "apart"), [(1, 256, 1, 0.55, True), (25, 7, 3, None, False), (60, 16, 12, 0.9, True), (9, 3, 1, None, False)])
def test_exact_join(spark, cells, block, k, least, apart):
    rows = clustered()
    rows += [(1000 + i, rows[0][1]) for i in range(150)] + [(2000 + i, [2 * x for x in rows[5][1]]) for i in range(5)]
    rows += [(3000, None), (3001, [0.0] * 4), (3002, [1.0] * 3), (3003, [1.0, None, 1.0, 1.0]), (3004, [float("nan")] * 4), (3005, []), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    queries = [r for r in rows if r[0] is None or r[0] % 20 == 0]
    got = similarity.top_matches(df.where("id % 20 = 0 OR id IS NULL"), df, "id", "id", "v", k, least=least, apart=apart, cells=cells, block=block)
    assert told(got) == all_pairs(queries, rows, k, least, apart)


def test_keys_of_other_kinds_and_nothing(spark):
    rows = [(f"k{i:03d}", v) for i, v in clustered(60)]
    df = spark.createDataFrame(rows, "name string, v array<float>")
    asked = spark.createDataFrame([((i, "x"), v) for i, (_, v) in enumerate(rows[:5])], "q struct<a: int, b: string>, v array<double>")
    got = similarity.top_matches(asked, df.withColumnRenamed("name", "n"), "q", "n", "v", 2, cells=4).collect()
    assert {(r["query"].a, r.entity) for r in got if r["rank"] == 1} == {(i, rows[i][0]) for i in range(5)}
    assert similarity.top_matches(asked, df.where("false"), "q", "name", "v").isEmpty()
    assert similarity.top_matches(asked.where("false"), df, "q", "name", "v", cells=4).isEmpty()


def test_cells_are_passed_over(spark):
    """Beyond the first cells only those are met that may hold something better, and none that does is passed over."""
    rows = clustered(2000)
    df = spark.createDataFrame(rows, "id bigint, vector array<double>")
    shipped(spark)
    centres = similarity.centres_of(df, 2000, 50, 4)
    with Kept(spark) as kept:
        spread = kept.table(similarity.dealt(df, centres, 4, "bigint", None), "dealt")
        known = similarity.cells_of(spread, centres)
        assert known.sizes.sum() == 2000 and len(known.sizes) == 50
        asked = df.where("id % 20 = 0").withColumn("bound", F.lit(0.999))
        met = [similarity._met(asked, known, 4, "bigint", 2, None, later).count() for later in (False, True)]
    assert met[0] == 200 and met[1] < 100 * 48 / 3


def test_repeated_vectors_are_not_multiplied(spark):
    """Of a third of equal vectors a block holds the few that may be answers."""
    rows = clustered(200) + [(500 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>").repartition(7)
    shipped(spark)
    centres = similarity.centres_of(df, len(rows), 5, 4)
    with Kept(spark) as kept:
        spread = kept.table(similarity.dealt(df, centres, 4, "bigint", 3), "dealt")
        blocks = similarity.blocks_of(spread, similarity.cells_of(spread, centres), 4, "bigint", 3, 50)
        ids = [i for r in blocks.select("ids").collect() for i in r.ids]
    assert sorted(i for i in ids if i >= 500) == [500, 501, 502] and len(ids) == 203


def test_index(spark, tmp_path):
    rows = clustered(300) + [(999, None)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    path = str(tmp_path / "i")
    assert vector_index.build(df, "id", "v", path, cells=12) and not vector_index.build(df, "id", "v", path)
    want = [(r[1], r[2]) for r in all_pairs(rows[:1], rows, 10)]
    assert [tuple(r) for r in vector_index.search(spark, path, "id", rows[0][1], 10, exact=True).collect()] == want
    assert [tuple(r) for r in vector_index.search(spark, path, "id", rows[0][1], 10, probes=12).collect()] == want
    assert told(vector_index.search_all(spark, path, df, "id", "v", 3, exact=True, apart=True)) == all_pairs(rows, rows, 3, None, True)
    with pytest.raises(ValueError, match="no vectors"):
        vector_index.build(df.where("false"), "id", "v", str(tmp_path / "none"))


def test_recall_on_embeddings(spark, tmp_path):
    """Nine tenths of the ten nearest of every row whose id 20 divides, against all rows, with the probes that the index measured."""
    df, path = spark.read.parquet(EMBEDDINGS), str(tmp_path / "i")
    vector_index.build(df, "vec_id", "embedding", path, cells=64)
    asked = df.where("vec_id % 20 = 0")
    exact = {tuple(r)[:2] for r in vector_index.search_all(spark, path, asked, "vec_id", "embedding", 10, exact=True).collect()}
    found = {tuple(r)[:2] for r in vector_index.search_all(spark, path, asked, "vec_id", "embedding", 10).collect()}
    assert len(exact) == 10 * asked.count() and len(exact & found) >= 0.9 * len(exact)


def test_items_of_users(spark):
    """Each user's best new items, an item that many users rated among the seeds; a user without new ones gets none."""
    rows = clustered(40)
    v = spark.createDataFrame(rows, "id bigint, v array<double>")
    pairs = [(u, i) for u in range(30) for i in (3, u)] + [(99, i) for i in range(40)] + [(98, 12345), (None, 3), (3, None), (3, 3)]
    got = search.similar_items(v, "id", "v", spark.createDataFrame(pairs, "u int, i bigint"), "u", "i", 3, 4)
    near = {}
    for q, e, s, _ in all_pairs(rows, rows, 3, 0.0, True):
        near.setdefault(q, []).append((e, s))
    want = []
    for u in range(30):
        mine, offered = {3, u}, {}
        for i in mine:
            for e, s in near[i]:
                if e not in mine:
                    offered[e] = max(offered.get(e, 0), s.expected)
        want += [(u, e, pytest.approx(s, abs=1.1e-6), k + 1) for k, (e, s) in enumerate(sorted(offered.items(), key=lambda x: (-x[1], x[0]))[:4])]
    assert told(got) == want


def test_batches_of_many_cells_are_bounded():
    """A thousand queries that each meet 300 cells come out in small batches, and whole."""
    n, cells, dim = 1000, 300, 64
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(cells, dim))
    centres /= np.sqrt((centres * centres).sum(1, keepdims=True))
    known = similarity.Cells(centres, np.full(cells, 2.0), np.full(cells, 1000))

    class Queries:
        sparkSession = property(lambda self: self)
        sparkContext = property(lambda self: self)
        broadcast = lambda self, value: types.SimpleNamespace(value=value)
        mapInArrow = lambda self, run, _: run

    vectors = pa.array(list(rng.normal(size=(n, dim))), pa.list_(pa.float64()))
    run = similarity._met(Queries(), known, dim, "bigint", 2, None, later=True)
    rows, most = 0, 0
    for batch in run(iter([pa.record_batch([pa.array(range(n)), vectors, pa.array(np.full(n, -1.0))], ["id", "vector", "bound"])])):
        rows, most = rows + batch.num_rows, max(most, batch.nbytes)
    assert rows == n * (cells - 2) and most < 6 << 20, (rows, most)


def test_batches_of_pairs_are_bounded(spark, monkeypatch):
    """Pairs of blocks go to Python by bytes; the session's own setting comes back."""
    name, seen, table = "spark.sql.execution.arrow.maxBytesPerBatch", {}, Kept.table
    before = spark.conf.get(name)
    monkeypatch.setattr(Kept, "table", lambda self, df, what, stays=False: (seen.update({what: spark.conf.get(name)}), table(self, df, what, stays))[1])
    rows = spark.createDataFrame(clustered(), "id int, vector array<double>")
    found = similarity.top_matches(rows, rows, "id", "id", "vector", 1, cells=6)
    assert seen["early"] == seen["matches"] == str(similarity.BATCH_BYTES) and spark.conf.get(name) == before
    assert found.count() == rows.where("id IS NOT NULL").count()
