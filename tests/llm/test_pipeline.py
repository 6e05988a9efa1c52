"""The pipeline stage by stage on whole documents, each against brute force on what the stage before kept."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import corpus_pipeline

from brindle.llm import weak_quality
from brindle.llm.scratch import save, ship
from tests.llm.test_operators import DATA, base_spans, contaminated, ids_of, joined, windows_of


def test_stages_and_run(spark):
    ship(spark)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, out, rows = docs.columns, {}, docs.collect()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "packing"]
    kept = {r.doc_id for r in weak_quality.judge(docs).collect() if r.kept}
    for name, stage in corpus_pipeline.STAGES:
        docs = save(stage(spark, docs, DATA), name)
        before, rows = rows, docs.collect()
        out[name] = rows
        if name != "packing":
            assert docs.columns == columns
        ids = {r.doc_id for r in rows}
        if name == "quality":
            assert ids == kept
        elif name == "near_duplicates":
            assert ids == {d for d, n, c in joined([(r.doc_id, r.text) for r in before], 5, 80, 100) if c == d or not n}
        elif name == "decontamination":
            windows = windows_of([tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()])
            assert ids == {r.doc_id for r in before if not contaminated(r.text, windows)[4]}
        elif name == "pii":
            was = {r.doc_id: r.text for r in before}
            assert ids == set(was) and all(r.n_chars == len(r.text) for r in rows)
            for r in rows:
                found = base_spans(was[r.doc_id])
                assert not [x for x in base_spans(r.text) if x[0] != "card"] and (not found or r.text != was[r.doc_id])
    want, sequences = Counter(), defaultdict(list)
    for r in out["pii"]:
        x, at = ids_of("byte_bpe_50k.json", r.text, 0), 0
        for piece, n in enumerate(([len(x) % 2048] if len(x) % 2048 else []) + [2048] * (len(x) // 2048)):
            want[r.doc_id, piece, at, n, zlib.crc32(x[at : at + n].tobytes())] += 1
            at += n
    assert Counter(tuple(r)[:5] for r in out["packing"]) == want
    for r in out["packing"]:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        ends = [0, *(a + n for a, n in sorted(parts))]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048
    assert Counter(tuple(r)[:5] for r in corpus_pipeline.run(spark, DATA).collect()) == want


#: The columns of documents, and some that stages might use themselves.
CLASHES = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, hash string, n bigint, component string, set_id string, sig string, kept string, here string, base string, piece string, Start string"


def test_odd_rows_and_clashes(spark):
    """Nulls, blanks, long texts, repeats, null ids and foreign columns go through every stage, each on its own input."""
    ship(spark)
    long = " ".join(f"w{i % 4999}" for i in range(30_000))
    prose = " ".join(f"word{i} of some prose." for i in range(40))
    given = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "mail a@b.co now"), (None, "a null id here is"), (6, long), (7, long + " more"), (8, prose), (8, prose), (9, "é 漢字 😀 +49 170 1234567")]
    docs = spark.createDataFrame([(i, t, "en", None, len(t or ""), "r", "h", 7, "c", "s", "g", "k", "e", "b", "p", "x") for i, t in given], CLASHES)
    kept = dict(Counter(r.doc_id for r in weak_quality.judge(docs).collect() if r.kept))
    want = {"quality": kept, "near_duplicates": {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, None: 1, 6: 1, 8: 1, 9: 1}}
    everything = dict(Counter(i for i, _ in given))
    for name, stage in corpus_pipeline.STAGES:
        out = save(stage(spark, docs, DATA), name)
        rows = out.collect()
        if name == "packing":
            assert {r.doc_id for r in rows} == set(everything) and sum(r.length for r in rows) == sum(len(ids_of("byte_bpe_50k.json", t, 0)) for _, t in given)
            continue
        assert out.columns == docs.columns and all((r.row, r.hash, r.n, r.Start) == ("r", "h", 7, "x") for r in rows)
        got = dict(Counter(r.doc_id for r in rows))
        assert got == want.get(name, everything)
        if name == "quality":
            assert set(got) <= {6, 7, 8}  # the others have fewer than 50 words
        if name == "pii":
            told = {r.doc_id: r.text for r in rows}
            assert "a@b.co" not in told[5] and "1234567" not in told[9] and told[1] is None and told[8] == prose


def test_empty_table(spark):
    ship(spark)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert save(stage(spark, docs, DATA), name).isEmpty()
