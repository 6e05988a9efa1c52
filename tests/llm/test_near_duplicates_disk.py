"""What the n-gram join sends to its comparison in blocks."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brindle.llm import ngram_join
from brindle.llm.scratch import save, ship
from tests.llm.test_operators import edited, frame, joined


@pytest.fixture
def saved(monkeypatch):
    """Rows of each table that the join writes."""
    rows = Counter()

    def told(df, what="table", by=None):
        out = save(df, what, by)
        rows[what] += out.count()
        rows[f"{what} tables"] += 1
        return out

    monkeypatch.setattr(ngram_join, "save", told)
    return rows


def test_unrelated_texts_meet_nothing(spark, saved):
    """Texts of one size share empty fragments and a line, which says little; the copies among them are found all the same."""
    ship(spark)
    rng = random.Random(21)
    line = " ".join(f"common{j}" for j in range(12))
    rows = [(i, " ".join(f"{rng.choice('abc')}{rng.randrange(10**7)}" for _ in range(rng.randrange(650, 800))) + "\n" + line) for i in range(400)]
    rows += [(400 + i, " ".join(edited(rng, rows[i][1].split(" "), share))) for i, share in enumerate((0, 0.005, 0.01, 0.015, 0.02))]
    assert Counter(map(tuple, ngram_join.near_duplicates(frame(spark, rows)).collect())) == joined(rows, 5, 80, 100)
    assert saved["members"] < 40


def test_blocks_come_in_waves(spark, saved, monkeypatch):
    """Families of many blocks, of which the disk holds one wave at a time; no signature is left out here."""
    ship(spark)
    rng, rows = random.Random(22), []
    line = " ".join(f"common{j}" for j in range(15))
    for _ in range(4):
        original = [f"o{rng.randrange(10**6)}" for _ in range(100)]
        rows += [(len(rows) + j, " ".join(edited(rng, original, share))) for j, share in enumerate((0, 0.01, 0.02, 0.02, 0.03, 0.05))]
    rows += [(100 + j, " ".join(f"u{j}z{x}" for x in range(40)) + "\n" + line) for j in range(60)]
    for name, value in (("STARS", 1), ("BLOCK", 4), ("WAVE_BYTES", 1)):
        monkeypatch.setattr(ngram_join, name, value)
    whole = lambda groups: groups.join(groups.groupBy("set_id").agg(F.count("*").alias("degree")), "set_id").select("sig", "set_id", "degree")
    monkeypatch.setattr(ngram_join, "_needed", whole)
    assert Counter(map(tuple, ngram_join.near_duplicates(frame(spark, rows), k=4, num=85, den=100).collect())) == joined(rows, 4, 85, 100)
    assert saved["members"] > 40 and saved["survivors tables"] > 3
