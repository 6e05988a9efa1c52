"""Edited notices at shares from 0.8 to 1.0: how many the bands retrieve, against shares recomputed over all windows."""

from __future__ import annotations

import random

from brindle.llm import license_scan
from brindle.llm.scratch import ship


def shingles(words, k=license_scan.K):
    return [tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]


def best_share(text, template):
    """The largest share of a template's shingles that a window as long as the template holds."""
    want, there = set(shingles(license_scan.words_of(template))), shingles(license_scan.words_of(text))
    n = len(shingles(license_scan.words_of(template)))
    return max(len(want & set(there[i : i + n])) / len(want) for i in range(max(1, len(there) - n + 1)))


def test_recall_of_edited_notices(spark):
    ship(spark)
    rng, long = random.Random(23), [(k, t) for k, (_, t) in enumerate(license_scan.TEMPLATES) if len(t.split()) > 30]
    rows, want = [], set()
    for i in range(240):
        k, template = long[i % len(long)]
        words = template.split()
        for _ in range(rng.randrange(max(1, len(words) // 12) + 1)):
            at = rng.randrange(len(words))
            words[at] = f"edit{rng.randrange(99)}"
        filler = [" ".join(f"f{rng.randrange(10**5)}" for _ in range(rng.randrange(80))) for _ in range(2)]
        text = f"{filler[0]} {' '.join(words)} {filler[1]}"
        rows.append((i, text))
        if best_share(text, template) >= license_scan.SHARE:
            want.add((i, k))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = license_scan.scan(docs).collect()
    got = {(r.doc_id, r.template) for r in found}
    assert len(want) > 120 and len(want & got) >= 0.99 * len(want)
    # What is found has the share it tells, over a window a little longer than the template's.
    texts = dict(rows)
    for r in found:
        template = license_scan.TEMPLATES[r.template][1]
        all_there = set(shingles(license_scan.words_of(texts[r.doc_id])))
        whole = set(shingles(license_scan.words_of(template)))
        assert license_scan.SHARE <= r.share <= len(whole & all_there) / len(whole) + 1e-9
