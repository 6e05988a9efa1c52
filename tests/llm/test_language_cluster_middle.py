"""Language identification, dual-tree clustering and fill-in-middle against brute force, held-out accuracy and exact restoration."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.llm import dual_tree, fill_middle, language_id, queries
from brindle.llm.scratch import ship

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, units int, row string, machine string, fim int"


def frame(spark, rows):
    ship(spark)
    return spark.createDataFrame([(i, t, lang, 1, "r", "m", 2) for i, t, lang in rows], SCHEMA)


# --- 11 --------------------------------------------------------------------------


def invented(seed: int, n: int) -> list[tuple[int, str, str]]:
    """Texts of six languages, three of one family and two of another, from syllables that relatives mostly share."""
    rng = random.Random(seed)
    shared = {"germanic": ["ing", "ber", "sch", "ten"], "slavic": ["ski", "ova", "ice", "pro"], "only xx": ["qua", "zul"]}
    own = {"en": ["the", "wh"], "de": ["und", "ei"], "nl": ["het", "ij"], "ru": ["что", "на"], "pl": ["się", "ża"], "xx": ["mba", "ngo"]}
    rows = []
    for i in range(n):
        lang = sorted(own)[i % 6]
        syllables = shared[language_id.family_of(lang)] * 2 + own[lang]
        words = ["".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(rng.randrange(8, 60))]
        rows.append((i, " ".join(words).capitalize() + ". 12!", lang))
    return rows


def test_families():
    assert [language_id.family_of(x) for x in ("en", "en-US", "PT_br", "xx")] == ["germanic", "germanic", "romance", "only xx"]
    members, sides = language_id.machines(["de", "en", "fr", "xx"])
    assert members == {"germanic": ("de", "en"), "romance": ("fr",), "only xx": ("xx",)}
    assert set(sides) == {"family germanic", "family romance", "family only xx", "pair de en"}
    assert sides["family romance"] == (["fr"], ["de", "en", "xx"])


def test_features_by_hand():
    texts = ["Ab, ab\n\nÉ1", None, "", "7 7", "x", "long " * 3000]
    got = np.concatenate([x for _, x in language_id.features(pa.array(texts))])
    assert [at for at, _ in language_id.features(pa.array(texts * 60))][1] == language_id.ROWS
    for text, row in zip(texts, got, strict=True):
        data = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in (text or "").encode())
        data = re.sub(rb" +", b" ", b" " + data + b" ")
        want = np.zeros(language_id.FEATURES)
        for k in language_id.ORDERS:
            for i in range(len(data) - k + 1):
                h = k
                for c in data[i : i + k]:
                    h = (h * 0x01000193 & 0xFFFFFFFF) ^ c
                want[(h * 0x9E3779B1 & 0xFFFFFFFF) >> 19] += 1
        want = np.sqrt(want)
        norm = np.linalg.norm(want)
        assert np.allclose(row, want / norm if norm else want, atol=1e-6)


def test_machine_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 20)).astype(np.float32)
    y = np.sign(x @ rng.normal(size=20) + 0.3)
    w = language_id.machine(x, y, cost=100.0, epochs=200)
    assert ((x @ w[:-1] + w[-1]) * y > 0).mean() > 0.98
    assert not language_id.machine(x[:0], y[:0]).any()


def test_language_of_invented_texts(spark):
    rows = invented(1, 600)
    train, held = [r for r in rows if r[0] % 5], [r for r in rows if r[0] % 5 == 0]
    odd = [(1, None, "en"), (2, "", "de"), (3, "12 34 !?", None), (None, "the thewhing", None), (4, rows[0][1], None), (4, rows[0][1], None), (5, rows[1][1] * 2000, None), (6, "no language", None)]
    model = language_id.fit(frame(spark, train + odd))
    assert set(model.members) == {"germanic", "slavic", "only xx"} and set(model.weights) == {"family germanic", "family slavic", "family only xx", "pair de en", "pair de nl", "pair en nl", "pair pl ru"}
    got = language_id.identify(frame(spark, held), model).collect()
    truth = {i: lang for i, _, lang in held}
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in got)
    # Each prediction again by hand: the family with the largest margin, then the most votes.
    for i, text, _ in held[:40]:
        x = next(language_id.features(pa.array([text])))[1]
        margin = {f: float(x[0] @ model.weights[f"family {f}"][:-1] + model.weights[f"family {f}"][-1]) for f in model.members}
        members = model.members[max(margin, key=margin.get)]
        votes = dict.fromkeys(members, 0)
        for a in members:
            for b in members:
                if a < b:
                    w = model.weights[f"pair {a} {b}"]
                    votes[a if x[0] @ w[:-1] + w[-1] >= 0 else b] += 1
        told = next(r.lang_pred for r in got if r.doc_id == i)
        assert told in members and votes[told] == max(votes.values())
    out = sorted((str(r.doc_id), r.lang_pred, r.score) for r in language_id.identify(frame(spark, odd), model).collect())
    assert len(out) == len(odd) and [x[1:] for x in out[:3]] == [("und", 0.0)] * 3
    assert out[3] == out[4] and out[3][1] == rows[0][2] and out[5][1] == rows[1][2]


def test_language_without_or_with_one(spark):
    one = language_id.fit(frame(spark, [(1, "ab cd", "en"), (2, "ef", "en")]))
    assert language_id.identify(frame(spark, [(1, "xyz", None), (2, "9", None)]), one).collect() == [(1, "en", 1.0), (2, "und", 0.0)]
    none = language_id.fit(frame(spark, [(1, "ab", None)]))
    assert [tuple(r) for r in language_id.identify(frame(spark, [(1, "ab", "en")]), none).collect()] == [(1, "und", 0.0)]
    assert language_id.identify(frame(spark, [(1, "x", "en")]).where("false"), one).isEmpty()
    assert language_id.fit(frame(spark, [(1, "x", "en")]).where("false")).members == {}
    conflict = language_id.fit(frame(spark, [(i, "same text", lang) for i, lang in enumerate(["en", "de"] * 50)]))
    assert {r.lang_pred for r in language_id.identify(frame(spark, [(1, "same text", None)]), conflict).collect()} <= {"en", "de"}


def test_language_of_documents(spark):
    rows = queries.op11_hierarchical_language(spark, DATA).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) >= 0.95


# --- 12 --------------------------------------------------------------------------


def vectors(spark, rows, kind="float"):
    ship(spark)
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, id string, cluster string")


def lloyd_by_hand(rows, k, rounds, dim, seed=2):
    kept = []
    for i, v, *_ in rows:
        if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(256.0 * float(np.float32(x)))) for x in v]))
    key = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cents = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for j, g in groups.items():
            cents[j] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    out = [(i, near(v)) for i, v in kept]
    each = {}
    for _, (d, j) in out:
        each[j] = each.get(j, 0) + d
    return sorted((str(i), j, d, each[j], sum(each.values()), cents[j]) for i, (d, j) in out)


@pytest.mark.parametrize(("spread", "block", "leaf"), [(0.05, 40, 4), (1.0, 64, 1), (0.3, 2048, 16)])
def test_lloyd_by_hand(spark, spread, block, leaf):
    rng = np.random.default_rng(int(spread * 100))
    middle = rng.normal(size=(7, 6))
    rows = [(i, [float(np.float32(x)) for x in middle[i % 7] + spread * rng.normal(size=6)], "c", "c") for i in range(300)]
    rows += [(300 + i, rows[0][1], "c", "c") for i in range(90)] + [rows[3], rows[3], (None, rows[5][1], "c", "c"), (2, [0.0] * 6, "c", "c")]
    rows += [(900, None, "c", "c"), (901, [], "c", "c"), (902, [1.0] * 5, "c", "c"), (903, [1.0] * 5 + [None], "c", "c"), (904, [float("nan")] + [1.0] * 5, "c", "c"), (905, [float("inf")] + [1.0] * 5, "c", "c")]
    got = dual_tree.lloyd(vectors(spark, rows), k=12, dim=6, block=block, leaf=leaf).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == lloyd_by_hand(rows, 12, 5, 6)


def test_lloyd_ties_few_none(spark):
    rows = [(i, [float(i % 3), 0.0], "c", "c") for i in range(9)]
    got = dual_tree.lloyd(vectors(spark, rows), k=6, dim=2).collect()  # copies among the first centroids
    assert sorted((str(r[0]), *r[1:]) for r in got) == lloyd_by_hand(rows, 6, 5, 2)
    few = dual_tree.lloyd(vectors(spark, rows[:2]), k=40, dim=2).collect()
    assert sorted((str(r[0]), *r[1:]) for r in few) == lloyd_by_hand(rows[:2], 40, 5, 2)
    none = dual_tree.lloyd(vectors(spark, [(1, [1.0], "c", "c")]), dim=2)
    assert none.collect() == [] and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    with pytest.raises(ValueError, match="beyond"):
        dual_tree.lloyd(vectors(spark, [(1, [1e9, 0.0], "c", "c")]), dim=2)


@pytest.mark.parametrize("scale", [3, 1000, 1 << 26])
def test_cover_tree(scale):
    rng = np.random.default_rng(scale)
    points = np.unique(rng.integers(-scale, scale + 1, (400, 3)), axis=0)
    tree = dual_tree.cover_tree(points, leaf=1 if scale == 3 else 5)
    deep = len(tree.levels) - 2
    assert sorted(tree.order) == list(range(len(points))) and tree.start[-1] == len(points)
    gap = lambda a, b: float(np.sqrt(((points[a] - points[b]).astype(float) ** 2).sum()))
    below = {deep: [tree.order[a:b] for a, b in zip(tree.start[:-1], tree.start[1:], strict=True)]}
    for level in range(deep - 1, -1, -1):
        first, count = dual_tree._children(tree, level, np.arange(tree.levels[level], tree.levels[level + 1]))
        assert count.min() >= 1 and count.sum() == tree.levels[level + 2] - tree.levels[level + 1]
        below[level] = [np.concatenate(below[level + 1][f - tree.levels[level + 1] : f - tree.levels[level + 1] + n]) for f, n in zip(first, count, strict=True)]
    for level in range(deep + 1):
        centers = tree.center[tree.levels[level] : tree.levels[level + 1]]
        if level < deep:
            assert set(centers) <= set(tree.center[tree.levels[level + 1] : tree.levels[level + 2]])  # nested
        for node, center in enumerate(centers):
            assert max(gap(p, center) for p in below[level][node]) <= tree.radius[tree.levels[level] + node] + 1e-6
        apart = min((gap(a, b) for i, a in enumerate(centers) for b in centers[:i]), default=np.inf)
        covering = max(min(gap(p, c) for c in centers) for p in range(len(points)))
        assert apart >= covering - 1e-6  # separated by more than what they cover


def test_bounds_prune_and_keep(spark):
    rng = np.random.default_rng(5)
    middle = rng.integers(-5000, 5000, (8, 4))
    points = np.unique(np.concatenate([m + rng.integers(-40, 40, (100, 4)) for m in middle]), axis=0)
    tree = dual_tree.cover_tree(points)
    leaf, group = dual_tree.candidates(tree, points, dual_tree.cover_tree(middle, 1), middle)
    assert len(leaf) < 3 * (len(tree.start) - 1)  # of 8 a leaf
    cluster, distance = dual_tree.nearest(points, tree, middle)
    d = ((points[:, None] - middle[None]) ** 2).sum(2)
    assert (cluster == d.argmin(1)).all() and (distance == d.min(1)).all()


# --- 13 --------------------------------------------------------------------------

UNITS = {"lines": (fill_middle.LINES, re.compile(r"[^\n]*\n|[^\n]+")), "words": (fill_middle.WORDS, re.compile(r"[^ \t-\r]+[ \t-\r]*|[ \t-\r]+"))}


def middle_by_hand(doc_id, text, pattern, rate=100, spm=50, seed=7):
    text = text or ""
    u = pattern.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    pre, mid, suf = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(u), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(u), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(u), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def odd_texts():
    rng = random.Random(8)
    rows = [(i, "".join(rng.choices("ab é漢😀\n\n <S", k=rng.randrange(60))), "x") for i in range(150)]
    rows += [(200, None, "x"), (201, "", None), (202, "\n", "x"), (203, "\n\n\n", "x"), (204, "no end", "x"), (205, "a<P>b\nc", "x"), (206, "<S>", "x"), (207, "<\nM>\n<", "x"), (208, "a\r\nb\r\n", "x"), (None, "null\nid\n", "x")]
    rows += [(209, "é" * 255 + "\n" + "x" * 256 + "\n" + "漢\n" * 400, "x"), (209, "repeated\nrow", "x"), (209, "repeated\nrow", "x"), (210, "line of a long text\n" * 30_000, "x"), (211, "z" * 300_000, "x")]
    return rows


@pytest.mark.parametrize("units", UNITS)
@pytest.mark.parametrize(("giant", "dealt"), [(4 << 20, 1 << 18), (40, 7), (300, 256), (-1, 1000)])
def test_fill_in_middle(spark, units, giant, dealt):
    automaton, pattern = UNITS[units]
    rows = odd_texts() if dealt > 100 else odd_texts()[:-2]
    docs = frame(spark, rows)
    out = fill_middle.transform(docs, automaton=automaton, giant=giant, dealt=dealt)
    assert out.columns == docs.columns
    back = out.withColumn("back", fill_middle.restored(F.col("fim.output"), F.col("fim.form")))
    got = back.select("doc_id", "text", "fim", "back").collect()
    want = sorted(((str(i), t or "", *middle_by_hand(i, t, pattern)) for i, t, _ in rows), key=str)
    assert sorted(((str(r[0]), r[1] or "", *r[2]) for r in got), key=str) == want
    assert all(r.back == (r.text or "") for r in got)


def test_fill_in_middle_rates(spark):
    rows = odd_texts()[:150]
    got = fill_middle.transform(frame(spark, rows), rate=0.6, spm=0.2, seed=3).select("doc_id", "fim").collect()
    assert sorted((r[0], *r[1]) for r in got if r[1].form != "plain") == sorted(x for x in ((i, *middle_by_hand(i, t, UNITS["lines"][1], 60, 20, 3)) for i, t, _ in rows) if x[2] != "plain")
    assert fill_middle.transform(frame(spark, rows).where("false")).isEmpty()


def test_functions_compose():
    """A chunk's function is that of its halves, the first and then the second, wherever it is cut."""
    rng = random.Random(2)
    for automaton, pattern in UNITS.values():
        text = "".join(rng.choices("ab \n", k=999)).encode()
        whole = fill_middle.chunk_function(text, automaton)
        assert whole[1][0] == len(pattern.findall(text.decode()))
        for at in (0, 1, 255, 256, 500, 999):
            (e1, n1, c1), (e2, n2, c2) = (fill_middle.chunk_function(part, automaton) for part in (text[:at], text[at:]))
            assert ([e2[s] for s in e1], [n + n2[s] for n, s in zip(n1, e1, strict=True)], c1 + c2) == whole
