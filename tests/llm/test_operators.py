"""Each operator against a brute-force version, and its edge cases: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brindle.llm import complement_pack, components, encoder, label_sharding, license_scan, ngram_join, pii_bootstrap, repair_tokens, suffix_decontam, url_filter, warc_index, weak_quality
from brindle.llm.scratch import new_path, ship

DATA = "/root/testdata/sf0.001"
WORD, SPACED = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"), re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Columns whose names an operator might use itself.
SCHEMA = "doc_id bigint, text string, lang string, n bigint, start bigint, kind string, component string, n_words int, ids string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, 2, "k", "c", 3, "x") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    ship(spark)
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    ship(spark)
    long = " ".join(f"w{i % 7919}" for i in range(60_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "two words"), (None, "a null id here"), (6, long), (7, long + " more"), (8, "é ñ 漢字 😀 a@b.co"), (9, "A" * 50_000), (10, "a <|endoftext|> b<|startoftext|>")]


def empty(spark):
    ship(spark)
    return frame(spark, [(1, "x")]).where("false")


# --- 1 ---------------------------------------------------------------------------


def windows_of(items, n=13):
    out = defaultdict(set)
    for name, text in items:
        w = WORD.findall((text or "").translate(LOW))
        size = min(n, len(w))
        for j in range(len(w) - size + 1 if size else 0):
            out[tuple(w[j : j + size])].add(str(name))
    return out


def contaminated(text, windows):
    w, hit, items = WORD.findall((text or "").translate(LOW)), set(), set()
    for size in {len(k) for k in windows}:
        for j in range(len(w) - size + 1):
            found = windows.get(tuple(w[j : j + size]))
            if found:
                hit |= set(range(j, j + size))
                items |= found
    names = sorted(items)
    return len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block", [400, 8 << 20])
def test_decontamination(spark, documents, texts, odd, block):
    rng = random.Random(3)
    vocabulary = ["a", "b", "c", "d"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 4, 9, 13, 20])))) for i in range(4, 30)] + [(98, None), (99, "..."), (5, "again under one id")]
    rows = [(i, " ".join(rng.choices([*vocabulary, "z"], k=rng.randrange(80)))) for i in range(40)] + odd
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    windows = windows_of(items)
    got = suffix_decontam.find_contamination(frame(spark, rows), bench, block_bytes=block).select("doc_id", "__found", "n_words")
    want = Counter((i, *contaminated(t, windows)) for i, t in rows)
    assert Counter((r[0], *r[1][:5]) for r in got.collect()) == want
    kept = suffix_decontam.decontaminate(frame(spark, rows), bench)
    assert kept.columns == frame(spark, rows).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, t in rows if not contaminated(t, windows)[4])
    real = spark.read.parquet(f"{DATA}/benchmark.parquet")
    windows = windows_of([tuple(r) for r in real.select("item_id", "text").collect()])
    for r in suffix_decontam.find_contamination(documents, real).select("doc_id", "__found").collect():
        assert tuple(r[1][:5]) == contaminated(texts[r[0]], windows)
    assert suffix_decontam.find_contamination(empty(spark), bench).isEmpty()
    assert suffix_decontam.decontaminate(frame(spark, odd), bench.where("false")).count() == len(odd)


def test_longest_match(spark):
    ship(spark)
    bench = spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(30)))], "item_id int, text string")
    doc = "x y " + " ".join(f"b{i}" for i in range(5, 25)) + " z"
    found = suffix_decontam.find_contamination(frame(spark, [(1, doc)]), bench).first()["__found"]
    assert [tuple(x) for x in found.longest] == [("1", 5, 2, 20)] and (found.hit_from, found.hit_to) == ([2], [22])


# --- 2 ---------------------------------------------------------------------------


def test_url_rules_and_aliases(spark):
    link = lambda u: f'<html><link rel="canonical" href="{u}"></html>'
    rows = [
        (1, "http://a.example.com/en/x", None), (2, "HTTPS://WWW.example.com/en/?q#f", ""), (3, "http://shop.net/es/1", link("/es/1")), (4, "http://mirror.org/1", link("http://shop.net/es/1")),
        (5, "http://other.org/2", '<meta http-equiv="refresh" content="0; url=http://mirror.org/1">'), (6, "http://free.org/", "x"), (7, None, None), (8, "no scheme", link("http://shop.net/es/1")), (9, "http://example.com", "x"),
        (10, "http://c.org/", link("http://shop.net/es/7")), (11, "http://d.org/", link("http://c.org/")), (12, "http://d.org/", link("http://z.com/a")), (6, "http://free.org/", "x"),
    ]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id bigint, url string, html string, host string, verdict string")
    got = url_filter.judge(pages).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    assert {k: (r.rule, r.verdict) for k, r in by.items()} == {
        1: ("example.com/en/", "block"), 2: ("www.example.com/en/", "allow"), 3: ("net/es/", "block"), 4: (None, "block"), 5: (None, "block"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "block"), 9: (None, "allow"),
        10: (None, "allow"), 11: (None, "allow"), 12: (None, "allow"),
    }
    assert (by[2].host, by[2].path, by[7].host, by[9].path) == ("www.example.com", "/en/", "", "")
    many = url_filter.DEFAULT_RULES + [("block", f"h{i}.org", "/") for i in range(600)]
    assert {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, many).collect()} == {k: (r.rule, r.verdict) for k, r in by.items()}
    assert url_filter.judge(pages.where("false")).isEmpty()


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(200, 200 + i) for i in range(1, 50)] + [(7, 7), (1, None)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    assert {r.node: r.component for r in components.connected_components(df, "a", "b").collect()} == {x: find(x) for x in root}


# --- 3 ---------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    ship(spark)
    big = "é" * 600
    rows = [(1, "http://b.org/x", big), (2, "http://a.org/\nodd", big), (3, None, big), (4, "http://a.org/", "short"), (5, "http://a.org/", "short"), (6, "http://c.d.org:8080/p?q#f", None), (7, "x", "y" * 1000), (None, "http://n.org/", big), (8, "u", "z" * 3000), (8, "u", "z" * 3000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, id string")
    got = warc_index.roundtrip(pages).collect()
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        revisit = len(raw) >= 1000 and same and i != max(same)
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    # Repeated rows are two records under one key: a lookup of it gives both.
    assert Counter(map(tuple, got)) == Counter(want)
    assert warc_index.roundtrip(pages.where("false")).isEmpty()
    keys = [r.k for r in pages.where("page_id IN (6, 4)").orderBy("page_id").select(warc_index.url_key(F.col("url")).alias("k")).collect()]
    assert keys == ["org,a)/", "org,d,c:8080)/p?q"]


def test_capture_lookup(spark):
    ship(spark)
    pages = spark.range(5000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), (F.col("id") % 7).cast("string"), F.lit(".org/"), (F.col("id") % 50).cast("string")).alias("url"), F.lit("p").alias("html"))
    index = warc_index.build_index(warc_index.write(pages, new_path(spark, "w")), new_path(spark, "i"), block_lines=64)
    asked = spark.createDataFrame([("org,h1)/1", None), ("org,h2)/2", "2"), ("none", None)], "key string, id string")
    got = {(r.key, r.id) for r in warc_index.lookup(index, asked).collect()}
    assert got == {("org,h1)/1", str(i)) for i in range(5000) if i % 7 == 1 and i % 50 == 1} | {("org,h2)/2", "2")}


# --- 4 and 8 -----------------------------------------------------------------------


@pytest.mark.parametrize(("name", "pieces"), [("byte_bpe_50k.json", encoder.byte_level_pieces), ("word_bpe_49k.json", encoder.spaced_pieces)])
def test_encoder(texts, name, pieces):
    import pyarrow as pa

    rng = random.Random(7)
    letters = ["a", "B", "é", "ß", "'", "s", "t", " ", "  ", "\n", "\t", "1", "22", ".", "#", "漢", " ", " ", "́", "😀", "\x1c", "\x85", "<|endoftext|>", "İ", "Σ", "ﬁ", "¿", "×"]
    given = list(texts.values()) + ["".join(rng.choices(letters, k=rng.randrange(30))) for _ in range(2000)] + ["", "don't 've"]
    given += ["a <|endoftext|> b", "<|startoftext|>", "x<|endoftext|>y<|endoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "<|endoftext", "|> <|startoftext|><|endoftext|>z"]
    enc = encoder.Encoder(public_tokenizers.path(name), pieces)
    ids, off = enc(pa.array(given))
    for k, e in enumerate(Tokenizer.from_file(public_tokenizers.path(name)).encode_batch(given, add_special_tokens=False)):
        assert ids[off[k] : off[k + 1]].tolist() == e.ids, given[k]


@pytest.mark.parametrize(("name", "pieces"), [("byte_bpe_50k.json", encoder.byte_level_pieces), ("word_bpe_49k.json", encoder.spaced_pieces)])
def test_encoder_memory(name, pieces):
    """Encoding takes memory for a block and for the pieces kept, not many times the column's bytes; blocks and longer texts join without a seam."""
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(1, 9))) for _ in range(20_000)]
    given = [" ".join(rng.choices(words, k=n)) for n in [300] * 800 + [0, 150_000]]
    column, enc = pa.array(given), encoder.Encoder(public_tokenizers.path(name), pieces)
    enc(column.slice(0, 1))
    tracemalloc.start()
    short = enc(column.slice(0, 800))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 * sum(map(len, given[:800]))
    kept = sum(x.nbytes for x in vars(enc).values() if isinstance(x, np.ndarray) and len(x) < encoder.SLOTS)
    assert kept <= 2 * (1 << 20) + 8 * (1 << 16)
    ids, off = enc(column)
    assert ids[: off[800]].tolist() == short[0].tolist() and off[:801].tolist() == short[1].tolist()
    for k, e in enumerate(Tokenizer.from_file(public_tokenizers.path(name)).encode_batch(given, add_special_tokens=False)):
        assert ids[off[k] : off[k + 1]].tolist() == e.ids, k


def test_encoder_of_a_large_vocabulary(tmp_path):
    """Ids beyond 16 bits stay whole."""
    import pyarrow as pa
    from tokenizers import models, normalizers, pre_tokenizers

    vocab = {f"filler{k}": k for k in range(70_000)} | {c: 70_000 + k for k, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
    t = Tokenizer(models.BPE(vocab=vocab, merges=[]))
    t.normalizer, t.pre_tokenizer = normalizers.Lowercase(), pre_tokenizers.WhitespaceSplit()
    t.save(str(tmp_path / "t.json"))
    ids, off = encoder.Encoder(str(tmp_path / "t.json"), encoder.spaced_pieces)(pa.array(["Ab zz", "", "b"]))
    assert ids.tolist() == [70_000, 70_001, 70_025, 70_025, 70_001] and off.tolist() == [0, 4, 4, 5]


def ids_of(name, text, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_token_archive(spark, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = sorted(map(tuple, repair_tokens.archive(frame(spark, odd), path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((i for i, _ in odd), key=lambda i: (i is not None, i))
    at, want = 0, Counter()
    for i, t in odd:
        x = ids_of("word_bpe_49k.json", t, 2)
        want[i, len(x), zlib.crc32(x.tobytes())] += 1
    for r in got:
        assert r[1] == at
        at += r[2]
    assert Counter((r[0], r[2], r[3]) for r in got) == want
    assert repair_tokens.archive(empty(spark), path).isEmpty()


def test_token_archive_is_read_in_as_many_tasks_as_it_was_written(spark, documents):
    """Each task of a result makes files, for which an executor starts processes."""
    got = repair_tokens.archive(documents, public_tokenizers.path("word_bpe_49k.json"))
    assert got.rdd.getNumPartitions() == 8 and got.count() == documents.count()


def test_grammar():
    rng = np.random.default_rng(1)
    for n, kinds in ((0, 5), (1, 5), (5000, 4), (5000, 3000), (20_000, 50)):
        ids = rng.integers(0, kinds, n).astype(np.uint32)
        ends = np.append(np.sort(rng.integers(1, n + 1, 20)), n) if n > 1 else np.array([n])
        ends = np.unique(ends)
        shard = repair_tokens.Shard(repair_tokens.shard_bytes(ids, ends, 60_000))
        assert shard.ids(0, n).tolist() == ids.tolist()
        for a, b in (sorted(rng.integers(0, n + 1, 2)) for _ in range(50)):
            assert shard.ids(a, b).tolist() == ids[a:b].tolist()
        assert [shard.text(k).tolist() for k in range(len(ends))] == [x.tolist() for x in np.split(ids, ends[:-1])]


def test_grammar_is_whole():
    """No frequent pair is left while there are symbols: after more rounds than twelve, and where rounds replace little."""
    rng = np.random.default_rng(4)
    rare = np.concatenate([rng.permutation(20_000).reshape(-1, 2), np.tile([[7, 8, 9, 10, 11, 12]], (9, 1)).reshape(-1, 2)]).ravel()
    for ids in (np.tile([1, 2], 1 << 17), rare):
        rules, _, seq, ends = repair_tokens.compress(ids.astype(np.uint32), np.array([len(ids)]), 49_000)
        assert max(Counter(zip(seq[:-1].tolist(), seq[1:].tolist(), strict=True)).values(), default=0) < repair_tokens.LEAST and len(rules) < (1 << 16) - 49_000
        assert ends.tolist() == [len(seq)] and repair_tokens.expand(seq, rules, 49_000).tolist() == ids.tolist()


def test_packing(spark, odd):
    capacity, path = 64, public_tokenizers.path("byte_bpe_50k.json")
    got = complement_pack.pack(frame(spark, odd), path, capacity=capacity).collect()
    want = Counter()
    for i, t in odd:
        x, at = ids_of("byte_bpe_50k.json", t, 0), 0
        for piece, n in enumerate(([len(x) % capacity] if len(x) % capacity else []) + [capacity] * (len(x) // capacity)):
            want[i, piece, at, n, zlib.crc32(x[at : at + n].tobytes())] += 1
            at += n
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    assert complement_pack.pack(empty(spark), path).isEmpty()


def test_packing_plan():
    rng = np.random.default_rng(2)
    counts = np.bincount(rng.integers(1, 257, 20_000), minlength=257)
    plan = complement_pack.plan(counts)
    used = np.zeros_like(counts)
    for parts, times in plan:
        assert sum(parts) <= 256
        for x in parts:
            used[x] += times
    assert (used == counts).all()
    total = int((counts * np.arange(257)).sum())
    assert sum(t for _, t in plan) <= 1.005 * total / 256


# --- 5 ---------------------------------------------------------------------------

BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(digits):
    each = [int(c) for c in reversed(digits)]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(each)) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 16 <= len(d) <= 19 and luhn(d) or kind == "phone" and 8 <= len(d) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans(spark, documents, texts, odd):
    rng = random.Random(11)
    letters = ["a", "@", ".", "-", "_", "1", "25", "4", "+", "(", ")", " ", "4539578763621486", "b.co", "9.9.9.9", "😀", "é"]
    rows = [(i, "".join(rng.choices(letters, k=rng.randrange(40)))) for i in range(1000, 2500)] + [(i, t) for i, t in odd if i != 4]
    rows += [(20, "x" * 30_000 + "@"), (21, "a@" + "b." * 3000 + "c"), (22, "1 " * 3000), (23, "1." * 3001), (24, "a@b.cx_y@d.e"), (25, "001.002.0003.4")]
    got = {r.doc_id: [tuple(x) for x in r.base] for r in pii_bootstrap.find_pii(frame(spark, rows)).collect()}
    assert got == {i: base_spans(t) for i, t in rows}
    for r in pii_bootstrap.find_pii(documents).select("doc_id", "base").collect():
        assert [tuple(x) for x in r.base] == base_spans(texts[r.doc_id])
    assert pii_bootstrap.find_pii(empty(spark)).isEmpty()


def test_bootstrap_finds_unseen(spark):
    ship(spark)
    rows = [(i, f"note {i} please reach me at user{i}@mail.example.com or not") for i in range(12)]
    rows += [(100, "they said reach me at bob@localhost today"), (101, "a room at 12@34 nothing"), (102, "plain words")]
    found = {r.doc_id: r for r in pii_bootstrap.find_pii(frame(spark, rows)).collect()}
    text = rows[12][1]
    assert [tuple(x) for x in found[100].added] == [("email", text.index("bob"), text.index(" today"))]
    assert not found[101].added and not found[102].added
    masked = {r.doc_id: r.text for r in pii_bootstrap.mask(frame(spark, [*rows, (103, None)])).collect()}
    assert masked[100] == "they said reach me at <EMAIL> today" and masked[102] == "plain words" and masked[103] is None


def test_bootstrap_feeds_back(spark):
    """What one pattern finds induces the next one, over three hops; none of the later patterns has a seed."""
    ship(spark)
    rows = [(i, f"note {i} please reach me at user{i}@mail.example.com or not") for i in range(40)]
    n = 100
    for context, names in (("reach me at", "a0 b0 c0 d0"), ("or write to", "a0 b0 c0 d0 a1 b1 c1"), ("they sent from", "a1 b1 c1 a2")):
        for name in names.split():
            rows.append((n, f"now {context} {name}@localhost today"))
            n += 1
    rows += [(n, "now they sent from last@localhost today"), (n + 1, "an odd place 12@34 nothing")]
    found = {r.doc_id: [tuple(x) for x in r.added] for r in pii_bootstrap.find_pii(frame(spark, rows)).collect()}
    for i, t in rows[40:-1]:
        at = t.index(" today")
        assert found[i] == [("email", t.rindex(" ", 0, at) + 1, at)], t
    assert not found[n + 1] and not any(found[i] for i in range(40))


def test_candidates_and_contexts(spark):
    """Tokens by themselves and joined, beside base spans, with words before them that hold digits or are far from the last match."""
    ship(spark)
    rows = [(i, f"note {i} please reach me at user{i}@mail.example.com or not") for i in range(12)]
    rows += [(20 + i, f"a{i}@b.example.com in room 5 call +49 30 {7000000 + 37 * i} or not") for i in range(12)]
    rows += [(40 + i, f"at {'x' * 250} hub u{i}@mail.example.com") for i in range(12)]
    want = {
        100: ("reach me at bob@localhost 2nd floor", "email", "bob@localhost"),
        101: ("reach me at bob@localhost 9.9.9.9 4 times", "email", "bob@localhost"),
        102: ("in room 5 call 5551234567", "phone", "5551234567"),
        103: ("in room 5 call (555) 123 4567 2nd floor", "phone", "555) 123 4567"),
        104: ("in room 5 call 555 123 4567 9.9.9.9", "phone", "555 123 4567"),
        105: ("1.2.3.4 reach me at (bob@localhost)", "email", "bob@localhost"),
        106: (f"at {'x' * 250} hub bob@localhost", "email", "bob@localhost"),
    }
    rows += [(i, t) for i, (t, _, _) in want.items()]
    found = {r.doc_id: [tuple(x) for x in r.added] for r in pii_bootstrap.find_pii(frame(spark, rows)).collect()}
    assert {i: [(k, t[a:b]) for k, a, b in found[i]] for i, (t, _, _) in want.items()} == {i: [(k, x)] for i, (t, k, x) in want.items()}
    assert not any(found[i] for i in found if i < 100)


# --- 6 ---------------------------------------------------------------------------


def measured(text):
    t = text or ""
    w = SPACED.findall(t)
    seen, covered = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2)), set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if SPACED.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, documents, texts, odd):
    got = weak_quality.judge(documents).collect()
    for r in got:
        m = measured(texts[r.doc_id])
        assert tuple(r)[1:6] == m
        assert r.base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0]) and not (r.kept and r.base_failed)
    rows = [*odd, (30, "a b c a b c a b"), (31, "x\nx\n\n \nx"), (32, "a a a a"), (33, "##|| <>")]
    got = Counter((r.doc_id, *tuple(r)[1:6]) for r in weak_quality.judge(frame(spark, rows)).collect())
    assert got == Counter((i, *measured(t)) for i, t in rows)
    assert weak_quality.judge(empty(spark)).isEmpty() and weak_quality.keep_good(empty(spark)).isEmpty()
    kept = weak_quality.keep_good(documents)
    assert kept.columns == documents.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in weak_quality.judge(documents).collect() if r.kept}


def test_quality_held_out(spark):
    ship(spark)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    both = weak_quality.judge(docs).join(labels, "doc_id").where("NOT base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in both}
    assert n[1, True] >= 0.98 * (n[1, True] + n.get((1, False), 0)) and n.get((0, False), 0) >= 0.8 * (n.get((0, False), 0) + n.get((0, True), 0))


# --- 7 ---------------------------------------------------------------------------


def joined(rows, k, num, den):
    """Expected (size, component) by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = SPACED.findall((t or "").translate(LOW))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    at = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            at[x].append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in at[x] if j < i).items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((rows[i][0], len(sets[i]), least.get(find(i)) if sets[i] else rows[i][0]) for i in range(len(rows)))


def edited(rng, words, share):
    return [rng.choice("pqrstuv") + str(rng.randrange(10**6)) if rng.random() < share else w for w in words]


def test_near_duplicates(spark, odd, monkeypatch):
    ship(spark)
    rng = random.Random(13)
    rows, i = [], 100
    for size in (3, 8, 20, 60, 200, 700):
        original = [f"o{size}x{rng.randrange(10**6)}" for _ in range(size)]
        for share in (0, 0, 0.004, 0.01, 0.015, 0.02, 0.02, 0.03, 0.05):
            rows.append((i, " ".join(edited(rng, original, share))))
            i += 1
    line = " ".join(f"common{j}" for j in range(15))
    rows += [(500 + j, " ".join(f"u{j}z{x}" for x in range(40)) + "\n" + line) for j in range(60)]
    rows += odd
    got = Counter(map(tuple, ngram_join.near_duplicates(frame(spark, rows), k=4, num=85, den=100).collect()))
    assert got == joined(rows, 4, 85, 100)
    # No rounds with central sets first but one, and many small blocks.
    monkeypatch.setattr(ngram_join, "STARS", 1)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    assert Counter(map(tuple, ngram_join.near_duplicates(frame(spark, rows), k=4, num=85, den=100).collect())) == joined(rows, 4, 85, 100)
    monkeypatch.undo()
    kept = ngram_join.drop_near_duplicates(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    want = {d for (d, n, c) in joined(rows, 5, 80, 100) if c == d or not n}
    assert {r.doc_id for r in kept.collect()} == want
    assert ngram_join.near_duplicates(empty(spark)).isEmpty()


def test_drop_near_duplicates_repeats(spark):
    """Repeats without a set, repeats of a kept row, copies under one id, one id with several texts, map columns, clashing names."""
    ship(spark)
    a, b = "a b c d e f", "u v w x y z"
    rows = [(1, a, "p"), (1, a, "p"), (1, a, "q"), (2, "", "p"), (2, "", "p"), (2, None, "p"), (3, a, "p"), (1, b, "p"), (4, b, "p"), (None, b, "p"), (None, "q r s t q", "p"), (None, "q r s t q", "p")]
    df = spark.createDataFrame([(i, t, {"k": x}, x, x, 1) for i, t, x in rows], "doc_id bigint, text string, m map<string,string>, `of` string, hashed string, nth int")
    kept = ngram_join.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, a), (2, ""), (2, ""), (2, None), (1, b), (None, "q r s t q")])


# --- 9 ---------------------------------------------------------------------------


def test_sharding(spark, odd):
    rng = random.Random(17)
    rows = [(i, f"text {rng.randrange(150)}") for i in range(300)] + [(i, "hot") for i in range(300, 500)] + odd
    got = label_sharding.label_propagation(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    groups = defaultdict(list)
    for r in got:
        groups[r.group].append(r.shard)
    pairs = [len(set(v)) for v in groups.values() if 1 < len(v) < 10]
    assert sum(p == 1 for p in pairs) >= 0.6 * len(pairs)
    assert label_sharding.label_propagation(empty(spark)).isEmpty()


# --- 10 --------------------------------------------------------------------------


def test_licenses(spark, documents, texts, odd):
    rng = random.Random(19)
    filler = lambda n: " ".join(f"f{rng.randrange(10**5)}" for _ in range(n))
    rows, want = [], set()
    for k, (name, text) in enumerate(license_scan.TEMPLATES):
        for lead in (0, 1, 7, 40):
            i = 100 * k + lead
            rows.append((i, f"{filler(lead)} {text} {filler(30)}"))
            want.add((i, name, k))
        words = text.split()
        if len(words) > 30:  # a word changed: over 0.8 of the shingles stay
            words[len(words) // 2] = "changed"
            rows.append((100 * k + 50, " ".join(words)))
            want.add((100 * k + 50, name, k))
    got = {(r.doc_id, r.license, r.template) for r in license_scan.scan(frame(spark, [*rows, *odd])).collect()}
    assert want <= got and {i for i, _, _ in got} == {i for i, _, _ in want}
    exact = {(d, k) for d, t in texts.items() for k, (_, x) in enumerate(license_scan.TEMPLATES) if " ".join(license_scan.words_of(x)) in " ".join(license_scan.words_of(t or ""))}
    assert exact <= {(r.doc_id, r.template) for r in license_scan.scan(documents).collect()}
    assert license_scan.scan(empty(spark)).isEmpty() and license_scan.scan(frame(spark, rows), ()).isEmpty()


def test_label_model_against_brute_force(spark):
    """Expectation-maximisation over the documents one by one, not over counts of combinations, gives the same posteriors."""
    ship(spark)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = weak_quality.measures(docs.select("doc_id", "text")).select("doc_id", *(v.alias(f"v{k}") for k, v in enumerate(weak_quality.votes()))).collect()
    votes = np.array([tuple(r)[1:] for r in rows])
    hits, alarms, prior, weight = 0.4, 0.02, 0.8, 20
    rates, last = np.tile([hits, alarms], (votes.shape[1], 1)), None
    for _ in range(200):
        odds = np.full(len(votes), math.log(prior / (1 - prior)))
        for k, (a, b) in enumerate(rates):
            odds += np.where(votes[:, k] == 0, math.log(b / a), np.where(votes[:, k] == 1, math.log((1 - b) / (1 - a)), 0))
        good = 1 / (1 + np.exp(-odds))
        if last is not None and np.abs(good - last).max() < 1e-6:
            break
        last, prior = good, (good.sum() + 0.8 * weight) / (len(votes) + weight)
        for k in range(votes.shape[1]):
            bad, voted = votes[:, k] == 0, votes[:, k] < 2
            top = np.array([((1 - good) * bad).sum() + hits * weight, (good * bad).sum() + alarms * weight])
            base = np.array([((1 - good) * voted).sum() + weight, (good * voted).sum() + weight])
            rates[k] = top / base if top[0] / base[0] >= top[1] / base[1] else top.sum() / base.sum()
    got = {r.doc_id: r.posterior for r in weak_quality.judge(docs).collect()}
    assert all(abs(got[r.doc_id] - p) < 1e-4 for r, p in zip(rows, good, strict=True))


def test_cut_edges(spark):
    ship(spark)
    rng = random.Random(23)
    placed = [(rng.choice("abc"), rng.randrange(3)) for _ in range(60)] + [("alone", 1)]
    pairs = [x[1] != y[1] for i, x in enumerate(placed) for y in placed[:i] if x[0] == y[0]]
    got = label_sharding.cut_edges(spark.createDataFrame(placed, "`group` string, shard int")).first()
    assert (got.pairs, got.cut) == (len(pairs), sum(pairs))


def test_redirects_by_random_aliases(spark):
    """Verdicts of a random alias graph, known redirects and canonical links mixed, against a union of sets."""
    ship(spark)
    rng = random.Random(29)
    urls = [f"http://{h}/{i}" for i, h in enumerate(rng.choices(["a.org", "b.net/es", "x.com", "c.net/fr", "d.io"], k=80))]
    edges = [(rng.choice(urls), rng.choice(urls)) for _ in range(45)]
    root = {u: u for u in urls}

    def find(u):
        while root[u] != u:
            u = root[u]
        return u

    for a, b in edges:
        root[find(a)] = find(b)
    own = lambda u: "allow" if ".com/" in u else "block" if ".net/es/" in u or ".net/fr/" in u else None
    groups = defaultdict(set)
    for u in urls:
        groups[find(u)].add(own(u))
    linked = {u for e in edges for u in e if e[0] != e[1]}
    want = {u: own(u) or (("allow" if "allow" in groups[find(u)] else "block" if "block" in groups[find(u)] else "allow") if u in linked else "allow") for u in urls}
    html = defaultdict(lambda: None, {a: f'<link rel="canonical" href="{b}">' for a, b in edges[:20]})
    known = [(a, b) for a, b in edges if html[a] != f'<link rel="canonical" href="{b}">']
    pages = spark.createDataFrame([(i, u, html[u]) for i, u in enumerate(urls)], "page_id int, url string, html string")
    got = url_filter.judge(pages, redirects=spark.createDataFrame(known, "src string, dst string")).collect()
    assert {urls[r.page_id]: r.verdict for r in got} == want
