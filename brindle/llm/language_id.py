"""Language identification in two steps: the family first, then the language within it.

A text is the square roots of the shares of its byte n-grams, hashed.  A linear
support vector machine for each family against all others picks the family; one
for each two languages of a family vote on the language.  Machines are fitted
side by side, a task each, on a bounded sample of the different labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm import textbytes as tb
from brindle.llm.scratch import save

#: Languages of each family.  Others are families by themselves.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "semitic": ("ar", "he", "mt"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "austronesian": ("id", "jv", "mg", "ms", "tl"),
}
UNKNOWN = "und"
#: Different texts of a language in the sample, and on each side of a machine, about; n-gram lengths; hashed features.
PER_LANGUAGE, PER_SIDE, ORDERS, FEATURES = 1000, 2000, (2, 3, 4), 1 << 13
#: Texts looked at together: bytes, and rows.
SLICE, ROWS = 2 << 20, 128
COST, EPOCHS = 10.0, 20

#: Letters of ASCII in lower case, bytes beyond ASCII as they are, all else a blank.
_FOLDED = np.where(np.arange(256) >= 128, np.arange(256), 32).astype(np.uint8)
_FOLDED[65:91] = _FOLDED[97:123] = np.arange(97, 123)


def family_of(language: str, families: dict[str, tuple[str, ...]] = FAMILIES) -> str:
    """The family of a language code, of which only what stands before a dash or underscore counts."""
    code = language.lower().replace("_", "-").split("-")[0]
    return next((name for name, members in families.items() if code in members), f"only {language}")


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of features in runs of at most ROWS texts, each after its first row's number: unit vectors, zero for a text without letters.

    Runs of blanks are one, and a text has one at either end.
    """
    data, off = tb.text_bytes(column)
    n = len(off) - 1
    at = 0
    while at < n:
        to = at + 1
        while to < min(n, at + ROWS) and off[to + 1] - off[at] <= SLICE:
            to += 1
        sizes = off[at + 1 : to + 1] - off[at:to]
        # Each text with a blank before and after.
        folded = np.full(int(sizes.sum()) + 2 * (to - at), 32, np.uint8)
        shift = 2 * np.arange(to - at) + 1
        folded[np.arange(int(sizes.sum())) + np.repeat(shift, sizes)] = _FOLDED[data[off[at] : off[to]]]
        of = np.repeat(np.arange(to - at), sizes + 2)
        keep = np.ones(len(folded), bool)
        keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32) | (of[1:] != of[:-1])
        folded, of = folded[keep].astype(np.uint32), of[keep]
        total = np.zeros((to - at) * FEATURES, np.int64)
        for k in ORDERS:
            if len(folded) < k:
                continue
            gram = np.full(len(folded) - k + 1, k, np.uint32)
            for j in range(k):
                gram = gram * np.uint32(0x01000193) ^ folded[j : len(folded) - k + 1 + j]
            gram = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - FEATURES.bit_length() + 1)
            same = of[: len(gram)] == of[k - 1 :]
            total += np.bincount(of[: len(gram)][same] * FEATURES + gram[same], minlength=len(total))
        x = np.sqrt(total.reshape(to - at, FEATURES).astype(np.float32))
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        yield at, x / np.maximum(norm, 1e-9)
        at = to


def machine(x: np.ndarray, y: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> np.ndarray:
    """A linear support vector machine by dual coordinate descent (Hsieh et al., 2008): weights, and a bias behind them.

    Both sides weigh the same, whatever their sizes.
    """
    n = len(x)
    most = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum()))) * cost
    w, a, q = np.zeros(x.shape[1], np.float64), np.zeros(n), (x * x).sum(1) + 1.0
    bias, rng = 0.0, np.random.default_rng(1)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(n):
            new = min(max(a[i] - (y[i] * (x[i] @ w + bias) - 1) / q[i], 0.0), most[i])
            if (by := new - a[i]) != 0.0:
                w += by * y[i] * x[i]
                bias += by * y[i]
                a[i], moved = new, max(moved, abs(by))
        if moved < 1e-3:
            break
    return np.append(w, bias).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """Families and their languages; weights of a machine for each family (none if there is one) and for each pair (name of the pair)."""

    members: dict[str, tuple[str, ...]]
    weights: dict[str, np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and certainty of each row of features.

        The certainty is the family's share of the softmax of doubled margins
        times the mean, over the language's pairs, of the logistic of the same.
        """
        families = sorted(self.members)
        margin = np.stack([self._margin(x, f"family {f}") for f in families], 1) if len(families) > 1 else np.zeros((len(x), 1))
        share = np.exp(2 * (margin - margin.max(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        best = margin.argmax(1)
        language, sure = np.empty(len(x), object), share[np.arange(len(x)), best]
        for k, f in enumerate(families):
            rows, names = np.flatnonzero(best == k), self.members[f]
            if len(names) == 1 or not len(rows):
                language[rows] = names[0]
                continue
            won, told = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names)))
            for (i, a), (j, b) in combinations(enumerate(names), 2):
                m = self._margin(x[rows], f"pair {a} {b}")
                won[:, i] += m >= 0
                won[:, j] += m < 0
                told[:, i] += 1 / (1 + np.exp(-2 * m))
                told[:, j] += 1 / (1 + np.exp(2 * m))
            told /= len(names) - 1
            first = (won + 0.5 * told).argmax(1)
            language[rows] = np.array(names, object)[first]
            sure[rows] *= told[np.arange(len(rows)), first]
        return language.tolist(), sure

    def _margin(self, x: np.ndarray, name: str) -> np.ndarray:
        w = self.weights[name]
        return x @ w[:-1] + w[-1]


def machines(languages: list[str], families: dict[str, tuple[str, ...]] = FAMILIES) -> tuple[dict[str, tuple[str, ...]], dict[str, tuple[list[str], list[str]]]]:
    """The languages of each family, and each machine's languages for and against."""
    members: dict[str, list[str]] = {}
    for x in sorted(languages):
        members.setdefault(family_of(x, families), []).append(x)
    sides = {f"family {f}": (m, [x for g, o in members.items() if g != f for x in o]) for f, m in members.items() if len(members) > 1}
    sides |= {f"pair {a} {b}": ([a], [b]) for m in members.values() for a, b in combinations(m, 2)}
    return {f: tuple(m) for f, m in members.items()}, sides


def _share(by: Column, seed: str, part: Column) -> Column:
    """Whether a hash falls into the part of all."""
    return F.pmod(F.xxhash64(by, F.lit(seed)), F.lit(1 << 30)) < part * float(1 << 30)


def fit(labelled: DataFrame, *, text: str = "text", lang: str = "lang", families: dict[str, tuple[str, ...]] = FAMILIES, per_language: int = PER_LANGUAGE, per_side: int = PER_SIDE) -> Model:
    """A model of the languages of labelled texts.

    All texts are counted; of the different ones of a language about
    ``per_language``, as a hash of the text says, are the sample, and about
    ``per_side`` of these stand on each side of a machine.  Rows without a
    language or a letter teach nothing.  Languages are taken to be some hundreds
    at most: the driver holds their counts and the machines, of 32 KB each.
    """
    t, l = F.col(f"`{text}`").cast("string"), F.col(f"`{lang}`").cast("string")
    rows = labelled.select(l.alias("lang"), t.alias("text"), F.xxhash64(t).alias("by")).where(F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    counts = {r["lang"]: r["count"] for r in rows.select("lang", "by").distinct().groupBy("lang").count().collect()}
    members, sides = machines(sorted(counts), families)
    if not sides:
        return Model(members, {})
    part = F.lit(0.0)
    for name, n in counts.items():
        part = F.when(F.col("lang") == name, F.lit(per_language / n)).otherwise(part)
    sample = rows.where(_share(F.col("by"), "sample", part)).groupBy("lang", "by").agg(F.first("text").alias("text"))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in features(batch.column("text")):
                of, index = np.nonzero(x)
                off = pa.array(np.searchsorted(of, np.arange(len(x) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(off, pa.array(v)) for v in (index.astype(np.int32), x[of, index])]
                yield pa.record_batch([batch.column("lang").slice(at, len(x)), batch.column("by").slice(at, len(x)), *lists], ["lang", "by", "index", "value"])

    told = save(sample.mapInArrow(described, "lang string, by bigint, index array<int>, value array<float>"), "features")
    there = {r["lang"]: r["count"] for r in told.groupBy("lang").count().collect()}
    dealt = [(x, name, sign, per_side / max(1, sum(there.get(y, 0) for y in side))) for name, both in sides.items() for sign, side in zip((1, -1), both, strict=True) for x in side]
    dealt = F.broadcast(told.sparkSession.createDataFrame(dealt, "lang string, machine string, sign int, part double"))  # a row for each language and machine
    given = told.join(dealt, "lang").where(_share(F.col("by"), "side", F.col("part")))

    def fitted(group: pa.Table) -> pa.Table:
        group = group.sort_by([("by", "ascending"), ("lang", "ascending")])
        x = np.zeros((group.num_rows, FEATURES), np.float32)
        for i, (index, value) in enumerate(zip(group.column("index"), group.column("value"), strict=True)):
            x[i, index.values.to_numpy()] = value.values.to_numpy()
        w = machine(x, group.column("sign").to_numpy().astype(np.float64))
        return pa.table({"machine": [group.column("machine")[0].as_py()], "weights": pa.array([w.tobytes()], pa.binary())})

    found = given.groupBy("machine").applyInArrow(fitted, "machine string, weights binary").collect()
    weights = {r["machine"]: np.frombuffer(r["weights"], np.float32) for r in found}
    return Model(members, {name: weights.get(name, np.zeros(FEATURES + 1, np.float32)) for name in sides})


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row, from its whole text alone.

    ``und`` with a score of 0 if a text is null or has no letter, or if the
    model knows no language.  Repeated rows are rows each, ids may repeat or be
    null, an empty table gives no rows, other columns aren't read.
    """
    t = F.col(f"`{text}`").cast("string")
    asked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.when(t.rlike(r"\p{L}"), t).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            blank = batch.column("text").is_null().to_numpy(zero_copy_only=False)
            for at, x in features(batch.column("text")):
                empty = blank[at : at + len(x)] if known.members else np.ones(len(x), bool)
                language, sure = known.predict(x) if known.members else ([UNKNOWN] * len(x), np.zeros(len(x)))
                language = [UNKNOWN if e else y for e, y in zip(empty, language, strict=True)]
                yield pa.record_batch([batch.column("doc_id").slice(at, len(x)), pa.array(language, pa.string()), pa.array(np.where(empty, 0.0, sure), pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = dict(docs.dtypes)[id_col]
    return asked.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
