"""Quality rules under weak supervision, with DataFrame operations only.

Each rule votes good, votes bad or abstains.  How often each combination of
votes occurs is counted over all documents; from these counts (at most
3**rules, whatever the corpus) expectation-maximisation estimates how each rule
votes on good and on bad documents and how many are bad.  A document is kept if
its posterior probability of being good is ``threshold`` or more.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.scratch import save

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: What a document is measured by, in this order.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_upper", "n_marks")
FOUND = "__quality"


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` does, else abstains."""

    name: str
    bad: str
    good: str


#: n_words of 0 never reach the ratios: such a document fails the base rules.
RULES = (
    Rule("length", "n_words < 50", "n_words >= 80"),
    Rule("repeats", "100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 10 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    Rule("lines", "100 * n_dup_lines > 50 * n_lines", "n_lines > 1 AND n_dup_lines = 0"),
    Rule("word_length", "2 * word_chars < 5 * n_words OR word_chars > 10 * n_words", "word_chars >= 4 * n_words AND 2 * word_chars <= 15 * n_words"),
    Rule("capitals", "100 * n_upper > 30 * word_chars", "100 * n_upper <= 10 * word_chars"),
    Rule("endings", "100 * n_ended_lines < 30 * n_lines", "100 * n_ended_lines >= 70 * n_lines"),
    Rule("marks", "100 * n_marks > 10 * word_chars", "100 * n_marks <= 6 * word_chars"),
)


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct column ``__quality`` of MEASURES; see ``judge`` for the cases.

    Arrays that a lambda looks into are columns of an earlier projection, so
    they are built once for a row.
    """
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    step = docs.select("*", t.alias("__t"), F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "").alias("__w"), F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__l"))
    window = F.expr("CASE WHEN size(__w) < 3 THEN cast(array() AS array<bigint>) ELSE transform(sequence(0, size(__w) - 3), i -> xxhash64(get(__w, i), get(__w, i + 1), get(__w, i + 2))) END")
    step = step.withColumn("__h", window)
    # Windows that occur twice: neighbours in the order of their hashes; only texts that have some are sorted.
    again = F.expr(
        """CASE WHEN size(array_distinct(__h)) = size(__h) THEN cast(array() AS array<struct<h: bigint, i: int>>)
        ELSE sort_array(transform(__h, (h, i) -> named_struct('h', h, 'i', i))) END"""
    )
    step = step.withColumn("__s", again)
    pairs = F.expr("zip_with(slice(__s, 1, greatest(size(__s) - 1, 0)), slice(__s, 2, greatest(size(__s) - 1, 0)), (a, b) -> if(a.h = b.h, array(a.i, b.i), cast(array() AS array<int>)))")
    covered = F.aggregate(
        F.sort_array(F.array_distinct(F.flatten(pairs))),
        F.struct(F.lit(-9).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    w, lines, body = F.col("__w"), F.col("__l"), F.col("__t")
    values = {
        "n_words": F.size(w), "word_chars": F.length(F.translate(body, BLANKS, "")), "n_symbols": _count(body, SYMBOLS), "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.when(F.size("__s") > 0, covered).otherwise(0), "n_lines": F.size(lines), "n_ended_lines": F.size(F.filter(lines, lambda x: x.rlike(r"[.!?\"'][\x20\x09-\x0D]*$"))),
        "n_upper": F.length(body) - F.length(F.translate(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")), "n_marks": _count(body, "#*$%&|<>!?@[]{}()=+/\\^~_"),
    }
    return step.withColumn(FOUND, F.struct(*(values[m].cast("bigint").alias(m) for m in MEASURES))).drop("__t", "__w", "__l", "__h", "__s")


def base_failed(q: str = FOUND) -> Column:
    return (F.col(f"{q}.n_words") < 50) | (100 * F.col(f"{q}.n_repeat_words") > 50 * F.col(f"{q}.n_words"))


def _qualified(condition: str, q: str) -> Column:
    for m in sorted(MEASURES, key=len, reverse=True):
        condition = condition.replace(m, f"`{q}`.§{MEASURES.index(m)}")
    for k, m in enumerate(MEASURES):
        condition = condition.replace(f"§{k}", m)
    return F.expr(condition)


def votes(rules: tuple[Rule, ...] = RULES, q: str = FOUND) -> list[Column]:
    """Each rule's vote: 0 bad, 1 good, 2 none."""
    return [F.when(_qualified(r.bad, q), 0).when(_qualified(r.good, q), 1).otherwise(2) for r in rules]


@dataclass(frozen=True)
class Model:
    """What the votes say: logarithmic odds for good of the prior, and of a bad and of a good vote of each rule; rates: of bad votes among a rule's votes on bad and on good documents."""

    prior: float
    odds: tuple[tuple[float, float], ...]
    rates: tuple[tuple[float, float], ...]

    def posterior(self, each: list[Column]) -> Column:
        total = F.lit(self.prior)
        for v, (bad, good) in zip(each, self.odds, strict=True):
            total = total + F.when(v == 0, bad).when(v == 1, good).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(measured: DataFrame, rules: tuple[Rule, ...] = RULES, *, rounds: int = 200, hits: float = 0.4, alarms: float = 0.02, prior: float = 0.8, weight: float = 20, q: str = FOUND) -> Model:
    """The label model by expectation-maximisation over the counts of all vote combinations.

    A rule has two accuracies: how many of its votes on bad documents are bad
    (hits), and how many on good ones (alarms).  The estimates start from the
    values given, which also count as ``weight`` votes; a rule is never taken to
    do worse than chance (hits at least alarms), and to abstain says nothing.
    It stops when no posterior moves by a millionth.  An empty table gives the
    starting model.
    """
    counted = measured.select(F.concat_ws("", *(v.cast("string") for v in votes(rules, q))).alias("votes")).groupBy("votes").count().collect()
    seen = sorted((tuple(map(int, r["votes"])), r["count"]) for r in counted)
    total = sum(c for _, c in seen)
    rates = [(hits, alarms)] * len(rules)
    before: list[float] = []

    def odds() -> list[tuple[float, float]]:
        return [(math.log(b / a), math.log((1 - b) / (1 - a))) for a, b in rates]

    for _ in range(rounds):
        now, base = odds(), math.log(prior / (1 - prior))
        good = [1 / (1 + math.exp(max(-700.0, min(700.0, -base - sum(now[k][x] for k, x in enumerate(v) if x < 2))))) for v, _ in seen]
        if before and max(abs(x - y) for x, y in zip(good, before, strict=True)) < 1e-6 or not seen:
            break
        before = good
        prior = (sum(w * c for w, (_, c) in zip(good, seen, strict=True)) + 0.8 * weight) / (total + weight)
        for k in range(len(rules)):
            bad_of, all_of = [hits * weight, alarms * weight], [weight, weight]
            for w, (v, c) in zip(good, seen, strict=True):
                for side, mass in ((0, (1 - w) * c), (1, w * c)):
                    all_of[side] += mass * (v[k] < 2)
                    bad_of[side] += mass * (v[k] == 0)
            a, b = bad_of[0] / all_of[0], bad_of[1] / all_of[1]
            pooled = sum(bad_of) / sum(all_of)
            rates[k] = (a, b) if a >= b else (pooled, pooled)
    return Model(math.log(prior / (1 - prior)), tuple(odds()), tuple(rates))


def verdict(model: Model, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, q: str = FOUND) -> Column:
    return ~base_failed(q) & (model.posterior(votes(rules, q)) >= threshold)


def judge(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """(doc_id, measures, base_failed, posterior, kept) of each row.

    A null or empty text has no words and fails the base rules.  Each row is
    judged for itself, so repeats and null ids stay; an empty table gives no
    rows.  Other columns aren't read.
    """
    measured = save(measures(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))).select("doc_id", FOUND), "measures")
    model = fit(measured, rules)
    return measured.select("doc_id", *(F.col(f"{FOUND}.{m}") for m in MEASURES), base_failed().alias("base_failed"), model.posterior(votes(rules)).alias("posterior"), verdict(model, rules, threshold).alias("kept"))


def keep_good(docs: DataFrame, *, text: str = "text", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """docs, its columns unchanged, without the rows that are rejected; the cases are those of ``judge``.

    The measures are taken twice, for the model and for the verdict: that costs
    time but neither a shuffle nor a copy of the texts.  A row is one struct
    meanwhile, so its columns may have any names.
    """
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text}`").alias("text"))
    model = fit(measures(packed.select("text")).select(FOUND), rules)
    # The partition's number, not being deterministic, keeps the filter above the
    # projection: below it, arrays would be built anew for each element of a lambda.
    judged = measures(packed).select("row", verdict(model, rules, threshold).alias("kept"), F.spark_partition_id().alias("here"))
    return judged.where(F.col("kept") & (F.col("here") >= 0)).select("row.*")
