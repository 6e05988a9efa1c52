"""Personal data by base patterns and bootstrapped contextual extraction.

Base spans come from fixed patterns and checks.  They are the seeds: the two
words before a seed's token are a lexical pattern for its kind.  Tokens with
digits or an at sign that no base pattern takes, and stretches of them, are
candidates, each with its context.
Patterns and instances form a bipartite graph; its scores are iterated: a
pattern is as sure as the instances it has picked out so far, an instance as
sure as the independent patterns that pick it.  Instances of sure patterns join
the seeds, and what such a pattern finds in the whole corpus is a span too.

DataFrame operations only.  Spans of a text are read off its matches and the
gaps between them, in code points.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.scratch import drop, free_names, save, saved_path, sendable

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that each start is tried in constant time and no repetition is recursive: a run is entered at its start, or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a pattern to be tried at all.
NEEDED = {"email": "@", "ip": ".", "phone": "+"}
#: The first of two words before a token with a digit or an at sign; looked ahead at: the space up to the second word, it and the space after, the token, and as many such tokens one blank apart as an identifier has digits at most.
BEFORE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]++(?=([\x20\x09-\x0D]++[^\x20\x09-\x0D]++[\x20\x09-\x0D]++)([^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)((?:\x20[^\x20\x09-\x0D0-9@]{0,2}[0-9][^\x20\x09-\x0D]*+){0,18}+))"
#: Shapes that an unseen identifier of a kind may have, without the marks around it.
SHAPES = {
    "email": r"^[^\s@]+@[^\s@]*[A-Za-z0-9][^\s@]*$",
    "ip": r"^(?:[0-9]{1,3}(?:[.:][0-9]{1,3}){3}|[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){3,7})$",
    "card": r"^[0-9](?:[ -]?[0-9]){12,18}$",
    "phone": r"^[(]?[0-9](?:[ ().-]{0,2}[0-9]){6,14}$",
}
MARKS = r"\x21-\x24\x26-\x2A\x2C-\x2F\x3A-\x3F\x5B-\x60\x7B-\x7E"
#: A stretch of tokens that may be an identifier with blanks in it, as long as it goes.
RUN = rf"^[{MARKS}]*[0-9](?:[ ().-]{{0,2}}[0-9]){{6,18}}[{MARKS}]*(?=\x20|$)"
ROUNDS, SURE, SUPPORT = 3, 0.8, 3
#: Items of a block of a pass; beyond every text's end.
HELD, END = 128, 2**31 - 1
NO_TOKENS = "array<struct<start: int, stop: int, token: string, rest: string, pattern: string>>"


@dataclass(frozen=True)
class Pass:
    """A pass over items that gives a value for each; step: (state, item) -> (state after, value)."""

    items: Column
    state: dict[str, Column]
    step: Callable[[Column, Column], tuple[dict[str, Column], Column]]
    kind: str

    def _after(self, state: Column, x: Column) -> Column:
        return F.struct(*(v.alias(k) for k, v in self.step(state, x)[0].items()))

    def starts(self, blocks: str) -> Column:
        """The state before each block."""
        first = F.struct(*(v.alias(k) for k, v in self.state.items()))
        through = lambda acc, block: F.struct(F.aggregate(block, acc["now"], self._after).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out"))
        return F.aggregate(blocks, F.struct(first.alias("now"), F.slice(F.array(first), 1, 0).alias("out")), through, lambda acc: acc["out"])

    def values(self, blocks: str) -> Column:
        none = F.array().cast(f"array<{self.kind}>")

        def one(acc: Column, x: Column) -> Column:
            return F.struct(self._after(acc["now"], x).alias("now"), F.concat(acc["out"], F.array(self.step(acc["now"], x)[1].cast(self.kind))).alias("out"))

        of_block = lambda block, now: F.aggregate(block, F.struct(now.alias("now"), none.alias("out")), one, lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, self.starts(blocks), of_block))


def _passed(df: DataFrame, passes: dict[str, Pass]) -> DataFrame:
    """df with what the passes give as columns.

    An aggregation over an array copies what it has gathered at each step.  So
    items go by blocks of ``HELD``, each with the state before it, and only
    within a block does an array grow.
    """
    names = list(passes)
    items, blocks = ([free for free in free_names(df, *(f"{what}_{k}" for k in range(len(names))))] for what in ("items", "blocks"))
    df = df.withColumns({i: passes[n].items for i, n in zip(items, names, strict=True)})
    cut = "if(size({0}) > 0, transform(sequence(0, (size({0}) - 1) div {1}), b -> slice({0}, cast(b * {1} + 1 AS int), {1})), slice(array({0}), 1, 0))"
    df = df.withColumns({b: F.expr(cut.format(i, HELD)) for b, i in zip(blocks, items, strict=True)})
    return df.withColumns({n: passes[n].values(b) for b, n in zip(blocks, names, strict=True)}).drop(*items, *blocks)


def _spans(text: Column, pattern: str, tried: Column | None = None) -> Pass:
    """array<struct<start, stop, found, gap>>: the matches, where the text is to be tried, with the text between each and the one before."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(gaps, 1, F.greatest(F.size(found), F.lit(1))), lambda m, g: F.struct(m.alias("found"), g.alias("gap")))
    pairs = F.filter(pairs, lambda x: x["found"].isNotNull())

    def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        a = acc["at"] + F.length(x["gap"])
        b = a + F.length(x["found"])
        return {"at": b}, F.struct(a.alias("start"), b.alias("stop"), x["found"].alias("found"), x["gap"].alias("gap"))

    items = pairs if tried is None else F.when(tried, pairs).otherwise(F.array().cast("array<struct<found: string, gap: string>>"))
    return Pass(items, {"at": F.lit(0)}, step, "struct<start: int, stop: int, found: string, gap: string>")


def _luhn(digits: Column) -> Column:
    def one(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), one) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _checked(kind: str, x: Column) -> Column:
    return _valid(kind, x["found"])


def _of_kind(kind: str, x: Column) -> Column:
    return x["kind"] == kind


def _bare_seed(kind: str, x: Column) -> Column:
    return F.struct(x["start"].alias("start"), x["stop"].alias("stop"), F.lit(kind).alias("kind"), F.lower(x["found"]).alias("instance"))


def _events(base: str, tokens: str) -> Column:
    """Base spans and tokens in one array, by start; of those that start at one place the tokens come first."""
    spans = F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("base"), b["stop"].alias("stop"), F.lit(0).alias("k")))
    other = F.transform(tokens, lambda x, k: F.struct(x["start"].alias("at"), F.lit(0).alias("base"), x["stop"].alias("stop"), k.alias("k")))
    return F.concat(spans, other)


def _forward(events: Column) -> Pass:
    """array<struct<base, k, behind>>: for each event the last token so far, and the farthest end of the base spans before."""

    def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        is_base = x["base"] == 1
        inside = F.when(is_base & (x["at"] < acc["stop"]), acc["k"]).otherwise(F.when(is_base, -1).otherwise(x["k"]))
        after = {"k": F.when(is_base, acc["k"]).otherwise(x["k"]), "stop": F.when(is_base, acc["stop"]).otherwise(x["stop"]), "behind": F.when(is_base, F.greatest(acc["behind"], x["stop"])).otherwise(acc["behind"])}
        return after, F.struct(x["base"].alias("base"), inside.alias("k"), acc["behind"].alias("behind"))

    return Pass(F.sort_array(events), {"k": F.lit(-1), "stop": F.lit(0), "behind": F.lit(0)}, step, "struct<base: int, k: int, behind: int>")


def _backward(events: Column) -> Pass:
    """array<struct<base, ahead>>, last event first: where the next base span at or after its start starts."""

    def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        return {"ahead": F.when(x["base"] == 1, x["at"]).otherwise(acc["ahead"])}, F.struct(x["base"].alias("base"), acc["ahead"].alias("ahead"))

    return Pass(F.sort_array(events, asc=False), {"ahead": F.lit(END)}, step, "struct<base: int, ahead: int>")


def _context(first: Column, second: Column) -> Column:
    """Two words in lower case and without marks at their ends; null if nothing is left of one."""
    bare = [F.lower(F.regexp_replace(w, rf"^[{MARKS}]+|[{MARKS}]+$", "")) for w in (first, F.regexp_replace(second, r"[\x20\x09-\x0D]+", ""))]
    return F.when((bare[0] != "") & (bare[1] != ""), F.concat_ws(" ", *bare))


def with_base(docs: DataFrame, text: str) -> DataFrame:
    """docs with an array of base spans for each kind (columns ``__email`` ...) and ``__other``: array<struct<start, stop, token, rest, pattern>>.

    The latter are the tokens with a digit or an at sign, each with its context
    and the tokens after it one blank apart.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    passes = {f"__{kind}": _spans(body, PATTERNS[kind], body.contains(NEEDED[kind]) if kind in NEEDED else None) for kind in KINDS}
    docs = _passed(docs, passes | {"__before": _spans(body, BEFORE, body.rlike("[0-9@]"))})
    between, token, rest = (F.regexp_extract_all(body, F.lit(BEFORE), k) for k in (1, 2, 3))
    parts = F.when(F.size("__before") > 0, F.arrays_zip(between.alias("between"), token.alias("token"), rest.alias("rest")))

    def one(x: Column, p: Column) -> Column:
        start = x["stop"] + F.length(p["between"])
        return F.struct(start.alias("start"), (start + F.length(p["token"])).alias("stop"), p["token"].alias("token"), p["rest"].alias("rest"), _context(x["found"], p["between"]).alias("pattern"))

    checked = {f"__{kind}": F.filter(f"__{kind}", partial(_checked, kind)) for kind in KINDS}
    other = F.coalesce(F.zip_with("__before", parts, one), F.array().cast(NO_TOKENS))
    return docs.withColumns(checked | {"__other": other}).drop("__before")


def described(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc_id, hash, base, other): spans of a row as (kind, start, stop, instance, pattern) and candidates alike.

    Candidates are each token by itself and, if longer, the longest stretch from
    it on that ends before the next base span, where they have a kind's shape.
    """
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = with_base(docs.select(F.col(f"`{id_col}`").alias("doc_id"), t.alias("text"), F.xxhash64(t).alias("hash")), "text")
    # By start, as the passes meet them; find_pii puts them in order of kind.
    base = F.sort_array(F.concat(*(F.transform(f"__{kind}", partial(_bare_seed, kind)) for kind in KINDS)))
    rows = rows.select("doc_id", "hash", base.alias("seeds"), "__other")
    rows = rows.withColumn("events", F.when(F.size("seeds") > 0, _events("seeds", "__other")).otherwise(F.array().cast("array<struct<at: int, base: int, stop: int, k: int>>")))
    rows = _passed(rows, {"before": _forward(F.col("events")), "after": _backward(F.col("events"))})
    token_of = F.transform(F.filter("before", lambda e: e["base"] == 1), lambda e: e["k"])
    # A seed's context is that of the token in which it starts, null where less than two words come before.
    base = F.zip_with("seeds", token_of, lambda x, k: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), x["instance"].alias("instance"), F.when(k >= 0, F.get("__other", k)["pattern"]).alias("pattern")))
    behind = F.transform(F.filter("before", lambda e: e["base"] == 0), lambda e: e["behind"])
    ahead = F.reverse(F.transform(F.filter("after", lambda e: e["base"] == 0), lambda e: e["ahead"]))
    # (token, behind, ahead): the stretch around a token that no base span takes.
    around = F.arrays_zip(F.col("__other").alias("x"), behind.alias("behind"), ahead.alias("ahead"))
    rows = rows.select("doc_id", "hash", base.alias("base"), around.alias("around"))

    def bare(x: Column, found: Column) -> Column:
        lead = F.length(F.regexp_extract(found, rf"^[{MARKS}]*", 0))
        trail = F.length(F.regexp_extract(found, rf"[{MARKS}]*$", 0))
        keep = F.substring(found, lead + 1, F.length(found) - lead - trail)
        kind = F.lit(None).cast("string")
        for k in reversed(KINDS):
            kind = F.when(keep.rlike(SHAPES[k]), k).otherwise(kind)
        return F.struct(kind.alias("kind"), (x["start"] + lead).alias("start"), (x["start"] + F.length(found) - trail).alias("stop"), F.lower(keep).alias("instance"), x["pattern"].alias("pattern"))

    def both(y: Column) -> Column:
        x, behind, ahead = y["x"], F.coalesce(y["behind"], F.lit(0)), F.coalesce(y["ahead"], F.lit(END))
        whole = F.concat(x["token"], x["rest"])
        run = F.regexp_extract(F.substring(whole, F.lit(1), ahead - x["start"]), RUN, 0)
        alone = bare(x, x["token"])
        every = F.when((x["rest"] != "") & (F.length(run) > F.length(x["token"])), F.array(alone, bare(x, run))).otherwise(F.array(alone))
        return F.filter(every, lambda c: c["kind"].isNotNull() & (behind <= c["start"]) & (c["stop"] <= ahead))

    tokens = F.filter("around", lambda y: y["x"]["pattern"].isNotNull())
    return rows.select("doc_id", "hash", "base", F.flatten(F.transform(tokens, both)).alias("other"))


def bootstrap(found: DataFrame, *, rounds: int = ROUNDS, sure: float = SURE, support: int = SUPPORT) -> DataFrame:
    """(kind, pattern) of the sure patterns.

    The edges are distinct (kind, pattern, instance); counts come by partial sums,
    so a context or an identifier that is everywhere costs no more than its
    distinct partners.  Instances of one pattern have weights: a seed 1, another
    its score of the round before.  After ``rounds`` of scores the instances that
    are sure become seeds, support for patterns like the first ones, and the
    scores are made anew, until no instance joins; seeds only grow, so it ends.
    """

    def edges(column: str, seed: bool) -> DataFrame:
        x = found.select(F.explode(column).alias("x")).select("x.kind", "x.instance", "x.pattern")
        return x.where("pattern is not null").distinct().withColumn("seed", F.lit(1.0 if seed else 0.0))

    graph = save(edges("base", True).union(edges("other", False)).groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed")), "graph")
    known = graph.where("seed = 1").count()
    while True:
        patterns, score = _scored(graph, rounds, sure, support)
        found_sure = score.where(F.col("score") >= sure).select("kind", "instance", F.lit(1.0).alias("sure"))
        grown = save(graph.join(found_sure, ["kind", "instance"], "left").select("kind", "pattern", "instance", F.greatest("seed", F.coalesce("sure", F.lit(0.0))).alias("seed")), "graph")
        now = grown.where("seed = 1").count()
        drop(graph.sparkSession, saved_path(graph), saved_path(score))
        if now == known:
            return patterns.where((F.col("seeds") >= support) & (F.col("trust") >= sure)).select("kind", "pattern")
        drop(graph.sparkSession, saved_path(patterns))
        graph, known = grown, now


def _scored(graph: DataFrame, rounds: int, sure: float, support: int) -> tuple[DataFrame, DataFrame]:
    """((kind, pattern, seeds, trust), (kind, instance, score)) after some rounds from the seeds of the graph."""
    score = patterns = None
    for _ in range(rounds):
        known = graph.withColumn("weight", F.col("seed")) if score is None else graph.join(score, ["kind", "instance"], "left").withColumn("weight", F.greatest("seed", F.coalesce("score", F.lit(0.0))))
        # Of all instances of a pattern, of whatever kind, the share that is known to be of this one, smoothed by half an unknown.
        each = known.groupBy("kind", "pattern").agg(F.sum("weight").alias("mass"), F.sum("seed").alias("seeds"), F.count("*").alias("n"))
        every = each.groupBy("pattern").agg(F.sum("n").alias("all"))
        patterns = save(each.join(every, "pattern").select("kind", "pattern", "seeds", (F.col("mass") / (F.col("all") + 0.5)).alias("trust")), "patterns")
        good = patterns.where((F.col("seeds") >= support) & (F.col("trust") >= sure / 2))
        picked = graph.join(good, ["kind", "pattern"])
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-6)))))
        score = save(picked.groupBy("kind", "instance").agg((1 - doubt).alias("score")), "scores")
    return patterns, score


def _widest(spans: str) -> Pass:
    """Of a span and a longer one around it the longer stays; the other's kind becomes null."""
    by_start = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["stop"]).alias("back"), x["kind"].alias("kind"))))

    def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        stop = -x["back"]
        covered = (acc["most"] >= stop) & ~((acc["start"] == x["start"]) & (acc["most"] == stop))
        after = {"start": F.when(stop > acc["most"], x["start"]).otherwise(acc["start"]), "most": F.greatest(acc["most"], stop)}
        return after, F.struct(F.when(~covered, x["kind"]).alias("kind"), x["start"].alias("start"), stop.alias("stop"))

    return Pass(by_start, {"start": F.lit(-1), "most": F.lit(-1)}, step, "struct<kind: string, start: int, stop: int>")


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, hash, base, added) of each row; spans are (kind, start, stop), stop exclusive, in code points; base by kind as listed, then start.

    A null or empty text has none.  Rows stay each for itself.  hash is the
    text's.  Other columns aren't read; an empty table gives no rows.
    """
    found = save(described(docs, id_col, text), "spans")
    rules = save(bootstrap(found, **options), "rules")
    hits = found.where("size(other) > 0").select("doc_id", "hash", F.explode("other").alias("x")).select("doc_id", "hash", "x.kind", "x.start", "x.stop", "x.pattern")
    hits = hits.join(F.broadcast(rules) if sendable(rules) else rules, ["kind", "pattern"]).select("doc_id", "hash", F.struct("kind", "start", "stop").alias("x")).distinct()
    hits = _passed(hits.groupBy("doc_id", "hash").agg(F.collect_list("x").alias("every")), {"passed": _widest("every")})
    added = save(hits.select("doc_id", "hash", F.sort_array(F.filter("passed", lambda x: x["kind"].isNotNull())).alias("added")), "added")
    on = found.doc_id.eqNullSafe(added.doc_id) & (found.hash == added.hash)
    joined = found.join(F.broadcast(added) if sendable(added) else added, on, "left")
    base = F.transform(found.base, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))
    return joined.select(found.doc_id, found.hash, in_order(base).alias("base"), F.coalesce("added", F.array().cast("array<struct<kind: string, start: int, stop: int>>")).alias("added"))


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def in_order(spans: Column) -> Column:
    """Spans by kind as listed, then start."""
    return F.concat(*(F.array_sort(F.filter(spans, partial(_of_kind, kind))) for kind in KINDS))


def mask(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", length: str | None = None, **options) -> DataFrame:
    """docs, its columns unchanged but for the text, where each span is replaced by its kind (``<EMAIL>``), and length, its count of code points.

    Of overlapping spans the one that starts first, then the longest, names the
    stretch that they cover together.
    """
    found = find_pii(docs, id_col=id_col, text=text, **options)
    every = F.concat("base", "added")
    of, hashed, spans_of, pieces, masked_as = free_names(docs, "of", "hashed", "spans", "pieces", "masked")
    spans = F.transform(every, lambda x: F.struct(x["start"].alias("start"), (-x["stop"]).alias("back"), x["kind"].alias("kind")))
    spans = found.where("size(base) + size(added) > 0").select(F.col("doc_id").alias(of), F.col("hash").alias(hashed), F.array_sort(spans).alias(spans_of))
    spans = save(spans.dropDuplicates([of, hashed]), "masks")
    t = F.col(f"`{text}`").cast("string")
    on = F.col(f"`{id_col}`").eqNullSafe(F.col(of)) & (F.xxhash64(F.coalesce(t, F.lit(""))) == F.col(hashed))
    joined = docs.join(F.broadcast(spans) if sendable(spans) else spans, on, "left")

    def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        fresh = F.concat(F.substring(t, acc["at"] + 1, x["start"] - acc["at"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))
        return {"at": F.greatest(acc["at"], -x["back"])}, F.when(x["start"] >= acc["at"], fresh).otherwise("")

    end = F.array_max(F.transform(spans_of, lambda x: -x["back"]))
    masked = F.concat(F.array_join(pieces, ""), F.substring(t, end + 1, F.length(t)))
    joined = _passed(joined, {pieces: Pass(F.col(spans_of), {"at": F.lit(0)}, step, "string")})
    out = joined.withColumn(masked_as, F.when(F.col(spans_of).isNull(), t).otherwise(masked))
    columns = []
    for c in docs.columns:
        new = F.col(masked_as) if c == text else F.length(masked_as).cast(docs.schema[c].dataType) if c == length else F.col(f"`{c}`")
        columns.append(new.alias(c))
    return out.select(*columns)


def count_of(kind: str, spans: str) -> Column:
    return F.size(F.filter(spans, partial(_of_kind, kind))).cast("bigint")
