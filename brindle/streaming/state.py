"""Streams: bounded histories and profiles by key, event time, and incremental upserts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from brindle.streaming.graph_store import PARTS, GraphStore, Nodes

#: Keyed state with lists, maps and timers needs this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def with_state(spark: SparkSession) -> SparkSession:
    """The session with the state store that keyed lists, maps and timers need; a query that runs already keeps its own."""
    spark.conf.set(*STORE)
    return spark


class _Idle:
    """One timer a key: it fires when event time has passed the key's last news by ``idle`` milliseconds, and its state goes."""

    def __init__(self, idle: int | None, time: str | None):
        self.idle, self.time = idle, time

    def heard(self, handle: StatefulProcessorHandle, last: object) -> None:
        if self.idle is None or last is None:
            return
        due = int(last.timestamp() * 1000) + self.idle
        if all(t < due for t in handle.listTimers()):
            for t in list(handle.listTimers()):
                handle.deleteTimer(t)
            handle.registerTimer(due)

    def over(self, handle: StatefulProcessorHandle, timers: object) -> bool:
        """Whether the timer is due already, though what it does comes after the news of its batch."""
        return self.idle is not None and any(t <= timers.getCurrentWatermarkInMs() for t in handle.listTimers())

    def last_of(self, rows: list[Row]) -> object:
        return max((r[self.time] for r in rows if r[self.time] is not None), default=None) if self.time else None


class _History(StatefulProcessor):
    """Keeps the last n (order, value) of a key as a list, the latest first; null orders count as the oldest, and of equal ones what came later is later."""

    def __init__(self, n: int, key: str, order: str, value: str, kind: str, idle: _Idle):
        self.n, self.key, self.order, self.value, self.kind, self.idle = n, key, order, value, kind, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getListState("held", self.kind)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        news = list(rows)
        if self.idle.over(self.handle, timerValues):
            self.held.clear()
        held = [(r[self.order], r[self.value]) for r in reversed(news)] + [(r[0], r[1]) for r in self.held.get()]
        known, unknown = [h for h in held if h[0] is not None], [h for h in held if h[0] is None]
        held = (sorted(known, key=lambda h: h[0], reverse=True) + unknown)[: self.n]
        self.held.put(held)
        self.idle.heard(self.handle, self.idle.last_of(news))
        yield Row(**{self.key: key[0], "history": [v for _, v in held]})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
        self.held.clear()
        yield Row(**{self.key: key[0], "history": []})

    def close(self) -> None:
        pass


def _run(events: DataFrame, key: str, processor: StatefulProcessor, schema: T.StructType, idle: int | None) -> DataFrame:
    with_state(events.sparkSession)
    return events.groupBy(key).transformWithState(processor, schema, "Update", "None" if idle is None else "EventTime")


def bounded_history(events: DataFrame, key: str, order: str, value: str, n: int = 20, *, time: str | None = None, idle_ms: int | None = None) -> DataFrame:
    """(key, history): after each batch the last n values of each key that had news, most recent first, with their type and nulls.

    The state of a key is n values at most.  idle_ms: a key without news for so
    long, by the watermark of the column ``time``, is told with an empty history
    once, and its state goes.
    """
    field = events.schema[value].dataType
    kind = T.StructType([T.StructField("order", events.schema[order].dataType), T.StructField("value", field)])
    out = T.StructType([T.StructField(key, events.schema[key].dataType), T.StructField("history", T.ArrayType(field))])
    return _run(events, key, _History(n, key, order, value, kind, _Idle(idle_ms, time)), out, idle_ms)


class _Profile(StatefulProcessor):
    """Keeps the last value of each name of a key as a map, with the order it came under."""

    def __init__(self, key: str, name: str, value: str, order: str, kinds: tuple[T.StructType, T.StructType], idle: _Idle):
        self.key, self.name, self.value, self.order, self.kinds, self.idle = key, name, value, order, kinds, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getMapState("held", *self.kinds)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        news, changed = list(rows), {}
        if self.idle.over(self.handle, timerValues):
            self.held.clear()
        for r in news:
            name, order = r[self.name], r[self.order]
            if name is None or order is None:
                continue
            if name not in changed:
                there = self.held.getValue((name,)) if self.held.containsKey((name,)) else None
                changed[name] = (None if there is None else there[0], None if there is None else there[1], False)
            if changed[name][0] is None or order >= changed[name][0]:
                changed[name] = (order, r[self.value], True)
        for name, (order, value, new) in changed.items():
            if new:
                self.held.updateValue((name,), (order, value))
                yield Row(**{self.key: key[0], self.name: name, self.value: value})
        self.idle.heard(self.handle, self.idle.last_of(news))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
        for name in [k[0] for k in self.held.keys()]:
            yield Row(**{self.key: key[0], self.name: name, self.value: None})
        self.held.clear()

    def close(self) -> None:
        pass


def profiles(events: DataFrame, key: str, name: str, value: str, order: str, *, time: str | None = None, idle_ms: int | None = None) -> DataFrame:
    """(key, name, value): after each batch the names of each key whose value was set, the last by order; rows without a name or an order set nothing.

    The state of a key is a map of its names.  idle_ms: as in
    ``bounded_history``; the names of a key that goes are told with null.
    """
    kinds = T.StructType([events.schema[name]]), T.StructType([T.StructField("order", events.schema[order].dataType), T.StructField("value", events.schema[value].dataType)])
    out = T.StructType([T.StructField(c, events.schema[c].dataType) for c in (key, name, value)])
    return _run(events, key, _Profile(key, name, value, order, kinds, _Idle(idle_ms, time)), out, idle_ms)


# --- event time ----------------------------------------------------------------------


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts of each kind in tumbling windows; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"))


def session_counts(events: DataFrame, time: str, by: Sequence[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(by, session, n): rows of a key that follow each other by less than the gap are a session; told once the watermark is past it, and rows later than that are left out."""
    return events.withWatermark(time, late).groupBy(*by, F.session_window(time, gap).alias("session")).agg(F.count("*").alias("n"))


def distinct_within(events: DataFrame, by: Sequence[str], time: str, late: str = "1 hour") -> DataFrame:
    """Rows without those that repeat a key within the watermark; state of older keys goes."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(list(by))


def between(events: DataFrame, time: str, start: str, end: str, late: str = "1 hour") -> DataFrame:
    """Rows of a span of event time, both ends included, with the watermark that later operators go by."""
    kind = events.schema[time].dataType.simpleString()
    return events.withWatermark(time, late).where(F.col(time).between(F.lit(start).cast(kind), F.lit(end).cast(kind)))


# --- upserts ---------------------------------------------------------------------------


def upserting(path: str, key: str, order: Sequence[str], parts: int = PARTS):
    """A foreachBatch function that merges each batch into the node table at path; ``upserted`` reads it.

    One table of a ``GraphStore``: a batch that fails or comes again does no harm,
    neither a new checkpoint nor a skipped batch id loses what is there, and
    superseded files go.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        _one_table(batch.sparkSession, path, key, order, parts).upserting(lambda rows: {"rows": rows})(batch, batch_id)

    return merge


def _one_table(spark: SparkSession, path: str, key: str, order: Sequence[str], parts: int) -> GraphStore:
    return GraphStore(spark, path, {"rows": Nodes(key, tuple(order))}, {}, parts)


def upserted(spark: SparkSession, path: str) -> DataFrame:
    """The table as the last batch left it."""
    found = _one_table(spark, path, "", (), PARTS).read("rows")
    if found is None:
        raise FileNotFoundError(f"{path} holds no rows")
    return found
