"""Steps with deadlines: what a key's rows, or the silence after them, lead to in order of event time.

A step handles one row and may ask to be woken at a later time.  The batch form runs over sorted rows and wakes a step
before the first row at or after its deadline, and after the last row.  The stream form keeps a key's rows until the
watermark has passed them, so rows that are late within the watermark's delay come in order, and wakes steps by event-time
timers: a source that falls silent is noticed without another row, and the last phrase of a stream is handed out.  Both
give the same rows; rows later than the delay are dropped by the stream.  A key without state and rows keeps nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillwork.operators.retrieval import shared_folder

#: What the state of timers needs (public settings of Spark); every start of a query opens its stores anew.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: Rows that one element of a key's state holds.
PACKED = 500
#: A slice of time in which two streams meet, in longest rows.
SLICE = 8
#: Microseconds that stand for "after everything".
FAR = 4_000_000_000_000_000


class TimedStep:
    """A pure step over JSON-able state; times are microseconds.  `None` is the state of a key that keeps nothing."""

    def step(self, state: Any, row: dict) -> tuple[Any, list[tuple]]:
        raise NotImplementedError

    def due(self, state: Any) -> int | None:
        """When the step wants to be woken; it is before any row of that time."""
        return None

    def expire(self, state: Any) -> tuple[Any, list[tuple]]:
        """At the deadline: the next state, with a later deadline or none, and the rows to emit."""
        return None, []


@dataclass
class Phrases(TimedStep):
    """Closes a phrase at a pause, by silence alone, or when the next segment would make it too long.

    Emits start, end and the number of segments.
    """

    start: str
    end: str
    pause: int = 600_000
    longest: int = 15_000_000

    def step(self, state, row):
        a, b = row[self.start], row[self.end]
        if state is None:
            return [a, b, 1], []
        if b - state[0] >= self.longest:
            return [a, b, 1], [tuple(state)]
        return [state[0], max(b, state[1]), state[2] + 1], []

    def due(self, state):
        return None if state is None else state[1] + self.pause

    def expire(self, state):
        return None, [tuple(state)]


@dataclass
class Batches(TimedStep):
    """Emits a batch at the row that makes it old enough and large enough, or what there is after `most`.

    Emits the batch's last time (its deadline, if that closed it), characters and rows.
    """

    at: str
    chars_of: str
    least: int = 900_000_000
    chars: int = 800
    most: int = 3_600_000_000

    def step(self, state, row):
        since, size, n = state or (row[self.at], 0, 0)
        size, n = size + row[self.chars_of], n + 1
        if row[self.at] - since >= self.least and size >= self.chars:
            return None, [(row[self.at], size, n)]
        return [since, size, n], []

    def due(self, state):
        return None if state is None else state[0] + self.most

    def expire(self, state):
        return None, [(state[0] + self.most, state[1], state[2])]


@dataclass
class Silence(TimedStep):
    """Emits the last time of a source, and when it was given up, after `misses` looks of `every` without a row."""

    at: str
    every: int
    misses: int = 2

    def step(self, state, row):
        return row[self.at], []

    def due(self, state):
        return None if state is None else state + self.misses * self.every

    def expire(self, state):
        return None, [(state, state + self.misses * self.every)]


def _woken(timed: TimedStep, state: Any, until: int | None) -> tuple[Any, list[tuple]]:
    """Wakes the step at every deadline up to `until` (all, if None)."""
    out: list[tuple] = []
    while (due := timed.due(state)) is not None and (until is None or due <= until):
        state, made = timed.expire(state)
        out += made
    return state, out


def timed_folded(df: DataFrame, keys: Sequence[str], at: str, order: Sequence[str], timed: TimedStep, out: str) -> DataFrame:
    """What the step emits for each key, behind the key's columns (batch); rows with a null time take no part."""
    schema = T.StructType([df.schema[k] for k in keys] + list(T.StructType.fromDDL(out).fields))
    rows = df.where(F.col(at).isNotNull()).repartition(*keys).sortWithinPartitions(*keys, at, *order)
    names, columns = schema.names, df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            made: list[tuple] = []
            for values in zip(*(batch[c].tolist() for c in columns), strict=True):
                row = dict(zip(columns, values, strict=True))
                key = tuple(row[k] for k in keys)
                if key != now:
                    made += [(*now, *x) for x in _woken(timed, state, None)[1]] if now is not None else []
                    now, state = key, None
                state, woken = _woken(timed, state, row[at])
                state, emitted = timed.step(state, row)
                made += [(*key, *x) for x in [*woken, *emitted]]
            if made:
                yield pd.DataFrame(made, columns=names)
        if now is not None and (made := [(*now, *x) for x in _woken(timed, state, None)[1]]):
            yield pd.DataFrame(made, columns=names)

    return rows.mapInPandas(run, schema)


class _Ordered(StatefulProcessor):
    """Rows wait for the watermark, then run through the step in order; one timer a key, at what comes next."""

    def __init__(self, keys: Sequence[str], columns: Sequence[str], at: str, order: Sequence[str], timed: TimedStep, names: Sequence[str]):
        self.keys, self.columns, self.at, self.order, self.timed, self.names = list(keys), list(columns), at, list(order), timed, list(names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "row string")
        self.state = handle.getValueState("state", "state string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues):
        waiting = [tuple(r)[: len(self.columns)] for r in rows]
        self.rows.appendList(self._packed(waiting))
        place = self.columns.index(self.at)
        self._timer([min(r[place] for r in waiting)])
        return iter(())

    def _packed(self, rows: list[Sequence]) -> list[tuple[str]]:
        """Elements of the state, each up to PACKED rows: one of its own for each row costs more than the row."""
        return [(json.dumps(rows[i : i + PACKED]),) for i in range(0, len(rows), PACKED)]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        until = timerValues.getCurrentWatermarkInMs() * 1000
        kept = (dict(zip(self.columns, r, strict=True)) for pack in self.rows.get() for r in json.loads(pack[0]))
        waiting = sorted(kept, key=lambda r: [r[c] for c in (self.at, *self.order)])
        ready = [r for r in waiting if r[self.at] <= until]
        before = self.state.get()
        state, out = json.loads(before[0]) if before else None, []
        for row in ready:
            state, woken = _woken(self.timed, state, row[self.at])
            state, emitted = self.timed.step(state, row)
            out += [*woken, *emitted]
        state, woken = _woken(self.timed, state, until)
        for made in [*out, *woken]:
            yield Row(**dict(zip(self.names, (*key, *made), strict=True)))
        left = waiting[len(ready) :]
        if ready:
            self.rows.put(self._packed([[r[c] for c in self.columns] for r in left])) if left else self.rows.clear()
        self.state.update((json.dumps(state),)) if state is not None else self.state.clear()
        self._timer([r[self.at] for r in left[:1]] + [d for d in [self.timed.due(state)] if d is not None], until)

    def _timer(self, times: list[int], after: int | None = None) -> None:
        """One timer, at the earliest of `times` and of a timer that is set and has not passed."""
        if not times:
            return
        wanted = -(-min(times) // 1000)
        for each in list(self.handle.listTimers()):
            if after is None or each * 1000 > after:
                if each <= wanted:
                    return
                self.handle.deleteTimer(each)
        self.handle.registerTimer(wanted)


def timed_stream(stream: DataFrame, keys: Sequence[str], at: str, delay: str, order: Sequence[str], timed: TimedStep, out: str) -> DataFrame:
    """The same over a stream whose column `at` is microseconds since 1970; rows later than `delay` are dropped.

    Columns must be JSON-able, times after 1970: the first watermark is there.  Rows at or beyond FAR only move the watermark.
    """
    schema = T.StructType([stream.schema[k] for k in keys] + list(T.StructType.fromDDL(out).fields))
    columns = [c for c in stream.columns if c != "event_time"]
    rows = stream.withColumn("event_time", F.timestamp_micros(at)).withWatermark("event_time", delay).where(F.col("event_time") < F.timestamp_micros(F.lit(FAR)))
    processor = _Ordered(keys, columns, at, order, timed, schema.names)
    return rows.select(*columns, "event_time").groupBy(*keys).transformWithState(processor, schema, "Append", "EventTime")


def feed(spark: SparkSession, schema: T.StructType, name: str) -> str:
    """A new folder that a stream reads."""
    folder = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(folder)
    return folder


def ended(rows: DataFrame, at: str) -> DataFrame:
    """One row from far ahead, after which every deadline has passed."""
    return rows.sparkSession.range(1).select(*(F.lit(FAR if c == at else None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns))


def run(stream: DataFrame, folder: str) -> None:
    """One start over what the stream's source holds now, on the checkpoint and the table under `folder`."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        sink = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/rows")
        sink.trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def streamed(df: DataFrame, keys: Sequence[str], at: str, delay: str, order: Sequence[str], timed: TimedStep, out: str, name: str) -> DataFrame:
    """All that a step emits over a table that is fed to a stream and then ends."""
    spark = df.sparkSession
    source = feed(spark, df.schema, name)
    df.unionByName(ended(df, at)).write.mode("append").parquet(source)
    stream = timed_stream(spark.readStream.schema(df.schema).parquet(source), keys, at, delay, order, timed, out)
    run(stream, f"{source}-out")
    return spark.read.schema(stream.schema).parquet(f"{source}-out/rows")


def overlapping(phrases: DataFrame, spans: DataFrame, stream: str, phrase: str, label: str, delay: str, longest: str) -> DataFrame:
    """(stream, phrase, label, overlap): pairs of two streams whose times overlap, in seconds.

    Both have `start` and `end` timestamps of at most `longest`, which bounds what either side keeps: a row leaves the
    state when the watermark has passed all that could meet it.  Rows of either side may come first, late within `delay`.
    Rows meet within SLICE times `longest`, so a row looks at few of its stream's kept rows: a phrase is in the slice of
    its start, a span in each slice, one or two, where a phrase that it could meet starts.
    """
    span = F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"interval {longest}"))
    part = lambda us: F.floor(us / (SLICE * span))
    a = phrases.select(F.col(stream).alias("_s"), phrase, F.col("start").alias("p0"), F.col("end").alias("p1")).withWatermark("p0", delay)
    a = a.withColumn("_slice", part(F.unix_micros("p0")))
    b = spans.select(stream, label, F.col("start").alias("q0"), F.col("end").alias("q1")).withWatermark("q0", delay)
    b = b.withColumn("_part", F.explode(F.sequence(part(F.unix_micros("q0") - span), part(F.unix_micros("q0") + span))))
    near = F.expr(f"q0 >= p0 - interval {longest} and q0 <= p0 + interval {longest}")
    met = a.join(b, (F.col("_s") == F.col(stream)) & (F.col("_slice") == F.col("_part")) & near & (F.col("q0") < F.col("p1")) & (F.col("p0") < F.col("q1")))
    return met.select(stream, phrase, label, ((F.unix_micros(F.least("p1", "q1")) - F.unix_micros(F.greatest("p0", "q0"))) / 1e6).alias("overlap"))


def longest_overlap(pairs: DataFrame, stream: str, phrase: str, label: str) -> DataFrame:
    """The second step: each phrase's label with the longest overlap in all, ties to the least."""
    total = pairs.groupBy(stream, phrase, label).agg(F.round(F.sum("overlap"), 6).alias("overlap"))
    best = total.groupBy(stream, phrase).agg(F.min_by(F.struct(label, "overlap"), F.struct(-F.col("overlap"), F.col(label))).alias("m"))
    return best.select(stream, phrase, F.col(f"m.{label}").alias(label), F.col("m.overlap").alias("overlap"))
