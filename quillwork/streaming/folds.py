"""Stateful operators as pure steps, run over sorted batches or as Structured Streaming state.

A step takes a JSON-able state and a row and returns the next state and the rows to emit.  In batch, rows of a key are
sorted within their partition and streamed through, so a key of any size needs the memory of its state.  In a stream the
same step runs in applyInPandasWithState.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillwork.session import bounded_batches

#: Rows of a key that are rows of Python at a time.
PIECE = 2_000

Step = Callable[[Any, dict], tuple[Any, list[tuple]]]
Flush = Callable[[Any], list[tuple]]


def folded(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step, out: str, flush: Flush | None = None) -> DataFrame:
    """The rows that a step emits for each key in the given order, behind the key's columns (batch)."""
    schema = T.StructType([df.schema[k] for k in keys] + list(T.StructType.fromDDL(out).fields))
    bounded_batches(df.sparkSession)
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    names = schema.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            made: list[tuple] = []
            for row in batch.to_dict("records"):
                key = tuple(row[k] for k in keys)
                if key != now:
                    made += [(*now, *x) for x in flush(state)] if flush and now is not None else []
                    now, state = key, None
                state, emitted = step(state, row)
                made += [(*key, *x) for x in emitted]
            if made:
                yield pd.DataFrame(made, columns=names)
        if flush and now is not None and (made := [(*now, *x) for x in flush(state)]):
            yield pd.DataFrame(made, columns=names)

    return rows.mapInPandas(run, schema)


def _placed(rows: pd.DataFrame, order: Sequence[str]) -> np.ndarray:
    """The rows' places in the order, ties as they came; numbers are sorted without a copy of the rows."""
    if all(rows[c].dtype.kind in "iufM" for c in order):
        return np.lexsort([rows[c].to_numpy() for c in reversed(order)])
    return rows[list(order)].reset_index(drop=True).sort_values(list(order), kind="stable").index.to_numpy()


def folded_stream(stream: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step, out: str) -> DataFrame:
    """The same step over a stream: each key's state is kept as JSON; rows of a micro-batch run in the given order.

    A key's rows of one micro-batch wait as plain columns, without the key; at most PIECE of them are rows of Python, and
    what they emit leaves before the next.
    """
    schema = T.StructType([stream.schema[k] for k in keys] + list(T.StructType.fromDDL(out).fields))
    names = schema.names
    bounded_batches(stream.sparkSession)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else None
        rows = pd.concat((b.drop(columns=list(keys)) for b in batches), ignore_index=True)
        own, place = dict(zip(keys, key, strict=True)), _placed(rows, order)
        for i in range(0, len(place), PIECE):
            made: list[tuple] = []
            for row in rows.iloc[place[i : i + PIECE]].to_dict("records"):
                kept, emitted = step(kept, own | row)
                made += [(*key, *x) for x in emitted]
            if made:
                yield pd.DataFrame(made, columns=names)
        state.update((json.dumps(kept),))

    return stream.groupBy(*keys).applyInPandasWithState(run, schema, "state string", "append", "NoTimeout")


def cooldown(at: str, seconds: float, carry: Sequence[str] = ()) -> Step:
    """Emits a row if the key's last emitted one is at least so many seconds old."""

    def step(state: Any, row: dict) -> tuple[Any, list[tuple]]:
        if state is not None and row[at] - state < seconds:
            return state, []
        return row[at], [tuple(row[c] for c in (at, *carry))]

    return step


def words_of(text: str | None, least: int = 4) -> list[str]:
    plain = "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if not unicodedata.combining(c))
    return sorted({w for w in re.findall(r"\w+", plain) if len(w) >= least})


def unlike_recent(at: str, text: str, seconds: float, most: float = 0.5, carry: Sequence[str] = ()) -> Step:
    """Emits a row unless one emitted in the last `seconds` shares `most` or more of its words."""

    def step(state: Any, row: dict) -> tuple[Any, list[tuple]]:
        now, words = row[at], words_of(row[text])
        recent = [x for x in state or [] if now - x[0] <= seconds]
        mine = set(words)
        for _, other in recent:
            union = mine.union(other)
            if union and len(mine.intersection(other)) / len(union) >= most:
                return recent, []
        return [*recent, [now, words]], [tuple(row[c] for c in (at, *carry))]

    return step


def accumulated(text: str) -> Step:
    """Emits the running number of parts and characters (X6); the text itself is appended by the sink."""

    def step(state: Any, row: dict) -> tuple[Any, list[tuple]]:
        n, size = state or (0, 0)
        n, size = n + 1, size + len(row[text] or "")
        return [n, size], [(n, size)]

    return step


def phrases(start: str, end: str, pause: float = 0.6, longest: float = 15.0) -> tuple[Step, Flush]:
    """Closes a phrase at a pause or when it gets too long; emits start, end and its number of segments."""

    def step(state: Any, row: dict) -> tuple[Any, list[tuple]]:
        a, b = row[start], row[end]
        if state is None:
            return [a, b, 1], []
        if a - state[1] >= pause or b - state[0] >= longest:
            return [a, b, 1], [tuple(state)]
        return [state[0], max(b, state[1]), state[2] + 1], []

    return step, lambda state: [tuple(state)] if state else []


def batched(at: str, text: str, seconds: float = 900, chars: int = 800) -> Step:
    """Emits a batch when it is old enough and holds enough new characters (X8): time, characters, rows."""

    def step(state: Any, row: dict) -> tuple[Any, list[tuple]]:
        since, size, n = state or (row[at], 0, 0)
        size, n = size + len(row[text] or ""), n + 1
        if row[at] - since >= seconds and size >= chars:
            return [row[at], 0, 0], [(row[at], size, n)]
        return [since, size, n], []

    return step


def ended(at: str, alive: str, misses: int = 2) -> Step:
    """Emits the time when a source has been missed so many times in a row; an unknown answer counts as alive."""

    def step(state: Any, row: dict) -> tuple[Any, list[tuple]]:
        n = (state or 0) + 1 if row[alive] is False or row[alive] == 0 else 0
        return n, [(row[at],)] if n == misses else []

    return step


def seconds_of(ts: str) -> F.Column:
    return F.col(ts).cast("double")
