"""Pluggable judges and embedders: interface, batching, sanity of answers, retries, fallbacks.

A judge is any callable from a list of prompts to a list of answers (index, verdict).  Models and remote services are the
caller's; the stubs here are deterministic and run offline.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillwork.session import bounded_batches

#: Segments that leave a recogniser at a time.
PIECE = 2_000

Judge = Callable[[Sequence[str]], Sequence[tuple[int, bool]]]


def keyword_judge(words: Sequence[str]) -> Judge:
    """Says yes to prompts that hold a word."""
    return lambda prompts: [(i, any(w in p.lower() for w in words)) for i, p in enumerate(prompts)]


def failing_judge(prompts: Sequence[str]) -> Sequence[tuple[int, bool]]:
    raise RuntimeError("no model here")


def answered(prompts: Sequence[str], judges: Sequence[Judge], tries: int = 2) -> list[bool | None]:
    """One verdict a prompt from the first judge that answers; an index that is missing, repeated or out of range gives null."""
    for judge in judges:
        for _ in range(tries):
            try:
                answers = list(judge(prompts))
            except Exception:  # a judge's failure is what the next one is for
                continue
            out: list[bool | None] = [None] * len(prompts)
            seen: set[int] = set()
            for i, verdict in answers:
                if 0 <= i < len(prompts):
                    out[i] = None if i in seen else bool(verdict)
                    seen.add(i)
            return out
    return [None] * len(prompts)


def judged(df: DataFrame, key: str, prompt: str, judges: Sequence[Judge], batch: int = 30, out: str = "verdict") -> DataFrame:
    """key and verdict of every row, in batches of at most `batch` prompts (C4: 35 prompts are two batches)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            verdicts: list[bool | None] = []
            for a in range(0, len(rows), batch):
                verdicts += answered(rows["prompt"].iloc[a : a + batch].fillna("").tolist(), judges)
            yield pd.DataFrame({"key": rows["key"], "verdict": pd.Series(verdicts, dtype="object", index=rows.index)})

    plain = df.select(F.col(key).alias("key"), F.col(prompt).alias("prompt"))
    return plain.mapInPandas(run, f"key {kind}, verdict boolean").toDF(key, out)


def with_found(df: DataFrame, gate: Column, source: str, fetch: Callable[[str], str | None], out: str) -> DataFrame:
    """The rows with what `fetch` finds for their source where the gate holds, else null; no other row reaches Python.

    Whole rows travel with what was found, so repeated and null keys are no matter; a null source finds nothing.
    """
    at = df.columns.index(source)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [None if s is None else fetch(s) for s in rows.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.string())], schema.names)

    open_ = F.coalesce(gate, F.lit(False))
    return df.where(open_).mapInArrow(run, schema).unionByName(df.where(~open_).withColumn(out, F.lit(None).cast("string")))


def backfilled(df: DataFrame, source: str, value: str, fetch: Callable[[str], str | None]) -> DataFrame:
    """Rows with their null values fetched; nothing is invented where the fetch finds nothing."""
    found = with_found(df, F.col(value).isNull(), source, fetch, "_found")
    return found.withColumn(value, F.coalesce(value, "_found")).drop("_found")


Recogniser = Callable[[str], Sequence[tuple[float, float, str, float, float, str | None]]]


def stub_recogniser(words: int = 50) -> Recogniser:
    """Reads a text as if it were sound: a segment every so many words, half a second a word, one voice."""

    def recognise(sound: str) -> list[tuple[float, float, str, float, float, str | None]]:
        said = sound.split()
        parts = [said[i : i + words] for i in range(0, len(said), words)]
        return [(words * i / 2, (words * i + len(x)) / 2, " ".join(x), 0.1, -0.2, "S1") for i, x in enumerate(parts)]

    return recognise


def recognised(df: DataFrame, key: str, sound: str, recogniser: Recogniser) -> DataFrame:
    """A recogniser's segments of every recording: key, start, end, said, no_speech, logprob, voice.

    Recordings are read one by one on the executors; a null one, or one that the recogniser fails on, has no segments.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def heard(k, sound: str) -> list[tuple]:
            try:
                return [(k, *x) for x in recogniser(sound)] if sound is not None else []
            except Exception:  # one broken recording must not stop the others
                return []

        for rows in batches:
            found = (x for k, sound in zip(rows["key"], rows["sound"], strict=True) for x in heard(k, sound))
            while out := list(islice(found, PIECE)):
                yield pd.DataFrame(out, columns=["key", "start", "end", "said", "no_speech", "logprob", "voice"])

    bounded_batches(df.sparkSession)
    plain = df.select(F.col(key).alias("key"), F.col(sound).alias("sound"))
    return plain.mapInPandas(run, f"key {kind}, start double, end double, said string, no_speech double, logprob double, voice string").withColumnRenamed("key", key)
