"""Streaming flows: high-water marks, slots, sessions, late rows, staleness and health."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.operators.retrieval import shared_folder


def since(df: DataFrame, marks: DataFrame, by: str, key: str) -> DataFrame:
    """Rows above their group's high-water mark; all rows of a group without one."""
    known = marks.select(by, F.col("mark").alias("_m"))
    return df.join(known, by, "left").where(F.col("_m").isNull() | (F.col(key) > F.col("_m"))).drop("_m")


def advanced(df: DataFrame, marks: DataFrame, by: str, key: str) -> DataFrame:
    """The next marks: the greatest key seen, relevant or not, never lower than before."""
    seen = df.groupBy(by).agg(F.max(key).alias("_s"))
    return marks.join(seen, by, "full").select(by, F.greatest("mark", "_s").alias("mark"))


def since_last_success(rows: DataFrame, at: str, runs: DataFrame, default: Column) -> DataFrame:
    """Rows newer than the last successful run of any slot."""
    last = runs.where("ok").agg(F.coalesce(F.max("finished_at"), default).alias("_t"))
    return rows.crossJoin(F.broadcast(last)).where(F.col(at) > F.col("_t")).drop("_t")  # one row


def once_per_version(df: DataFrame, key: Sequence[str], content: Column) -> DataFrame:
    """One row for each version of a key's content (X4); in a stream, state of one hash a version."""
    return df.withColumn("version", F.sha1(content)).dropDuplicates([*key, "version"])


def sessions(events: DataFrame, at: str, keys: Sequence[str], gap: str, delay: str | None = None) -> DataFrame:
    """Gap sessions; with a delay, over a stream with a watermark."""
    rows = events.withWatermark(at, delay) if delay else events
    out = rows.groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def fingerprint(text: Column, first: int = 5, last: int = 25) -> Column:
    """Hash of a text's words `first` to `last`, by which a repeated advert is known (X11)."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return F.sha1(F.array_join(F.slice(words, first, last - first + 1), " "))


def without_repeats(stream: DataFrame, at: str, delay: str, key: Sequence[str]) -> DataFrame:
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(key))


def late_split(df: DataFrame, event_at: str, seen_at: str, days: int) -> DataFrame:
    """Rows with `late`: older than so many days when they were first seen; they are marked, not processed."""
    return df.withColumn("late", F.coalesce(F.col(seen_at) - F.make_interval(days=F.lit(days)) > F.col(event_at), F.lit(False)))


def staleness(df: DataFrame, by: str, at: str, as_of: Column) -> DataFrame:
    """Hours since each group's last row."""
    last = df.groupBy(by).agg(F.max(at).alias("last"))
    return last.withColumn("hours", (as_of.cast("double") - F.col("last").cast("double")) / 3600)


def health_changes(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """Problems that are new or resolved since the last look."""
    a, b = before.select(key).distinct().withColumn("_a", F.lit(1)), now.select(key).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, key, "full").where(F.col("_a").isNull() | F.col("_b").isNull())
    return both.select(key, F.when(F.col("_a").isNull(), "new").otherwise("resolved").alias("state"))


def run_states(runs: DataFrame, by: str, as_of: Column, minutes: int = 15) -> DataFrame:
    """running, finished or stalled for each source's latest run, and minutes since its last finish."""
    started = F.max_by(F.struct("started_at", "finished_at"), F.struct("started_at", F.col("finished_at").isNull())).alias("r")
    last = runs.groupBy(by).agg(started, F.max("finished_at").alias("last_finish"))
    recent = F.col("r.started_at") >= as_of - F.make_interval(mins=F.lit(minutes))
    state = F.when(F.col("r.finished_at").isNotNull(), "finished").when(recent, "running").otherwise("stalled")
    since_end = F.floor((as_of.cast("double") - F.col("last_finish").cast("double")) / 60)
    return last.select(by, state.alias("state"), since_end.alias("minutes"))


def materialised(spark: SparkSession, sections: dict[str, Callable[[], DataFrame]], write: Callable[[str, DataFrame], None]) -> dict[str, str]:
    """Recomputes every section; one that fails keeps its last good version and is reported."""
    out = {}
    for name, build in sections.items():
        try:
            write(name, build())
            out[name] = "ok"
        except Exception as error:  # the section's own failure must not stop the others
            out[name] = f"{type(error).__name__}: {error}"[:200]
    return out


def replayed(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """All rows that a stream emits over what its source holds now.

    Batches are written to the shared folder, each under its number, so one that is run again replaces itself; of a
    complete result only the last counts.
    """
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/streams/{name}"

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/batch={n if mode == 'append' else 0}")

    put(spark.createDataFrame([], stream.schema), -1)
    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{root}/checkpoint").foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows/batch=*")
