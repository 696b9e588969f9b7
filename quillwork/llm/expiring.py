"""Expiring click deduplication (operator 13): a stateful stream of hashed buckets with a timing wheel.

Ids are hashed to buckets.  A bucket keeps two maps, from id to its open window and from deadline hour to the ids whose
windows end then (the timing wheel), and one timer at its first deadline; when the watermark has passed the timer, the due
slots are drained and the timer moves to the next one.  The watermark is the largest hour of earlier batches less the
lateness, so what a batch has made expire is drained in the next run, and counts as closed after the batch before it.

A bucket's windows are read in one pass when rows come for it.  Windows that its own latest row already makes expire are
handed out at once and not stored: the batch's watermark can only be later.  The number of buckets grows with the input,
so a bucket's rows of a batch and its state stay small.  All rows of one id are one bucket's, since their order decides.

A row of a stateful Python operator costs as much as its conversion, so rows are packed by bucket, batch by batch, before
they reach the state, and closed windows leave it as columns.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .common import _delete, scratch, table
from .oracles import OP13

#: Hours that a window reaches beyond its first row; hours that rows may be late; batches of the query.
REACH, LATE, BATCHES = 48, 24, 10
#: Rows of a bucket, and the fewest buckets.
BUCKET_ROWS, FEWEST = 200_000, 48
HOUR_MS = 3_600_000
#: Hours between the event time's origin and the first row, beyond the lateness, so that the first watermark drops nothing.
BEFORE = 10_000

COPY = "click_id long, hour long, digest binary, bucket int, at timestamp"
#: One copy, as it is packed.
COPY_ROW = np.dtype([("id", "<i8"), ("hour", "<i8"), ("digest", "V32")])
#: Columns of closed windows.
COLUMNS = ("click_id", "start_hour", "n_repeats", "n_conflicts", "conflict_crc", "digest")
WINDOW = "start_hour long, n_repeats long, n_conflicts long, conflict_crc long, hash binary"
CLOSED = "click_id long, start_hour long, n_repeats long, n_conflicts long, conflict_crc long, hash string, closed_batch long"
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # the next start drains what a batch has made expire, so no run without data is needed for that
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    # every start opens its stores anew: those of earlier starts would keep their files
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    # all stores of an executor share this memory
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


class ExpiringWindows(StatefulProcessor):
    """Rows (bucket, id, hour, digest, event time) to closed windows; `origin` is the hour of event time 0."""

    def __init__(self, origin: int, reach: int = REACH, late: int = LATE):
        self.origin, self.reach, self.late = origin, reach, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getMapState("windows", "click_id long", WINDOW)
        self.wheel = handle.getMapState("wheel", "deadline_hour long", "ids array<long>")

    def close(self) -> None:
        pass

    def _timer(self, deadline: int) -> int:
        """Half an hour after the deadline: before a later deadline's watermark, after its own."""
        return (deadline - self.origin) * HOUR_MS + HOUR_MS // 2

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        copies = np.concatenate([np.frombuffer(r[1], COPY_ROW) for r in rows])
        if mark > 0:  # earlier hours are late
            copies = copies[copies["hour"] > mark // HOUR_MS + self.origin]
        if not len(copies):
            return
        places = np.ascontiguousarray(copies["digest"]).view(">u8").reshape(-1, 4).astype(np.uint64)
        copies = copies[np.lexsort((*places.T[::-1], copies["hour"], copies["id"]))]
        raw = np.ascontiguousarray(copies["digest"]).tobytes()
        stored = {k[0]: [*v[:4], bytes(v[4])] for k, v in self.windows.iterator()}
        now = {one: list(w) for one, w in stored.items() if self._timer(w[0] + self.reach) > mark}
        before = [(one, *w) for one, w in stored.items() if one not in now]
        closed: list[tuple] = []
        at = 0
        for one, hour in zip(copies["id"].tolist(), copies["hour"].tolist(), strict=True):
            digest = raw[at : at + 32]
            at += 32
            w = now.get(one)
            if w is None:
                now[one] = [hour, 0, 0, 0, digest]
            elif hour <= w[0] + self.reach:
                w[1] += 1
                if digest != w[4]:
                    w[2] += 1
                    w[3] += zlib.crc32(digest.hex().encode())
            else:
                closed.append((one, *w))
                now[one] = [hour, 0, 0, 0, digest]
        gone = int(copies["hour"].max()) - self.late - self.reach  # starts before this have expired after this batch
        closed += [(one, *w) for one, w in now.items() if w[0] < gone]
        now = {one: w for one, w in now.items() if w[0] >= gone}
        self._keep(stored, now)
        if before:
            yield _packed(before, False)
        if closed:
            yield _packed(closed, True)

    def _keep(self, stored: dict[int, list], now: dict[int, list]) -> None:
        """Writes what has changed, or everything anew if that is less."""
        slots = defaultdict(list)
        for one, w in now.items():
            slots[w[0] + self.reach].append(one)
        gone = stored.keys() - now.keys()
        changed = {one for one, w in now.items() if stored.get(one) != w}
        if len(gone) + len(changed) > len(now):
            self.windows.clear()
            self.wheel.clear()
            changed, touched = set(now), set(slots)
        else:
            moved = [one for one in changed if one not in stored or stored[one][0] != now[one][0]]
            touched = {now[one][0] + self.reach for one in moved}
            touched |= {stored[one][0] + self.reach for one in [*gone, *(o for o in moved if o in stored)]}
            for one in gone:
                self.windows.removeKey((one,))
        for one in changed:
            self.windows.updateValue((one,), tuple(now[one]))
        for deadline in touched:
            if deadline in slots:
                self.wheel.updateValue((deadline,), (slots[deadline],))
            else:
                self.wheel.removeKey((deadline,))
        wanted = self._timer(min(slots)) if slots else None
        set_for = list(self.handle.listTimers())
        for each in set_for:
            if each != wanted:
                self.handle.deleteTimer(each)
        if wanted is not None and wanted not in set_for:
            self.handle.registerTimer(wanted)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        deadlines = sorted(d for (d,) in self.wheel.keys())
        due = [d for d in deadlines if self._timer(d) <= mark]
        closed: list[tuple] = []
        if len(due) == len(deadlines):  # the whole wheel
            closed = [(one, *w) for (one,), w in self.windows.iterator()]
            self.windows.clear()
            self.wheel.clear()
        else:
            for deadline in due:
                for one in self.wheel.getValue((deadline,))[0]:
                    closed.append((one, *self.windows.getValue((one,))))
                    self.windows.removeKey((one,))
                self.wheel.removeKey((deadline,))
            self.handle.registerTimer(self._timer(deadlines[len(due)]))
        if closed:
            yield _packed(closed, False)


def _packed(closed: list[tuple], now: bool) -> Row:
    """Windows closed in this batch, or after the one before it, as one row of columns: a row of its own for each would cost more than what was counted."""
    return Row(now=now, **dict(zip(COLUMNS, map(list, zip(*closed, strict=True)), strict=True)))


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (click_id, hour, digest, bucket) to one row per bucket of each batch: bucket, copies."""
    for batch in batches:
        if not batch.num_rows:
            continue
        out = np.empty(batch.num_rows, COPY_ROW)
        out["id"], out["hour"] = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        digests = batch.column(2).cast(pa.binary(32))
        out["digest"] = np.frombuffer(digests.buffers()[1], "V32")[digests.offset : digests.offset + len(out)]
        bucket = batch.column(3).to_numpy()
        order = np.argsort(bucket, kind="stable")
        names, first = np.unique(bucket[order], return_index=True)
        parts = [x.tobytes() for x in np.split(out[order], first[1:])]
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(names, pa.int32()), "copies": pa.array(parts, pa.binary())})


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 in UTC of a timestamp with or without zone."""
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{name}`)")
    return F.unix_micros(name)


def copies(clicks: DataFrame) -> DataFrame:
    """(click_id, hour, digest, at_hour) of copies j = 0 to click_id % 3 of every row, with jittered hours.

    Null ids and negative remainders have no copies; a null arrival has no hour and is in no batch.
    """
    plain = clicks.withColumns({"_arrived": micros(clicks, "arrived_at"), "_ts": micros(clicks, "ts")})
    each = plain.where("click_id % 3 >= 0 AND arrived_at IS NOT NULL").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("click_id") % 3)))
    each = each.withColumn("c", F.crc32(F.concat_ws(":", F.col("click_id").cast("string"), F.col("j").cast("string"))))
    hour = F.expr("(_arrived - pmod(_arrived, 3600000000L)) div 3600000000L")
    told = [F.col("client_id").cast("string"), F.col("kind"), F.floor(100 * F.col("value") + 0.5).cast("string"), F.col("_ts").cast("string"), F.col("props"), (F.col("c") % 3).cast("string")]
    said = F.concat_ws("|", *(F.coalesce(x, F.lit("")) for x in told))
    out = each.withColumn("hour", hour + 6 * F.col("j") * (F.col("c") % 10))
    return out.select("click_id", "hour", F.unhex(F.sha2(said, 256)).alias("digest"), (F.col("hour") + F.expr("c div 10") % 200).alias("at_hour"))


def deduplicate(rows: DataFrame, batches: int = BATCHES, reach: int = REACH, late: int = LATE) -> DataFrame:
    """Closed windows of rows (click_id, hour, digest, at_hour), which come in `batches` batches by at_hour.

    One row per window: click_id, start_hour, closed_batch, n_repeats, n_conflicts, conflict_crc, hash.  A window opens
    with a row (of one hour the smallest digest first) and takes rows up to `reach` hours after it as repeats; a conflict
    is a repeat of another digest.  Rows more than `late` hours before the latest hour of earlier batches are dropped;
    windows that end before that close after the batch, all others after the last one.  The stream is started anew for
    every batch on one checkpoint, so it goes on from any of them.

    Repeated rows are repeats; rows with a null id, hour or at_hour take no part; an empty table gives no windows; other
    columns are not looked at.
    """
    spark = rows.sparkSession
    rows = rows.select("click_id", "hour", "digest", "at_hour").where("click_id is not null and hour is not null and at_hour is not null")
    edge = rows.agg(F.min("at_hour").alias("low"), F.max("at_hour").alias("high"), F.min("hour").alias("first"), F.max("hour").alias("last"), F.count("*").alias("n")).first()
    order = ["click_id", "start_hour", "closed_batch", "n_repeats", "n_conflicts", "conflict_crc", "hash"]
    if not edge.n:
        return spark.createDataFrame([], CLOSED).select(order)
    origin, end = edge["first"] - BEFORE, edge["last"] + BEFORE + reach + late
    at = lambda hour: F.timestamp_millis((hour - origin) * HOUR_MS)
    batch = F.expr(f"(at_hour - {edge.low}L) * {batches} div {edge.high - edge.low + 1}L").cast("int")
    bucket = F.pmod(F.xxhash64("click_id"), F.lit(max(FEWEST, -(-edge.n // BUCKET_ROWS)))).cast("int")
    folder = scratch(spark, "clicks")
    fed = rows.select("click_id", "hour", "digest", bucket.alias("bucket"), at(F.col("hour")).alias("at"), batch.alias("batch"))
    fed.write.partitionBy("batch").parquet(f"{folder}/batches")
    last = spark.range(1).select(F.lit(None).cast("long").alias("click_id"), F.lit(end).cast("long").alias("hour"), F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("bucket"))
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        seen, ends = 0, [batches, batches + 1]
        end_row = last.withColumn("at", at(F.col("hour")))  # from far ahead: all windows have expired in the run after it
        for k in range(batches):
            if not _moved(spark, f"{folder}/batches/batch={k}", f"{folder}/feed/batch={k}"):
                continue  # nothing comes, nothing closes
            if k + 1 == batches:
                end_row.write.mode("append").parquet(f"{folder}/feed/batch={k}")
                ends = ends[1:]
            _start(spark, folder, k, seen, origin, end, reach, late)
            seen = k
        for k in ends:  # the first of two drains what the last batch that came has made expire
            end_row.write.parquet(f"{folder}/feed/batch={k}")
            _start(spark, folder, k, seen if k == batches else batches - 1, origin, end, reach, late)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for used in ("batches", "feed", "state"):
        _delete(spark, f"{folder}/{used}")
    return spark.read.schema(CLOSED).parquet(f"{folder}/closed").select(order)


def _start(spark: SparkSession, folder: str, k: int, before: int, origin: int, end: int, reach: int, late: int) -> None:
    """One start of the query, on what the feed holds and the checkpoint has not seen; `before` is the batch before batch k."""
    rows = spark.readStream.schema(COPY).parquet(f"{folder}/feed").withWatermark("at", f"{late * HOUR_MS + 1} milliseconds")
    rows = rows.where(F.col("at") < F.timestamp_millis(F.lit((end - origin) * HOUR_MS))).select("click_id", "hour", "digest", "bucket")
    kind = "now boolean, " + ", ".join(f"{c} array<{'binary' if c == 'digest' else 'long'}>" for c in COLUMNS)
    packed = rows.mapInArrow(pack, "bucket int, copies binary")
    closed = packed.groupBy("bucket").transformWithState(ExpiringWindows(origin, reach, late), kind, "Append", "EventTime")
    hashed = closed.select("now", F.inline(F.arrays_zip(*COLUMNS))).select(*COLUMNS[:-1], F.lower(F.hex("digest")).alias("hash"), F.when(F.col("now"), k).otherwise(before).cast("long").alias("closed_batch"))
    sink = hashed.writeStream.format("parquet").outputMode("append")
    sink.option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/closed").trigger(availableNow=True).start().awaitTermination()


def _moved(spark: SparkSession, path: str, to: str) -> bool:
    """Moves a folder on the shared store; whether there was one."""
    jvm = spark.sparkContext._jvm
    old, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(to)
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(old):
        return False
    fs.mkdirs(new.getParent())
    return fs.rename(old, new)


def op13_click_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(copies(table(spark, sf_dir, "clicks")))


QUERIES = {"op13_click_windows": op13_click_windows}
ORACLES = {"op13_click_windows": OP13}
