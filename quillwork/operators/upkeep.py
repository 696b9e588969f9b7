"""State kept between runs: refetch sets, ledgers, caches, inboxes, vector indexes, alerts sent.

Each operator takes the stored state and what is new, and returns the next state or the work to do; `sources.publish`
makes a returned state current.  `as_of` is always given.  Null keys match nothing; empty tables give no work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.functions.values import changed

from .judging import with_found


def days_before(as_of: Column, days: int) -> Column:
    return as_of - F.make_interval(days=F.lit(days))


def to_refetch(listing: DataFrame, stored: DataFrame, key: str, tracked: Sequence[str], as_of: Column, days: int, forced: Column | None = None) -> DataFrame:
    """key and reason of the listed rows whose detail is due: new, changed, never (fetched), old or forced.

    `stored` has the key, the tracked columns and fetched_at.
    """
    before = stored.select(key, F.lit(True).alias("_known"), "fetched_at", *[F.col(c).alias(f"_{c}") for c in tracked])
    both = listing.select(key, *tracked, (forced if forced is not None else F.lit(False)).alias("_forced")).join(before, key, "left")
    differs = F.lit(False)
    for c in tracked:
        differs = differs | changed(c, f"_{c}")
    reason = (
        F.when(F.col("_known").isNull(), "new").when(differs, "changed").when(F.col("fetched_at").isNull(), "never")
        .when(F.col("fetched_at") < days_before(as_of, days), "old").when(F.col("_forced"), "forced")
    )
    return both.withColumn("reason", reason).where("reason is not null").select(key, "reason")


def due(work: DataFrame, ledger: DataFrame, key: str, as_of: Column, most: int = 5, wait: int = 60) -> DataFrame:
    """Work that no success covers and whose last failure is long enough ago, `wait` seconds doubled by each try.

    A failure at an unknown time is long enough ago.

    `ledger` has the key, tries, tried_at and done; after `most` tries a piece of work is given up.
    """
    known = ledger.select(key, "tries", "tried_at", "done")
    rest = F.col("tried_at").cast("double") + wait * F.pow(F.lit(2.0), F.col("tries") - 1) <= as_of.cast("double")
    open_ = F.col("tries").isNull() | (~F.coalesce("done", F.lit(False)) & (F.col("tries") < most) & F.coalesce(rest, F.lit(True)))
    return work.join(known, key, "left").where(open_).drop("tries", "tried_at", "done")


def ledgered(ledger: DataFrame, outcomes: DataFrame, key: str, as_of: Column) -> DataFrame:
    """The next ledger after outcomes (key, ok): one try more, done for good once it went well."""
    new = outcomes.groupBy(key).agg(F.bool_or("ok").alias("_ok"))
    both = ledger.join(new, key, "full")
    tried = F.col("_ok").isNotNull()
    return both.select(
        key,
        (F.coalesce("tries", F.lit(0)) + tried.cast("int")).alias("tries"),
        F.when(tried, as_of).otherwise(F.col("tried_at")).alias("tried_at"),
        (F.coalesce("done", F.lit(False)) | F.coalesce("_ok", F.lit(False))).alias("done"),
    )


def seen_after(seen: DataFrame, candidates: DataFrame, delivered: DataFrame, key: str) -> DataFrame:
    """The next set of seen keys: candidates join it only if they were delivered."""
    sent = candidates.select(key).join(delivered.where("ok").select(key), key, "left_semi")
    return seen.select(key).union(sent).distinct()


def cached(cache: DataFrame, as_of: Column, good: int = 240, bad: int = 20) -> DataFrame:
    """Cache entries that still count: a good answer for `good` seconds, a failure for `bad`.

    `cache` has at and ok; an entry from the future counts.
    """
    age = as_of.cast("double") - F.col("at").cast("double")
    return cache.where(F.col("at").isNotNull() & (age < F.when(F.col("ok"), good).otherwise(bad)))


def inbox(state: DataFrame, changes: DataFrame, owner: str, key: str, at: str, as_of: Column, days: int = 45, most: int = 100) -> DataFrame:
    """The next version of owners' inboxes: changes win over what they had, old entries go, the latest `most` stay (C14).

    A change with a null `body` takes its entry out; owners without changes are written as they were, less old entries.
    """
    both = state.withColumn("_n", F.lit(0)).unionByName(changes.withColumn("_n", F.lit(1)))
    last = Window.partitionBy(owner, key).orderBy(F.desc("_n"), F.desc(at), "body")
    held = both.withColumn("_r", F.row_number().over(last)).where(F.col("_r") == 1).where(F.col("body").isNotNull() & (F.col(at) >= days_before(as_of, days)))
    newest = Window.partitionBy(owner).orderBy(F.desc(at), key)
    return held.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= most).drop("_n", "_r")


def as_documents(state: DataFrame, owner: str, order: Sequence[Column]) -> DataFrame:
    """Each owner's entries as one JSON document, in order."""
    rest = [c for c in state.columns if c != owner]
    place = F.row_number().over(Window.partitionBy(owner).orderBy(*order))
    rows = state.select(owner, F.struct(place.alias("n"), F.struct(*rest).alias("e")).alias("s"))
    return rows.groupBy(owner).agg(F.to_json(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["e"])).alias("document"))


def index_refreshed(index: DataFrame, items: DataFrame, key: str, model: str, embed: Callable[[Column], Column]) -> DataFrame:
    """The next vector index: key, hash, model, vector and change (insert, update, model or same) (V6, V7).

    `items` has the key, hash and text; `index` the key, hash, model and vector.  Only rows that are new, whose text
    changed, or whose vector comes from another model are embedded; rows without an item leave the index.
    """
    held = index.select(key, F.col("hash").alias("_hash"), F.col("model").alias("_model"), F.col("vector").alias("_vector"))
    both = items.select(key, "hash", "text").join(held, key, "left")
    change = (
        F.when(F.col("_hash").isNull(), "insert").when(~F.col("_hash").eqNullSafe(F.col("hash")), "update")
        .when(~F.col("_model").eqNullSafe(F.lit(model)), "model").otherwise("same")
    )
    both = both.withColumn("change", change)
    same = both.where("change = 'same'").select(key, "hash", F.lit(model).alias("model"), F.col("_vector").alias("vector"), "change")
    new = both.where("change <> 'same'").select(key, "hash", F.lit(model).alias("model"), embed(F.col("text")).alias("vector"), "change")
    return same.unionByName(new)


def already_alerted(
    items: DataFrame, alerts: DataFrame, key: str, client: str, at: str, vector: str, least: float = 0.78, days: int = 30, block: int = 1024
) -> DataFrame:
    """The first alert, by day and id, that told a client an item's fact within so many days before it (V8).

    `at` is a day number.  `items` has key, day and vector; `alerts` alert, client, day, title and vector.  Both are dealt
    to blocks of about `block` rows of a span of days; an item's block meets the alerts' blocks of its span and the one
    before, each two as one row of work, from which only the first alert of an item and a client leaves.  Null and zero
    vectors and null days match nothing, nor do vectors of different lengths; null clients are one client.
    """
    v = F.col(vector).cast("array<double>")
    length = F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda a, x: a + x))
    unit = F.when(length > 0, F.transform(v, lambda x: x / length)).alias("v")
    day, told = F.col(at).cast("long"), F.col(client).alias("client")

    def blocks(df: DataFrame, name: str, *fields: Column) -> DataFrame:
        rows = df.select(F.floor(day / (days + 1)).alias("span"), F.size(v).alias("width"), F.struct(*fields, unit).alias("r")).where("span is not null and r.v is not null")
        deals = rows.groupBy("span", "width").agg(F.ceil(F.count("*") / block).alias("deals"))
        part = F.pmod(F.xxhash64("r"), F.col("deals")).alias(name)
        dealt = rows.join(deals, ["span", "width"]).select("span", "width", part, "r")
        return dealt.groupBy("span", "width", name).agg(F.array_sort(F.collect_list("r")).alias(f"{name}_rows"))  # about `block` rows

    a = blocks(items, "i", F.col(key).alias("key"), day.alias("day")).withColumn("span", F.explode(F.array(F.col("span") - 1, F.col("span"))))
    b = blocks(alerts, "j", day.alias("sent"), F.col("alert"), F.col("title"), told)
    work = a.join(b, ["span", "width"]).repartition("span", "width", "i", "j").select("i_rows", "j_rows")
    types = {c: df.schema[c].dataType.simpleString() for df, c in ((items, key), (alerts, client), (alerts, "alert"), (alerts, "title"))}

    def first_told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                x, y = x.values, y.values
                p, q = (z.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(z), -1) for z in (x, y))
                on, sent = (z.field(c).to_numpy(zero_copy_only=False) for z, c in ((x, "day"), (y, "sent")))
                near = (p @ q.T >= least - 1e-12) & (sent <= on[:, None]) & (sent >= on[:, None] - days)
                codes = y.field("client").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                r, c = np.nonzero(near)  # alerts of a block are in order, so an item's first one of a client comes first
                _, once = np.unique(r * len(y) + codes[c], return_index=True)
                r, c = pa.array(r[once]), pa.array(c[once])
                out = {"key": x.field("key").take(r), **{n: y.field(n).take(c) for n in ("client", "alert", "title", "sent")}}
                yield pa.RecordBatch.from_pydict(out)

    schema = f"key {types[key]}, client {types[client]}, alert {types['alert']}, title {types['title']}, sent long"
    found = work.mapInArrow(first_told, schema)
    first = F.min_by(F.struct("alert", "title"), F.struct("sent", "alert", "title")).alias("f")
    return found.groupBy("key", "client").agg(first).select(F.col("key").alias(key), F.col("client").alias(client), "f.alert", "f.title")


def gated(df: DataFrame, gate: Column, text: str, enrich: Callable[[str], str | None], out: str = "extra") -> DataFrame:
    """The rows with `out` from an expensive step that only those meet for which the gate holds; null for the others."""
    return with_found(df, gate, text, enrich, out)


def with_context(hits: DataFrame, parts: DataFrame, key: str, position: str, margin: int = 1) -> DataFrame:
    """The parts of a text at most `margin` places from a hit, once each, with whether they are hits themselves."""
    around = hits.select(key, F.col(position).alias("_h"), F.explode(F.sequence(F.col(position) - margin, F.col(position) + margin)).alias(position))
    wanted = around.groupBy(key, position).agg(F.bool_or(F.col("_h") == F.col(position)).alias("hit"))
    return parts.join(wanted, [key, position])
