"""Joins, aggregations, windows and set operations with stated orders.  DataFrame in, DataFrame out.

Every choice of a row names a total order; every lookup keeps the left side's rows; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A side is broadcast only if the optimizer's own estimate of its size is below this; otherwise both are shuffled.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """The DataFrame with a broadcast hint if its estimated size is small, else as it is."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= most else df


def where_all(df: DataFrame, *tests: Column | None) -> DataFrame:
    """Rows that pass all tests that are given; absent ones are None."""
    given = [t for t in tests if t is not None]
    return df.where(reduce(lambda a, b: a & b, given)) if given else df


def labelled(c: Column | str, names: Mapping[str, str], default: str | None = None) -> Column:
    """The label of a code."""
    c = F.col(c) if isinstance(c, str) else c
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(known[c], F.lit(default)) if names else F.lit(default)


def least_lookup(left: DataFrame, right: DataFrame, on: Sequence[str], order: Sequence[str], take: Sequence[str]) -> DataFrame:
    """Left join to a reference that may hold several rows a key, of which the least by `order` counts.

    The reference is reduced before the join, with partial aggregation, so the left side never fans out.
    """
    row = F.struct(*[F.col(c) for c in dict.fromkeys([*order, *take])])
    best = right.groupBy(*on).agg(F.min_by(row, F.struct(*[F.col(c) for c in dict.fromkeys([*order, *take])])).alias("_r"))
    return left.join(best, list(on), "left").select(*left.columns, *[F.col(f"_r.{c}").alias(c) for c in take])


def with_child_aggregates(parents: DataFrame, children: DataFrame, on: Sequence[str], *aggregates: Column, zero: Sequence[str] = ()) -> DataFrame:
    """Each parent with aggregates of its children; the named ones are 0 without children."""
    grouped = children.groupBy(*on).agg(*aggregates)
    out = parents.join(grouped, list(on), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero}) if zero else out


def preferred_child(parents: DataFrame, children: DataFrame, on: Sequence[str], preferred: Column, order: Sequence[str], take: str, default: Column) -> DataFrame:
    """Each parent with `take` of its preferred child, else of its first by `order`, else the default."""
    rank = F.struct(F.when(preferred, 0).otherwise(1), *[F.col(c) for c in order], F.col(take))
    best = children.groupBy(*on).agg(F.min_by(take, rank).alias("_t"))
    return parents.join(best, list(on), "left").select(*parents.columns, F.coalesce(F.col("_t"), default).alias(take))


def siblings(members: DataFrame, group: str, key: str, include_self: bool = False) -> DataFrame:
    """group, key and the sorted array of the group's other members, or of all."""
    whole = members.groupBy(group).agg(F.array_sort(F.collect_set(key)).alias("siblings"))
    out = members.select(group, key).join(whole, group)
    return out if include_self else out.withColumn("siblings", F.array_except("siblings", F.array(key)))


def outer_series(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Two series by one key, with 0 where one has no value."""
    out = left.join(right, on, "full")
    return out.select(on, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in out.columns if c != on])


def only_match(left: DataFrame, candidates: DataFrame, on: Sequence[str], take: str) -> DataFrame:
    """The one candidate of a row; null for none or several different ones."""
    one = candidates.groupBy(*on).agg(F.min(take).alias("_lo"), F.max(take).alias("_hi"))
    one = one.where(F.col("_lo") == F.col("_hi")).select(*on, F.col("_lo").alias(take))
    return left.join(one, list(on), "left")


def largest_overlap(phrases: DataFrame, spans: DataFrame, stream: str, phrase: str, label: str, bucket: float) -> DataFrame:
    """For each phrase (stream, phrase, start, end) the label of the spans that overlap it longest, ties to the least.

    Both sides are dealt to time buckets of a fixed width, so the join is an equi-join; an overlap counts in the bucket
    where it begins, once.
    """

    def dealt(df: DataFrame, side: str) -> DataFrame:
        buckets = F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))
        return df.withColumn("_b", F.explode(buckets)).withColumnsRenamed({"start": f"_{side}0", "end": f"_{side}1"})

    a = dealt(phrases.select(stream, phrase, "start", "end"), "p")
    b = dealt(spans.select(stream, label, "start", "end"), "q")
    both = a.join(b, [stream, "_b"]).where((F.col("_p0") < F.col("_q1")) & (F.col("_q0") < F.col("_p1")))
    both = both.where(F.col("_b") == F.floor(F.greatest("_p0", "_q0") / bucket))
    shared = F.sum(F.least("_p1", "_q1") - F.greatest("_p0", "_q0")).alias("_o")
    total = both.groupBy(stream, phrase, label).agg(shared)
    best = total.groupBy(stream, phrase).agg(F.min_by(F.struct(label, "_o"), F.struct(-F.col("_o"), F.col(label))).alias("_m"))
    return best.select(stream, phrase, F.col(f"_m.{label}").alias(label), F.col("_m._o").alias("overlap"))


def near_in_time(left: DataFrame, right: DataFrame, on: Sequence[str], at: str, other_at: str, within: int) -> DataFrame:
    """Pairs with equal keys whose times (seconds) differ by at most `within` (J15): an equi-join on neighbouring buckets."""
    a = left.withColumn("_b", F.floor(F.col(at) / within))
    b = right.withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(other_at) / within) + d)))
    return a.join(b, [*on, "_b"]).where(F.abs(F.col(at) - F.col(other_at)) <= within).drop("_b")


def listed(value: Column | str, separator: str = ", ") -> Column:
    """Sorted distinct values as one text (A5)."""
    value = F.col(value) if isinstance(value, str) else value
    return F.array_join(F.array_sort(F.collect_set(value.cast("string"))), separator)


def series(df: DataFrame, at: str, unit: str = "month", **aggregates: Column) -> DataFrame:
    """Aggregates by calendar period."""
    period = F.date_format(F.date_trunc(unit, F.col(at)), "yyyy-MM-dd").alias("period")
    return df.groupBy(period).agg(*[c.alias(n) for n, c in aggregates.items()])


def first_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key by a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def interleaved(df: DataFrame, by: str, order: Sequence[Column]) -> DataFrame:
    """Each row's round (its rank within its group) and the order that alternates between groups."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("round", F.row_number().over(w)).orderBy("round", by)


def gap_sessions(df: DataFrame, keys: Sequence[str], at: Column, gap: float, tie: str) -> DataFrame:
    """Rows with a session number per key: a pause of more than `gap` seconds begins a new one."""
    w = Window.partitionBy(*keys).orderBy(at, F.col(tie))
    pause = at - F.lag(at).over(w)
    new = F.when(pause.isNull() | (pause > gap), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows with a run number per key: a change of `value` begins a new run."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.when(F.row_number().over(w) == 1, 1).when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def without_repeats(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows that differ from the one before them."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(w) == 1
    return df.withColumn("_keep", first | ~F.lag(value).over(w).eqNullSafe(F.col(value))).where("_keep").drop("_keep")


def disambiguated(df: DataFrame, key: str, title: str, out: str) -> DataFrame:
    """Unique ids from ones that clash: the first title keeps the id, others get `~` and six hex digits."""
    w = Window.partitionBy(key).orderBy(F.col(title).asc_nulls_last())
    extra = F.concat(F.col(key).cast("string"), F.lit("~"), F.substring(F.sha1(F.coalesce(F.col(title), F.lit(""))), 1, 6))
    return df.withColumn(out, F.when(F.row_number().over(w) == 1, F.col(key).cast("string")).otherwise(extra))


def streak(df: DataFrame, keys: Sequence[str], newest_first: Sequence[Column], failed: Column) -> DataFrame:
    """How many of each key's newest rows failed before the first that did not."""
    w = Window.partitionBy(*keys).orderBy(*newest_first)
    rows = df.withColumn("_n", F.row_number().over(w)).withColumn("_f", failed)
    first_ok = F.min(F.when(~F.col("_f"), F.col("_n")))
    return rows.groupBy(*keys).agg(F.coalesce(first_ok - 1, F.count("*")).cast("long").alias("streak"))


def precision_recall(df: DataFrame, truth: Column, said: Column, *by: str) -> DataFrame:
    """True and false positives, false negatives, precision, recall and F1, 0 where undefined."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rows = df.groupBy(*by).agg(
        F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"), F.count_if(truth & ~said).alias("fn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return rows.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)})


def stratified_sample(df: DataFrame, stratum: Column, n: int, key: str, seed: int = 13) -> DataFrame:
    """n rows of each stratum, chosen by a seeded hash of the key."""
    rows = df.withColumn("_s", stratum)
    w = Window.partitionBy("_s").orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n", "_s")


def split_side(key: str, train: float = 0.8, seed: int = 13) -> Column:
    """'train' or 'test', fixed by a seeded hash of the key."""
    return F.when(F.pmod(F.crc32(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), F.lit(1000)) < int(train * 1000), "train").otherwise("test")


def merged_longest(local: DataFrame, remote: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """All keys of both; of two rows the one with the longer text stays, the local one if they are as long."""
    both = local.withColumn("_here", F.lit(1)).unionByName(remote.withColumn("_here", F.lit(0)))
    order = [F.length(F.coalesce(F.col(text), F.lit(""))).desc(), F.col("_here").desc(), F.col(text).asc_nulls_last()]
    return first_per_key(both, list(key), order).drop("_here")


def difference(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys that are new or gone (U4)."""
    a, b = before.select(key).distinct().withColumn("_a", F.lit(True)), after.select(key).distinct().withColumn("_b", F.lit(True))
    both = a.join(b, key, "full").where(F.col("_a").isNull() | F.col("_b").isNull())
    return both.select(key, F.when(F.col("_a").isNull(), "new").otherwise("gone").alias("state"))


def inverted(df: DataFrame, key: str, values: str, out: str) -> DataFrame:
    """From key and its array of values to value and its sorted array of keys."""
    return df.select(F.explode(values).alias("value"), F.col(key)).groupBy("value").agg(F.array_sort(F.collect_set(key)).alias(out))


def round_robin_limit(df: DataFrame, by: str, order: Sequence[Column], most: int) -> DataFrame:
    """At most `most` rows, taken in turn from each group (W4 before a cap)."""
    return interleaved(first_per_key(df, [by], order, most), by, order).limit(most)


def bounded_above(df: DataFrame, keys: Sequence[str], position: str, most: int) -> DataFrame:
    """Groups in which no position holds `most` rows or more: unanimity beyond belief is dropped."""
    peak = df.groupBy(*keys, position).count().groupBy(*keys).agg(F.max("count").alias("_peak"))
    return df.join(peak.where(F.col("_peak") < most).select(*keys), list(keys), "left_semi")
