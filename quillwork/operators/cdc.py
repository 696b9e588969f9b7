"""Keyed incremental sync: change detection, history, merges, retention.

Parquet has no MERGE, so each operator returns the next version of a table; `quillwork.sources.publish` writes it aside
and swaps a pointer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.functions.values import changed

from .relational import first_per_key


def compared(old: DataFrame, new: DataFrame, key: Sequence[str], tracked: Sequence[str]) -> DataFrame:
    """Both versions side by side (o_ and n_ columns) with `change`: insert, update, same or missing."""
    a = old.select(*key, F.lit(True).alias("_old"), *[F.col(c).alias(f"o_{c}") for c in old.columns if c not in key])
    b = new.select(*key, F.lit(True).alias("_new"), *[F.col(c).alias(f"n_{c}") for c in new.columns if c not in key])
    differs = F.lit(False)
    for c in tracked:
        differs = differs | changed(f"o_{c}", f"n_{c}")
    change = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "missing").when(differs, "update").otherwise("same")
    return a.join(b, list(key), "full").withColumn("change", change).drop("_old", "_new")


def upserted(old: DataFrame, new: DataFrame, key: Sequence[str], tracked: Sequence[str], now: Column) -> DataFrame:
    """The next version (C1): new rows, new values, last_seen on every row seen, last_changed only where a tracked value differs.

    `old` has first_seen, last_seen and last_changed beside the columns of `new`; columns that `new` does not carry keep
    their values (C8, Q13).
    """
    both = compared(old, new, key, tracked)
    seen = F.col("change") != "missing"
    values = [
        (F.when(seen, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")) if c in new.columns else F.col(f"o_{c}")).alias(c)
        for c in old.columns
        if c not in key and c not in ("first_seen", "last_seen", "last_changed")
    ]
    return both.select(
        *key,
        *values,
        F.coalesce("o_first_seen", now).alias("first_seen"),
        F.when(seen, now).otherwise(F.col("o_last_seen")).alias("last_seen"),
        F.when(F.col("change").isin("insert", "update"), now).otherwise(F.col("o_last_changed")).alias("last_changed"),
    )


def history(old: DataFrame, new: DataFrame, key: Sequence[str], tracked: Sequence[str]) -> DataFrame:
    """One row per changed field of rows in both versions: key, field, before, after."""
    both = compared(old, new, key, tracked).where("change = 'update'")
    fields = F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(f"o_{c}").cast("string").alias("before"), F.col(f"n_{c}").cast("string").alias("after")) for c in tracked
    ])
    rows = both.select(*key, F.explode(fields).alias("f")).select(*key, "f.*")
    return rows.where(changed("before", "after"))


def inserted_only(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Old rows, and the new ones whose keys are new."""
    return old.unionByName(new.dropDuplicates(list(key)).join(old, list(key), "left_anti"))


def replaced(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Last write wins (C4)."""
    return old.join(new, list(key), "left_anti").unionByName(new)


def children_replaced(old: DataFrame, new: DataFrame, parent: Sequence[str], read: DataFrame | None = None) -> DataFrame:
    """The children of every parent in `new` are those in `new` (C5); those of a parent that was `read` anew without any are none.

    Old rows meet all these parents in one join, whose parents, each once, are the side that a task holds.
    """
    parents = new.select(*parent) if read is None else new.select(*parent).unionByName(read.select(*parent))
    return old.join(parents.distinct().hint("shuffle_hash"), list(parent), "left_anti").unionByName(new)


def checksum_guarded(old: DataFrame, new: DataFrame, key: Sequence[str], ok: str) -> DataFrame:
    """A row is replaced unless the old one passes its check and the new one does not."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return first_per_key(both, list(key), [F.col(ok).desc(), F.col("_new").desc()]).drop("_new")


def purged(df: DataFrame, at: str, as_of: Column, days: int) -> DataFrame:
    """Rows not older than so many days (C9); a missing time stays."""
    return df.where(F.col(at).isNull() | (F.col(at) >= as_of - F.make_interval(days=F.lit(days))))


def orphans_off(rows: DataFrame, catalogue: DataFrame, key: Sequence[str], active: str, note: str) -> DataFrame:
    """Active rows that the catalogue does not know become inactive, with a note."""
    known = catalogue.select(*key, F.lit(True).alias("_known")).dropDuplicates(list(key))
    out = rows.join(known, list(key), "left")
    gone = F.col(active) & F.col("_known").isNull()
    return out.withColumn(note, F.when(gone, "not in catalogue").otherwise(F.col(note))).withColumn(active, F.col(active) & ~gone).drop("_known")


def exclusive_groups(memberships: DataFrame, member: str, group: str, order: Sequence[Column]) -> DataFrame:
    """One group a member, that of the latest membership."""
    return first_per_key(memberships, [member], order).select(member, group)


def stubs(members: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Members that no row describes yet."""
    return members.select(key).distinct().join(known, key, "left_anti")


def state_changes(stored: DataFrame, current: DataFrame, key: Sequence[str], state: str) -> DataFrame:
    """Rows whose state differs from the stored one; those seen for the first time are silent."""
    before = stored.select(*key, F.col(state).alias("before"))
    return current.join(before, list(key)).where(changed("before", state)).select(*key, "before", F.col(state).alias("after"))


def pending(work: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """What no ledger entry covers: failures stay unmarked, so they come again."""
    return work.join(done, list(key), "left_anti")


def regained(parsed: DataFrame, before: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """A new parse, with the value recovered before where it has none."""
    old = before.select(*key, F.col(value).alias("_old"))
    return parsed.join(old, list(key), "left").withColumn(value, F.coalesce(F.col(value), F.col("_old"))).drop("_old")


def suggestions_applied(rows: DataFrame, suggestions: DataFrame, key: Sequence[str], label: str, apply: float = 0.85, suggest: float = 0.70) -> DataFrame:
    """Model labels by confidence: applied, suggested or ignored (M5)."""
    outcome = F.when(F.col("confidence") >= apply, "applied").when(F.col("confidence") >= suggest, "suggested").otherwise("ignored")
    out = rows.join(suggestions.withColumn("outcome", outcome), list(key), "left")
    return out.withColumn(label, F.when(F.col("outcome") == "applied", F.col("suggested_label")).otherwise(F.col(label)))


def decided(suggestions: DataFrame, decisions: DataFrame, key: Sequence[str]) -> DataFrame:
    """Suggestions after decisions; repeated decisions and ones for unknown or settled rows change nothing (M5)."""
    first = decisions.groupBy(*key).agg(F.min_by("decision", "decided_at").alias("decision"))
    out = suggestions.join(first, list(key), "left")
    return out.withColumn("state", F.when(F.col("state") == "pending", F.coalesce("decision", "state")).otherwise(F.col("state"))).drop("decision")


def provenance_merged(existing: DataFrame, incoming: DataFrame, key: str, source: str) -> DataFrame:
    """Existing entries stay; incoming keys are added once with all their sources."""
    new = incoming.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(source)), ", ").alias(source))
    return existing.unionByName(new.join(existing, key, "left_anti"))


def latest_snapshot(df: DataFrame, key: Sequence[str], at: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.col(at).desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
