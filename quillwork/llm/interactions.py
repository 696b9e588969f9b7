"""Audit of filter interactions (operator 12): what each filter of a chain removes, in every order of the chain.

Rows are first counted by part and by which filters they fail, so the CUBE over the failure flags and the part expands
counts, not rows.  A grouping set keeps some flags and rolls the others up; its row whose kept flags are all false holds
the rows that survive that subset of filters.  Every step of every order is then a join of two such subsets, the one
before the step and the one after it.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .oracles import OP12

#: The filters of the query, in the bit order of a mask.
FILTERS = "ABCDE"
#: Orders of more filters than this are too many to list: 7! * 7 rows a part.
MOST = 7


def orders(filters: str = FILTERS) -> list[tuple[str, int, str, int, int]]:
    """(filter_order, step, filter, mask of the filters before the step, mask after it) of all permutations."""
    if not filters or len(filters) > MOST or len(set(filters)) < len(filters):
        raise ValueError(f"1 to {MOST} different filters")
    bit = {f: 1 << i for i, f in enumerate(filters)}
    out = []
    for order in map("".join, permutations(filters)):
        before = 0
        for step, f in enumerate(order, 1):
            out.append((order, step, f, before, before | bit[f]))
            before |= bit[f]
    return out


def survivors(rows: DataFrame, filters: str, part: str, measures: dict[str, Column], weight: str | None = None) -> DataFrame:
    """(part, mask, rows, only, one column a measure): what survives each subset of filters, zeros included.

    `only` is the number of rows that fail the filters of the mask and no other.
    """
    names = [f"f{i}" for i in range(len(filters))]
    flags = [F.coalesce(F.col(f), F.lit(False)).alias(n) for f, n in zip(filters, names, strict=True)]
    n = (F.col(weight) if weight else F.lit(1)).cast("long")
    sums = {m: F.sum(m) for m in ("rows", *measures)}
    counted = (
        rows.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), *flags, n.alias("rows"), *((n * c).cast("long").alias(m) for m, c in measures.items()))
        .groupBy("part", *names)
        .agg(*(F.coalesce(c, F.lit(0)).alias(m) for m, c in sums.items()))
    )
    cube = counted.cube("part", *names).agg(F.grouping("part").alias("all_parts"), *(F.grouping(n).alias(f"{n}_rolled") for n in names), *(c.alias(m) for m, c in sums.items()))
    mask = lambda kept: sum((F.when(kept(n), F.lit(1 << i)).otherwise(0) for i, n in enumerate(names)), F.lit(0))
    rolled = lambda n: F.col(f"{n}_rolled") == 1
    subset = F.when(F.forall(F.array(*names), lambda x: ~F.coalesce(x, F.lit(False))), mask(lambda n: ~rolled(n)))
    failed = F.when(~F.exists(F.array(*(rolled(n) for n in names)), lambda x: x), mask(F.col))
    each = cube.where("all_parts = 0").select("part", F.explode(F.array(
        F.struct(subset.alias("mask"), "rows", F.lit(0).cast("long").alias("only"), *measures),
        F.struct(failed.alias("mask"), F.lit(0).cast("long").alias("rows"), F.col("rows").alias("only"), *(F.lit(0).cast("long").alias(m) for m in measures)),
    )).alias("e")).select("part", "e.*").where("mask is not null")
    empty = counted.select("part").distinct().select(
        "part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("mask"), *(F.lit(0).cast("long").alias(c) for c in ("rows", "only", *measures))
    )
    return each.unionByName(empty).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("rows", "only", *measures)))


def audit(rows: DataFrame, filters: str = FILTERS, part: str = "part", measures: dict[str, Column] | None = None, weight: str | None = None) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, `measures` lost, shapley.

    Each letter of `filters` names a boolean column of `rows`, true where the row fails; null is false.  A null part is
    the empty string and meets it; repeated rows count as often as they stand there; an empty table gives no rows; other
    columns are not looked at, whatever their names.  A measure sums a numeric column, null as 0.  A row stands for
    `weight` rows, if that is named.
    """
    measures = measures or {}
    steps = rows.sparkSession.createDataFrame(orders(filters), "filter_order string, step int, filter string, mask int, after_mask int")
    found = survivors(rows, filters, part, measures, weight)
    after = found.select(F.col("part"), F.col("mask").alias("after_mask"), *(F.col(c).alias(f"after_{c}") for c in ("rows", *measures)))
    alone = {f: 1 << i for i, f in enumerate(filters)}
    first = found.where(F.col("mask").isin(0, *alone.values()))
    fails = first.groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.struct("mask", "rows"))).alias("left"), F.map_from_entries(F.collect_list(F.struct("mask", "only"))).alias("only")
    )  # one more than the filters: bounded
    at = F.element_at(F.create_map(*(x for f, m in alone.items() for x in (F.lit(f), F.lit(m)))), F.col("filter"))
    before = found.drop("only").join(F.broadcast(steps), "mask")  # n! * n rows
    joined = before.join(after, ["part", "after_mask"]).join(fails, "part")
    removed = F.col("rows") - F.col("after_rows")
    shapley = found.join(F.broadcast(steps.groupBy("mask", "after_mask", "filter").count()), "mask").join(after, ["part", "after_mask"])
    shapley = shapley.groupBy("part", "filter").agg(F.sum(removed * F.col("count")).alias("shapley"))
    return joined.select(
        "part", "filter_order", "step", "filter",
        F.col("after_rows").alias("kept"),
        removed.alias("removed"),
        (F.element_at("left", F.lit(0)) - F.element_at("left", at) - removed).alias("redundant"),
        F.element_at("only", at).alias("unique_fails"),
        *((F.col(m) - F.col(f"after_{m}")).alias(m) for m in measures),
    ).join(shapley, ["part", "filter"]).drop("filter")


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, digest, A, B, C, D) of every document: the conditions that its own text decides, on whole texts.

    A: under 200 words; B: fewer than half of the words are distinct; C: over 2 per cent capitals A-Z; D: any of #$%&*|.
    A null text is empty.  The digest names the text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    seen = plain.withColumns({"n": F.size(words), "distinct": F.size(F.array_distinct(words))})
    return seen.select(
        "id", "part", F.unhex(F.sha2("text", 256)).alias("digest"),
        (F.col("n") < 200).alias("A"),
        (100 * F.col("distinct") < 50 * F.col("n")).alias("B"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")) > 2 * F.char_length("text")).alias("C"),
        F.col("text").rlike("[#$%&*|]").alias("D"),
    )


def with_repeats(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts (n) by part, A to E, good and toxic, with E: the text also stands under a smaller id, anywhere.

    `labels` has id, good and toxic, one row an id.  Rows of one text are counted by part and label before they meet, so
    a text that a third of all rows share is a few rows.  A null id fails nothing and no id is larger than it; of rows
    that repeat the smallest id none fails.
    """
    key = lambda c: [F.coalesce(F.col("id"), F.xxhash64("digest") if c else F.lit(None)).alias("k"), F.col("id").isNull().alias("none")]
    # null ids meet no label: their rows are dealt by text
    one = labels.where("id is not null").select(*key(False), "good", "toxic")
    met = rows.select(*key(True), *rows.columns).join(one, ["k", "none"], "left")
    met = met.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    by_id = met.groupBy("k", "none", "id", "digest", "part", *"ABCD", "good", "toxic").count()
    groups = by_id.groupBy("digest", "part", *"ABCD", "good", "toxic").agg(
        F.sum("count").alias("n"), F.min("id").alias("least"), F.min_by("count", "id").alias("n_least"), F.sum(F.when(F.col("id").isNull(), F.col("count")).otherwise(0)).alias("n_null")
    )
    joined = groups.withColumn("first", F.min("least").over(Window.partitionBy("digest")))  # at most four rows a part
    stay = F.col("n_null") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    split = F.explode(F.array(F.struct(F.lit(False).alias("E"), stay.alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - stay).alias("n"))))
    out = joined.select("part", *"ABCD", "good", "toxic", split.alias("e")).select("part", *"ABCD", "e.E", "good", "toxic", "e.n")
    return out.where("n > 0")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over `docs`; a document is good or toxic if any of its label rows says 1."""
    said = labels.groupBy(F.col("doc_id").alias("id")).agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    rows = with_repeats(failures(docs), said)
    return audit(rows, measures={"good_lost": F.col("good"), "toxic_lost": F.col("toxic")}, weight="n")


QUERIES = {"op12_filter_audit": op12_filter_audit}
ORACLES = {"op12_filter_audit": OP12}
