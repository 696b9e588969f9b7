"""Geometry of scanned pages: skew, columns, pairing, boxes, headers, and roll calls read from them.

Pages are the unit: every window and group is one page's words, which are few; any number of pages runs side by side.
Null coordinates place a word nowhere, so such words are dropped; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .greedy import matched
from .relational import small
from .retrieval import written

#: Possible pairs of one page that are paired in one row.
PAGE_PAIRS = 100_000


def skew(words: DataFrame, page: str, slopes: Sequence[float], tolerance: float = 2.5) -> DataFrame:
    """Each page's slope: the one under which its words (x, y) fall into the fewest lines; ties go to the least.

    A line ends where the next word, from top to bottom, lies more than `tolerance` below.
    """
    tried = words.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(page, "x", "y", F.explode(F.array(*map(F.lit, slopes))).alias("slope"))
    tried = tried.withColumn("_y", F.col("y") - F.col("slope") * F.col("x"))
    w = Window.partitionBy(page, "slope").orderBy("_y")
    before = F.lag("_y").over(w)
    lines = tried.withColumn("_new", F.when(F.col("_y") - before <= tolerance, 0).otherwise(1)).groupBy(page, "slope").agg(F.sum("_new").alias("lines"))
    best = F.min_by(F.struct("slope", "lines"), F.struct("lines", F.abs("slope").alias("size"), "slope"))
    return lines.groupBy(page).agg(best.alias("b")).select(page, "b.slope", "b.lines")


def deskewed(words: DataFrame, page: str, slopes: Sequence[float], tolerance: float = 2.5) -> DataFrame:
    """The words with their y set upright."""
    return words.join(skew(words, page, slopes, tolerance).select(page, "slope"), page).withColumn("y", F.col("y") - F.col("slope") * F.col("x")).drop("slope")


def nearest_column(words: DataFrame, columns: DataFrame, page: str, tolerance: float) -> DataFrame:
    """The words with the column (an x) next to them, at most `tolerance` away, else null; ties go to the left."""
    known = columns.groupBy(page).agg(F.sort_array(F.collect_set("column")).alias("_columns"))
    near = F.transform(F.coalesce("_columns", F.array()), lambda c: F.struct(F.abs(F.col("x") - c).alias("d"), c.alias("c")))
    best = F.array_min(F.filter(near, lambda s: s["d"] <= tolerance))["c"]
    return words.join(known, page, "left").withColumn("column", best).drop("_columns")


def paired(left: DataFrame, right: DataFrame, page: str, key: str, at: str, tolerance: float, most: int = PAGE_PAIRS) -> DataFrame:
    """Greedy one-to-one pairs of a page's items by distance: page, a, b, distance.

    The nearest two items that are both free make a pair, again and again; ties go to the lesser keys.  A page's items are
    brought together once and paired where they lie.  Pages with more than `most` possible pairs, counted first, decide in
    parallel rounds, so one page of any size is no single task.
    """
    own = F.struct(F.col(key).alias("key"), F.col(at).alias("x"))
    side = lambda df, name: df.where(F.col(page).isNotNull()).select(F.col(page).alias("page"), own.alias(name))
    both = side(left, "l").unionByName(side(right, "r"), allowMissingColumns=True)
    sizes = both.groupBy("page").agg(F.count("l").alias("l"), F.count("r").alias("r"))
    crowded = written(sizes.where(F.col("l") * F.col("r") > most).select(F.col("page").alias(page)), "crowded-pages")
    if crowded.isEmpty():
        return _paired_pages(both, page, tolerance)
    few = _paired_pages(both.join(small(crowded.withColumnRenamed(page, "page")), "page", "left_anti"), page, tolerance)
    many = (df.join(small(crowded), page, "left_semi") for df in (left, right))
    return few.unionByName(_paired_rounds(*many, page, key, at, tolerance))


def _paired_pages(both: DataFrame, page: str, tolerance: float) -> DataFrame:
    """Pairs of pages whose items (l or r) fit one row: candidates in order, each made unless one before it has an end of it."""
    rows = both.repartition("page").groupBy("page").agg(F.collect_list("l").alias("l"), F.collect_list("r").alias("r"))
    pair = lambda a, b: F.struct(F.abs(a["x"] - b["x"]).alias("distance"), a["key"].alias("a"), b["key"].alias("b"))
    near = F.flatten(F.transform("l", lambda a: F.filter(F.transform("r", lambda b: pair(a, b)), lambda c: c["distance"] <= tolerance)))
    rows = rows.select("page", F.array_sort(near).alias("near"))
    taken = lambda made, c: F.exists(made, lambda m: m["a"].eqNullSafe(c["a"]) | m["b"].eqNullSafe(c["b"]))
    made = F.aggregate("near", F.slice("near", 1, 0), lambda made, c: F.when(taken(made, c), made).otherwise(F.concat(made, F.array(c))))
    return rows.select(F.col("page").alias(page), F.explode(made).alias("m")).select(page, "m.a", "m.b", "m.distance")


def _paired_rounds(left: DataFrame, right: DataFrame, page: str, key: str, at: str, tolerance: float) -> DataFrame:
    """Pairs of crowded pages: candidates meet in cells as wide as the tolerance."""
    cell = lambda c: F.floor(F.col(c) / tolerance)
    a = left.select(F.col(page).alias("_p"), F.struct(page, F.col(key).alias("key")).alias("a"), F.col(at).alias("_x")).withColumn("_c", F.explode(F.sequence(cell("_x") - 1, cell("_x") + 1)))
    b = right.select(F.col(page).alias("_p"), F.struct(page, F.col(key).alias("key")).alias("b"), F.col(at).alias("_z")).withColumn("_c", cell("_z"))
    near = a.join(b, ["_p", "_c"]).withColumn("distance", F.abs(F.col("_x") - F.col("_z"))).where(F.col("distance") <= tolerance)
    return matched(near.select("a", "b", "distance"), ["distance"]).select(F.col(f"a.{page}").alias(page), F.col("a.key").alias("a"), F.col("b.key").alias("b"), "distance")


def box_words(boxes: DataFrame, keys: Sequence[str], votes: Sequence[str] = ("SI", "NO", "ABST")) -> DataFrame:
    """Words of recognised boxes (x0, x1, text): keys, position, x, word.

    A box's width is shared out by characters, blanks included.  A vote that is glued to the last word stands alone, and
    a vote at the end of a box with other words is placed from the right edge.
    """
    glued = F.regexp_replace("text", rf"(?<=\p{{L}}{{4}})({'|'.join(votes)})\s*$", " $1")
    rows = boxes.select(*keys, "x0", "x1", F.trim(F.regexp_replace(glued, r"\s+", " ")).alias("_t")).where("_t <> ''")
    cut = rows.select(*keys, "x0", "x1", "_t", F.posexplode(F.split("_t", " ")).alias("position", "word"))
    before = F.length(F.array_join(F.slice(F.split("_t", " "), F.lit(1), F.col("position")), " ")) + F.when(F.col("position") > 0, 1).otherwise(0)
    wide = (F.col("x1") - F.col("x0")) / F.length("_t")
    last = (F.col("position") > 0) & (F.col("position") == F.size(F.split("_t", " ")) - 1) & F.col("word").isin(*votes)
    x = F.when(last, F.col("x1") - wide * F.length("word")).otherwise(F.col("x0") + wide * before)
    return cut.select(*keys, "position", x.alias("x"), "word")


def header(line: Column) -> Column:
    """struct<kind, day, minute> of a page's head line, "VOTING 03/11/2026 4:05 PM"; null for any other line."""
    form = r"(?i)\b(VOTING|VOTACION|ATTENDANCE|ASISTENCIA)\b.*?(\d{1,2}/\d{1,2}/\d{4})\D+(\d{1,2}):(\d{2})\s*([AP])\.?M"
    part = lambda i: F.regexp_extract(line, form, i)
    hour = F.pmod(part(3).cast("int"), F.lit(12)) + F.when(F.upper(part(5)) == "P", 12).otherwise(0)
    kind = F.when(F.upper(part(1)).startswith("VOT"), "voting").otherwise("attendance")
    said = F.struct(kind.alias("kind"), F.to_date(part(2), "d/M/yyyy").alias("day"), (hour * 60 + part(4).cast("int")).alias("minute"))
    return F.when(line.rlike(form), said)


def repaired(votes: DataFrame, totals: DataFrame, key: str, position: str, unsure: str) -> DataFrame:
    """The votes of roll calls with one misread cell, set right by the printed totals.

    Where one position has one vote too many, another one too few, all others agree, and only one vote of the first is
    unsure, that vote takes the second position.  Anything else stays as it was read.
    """
    counts = votes.groupBy(key, position).agg(F.count("*").alias("_have"), F.count_if(F.col(unsure)).alias("_unsure"))
    both = counts.join(totals.select(key, position, F.col("n").alias("_n")), [key, position], "full")
    more = F.coalesce("_have", F.lit(0)) - F.coalesce("_n", F.lit(0))
    both = both.select(key, position, more.alias("_more"), F.coalesce("_unsure", F.lit(0)).alias("_unsure")).where("_more <> 0")
    one = both.groupBy(key).agg(
        F.count("*").alias("_off"),
        F.max(F.when((F.col("_more") == 1) & (F.col("_unsure") == 1), F.col(position))).alias("_from"),
        F.max(F.when(F.col("_more") == -1, F.col(position))).alias("_to"),
    )
    one = one.where("_off = 2 and _from is not null and _to is not null").drop("_off")
    out = votes.join(one, key, "left")
    wrong = F.col(unsure) & (F.col(position) == F.col("_from"))
    return out.withColumn(position, F.when(wrong, F.col("_to")).otherwise(F.col(position))).drop("_from", "_to")


def majority_resolved(votes: DataFrame, key: str, member: str) -> DataFrame:
    """The resolved votes of roll calls of which at least half the names are known members."""
    share = votes.groupBy(key).agg((2 * F.count(member) >= F.count("*")).alias("_ok"))
    return votes.join(share.where("_ok").select(key), key, "left_semi").where(F.col(member).isNotNull())
