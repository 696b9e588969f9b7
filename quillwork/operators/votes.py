"""Roll-call analytics: strict mode, alignment, participation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POSITIONS = ("SI", "NO", "ABST")


def tallies(votes: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    return votes.groupBy(*keys, position).agg(F.count("*").alias("n"))


def strict_mode(votes: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """The position with most votes of each group; no row for a tie."""
    w = Window.partitionBy(*keys).orderBy(F.desc("n"))
    ranked = tallies(votes, keys, position).withColumns({"_r": F.rank().over(w)})
    top = ranked.where("_r = 1").groupBy(*keys).agg(F.count("*").alias("_c"), F.min(position).alias("mode"), F.max("n").alias("n_mode"))
    return top.where("_c = 1").drop("_c")


def alignment(votes: DataFrame, rollcall: str, party: str, member: str, position: str, include_self: bool = True) -> DataFrame:
    """Each member's votes that count and the share cast with the own party's majority (A10, Q1).

    Roll calls in which the party ties do not count.  Without self, the majority is that of the other members, which
    follows from the party's tallies less the own vote; nothing is joined member by member.
    """
    if include_self:
        mode = strict_mode(votes, [rollcall, party], position)
        rows = votes.join(mode, [rollcall, party]).withColumn("aligned", F.col(position) == F.col("mode"))
    else:
        counts = tallies(votes, [rollcall, party], position)
        held = counts.groupBy(rollcall, party).agg(F.collect_list(F.struct("n", F.col(position).alias("p"))).alias("_t"))
        others = F.transform("_t", lambda t: F.struct((t["n"] - (t["p"] == F.col(position)).cast("int")).alias("n"), t["p"].alias("p")))
        rows = votes.join(held, [rollcall, party]).withColumn("_o", F.filter(others, lambda t: t["n"] > 0))
        peak = F.array_max(F.transform("_o", lambda t: t["n"]))
        rows = rows.withColumn("_m", F.filter("_o", lambda t: t["n"] == peak)).where(F.size("_m") == 1)
        rows = rows.withColumn("aligned", F.col("_m")[0]["p"] == F.col(position))
    return rows.groupBy(party, member).agg(F.count("*").alias("n_votes"), F.avg(F.col("aligned").cast("int")).alias("share"))


def participation(votes: DataFrame, member: str, position: str, present: Sequence[str] = POSITIONS) -> DataFrame:
    """Votes, absences and the share present of each member."""
    here = F.col(position).isin(*present)
    return votes.groupBy(member).agg(F.count("*").alias("n"), F.count_if(~here).alias("absent"), F.avg(here.cast("int")).alias("present"))


def longest_spelling(df: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """One spelling per key, the longest, then the least (A10)."""
    return df.groupBy(*key).agg(F.min_by(name, F.struct(-F.length(name), F.col(name))).alias(name))


def contributions(df: DataFrame, authors: Column, topic: str, most: int = 30) -> DataFrame:
    """The authors with most rows by topic."""
    counts = df.select(topic, F.explode(authors).alias("author")).groupBy(topic, "author").agg(F.count("*").alias("n"))
    w = Window.partitionBy(topic).orderBy(F.desc("n"), "author")
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def tally_over_members(members: DataFrame, votes: DataFrame, member: str, position: str, known: Sequence[str] = POSITIONS) -> DataFrame:
    """Votes of present members by position; missing and unknown ones are 'no vote' (Y10)."""
    rows = members.join(votes, member, "left")
    said = F.when(F.col(position).isin(*known), F.col(position)).otherwise("no vote")
    return rows.groupBy(said.alias("position")).agg(F.count("*").alias("n"))


def seats(members: DataFrame, party: str) -> DataFrame:
    """Seats by party, largest first, with the seats that a majority of all needs."""
    counts = members.groupBy(party).agg(F.count("*").alias("seats"))
    total = members.agg((F.floor(F.count("*") / 2) + 1).alias("majority"))
    return counts.crossJoin(F.broadcast(total)).orderBy(F.desc("seats"), party)  # one row
