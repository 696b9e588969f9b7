"""Rolling suppression of repeats: a row is held back if a row let through shortly before it says much the same.

Rows are cut, in order of block, time and key, into pieces of about equal size, so a block with a third of all rows is many
pieces.  All pieces are judged side by side as if nothing had come before them; then each piece whose predecessor in the
block ends with other rows let through than the piece has been told of is judged again, until none is left.  No pairs are
written.  A task streams its rows and holds only what was let through within the time span.  In round r the first r pieces
of a block are final, so rounds are at most as many as the pieces of the longest block; they are that many only if copies
follow each other so densely that the choice at the start of a piece shifts all later ones.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.session import bounded_batches

from .retrieval import discard, written

#: Rows of a piece, and the most pieces: beyond PIECE * PIECES rows pieces grow, which only makes tasks longer.
PIECE, PIECES = 16_384, 20_000


class _Recent:
    """What was let through within the span, oldest first, by the words of which any alike row must hold one."""

    def __init__(self, seconds: float, least: float):
        self.seconds, self.least = seconds, least
        self.clear()

    def clear(self) -> None:
        self.rows: deque = deque()
        self.first, self.by_word = 0, {}

    def _reach(self, words: list) -> list:
        """Of two alike sets in one order, each has a word that both share among these."""
        return words[: len(words) - math.ceil(self.least * len(words) - 1e-9) + 1]

    def expire(self, now: float) -> None:
        while self.rows and now - self.rows[0][0] > self.seconds:
            for w in self._reach(self.rows.popleft()[2]):
                places = self.by_word[w]
                places.popleft()
                if not places:
                    del self.by_word[w]
            self.first += 1

    def add(self, at: float, key, words: list) -> None:
        for w in self._reach(words):
            self.by_word.setdefault(w, deque()).append(self.first + len(self.rows))
        self.rows.append((at, key, words, set(words)))

    def alike(self, words: list):
        """The key of the oldest alike row, or None."""
        met = {i for w in self._reach(words) for i in self.by_word.get(w, ())}
        mine, n = set(words), len(words)
        for i in sorted(met):
            _, key, _, other = self.rows[i - self.first]
            if min(n, len(other)) >= self.least * max(n, len(other)) - 1e-9:
                shared = len(mine & other)
                if shared >= self.least * (n + len(other) - shared) - 1e-9:
                    return key
        return None


def _judged(told: DataFrame, kind: str, seconds: float, least: float, tasks: int) -> DataFrame:
    """The rows with their leaders, and what each piece's last block ends with (then `leader` is null)."""
    names = ["piece", "block", "at", "key", "leader", "words"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recent, piece, block = _Recent(seconds, least), None, None
        ends = lambda: [(piece, block, at, key, None, words) for at, key, words, _ in recent.rows]
        for batch in batches:
            out: list = []
            for p, before, b, at, key, words in zip(*(batch[c] for c in ("piece", "before", "block", "at", "key", "words")), strict=True):
                if p != piece:
                    out += ends()
                if (p, b) != (piece, block):
                    recent.clear()
                    piece, block = p, b
                recent.expire(at)
                words = list(words)
                leader = None if before else recent.alike(words)
                if leader is None:
                    recent.add(at, key, words)
                if not before:
                    out.append((p, b, at, key, key if leader is None else leader, None))
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(ends(), columns=names)

    bounded_batches(told.sparkSession)
    rows = told.repartition(tasks, "piece").sortWithinPartitions("piece", F.desc("before"), "block", "at", "key")
    return rows.mapInPandas(run, f"piece int, block string, at double, key {kind}, leader {kind}, words array<string>")


def unlike_recent(
    rows: DataFrame, block: str, at: str | Column, key: str, words: str | Column, seconds: float, least: float = 0.5, piece: int = PIECE
) -> DataFrame:
    """(key, leader): whom each row repeats, itself if it is let through.

    In order of time, ties to the lesser key, a row is let through unless one let through in its block at most `seconds`
    before it has a Jaccard similarity of at least `least` (above 0) of the sets of words; `leader` is the oldest such
    row.  Rows without words or with a null time are let through and suppress nothing; null blocks are one block; keys
    are unique and not null; an empty table gives no rows.  A block of any size is spread over its pieces.
    """
    kind = rows.schema[key].dataType.simpleString()
    said = F.col(words) if isinstance(words, str) else words
    # long words first: they are the rarer ones, and any order that all rows share finds all alike rows
    ordered = F.transform(F.array_sort(F.transform(F.array_distinct(said), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda s: s["w"])
    time = (F.col(at) if isinstance(at, str) else at).cast("double")
    plain = rows.select(F.to_json(F.struct(F.col(block))).alias("block"), time.alias("at"), F.col(key).alias("key"), F.filter(ordered, F.isnotnull).alias("words"))
    told = written(plain, "suppression-words")  # counted, sampled and dealt without finding the words again
    judged_alone = written(told.where("at is null or words is null or size(words) = 0").select("key", F.col("key").alias("leader")), "suppression-alone")
    plain = told.where("at is not null and size(words) > 0")
    pieces = min(PIECES, -(-plain.count() // piece)) or 1
    dealt = written(plain.repartitionByRange(pieces, "block", "at", "key").withColumn("piece", F.spark_partition_id()), "suppression-rows")
    discard(told)

    heads = dealt.groupBy("piece").agg(F.min("block").alias("block"))
    links = written(heads.withColumn("last", F.lag("piece").over(Window.orderBy("piece"))), "suppression-pieces")  # a row a piece, at most PIECES
    fresh = dealt.withColumn("before", F.lit(False))
    rounds = [written(_judged(fresh, kind, seconds, least, pieces), "suppression-judged")]
    states = rounds[0].where("leader is null").drop("leader")
    spent = [dealt, links] if pieces > 1 else [dealt]  # a single piece is not told of anything
    now = links.select("piece", F.array().cast(f"array<{kind}>").alias("told"), F.lit(0).alias("round"))
    while pieces > 1:
        came = states.withColumnRenamed("piece", "last").join(links, ["last", "block"]).drop("last").withColumn("before", F.lit(True))
        heard = came.groupBy("piece").agg(F.sort_array(F.collect_list("key")).alias("heard"))  # what one task holds anyway
        both = now.join(heard, "piece", "left").withColumn("heard", F.coalesce("heard", F.array().cast(f"array<{kind}>")))
        after = F.when(F.col("heard") != F.col("told"), len(rounds)).otherwise(F.col("round")).alias("round")
        now = written(both.select("piece", F.col("heard").alias("told"), after), "suppression-told")
        spent.append(now)
        stale = now.where(F.col("round") == len(rounds)).select("piece")
        n = stale.count()
        if not n:
            break
        parts = lambda df: df.join(F.broadcast(stale), "piece", "left_semi")  # noqa: E731, B023  at most PIECES rows
        again = written(_judged(parts(fresh).unionByName(parts(came)), kind, seconds, least, n), "suppression-judged")
        rounds.append(again)
        kept = states.join(F.broadcast(stale), "piece", "left_anti").unionByName(again.where("leader is null").drop("leader"))
        states = written(kept, "suppression-states")
        spent.append(states)
    discard(*(t for t in spent if t is not now))
    found = rounds[0].limit(0).withColumn("round", F.lit(0))
    for i, each in enumerate(rounds):
        found = found.unionByName(each.withColumn("round", F.lit(i)))
    found = found.where("leader is not null").join(F.broadcast(now.select("piece", "round")), ["piece", "round"], "left_semi")  # at most PIECES rows
    return found.select("key", "leader").unionByName(judged_alone).toDF(key, "leader")
