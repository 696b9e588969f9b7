"""Greedy choices in a total order, made in parallel rounds.

What a loop over sorted rows would choose (the first of similar items leads, the nearest free pair is made) depends on the
order alone, so it can be found in rounds: an item decides as soon as nothing before it that touches it is undecided.
Rounds are written to the shared folder, so a lost executor costs its own tasks only; what a round leaves is counted, and
a rest of at most REST rows is finished in order in one task, which keeps long chains from taking a round a link.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import discard, written

#: Rows of edges that one task may finish.
REST = 200_000
#: Rows of a block that one task decides in a round, and rows of a block that meet them in one task.
CHUNK, GROUP = 4096, 50_000


def _edges(pairs: DataFrame, nodes: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """(lo, hi, at): each pair once, with the earlier node first and its place in the order."""
    place = F.struct(*(F.col(c).alias(f"o{i}") if isinstance(c, str) else c.alias(f"o{i}") for i, c in enumerate(order)), F.col(key).alias("k"))
    placed = nodes.select(F.col(key).alias("_k"), place.alias("at"))
    side = lambda c: placed.select(F.col("_k").alias(c), F.col("at").alias(f"at_{c}"))
    both = pairs.select("a", "b").where("a <> b").join(side("a"), "a").join(side("b"), "b")
    first = F.col("at_a") < F.col("at_b")
    return both.select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("hi"), F.least("at_a", "at_b").alias("at")
    ).distinct()


def followed(pairs: DataFrame, nodes: DataFrame, key: str, order: Sequence[str | Column], rest: int = REST) -> DataFrame:
    """(key, leader): the greedy leaders of a graph of pairs (a, b), and whom the other nodes follow.

    In the order, ties to the lesser key, a node leads unless an earlier leader touches it; it follows the first such one.
    This is the lexicographically first independent set.  Nodes without a pair lead; pairs of unknown or null nodes and
    of a node with itself say nothing; repeated pairs count once; `nodes` has one row a key.
    """
    spark = pairs.sparkSession
    every = written(_edges(pairs, nodes, key, order), "greedy-edges")
    left, leads = every, []
    while n := left.count():
        if n <= rest:
            leads.append(_rest(left))
            break
        free = left.select("lo").distinct().join(left.select(F.col("hi").alias("lo")).distinct(), "lo", "left_anti")
        free = written(free, "greedy-leads")
        out = left.join(free, "lo", "left_semi").select("hi").distinct()
        kept = left.join(free, "lo", "left_anti")
        kept = kept.join(out, "hi", "left_anti").join(out.select(F.col("hi").alias("lo")), "lo", "left_anti")
        after = written(kept.select("lo", "hi", "at"), "greedy-edges")
        # nodes whose last pairs went with this round lead, unless they are out
        alone = left.select(F.explode(F.array("lo", "hi")).alias("lo")).distinct().join(free, "lo", "left_anti").join(out.select(F.col("hi").alias("lo")), "lo", "left_anti")
        alone = alone.join(after.select(F.explode(F.array("lo", "hi")).alias("lo")).distinct(), "lo", "left_anti")
        leads += [free, written(alone, "greedy-leads")]
        if left is not every:
            discard(left)
        left = after
    kind = every.schema["lo"].dataType.simpleString()
    found = spark.createDataFrame([], f"lo {kind}")
    for each in leads:
        found = found.unionByName(each.select("lo"))
    first = every.join(found, "lo", "left_semi").groupBy("hi").agg(F.min_by("lo", "at").alias("leader"))
    # only nodes that do not lead follow: an earlier leader that touches a leader cannot be
    return nodes.select(key).join(first.withColumnRenamed("hi", key), key, "left").select(key, F.coalesce("leader", key).alias("leader"))


def _rest(left: DataFrame) -> DataFrame:
    """The leaders among a counted, bounded rest of edges, in order, in one task."""
    kind = left.schema["lo"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leads: set = set()
        out: set = set()
        seen: list = []
        for batch in batches:
            for lo, hi in zip(batch["lo"], batch["hi"], strict=True):
                # edges come by their earlier node, so all edges into `lo` have been seen
                if lo not in leads and lo not in out:
                    leads.add(lo)
                if lo in leads:
                    out.add(hi)
                seen.append(hi)
        yield pd.DataFrame({"lo": list(leads | {h for h in seen if h not in out})})

    return left.coalesce(1).sortWithinPartitions("at", "hi").mapInPandas(run, f"lo {kind}")


def matched(pairs: DataFrame, order: Sequence[str], rest: int = REST) -> DataFrame:
    """The greedy one-to-one pairs of (a, b, ...): in the order, ties to the lesser a and b, the next pair with two free ends.

    A pair that comes first at both of its ends is made, its ends' other pairs go, again and again.  `a` and `b` may be
    structs; they name ends on two different sides.  Pairs with a null end are none; of repeated pairs the first counts.
    """
    place = F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.col("a").alias("a"), F.col("b").alias("b"))
    every = pairs.where("a is not null and b is not null")
    left = written(every.withColumn("_at", place).dropDuplicates(["_at"]), "greedy-pairs")
    made = []
    while n := left.count():
        if n <= rest:
            made.append(_paired_rest(left))
            break
        first = lambda c: left.groupBy(c).agg(F.min("_at").alias(f"_{c}"))  # noqa: E731, B023
        now = left.join(first("a"), "a").join(first("b"), "b").where("_at = _a and _at = _b").select(left.columns)
        now = written(now, "greedy-made")
        made.append(now)
        after = written(left.join(now.select("a"), "a", "left_anti").join(now.select("b"), "b", "left_anti").select(left.columns), "greedy-pairs")
        discard(left)
        left = after
    out = every.limit(0)
    for each in made:
        out = out.unionByName(each.drop("_at"))
    return out


def _paired_rest(left: DataFrame) -> DataFrame:
    names = [c for c in left.columns if c != "_at"]
    flat = left.select(F.struct(*names).alias("row"), F.xxhash64("a").alias("ha"), F.col("a").cast("string").alias("sa"), F.col("b").cast("string").alias("sb"), "_at")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends: tuple[set, set] = (set(), set())
        for batch in batches:
            keep = []
            for a, b in zip(batch["sa"], batch["sb"], strict=True):
                free = a not in ends[0] and b not in ends[1]
                if free:
                    ends[0].add(a)
                    ends[1].add(b)
                keep.append(free)
            yield batch[keep][["sa", "sb"]]

    said = flat.coalesce(1).sortWithinPartitions("_at").select("sa", "sb").mapInPandas(run, "sa string, sb string")
    first = left.withColumns({"sa": F.col("a").cast("string"), "sb": F.col("b").cast("string")})
    first = first.withColumn("_n", F.row_number().over(Window.partitionBy("sa", "sb").orderBy("_at"))).where("_n = 1")
    return first.join(said, ["sa", "sb"], "left_semi").select(*names)


def leaders(rows: DataFrame, block: str, order: Sequence[str], key: str, vector: str, least: float, chunk: int = CHUNK, group: int = GROUP) -> DataFrame:
    """Greedy clustering by cosine in a total order: join the first leader that is similar enough, else lead.

    In each round the first `chunk` undecided rows of every block are decided in order by one task a block, and all other
    undecided rows meet the new leaders, spread over as many tasks as the largest block needs, and follow the first that
    is similar enough.  The rounds are as many as the chunks of leaders, and no pair of rows is written.  Rows with a null
    or zero vector lead themselves; ties of the order go to the lesser key; keys are unique; empty tables give no rows.
    """
    kind, id_kind = rows.schema[block].dataType.simpleString(), rows.schema[key].dataType.simpleString()
    place = F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.col(key).alias("k"))
    v = F.col(vector).cast("array<double>")
    length = F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda a, x: a + x))
    plain = rows.select(F.col(block).alias("block"), F.col(key).alias("key"), v.alias("v"), length.alias("_length"), place.alias("at"))  # once a row, not once an element
    plain = plain.withColumn("v", F.when(F.col("_length") > 0, F.transform("v", lambda x: x / F.col("_length")))).drop("_length")
    most = plain.groupBy("block").count().agg(F.max("count")).first()[0] or 0
    salts = -(-most // group) or 1
    spread = F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")
    left = written(plain.where("v is not null").withColumn("salt", spread), "leaders-left")
    alone = plain.where("v is null").select("block", "key", F.col("key").alias("leader"))
    done = []
    said = f"block {kind}, key {id_kind}, leader {id_kind}, n int, v array<double>"

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        x, ids = np.stack(rows["v"].to_list()), rows["key"].tolist()
        heads, at, leader = np.zeros_like(x), [], []
        for i in range(len(x)):
            close = np.flatnonzero(heads[: len(at)] @ x[i] >= least)
            if not len(close):
                heads[len(at)] = x[i]
                at.append(i)
            leader.append(ids[at[close[0]]] if len(close) else ids[i])
        v = rows["v"].where(pd.Series(leader, rows.index) == rows["key"], None)
        return pd.DataFrame({"block": rows["block"], "key": ids, "leader": leader, "n": rows["n"], "v": v})

    def absorb(rows: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
        rows = rows[~rows["key"].isin(set(heads["key"]))]
        heads = heads[heads["v"].notna()].sort_values("n")
        leader = np.full(len(rows), None, object)
        if len(rows) and len(heads):
            y, ids = np.stack(heads["v"].to_list()), heads["key"].to_numpy(object)
            for i in range(0, len(rows), 1024):
                close = np.stack(rows["v"].iloc[i : i + 1024].to_list()) @ y.T >= least
                some = close.any(1)
                leader[i : i + 1024][some] = ids[close.argmax(1)[some]]
        return pd.DataFrame({"block": rows["block"], "key": rows["key"], "v": rows["v"], "at": rows["at"], "salt": rows["salt"], "leader": leader})

    while left.limit(1).count():
        w = Window.partitionBy("block").orderBy("at")
        first = left.withColumn("n", F.row_number().over(w)).where(F.col("n") <= chunk).select("block", "key", "n", "v")
        heads = written(first.groupBy("block").applyInPandas(decide, said), "leaders-heads")
        near = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        kinds = f"block {kind}, key {id_kind}, v array<double>, at {left.schema['at'].dataType.simpleString()}, salt int, leader {id_kind}"
        met = written(left.groupBy("block", "salt").cogroup(near.groupBy("block", "salt")).applyInPandas(absorb, kinds), "leaders-met")
        done += [heads.select("block", "key", "leader"), met.where("leader is not null").select("block", "key", "leader")]
        left = met.where("leader is null").drop("leader")
    for each in done:
        alone = alone.unionByName(each)
    return alone.toDF(block, key, "leader")
