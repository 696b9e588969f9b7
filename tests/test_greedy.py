"""Greedy choices in parallel rounds equal the loop over sorted rows: ties, chains, stars, hot blocks, nulls, empty tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillwork.operators import greedy


def looped(pairs, order):
    near = {k: set() for k in order}
    for a, b in pairs:
        if a != b and a in near and b in near:
            near[a].add(b)
            near[b].add(a)
    leads, out = [], {}
    for k in order:
        found = [h for h in leads if h in near[k]]
        out[k] = found[0] if found else k
        if not found:
            leads.append(k)
    return out


def graphs():
    rng = random.Random(3)
    yield [(i, i + 1) for i in range(60)], 61  # a chain in order
    yield [(0, i) for i in range(1, 50)] + [(49, i) for i in range(50, 60)], 61  # stars
    yield [(rng.randrange(80), rng.randrange(80)) for _ in range(150)], 80
    yield [(a, b) for a in range(12) for b in range(12)], 14  # all alike
    yield [], 3


@pytest.mark.parametrize("rest", [0, 1_000_000])
def test_followed(spark, rest):
    for pairs, n in graphs():
        rng = random.Random(n)
        weight = {k: rng.randrange(n // 2 + 1) for k in range(n)}  # ties go to the lesser key
        nodes = spark.createDataFrame([(k, weight[k]) for k in range(n)], "k long, w int")
        edges = spark.createDataFrame([*pairs, *pairs[:3], (None, 1), (1, 999)], "a long, b long")
        got = {r.k: r.leader for r in greedy.followed(edges, nodes, "k", ["w"], rest).collect()}
        assert got == looped(pairs, sorted(range(n), key=lambda k: (weight[k], k)))


@pytest.mark.parametrize("rest", [0, 1_000_000])
def test_matched(spark, rest):
    rng = random.Random(7)
    cases = [[(a, b, float(rng.randrange(5))) for a in range(15) for b in range(12) if rng.random() < 0.3]]
    cases += [[(i, i, 2.0 * i) for i in range(30)] + [(i, i + 1, 2.0 * i + 1) for i in range(30)], []]  # a chain of ever dearer pairs
    for pairs in cases:
        df = spark.createDataFrame([*pairs, *pairs[:4], (None, 1, 0.0)], "a long, b long, d double")
        used, expected = (set(), set()), []
        for d, a, b in sorted((d, a, b) for a, b, d in pairs):
            if a not in used[0] and b not in used[1]:
                used[0].add(a)
                used[1].add(b)
                expected.append((a, b, d))
        assert sorted(tuple(r) for r in greedy.matched(df, ["d"], rest).collect()) == sorted(expected)


@pytest.mark.parametrize("chunk", [3, 4096])
def test_leaders(spark, chunk):
    rng = random.Random(5)
    data = [(k, k % 2, [rng.gauss(0, 1) for _ in range(3)]) for k in range(120)]
    data += [(k, 0, data[k % 7][2]) for k in range(130, 150)] + [(200, 0, None), (201, 1, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(data, "k long, b int, v array<double>")
    got = {r.k: r.leader for r in greedy.leaders(df, "b", ["k"], "k", "v", 0.8, chunk, group=20).collect()}
    heads = {0: [], 1: []}
    for k, b, v in data:
        n = sum(x * x for x in v) ** 0.5 if v else 0
        leader = k
        if n:
            unit = np.array(v) / n
            close = [h for h, u in heads[b] if unit @ u >= 0.8]
            leader = close[0] if close else k
            if not close:
                heads[b].append((k, unit))
        assert got.pop(k) == leader
    assert not got
    assert greedy.leaders(df.limit(0), "b", ["k"], "k", "v", 0.8).count() == 0


def test_hot_block_is_many_tasks(spark):
    """One block of 100,000 rows: no task of the meeting step has more than a small share of them."""
    rng = np.random.default_rng(1)
    heads = rng.normal(size=(40, 8))
    rows = spark.range(100_000, numPartitions=8).select("id", F.lit(1).alias("b"), (F.col("id") % 40).cast("int").alias("h"))
    table = F.array(*[F.array(*map(F.lit, map(float, h))) for h in heads])
    out = greedy.leaders(rows.select("id", "b", table[F.col("h")].alias("v")), "b", ["id"], "id", "v", 0.999, chunk=64, group=5_000)
    found = out.groupBy("leader").count().collect()
    assert sum(r["count"] for r in found) == 100_000 and {r.leader for r in found} == set(range(40))
