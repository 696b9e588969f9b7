"""Suppression of repeats in pieces equals the loop over sorted rows, and its stream form."""

import random

import pytest
from pyspark.sql import functions as F

from quillwork.operators import suppression
from quillwork.streaming import folds

SCHEMA = "k long, b string, t double, w array<string>"


def looped(data, seconds, least):
    recent, out = {}, {}
    for k, b, t, w in sorted((r for r in data if r[2] is not None), key=lambda r: (r[2], r[0])):
        mine = {x for x in w or [] if x is not None}
        found = [h for h, at, other in recent.get(b, []) if t - at <= seconds and mine and len(mine & other) / len(mine | other) >= least]
        out[k] = found[0] if found else k
        if not found:
            recent.setdefault(b, []).append((k, t, mine))
    return out | {k: k for k, _, t, _ in data if t is None}


def texts(rng):
    base = [[f"word{rng.randrange(40)}" for _ in range(8)] for _ in range(6)]
    while True:
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(8)] = f"word{rng.randrange(60)}"
        yield w


def cases():
    rng = random.Random(4)
    words = texts(rng)
    yield [(k, rng.choice("aab"), float(rng.randrange(200)), next(words)) for k in range(150)]
    yield [(k, "hot", float(k), ["same", "words"]) for k in range(40)]  # dense copies: every piece shifts the next
    yield [(k, None, 5.0, next(words)) for k in range(40)]  # one instant, no block
    odd = [(200, "a", None, ["x"]), (201, "a", 3.0, None), (202, "a", 3.0, []), (203, "a", 4.0, [None]), (204, "a", 4.0, []), (205, "", 4.0, ["x", "x", None])]
    yield [(k, "a", float(k % 7), next(words)) for k in range(30)] + odd
    yield [(k, "a", 1000.0 * k, ["far", "apart"]) for k in range(20)]


@pytest.mark.parametrize(("piece", "least"), [(7, 0.5), (17, 0.8), (1000, 0.5)])
def test_pieces_equal_the_loop(spark, piece, least):
    for data in cases():
        rows = spark.createDataFrame(data, SCHEMA).withColumn("leader", F.lit("a clashing name"))
        got = suppression.unlike_recent(rows, "b", "t", "k", "w", 11.0, least, piece).collect()
        assert len(got) == len(data)
        assert {r.k: r.leader for r in got} == looped(data, 11.0, least)


def test_empty_and_named_keys(spark):
    rows = spark.createDataFrame([], "name string, b int, t long, w array<string>")
    assert suppression.unlike_recent(rows, "b", "t", "name", "w", 5).collect() == []
    rows = spark.createDataFrame([("b", 1, 1, ["x"]), ("a", 1, 1, ["x"]), ("c", 1, 9, ["x"])], rows.schema)
    assert sorted(map(tuple, suppression.unlike_recent(rows, "b", "t", "name", "w", 5, piece=1).collect())) == [("a", "a"), ("b", "a"), ("c", "c")]


def test_equals_the_stream_form(spark):
    rng = random.Random(8)
    words = texts(rng)
    data = [(k, rng.choice("ab"), float(rng.randrange(100)), " ".join(next(words))) for k in range(80)]
    df = spark.createDataFrame(data, "k long, b string, t double, x string")
    step = folds.unlike_recent("t", "x", 20, 0.5, ["k"])
    stream = folds.folded(df, ["b"], ["t", "k"], step, "t double, k long").select("k").collect()
    pieces = suppression.unlike_recent(df, "b", "t", "k", F.split("x", " "), 20, piece=9).where("k = leader").select("k").collect()
    assert sorted(stream) == sorted(pieces)


def test_a_hot_block_is_many_pieces(spark, monkeypatch):
    """A block with all 40,000 rows, half of them copies of one text, is judged in pieces of bounded size."""
    seen = []
    judged = suppression._judged

    def watched(told, *rest):
        seen.append(told.where("not before").groupBy("piece").count().agg(F.max("count"), F.count("*")).first())
        return judged(told, *rest)

    monkeypatch.setattr(suppression, "_judged", watched)
    word = F.concat(F.lit("w"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).cast("string"))
    rows = spark.range(40_000).select("id", F.lit("s").alias("b"), (F.col("id") * 60).alias("t"), F.array(word).alias("w"))
    out = suppression.unlike_recent(rows, "b", "t", "id", "w", 6 * 3600, piece=5_000)
    kept = {r.id for r in out.where("id = leader").collect()}
    assert kept == {i for i in range(40_000) if i % 2} | set(range(0, 40_000, 362))
    assert seen[0][1] == 8 and max(r[0] for r in seen) < 10_000
