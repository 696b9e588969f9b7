"""A stream with timers and its batch form give the same rows: out of order, late, silent, over several starts."""

import random

import pytest
from pyspark.sql import functions as F

from quillwork.operators import relational
from quillwork.streaming import timed

S = 1_000_000
KIND = "k long, at long, til long, n long, id long"


def data(seed, n=60):
    rng = random.Random(seed)
    rows, now = [], {k: 0 for k in range(3)}
    for i in range(n):
        k = rng.randrange(3)
        now[k] += rng.choice([0, 1, 2, 5, 40]) * S // 2
        rows.append((k, now[k] + 1000 * S, now[k] + 1000 * S + rng.choice([0, 1, 3]) * S // 2, rng.randrange(300), i))
    return rows


STEPS = [
    (timed.Phrases("at", "til", 2 * S, 6 * S), "start long, end long, n long"),
    (timed.Batches("at", "n", 3 * S, 400, 20 * S), "t long, chars long, n_rows long"),
    (timed.Silence("at", 4 * S, 2), "last long, given_up long"),
]


def looped(rows, step):
    out = []
    for k in sorted({r[0] for r in rows}):
        state = None
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[4])):
            row = dict(zip(("k", "at", "til", "n", "id"), r, strict=True))
            while step.due(state) is not None and step.due(state) <= row["at"]:
                state, made = step.expire(state)
                out += [(k, *x) for x in made]
            state, made = step.step(state, row)
            out += [(k, *x) for x in made]
        while step.due(state) is not None:
            state, made = step.expire(state)
            out += [(k, *x) for x in made]
    return sorted(out)


@pytest.mark.parametrize("which", range(3))
def test_stream_equals_batch(spark, which):
    step, out = STEPS[which]
    rows = data(which)
    df = spark.createDataFrame(rows, KIND)
    got = sorted(tuple(r) for r in timed.timed_folded(df, ["k"], "at", ["id"], step, out).collect())
    assert got == looped(rows, step) and got
    # three starts, rows out of order within the delay, then a row that is too late
    source = timed.feed(spark, df.schema, "test")
    make = lambda: timed.timed_stream(spark.readStream.schema(df.schema).parquet(source), ["k"], "at", "30 seconds", ["id"], step, out)
    rng = random.Random(9)
    placed = sorted(rows, key=lambda r: (r[1] + rng.randrange(20 * S), r[4]))
    last = max(r[1] for r in rows)
    for i in range(0, len(placed), 25):
        spark.createDataFrame(placed[i : i + 25], KIND).coalesce(1).write.mode("append").parquet(source)
        timed.run(make(), f"{source}-out")
    spark.createDataFrame([(0, last + 200 * S, last + 200 * S, 1, 900)], KIND).write.mode("append").parquet(source)
    timed.run(make(), f"{source}-out")
    # silence alone has closed what the earlier rows left open, without another row of their sources
    seen = spark.read.parquet(f"{source}-out/rows").collect()
    assert sorted(tuple(r) for r in seen) == looped(rows, step)
    spark.createDataFrame([(1, 1000 * S, 1000 * S, 1, 901)], KIND).write.mode("append").parquet(source)  # dropped
    timed.ended(df, "at").write.mode("append").parquet(source)
    timed.run(make(), f"{source}-out")
    everything = sorted(tuple(r) for r in spark.read.parquet(f"{source}-out/rows").collect())
    assert everything == looped([*rows, (0, last + 200 * S, last + 200 * S, 1, 900)], step)


def test_empty_and_null(spark):
    step, out = STEPS[0]
    df = spark.createDataFrame([(1, None, 5, 1, 1), (None, 10 * S, 11 * S, 1, 2)], KIND)
    assert [tuple(r) for r in timed.timed_folded(df, ["k"], "at", ["id"], step, out).collect()] == [(None, 10 * S, 11 * S, 1)]
    assert timed.timed_folded(df.limit(0), ["k"], "at", ["id"], step, out).count() == 0


def test_two_streams(spark):
    rng = random.Random(4)
    at = lambda s: F.timestamp_micros((F.col(s) * S).cast("long"))
    phrases = [(i % 3, i, float(1000 + i * 3), float(1000 + i * 3 + rng.randrange(1, 9))) for i in range(40)]
    spans = [(rng.randrange(3), rng.choice("xyz"), float(1000 + s), float(1000 + s + rng.randrange(1, 30))) for s in range(0, 120, 2)]
    p = spark.createDataFrame(phrases, "s long, phrase long, start double, end double")
    q = spark.createDataFrame(spans, "s long, label string, start double, end double")
    expected = relational.largest_overlap(p, q, "s", "phrase", "label", 60.0)
    plain = [x.withColumns({"start": at("start"), "end": at("end")}) for x in (p, q)]
    folders = [timed.feed(spark, x.schema, f"two{i}") for i, x in enumerate(plain)]
    out = f"{folders[0]}-out"

    def start():
        a, b = (spark.readStream.schema(x.schema).parquet(f) for x, f in zip(plain, folders, strict=True))
        timed.run(timed.overlapping(a, b, "s", "phrase", "label", "10 minutes", "60 seconds"), out)

    for lo, hi, side in ((0, 1060, 1), (0, 1060, 0), (1060, 9000, 0), (1060, 9000, 1)):  # either side may be ahead
        (p, q)[side].where(f"start >= {lo} and start < {hi}").withColumns({"start": at("start"), "end": at("end")}).write.mode("append").parquet(folders[side])
        start()
    got = timed.longest_overlap(spark.read.parquet(f"{out}/rows"), "s", "phrase", "label")
    key = lambda df: sorted((r.s, r.phrase, r.label, round(r.overlap, 6)) for r in df.collect())
    assert key(got) == key(expected) and key(got)


def test_folded_stream_in_pieces(spark):
    """A key's rows reach the step in pieces, in order over all of them, with its state from start to start, and no frame of all rows as Python's."""
    from quillwork.streaming import flows, folds

    rng = random.Random(6)
    rows = [(k, float(t), i) for i, (k, t) in enumerate((rng.choice(["a", "b", None]), rng.randrange(20_000)) for _ in range(15_000))]
    df = spark.createDataFrame(rows, "k string, t double, i long")
    source = timed.feed(spark, df.schema, "pieces")
    most = folds.PIECE

    def step(state, row):
        n, last = state or (0, -1.0)
        import sys

        held = sys._getframe(1).f_locals["rows"]
        assert "k" not in held.columns and len(sys._getframe(1).f_locals["made"]) <= most
        assert row["t"] >= last
        return [n + 1, row["t"]], [(row["i"], n)]

    parts = [[r for r in rows if r[1] < 10_000], [r for r in rows if r[1] >= 10_000]]
    name = f"pieces-{rng.randrange(10**12)}"
    for part in parts:
        spark.createDataFrame(part, df.schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        got = flows.replayed(folds.folded_stream(stream, ["k"], ["t", "i"], step, "i long, n long"), name)
    expected = []
    for k in ("a", "b", None):
        expected += [(k, i, n) for n, (t, i) in enumerate(sorted((t, i) for x, t, i in rows if x == k))]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(expected, key=repr)


def test_streams_meet_in_slices(spark):
    """Rows of two streams meet in slices of time, those on a slice's edge included, each pair once."""
    at = lambda s: F.timestamp_micros((F.col(s) * S).cast("long"))
    starts = [480.0 * n + d for n in (2, 3, 4) for d in (-61.0, -60.0, -59.0, -1.0, 0.0, 1.0, 59.0, 60.0, 61.0, 240.0)]  # a slice is 480 s
    p = [(1, i, t, t + 60.0) for i, t in enumerate(starts)]
    q = [(1, f"v{i}", t, t + 30.0 * (1 + i % 2)) for i, t in enumerate(starts)]
    folders = []
    for rows, kind in ((p, "s long, phrase long"), (q, "s long, label string")):
        df = spark.createDataFrame(rows, f"{kind}, start double, end double").withColumns({"start": at("start"), "end": at("end")})
        folders.append(timed.feed(spark, df.schema, "slices"))
        df.write.mode("append").parquet(folders[-1])
    a, b = (spark.readStream.schema(spark.read.parquet(f).schema).parquet(f) for f in folders)
    pairs = timed.overlapping(a, b, "s", "phrase", "label", "10 minutes", "60 seconds")
    timed.run(pairs, f"{folders[0]}-out")
    expected = sorted((1, i, label, min(y, z) - max(x, w)) for _, i, x, y in p for _, label, w, z in q if x < z and w < y)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{folders[0]}-out/rows").collect()) == expected
    join = pairs._jdf.queryExecution().analyzed().toString().split("Join Inner", 1)[1].split("\n", 1)[0]
    assert "_slice" in join and "_part" in join


def test_waiting_rows_are_packed():
    """Rows that wait for the watermark are kept many to an element of the state, in their columns' order, without their event time."""
    import json

    kept = []

    class Handle:
        def getListState(self, *_):
            return type("Rows", (), {"appendList": lambda self, rows: kept.extend(rows)})()

        def getValueState(self, *_):
            return None

        def listTimers(self):
            return []

        def registerTimer(self, at):
            assert at == 7

    each = timed._Ordered(["k"], ["k", "at"], "at", [], timed.Silence("at", S), ["k", "last", "given_up"])
    each.init(Handle())
    assert list(each.handleInputRows((1,), iter([(1, 7000 + i, "event time") for i in range(1_200)]), None)) == []
    assert len(kept) == 3 and [tuple(r) for pack in kept for r in json.loads(pack[0])] == [(1, 7000 + i) for i in range(1_200)]
