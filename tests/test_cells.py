"""A stored index of cells: exact with all cells, recall of 0.9 with few, partitions pruned by filters and cells."""

import uuid

import numpy as np
from pyspark.sql import functions as F

from quillwork.operators import cells
from quillwork.operators.retrieval import Nearest, nearest, shared_folder


def test_filtered_neighbours(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8))
    x = centres[rng.integers(0, 12, 900)] + 0.3 * rng.normal(size=(900, 8))
    x[5] = x[6]  # a tie
    kinds = ["news", "bill", None]
    rows = [(i, kinds[i % 3], "PE" if i % 4 else "EC", list(map(float, v))) for i, v in enumerate(x)] + [(2000, "news", "PE", None), (2001, "news", "PE", [0.0] * 8)]
    df = spark.createDataFrame(rows, "id long, kind string, country string, v array<double>")
    folder = f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}"
    n = cells.build(df, folder, "id", "v", ["kind", "country"])
    assert n == 30 and spark.read.parquet(f"{folder}/rows").count() == 900
    asked = df.where("id % 20 = 0 or id in (5, 2000)").select(F.col("id").alias("q"), "v")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for where, mine in ((None, np.ones(900, bool)), (F.col("kind") == "bill", np.arange(900) % 3 == 1), ((F.col("country") == "EC") & F.col("kind").isNull(), (np.arange(900) % 3 == 2) & (np.arange(900) % 4 == 0))):
        exact = cells.search(spark, folder, asked, 5, "q", "v", where).cache()
        expected = set()
        for q in [i for i in range(900) if i % 20 == 0 or i == 5]:
            score = unit @ unit[q]
            best = sorted((-round(s, 12), i) for i, s in enumerate(score) if i != q and mine[i])[:5]
            expected |= {(q, i, r + 1) for r, (_, i) in enumerate(best)}
        assert {(r.q, r.key, r["rank"]) for r in exact.collect()} == expected
        few = cells.search(spark, folder, asked, 5, "q", "v", where, probe=8)
        assert cells.recall(few, exact, "q") >= 0.9
    plan = cells.search(spark, folder, asked.limit(1), 5, "q", "v", F.col("kind") == "bill", probe=2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan and "cell" in plan.split("PartitionFilters", 1)[1].split("]", 1)[0]
    assert cells.search(spark, folder, asked.limit(0), 5, "q", "v").count() == 0


def test_tasks_hand_out_their_best_alone(spark):
    """A task's batches are ranked together: at most k rows a query leave it, however many batches and cells it reads."""
    x = np.random.default_rng(3).normal(size=(600, 4))
    df = spark.createDataFrame([(i, "a", list(map(float, v))) for i, v in enumerate(x)], "id long, kind string, v array<double>")
    folder = f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}"
    cells.build(df, folder, "id", "v", ["kind"])
    found = cells.search(spark, folder, df.where("id < 10").select(F.col("id").alias("q"), "v"), 5, "q", "v")
    best = Nearest(np.arange(10), x[:10], 5)
    for i in range(0, 600, 20):
        best.meet(np.arange(i, i + 20), x[i : i + 20])
        assert len(best.found()[0]) <= 50
    assert {(r.q, r.key) for r in found.collect()} == set(zip(*(c.tolist() for c in best.found()[:2]), strict=True))


def test_nearest_ties_and_copies(spark):
    """Blocks of any cut give the loop's rows: many copies, ties to the lesser key, zero vectors, fewer rows than k."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6))
    x[50:200] = x[3]
    x[200:230] = 0.0
    keys = rng.permutation(400)
    norm = np.sqrt((x * x).sum(1))
    for cut in (7, 64, 400):
        best = Nearest(keys[::9], x[::9], 5)
        for i in range(0, 400, cut):
            best.meet(keys[i : i + cut], x[i : i + cut])
        got = {}
        for q, key, score in zip(*(c.tolist() for c in best.found()), strict=True):
            got.setdefault(q, []).append((key, round(score, 9)))
        for i in range(0, 400, 9):
            score = np.divide(x @ x[i], norm * norm[i], out=np.zeros(400), where=norm * norm[i] > 0).round(12)
            expected = sorted((-s, k) for s, k in zip(score.tolist(), keys.tolist(), strict=True) if k != keys[i])[:5]
            assert got[keys[i]] == [(k, round(-s, 9) + 0.0) for s, k in expected]
    few = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(3)], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.vec_id) for r in nearest(few, few, 5, block=2).collect()) == [(a, b) for a in range(3) for b in range(3) if a != b]


def test_nearest_decides_in_double_precision(spark):
    """Rows that single precision cannot tell apart rank by their exact scores; vectors that are not finite hide nothing."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(1, 6)) + 1e-7 * rng.normal(size=(300, 6)), rng.normal(size=(100, 6))])[rng.permutation(400)]
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    score = np.einsum("ij,ij->i", x, np.broadcast_to(x[0], x.shape)) / (np.sqrt((x * x).sum(1)) * np.sqrt((x[0] * x[0]).sum()))
    assert len(np.unique((unit.astype(np.float32) @ unit[0].astype(np.float32)))) < 350
    odd = np.full((9, 6), np.nan)
    for cut in (50, 409):
        best = Nearest(np.array([0]), x[:1], 5)
        keys, rows = np.arange(409), np.concatenate([x, odd])
        for i in range(0, 409, cut):
            best.meet(keys[i : i + cut], rows[i : i + cut])
        _, key, got = best.found()
        assert key.tolist() == sorted(range(1, 400), key=lambda i: (-score[i], i))[:5] and np.allclose(got, score[key], rtol=0, atol=1e-15)


def test_queries_are_cut_where_pairs_of_blocks_are_few(spark):
    """Fewer pairs of blocks than cores are cut finer, and each is a task of its own, small as it may be; rows stay the same."""
    x = np.random.default_rng(6).normal(size=(2500, 3))
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    plan = nearest(df, df, 2)._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan.split("Physical Plan", 1)[1]
    best = Nearest(np.arange(2500), x, 2)
    best.meet(np.arange(2500), x)
    assert {(r.query_id, r.vec_id) for r in nearest(df, df, 2).collect()} == set(zip(*(c.tolist() for c in best.found()[:2]), strict=True))
