"""Approximate nearest neighbours by learned partitions (operator 7).

The neighbour graph of a bounded sample is cut into balanced parts by recursive bisection, and a softmax classifier
learns to tell a vector's part.  The number of parts grows with the square root of the table: beyond `LEVEL` parts every
part is cut again, by a graph and a classifier of its own, learned on the executors from a bounded sample of its rows.
Every row is indexed under its most probable part; a query looks into its several most probable parts, and what it finds
there is ranked by exact cosine.

The number of parts it looks into is the smallest that reaches `AIM` of the true neighbours, among all rows, of `ASKED`
rows that the fit has not seen; they are compared with the whole table in one pass.  Queries travel to the parts; a part
is dealt to several tasks, and its rows or queries are repeated, only if it is larger than a block.  A query that finds
fewer than k rows in its parts is run again against all parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_append, arrow_map, discard, table, written

#: Rows that one classifier learns from, and rows asked to choose the number of parts that a query looks into.
SAMPLE, ASKED = 8_192, 256
#: Parts of one level; two levels at most, which bounds the broadcast classifiers.
LEVEL = 256
AIM = 0.95
BLOCK, QUERY_BLOCK = 65_536, 16_384


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that their largest component is between a half and one: no rounding, no overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one."""
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def neighbours(x: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k nearest other rows of x to the rows `queries`, block by block."""
    out = []
    for a in range(0, len(queries), 512):
        rows = queries[a : a + 512]
        sims = x[rows] @ x.T
        sims[np.arange(len(rows)), rows] = -np.inf
        out.append(np.argpartition(-sims, k - 1, axis=1)[:, :k].copy())  # not a view: that would keep the whole block
    return np.concatenate(out) if out else np.zeros((0, k), int)


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 0) -> np.ndarray:
    """A part for each node of a neighbour graph: recursive bisection at the median of a smooth vector, then swaps."""
    n, rng = len(graph), np.random.default_rng(seed)
    a = np.repeat(np.arange(n), graph.shape[1])
    b = graph.ravel()
    part = np.zeros(n, int)
    for level in range(int(np.log2(parts))):
        inside = part[a] == part[b]
        u, v = np.r_[a[inside], b[inside]], np.r_[b[inside], a[inside]]
        degree = np.bincount(u, minlength=n) + 1.0
        sizes = np.bincount(part, minlength=1 << level)
        y = rng.standard_normal(n)
        for _ in range(60):  # power steps towards the smoothest vector of each part
            y = 0.5 * y + 0.5 * (np.bincount(u, y[v], n) + y) / degree
            mean = np.bincount(part, y * degree, 1 << level) / np.bincount(part, degree, 1 << level).clip(1e-9)
            y -= mean[part]
            y /= np.sqrt(np.bincount(part, y * y, 1 << level).clip(1e-30))[part]
        order = np.lexsort((y, part))
        start = np.r_[0, np.cumsum(sizes)][:-1]
        rank = np.empty(n, int)
        rank[order] = np.arange(n) - start[part[order]]
        side = (rank >= (sizes[part] + 1) // 2).astype(int)
        for _ in range(4):  # exchange as many nodes of each side as gain by it
            gain = np.bincount(u, np.where(side[u] != side[v], 1, -1), n)
            best = np.lexsort((-gain, side, part))
            group = 2 * part[best] + side[best]
            first = np.r_[0, np.flatnonzero(np.diff(group)) + 1]
            place = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
            willing = np.zeros((1 << level) * 2, int)
            np.add.at(willing, group, gain[best] > 0)
            swap = np.minimum(willing[0::2], willing[1::2]) // 2
            moved = best[place < swap[part[best]]]
            if not len(moved):
                break
            side[moved] ^= 1
        part = 2 * part + side
    return part


def classifier(x: np.ndarray, target: np.ndarray, steps: int = 250, rate: float = 0.1) -> np.ndarray:
    """Weights of a softmax classifier; the last row is the bias."""
    w = np.zeros((x.shape[1] + 1, target.shape[1]))
    x = np.c_[x, np.ones(len(x))]
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        grad = x.T @ ((p / p.sum(axis=1, keepdims=True) - target) / len(x))
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad * grad
        w -= rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-9)
    return w


def fit(x: np.ndarray, parts: int, seed: int = 0) -> np.ndarray:
    """Weights that tell the part of a unit vector, learned from the neighbour graph of x; fewer parts if x is too small."""
    parts = min(parts, 1 << max(0, (len(x) // 8).bit_length() - 1))
    if parts < 2:
        return np.zeros((x.shape[1] + 1, 1))
    near = neighbours(x, np.arange(len(x)), min(10, len(x) - 1))
    part = balanced_parts(near, parts, seed)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), part[near.ravel()]), 0.5 / near.shape[1])
    target[np.arange(len(x)), part] += 0.5
    return classifier(x, target)


def _log_softmax(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = x @ w[:-1] + w[-1]
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


@dataclass
class Router:
    """Classifiers of one level or two.  Part numbers count the second level's parts top by top."""

    top: np.ndarray
    inner: dict[int, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.sizes = np.array([self.inner[t].shape[1] if t in self.inner else 1 for t in range(self.top.shape[1])])
        self.first = np.r_[0, np.cumsum(self.sizes)]
        self.parts = int(self.first[-1])

    def logs(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities of all parts."""
        top = _log_softmax(x, self.top)
        if not self.inner:
            return top
        return np.concatenate([top[:, t : t + 1] + (_log_softmax(x, self.inner[t]) if t in self.inner else 0) for t in range(top.shape[1])], axis=1)

    def home(self, x: np.ndarray) -> np.ndarray:
        """The part that each row is indexed under: the most probable one of its most probable top."""
        top = _log_softmax(x, self.top).argmax(axis=1)
        out = self.first[top]
        for t in np.unique(top).tolist():
            if t in self.inner:
                mine = top == t
                out[mine] += _log_softmax(x[mine], self.inner[t]).argmax(axis=1)
        return out

    def ranked(self, x: np.ndarray, most: int) -> np.ndarray:
        step = max(1, 2_000_000 // self.parts)
        found = [np.argsort(-self.logs(x[a : a + step]), axis=1, kind="stable")[:, :most].copy() for a in range(0, len(x), step)]
        return np.concatenate(found) if found else np.zeros((0, most), int)


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the vectors that take part; v holds doubles."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    good = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(good, F.lit(False)))


def _matrix(values) -> np.ndarray:
    return np.stack([np.frombuffer(v) for v in values])


def _search_block(k: int):
    def search(found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(found) and len(asked):
            ids, x = found["id"].to_numpy(), scaled(_matrix(found["v"]))
            qids, q = asked["id"].to_numpy(), scaled(_matrix(asked["v"]))
            near, lengths = unit(x), np.sqrt((x * x).sum(axis=1))
            step = max(1, 4_000_000 // len(x))
            for a in range(0, len(q), step):
                sims = unit(q[a : a + step]) @ near.T
                for row, s in enumerate(sims, a):
                    s[ids == qids[row]] = -np.inf
                    take = min(k, len(s))
                    least = np.partition(s, len(s) - take)[len(s) - take]
                    close = np.flatnonzero((s >= least - 1e-9) & (s > -np.inf))
                    exact = (x[close] * q[row]).sum(axis=1) / (lengths[close] * np.sqrt((q[row] * q[row]).sum()))
                    best = np.lexsort((ids[close], -exact))[:take]
                    out += [(qids[row], ids[close[j]], exact[j]) for j in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return search


def parts_for(total: int) -> int:
    """A power of two next to the square root of the number of rows."""
    return 1 << max(0, round(np.log2(max(1, total)) / 2))


def learn(rows: DataFrame, total: int, dims: int, k: int = 5, sample: int = SAMPLE, level: int = LEVEL) -> tuple[Router, DataFrame, int, float]:
    """The router, the written index (id, v, q, p), the parts to look into, and the recall that they reach.

    `rows` (id, v, q) hold vectors of one length, as bytes.
    """
    asked = min(ASKED, total // 4)
    order = rows.orderBy(F.xxhash64("id", F.lit("ann")), "id").select("id", "v")
    taken = order.limit(asked + sample).toPandas()
    asks, x = taken.iloc[:asked], unit(_matrix(taken["v"][asked:]).reshape(-1, dims))
    parts = parts_for(total)
    top = fit(x, min(parts, level))
    router = Router(top)
    if parts > level:
        router = Router(top, _inner(rows, router, min(level, parts // level), sample))
    index = written(_homes(rows, router, dims), "ann")
    if not asked or router.parts == 1:
        return router, index, 1, 1.0
    ids, queries = asks["id"].to_numpy(), unit(_matrix(asks["v"]))
    home = _nearest_homes(index, ids, queries, k)
    place = router.ranked(queries, router.parts).argsort(axis=1)  # of each part among those that a query asks
    found = np.array([place[r.a, r.p] for r in home])
    recall = np.cumsum(np.bincount(found, minlength=router.parts)) / max(1, len(found))
    probes = int(np.argmax(recall >= AIM)) + 1
    return router, index, probes, float(recall[probes - 1])


def _homes(rows: DataFrame, router: Router, dims: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(router)

    def start():
        def each(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            x = unit(_matrix(batch.column(0).to_pylist()).reshape(-1, dims)) if batch.num_rows else np.zeros((0, dims))
            return {"p": pa.array(shared.value.home(x).astype(np.int32), pa.int32())}

        return each

    return arrow_append(rows, ["v"], start, "p int", ["id", "v", "q"])


def _inner(rows: DataFrame, router: Router, parts: int, sample: int) -> dict[int, np.ndarray]:
    """Classifiers within each top part, learned on the executors from about `sample` rows of it."""
    dims = router.top.shape[0] - 1
    placed = written(_homes(rows, router, dims), "tops")
    share = {r.p: min(1.0, sample / r["count"]) for r in placed.groupBy("p").count().collect()}
    draw = F.pmod(F.xxhash64("id", F.lit("inner")), F.lit(1 << 30)) / float(1 << 30)
    limits = F.create_map(*[F.lit(v) for kv in share.items() for v in kv])

    def train(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("id")
        w = fit(unit(_matrix(found["v"])), parts)
        return pd.DataFrame({"p": [int(found["p"].iloc[0])], "w": [w.tobytes()]})

    learned = placed.where(draw < limits[F.col("p")]).groupBy("p").applyInPandas(train, "p int, w binary").collect()
    discard(placed)
    return {r.p: np.frombuffer(r.w).reshape(dims + 1, -1) for r in learned}


def _nearest_homes(index: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> list:
    """(a, p): the parts p in which the k true neighbours, among all rows, of the a-th asked row lie."""
    shared = index.sparkSession.sparkContext.broadcast((ids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        best = np.full((len(ids), k), -np.inf)
        near, home = np.full((len(ids), k), -1), np.zeros((len(ids), k), int)
        for batch in batches:
            own, p = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            sims = queries @ unit(_matrix(batch.column(1).to_pylist())).T
            sims[ids[:, None] == own[None, :]] = -np.inf
            sims = np.c_[best, sims]
            at = np.argsort(-sims, axis=1, kind="stable")[:, :k]
            near = np.take_along_axis(np.c_[near, np.broadcast_to(own, (len(ids), len(own)))], at, 1)
            home = np.take_along_axis(np.c_[home, np.broadcast_to(p, (len(ids), len(p)))], at, 1)
            best = np.take_along_axis(sims, at, 1)
        a = np.repeat(np.arange(len(ids)), k)
        some = best.ravel() > -np.inf
        arrays = [pa.array(c.ravel()[some]) for c in (a, near, home)] + [pa.array(best.ravel()[some])]
        yield pa.RecordBatch.from_arrays(arrays, ["a", "id", "p", "s"])

    found = arrow_map(index.select("id", "v", "p"), run, "a long, id long, p long, s double")
    order = Window.partitionBy("a").orderBy(F.desc("s"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("a", "p").collect()


def search(
    vectors: DataFrame, is_query: F.Column, *, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE, level: int = LEVEL
) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest found; ties go to the smaller vec_id.

    `is_query` is a condition on the column `id`.  Vectors that are null, zero or hold a null or non-finite component
    take no part, nor do null ids.  Vectors of another length than the commonest are compared with their like, all of
    them.  Repeated rows of one id count once, as its smallest vector.  An empty table gives no rows.
    """
    rows = _usable(vectors, id_col, vec_col)
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))

    def start():
        return lambda batch: {"b": pa.array([np.array(v, np.float64).tobytes() for v in batch.column(0).to_pylist()], pa.binary())}

    rows = arrow_append(rows, ["v"], start, "b binary", ["id"])
    rows = written(rows.select("id", F.col("b").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"), (F.length("b") / 8).cast("int").alias("dims")), "vectors")
    lengths = rows.groupBy("dims").count().orderBy(F.desc("count"), "dims").limit(1).collect()
    dims, total = (lengths[0]["dims"], lengths[0]["count"]) if lengths else (1, 0)
    if not total:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    router, indexed, probes, _ = learn(rows.where(F.col("dims") == dims).drop("dims"), total, dims, k, sample, level)
    # vectors of another length lie in a part of their own, of a negative number
    other = rows.where(F.col("dims") != dims).select("id", "v", "q", (-F.col("dims")).alias("p"))
    indexed = indexed.union(other)
    shared = rows.sparkSession.sparkContext.broadcast(router)

    def ranked():
        def each(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            p = batch.column(1).to_pylist()
            out = [[x] for x in p]
            mine = [i for i, x in enumerate(p) if x >= 0]
            if mine:
                values = batch.column(0).to_pylist()
                best = shared.value.ranked(unit(_matrix([values[i] for i in mine])), probes).tolist()
                for i, found in zip(mine, best, strict=True):
                    out[i] = found
            return {"parts": pa.array(out, pa.list_(pa.int32()))}

        return each

    asked = arrow_append(indexed.where("q"), ["v", "p"], ranked, "parts array<int>", ["id", "v"])
    asked = written(asked.select("id", "v", F.explode("parts").alias("p")), "asked")
    found = written(_ask(indexed, asked, k), "ann")
    if probes < router.parts:
        served = written(found.where(F.col("rank") == min(k, max(1, total - 1))).select(F.col("query_id").alias("id")), "served")
        short = written(indexed.where("q and p >= 0").join(served, "id", "left_anti").select("id", "v"), "short")
        if short.limit(1).count():
            every = short.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(router.parts - 1))))
            again = _ask(indexed.where("p >= 0"), every, k)
            found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _ask(indexed: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score, rank of the k nearest rows in the parts asked; larger parts are dealt in blocks."""
    rows = {r.p: r["count"] for r in indexed.groupBy("p").count().collect()}
    queries = {r.p: r["count"] for r in asked.groupBy("p").count().collect()}
    blocks = {p: (-(-rows.get(p, 1) // BLOCK), -(-queries[p] // QUERY_BLOCK)) for p in queries}
    large = {p: b for p, b in blocks.items() if b != (1, 1)}

    def block(side: int, own: F.Column) -> F.Column:
        """A row's own block, or all blocks of the other side."""
        counts = F.create_map(*[F.lit(v) for p, b in large.items() for v in (p, b[side])]) if large else None
        count = F.coalesce(counts[F.col("p")], F.lit(1)) if large else F.lit(1)
        return F.pmod(own, count).cast("int") if side == mine else F.explode(F.sequence(F.lit(0), count - 1))

    mine = 0
    found = indexed.select("id", "v", "p")
    found = found.withColumn("c", block(0, F.xxhash64("id"))).withColumn("d", block(1, F.lit(0)))
    mine = 1
    wanted = asked.withColumn("d", block(1, F.xxhash64("id", F.lit(1)))).withColumn("c", block(0, F.lit(0)))
    pairs = found.groupBy("p", "c", "d").cogroup(wanted.groupBy("p", "c", "d"))
    near = pairs.applyInPandas(_search_block(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


QUERIES = {"op7_ann": op7_ann}
ORACLES: dict[str, str] = {}
