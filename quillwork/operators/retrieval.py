"""Vectors, full-text ranking, fusion, clustering and components."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillwork.functions.text import fold_words
from quillwork.functions.values import cosine

from .relational import small


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares for written intermediate tables: spark.checkpoint.dir, or the context's.

    Only a session within one process, as in tests, may do without: it gets a folder of its own.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quillwork-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows from a table in the shared folder: cuts the lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/quillwork/{df.sparkSession.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables of `written` that nothing reads any more."""
    for each in tables:
        jvm = each.sparkSession.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(each.folder)
        folder.getFileSystem(each.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of finished jobs now: it does so when the driver's garbage is collected.

    Python's references to plans reach the driver's heap about a second after they are dropped, and the first pass may drop more.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(1.2)
        spark.sparkContext._jvm.System.gc()


def exploded(df: DataFrame, tokens: Column, name: str, *kept: str) -> DataFrame:
    """The kept columns and one row a token, made once: without a row's number the optimizer makes them again to filter empty arrays."""
    rows = df.select(*kept, tokens.alias("_t"), F.monotonically_increasing_id().alias("_row"))
    return rows.select(*kept, "_row", F.explode("_t").alias(name)).where("_row >= 0").drop("_row")


def counted_words(df: DataFrame, words: Column, *kept: str) -> DataFrame:
    """The kept columns, term and tf of every row's distinct words, which have no nulls: runs of the sorted words, so nothing is shuffled."""
    rows = df.select(*kept, F.array_sort(words).alias("_w"))
    starts = F.filter(F.transform("_w", lambda w, i: F.when((i == 0) | (w != F.get("_w", i - 1)), i)), lambda i: i.isNotNull())
    rows = rows.select(*kept, "_w", starts.alias("_at"))
    runs = F.transform("_at", lambda i, j: F.struct(F.get("_w", i).alias("term"), (F.coalesce(F.get("_at", j + 1), F.size("_w")) - i).cast("long").alias("tf")))
    return exploded(rows, runs, "_run", *kept).select(*kept, "_run.term", "_run.tf")


class Nearest:
    """The k rows most similar to each query by cosine, ties to the lesser key, over blocks of rows that come one by one; itself never.

    A product of matrices in single precision says which rows can be among the k best, by a slack that its rounding cannot
    exceed, and those alone are scored pair by pair in double precision, so equal vectors have equal scores wherever they
    lie.  Of copies in one block, the k + 1 with the least keys are all that can be found.  Zero vectors score 0; vectors
    that are not finite find nothing and are not found.
    """

    ROWS, QUERIES, RUN = 2048, 1024, 64

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.norm, self.unit = self._unit(x)
        self.score, self.key = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)

    @staticmethod
    def _unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        norm = np.sqrt(np.einsum("ij,ij->i", v, v))
        return norm, (v / np.where(norm > 0, norm, 1.0)[:, None]).astype(np.float32)

    def _least_copies(self, keys: np.ndarray, v: np.ndarray) -> np.ndarray:
        by_key = np.argsort(keys, kind="stable")
        raw = np.ascontiguousarray(v[by_key]).view(np.dtype((np.void, v.itemsize * v.shape[1]))).ravel()
        group = np.unique(raw, return_inverse=True)[1].ravel()
        order = np.argsort(group, kind="stable")
        starts = np.searchsorted(group[order], group[order])
        return by_key[order[np.arange(len(order)) - starts <= self.k]]

    def meet(self, keys: np.ndarray, v: np.ndarray, among: np.ndarray | None = None) -> None:
        """Rows meet all queries, or those at the places `among`."""
        among = np.arange(len(self.ids)) if among is None else among
        if not len(keys) or not len(among):
            return
        some = self._least_copies(keys, v)
        keys, v = keys[some], v[some]
        norm, unit = self._unit(v)
        sound = ~np.isnan(unit).any(1)
        if not sound.all():
            keys, v, norm, unit = keys[sound], v[sound], norm[sound], unit[sound]
        for i in range(0, len(keys), self.ROWS):
            for j in range(0, len(among), self.QUERIES):
                self._block(keys[i : i + self.ROWS], v[i : i + self.ROWS], norm[i : i + self.ROWS], unit[i : i + self.ROWS], among[j : j + self.QUERIES])

    def _block(self, keys, v, norm, unit, qs) -> None:
        near = self.unit[qs] @ unit.T
        least = self.score[qs, -1]
        unmet = np.isneginf(least)
        if unmet.any():  # one of the k + 1 best of these rows may be the query itself
            place = max(0, len(keys) - self.k - 1)
            least[unmet] = np.partition(near[unmet], place, axis=1)[:, place]
        least = (least - (unit.shape[1] + 8) * 2.0**-23).astype(np.float32)
        q, row = self._at_least(near, least)
        other = keys[row] != self.ids[qs[q]]
        q, row = q[other], row[other]
        if not len(q):
            return
        size = norm[row] * self.norm[qs[q]]
        score = np.concatenate([np.einsum("ij,ij->i", v[row[a : a + 65_536]], self.x[qs[q[a : a + 65_536]]]) for a in range(0, len(q), 65_536)])
        score /= np.where(size > 0, size, np.inf)
        had = ~np.isneginf(self.score[qs])
        q = np.concatenate([np.nonzero(had)[0], q])
        score, key = np.concatenate([self.score[qs][had], score]), np.concatenate([self.key[qs][had], keys[row]])
        order = np.lexsort((key, -score, q))
        q, score, key = q[order], score[order], key[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < self.k
        self.score[qs[q[top]], rank[top]], self.key[qs[q[top]], rank[top]] = score[top], key[top]

    def _at_least(self, near: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places that reach their query's least, looked for in runs of rows whose maximum does: after the first blocks, few."""
        whole = near.shape[1] // self.RUN * self.RUN
        runs = near[:, :whole].reshape(len(near), whole // self.RUN, self.RUN)
        q, run = np.nonzero(runs.max(2) >= least[:, None])
        at = np.flatnonzero(runs[q, run] >= least[q, None])
        rest, row = np.nonzero(near[:, whole:] >= least[:, None])
        return np.concatenate([q[at // self.RUN], rest]), np.concatenate([run[at // self.RUN] * self.RUN + at % self.RUN, row + whole])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, keys and scores."""
        q, rank = np.nonzero(~np.isneginf(self.score))
        return self.ids[q], self.key[q, rank], self.score[q, rank]


def nearest(
    queries: DataFrame, items: DataFrame, k: int, query: str = "query_id", key: str = "vec_id", vector: str = "embedding", block: int = 16_384
) -> DataFrame:
    """The k items most similar to each query by cosine, ties to the least key (V2); an item never finds itself.

    Exact: a stated set of queries meets all items in blocks of a bounded size on both sides; each pair of blocks keeps
    its k best for a query, and those are ranked again.  Queries are cut finer where there are fewer pairs than cores.
    """

    def search(pair_key, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out: tuple = ([], [], [])
        if len(q) and len(x):
            best = Nearest(q["id"].to_numpy(), np.stack(q["v"]).astype(float), k)
            best.meet(x["id"].to_numpy(), np.stack(x["v"]).astype(float))
            out = best.found()
        return pd.DataFrame(dict(zip((query, key, "score"), out, strict=True))).astype({query: "int64", key: "int64", "score": "float64"})

    n, m = items.count(), queries.count()
    deals = [max(1, -(-n // block)), max(1, -(-m // block))]
    deals[1] = max(deals[1], min(-(-3 * items.sparkSession.sparkContext.defaultParallelism // deals[0]), -(-m // Nearest.QUERIES)))
    pairs = deals[0] * deals[1]
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    own = lambda n, name: F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int").alias(name)
    q = queries.select(F.col(key).alias("id"), F.col(vector).alias("v"), own(deals[1], "bq"), every(deals[0], "bx"))
    x = items.select(F.col(key).alias("id"), F.col(vector).alias("v"), own(deals[0], "bx"), every(deals[1], "bq"))
    q, x = (side.repartition(pairs, "bx", "bq") for side in (q, x))  # by number, or small blocks would be put together in few tasks
    found = q.groupBy("bx", "bq").cogroup(x.groupBy("bx", "bq")).applyInPandas(search, f"{query} long, {key} long, score double")
    w = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def affinity(items: DataFrame, fragments: DataFrame, key: str, profile: str, vector: str, fragment: str) -> DataFrame:
    """Each item's best similarity to a profile's fragments (V5, A20): profiles are a few rows of configuration."""
    pairs = items.select(key, vector).crossJoin(small(fragments.select(profile, fragment)))
    return pairs.groupBy(key, profile).agg(F.max(cosine(vector, fragment)).alias("affinity"))


def postings(docs: DataFrame, key: str, fields: dict[str, float], terms: Sequence[str] | None = None) -> DataFrame:
    """(term, key, field, tf) of the folded words of the fields (V3), of the given terms alone if there are any."""
    wanted = (lambda w: w.isin(*terms)) if terms is not None else (lambda w: w != "")
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.filter(F.split(fold_words(f), " "), wanted).alias("w")) for f in fields])
    rows = docs.select(key, F.explode(parts).alias("p")).select(key, "p.field", F.explode("p.w").alias("term"))
    return rows.groupBy("term", key, "field").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, key: str, fields: dict[str, float], terms: Sequence[str], k1: float = 1.2, b: float = 0.75, every: bool = True) -> DataFrame:
    """Weighted BM25 of the documents that hold all (or any) of a query's terms (V3).

    Field lengths and their means are over all documents; tf of a document is the weighted sum over its fields.
    Lengths and counted words are written, so texts are not split again for each use of them.
    """
    index = postings(docs, key, fields, terms)
    size = F.size(F.filter(F.split(fold_words(F.concat_ws(" ", *fields)), " "), lambda w: w != ""))
    sized = written(docs.select(key, size.alias("len")), "bm25-sizes")
    stats = sized.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    weight = F.create_map(*[F.lit(x) for kv in fields.items() for x in kv])
    tf = written(index.groupBy("term", key).agg(F.sum(F.col("tf") * weight[F.col("field")]).alias("tf")), "bm25-words")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    rows = tf.join(F.broadcast(df), "term").join(sized, key).crossJoin(F.broadcast(stats))  # df: a row a query term; stats: one
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    gain = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    out = rows.groupBy(key).agg(F.sum(gain).alias("score"), F.count("*").alias("matched"))
    return (out.where(F.col("matched") == len(set(terms))) if every else out).drop("matched")


def tfidf(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, token, df, weight): TF-IDF vectors of length one, idf = ln((1 + N) / (1 + df)) + 1.

    Null and empty arrays have no vector, but count in N; a key's rows must be one.
    """
    tf = df.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))
    freq = tf.groupBy("token").agg(F.count("*").alias("df"))
    total = df.agg(F.count("*").alias("n"))
    rows = tf.join(freq, "token").crossJoin(F.broadcast(total))  # one row
    rows = rows.withColumn("weight", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(key)))
    return rows.select(key, "token", "df", (F.col("weight") / length).alias("weight"))


def similar_by_tfidf(vectors: DataFrame, key: str, least: float) -> DataFrame:
    """a, b, score: the pairs of TF-IDF vectors with a cosine of at least `least`.

    In the order from rare to common, the first token that a similar pair shares must leave either vector at least
    `least` of its length, so only such tokens are met; the score is then summed over all of them.
    """
    order = Window.partitionBy(key).orderBy("df", "token").rowsBetween(0, Window.unboundedFollowing)
    rest = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(order))
    first = vectors.withColumn("_rest", rest).where(F.col("_rest") >= least - 1e-9).select(key, "token")
    pairs = first.select(F.col(key).alias("a"), "token").join(first.select(F.col(key).alias("b"), "token"), "token").where("a < b").select("a", "b").distinct()
    x = vectors.select(F.col(key).alias("a"), "token", F.col("weight").alias("x"))
    y = vectors.select(F.col(key).alias("b"), "token", F.col("weight").alias("y"))
    score = pairs.join(x, "a").join(y, ["b", "token"]).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("score"))
    return score.where(F.col("score") >= least)


def fused(first: DataFrame, second: DataFrame, key: str, k: int = 60, names: tuple[str, str] = ("words", "meaning")) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (key, rank): score, source, ties by the first list's rank (V4)."""
    a, b = first.select(key, F.col("rank").alias("ra")), second.select(key, F.col("rank").alias("rb"))
    both = a.join(b, key, "full")
    score = F.coalesce(1 / (k + F.col("ra")), F.lit(0.0)) + F.coalesce(1 / (k + F.col("rb")), F.lit(0.0))
    source = F.when(F.col("rb").isNull(), names[0]).when(F.col("ra").isNull(), names[1]).otherwise("both")
    return both.select(key, score.alias("score"), source.alias("source"), "ra", "rb")


def bm25_many(
    questions: DataFrame, docs: DataFrame, query: str, asked: str, key: str, text: str, k: int, k1: float = 1.2, b: float = 0.75
) -> DataFrame:
    """(query, key, score, rank): the k best documents of each question by BM25, ties to the lesser key.

    All questions run as one job: their distinct words meet the documents' words, counted by document, in an equi-join,
    and only words that a question asks leave the documents, which are read once and written.  Counted words are dealt by
    document, so that a document's scores are summed where it lies.  Scores are compared to nine decimals.  Null and
    empty questions find nothing; null texts are empty, and count in the mean length.
    """
    words = lambda c: F.filter(F.split(fold_words(F.coalesce(F.col(c), F.lit(""))), " "), lambda w: w != "")
    ask = written(questions.select(F.col(query).alias("q"), F.explode(F.array_distinct(words(asked))).alias("term")), "asked")
    sized = docs.select(F.col(key).alias("d"), words(text).alias("w"))
    sized = sized.select("d", F.size("w").alias("n"), F.concat(F.array(F.lit("")), "w").alias("w"))  # the empty word stands for the document
    wanted = ask.select("term").union(docs.sparkSession.range(1).select(F.lit(""))).distinct()
    every = exploded(sized, F.col("w"), "term", "d", "n").join(small(wanted), "term", "left_semi").groupBy("term", "d", "n").agg(F.count("*").alias("tf"))
    every = written(every, "bm25-words")
    stats = every.where("term = ''").agg(F.sum("tf").alias("docs"), (F.sum(F.col("n") * F.col("tf")) / F.sum("tf")).alias("mean"))
    tf = every.where("term <> ''")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    gain = tf.repartition("d").join(small(df), "term").crossJoin(F.broadcast(stats))  # one row
    gain = gain.withColumn("gain", F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean"))))
    score = gain.join(small(ask), "term").groupBy("q", "d").agg(F.round(F.sum("gain"), 9).alias("score"))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "d")
    best = score.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select(F.col("q").alias(query), F.col("d").alias(key), "score", "rank")


def context(
    questions: DataFrame, items: DataFrame, k: int = 8, *, query: str = "query_id", asked: str = "asked", key: str = "key", text: str = "text",
    vector: str = "v", url: str = "url", kind: str = "kind", date: str = "date", title: str = "title", pool: int = 40, fusion: int = 60,
) -> DataFrame:
    """(query, key, place, source, line): what is related to each question, by words and by meaning, in one job.

    Each question's best `pool` items by BM25 and by cosine are fused by reciprocal ranks, ties to the better rank by
    words and then to the lesser key; items with the question's own key or URL go, and of the rest the first `k` stay, as
    a line "- [kind · date] title".  Questions are a stated set and meet items in blocks; a question without a vector is
    answered by words alone; a null URL excludes nothing; null dates and titles are written out as unknown and empty.
    """
    said = bm25_many(questions, items, query, asked, key, text, pool).select(query, key, F.col("rank").alias("rw"))
    qs = questions.where(F.col(vector).isNotNull()).select(F.col(query).alias(key), F.col(vector).alias("embedding"))
    near = nearest(qs, items.where(F.col(vector).isNotNull()).select(key, F.col(vector).alias("embedding")), pool, query, key).select(query, key, F.col("rank").alias("rm"))
    both = said.join(near, [query, key], "full")
    score = F.coalesce(1 / (fusion + F.col("rw")), F.lit(0.0)) + F.coalesce(1 / (fusion + F.col("rm")), F.lit(0.0))
    own = questions.select(query, F.col(url).alias("_own"))
    told = items.select(key, F.col(url).alias("_url"), F.concat(F.lit("- ["), F.coalesce(F.col(kind).cast("string"), F.lit("?")), F.lit(" · "), F.coalesce(F.col(date).cast("string"), F.lit("no date")), F.lit("] "), F.coalesce(F.col(title), F.lit(""))).alias("line"))
    rows = both.join(own, query).join(told, key).where((F.col(key) != F.col(query)) & ~F.coalesce(F.col("_url") == F.col("_own"), F.lit(False)))
    source = F.when(F.col("rm").isNull(), "words").when(F.col("rw").isNull(), "meaning").otherwise("both")
    w = Window.partitionBy(query).orderBy(F.desc(F.round(score, 12)), F.col("rw").asc_nulls_last(), key)
    return rows.withColumns({"place": F.row_number().over(w), "source": source}).where(F.col("place") <= k).select(query, key, "place", "source", "line")


def banded_pairs(
    rows: DataFrame, key: str, vector: str, block: Sequence[str], band: str, width: int, least: float, apart: Sequence[str] = ()
) -> DataFrame:
    """Similar pairs with equal blocks, bands at most `width` apart and the `apart` columns different.

    The band (a day, say) bounds what meets: an equi-join on the block and a neighbouring band.
    """
    extra = [F.col(c) for c in apart]
    a = rows.select(*block, F.col(key).alias("a"), F.col(vector).alias("va"), F.col(band).alias("ba"), *[c.alias(f"a_{n}") for c, n in zip(extra, apart, strict=True)])
    b = rows.select(*block, F.col(key).alias("b"), F.col(vector).alias("vb"), F.col(band).alias("bb"), *[c.alias(f"b_{n}") for c, n in zip(extra, apart, strict=True)])
    a = a.withColumn("_near", F.explode(F.sequence(F.col("ba") - width, F.col("ba") + width)))
    pairs = a.join(b.withColumn("_near", F.col("bb")), [*block, "_near"]).where("a < b")
    for n in apart:
        pairs = pairs.where(~F.col(f"a_{n}").eqNullSafe(F.col(f"b_{n}")))
    return pairs.withColumn("score", cosine("va", "vb")).where(F.col("score") >= least).select("a", "b", "score")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that links reach, over all nodes of the edges.

    Hooking to the least neighbour, shortcutting and contracting; each round is written, so rounds are logarithmic and a
    lost executor costs its own tasks only.
    """
    left = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    labels: DataFrame | None = None
    while left.limit(1).count():
        both = left.union(left.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).select("node", F.least("node", "p").alias("p"))
        for _ in range(2):
            up = parent.select(F.col("node").alias("p"), F.col("p").alias("q"))
            parent = parent.join(up, "p", "left").select("node", F.coalesce("q", "p").alias("p"))
        parent = written(parent, "parents")
        hop = lambda side, out: parent.select(F.col("node").alias(side), F.col("p").alias(out))  # noqa: E731, B023
        moved = left.join(hop("a", "x"), "a").join(hop("b", "y"), "b").where("x <> y")
        left = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if labels is None:
            labels = parent.withColumnRenamed("p", "component")
        else:
            up = parent.select(F.col("node").alias("component"), F.col("p").alias("q"))
            labels = written(labels.join(up, "component", "left").select("node", F.coalesce("q", "component").alias("component")), "labels")
    if labels is None:
        kind = edges.schema[a].dataType.simpleString()
        return edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    return labels


def verdicts(rows: DataFrame, key: Sequence[str], source: str, precedence: Sequence[str]) -> DataFrame:
    """One verdict a pair, from the most trusted source."""
    rank = F.array_position(F.array(*map(F.lit, precedence)), F.col(source))
    rank = F.when(rank == 0, len(precedence) + 1).otherwise(rank)
    w = Window.partitionBy(*key).orderBy(rank, source)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def hashed_vector(c: Column, buckets: int = 64) -> Column:
    """A unit vector of hashed word counts: the stand-in for a model's embedding (V1), Arrow-batched as a model would be."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            places = [zlib.crc32(w.encode()) % buckets for w in re.findall(r"\w+", (text or "").lower())]
            v = np.bincount(np.array(places, int), minlength=buckets).astype(float)
            out.append((v / max(1e-12, np.sqrt(v @ v))).tolist())
        return pd.Series(out)

    return embed(c)
