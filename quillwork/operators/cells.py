"""Nearest neighbours with filters over a stored index (V2): vectors in cells, written partitioned by their filters.

The index is a folder: centroids of a bounded sample, and all rows, each under its filter values and its nearest centroid's
cell.  A search reads the partitions of its filters and of the cells that its queries probe, and no others; scores are
exact, so with all cells probed the result is exact too.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .retrieval import Nearest, discard, written

#: Rows that the centroids are fitted on, the most cells, and the queries that one pass over the index serves.
SAMPLE, MOST_CELLS, QUERIES = 20_000, 1024, 10_000
#: Rows of one file of the index: a hot cell is many files.
FILE_ROWS = 500_000


def _units(df: DataFrame, vector: str, *columns: Column) -> DataFrame:
    """The columns, and v: the vector at length one, null for null and zero vectors.  The length is made once a row, not once an element."""
    v = F.col(vector).cast("array<double>")
    length = F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda a, x: a + x))
    rows = df.select(*columns, v.alias("v"), length.alias("_length"))
    return rows.withColumn("v", F.when(F.col("_length") > 0, F.transform("v", lambda x: x / F.col("_length")))).drop("_length")


def build(items: DataFrame, folder: str, key: str, vector: str, filters: Sequence[str], cells: int | None = None, sample: int = SAMPLE) -> int:
    """Writes the index and returns its number of cells (about the square root of the rows, if not given).

    All rows with a vector are indexed; null and zero vectors are not.  Null filter values are a partition of their own.
    The sample is the rows with the least hashes, so the same rows make the same index.
    """
    rows = _units(items, vector, F.col(key).cast("long").alias("k"), *map(F.col, filters)).select("k", "v", *filters).where("v is not null")
    rows = written(rows, "cells-rows")
    n = rows.count()
    if not n:
        raise ValueError("no vectors to index")
    cells = cells or min(MOST_CELLS, max(1, round(n**0.5)))
    chosen = rows.orderBy(F.xxhash64("k"), "k").limit(sample).select(array_to_vector("v").alias("x"))
    model = KMeans(k=cells, featuresCol="x", distanceMeasure="cosine", seed=7, maxIter=10).fit(chosen)
    centres = np.array(model.clusterCenters())  # at most MOST_CELLS rows
    spark = items.sparkSession
    spark.createDataFrame([(i, list(map(float, c))) for i, c in enumerate(centres)], "cell int, v array<double>").write.mode("overwrite").parquet(f"{folder}/centres")
    shared = spark.sparkContext.broadcast(centres)
    names = ["k", "v", *filters, "cell"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = (_matrix(batch.column(1)) @ shared.value.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    dealt = rows.mapInArrow(assign, f"{kinds}, cell int")
    dealt = dealt.repartition(*filters, "cell", F.pmod(F.xxhash64("k"), F.lit(-(-n // (cells * FILE_ROWS)))))
    dealt.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).partitionBy(*filters, "cell").parquet(f"{folder}/rows")
    discard(rows)
    return len(centres)


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def search(spark: SparkSession, folder: str, queries: DataFrame, k: int, query: str, vector: str, where: Column | None = None, probe: int | None = None) -> DataFrame:
    """(query, key, score, rank): each query's k most similar rows that meet `where`, ties to the lesser key; itself never.

    `where` is a condition on the filter columns; `probe` the cells that each query looks into (all, if None).  Queries
    are a stated set, looked up in blocks of QUERIES, each of which reads the index once; every task keeps and
    hands out each query's k best, so no more leave it.
    """
    centres = np.array([r.v for r in spark.read.parquet(f"{folder}/centres").orderBy("cell").collect()])  # at most MOST_CELLS
    probe = len(centres) if probe is None else min(probe, len(centres))
    asked = _units(queries, vector, F.col(query).cast("long").alias("q")).where("v is not null and q is not null").dropDuplicates(["q"])
    index = spark.read.parquet(f"{folder}/rows")
    index = index if where is None else index.where(where)
    out = spark.createDataFrame([], "q long, k long, score double")
    blocks = -(-asked.count() // QUERIES)
    for i in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).collect()  # about QUERIES rows
        ids, x = np.array([r.q for r in block]), np.array([r.v for r in block]).reshape(len(block), -1)
        if not len(block):
            continue
        by_cell = None
        if probe < len(centres):
            near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probe]
            by_cell = {int(c): np.flatnonzero((near == c).any(1)) for c in np.unique(near)}
        shared = spark.sparkContext.broadcast((ids, x, by_cell))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, x, by_cell = shared.value
            best = Nearest(ids, x, k)
            for batch in batches:
                keys, cell, v = batch.column(0).to_numpy(), batch.column(2).to_numpy(), _matrix(batch.column(1))
                if by_cell is None:
                    best.meet(keys, v)
                    continue
                for c in np.unique(cell):
                    best.meet(keys[cell == c], v[cell == c], by_cell.get(int(c), np.array([], int)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(best.found(), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["q", "k", "score"])

        part = (index if by_cell is None else index.where(F.col("cell").isin(*by_cell))).select("k", "v", "cell").mapInArrow(scan, "q long, k long, score double")
        out = out.unionByName(part)
    w = Window.partitionBy("q").orderBy(F.desc("score"), "k")
    best = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select(F.col("q").alias(query), F.col("k").alias("key"), "score", "rank")


def recall(found: DataFrame, exact: DataFrame, query: str) -> float:
    """The share of the exact neighbours that were found."""
    both = exact.select(query, "key").join(found.select(query, "key", F.lit(1).alias("_f")), [query, "key"], "left")
    return both.agg(F.coalesce(F.avg(F.coalesce("_f", F.lit(0))), F.lit(1.0))).first()[0]
