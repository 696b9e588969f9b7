"""Substring deduplication by De Bruijn compaction (operator 1).

The edges of the graph are the windows of `window` consecutive words.  They never travel one by one: a run of windows
that share their minimizer (the smallest hash among their `gram`-word grams) is one piece of a path, named by that
minimizer, its anchor, and a hash of its words, as in partitioned De Bruijn compaction.

1. Pieces are cut once and written with their source coordinates (text, first word); equal texts share one entry.
2. Pieces are grouped by content, and contents by anchor.  An anchor with one content does not branch: all windows there
   are repeated, if the content stands at two places, or none is.  Anchors that stand once in the corpus go.
3. A join brings each repeated content, with its least source, to all its pieces.  What does not branch stays compact:
   one row for the whole piece.  A text's repeated pieces that follow one another end as one span.
4. One pass over the texts verifies and expands.  Each repeated piece is read at its coordinates and its words are
   compared, by a 128-bit cryptographic digest, with those at the source coordinates.  At branching anchors single
   pieces, and one source of each repeated content, are expanded into their windows, named by digests of their words.
5. Windows that stand at two coordinates, and the verified paths, are the repeated spans.  Should words differ under one
   name, the pieces with that name are expanded as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, WordHashes, arrow_append, arrow_map, discard, mix, table, texts, written
from .oracles import OP1

WINDOW, GRAM = 35, 8
_CHUNK = 1 << 20
_LOW = np.uint64((1 << 30) - 1)
_S = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
#: Rows of one Arrow batch that a task gives back.
_ROWS = 50_000


class Hasher:
    """Pieces of a text's words; `bits` of their hashes are used, all but in tests."""

    def __init__(self, window: int, gram: int, bits: int = 64):
        self.window, self.gram, self.shift = window, gram, np.uint64(64 - bits)
        self.words, self.one = WordHashes(), Rolling(0x5851F42D4C957F2D)

    def pieces(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        """anchor, content, lo, n of the text's pieces, chunk by chunk."""
        for a in range(0, len(words) - self.window + 1, _CHUNK):
            anchor, content, lo, n = self._pieces(words[a : a + _CHUNK + self.window - 1])
            yield anchor, content, lo + a, n

    def _pieces(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        prefix = self.one.prefix(self.words.of(words))
        grams = self.one.windows(prefix, self.gram)
        key = (mix(grams ^ _S[0]) & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        width, count = self.window - self.gram + 1, len(words) - self.window + 1
        least, size = key, 1
        while 2 * size <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[:count], least[width - size : width - size + count])
        at = (least & _LOW).astype(np.int64)
        lo = np.r_[0, np.flatnonzero(np.diff(at)) + 1]
        n = np.diff(np.r_[lo, count])
        at = at[lo]
        with np.errstate(over="ignore"):
            shape = (at - lo).astype(np.uint64) * _S[0] + n.astype(np.uint64) * _S[1]
            content = mix(self.one.spans(prefix, lo, lo + n + self.window - 1) ^ shape)
        return grams[at] >> self.shift, content >> self.shift, lo, n


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and t1, t2, which name a text by 128 bits; null texts are empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))


def pieces(keyed: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = 64) -> DataFrame:
    """One row per piece: anchor, content, text (t1, t2), first window lo and number of windows n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(window, gram, bits)
        for batch in batches:
            rows, owner, held = [], [], 0
            for i, text in enumerate(texts(batch.column(0))):
                for found in hasher.pieces(text.split()):
                    rows.append(found)
                    owner.append(np.full(len(found[0]), i))
                    held += len(found[0])
                    if held > _ROWS:
                        yield made(batch, rows, owner)
                        rows, owner, held = [], [], 0
            if held:
                yield made(batch, rows, owner)

    def made(batch: pa.RecordBatch, rows: list, owner: list) -> pa.RecordBatch:
        own = pa.array(np.concatenate(owner))
        anchor, content, lo, n = (np.concatenate(c) for c in zip(*rows, strict=True))
        arrays = [_long(anchor), _long(content), batch.column(1).take(own), batch.column(2).take(own), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32))]
        return pa.RecordBatch.from_arrays(arrays, ["anchor", "content", "t1", "t2", "lo", "n"])

    fields = "anchor long, content long, t1 long, t2 long, lo int, n int"
    return arrow_map(keyed.select("text", "t1", "t2"), run, fields)


def repeated_spans(keyed: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = 64) -> DataFrame:
    """Written: t1, t2 and spans, array<struct<lo, n>> of the repeated windows, of every text that has any."""
    # what a join takes from an aggregate is written first: a join of two plain shuffles can split hot keys
    found = pieces(keyed, window, gram, bits).groupBy("anchor", "content", "t1", "t2", "lo", "n").agg(F.count("*").alias("copies"))
    found = written(found, "pieces")
    contents = found.groupBy("anchor", "content").agg(F.sum("copies").alias("copies"), F.min(F.struct("t1", "t2", "lo")).alias("source"))
    contents = written(contents, "contents")
    anchors = contents.groupBy("anchor").agg((F.count("*") > 1).alias("branches"), F.sum("copies").alias("n")).where("n > 1").drop("n")
    anchors = written(anchors, "anchors")
    shared = contents.join(anchors, "anchor").select("anchor", "content", "source", (F.col("copies") > 1).alias("repeated"), "branches")
    shared = written(shared, "shared")
    discard(contents, anchors, release=True)

    single = "branches and (not repeated or (t1 = source.t1 and t2 = source.t2 and lo = source.lo))"
    placed = found.join(shared, ["anchor", "content"]).where(f"repeated or ({single})")
    one = F.struct("lo", "n", "anchor", "content", "repeated", F.expr(single).alias("expand"), (F.col("copies") > 1).alias("twice"))
    placed = written(placed.groupBy("t1", "t2").agg(F.sort_array(F.collect_list(one)).alias("places")), "placed")
    discard(found, shared, release=True)

    read = written(_read(keyed, placed, window), "read")
    paths = read.where("not edge")
    names = paths.groupBy("k1", "k2").agg(F.min(F.struct("d1", "d2")).alias("a"), F.max(F.struct("d1", "d2")).alias("z"))
    differ = written(names.where("a <> z").select("k1", "k2"), "differ")
    edges = read.where("edge")
    if differ.limit(1).count():  # words differ under one name: all pieces of that name are expanded, sources and all
        wrong = written(paths.join(differ, ["k1", "k2"], "left_semi"), "wrong")
        paths = paths.join(differ, ["k1", "k2"], "left_anti").union(wrong.where("twice"))
        opened = placed.join(wrong.groupBy("t1", "t2").agg(F.collect_set("at").alias("wrong")), ["t1", "t2"])
        opened = opened.select("t1", "t2", F.filter("places", lambda p: F.array_contains("wrong", p["lo"])).alias("places"))
        opened = opened.withColumn("places", F.transform("places", lambda p: p.withField("expand", F.lit(True))))
        edges = edges.union(written(_read(keyed, opened, window), "opened").where("edge"))
    places = edges.groupBy("k1", "k2").agg(F.min(F.struct("t1", "t2", "at")).alias("a"), F.max(F.struct("t1", "t2", "at")).alias("z"))
    places = written(places.where("a <> z").select("k1", "k2"), "places")
    alone = edges.join(places, ["k1", "k2"], "left_semi")
    spans = paths.select("t1", "t2", "at", "n").union(alone.select("t1", "t2", "at", "n"))
    spans = written(spans.groupBy("t1", "t2").agg(F.collect_set(F.struct(F.col("at").alias("lo"), "n")).alias("spans")), "spans")
    discard(placed, read, differ, places, release=True)
    return spans


def _read(keyed: DataFrame, placed: DataFrame, window: int) -> DataFrame:
    """What stands at the coordinates: k1, k2, d1, d2, t1, t2, at, n, edge, twice.

    A repeated piece has its name (k1, k2) and its words' digest (d1, d2); an edge, one window, its words' digest alone.
    A piece of a text that stands in the corpus twice is repeated by that alone.
    Texts come sorted by name, so copies are neighbours and are read once; were they not, the result would be the same.
    """
    rows = keyed.drop("id").join(placed, ["t1", "t2"]).select("text", "t1", "t2", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out = None, []
        for batch in batches:
            names = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            for i, (text, name) in enumerate(zip(texts(batch.column(0)), names, strict=True)):
                if name == last:
                    continue
                last, words = name, text.split()
                for p in batch.column(3)[i].as_py():
                    lo, n = p["lo"], p["n"]
                    if p["repeated"]:
                        out.append((p["anchor"], p["content"], *_digest(words[lo : lo + n + window - 1]), *name, lo, n, False, p["twice"]))
                    if p["expand"]:
                        out += [(*_digest(words[at : at + window]), 0, 0, *name, at, 1, True, False) for at in range(lo, lo + n)]
                    if len(out) >= _ROWS:
                        yield made(out)
                        out = []
        if out:
            yield made(out)

    def made(out: list[tuple]) -> pa.RecordBatch:
        *longs, at, n, edge, twice = zip(*out, strict=True)
        arrays = [*(pa.array(c, pa.int64()) for c in longs), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(edge, pa.bool_()), pa.array(twice, pa.bool_())]
        return pa.RecordBatch.from_arrays(arrays, ["k1", "k2", "d1", "d2", "t1", "t2", "at", "n", "edge", "twice"])

    return arrow_map(rows, run, "k1 long, k2 long, d1 long, d2 long, t1 long, t2 long, at int, n int, edge boolean, twice boolean")


def _digest(words: list[bytes]) -> tuple[int, int]:
    d = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def kept_words(words: list[bytes], spans: list[dict] | None, window: int) -> list[bytes]:
    """The words that no repeated window covers."""
    if not spans:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    lo, n = (np.array([s[k] for s in spans]) for k in ("lo", "n"))
    np.add.at(step, lo, 1)
    np.add.at(step, lo + n + window - 1, -1)
    keep = np.cumsum(step[:-1]) == 0
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, gram: int = GRAM, with_text: bool = False, bits: int = 64
) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 (and the kept text) of every document.

    Null, empty and short texts lose nothing; windows are judged on the input, so all copies of a repeated passage go;
    repeated rows are copies of each other; an empty table gives no rows.  Only the named columns are read.
    """
    if not 1 <= gram <= window:
        raise ValueError("a gram is longer than the window")
    keyed = _keyed(docs, id_col, text_col)
    rows = keyed.join(repeated_spans(keyed, window, gram, bits), ["t1", "t2"], "left").select("id", "text", "spans")

    def start():
        def each(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            n_words, removed, digest, kept = [], [], [], []
            for i, text in enumerate(texts(batch.column(0))):
                words = text.split()
                left = kept_words(words, batch.column(1)[i].as_py(), window)
                joined = b" ".join(left)
                n_words.append(len(words))
                removed.append(len(words) - len(left))
                digest.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    kept.append(joined.decode("utf-8", "replace"))
            out = {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
            return out | ({"kept_text": pa.array(kept, pa.string())} if with_text else {})

        return each

    kind = "n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return arrow_append(rows, ["text", "spans"], start, kind, ["id"]).withColumnRenamed("id", id_col)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op1_substring_dedup": op1_substring_dedup}
ORACLES = {"op1_substring_dedup": OP1}
