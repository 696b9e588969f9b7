"""N-gram Jaccard join by universe partition and pigeonhole (operator 8).

Two sets with similarity t or more, both of at most u elements, differ in at most H = 2u(1-t)/(1+t) elements.  For each
band of sizes the universe is hashed into m = H + 1 + spare segments.  The index has a set's content in each segment;
equal empty contents would join unrelated sets, so they are left out.  A similar pair agrees in more than `spare`
segments, so if either set has at most `spare` empty ones, it agrees in a content that is indexed (threshold 0).  A set
with more empty segments is also indexed by the one-deletion neighbourhood of all its segments (threshold 1): of two
such sets at most half of H segments can differ by two or more, so some other segment differs by at most one, and it is
indexed unless one set has nothing there and the other at most one element.  A set with too many such thin segments is
indexed again under another hash seed.  Under the last seed empty contents are indexed too, so nothing is ever lost.

The spare segments of a band are chosen by cost: contents indexed, neighbourhoods indexed by the share of sets that need
them, chance agreement, and sets that would fail under every seed, whose entries of empty contents would be shared by
more and more sets as the corpus grows.

Equal sets are one class, named by 128 bits; each class is indexed and verified by one of its texts.  In each group of
equal index entries the members are verified against the group's leaders; the links make components; only pairs of a
group that are still in different components are then verified as well.  A pair reaches verification only if a parity
sketch allows it: every element flips one bit, so two sketches never differ in more bits than the sets differ in
elements, and pairs that do not fit are dropped inside the join.  All sets have a sketch of 1024 bits; larger sets, which
would saturate it, have a wide one besides, of about a bit an element.  Verification compares the words of both texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, WordHashes, arrow_append, arrow_map, discard, mix, table, texts, written
from .oracles import OP8

SEEDS = 8
#: Leaders of a group of equal index entries besides its least member; more leaders leave fewer components apart.
LEADERS = 3
#: 64-bit words of a parity sketch; sets of more than WIDE elements have a wide one as well.
SKETCH, WIDE = 16, 1000
_SKETCH = [f"k{i}" for i in range(SKETCH)]
GROWTH = 1.4
#: Weight of a chance agreement in one segment against one indexed row.
CHANCE = 6
#: Weight of a set that fails under every seed: how many others may come to share its entries.
SHARED = 1e9
#: Pairs to verify at most for which their classes' names are broadcast (as 16 bytes each).
FEW = 200_000
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(text: bytes | None, n: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of the n-word shingles of a text; of all its words if they are fewer."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h, k = hashes.of(words), min(n, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - k + 1, np.uint64(k) * _K[4], np.uint64)
        for i in range(k):
            out = mix(out ^ h[i : len(h) - k + 1 + i]) * _K[0]
    return np.unique(out)


def class_id(elements: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    import xxhash

    high, low = divmod(xxhash.xxh3_128_intdigest(elements.tobytes()), 1 << 64)
    return high - (1 << 63), low - (1 << 63)


@cache
def bands(most: int) -> list[tuple[int, int]]:
    out, low = [], 1
    while low <= most:
        high = max(low, int(low * GROWTH))
        out.append((low, high))
        low = high + 1
    return out


def _binomial(n: int, p: float, most: int) -> np.ndarray:
    """Probabilities of 0 to `most` successes among n."""
    k = np.arange(min(n, most) + 1)
    if p <= 0 or p >= 1 or n == 0:
        return np.eye(1, most + 1, n if p >= 1 else 0)[0][: most + 1]
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in k.tolist()]
    out = np.zeros(most + 1)
    out[: len(k)] = np.exp(np.array(logs) + k * math.log(p) + (n - k) * math.log1p(-p))
    return out


def _exceeds(m: int, p: float, most: int) -> float:
    """The probability that more than `most` of m segments have a property of probability p."""
    return max(0.0, 1 - float(_binomial(m, min(1.0, p), most).sum())) if most < m else 0.0


def cost(spare: int, high: int, percent: int) -> float:
    """Expected cost of a set of a band, in indexed rows; the probabilities are those of the least size indexed there."""
    most = 2 * high * (100 - percent) // (100 + percent)
    m, size, least = most + 1 + spare, 0.6 * high, max(1, math.ceil(percent * int(high / GROWTH) / 100))
    none, one = (1 - 1 / m) ** least, least / m * (1 - 1 / m) ** (least - 1)
    near, again = _exceeds(m, none, spare), _exceeds(m, none + one, m - (most + 2) // 2)
    rows = (m + near * size) * sum(again**k for k in range(SEEDS))
    return rows + CHANCE * m * math.exp(-size / m) * size / m + SHARED * again**SEEDS


@cache
def scheme(high: int, percent: int) -> tuple[int, int, int]:
    """Segments, spare ones and thin ones allowed, for sets of up to `high` elements; no segment if only equal sets can be similar."""
    most = 2 * high * (100 - percent) // (100 + percent)
    if most == 0:
        return 0, 0, 0
    spares = sorted({max(4, most) * k // 24 for k in range(25)})
    spare = min(spares, key=lambda k: cost(k, high, percent))
    return most + 1 + spare, spare, most + 1 + spare - (most + 2) // 2


def entries(elements: np.ndarray, percent: int) -> np.ndarray:
    """Index entries (64-bit) of a set: under the schemes of its own band and of all above it where a similar set can lie."""
    n, out = len(elements), []
    values = mix(elements ^ _K[1])
    for low, high in bands(100 * n // percent + 1):
        if n > high or percent * low > 100 * n:
            continue
        m, spare, thin = scheme(high, percent)
        for seed in range(SEEDS if m else 0):
            counts, full, at, without = _segments(elements, values, m, high, seed)
            out.append(full[counts > 0])
            if (counts == 0).sum() <= spare:
                break
            out.append(without[counts[at] > 1])
            if (counts <= 1).sum() <= thin:
                break
        else:
            out.extend([full[counts == 0]] if m else [])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _segments(elements: np.ndarray, values: np.ndarray, m: int, high: int, seed: int) -> tuple[np.ndarray, ...]:
    """Sizes and entries of the segments under a seed; for each element its segment and the entry of the rest of it."""
    with np.errstate(over="ignore"):
        tag = np.uint64(high) * _K[2] + np.uint64(seed + 1) * _K[3]
        at = ((mix(elements + tag) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        counts, total = np.bincount(at, minlength=m), np.zeros(m, np.uint64)
        np.add.at(total, at, values)
        base = tag + np.arange(m, dtype=np.uint64) * _K[0]
        full = mix(total * _K[4] + base + counts.astype(np.uint64))
        without = mix((total[at] - values) * _K[4] + base[at] + (counts[at] - 1).astype(np.uint64))
    return counts, full, at, without


class Vocabulary(dict):
    """word -> number, in the order of coming."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def similar(a: bytes, b: bytes, shingle: int, percent: int) -> bool:
    """Whether the shingle sets of two texts are similar, by their words and not by hashes."""
    number = Vocabulary()
    rows = []
    for text in (a, b):
        words = text.translate(LOWER).split()
        ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        rows.append(np.lib.stride_tricks.sliding_window_view(ids, min(shingle, len(ids))))
    if rows[0].shape[1] != rows[1].shape[1]:  # one text has fewer words than a shingle: no element can be equal
        return False
    both = np.concatenate(rows)
    code, size = both[:, 0], len(number)
    for k in range(1, both.shape[1]):
        if size > (1 << 62) // len(number):  # number the prefixes anew, so that codes stay exact
            found, code = np.unique(code, return_inverse=True)
            size = len(found)
        code, size = code * len(number) + both[:, k], size * len(number)
    x, y = np.unique(code[: len(rows[0])]), np.unique(code[len(rows[0]) :])
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def sketch(elements: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """64-bit words of the bits that an odd number of elements flips: SKETCH words, and the wide sketch or None."""
    size = 64 * SKETCH
    while WIDE * size < 64 * SKETCH * len(elements):
        size *= 2
    odd = np.bincount((mix(elements ^ _K[3]) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    plain = odd.reshape(-1, 64 * SKETCH).sum(axis=0) & 1
    words = [np.packbits(x.astype(np.uint8)).view(np.int64) for x in (plain, odd)]
    return words[0], words[1] if size > 64 * SKETCH else None


def _differ(a: str, b: str) -> F.Column:
    """Bits in which the sketches, columns k0.. behind the prefixes, differ."""
    bits = [F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in _SKETCH]
    return sum(bits[1:], bits[0])


def _differ_wide(a: F.Column, b: F.Column) -> F.Column:
    """Bits in which two wide sketches differ; the wider one is folded.  Null if a set has none."""
    least = F.least(F.size(a), F.size(b))
    fold = lambda x: F.when(  # noqa: E731  sizes of sets that can be similar are less than a factor of two apart
        F.size(x) > least, F.zip_with(F.slice(x, F.lit(1), least), F.slice(x, least + 1, least), lambda u, v: u.bitwiseXOR(v))
    ).otherwise(x)
    return F.aggregate(F.zip_with(fold(a), fold(b), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda n, k: n + F.coalesce(k, F.lit(0)))


def _possible(a: str, b: str, percent: int) -> F.Column:
    """Whether sizes and sketches allow a similar pair."""
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    near = (percent * na <= 100 * nb) & (percent * nb <= 100 * na)
    most = (100 - percent) * (na + nb)
    wide = (100 + percent) * _differ_wide(F.col(f"{a}wide"), F.col(f"{b}wide")) <= most if 2 * percent > 100 else F.lit(True)
    return F.when(near & ((100 + percent) * _differ(a, b) <= most), F.coalesce(wide, F.lit(True))).otherwise(False)


def _prefixed(sketches: DataFrame, side: str) -> DataFrame:
    return sketches.select(F.col("cls").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("n", *_SKETCH, "wide")])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def sets(docs: DataFrame, text_col: str, shingle: int, keep: list[str]) -> DataFrame:
    """The kept columns with n_shingles, c1 and c2, which name the set (null for an empty one), and the sketch."""

    def start():
        hashes = WordHashes()

        def each(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            found = [shingles(t, shingle, hashes) for t in texts(batch.column(0))]
            both = [sketch(x) for x in found]
            marks = np.array([m for m, _ in both]).reshape(len(found), SKETCH)
            names = [class_id(x) if len(x) else (None, None) for x in found]
            return {
                "n_shingles": pa.array([len(x) for x in found], pa.int64()),
                "c1": pa.array([c for c, _ in names], pa.int64()),
                "c2": pa.array([c for _, c in names], pa.int64()),
                "wide": pa.array([w for _, w in both], pa.list_(pa.int64())),
            } | {name: pa.array(marks[:, i]) for i, name in enumerate(_SKETCH)}

        return each

    kind = "n_shingles long, c1 long, c2 long, wide array<bigint>" + "".join(f", {k} long" for k in _SKETCH)
    return arrow_append(docs, [text_col], start, kind, keep)


def classes(own: DataFrame) -> DataFrame:
    """Written: one row per class of equal sets, numbered `cls`, with its names, its least row, the row's copies and the sketch."""
    first = [F.first(c).alias(c) for c in ("n_shingles", *_SKETCH, "wide")]
    rows = own.where("c1 is not null").groupBy("c1", "c2", "row1", "row2").agg((F.count("*") > 1).alias("again"), *first)
    found = rows.groupBy("c1", "c2").agg(F.min(F.struct("row1", "row2", "again")).alias("m"), *first)
    return written(found.select(F.monotonically_increasing_id().alias("cls"), "c1", "c2", "m.*", F.col("n_shingles").alias("n"), *_SKETCH, "wide"), "classes")


def class_texts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Written: (cls, text), one of the texts of each class; docs has row1, row2 and text."""
    rows = docs.select("row1", "row2", "text")
    at = found.select("row1", "row2", "cls", "again")
    out = rows.join(at.where("not again").drop("again"), ["row1", "row2"]).select("cls", "text")
    again = written(at.where("again").drop("again"), "again")
    if again.limit(1).count():  # rows that repeat, maybe many times: one of each
        out = out.union(rows.join(again, ["row1", "row2"]).select("cls", "text").dropDuplicates(["cls"]))
    out = written(out, "texts")
    discard(again, release=True)
    return out


def index(said: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(sig, cls): the index entries of every class (cls, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sigs, ids, held = [], [], 0
            for cls, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                own = entries(shingles(text, shingle, hashes), percent)
                sigs.append(own)
                ids.append(np.full(len(own), cls, np.int64))
                held += len(own)
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([_signed(np.concatenate(sigs)), pa.array(np.concatenate(ids))], ["sig", "cls"])
                    sigs, ids, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(sigs)), pa.array(np.concatenate(ids))], ["sig", "cls"])

    return arrow_map(said.select("cls", "text"), run, "sig long, cls long")


def verified(pairs: DataFrame, said: DataFrame, shingle: int, percent: int, label: str) -> DataFrame:
    """Written: the pairs (a, b) whose texts' sets are similar; `said` has (cls, text).

    Of FEW pairs at most the classes' names are broadcast, so that only their texts are shuffled; of more, all texts are.
    """
    if pairs.limit(FEW + 1).count() <= FEW:
        names = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
        said = said.join(F.broadcast(names), "cls", "left_semi")
    other = pairs.join(said.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b")
    rows = other.join(said.select(F.col("cls").alias("a"), F.col("text").alias("ta")), "a")

    def start():
        def each(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            both = zip(texts(batch.column(0)), texts(batch.column(1)), strict=True)
            return {"ok": pa.array([similar(a, b, shingle, percent) for a, b in both], pa.bool_())}

        return each

    return written(arrow_append(rows, ["ta", "tb"], start, "ok boolean", ["a", "b"]).where("ok").select("a", "b"), label)


def connected(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes of the links (a, b): the smallest node reachable.

    Every round hooks each node to its smallest neighbour, shortens the paths and contracts the links; rounds are
    written, so a lost executor costs no more than its own tasks.
    """
    spark = links.sparkSession
    labels: DataFrame | None = None
    edges = written(links.select("a", "b").where("a <> b").distinct(), "links")
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).select("node", F.least("node", "p").alias("p"))
        parent = written(parent, "parents")  # before it is joined: a join of two plain shuffles can split a hub
        up = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        parent = written(parent.join(up, "p", "left").select("node", F.coalesce("pp", "p").alias("p")), "parents")
        ends = edges.join(parent.select(F.col("node").alias("a"), F.col("p").alias("x")), "a")
        ends = ends.join(parent.select(F.col("node").alias("b"), F.col("p").alias("y")), "b")
        edges = written(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        if labels is None:
            labels = parent.select("node", F.col("p").alias("label"))
        else:
            up = parent.select(F.col("node").alias("label"), "p")
            labels = written(labels.join(up, "label", "left").select("node", F.coalesce("p", "label").alias("label")), "labels")
    return labels if labels is not None else spark.createDataFrame([], "node long, label long")


def _labelled(rows: DataFrame, labels: DataFrame, column: str, out: str) -> DataFrame:
    names = labels.select(F.col("node").alias(column), F.col("label").alias("_l"))
    return rows.join(names, column, "left").withColumn(out, F.coalesce("_l", column)).drop("_l")


def link_classes(said: DataFrame, found: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, label) of the classes that are linked with another one; from class_texts() and classes()."""
    group = Window.partitionBy("sig")
    others = [F.min_by("cls", F.xxhash64("cls", F.lit(r))).over(group).alias(f"lead{r}") for r in range(LEADERS)]
    rows = index(said, shingle, percent).select("sig", "cls", F.min("cls").over(group).alias("lead"), F.max("cls").over(group).alias("most"), *others)
    members = written(rows.where("lead <> most").drop("most"), "members")
    needed = written(members.select("cls").distinct(), "needed")  # written: a join of two plain shuffles can split hot keys
    sketches = written(found.select("cls", "n", *_SKETCH, "wide").join(needed, "cls", "left_semi"), "sketches")
    discard(needed, release=True)

    heads = F.explode(F.array_distinct(F.array("lead", *[f"lead{r}" for r in range(LEADERS)]))).alias("head")
    stars = members.select("cls", heads).where("cls <> head")
    stars = written(stars.groupBy(F.least("cls", "head").alias("a"), F.greatest("cls", "head").alias("b")).agg(F.count("*").alias("w")), "stars")
    near = stars.join(_prefixed(sketches, "a"), "a").join(_prefixed(sketches, "b"), "b").where(_possible("a_", "b_", percent))
    near = written(near.select("a", "b", "w"), "near")
    discard(stars)
    best = written(near.groupBy("b").agg(F.max_by("a", F.struct("w", -F.col("a"))).alias("a")).select("a", "b"), "best")
    links = first = verified(best, said, shingle, percent, "first")
    labels = connected(first)

    # members of a group that are still apart from one of its leaders
    rest = near.select("a", "b").join(best, ["a", "b"], "left_anti")
    rest = written(_labelled(_labelled(rest, labels, "a", "la"), labels, "b", "lb").where("la <> lb").select("a", "b"), "rest")
    second = verified(rest, said, shingle, percent, "second")
    if second.limit(1).count():
        links = first.union(second)
        labels = connected(links)

    # other pairs of a group that are still apart
    marked = _labelled(members.select("sig", "cls", "lead"), labels, "cls", "l")
    apart = written(marked.groupBy("sig").agg(F.min("l").alias("lo"), F.max("l").alias("hi")).where("lo <> hi").select("sig"), "apart")
    open_ = written(marked.join(apart, "sig", "left_semi").select("sig", "cls", "l"), "apart")
    open_ = written(open_.join(sketches, "cls"), "open")
    discard(members, sketches)
    x, y = open_.alias("x"), open_.alias("y")  # alike but for the alias, so that one shuffle serves both sides
    pairs = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.l") < F.col("y.l")) & _possible("x.", "y.", percent))
    least, most = F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")
    pairs = pairs.select(least, most, F.col("x.l").alias("la"), F.col("y.l").alias("lb"), _differ("x.", "y.").alias("d")).distinct()
    pairs = written(pairs.join(near.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    discard(open_, near)

    # first the nearest pair of any two components: one link joins them, and their other pairs need no look
    close = pairs.groupBy("la", "lb").agg(F.min_by(F.struct("a", "b"), F.struct("d", "a", "b")).alias("p")).select("p.*")
    close = written(close, "close")
    third = verified(close, said, shingle, percent, "third")
    if third.limit(1).count():
        links = links.union(third)
        labels = connected(links)
    rest = pairs.select("a", "b").join(close, ["a", "b"], "left_anti")
    rest = written(_labelled(_labelled(rest, labels, "a", "la"), labels, "b", "lb").where("la <> lb").select("a", "b"), "rest")
    last = verified(rest, said, shingle, percent, "last")
    return connected(links.union(last)) if last.limit(1).count() else labels


def _named(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Written: id, row1, row2, n_shingles and label of all rows of docs (id, text, row1, row2); no label for an empty set.

    row1 and row2 name a row's id and text.
    """
    own = written(sets(docs, "text", shingle, ["id", "row1", "row2"]), "sets")
    found = classes(own)
    said = class_texts(docs, found)
    labels = link_classes(said, found, shingle, percent).withColumnRenamed("node", "cls")
    discard(said, release=True)
    names = found.select("cls", "c1", "c2").join(labels, "cls", "left").select("c1", "c2", F.coalesce("label", "cls").alias("label"))
    names = written(names, "names")
    out = written(own.select("id", "row1", "row2", "n_shingles", "c1", "c2").join(names, ["c1", "c2"], "left").drop("c1", "c2"), "named")
    discard(own, found, names)
    return out


def _rows(at: F.Column, said: F.Column) -> dict[str, F.Column]:
    """128 bits that name a row's id and text."""
    row = [at, at.isNull(), said, said.isNull()]
    return {"row1": F.xxhash64(*row), "row2": F.xxhash64(F.lit(1), *row)}


def components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3, percent: int = 90
) -> DataFrame:
    """id, n_shingles, component_id (the smallest id reachable by links, its own included) of every document.

    Null and wordless texts have an empty set and are linked with nothing; repeated rows and equal sets are linked;
    null ids count as larger than all others; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    named = _named(rows.withColumns(_rows(F.col("id"), F.col("text"))), shingle, percent)
    least = written(named.where("label is not null").groupBy("label").agg(F.min("id").alias("component_id")), "least")
    out = named.join(least, "label", "left")
    found = F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", found.alias("component_id"))


def distinct_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, percent: int = 80
) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each component the row with the smallest id stays, once.

    Null ids count as larger than all others; of equal ids the text with the least hash stays.  Rows whose text is null
    or has no words have no near-duplicates and stay, repeated or not.  Rows are named by 128 bits of id and text.
    """
    width = len(docs.columns)
    plain = docs.toDF(*(f"d{i}" for i in range(width)))
    at, said = F.col(f"d{docs.columns.index(id_col)}"), F.col(f"d{docs.columns.index(text_col)}")
    plain = plain.withColumns(_rows(at, said))
    named = _named(plain.select(at.alias("id"), said.alias("text"), "row1", "row2"), shingle, percent)
    rows = named.where("label is not null").groupBy("label", "id", "row1", "row2").agg((F.count("*") > 1).alias("again"))
    least = rows.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row1", "row2", "again")).alias("m"))
    bare = named.where("label is null").select("row1", "row2", F.lit(False).alias("again")).distinct()
    kept = written(least.select("m.row1", "m.row2", "m.again").union(bare), "kept")
    discard(named)
    out = plain.join(kept.where("not again"), ["row1", "row2"], "left_semi").drop("row1", "row2")
    again = written(kept.where("again"), "again")  # written: only these few rows' texts need a further look
    if again.limit(1).count():
        first = plain.join(again, ["row1", "row2"], "left_semi").dropDuplicates(["row1", "row2"])
        out = out.union(first.drop("row1", "row2"))
    return out.toDF(*docs.columns)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))


QUERIES = {"op8_jaccard_join": op8_jaccard_join}
ORACLES = {"op8_jaccard_join": OP8}
