"""URL filters (operator 11): a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A list has prefix rules (a host, which stands for its subdomains too, and the start of a path) and whole canonical URLs.
Its keys set bits of a blocked Bloom filter: five bits within one block of 512, so a probe touches one cache line.  Every
page probes the filter for each suffix of its host, for the starts of its path where a host passes, and for its canonical
URL; what passes meets the list in an exact hash join, which removes the filter's false positives.

The filter's size is bounded (`MOST_BLOCKS`, 32 MiB), whatever the list's; a longer list lets more false positives pass to
the join, which shuffles both sides, and the results are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_append, table, texts
from .oracles import OP11

#: Bits of a block, bits a key, bits of the filter for each key, words of a block, and the most blocks of a filter.
BLOCK, SET, A_KEY, WORDS, MOST_BLOCKS = 512, 5, 12, 8, 1 << 19
#: Blocks that travel in one row when the filter is gathered.
SEGMENT = 1024
SEED = 42  # of Spark's xxhash64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that do not tell pages apart.
TRACKING = "^(utm_[a-z]*|ref|gclid|fbclid)="
#: The rules of the query (fixed values): host, start of the path, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Hosts with one of these labels are the list's source in the query.
JUNK_LABELS = ("spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track", "adult-x")


def parts(url: str | Column) -> dict[str, Column]:
    """host (A-Z lower-cased), path and canonical URL of a URL; all empty without `://` and for null.

    The canonical URL has no scheme, no leading www. or m., no port 80 or 443, no trailing slash, no fragment and no
    tracking parameters.
    """
    col = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    host = F.translate(F.regexp_extract(col, pattern, 1), UPPER, LOWER)
    path, query = F.regexp_extract(col, pattern, 2), F.regexp_extract(col, pattern, 3)
    told = F.array_join(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)), "&")
    bare = F.regexp_replace(F.regexp_replace(host, r":(80|443)\z", ""), r"^(www|m)\.", "")
    return {"host": host, "path": path, "canonical": F.concat(bare, F.regexp_replace(path, r"/+\z", ""), F.when(told != "", F.concat(F.lit("?"), told)).otherwise(""))}


def entries(rules: DataFrame | None = None, listed: DataFrame | None = None) -> DataFrame:
    """(key, verdict, rule): the list's keys, once each; of contrary verdicts on one key `block` wins.

    `rules` has host, path and verdict, `listed` has canonical and verdict.  Null hosts and paths are empty; null
    canonical URLs and verdicts are no entries.
    """
    if rules is None and listed is None:
        raise ValueError("rules or listed URLs")
    found = []
    if rules is not None:
        name = F.concat(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER), F.coalesce("path", F.lit("")))
        found.append(rules.select(F.concat(F.lit("^"), name).alias("key"), "verdict", name.alias("rule"), F.length(F.coalesce("path", F.lit(""))).alias("reach"), F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("at")))
    if listed is not None:
        found.append(listed.select(F.concat(F.lit("="), "canonical").alias("key"), "verdict", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("int").alias("reach"), F.lit(None).cast("string").alias("at")))
    both = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return both.where("key is not null and verdict is not null").groupBy("key", "rule", "reach", "at").agg(F.max("verdict").alias("verdict"))


@dataclass
class Filter:
    """Blocks of 512 bits, as 64-bit words, and the lengths of listed path starts."""

    bits: np.ndarray
    power: int
    lengths: tuple[int, ...]

    def __post_init__(self) -> None:
        import xxhash

        self.start = xxhash.xxh64

    def has(self, hashed: int) -> bool:
        base = (hashed >> (64 - self.power)) * WORDS if self.power else 0
        for _ in range(SET):
            bit = hashed & (BLOCK - 1)
            if not int(self.bits[base + (bit >> 6)]) >> (bit & 63) & 1:
                return False
            hashed >>= 9
        return True

    def holds(self, key: bytes) -> bool:
        return self.has(self.start(key, seed=SEED).intdigest())

    def hits(self, host: bytes, path: bytes, canonical: bytes) -> list[bytes]:
        """The keys of one URL that may be listed."""
        found = [b"=" + canonical] if self.holds(b"=" + canonical) else []
        at = 0
        while self.lengths and at >= 0:
            suffix = host[at:]
            at = host.find(b".", at) + 1 or -1
            if not self.holds(b"@" + suffix):
                continue
            state, done = self.start(b"^" + suffix, seed=SEED), 0
            text = path.decode()
            for n in self.lengths:
                if n > len(text):
                    break
                state.update(text[done:n].encode())
                done = n
                if self.has(state.intdigest()):
                    found.append(b"^" + suffix + text[:n].encode())
        return found


def build(listed: DataFrame) -> Filter:
    """The filter of the keys that `entries` gives, which are read twice; bits are combined on the executors."""
    size = listed.agg(F.count("*").alias("n"), F.count("at").alias("hosts"), F.array_sort(F.collect_set("reach")).alias("lengths")).first()
    power = 0
    while BLOCK << power < (size.n + size.hosts) * A_KEY and 1 << power < MOST_BLOCKS:
        power += 1
    keys = listed.select(F.explode(F.array("key", F.concat(F.lit("@"), "at"))).alias("key")).where("key is not null")
    hashed = keys.select(F.xxhash64("key").alias("h"))
    block = F.shiftrightunsigned("h", 64 - power).cast("int") if power else F.lit(0)
    bits = F.explode(F.array(*(F.shiftrightunsigned("h", 9 * i).bitwiseAND(BLOCK - 1).cast("int") for i in range(SET))))
    words = hashed.select(block.alias("block"), bits.alias("bit")).groupBy("block", F.expr("bit div 64").cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, bit % 64))").alias("mask"))

    def packed(group: pa.Table) -> pa.Table:  # at most SEGMENT * WORDS rows
        out = np.zeros(SEGMENT * WORDS, np.uint64)
        at = group["block"].to_numpy() % SEGMENT * WORDS + group["word"].to_numpy()
        out[at] = group["mask"].to_numpy().view(np.uint64)
        return pa.table({"segment": group["block"][:1].cast(pa.int32()).to_numpy() // SEGMENT, "bits": pa.array([out.tobytes()], pa.binary())})

    segments = words.groupBy(F.expr(f"block div {SEGMENT}")).applyInArrow(packed, "segment int, bits binary")
    all_bits = np.zeros(max(SEGMENT, 1 << power) * WORDS, np.uint64)
    for row in segments.toLocalIterator():  # at most MOST_BLOCKS / SEGMENT rows of 64 KiB
        all_bits[row.segment * SEGMENT * WORDS : (row.segment + 1) * SEGMENT * WORDS] = np.frombuffer(row.bits, np.uint64)
    return Filter(all_bits, power, tuple(n for n in size.lengths if n is not None))


def judge(pages: DataFrame, listed: DataFrame, url_col: str = "url", keep: list[str] | None = None, default: str = "allow") -> DataFrame:
    """The kept columns with host, path, rule and verdict.

    The longest rule that fits wins, of two of one length that with the longer host; without a rule, the verdict on the
    listed canonical URL, else `default`.  A null URL, or one without `://`, has an empty host and path and no rule, unless a rule has an empty
    host.  Repeated rows are judged alike; an empty table gives no rows, an empty list the default everywhere; kept columns may have the new columns' names.
    """
    kept = pages.columns if keep is None else keep
    at = {c: i for i, c in reversed(list(enumerate(pages.columns)))}
    plain = pages.toDF(*(f"c{i}" for i in range(len(pages.columns))))
    cols = [F.col(f"c{at[c]}").alias(f"kept{j}") for j, c in enumerate(kept)]
    url = F.col(f"c{at[url_col]}")
    found = parts(url)
    rows = plain.select(F.monotonically_increasing_id().alias("row"), *cols, *(c.alias(n) for n, c in found.items()), F.coalesce(F.locate("://", url) > 0, F.lit(False)).alias("whole"))
    shared = pages.sparkSession.sparkContext.broadcast(build(listed))

    def start():
        bloom = shared.value

        def each(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            said = zip(*(texts(batch.column(i)) for i in range(3)), batch.column(3).to_pylist(), strict=True)
            hits = [bloom.hits(h, p, c) if whole else [k for k in bloom.hits(h, p, c) if k[:1] == b"^"] for h, p, c, whole in said]
            return {"hits": pa.array([[k.decode() for k in x] for x in hits], pa.list_(pa.string()))}

        return each

    names = [f"kept{j}" for j in range(len(kept))]
    probed = arrow_append(rows, ["host", "path", "canonical", "whole"], start, "hits array<string>", ["row", *names, "host", "path"])
    # pages without a hit keep a key of their own, so that they are dealt evenly
    asked = probed.select("row", *names, "host", "path", F.explode_outer("hits").alias("hit")).withColumn("key", F.coalesce("hit", F.col("row").cast("string")))
    side = listed.select("key", "verdict", "rule", F.length("at").alias("at")).hint("shuffle_hash")
    met = asked.join(side, "key", "left")
    of_rule = F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), F.col("at"), "rule", "verdict"))
    best = met.groupBy("row").agg(
        *(F.first(c).alias(c) for c in (*names, "host", "path")), F.max(of_rule).alias("best"), F.max(F.when(F.col("rule").isNull(), F.col("verdict"))).alias("said")
    )
    out = best.select(*names, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", "said", F.lit(default)).alias("verdict"))
    return out.toDF(*kept, "host", "path", "rule", "verdict")


def junk_urls(pages: DataFrame, url_col: str = "url", labels: tuple[str, ...] = JUNK_LABELS) -> DataFrame:
    """(canonical, verdict): the canonical URLs of pages whose host has one of the labels before its last one, to be blocked."""
    found = parts(url_col)
    where = (F.locate("://", F.coalesce(F.col(url_col), F.lit(""))) > 0) & found["host"].rlike(rf"(^|\.)({'|'.join(labels)})\.")
    return pages.where(where).select(found["canonical"].alias("canonical")).distinct().withColumn("verdict", F.lit("block"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(pages, entries(rules, junk_urls(pages)), keep=["page_id"])


QUERIES = {"op11_url_filter": op11_url_filter}
ORACLES = {"op11_url_filter": OP11}
