"""URL lists, filter audits and expiring windows against brute force, and on nulls, ties, repeated rows and empty tables."""

import hashlib
import math
import random
import zlib
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillwork.llm import expiring, interactions, urls

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("", "/void", "block"), ("net", "", "block"))
URLS = [
    "http://example.org/es/1", "https://A.Example.ORG/es/x?q=1#f", "http://example.org/en/12", "http://example.org/en/2", "http://notexample.org/es/", "http://org/", "http://org",
    "ftp://x.com/fr/1", "http://x.com/FR/1", "http://com.net/fr/", "http://x.com?y=/fr/", "no scheme/fr/", "a://b://c", None, "", "http://", "http://./void", "http://x.com:80/fr/", "http://ünï.org/ñ", "x://m.spam-farm.com/a/?utm_source=1&b=2",
    "http://example.org/es/1", "http://www.spam-farm.com:80/a?b=2#z", "http://spam-farm.com/a?b=3",
]


def judged(url, rules=RULES, listed=frozenset()):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, *max(fits)[2:]
    return host, path, None, "block" if url in listed else "allow"


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "own") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    listed = urls.junk_urls(pages)
    assert sorted(r.canonical for r in listed.collect()) == ["spam-farm.com/a?b=2", "spam-farm.com/a?b=3"]
    got = [tuple(r) for r in urls.judge(pages, urls.entries(rules, listed), keep=["page_id"]).orderBy("page_id").collect()]
    junk = {u for u in URLS if u and "spam-farm" in u}
    assert got == [(i, *judged(u, listed=junk)) for i, u in enumerate(URLS)]
    kept = urls.judge(pages, urls.entries(rules, listed))
    assert kept.columns == ["page_id", "url", "rule", "host", "path", "rule", "verdict"] and kept.count() == len(URLS)
    assert urls.judge(pages.limit(0), urls.entries(rules)).count() == 0
    nothing = urls.entries(rules.limit(0))
    assert {r.verdict for r in urls.judge(pages, nothing, keep=["page_id"], default="block").select("verdict").collect()} == {"block"}
    both = spark.createDataFrame([("x.org", "/", "allow"), ("X.org", "/", "block"), (None, None, None)], "host string, path string, verdict string")
    assert [tuple(r) for r in urls.entries(both).select("rule", "verdict").collect()] == [("x.org/", "block")]


def test_filter_has_every_key_and_few_others(spark):
    listed = spark.range(20_000).select(F.concat(F.lit("h.example/"), F.col("id").cast("string")).alias("canonical"), F.lit("block").alias("verdict"))
    bloom = urls.build(urls.entries(listed=listed))
    key = lambda i: f"=h.example/{i}".encode()
    assert spark.range(1).select(F.xxhash64(F.lit("=h.example/7"))).first()[0] == np.uint64(xxhash.xxh64_intdigest(key(7), seed=42)).astype(np.int64)
    assert all(bloom.holds(key(i)) for i in range(20_000))
    assert np.mean([bloom.holds(key(i)) for i in range(100_000, 120_000)]) < 0.03


def audited(rows, labels):
    """Every order, document by document."""
    text_of = [(i, t or "", s or "") for i, t, s in rows]
    good, toxic = ({i for i, *said in labels if said[k] == 1 and i is not None} for k in (0, 1))
    out = {}
    fails = []
    for i, t, s in text_of:
        words = t.replace("\v", " ").replace("\f", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
        words = [w for w in words if w]
        first = min((j for j, u, _ in text_of if u == t and j is not None), default=None)
        fails.append({
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > first,
        })
    for part in {s for *_, s in text_of}:
        mine = [(i, f) for (i, _, s), f in zip(text_of, fails, strict=True) if s == part]
        shapley = defaultdict(int)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                removed = [x for x in left if x[1][f]]
                kept = [x for x in left if not x[1][f]]
                alone = sum(x[1][f] and sum(x[1].values()) == 1 for x in mine)
                out[part, order, step] = [len(kept), len(removed), sum(x[1][f] for x in mine) - len(removed), alone, sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed)]
                shapley[f] += len(removed)
                left = kept
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                out[part, order, step].append(shapley[f])
    return out


def test_filter_audit(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["lorem", "Ipsum", "dolor", "SIT", "a&b", "ñandú", "x"]) + str(rng.randrange(400))
    texts = ["", None, "one $ sign", "AB c"] + [" ".join(word() for _ in range(n)) for n in (5, 199, 200, 201, 400)] + [" ".join(["same"] * 300), "tab\tnew\nline " * 100]
    rows = [(rng.choice([*range(40), None]), rng.choice(texts), rng.choice(["s", "t", "", None])) for _ in range(120)] + [(7, "AB c", "s"), (7, "AB c", "s")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(30)] + [(3, 1, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, source string, A string")
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {}
    for r in interactions.filter_audit(docs, said).collect():
        assert (r.part, r.filter_order, r.step) not in got
        got[r.part, r.filter_order, r.step] = [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]
    assert got == audited(rows, labels)
    assert interactions.filter_audit(docs.limit(0), said).count() == 0
    with pytest.raises(ValueError):
        interactions.orders("AA")


def windowed(rows, batches, reach=48, late=24):
    """The stream, batch by batch and row by row."""
    rows = [r for r in rows if None not in r]
    low, high = min(r[3] for r in rows), max(r[3] for r in rows)
    deal = defaultdict(list)
    for r in rows:
        deal[(r[3] - low) * batches // (high - low + 1)].append(r)
    opened, out, seen = {}, [], None
    for b in range(batches):
        kept = [r for r in deal[b] if seen is None or r[1] >= seen - late]
        for one, hour, digest, _ in sorted(kept, key=lambda r: (r[0], r[1], r[2])):
            w = opened.get(one)
            if w and hour <= w[0] + reach:
                w[1] += 1
                if digest != w[4]:
                    w[2] += 1
                    w[3] += zlib.crc32(digest.hex().encode())
                continue
            if w:
                out.append((one, w[0], b, *w[1:4], w[4].hex()))
            opened[one] = [hour, 0, 0, 0, digest]
        seen = max([r[1] for r in deal[b]] + ([seen] if seen is not None else []), default=None)
        for one in [o for o, w in opened.items() if b + 1 == batches or seen is not None and w[0] + reach < seen - late]:
            w = opened.pop(one)
            out.append((one, w[0], b, *w[1:4], w[4].hex()))
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 1])
def test_windows(spark, seed):
    """Hot ids, gaps, late rows, repeated rows, negative hours, batches without rows."""
    rng = random.Random(seed)
    digest = lambda x: hashlib.sha256(str(x).encode()).digest()
    rows = []
    for _ in range(400):
        hour = rng.choice([rng.randrange(-300, 300), rng.randrange(0, 60)])
        rows.append((rng.choice([1, 1, 1, *range(25)]), hour, digest(rng.randrange(3)), hour + rng.randrange(0, 90)))
    rows += rows[:5] + [(None, 1, digest(1), 1), (2, None, digest(1), 1), (2, 1, digest(1), None)] + ([(3, 2000, digest(1), 2000)] if seed else [])
    df = spark.createDataFrame([(*r, "own") for r in rows], "click_id long, hour long, digest binary, at_hour long, hash string")
    got = sorted(tuple(r) for r in expiring.deduplicate(df, batches=4).collect())
    assert got == windowed(rows, 4) and len({r[2] for r in got}) > 1
    assert expiring.deduplicate(df.limit(0)).count() == 0


def test_copies(spark):
    clicks = "click_id long, ts timestamp, arrived_at timestamp, client_id long, kind string, value double, props string"
    from datetime import datetime

    at = datetime(2024, 1, 1, 3, 30)
    rows = [(5, at, at, 7, "a|b", 1.005, "{}"), (3, None, at, None, None, None, None), (-1, at, at, 1, "k", 1.0, "p"), (4, at, None, 1, "k", 1.0, "p"), (None, at, at, 1, "k", 1.0, "p")]
    got = sorted(tuple(r) for r in expiring.copies(spark.createDataFrame(rows, clicks)).collect())
    hour = spark.sql("SELECT unix_micros(timestamp'2024-01-01 03:30:00')").first()[0]
    expected = []
    for one, ts, client, kind, value, props in ((5, hour, "7", "a|b", str(math.floor(100 * 1.005 + 0.5)), "{}"), (3, "", "", "", "", "")):
        for j in range(one % 3 + 1):
            c = zlib.crc32(f"{one}:{j}".encode())
            h = hour // 3_600_000_000 + 6 * j * (c % 10)
            said = f"{client}|{kind}|{value}|{ts}|{props}|{c % 3}"
            expected.append((one, h, bytearray(hashlib.sha256(said.encode()).digest()), h + c // 10 % 200))
    assert got == sorted(expected)
