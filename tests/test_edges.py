"""Operators against brute force and on edges: nulls, ties, repeated rows, empty tables."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from quillwork.operators import cdc, greedy, judging, matching, pages, relational, retrieval, upkeep
from quillwork.sources import connectors
from quillwork.streaming import flows


def rows(df, *columns):
    found = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in found.collect()), key=repr)


# pages


def test_greedy_pairs(spark):
    rng = random.Random(1)
    left = [(p, k, rng.choice([1.0, 2.5, 4.0, 9.0, 9.5, 30.0]) + p) for p in range(6) for k in range(5)]
    right = [(p, k, rng.choice([1.0, 3.0, 5.5, 9.0, 28.0]) + p) for p in range(5) for k in range(7)]
    schema = "page long, k long, y double"
    got = rows(pages.paired(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "page", "k", "y", 3.0), "page", "a", "b", "distance")
    expected = []
    for p in range(6):
        near = sorted((abs(x - z), a, b) for q, a, x in left if q == p for r, b, z in right if r == p and abs(x - z) <= 3.0)
        used = set(), set()
        for d, a, b in near:
            if a not in used[0] and b not in used[1]:
                used[0].add(a)
                used[1].add(b)
                expected.append((p, a, b, d))
    assert got == sorted(expected, key=repr) and got
    empty = spark.createDataFrame([], schema)
    assert pages.paired(empty, spark.createDataFrame(right, schema), "page", "k", "y", 3.0).count() == 0


def test_pairs_of_pages_meet_once(spark, monkeypatch):
    """Pages are paired where their items lie, without rounds; crowded ones in rounds; repeated items, nulls and ties as in the loop."""
    rng = random.Random(2)
    left = [(p, k % 5 or None, rng.choice([1.0, 2.5, 4.0, 9.0])) for p in (1, 2, 3) for k in range(8)] + [(None, 1, 1.0), (1, 9, None), (7, 1, 1.0)]
    right = [(p, k, rng.choice([1.0, 3.0, 5.5, 9.0])) for p in (1, 2, 3) for k in range(6)] + [(None, 1, 1.0), (2, 9, None), (2, 8, float("nan"))]
    right += [(3, 20 + k, 2.0) for k in range(10)]
    df = [spark.createDataFrame(x, "page long, k long, y double") for x in (left, right)]
    expected = []
    for p in (1, 2, 3):
        near = {(abs(x - z), a or 0, b) for q, a, x in left if q == p and x for r, b, z in right if r == p and z and abs(x - z) <= 3.0}
        used = set(), set()
        for d, a, b in sorted(near):
            if a not in used[0] and b not in used[1]:
                used[0].add(a)
                used[1].add(b)
                expected.append((p, a or None, b, d))
    for most in (1, 60, 1000):  # all, one and no page crowded
        assert rows(pages.paired(*df, "page", "k", "y", 3.0, most), "page", "a", "b", "distance") == sorted(expected, key=repr)
    monkeypatch.setattr(pages, "matched", None)
    assert pages.paired(*df, "page", "k", "y", 3.0).count() == len(expected)


def test_upright_pages(spark):
    words = [(p, x * 100.0, 20.0 * line + slope * x * 100, f"w{x}") for p, slope in ((1, 0.02), (2, 0.0), (3, -0.01)) for line in range(4) for x in range(5)]
    words += [(4, None, 1.0, "lost"), (5, 0.0, 7.0, "alone")]
    df = spark.createDataFrame(words, "page long, x double, y double, text string")
    slopes = [k / 100 for k in range(-3, 4)]
    assert rows(pages.skew(df, "page", slopes, 0.5), "page", "slope", "lines") == [(1, 0.02, 4), (2, 0.0, 4), (3, -0.01, 4), (5, 0.0, 1)]
    flat = pages.deskewed(df, "page", slopes, 0.5).where("page < 4").groupBy("page").agg(F.count_distinct(F.round("y", 6)).alias("n"))
    assert rows(flat) == [(1, 4), (2, 4), (3, 4)]


def test_votes_of_pages(spark):
    boxes = spark.createDataFrame([(1, 0.0, 100.0, "PEREZ  SI"), (2, 0.0, 70.0, "GOMEZNO"), (3, 0.0, 20.0, "SI"), (4, 0.0, 1.0, "  "), (5, 0.0, 1.0, None)], "k long, x0 double, x1 double, text string")
    got = rows(pages.box_words(boxes, ["k"]), "k", "position", "word")
    assert got == [(1, 0, "PEREZ"), (1, 1, "SI"), (2, 0, "GOMEZ"), (2, 1, "NO"), (3, 0, "SI")]
    heads = spark.createDataFrame([("ASISTENCIA: Fecha: 3/11/2026 Hora: 12:05 AM",), ("votación 3/11/2026",), (None,)], "s string")
    assert [r.h and (r.h.kind, str(r.h.day), r.h.minute) for r in heads.select(pages.header(F.col("s")).alias("h")).collect()] == [("attendance", "2026-11-03", 5), None, None]
    votes = spark.createDataFrame([(1, "a", "?", True), (1, "b", "SI", False), (2, "a", "?", True), (2, "b", "?", True), (3, "a", "NO", False)], "r long, m string, v string, u boolean")
    totals = spark.createDataFrame([(1, "SI", 1), (1, "NO", 1), (2, "SI", 2), (3, "SI", 1)], "r long, v string, n long")
    assert rows(pages.repaired(votes, totals, "r", "v", "u"), "r", "m", "v") == [(1, "a", "NO"), (1, "b", "SI"), (2, "a", "?"), (2, "b", "?"), (3, "a", "NO")]
    known = spark.createDataFrame([(1, 7), (1, None), (2, 7), (2, None), (2, None)], "r long, member long")
    assert rows(pages.majority_resolved(known, "r", "member")) == [(1, 7)]


# state between runs


def test_refetch_and_ledger(spark):
    listing = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d"), (5, "e")], "k long, v string")
    stored = spark.createDataFrame([(2, "x", "2024-01-01"), (3, "", "2024-01-01"), (4, "d", None), (5, "e", "2020-01-01")], "k long, v string, fetched_at string")
    stored = stored.withColumn("fetched_at", F.to_timestamp("fetched_at"))
    now = F.lit("2024-01-10").cast("timestamp")
    assert rows(upkeep.to_refetch(listing, stored, "k", ["v"], now, 30)) == [(1, "new"), (2, "changed"), (4, "never"), (5, "old")]
    assert upkeep.to_refetch(listing.limit(0), stored, "k", ["v"], now, 30).count() == 0
    ledger = spark.createDataFrame([], "k long, tries int, tried_at timestamp, done boolean")
    work = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    for minute, ok, left in ((0, [False, True], [1, 2, 3]), (1, [False, None], [1, 3]), (2, [None, None], [3]), (4, [None, None], [1, 3])):
        now = F.lit(f"2024-01-01 00:0{minute}:00").cast("timestamp")
        assert rows(upkeep.due(work, ledger, "k", now, most=3, wait=60)) == [(k,) for k in left]
        outcomes = spark.createDataFrame([(k, x) for k, x in zip((1, 2), ok, strict=True) if x is not None], "k long, ok boolean")
        ledger = upkeep.ledgered(ledger, outcomes, "k", now)
    assert rows(ledger, "k", "tries", "done") == [(1, 2, False), (2, 1, True)]


def test_inbox_and_cache(spark):
    schema = "o string, k long, at timestamp, body string"
    t = lambda d: __import__("datetime").datetime(2024, 1, d)
    state = spark.createDataFrame([("a", 1, t(1), "x"), ("a", 2, t(9), "x"), ("b", 1, t(9), "x")], schema)
    changes = spark.createDataFrame([("a", 2, t(10), "y"), ("a", 3, t(10), "z"), ("a", 3, t(10), "z"), ("b", 1, t(10), None)], schema)
    now = F.lit("2024-01-10").cast("timestamp")
    assert rows(upkeep.inbox(state, changes, "o", "k", "at", now, days=5), "o", "k", "body") == [("a", 2, "y"), ("a", 3, "z")]
    assert rows(upkeep.inbox(state, changes, "o", "k", "at", now, days=50, most=1), "o", "k") == [("a", 2)]
    cache = spark.createDataFrame([(1, t(10), True), (2, t(9), True), (3, t(9), False), (4, None, True)], "k long, at timestamp, ok boolean")
    assert rows(upkeep.cached(cache, now, good=2 * 86400, bad=3600), "k") == [(1,), (2,)]


def test_index_is_refreshed(spark):
    items = spark.createDataFrame([(1, "h1", "one"), (2, "h2", "two"), (3, "h3", None), (4, None, "four")], "k long, hash string, text string")
    index = spark.createDataFrame([(1, "h1", "m", [9.0]), (2, "old", "m", [9.0]), (3, "h3", "before", [9.0]), (7, "h7", "m", [9.0])], "k long, hash string, model string, vector array<double>")
    out = upkeep.index_refreshed(index, items, "k", "m", retrieval.hashed_vector)
    assert [(r.k, r.change, len(r.vector)) for r in out.orderBy("k").collect()] == [(1, "same", 1), (2, "update", 64), (3, "model", 64), (4, "insert", 64)]
    again = upkeep.index_refreshed(out.drop("change"), items, "k", "m", retrieval.hashed_vector)
    assert rows(again.where("k < 4"), "change") == [("same",)] * 3


def test_alerts_tell_once(spark):
    items = spark.createDataFrame([(1, 40, [1.0, 0.0]), (2, 40, [0.0, 0.0]), (3, 0, [1.0, 0.0]), (4, 40, None)], "k long, day int, v array<double>")
    alerts = [(1, "c", 9, "too old", [1.0, 0.0]), (2, "c", 10, "first", [1.0, 0.1]), (3, "c", 10, "later id", [1.0, 0.0]), (4, "d", 41, "after", [1.0, 0.0]), (5, "d", 40, "unlike", [0.0, 1.0])]
    out = upkeep.already_alerted(items, spark.createDataFrame(alerts, "alert long, client string, day int, title string, v array<double>"), "k", "client", "day", "v")
    assert rows(out) == [(1, "c", 2, "first")]


def test_alerts_in_blocks_of_any_size(spark):
    rng = random.Random(6)
    vector = lambda: [float(rng.randint(-2, 2)) for _ in range(3)]
    items = [(k, rng.randrange(-5, 60), vector()) for k in range(40)] + [(90, None, [1.0, 0.0, 0.0]), (91, 30, [1.0, 0.0])]
    alerts = [(k, rng.choice(["c", "d", None]), rng.randrange(-5, 60), f"t{k}", vector()) for k in range(40)] + [(95, "e", 29, None, [1.0, 0.0]), (96, "e", None, "x", [1.0, 0.0])]
    expected = {}
    for k, day, v in items:
        for sent, alert, client, title, w in sorted((s, a, c or "", t or "", w) for a, c, s, t, w in alerts if s is not None):
            norms = sum(x * x for x in v) * sum(x * x for x in w)
            if day is not None and len(v) == len(w) and norms and day - 7 <= sent <= day and sum(x * y for x, y in zip(v, w, strict=True)) / norms**0.5 >= 0.78 - 1e-12:
                expected.setdefault((k, client), (alert, title))
    both = (spark.createDataFrame(items, "k long, day int, v array<double>"), spark.createDataFrame(alerts, "alert long, client string, day int, title string, v array<double>"))
    for block in (2, 1024):
        out = upkeep.already_alerted(*both, "k", "client", "day", "v", days=7, block=block)
        assert {(r.k, r.client or ""): (r.alert, r.title or "") for r in out.collect()} == expected
    assert upkeep.already_alerted(both[0].limit(0), both[1], "k", "client", "day", "v").count() == 0


# linkage and retrieval


@pytest.mark.parametrize("most", [matching.CATALOGUE, 0])
def test_contained_names_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(matching, "CATALOGUE", most)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 3)))
    texts = [(i, " ".join(word() for _ in range(rng.randint(0, 9)))) for i in range(60)] + [(90, None), (91, "Á b"), (None, "a b")]
    names = [(" ".join(word() for _ in range(rng.randint(1, 4))),) for _ in range(25)] + [(None,), ("",), ("á B",)]
    got = rows(matching.contained_names(spark.createDataFrame(texts, "k long, t string"), spark.createDataFrame(names, "n string"), "k", "t", "n"))
    plain = lambda s: s.lower().replace("á", "a").strip()
    expected = []
    for k, t in texts:
        held = [n for (n,) in names if n and t is not None and plain(n) in plain(t)]
        if held and k is not None:
            expected.append((k, min(held, key=lambda n: (-len(plain(n)), n))))
    assert got == sorted(expected, key=repr)


def test_people(spark):
    members = spark.createDataFrame([(1, "Ana Torres Vega"), (2, "Luis Torres Mena"), (3, "Rosa Quispe"), (4, None)], "id long, name string")
    said = [(1, "torres vega"), (2, "torres"), (3, "quispe"), (4, "vega mena torres"), (5, None), (6, "nobody"), (7, "quispe vega")]
    mentions = spark.createDataFrame(said, "m long, s string")
    assert rows(matching.resolved_people(mentions, members, "m", "s", "id", "name")) == sorted([(1, 1), (2, None), (3, 3), (4, None), (5, None), (6, None), (7, None)], key=repr)
    assert rows(matching.best_overlap(mentions, members, "m", "s", "id", "name")) == [(1, 1), (4, 1)]
    news = spark.createDataFrame([(1, "La senadora Quispe", "P"), (2, "Rosa de la Quispe", "P"), (3, "senador Torres", "P"), (4, "Rosa dijo que ayer Quispe", "P"), (5, None, "P"), (6, "rosa quispe", "Q")], "k long, t string, place string")
    people = spark.createDataFrame([(1, "Ana", "Torres", "P"), (2, "Luis", "Torres", "P"), (3, "Rosa", "Quispe", "P"), (4, None, "Solo", "P")], "id long, given string, surname string, place string")
    assert rows(matching.named_in_media(news, people, "k", "t", "id", "given", "surname", "place", "senadora?")) == [(1, 3), (2, 3)]


def test_leaders_against_brute_force(spark):
    rng = random.Random(5)
    data = [(k, k % 2, [rng.gauss(0, 1) for _ in range(3)]) for k in range(120)] + [(200, 0, None), (201, 1, [0.0, 0.0, 0.0])]
    got = {r.k: r.leader for r in greedy.leaders(spark.createDataFrame(data, "k long, b int, v array<double>"), "b", ["k"], "k", "v", 0.8).collect()}
    heads = {0: [], 1: []}
    for k, b, v in data:
        n = sum(x * x for x in v) ** 0.5 if v else 0
        leader = k
        if n:
            unit = [x / n for x in v]
            close = [h for h, u in heads[b] if sum(x * y for x, y in zip(unit, u, strict=True)) >= 0.8]
            leader = close[0] if close else k
            if not close:
                heads[b].append((k, unit))
        assert got[k] == leader


def test_tfidf_against_brute_force(spark):
    import math
    from collections import Counter

    rng = random.Random(2)
    texts = [(k, [rng.choice("abcdefghij") for _ in range(rng.randint(0, 6))]) for k in range(40)] + [(99, None)]
    vectors = retrieval.tfidf(spark.createDataFrame(texts, "k long, w array<string>"), "k", "w")
    freq = Counter(t for _, w in texts for t in set(w or ()))
    unit = {}
    for k, w in texts:
        v = {t: n * (math.log((1 + len(texts)) / (1 + freq[t])) + 1) for t, n in Counter(w or ()).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        unit[k] = {t: x / size for t, x in v.items()} if size else {}
    for least in (0.2, 0.7):
        got = {(r.a, r.b): r.score for r in retrieval.similar_by_tfidf(vectors, "k", least).collect()}
        expected = {(a, b): s for a in unit for b in unit if a < b and (s := sum(x * unit[b].get(t, 0) for t, x in unit[a].items())) >= least}
        assert set(got) == set(expected) and all(abs(got[p] - s) < 1e-9 for p, s in expected.items())


def test_bm25_and_fusion(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None), (4, "")], "k long, t string")
    assert rows(retrieval.bm25(docs, "k", {"t": 1.0}, ["a", "b"]), "k") == [(1,)]
    assert rows(retrieval.bm25(docs, "k", {"t": 1.0}, ["a", "b"], every=False), "k") == [(1,), (2,)]
    assert retrieval.bm25(docs, "k", {"t": 1.0}, ["z"]).count() == 0
    a, b = (spark.createDataFrame(x, "k long, rank int") for x in ([(1, 1), (2, 2)], [(2, 1)]))
    assert rows(retrieval.fused(a, b, "k"), "k", "source") == [(1, "words"), (2, "both")]


# windows, joins, sync


def test_windows_on_edges(spark):
    data = [("a", 1, 10.0, "x"), ("a", 2, 10.0, "x"), ("a", 3, None, None), ("a", 4, 99.0, "y"), (None, 5, 1.0, "x")]
    df = spark.createDataFrame(data, "k string, id long, t double, v string")
    assert {r.id: r.session for r in relational.gap_sessions(df, ["k"], F.col("t"), 5, "id").collect()}[2] == 2  # the null time comes first, alone
    assert rows(relational.runs(df, ["k"], ["id"], "v"), "id", "run") == [(1, 1), (2, 1), (3, 2), (4, 3), (5, 1)]
    assert rows(relational.streak(df, ["k"], [F.desc("id")], F.col("v").isNull() | (F.col("v") == "y")), "k", "streak") == sorted([("a", 2), (None, 0)], key=repr)
    clash = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, None)], "k long, title string")
    ids = [r.id for r in relational.disambiguated(clash, "k", "title", "id").collect()]
    assert len(set(ids)) == 4 and {"1", "2"} <= set(ids)
    near = relational.near_in_time(df.select("k", F.col("t").alias("a")), df.select("k", F.col("t").alias("b")), ["k"], "a", "b", 5)
    assert near.count() == 5 and near.where("a is null or b is null or k is null").count() == 0
    for out in (relational.runs(df.limit(0), ["k"], ["id"], "v"), relational.gap_sessions(df.limit(0), ["k"], F.col("t"), 5, "id")):
        assert out.count() == 0


def test_sync_on_edges(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k long, v string")
    new = spark.createDataFrame([(1, "a"), (2, ""), (4, "d")], "k long, v string")
    assert rows(cdc.compared(old, new, ["k"], ["v"]), "k", "change") == [(1, "same"), (2, "same"), (3, "missing"), (4, "insert")]
    assert rows(cdc.inserted_only(old, new.union(new), ["k"]), "k") == [(1,), (2,), (3,), (4,)]
    assert rows(cdc.replaced(old, new, ["k"])) == sorted([(1, "a"), (2, ""), (3, "c"), (4, "d")], key=repr)
    assert cdc.pending(new, old.limit(0), ["k"]).count() == 3
    assert rows(cdc.regained(old, new, ["k"], "v")) == sorted([(1, "a"), (2, ""), (3, "c")], key=repr)
    assert cdc.compared(old.limit(0), new.limit(0), ["k"], ["v"]).count() == 0


# plugs


def test_recognisers_and_sources(spark):
    sound = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (4, "boom")], "k long, s string")
    assert rows(judging.recognised(sound, "k", "s", judging.stub_recogniser(2)), "k", "start", "said") == [(1, 0.0, "a b"), (1, 1.0, "c"), (4, 0.0, "boom")]

    def fragile(s):
        if s == "boom":
            raise RuntimeError
        return [(0.0, 1.0, s, 0.0, 0.0, None)]

    assert rows(judging.recognised(sound, "k", "s", fragile), "k") == [(1,), (3,)]
    catalogue = spark.createDataFrame([(1, "count", "2"), (2, "count", "x"), (3, "none", ""), (4, None, None)], "k long, kind string, o string")
    assert rows(connectors.dispatched(catalogue, "k", "kind", "o"), "k", "body") == [(1, "0"), (1, "1")]


@pytest.mark.parametrize("mode", ["append", "complete"])
def test_replayed_streams(spark, sf, mode):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    stream = stream.groupBy("event_type").count() if mode == "complete" else stream.select("event_id")
    out = flows.replayed(stream, f"q{uuid.uuid4().hex}", mode)
    batch = spark.read.parquet(f"{sf}/events.parquet")
    assert rows(out) == rows(batch.groupBy("event_type").count() if mode == "complete" else batch.select("event_id"))


def test_fetched_values_stay_with_their_rows(spark):
    data = [(1, "a", None), (1, "b", None), (None, "c", None), (2, None, None), (3, "none", None), (4, "d", "kept")]
    df = spark.createDataFrame(data, "k long, s string, v string")
    fetch = lambda s: None if s == "none" else s.upper()
    assert rows(judging.backfilled(df, "s", "v", fetch)) == sorted([(1, "a", "A"), (1, "b", "B"), (None, "c", "C"), (2, None, None), (3, "none", None), (4, "d", "kept")], key=repr)
    gate = F.col("k") < 3
    assert rows(upkeep.gated(df, gate, "s", fetch), "k", "extra") == sorted([(1, "A"), (1, "B"), (None, None), (2, None), (3, None), (4, None)], key=repr)
    assert upkeep.gated(df.limit(0), gate, "s", fetch).count() == 0


def test_a_failure_at_an_unknown_time_is_due(spark):
    ledger = spark.createDataFrame([(1, 2, None, False), (2, 5, None, False), (3, 1, None, True), (4, 1, None, None)], "k long, tries int, tried_at timestamp, done boolean")
    work = spark.createDataFrame([(k,) for k in range(6)], "k long")
    assert rows(upkeep.due(work, ledger, "k", F.expr("timestamp'2024-01-01'"), most=5)) == [(0,), (1,), (4,), (5,)]


def test_children_of_parents_read_anew(spark):
    """Parents read anew lose their children, with and without new ones, in one join that sorts no old row; null parents stay."""
    old = spark.createDataFrame([(p, c) for p in (1, 2, 3, None) for c in (1, 2)], "p long, c long")
    new, read = spark.createDataFrame([(1, 9), (1, 9), (4, 9)], "p long, c long"), spark.createDataFrame([(1,), (2,), (2,), (7,), (None,)], "p long")
    got = cdc.children_replaced(old, new, ["p"], read)
    assert rows(got) == sorted([(1, 9), (1, 9), (3, 1), (3, 2), (4, 9), (None, 1), (None, 2)], key=repr)
    assert rows(cdc.children_replaced(old, new, ["p"])) == sorted([(1, 9), (1, 9), (2, 1), (2, 2), (3, 1), (3, 2), (4, 9), (None, 1), (None, 2)], key=repr)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("LeftAnti") == 1 and "SortMergeJoin" not in plan
