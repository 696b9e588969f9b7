"""Operators on small rows with every edge: nulls, ties, empty tables, repeated rows."""

import math
import re
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillwork.functions import dates, text, values
from quillwork.operators import cdc, judging, matching, relational, retrieval, votes
from quillwork.sources import parsers, pieces, publish, tables
from quillwork.streaming import flows, folds


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def rows(df, *order):
    return sorted(tuple(r) for r in df.collect())


def test_text(spark):
    assert one(spark, text.fold(F.lit("  ÁÉ  Ñandú\t x "))) == "ae nandu x"
    assert one(spark, text.references(F.lit("007/2021-CR, 7/2022 y 12/2020 y 0/2020"))) == [7, 12]
    assert one(spark, text.people(F.lit("ANA (X)/ (Y)/LUIS"))) == [("ANA", "X"), ("LUIS", None)]
    assert one(spark, text.html_text(F.lit("<style>p{}</style><p>a&amp;b<br>c</p><!-- no -->d"))) == "a&b\nc\nd"
    assert one(spark, text.shortened(F.lit("aaa bbb ccc"), 6)) == "aaa…"
    assert one(spark, text.fold(F.lit(None).cast("string"))) is None
    assert one(spark, text.title_kernel(F.lit("LEY QUE ley que regula el agua (12) (3)"), ["ley que"])) == "regula el agua"


def test_dates(spark):
    for said in ("Tue, 03 Dec 2024 10:00:00 GMT", "2024-12-03T10:00:00Z", "2024-12-03", "03/12/2024", "Lima, 3 de diciembre del 2024"):
        assert one(spark, F.date_format(dates.parsed(F.lit(said)), "yyyy-MM-dd")) == "2024-12-03", said
    assert one(spark, dates.parsed(F.lit("someday"))) is None
    assert [one(spark, dates.clock_minutes(F.lit(c))) for c in ("9:00AM", "12:30 a.m.", "14:30", "25:00", "x")] == [540, 30, 870, -1, -1]


def test_numbers(spark):
    assert [one(spark, values.number(F.lit(s))) for s in ("diez (10)", "Once votos", "none")] == [10, 11, None]
    assert [one(spark, values.level(F.lit(x).cast("double"))) for x in (0.7, 0.6, 0.1, None)] == ["high", "medium", "low", ""]
    assert one(spark, values.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2)))) == 0.5


def test_strict_mode_drops_ties(spark):
    df = spark.createDataFrame([(1, "a", "SI"), (1, "a", "NO"), (1, "b", "SI"), (2, "a", "NO"), (2, "a", "NO"), (2, "a", "SI")], "rc int, party string, v string")
    assert rows(votes.strict_mode(df, ["rc", "party"], "v").select("rc", "party", "mode")) == [(1, "b", "SI"), (2, "a", "NO")]
    assert votes.strict_mode(df.limit(0), ["rc", "party"], "v").count() == 0


def test_sync_is_idempotent(spark):
    new = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    old = new.withColumns({c: F.lit("t0") for c in ("first_seen", "last_seen", "last_changed")}).where("k < 3").withColumn("v", F.coalesce("v", F.lit("")))
    once = cdc.upserted(old, new, ["k"], ["v"], F.lit("t1"))
    assert rows(once.select("k", "first_seen", "last_seen", "last_changed")) == [(1, "t0", "t1", "t0"), (2, "t0", "t1", "t0"), (3, "t1", "t1", "t1")]
    again = cdc.upserted(once, new, ["k"], ["v"], F.lit("t2"))
    assert rows(again.select("k", "last_changed")) == [(1, "t0"), (2, "t0"), (3, "t1")]
    assert cdc.history(old, new, ["k"], ["v"]).count() == 0


def test_lookup_never_fans_out(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1, 5, "x"), (1, 5, "a"), (1, 9, "b"), (None, 1, "n")], "k int, o int, t string")
    assert rows(relational.least_lookup(left, right, ["k"], ["o"], ["t"]).where("k is not null")) == [(1, "a"), (1, "a"), (2, None)]
    assert relational.least_lookup(left, right.limit(0), ["k"], ["o"], ["t"]).count() == 4


def test_overlap_and_containment(spark):
    spans = spark.createDataFrame([(1, "a", 0.0, 10.0), (1, "b", 8.0, 30.0)], "s int, voice string, start double, end double")
    said = spark.createDataFrame([(1, 1, 7.0, 11.0), (1, 2, 40.0, 41.0)], "s int, p int, start double, end double")
    assert rows(relational.largest_overlap(said, spans, "s", "p", "voice", 5.0)) == [(1, 1, "a", 3.0)]
    texts = spark.createDataFrame([(1, "the Ágora of trade unions"), (2, "x"), (3, None)], "k int, t string")
    names = spark.createDataFrame([("agor",), ("gora of trade uni",), ("",), (None,), ("x",)], "n string")
    assert rows(matching.contained_names(texts, names, "k", "t", "n")) == [(1, "gora of trade uni"), (2, "x")]


def brute_titles(said, names, bridges):
    """The tiers of T6 of plain lower-case texts, every text against every title."""
    long = lambda t: {w for w in t.split() if len(w) >= 7}
    idf = {t: math.log((len(names) + 1) / (sum(t in long(k) for _, k in names) + 1)) + 1 for _, k in names for t in long(k)}
    out = []
    for i, text_ in said:
        for j, k in names:
            parts = [k[k.rfind(f" {x} ") + 1 :] for x in bridges if f" {x} " in k]
            tail = max((len(p) for p in parts if len(p) >= 18 and p in text_), default=0) / max(len(text_), 1) * 0.8
            whole = (k in text_) * len(k) / max(len(text_), 1)
            tokens, both = long(k), long(k) & long(text_)
            rare = min(tokens, key=lambda t: (-idf[t], t), default=None)
            if len(k) < 8:
                continue
            if tail >= 0.04:
                out.append((i, j, round(tail, 6), "tail"))
            elif whole >= 0.04:
                out.append((i, j, round(whole, 6), "kernel"))
            elif rare in both and idf[rare] >= 3 and len(both) >= 2 and len(both) / len(tokens) >= 0.3:
                out.append((i, j, round(len(both) / len(tokens) * 0.5, 6), "tokens"))
    return sorted(out)


@pytest.mark.parametrize("most", [matching.CATALOGUE, 0])
def test_titles_meet_texts_in_every_tier(spark, monkeypatch, most):
    monkeypatch.setattr(matching, "CATALOGUE", most)
    names = [(1, "extraordinary reform of the law on lakes and rivers"), (2, "water law"), (3, "transparency of the budget"), (4, "tiny"), (5, "clean air now"), (6, "ab cd ef")]
    names += [(10 + i, f"common{i % 3} subject number{i} clauses") for i in range(30)]
    said = [(1, "on the of the law on lakes and rivers today"), (2, "a saltwater lawsuit"), (3, "nontransparency of the budgets"), (4, "tiny"), (5, "an unclean air nowhere"), (6, "xab cd efx")]
    said += [(7, "number12 " + "filler word " * 90 + "clauses"), (8, ""), (9, "x " * 600 + "of the law on lakes and rivers"), (10, "extraordinary and nothing")]
    bridges = ["of the", "of", "on"]
    expected = brute_titles(said, names, bridges)
    assert {t for *_, t in expected} == {"tail", "kernel", "tokens"} and {(1, 1), (2, 2), (3, 3), (5, 5), (6, 6)} <= {x[:2] for x in expected}
    texts = spark.createDataFrame([*said, (11, None), (None, "clean air now")], "i int, x string")
    titles = spark.createDataFrame([*names, (99, None)], "j int, t string")
    found = matching.tiered_titles(texts, titles, "i", "x", "j", "t", ["proyecto"], bridges)
    assert rows(found.select("i", "j", F.round("score", 6), "tier")) == expected
    assert matching.tiered_titles(texts.limit(0), titles, "i", "x", "j", "t", ["proyecto"], bridges).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 91)], "a long, b long")
    found = dict(retrieval.components(edges).collect())
    assert found == {**dict.fromkeys(range(41), 0), 90: 90, 91: 90}
    assert retrieval.components(edges.limit(0)).count() == 0


def test_publish_detects_other_writers(spark):
    root = f"{retrieval.shared_folder(spark)}/publish-{uuid.uuid4().hex}"
    df = spark.range(3)
    assert publish.publish(df, root, 0) == 1
    with pytest.raises(publish.Conflict):
        publish.publish(df, root, 0)
    assert publish.publish_merged(spark, root, lambda old: old.union(df)) == 2
    assert publish.read_published(spark, root).count() == 6 and publish.version(spark, root) == 2


def test_messages_keep_blocks_whole(spark):
    df = spark.createDataFrame([(1, "S", "x" * 30, i) for i in range(5)] + [(2, None, None, 0)], "r int, s string, t string, o int")
    out = publish.packed_messages(df, "r", "s", "t", ["o"], 70).where("r = 1").orderBy("part").collect()
    assert [r.part for r in out] == [1, 2, 3] and all(len(r.message) <= 70 and r.message.startswith("S\n") and r.parts == 3 for r in out)


def test_parsers():
    vtt = "WEBVTT\n\n00:01.000 --> 00:02.000\nold\nnew\n\n00:02.000 --> 00:03.000\nnew\n\n01:00:03.500 --> 01:00:04.000\nthen <c>x</c>"
    assert list(parsers.caption_lines(vtt)) == [(1.0, "new"), (3603.5, "then x")]
    ics = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1\r\nSUMMARY:a\\, b\r\n c\r\nDTSTART;TZID=America/Lima:20240101T100000\r\nBEGIN:VALARM\r\nUID:9\r\nEND:VALARM\r\nEND:VEVENT\r\nEND:VCALENDAR"
    assert list(parsers.calendar_events(ics)) == [("1", "a, bc", "20240101T100000", None, "America/Lima", None, None)]
    feed = "<feed><entry><title>T</title><link href='http://x'/><category term='a'/><updated>2024-01-01</updated></entry></feed>"
    assert list(parsers.feed_items(feed)) == [("http://x", "T", "", "2024-01-01", None, "a")]
    assert list(parsers.feed_items("<broken")) == []
    assert list(parsers.prose_votes("A favor: dos (Ana y Luis)")) == [("SI", 2, "Ana|Luis")]
    body = "word " * 50
    cut = list(pieces.chunks(60, 10)(body))
    assert cut[0][0] == 0 and "".join(c[10 if i else 0 :] for i, (_, c) in enumerate(cut)) == body
    assert [f for (f,) in pieces.fragments(20, 5, 3)("aaaaaaaaaa\nbbbbbbbbbbbbbbb\nHd\ncc")] == ["aaaaaaaaaa", "bbbbbbbbbbbbbbb", "Hd\ncc"]


def test_judges():
    twice = lambda p: [(0, True), (0, False), (5, True), (1, True)]
    assert judging.answered(["a", "b", "c"], [judging.failing_judge, twice]) == [None, True, None]
    assert judging.answered(["a"], [judging.failing_judge]) == [None]


def test_optional_tables(spark, sf):
    assert tables.optional_table(spark, f"{sf}/nothing.parquet", "a int").count() == 0
    found = tables.optional_table(spark, f"{sf}/region.parquet", "r_name string, extra int")
    assert found.columns == ["r_name", "extra"] and found.where("extra is not null").count() == 0


def test_suppression_in_batch_and_stream_agree(spark, sf):
    step = folds.unlike_recent("t", "x", 6 * 3600, 0.5, ["i"])
    data = [(1, 0.0, 1, "water law debated today"), (1, 60.0, 2, "water law debated"), (1, 30000.0, 3, "water law debated today"), (2, 0.0, 4, None), (2, 1.0, 5, None)]
    df = spark.createDataFrame(data, "k int, t double, i int, x string")
    assert rows(folds.folded(df, ["k"], ["t"], step, "t double, i int").select("i")) == [(1,), (3,), (4,), (5,)]
    path = f"{retrieval.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    df.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    out = flows.replayed(folds.folded_stream(stream, ["k"], ["t"], step, "t double, i int"), f"q{uuid.uuid4().hex}")
    assert rows(out.select("i")) == [(1,), (3,), (4,), (5,)]


def test_delimited(spark):
    path = f"{retrieval.shared_folder(spark)}/text-{uuid.uuid4().hex}"
    spark.createDataFrame([('a;b\n1;"x;y"\n2;null\nnull;z',)], "v string").coalesce(1).write.option("lineSep", "\n").text(path)
    got = tables.delimited(spark, path, T.StructType.fromDDL("a string, b string"), ["a"])
    assert rows(got.select("a", F.coalesce("b", F.lit("-")))) == [("1", "x;y"), ("2", "-")]
