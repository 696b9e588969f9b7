"""Composite views: end products put together from the other operators."""

from __future__ import annotations

from functools import reduce


from pyspark.sql import functions as F

from quillwork.functions import dates
from quillwork.functions.text import references
from quillwork.operators import matching as M
from quillwork.operators import relational as R
from quillwork.operators import votes as V
from quillwork.operators.greedy import leaders
from quillwork.session import table
from quillwork.sources import publish as K

from .records import MODE, VOTES, roll_calls
from .registry import query
from .vectors import leaders_sql


@query("D1", """SELECT w AS days, section, count(*) AS n FROM (VALUES (1), (7), (30)) v(w), (SELECT 'orders' AS section, o_orderdate AS moment FROM orders UNION ALL SELECT 'shipments', l_shipdate FROM lineitem) s
    WHERE moment <= TIMESTAMP '1998-06-15' AND moment >= TIMESTAMP '1998-06-15' - to_days(w) GROUP BY 1, 2""")
def panel_windows(spark, sf):
    as_of = F.expr("timestamp'1998-06-15 00:00:00'")
    rows = table(spark, sf, "orders").select(F.lit("orders").alias("section"), F.col("o_orderdate").alias("at"))
    rows = rows.unionByName(table(spark, sf, "lineitem").select(F.lit("shipments").alias("section"), F.col("l_shipdate").alias("at")))
    rows = rows.where(dates.within_days("at", as_of, 30))
    flags = F.array(*[F.when(dates.within_days("at", as_of, d), d) for d in (1, 7, 30)])
    return rows.select("section", F.explode(F.array_compact(flags)).alias("days")).groupBy("days", "section").agg(F.count("*").alias("n"))


@query("D2", """WITH d AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, row_number() OVER (PARTITION BY lang, lower(substr(text, 1, 80)) ORDER BY n_chars DESC, doc_id) AS r FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(quality, 1) = 1 AND length(text) >= 20)
    SELECT lang, source, count(*) AS n, max_by(doc_id, (n_chars, -doc_id)) AS top FROM d WHERE r = 1 GROUP BY 1, 2""")
def news_board(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    rows = R.where_all(rows, F.coalesce("quality", F.lit(1)) == 1, F.length("text") >= 20).withColumn("head", F.lower(F.substring("text", 1, 80)))
    rows = R.first_per_key(rows, ["lang", "head"], [F.desc("n_chars"), F.col("doc_id")])
    return rows.groupBy("lang", "source").agg(F.count("*").alias("n"), F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("top"))


@query("D3 V10", f"""WITH RECURSIVE {leaders_sql(0.3)}, d AS (SELECT doc_id, array_to_string(list_filter([CASE WHEN lower(text) LIKE '%license%' THEN 'license' END, CASE WHEN lower(text) LIKE '%!!%' THEN 'shout' END], lambda x: x IS NOT NULL), ',') AS tags FROM documents)
    SELECT leader, tags, count(*) AS n FROM r JOIN d ON doc_id = vec_id GROUP BY 1, 2""")
def media_board(spark, sf):
    tags = M.labels(F.lower("text"), {"license": "license", "shout": "!!"})
    docs = table(spark, sf, "documents").select("doc_id", F.array_join(tags, ",").alias("tags"), "source")
    groups = leaders(table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id"), "label", ["doc_id"], "doc_id", "embedding", 0.3)
    return docs.join(groups, "doc_id").groupBy("leader", "tags").agg(F.count("*").alias("n"))


@query("D5 N30", """SELECT o_orderkey, coalesce(n, 0) AS n_points, coalesce(p.p_name, 'to be set') AS lead_item FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, min(l_partkey) AS k FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
    LEFT JOIN part p ON p.p_partkey = k WHERE o_orderdate BETWEEN TIMESTAMP '1998-06-15' AND TIMESTAMP '1998-09-15'""")
def agenda_board(spark, sf):
    sessions = table(spark, sf, "orders").where("o_orderdate between timestamp'1998-06-15' and timestamp'1998-09-15'").select("o_orderkey")
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    rows = R.with_child_aggregates(sessions, lines, ["o_orderkey"], F.count("*").alias("n_points"), F.min("l_partkey").alias("p_partkey"), zero=["n_points"])
    named = rows.join(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", "left")
    return named.select("o_orderkey", "n_points", F.coalesce("p_name", F.lit("to be set")).alias("lead_item"))


@query("D6", """SELECT o.o_orderkey, o.o_orderstatus, c.c_name, (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AS n_lines, (SELECT count(*) FROM events e WHERE e.user_id = o.o_custkey) AS n_mentions FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey""")
def record_dossier(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    rows = R.with_child_aggregates(rows, lines, ["o_orderkey"], F.count("*").alias("n_lines"), zero=["n_lines"])
    events = table(spark, sf, "events").withColumnRenamed("user_id", "o_custkey")
    rows = R.with_child_aggregates(rows, events, ["o_custkey"], F.count("*").alias("n_mentions"), zero=["n_mentions"])
    return rows.select("o_orderkey", "o_orderstatus", "c_name", "n_lines", "n_mentions")


@query("D7", f"WITH {VOTES}, {MODE} SELECT v.member, c.c_name, count(*) AS n_votes, count(*) FILTER (v.position <> m.mode) AS against FROM votes v JOIN mode m USING (rollcall, party) JOIN customer c ON c.c_custkey = v.member GROUP BY 1, 2")
def person_dossier(spark, sf):
    votes = roll_calls(spark, sf)
    rows = votes.join(V.strict_mode(votes, ["rollcall", "party"], "position"), ["rollcall", "party"])
    rows = rows.groupBy("member").agg(F.count("*").alias("n_votes"), F.count_if(F.col("position") != F.col("mode")).alias("against"))
    return rows.join(table(spark, sf, "customer"), F.col("member") == F.col("c_custkey")).select("member", "c_name", "n_votes", "against")


@query("D9", """SELECT conv_id, role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, min(turn) AS first_turn FROM conversations WHERE role <> 'system' GROUP BY 1, 2""")
def stance_timeline(spark, sf):
    rows = table(spark, sf, "conversations").where("role <> 'system'")
    return rows.groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"), F.min("turn").alias("first_turn"))


@query("D10", """SELECT conv_id, count(*) AS parts, CASE WHEN sum(len(regexp_extract_all(text, '\\sthe\\s'))) > 3 * sum(len(regexp_extract_all(text, '\\sde\\s'))) AND sum(len(regexp_extract_all(text, '\\sthe\\s'))) >= 5 THEN 'upper' END AS chamber FROM conversations GROUP BY 1""")
def transcript_catalogue(spark, sf):
    n = lambda p: F.sum(F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("parts"), n(r"\sthe\s").alias("a"), n(r"\sde\s").alias("b"))
    return rows.select("conv_id", "parts", F.when((F.col("a") > 3 * F.col("b")) & (F.col("a") >= 5), "upper").alias("chamber"))


@query("D11 N18", """SELECT 'new' AS section, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-08' AND o_orderdate < TIMESTAMP '1998-06-15' UNION ALL
    SELECT 'shipped', count(*) FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-08' AND l_shipdate < TIMESTAMP '1998-06-15' UNION ALL SELECT 'upcoming', count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-15' AND o_orderdate < TIMESTAMP '1998-06-22'""")
def alert_payload(spark, sf):
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    part = lambda df, name, at, a, b: df.where((F.col(at) >= a) & (F.col(at) < b)).agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), "n")
    out = part(orders, "new", "o_orderdate", "1998-06-08", "1998-06-15")
    out = out.unionByName(part(lines, "shipped", "l_shipdate", "1998-06-08", "1998-06-15"))
    return out.unionByName(part(orders, "upcoming", "o_orderdate", "1998-06-15", "1998-06-22"))


@query("D13")
def news_digest(spark, sf):
    """Whole texts packed into messages for each language and run of 200 ids, as a digest by language and day would be."""
    rows = table(spark, sf, "documents").select(F.concat_ws("-", "lang", F.floor(F.col("doc_id") / 200).cast("string")).alias("digest"), "source", "doc_id", "text")
    out = K.packed_messages(rows, "digest", "source", "text", ["source", "doc_id"], 1500)
    return out.select("digest", "part", "parts", F.length("message").alias("n"))


@query("D12", """SELECT 'dearest' AS section, o_orderkey AS id FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5) UNION ALL SELECT 'latest', o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5)
    UNION ALL SELECT 'clients', c_custkey FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5) UNION ALL SELECT 'events', event_id FROM (SELECT * FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 5)
    UNION ALL SELECT 'texts', doc_id FROM (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5)""")
def brief_material(spark, sf):
    """Five sections of five: what a daily brief is written from."""
    parts = (
        ("dearest", "orders", "o_orderkey", F.desc("o_totalprice"), "true"), ("latest", "orders", "o_orderkey", F.desc("o_orderdate"), "true"),
        ("clients", "customer", "c_custkey", F.desc("c_acctbal"), "true"), ("events", "events", "event_id", F.desc("ts"), "event_type = 'error'"),
        ("texts", "documents", "doc_id", F.desc("n_chars"), "true"),
    )
    rows = [table(spark, sf, t).where(some).orderBy(order, key).limit(5).select(F.lit(name).alias("section"), F.col(key).alias("id")) for name, t, key, order, some in parts]
    return reduce(lambda x, y: x.unionByName(y), rows)


@query("D14", """SELECT c_custkey, count(o_orderkey) AS followed, count(o_orderkey) FILTER (o_orderstatus = 'F') AS closed FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 100000 GROUP BY 1""")
def client_workspace(spark, sf):
    orders = table(spark, sf, "orders").where("o_totalprice > 100000").withColumnRenamed("o_custkey", "c_custkey")
    return R.with_child_aggregates(
        table(spark, sf, "customer").select("c_custkey"), orders, ["c_custkey"],
        F.count("*").alias("followed"), F.count_if(F.col("o_orderstatus") == "F").alias("closed"), zero=["followed", "closed"],
    )


@query("D16", """SELECT o_custkey, count(*) AS n, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders WHERE o_custkey % 10 = 1 GROUP BY 1""")
def watch_list_tracker(spark, sf):
    watched = table(spark, sf, "customer").where("c_custkey % 10 = 1").select(F.col("c_custkey").alias("o_custkey"))
    rows = table(spark, sf, "orders").join(watched, "o_custkey", "left_semi")
    return rows.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query("D17 W3", """SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer WHERE c_acctbal >= 450) WHERE n <= 50""")
def candidate_quota(spark, sf):
    rows = table(spark, sf, "customer").where("c_acctbal >= 450")
    return R.first_per_key(rows, ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 50).select("c_nationkey", "c_custkey")


@query("N26", """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM events WHERE ts < TIMESTAMP '2024-01-28' GROUP BY 1, 2""")
def closed_day_groups(spark, sf):
    rows = table(spark, sf, "events").where("ts < timestamp'2024-01-28'")
    ids = F.transform(F.array_sort(F.collect_list("event_id")), lambda i: i.cast("string"))
    return rows.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.array_join(ids, ",").alias("ids"))


@query("N34", """SELECT lang, count(*) AS n, round(count(*) / 30, 4) AS per_day FROM documents WHERE contains(lower(text), 'license') GROUP BY 1""")
def client_dry_run(spark, sf):
    rows = table(spark, sf, "documents").where(F.contains(F.lower("text"), F.lit("license")))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.count("*") / 30, 4).alias("per_day"))


@query("W4", """SELECT doc_id FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) ORDER BY r, lang NULLS FIRST LIMIT 40""")
def capped_round_robin(spark, sf):
    return R.round_robin_limit(table(spark, sf, "documents").select("doc_id", "lang"), "lang", [F.col("doc_id")], 40).select("doc_id")


@query("T13 N30 F15", """SELECT doc_id, CASE WHEN doc_id * 40 BETWEEN 1 AND 30000 THEN doc_id * 40 || ',7' ELSE '7' END AS numbers FROM documents WHERE doc_id <> 0""")
def references_in_news(spark, sf):
    """Numbers of the bills that invented news name: zeros in front, repeats, and numbers out of range."""
    said = F.concat(F.lit("On bill 00"), F.col("doc_id") * 40, F.lit("/2026-CR, again "), F.col("doc_id") * 40, F.lit("/2026 and 7/1999, not 8/1899 or 9/20261"))
    found = references(said)
    return table(spark, sf, "documents").where("doc_id <> 0").select("doc_id", F.array_join(found, ",").alias("numbers"))


#: Request names and the queries that answer them.
ACTIONS = {"panel": "panel_windows", "news": "news_board", "bills": "bill_board", "agenda": "agenda_board", "record": "record_dossier", "person": "person_dossier", "search": "hybrid_rrf"}


def answer(spark, sf, action: str):
    """The result of a named request; an unknown name is an error of the caller."""
    from .registry import REGISTRY

    if action not in ACTIONS:
        raise KeyError(f"no action {action!r}")
    return REGISTRY[ACTIONS[action]].run(spark, sf)


@query("D18", "SELECT * FROM (VALUES ('panel', true), ('news', true), ('bills', true), ('agenda', true), ('record', true), ('person', true), ('search', true)) t(action, answers)")
def request_dispatch(spark, sf):
    """Every named request, and whether it is answered with rows."""
    rows = [answer(spark, sf, a).agg((F.count("*") > 0).alias("answers")).select(F.lit(a).alias("action"), "answers") for a in ACTIONS]
    return reduce(lambda x, y: x.unionByName(y), rows)
