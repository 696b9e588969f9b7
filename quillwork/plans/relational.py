"""Queries over joins, filters, aggregates, windows, sorts and sets, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.functions import dates
from quillwork.functions.text import fold
from quillwork.operators import relational as R
from quillwork.session import table

from .registry import query

AS_OF = "timestamp'1998-06-15 00:00:00'"
EVENTS_AS_OF = "timestamp'2024-01-28 00:00:00'"


@query(
    "S1 P1 P2 J2 J3 A6 O1 D4",
    """WITH least_part AS (SELECT p_size % 50 AS size_key, min(p_partkey) AS part_key FROM part GROUP BY 1),
    per_order AS (SELECT l_orderkey, count(*) AS n_lines, round(sum(l_extendedprice), 2) AS total,
      string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, min(l_suppkey) AS first_supplier
      FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31' GROUP BY 1)
    SELECT o.o_orderkey, o.o_orderstatus, n_lines, total, flags, first_supplier, p.p_name AS reference_part
    FROM orders o JOIN per_order d ON o.o_orderkey = d.l_orderkey
    LEFT JOIN least_part lp ON lp.size_key = o.o_orderkey % 50 LEFT JOIN part p ON p.p_partkey = lp.part_key
    WHERE o.o_orderstatus IN ('O', 'P')""",
)
def bill_board(spark: SparkSession, sf: str) -> DataFrame:
    """Filtered records with set-aggregated children and a tie-broken lookup: the flagship list."""
    lines = table(spark, sf, "lineitem").where(F.col("l_shipdate").between("1996-01-01", "1997-12-31"))
    detail = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("n_lines"),
        F.round(F.sum("l_extendedprice"), 2).alias("total"),
        R.listed("l_returnflag", ",").alias("flags"),
        F.min("l_suppkey").alias("first_supplier"),
    )
    orders = R.where_all(table(spark, sf, "orders"), F.col("o_orderstatus").isin("O", "P"), None)
    rows = orders.join(detail, "o_orderkey").withColumn("size_key", F.col("o_orderkey") % 50)
    parts = table(spark, sf, "part").withColumn("size_key", (F.col("p_size") % 50).cast("long"))
    rows = R.least_lookup(rows, parts, ["size_key"], ["p_partkey"], ["p_name"])
    return rows.select("o_orderkey", "o_orderstatus", "n_lines", "total", "flags", "first_supplier", F.col("p_name").alias("reference_part"))


@query("P2 P4 P17", """SELECT o_orderkey, 'order/' || o_orderstatus || '/' || o_orderkey AS url FROM orders
    WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-03-31' AND o_orderpriority ILIKE '%urgent%'""")
def date_range_and_substring(spark, sf):
    orders = table(spark, sf, "orders").where(F.col("o_orderdate").between("1997-01-01", "1997-03-31"))
    orders = orders.where(F.col("o_orderpriority").ilike("%urgent%"))
    return orders.select("o_orderkey", F.concat(F.lit("order/"), "o_orderstatus", F.lit("/"), F.col("o_orderkey").cast("string")).alias("url"))


@query("P3", f"""SELECT w AS days, count(*) AS n FROM events, (VALUES (1), (7), (30)) v(w)
    WHERE ts >= {EVENTS_AS_OF} - to_days(w) AND ts <= {EVENTS_AS_OF} GROUP BY 1""")
def relative_windows(spark, sf):
    events, as_of = table(spark, sf, "events"), F.expr(EVENTS_AS_OF)
    flags = [F.struct(F.lit(d).alias("days"), dates.within_days("ts", as_of, d).alias("in")) for d in (1, 7, 30)]
    return events.select(F.explode(F.array(*flags)).alias("w")).where("w.in").groupBy("w.days").agg(F.count("*").alias("n"))


@query("P6", """SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 400000)""")
def exists_filter(spark, sf):
    big = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("P7 U3", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderkey % 5 = 0)")
def anti_join_missing(spark, sf):
    have = table(spark, sf, "orders").where("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(have, "c_custkey", "left_anti").select("c_custkey")


@query("P15 P16", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'unknown' END AS status,
    coalesce(CASE WHEN o_totalprice > 100000 THEN o_orderpriority END, 'minor ' || o_orderstatus) AS grade FROM orders""")
def code_labels(spark, sf):
    rows = table(spark, sf, "orders")
    status = R.labelled("o_orderstatus", {"F": "finished", "O": "open"}, "unknown")
    grade = F.coalesce(F.when(F.col("o_totalprice") > 100000, F.col("o_orderpriority")), F.concat(F.lit("minor "), "o_orderstatus"))
    return rows.select("o_orderkey", status.alias("status"), grade.alias("grade"))


@query("P11", """WITH d AS (SELECT doc_id, source, contains(lower(text), 'license') AS keyword, lang IN ('en', 'fr') AS topical FROM documents)
    SELECT doc_id, CASE WHEN source = 'src0' THEN 'strict' WHEN source IN ('src1', 'src2') THEN 'broad' ELSE 'general' END AS gate FROM d
    WHERE (source = 'src0' AND keyword) OR (source IN ('src1', 'src2') AND topical) OR source NOT IN ('src0', 'src1', 'src2')""")
def source_class_gates(spark, sf):
    docs = table(spark, sf, "documents")
    gate = F.when(F.col("source") == "src0", "strict").when(F.col("source").isin("src1", "src2"), "broad").otherwise("general")
    keyword, topical = F.contains(F.lower("text"), F.lit("license")), F.col("lang").isin("en", "fr")
    rows = docs.select("doc_id", gate.alias("gate"), keyword.alias("keyword"), topical.alias("topical"))
    passes = F.when(F.col("gate") == "strict", F.col("keyword")).when(F.col("gate") == "broad", F.col("topical")).otherwise(True)
    return rows.where(passes).select("doc_id", "gate")


@query("P14", """WITH votes AS (SELECT date_trunc('month', o_orderdate) AS m, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2)
    SELECT strftime(m, '%Y-%m') AS rollcall, CAST(sum(n) AS BIGINT) AS n FROM votes GROUP BY m HAVING max(n) < 60""")
def near_unanimous_filter(spark, sf):
    votes = table(spark, sf, "orders").select(dates.month("o_orderdate").alias("rollcall"), "o_orderpriority")
    return R.bounded_above(votes, ["rollcall"], "o_orderpriority", 60).groupBy("rollcall").agg(F.count("*").alias("n"))


@query("J1 J4", """SELECT n_name, coalesce(r_name, 'nowhere') AS region, count(s_suppkey) AS n FROM nation
    LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA' JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2""")
def left_join_defaults(spark, sf):
    region = table(spark, sf, "region").where("r_name <> 'ASIA'")
    nation = table(spark, sf, "nation")
    named = nation.join(R.small(region), nation["n_regionkey"] == region["r_regionkey"], "left").withColumn("region", F.coalesce("r_name", F.lit("nowhere")))
    rows = table(spark, sf, "supplier").join(R.small(named), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name", "region").agg(F.count("s_suppkey").alias("n"))


@query("J3", """WITH best AS (SELECT p_brand, min(p_partkey) AS k FROM part GROUP BY 1)
    SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, b.k AS reference_key, q.p_name AS reference_name FROM lineitem l
    JOIN part p ON p.p_partkey = l.l_partkey LEFT JOIN best b ON b.p_brand = p.p_brand LEFT JOIN part q ON q.p_partkey = b.k""")
def tiebreak_lookup_join(spark, sf):
    part = table(spark, sf, "part")
    lines = table(spark, sf, "lineitem").join(part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    rows = R.least_lookup(lines.select("l_orderkey", "l_linenumber", "l_partkey", "p_brand"), part, ["p_brand"], ["p_partkey"], ["p_partkey", "p_name"])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.col("p_partkey").alias("reference_key"), F.col("p_name").alias("reference_name"))


@query("J5 A5", """SELECT o_orderkey, coalesce(n, 0) AS n_lines, modes FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n,
    string_agg(DISTINCT l_linestatus || l_returnflag, ', ' ORDER BY l_linestatus || l_returnflag) AS modes FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def listagg_detail_per_key(spark, sf):
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return R.with_child_aggregates(
        table(spark, sf, "orders").select("o_orderkey"), lines, ["o_orderkey"],
        F.count("*").alias("n_lines"), R.listed(F.concat("l_linestatus", "l_returnflag")).alias("modes"), zero=["n_lines"],
    )


@query("J6", """WITH r AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey
      ORDER BY (l_returnflag = 'R') DESC, l_linenumber, l_partkey) AS n FROM lineitem)
    SELECT o_orderkey, coalesce(l_partkey, -1) AS l_partkey FROM orders LEFT JOIN r ON l_orderkey = o_orderkey AND n = 1""")
def first_preferred_child(spark, sf):
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    orders = table(spark, sf, "orders").select("o_orderkey")
    return R.preferred_child(orders, lines, ["o_orderkey"], F.col("l_returnflag") == "R", ["l_linenumber"], "l_partkey", F.lit(-1).cast("long"))


@query("J7", """SELECT a.s_suppkey, a.s_nationkey, count(b.s_suppkey) AS n_siblings, coalesce(string_agg(CAST(b.s_suppkey AS VARCHAR), ',' ORDER BY b.s_suppkey), '') AS siblings
    FROM supplier a LEFT JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey GROUP BY 1, 2""")
def siblings_in_group(spark, sf):
    rows = R.siblings(table(spark, sf, "supplier"), "s_nationkey", "s_suppkey")
    joined = F.array_join(F.transform("siblings", lambda s: s.cast("string")), ",")
    return rows.select("s_suppkey", "s_nationkey", F.size("siblings").cast("long").alias("n_siblings"), joined.alias("siblings"))


@query("J7", """SELECT a.s_suppkey, count(b.s_suppkey) AS n FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey GROUP BY 1""")
def whole_group_members(spark, sf):
    rows = R.siblings(table(spark, sf, "supplier"), "s_nationkey", "s_suppkey", include_self=True)
    return rows.select("s_suppkey", F.size("siblings").cast("long").alias("n"))


@query("J9 A7", """WITH a AS (SELECT date_trunc('month', o_orderdate) m, count(*) n FROM orders GROUP BY 1),
    b AS (SELECT date_trunc('month', l_shipdate) m, count(*) n FROM lineitem GROUP BY 1)
    SELECT strftime(coalesce(a.m, b.m), '%Y-%m-%d') AS period, coalesce(a.n, 0) AS filed, coalesce(b.n, 0) AS shipped FROM a FULL JOIN b ON a.m = b.m""")
def monthly_two_series_outer(spark, sf):
    filed = R.series(table(spark, sf, "orders"), "o_orderdate", filed=F.count("*"))
    return R.outer_series(filed, R.series(table(spark, sf, "lineitem"), "l_shipdate", shipped=F.count("*")), "period")


@query("J8 J18", """SELECT o.o_orderkey, c.c_mktsegment FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
    WHERE date_trunc('year', o_orderdate) = (SELECT date_trunc('year', max(o_orderdate)) FROM orders)""")
def active_period_semi_join(spark, sf):
    orders = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    latest = orders.agg(F.max("y").alias("y"))
    rows = orders.join(F.broadcast(latest), "y", "left_semi")  # one row
    return rows.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")


@query("J14", """WITH e AS (SELECT user_id, event_id, epoch(ts) AS a, lead(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events WHERE event_type <> 'error'),
    v AS (SELECT user_id, event_type, epoch(ts) AS s, epoch(ts) + 3600 * (1 + value / 100) AS e FROM events WHERE event_type <> 'view'),
    o AS (SELECT e.user_id, event_id, event_type, sum(least(b, v.e) - greatest(a, s)) AS overlap FROM e JOIN v ON e.user_id = v.user_id AND a < v.e AND s < b WHERE b IS NOT NULL GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_id ORDER BY round(overlap, 3) DESC, event_type) AS n FROM o)
    SELECT user_id, event_id, event_type, round(overlap, 2) AS overlap FROM r WHERE n = 1""")
def interval_overlap_argmax(spark, sf):
    from pyspark.sql import Window

    events = table(spark, sf, "events").withColumn("t", F.unix_micros("ts") / 1e6)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    spans = events.where("event_type <> 'error'").withColumn("next", F.lead("t").over(w)).where("next is not null")
    spans = spans.select("user_id", "event_id", F.col("t").alias("start"), F.col("next").alias("end"))
    voices = events.where("event_type <> 'view'").select("user_id", "event_type", F.col("t").alias("start"), (F.col("t") + 3600 * (1 + F.col("value") / 100)).alias("end"))
    return R.largest_overlap(spans, voices, "user_id", "event_id", "event_type", 3600.0).withColumn("overlap", F.round("overlap", 2))


@query("J15", """SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id
    AND abs(epoch(a.ts) - epoch(b.ts)) <= 7200 WHERE a.event_type = 'signup' AND b.event_type = 'purchase'""")
def temporal_proximity_join(spark, sf):
    events = table(spark, sf, "events").withColumn("t", F.unix_micros("ts") / 1e6)
    a = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("a_id"), F.col("t").alias("ta"))
    b = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("b_id"), F.col("t").alias("tb"))
    return R.near_in_time(a, b, ["user_id"], "ta", "tb", 7200).select("a_id", "b_id")


@query("J16", """SELECT n_nationkey, CASE WHEN count(DISTINCT s_suppkey) = 1 THEN min(s_suppkey) END AS s_suppkey FROM nation
    LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 8000 GROUP BY 1""")
def unique_match_or_nothing(spark, sf):
    rich = table(spark, sf, "supplier").where("s_acctbal > 8000").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    return R.only_match(table(spark, sf, "nation").select("n_nationkey"), rich, ["n_nationkey"], "s_suppkey")


@query("J17 P8", """SELECT d.doc_id, string_agg(c.client, ',' ORDER BY c.client) AS clients FROM documents d JOIN (VALUES ('alpha', 'en|fr', 3), ('beta', 'all', 7), ('gamma', 'de', 5)) c(client, langs, watched)
    ON list_contains(string_split(c.langs, '|'), d.lang) OR d.doc_id % 10 = c.watched OR (c.langs = 'all' AND d.source = 'src1') GROUP BY 1""")
def bridge_through_configuration(spark, sf):
    config = spark.createDataFrame([("alpha", "en|fr", 3), ("beta", "all", 7), ("gamma", "de", 5)], "client string, langs string, watched int")
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    topic = config.select("client", F.explode(F.split("langs", r"\|")).alias("lang"))
    by_topic = docs.join(F.broadcast(topic), "lang").select("doc_id", "client")  # configuration literals
    by_watch = docs.withColumn("watched", (F.col("doc_id") % 10).cast("int")).join(F.broadcast(config.select("client", "watched")), "watched").select("doc_id", "client")
    by_all = docs.where("source = 'src1'").withColumn("langs", F.lit("all")).join(F.broadcast(config.select("client", "langs")), "langs").select("doc_id", "client")
    return by_topic.union(by_watch).union(by_all).groupBy("doc_id").agg(R.listed("client", ",").alias("clients"))


@query("A1 A2 N15", f"""SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_totalprice > 200000) AS large,
    count(*) FILTER (o_orderdate >= {AS_OF}) AS recent FROM orders GROUP BY 1""")
def kpi_status_counts(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"),
        F.count_if(F.col("o_totalprice") > 200000).alias("large"), F.count_if(F.col("o_orderdate") >= F.expr(AS_OF)).alias("recent"),
    )


@query("A3 U1", """SELECT kind, count(DISTINCT who) AS n FROM (SELECT 'order' AS kind, o_custkey AS who FROM orders UNION ALL SELECT 'event', user_id FROM events) GROUP BY 1""")
def union_two_sources_distinct_refs(spark, sf):
    orders = table(spark, sf, "orders").select(F.lit("order").alias("kind"), F.col("o_custkey").alias("who"))
    events = table(spark, sf, "events").select(F.lit("event").alias("kind"), F.col("user_id").alias("who"))
    return orders.unionByName(events).groupBy("kind").agg(F.count_distinct("who").alias("n"))


@query("A4 N32", """SELECT strftime(least((SELECT min(o_orderdate) FROM orders), (SELECT min(l_shipdate) FROM lineitem)), '%Y-%m-%d') AS first_day,
    strftime(greatest((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)), '%Y-%m-%d') AS last_day""")
def cross_source_extents(spark, sf):
    a = table(spark, sf, "orders").agg(F.min("o_orderdate").alias("a0"), F.max("o_orderdate").alias("a1"))
    b = table(spark, sf, "lineitem").agg(F.min("l_shipdate").alias("b0"), F.max("l_shipdate").alias("b1"))
    both = a.crossJoin(F.broadcast(b))  # one row each
    return both.select(F.date_format(F.least("a0", "b0"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.greatest("a1", "b1"), "yyyy-MM-dd").alias("last_day"))


@query("A6", """SELECT l_suppkey, min(l_orderkey) AS first_order, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY 1""")
def set_agg_first_per_key(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.min("l_orderkey").alias("first_order"), R.listed("l_returnflag", ",").alias("flags"), F.count_distinct("l_partkey").alias("n_parts")
    )


@query("A13 A14", """SELECT user_id, strftime(max(ts), '%Y-%m-%d') AS last_day FROM events GROUP BY 1
    HAVING max(ts) < TIMESTAMP '2024-01-30 20:00:00' - INTERVAL 7 HOUR AND max(ts) >= TIMESTAMP '2024-01-30 20:00:00' - INTERVAL 60 HOUR""")
def silent_sources(spark, sf):
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    as_of = F.expr("timestamp'2024-01-30 20:00:00'")
    silent = (F.col("last") < as_of - F.expr("interval 7 hours")) & (F.col("last") >= as_of - F.expr("interval 60 hours"))
    return last.where(silent).select("user_id", F.date_format("last", "yyyy-MM-dd").alias("last_day"))


@query("A15", """WITH r AS (SELECT user_id, event_type = 'error' AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
    SELECT user_id, coalesce(min(n) FILTER (NOT f) - 1, count(*)) AS streak FROM r GROUP BY 1""")
def failure_streaks(spark, sf):
    return R.streak(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], F.col("event_type") == "error")


@query("A16", """WITH c AS (SELECT lang, count(*) FILTER (quality = 1 AND p) AS tp, count(*) FILTER (quality = 0 AND p) AS fp, count(*) FILTER (quality = 1 AND NOT p) AS fn
      FROM (SELECT d.lang, l.quality, d.n_chars > 1000 AS p FROM documents d JOIN labels l USING (doc_id)) GROUP BY 1)
    SELECT lang, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS "precision", round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
    round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c""")
def prf_by_label(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    out = R.precision_recall(rows, F.col("quality") == 1, F.col("n_chars") > 1000, "lang")
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("A19 N16", """SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, max(user_id) AS top_user FROM events GROUP BY 1""")
def run_counters(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.max("user_id").alias("top_user"))


@query("A21 A22 K4", """SELECT conv_id, count(*) AS n_turns, string_agg(role, '>' ORDER BY turn, role) AS roles, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1""")
def nested_payload_counts(spark, sf):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("n"))))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    chars = F.aggregate("t", F.lit(0).cast("long"), lambda a, t: a + t["n"])
    return rows.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join("t.role", ">").alias("roles"), chars.alias("chars"))


@query("W1", """SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source, lower(substr(text, 1, 80)) ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n = 1""")
def first_per_title(spark, sf):
    rows = table(spark, sf, "documents").withColumn("head", F.lower(F.substring("text", 1, 80)))
    return R.first_per_key(rows, ["source", "head"], [F.desc("n_chars"), F.col("doc_id")]).select("source", "doc_id")


@query("W2 W3", """SELECT c_mktsegment, c_custkey, n AS place FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n <= 50""")
def quota_per_partition(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf, "customer").withColumn("place", F.row_number().over(w).cast("long")).where("place <= 50").select("c_mktsegment", "c_custkey", "place")


@query("W4", """SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS round FROM documents""")
def round_robin_interleave(spark, sf):
    rows = R.interleaved(table(spark, sf, "documents"), "lang", [F.desc("n_chars"), F.col("doc_id")])
    return rows.select("doc_id", "lang", F.col("round").cast("long").alias("round"))


@query("W5", """WITH g AS (SELECT *, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER w <= 14400 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
    SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM s GROUP BY 1, 2""")
def gap_sessions(spark, sf):
    rows = R.gap_sessions(table(spark, sf, "events").withColumn("t", F.unix_micros("ts") / 1e6), ["user_id"], F.col("t"), 14400, "event_id")
    return rows.groupBy("user_id", F.col("session").cast("long").alias("session")).agg(F.count("*").alias("n"), R.listed("event_type", ",").alias("kinds"))


@query("W6", """WITH g AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM g)
    SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS n, min(event_id) AS first_id FROM s GROUP BY 1, 2, 3""")
def run_length_merge(spark, sf):
    rows = R.runs(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return rows.groupBy("user_id", F.col("run").cast("long").alias("run"), "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("W7", """SELECT user_id, event_id FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type""")
def consecutive_duplicate_drop(spark, sf):
    return R.without_repeats(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id")


@query("W10", """SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 2) AS delta FROM events""")
def previous_value_compare(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("event_id", "event_type", F.lag("event_type").over(w).alias("previous"), F.round(F.col("value") - F.lag("value").over(w), 2).alias("delta"))


@query("W11", """WITH s AS (SELECT doc_id % 200 AS k, doc_id, substr(text, 1, 60) || doc_id AS title FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY title) AS n FROM s)
    SELECT doc_id, CASE WHEN n = 1 THEN CAST(k AS VARCHAR) ELSE k || '~' || substr(sha1(title), 1, 6) END AS unique_id FROM r""")
def collision_disambiguate(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 200).alias("k"), F.concat(F.substring("text", 1, 60), F.col("doc_id").cast("string")).alias("title"))
    return R.disambiguated(rows, "k", "title", "unique_id").select("doc_id", "unique_id")


@query("W12", """SELECT o_orderkey, o_custkey || ':' || strftime(o_orderdate, '%Y') || ':' || row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS id FROM orders""")
def ordinal_in_key(spark, sf):
    from pyspark.sql import Window

    rows = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    n = F.row_number().over(Window.partitionBy("o_custkey", "y").orderBy("o_orderdate", "o_orderkey"))
    return rows.select("o_orderkey", F.concat_ws(":", F.col("o_custkey").cast("string"), F.col("y").cast("string"), n.cast("string")).alias("id"))


@query("W13", """SELECT event_id, strftime(max(tick), '%Y-%m-%d %H:%M') AS last_tick FROM (SELECT event_id, ts, unnest(generate_series(date_trunc('hour', ts) - INTERVAL 24 HOUR, date_trunc('hour', ts), INTERVAL 1 HOUR)) AS tick FROM events)
    WHERE hour(tick) IN (6, 18) AND tick <= ts GROUP BY 1""")
def last_scheduled_tick(spark, sf):
    hour = F.date_trunc("hour", "ts")
    ticks = F.sequence(hour - F.expr("interval 24 hours"), hour, F.expr("interval 1 hour"))
    good = F.filter(ticks, lambda t: F.hour(t).isin(6, 18) & (t <= F.col("ts")))
    return table(spark, sf, "events").select("event_id", F.date_format(F.array_max(good), "yyyy-MM-dd HH:mm").alias("last_tick"))


@query("O1 O2 O4 P18", """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""")
def top_by_price(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("O5", "SELECT lang, least(count(*), 25) AS n FROM documents GROUP BY 1")
def stratified_sample(spark, sf):
    rows = R.stratified_sample(table(spark, sf, "documents"), F.col("lang"), 25, "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("n"))


@query("O6", None)
def seeded_split(spark, sf):
    return table(spark, sf, "documents").groupBy(R.split_side("doc_id").alias("side")).agg(F.count("*").alias("n"))


@query("U2", "SELECT DISTINCT source, lang FROM documents")
def distinct_catalogue(spark, sf):
    return table(spark, sf, "documents").select("source", "lang").distinct()


@query("U4 X17", """WITH a AS (SELECT DISTINCT user_id FROM events WHERE ts < TIMESTAMP '2024-01-02'), b AS (SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-29')
    SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 'new' ELSE 'gone' END AS state FROM a FULL JOIN b ON a.user_id = b.user_id WHERE a.user_id IS NULL OR b.user_id IS NULL""")
def symmetric_difference(spark, sf):
    events = table(spark, sf, "events")
    return R.difference(events.where("ts < timestamp'2024-01-02'"), events.where("ts >= timestamp'2024-01-29'"), "user_id")


@query("U5 C15", """WITH l AS (SELECT doc_id % 500 AS k, text, 1 AS here FROM documents WHERE doc_id % 2 = 0), r AS (SELECT doc_id % 500 AS k, text, 0 AS here FROM documents WHERE doc_id % 2 = 1 OR doc_id % 3 = 0),
    u AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY length(coalesce(text, '')) DESC, here DESC, text) AS n FROM (SELECT * FROM l UNION ALL SELECT * FROM r))
    SELECT k, sha1(text) AS digest FROM u WHERE n = 1""")
def merge_keep_longest(spark, sf):
    rows = table(spark, sf, "documents").select((F.col("doc_id") % 500).alias("k"), "text", "doc_id")
    local, remote = rows.where("doc_id % 2 = 0").drop("doc_id"), rows.where("doc_id % 2 = 1 or doc_id % 3 = 0").drop("doc_id")
    return R.merged_longest(local, remote, ["k"], "text").select("k", F.sha1("text").alias("digest"))


@query("U6", """SELECT conv_id, string_agg(role, ',' ORDER BY first_turn, role) AS roles FROM (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY 1, 2) GROUP BY 1""")
def ordered_dedup(spark, sf):
    first = table(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("t"))
    return first.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("t", "role")))["role"], ",").alias("roles"))


@query("U7 F27", """SELECT v AS value, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) AS holders FROM (SELECT s_suppkey, unnest([s_nationkey, s_suppkey % 7]) AS v FROM supplier) GROUP BY 1""")
def inverse_multimap(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", F.array(F.col("s_nationkey").cast("long"), F.col("s_suppkey") % 7).alias("vs"))
    doubled = rows.select(F.explode("vs").alias("value"), "s_suppkey").groupBy("value").agg(F.array_sort(F.collect_list("s_suppkey")).alias("h"))
    return doubled.select("value", F.array_join(F.transform("h", lambda x: x.cast("string")), ",").alias("holders"))


@query("N1", """WITH k AS (SELECT p_name, min(p_partkey) AS part FROM part GROUP BY 1)
    SELECT e.event_id, coalesce(CAST(k.part AS VARCHAR), 'new/' || substr(md5(e.event_type || e.user_id), 1, 12)) AS id FROM events e LEFT JOIN k ON k.p_name = (CASE WHEN e.user_id % 2 = 0 THEN 'small ring' ELSE 'no such' END)""")
def enrich_or_create(spark, sf):
    known = table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("part"))
    events = table(spark, sf, "events").withColumn("p_name", F.when(F.col("user_id") % 2 == 0, "small ring").otherwise("no such"))
    made = F.concat(F.lit("new/"), F.substring(F.md5(F.concat("event_type", F.col("user_id").cast("string"))), 1, 12))
    return events.join(known, "p_name", "left").select("event_id", F.coalesce(F.col("part").cast("string"), made).alias("id"))


@query("N3", """SELECT o_custkey, o_orderkey, list_extract(['z', 'y', 'x', 'w'], (4 - n + 1)::INT) AS supplement FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 4
    UNION ALL SELECT o_custkey, o_orderkey, NULL FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n > 4""")
def positional_alignment(spark, sf):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    names = F.array(*map(F.lit, "zyxw"))
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", n.alias("n"))
    return rows.select("o_custkey", "o_orderkey", F.when(F.col("n") <= 4, F.get(names, 4 - F.col("n"))).alias("supplement"))


@query("N6", """SELECT event_id FROM events WHERE TIMESTAMP '2024-01-15 12:00:00' BETWEEN ts - INTERVAL 15 MINUTE AND ts + INTERVAL 2 HOUR AND event_type <> 'error'""")
def active_now(spark, sf):
    now = F.expr("timestamp'2024-01-15 12:00:00'")
    return table(spark, sf, "events").where((now >= F.col("ts") - F.expr("interval 15 minutes")) & (now <= F.col("ts") + F.expr("interval 2 hours")) & (F.col("event_type") != "error")).select("event_id")


@query("N2 N7 N8 N10", """SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(d.lang, 'und') AS lang FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL OR d.n_chars < 0.5 * 2000""")
def completeness_overlay(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = docs.join(labels.withColumn("known", F.lit(True)), "doc_id", "left").where("known is null or n_chars < 1000")
    return rows.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("lang", F.lit("und")).alias("lang"))


@query("N12", """SELECT source, lang, max_by(doc_id, (length(text), -doc_id)) AS doc_id FROM documents GROUP BY 1, 2""")
def longest_text_pick(spark, sf):
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.max_by("doc_id", F.struct(F.length("text"), -F.col("doc_id"))).alias("doc_id"))


@query("N18 K4", """SELECT c_custkey, count(o_orderkey) AS n, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey), '') AS upcoming FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate BETWEEN TIMESTAMP '1998-06-15' AND TIMESTAMP '1998-07-15' GROUP BY 1""")
def upcoming_with_children(spark, sf):
    from quillwork.sources.publish import nested

    soon = table(spark, sf, "orders").where("o_orderdate between timestamp'1998-06-15' and timestamp'1998-07-15'")
    soon = soon.select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey")
    rows = nested(table(spark, sf, "customer").select("c_custkey"), {"upcoming": (soon, ["o_orderdate", "o_orderkey"])}, ["c_custkey"])
    ids = F.transform("upcoming", lambda u: u["o_orderkey"].cast("string"))
    return rows.select("c_custkey", F.size("upcoming").cast("long").alias("n"), F.array_join(ids, ",").alias("upcoming"))


@query("N9", """SELECT doc_id FROM documents WHERE NOT (trim(substr(text, 1, 40)) = '' OR regexp_matches(lower(substr(text, 1, 40)), '[bcdfghjklmnpqrstvwxyz]{5}')) OR source = 'src0'""")
def catalogue_cleanup(spark, sf):
    head = F.lower(F.substring("text", 1, 40))
    junk = (F.trim(head) == "") | head.rlike("[bcdfghjklmnpqrstvwxyz]{5}")
    return table(spark, sf, "documents").where(~junk | (F.col("source") == "src0")).select("doc_id")


@query("Y1 Y5 Y8", """SELECT doc_id, CASE WHEN lang = 'en' THEN 'kept' WHEN quality IS NULL THEN 'unevaluated' WHEN quality = 1 THEN 'kept' ELSE 'hidden' END AS state FROM documents LEFT JOIN labels USING (doc_id)""")
def relevance_gate(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    state = F.when(F.col("lang") == "en", "kept").when(F.col("quality").isNull(), "unevaluated").when(F.col("quality") == 1, "kept").otherwise("hidden")
    return rows.select("doc_id", state.alias("state"))


@query("Y2", """SELECT lang, min_by(doc_id, (-n_chars, doc_id)) AS principal, count(*) - 1 AS n_others FROM documents GROUP BY lang, source""")
def group_collapse(spark, sf):
    rows = table(spark, sf, "documents").groupBy("lang", "source").agg(F.min_by("doc_id", F.struct(-F.col("n_chars"), "doc_id")).alias("principal"), (F.count("*") - 1).alias("n_others"))
    return rows.select("lang", "principal", "n_others")


@query("Y3", """SELECT topic, doc_id, n AS place FROM (SELECT topic, doc_id, row_number() OVER (PARTITION BY topic ORDER BY n_chars DESC, doc_id) AS n FROM (SELECT doc_id, n_chars, unnest([lang, source]) AS topic FROM documents)) WHERE n <= 30""")
def multi_bucket_listing(spark, sf):
    from pyspark.sql import Window

    rows = table(spark, sf, "documents").select("doc_id", "n_chars", F.explode(F.array("lang", "source")).alias("topic"))
    w = Window.partitionBy("topic").orderBy(F.desc("n_chars"), "doc_id")
    return rows.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 30").select("topic", "doc_id", "place")


@query("Y6 Y7", """SELECT s.status, count(o.o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) s(status) LEFT JOIN orders o ON o.o_orderstatus = s.status GROUP BY 1""")
def stage_funnel(spark, sf):
    counts = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    stages = spark.createDataFrame([(s,) for s in "FOPX"], "status string")
    return stages.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@query("Y11", """SELECT c, topic, CAST(sum(w) AS BIGINT) AS weight FROM (SELECT o_custkey AS c, o_orderpriority AS topic, 2 AS w FROM orders UNION ALL SELECT user_id, event_type, 1 FROM events) WHERE topic <> 'error' GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY c ORDER BY sum(w) DESC, topic) <= 7""")
def weighted_interest_profile(spark, sf):
    from pyspark.sql import Window

    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("topic"), F.lit(2).alias("w"))
    b = table(spark, sf, "events").select(F.col("user_id").alias("c"), F.col("event_type").alias("topic"), F.lit(1).alias("w"))
    rows = a.unionByName(b).where("topic <> 'error'").groupBy("c", "topic").agg(F.sum("w").alias("weight"))
    w = Window.partitionBy("c").orderBy(F.desc("weight"), "topic")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n <= 7").drop("_n")


@query("Y13", """SELECT DISTINCT trim(f) AS facet FROM (SELECT unnest(string_split(replace(p_type || ';' || p_name, ' ', ';'), ';')) AS f FROM part) WHERE trim(f) <> ''""")
def split_field_facets(spark, sf):
    parts = F.split(F.concat("p_type", F.lit(";"), "p_name"), "[; ]")
    return table(spark, sf, "part").select(F.explode(parts).alias("f")).select(F.trim("f").alias("facet")).where("facet <> ''").distinct()


@query("Y14 N31", """SELECT event_id FROM events WHERE event_type = 'signup' AND event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)""")
def live_not_stored(spark, sf):
    stored = table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("event_id"))
    return table(spark, sf, "events").where("event_type = 'signup'").join(stored, "event_id", "left_anti").select("event_id")


@query("Y15", """SELECT s_nationkey, count(DISTINCT l_partkey) AS n FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1""")
def distinct_children(spark, sf):
    rows = table(spark, sf, "lineitem").join(R.small(table(spark, sf, "supplier")), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("s_nationkey").agg(F.count_distinct("l_partkey").alias("n"))


@query("P5 F1", """SELECT doc_id FROM documents WHERE contains(strip_accents(lower(text)), 'eauenai') OR contains(strip_accents(lower(text)), 'cion')""")
def accent_folded_search(spark, sf):
    body = fold("text")
    return table(spark, sf, "documents").where(F.contains(body, F.lit("eauenai")) | F.contains(body, F.lit("cion"))).select("doc_id")
