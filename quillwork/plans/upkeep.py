"""Queries over scanned pages, state kept between runs, people in media, and pluggable recognisers."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from quillwork.functions import text as X
from quillwork.functions import values
from quillwork.operators import cdc, judging, matching, pages, retrieval, upkeep
from quillwork.session import table
from quillwork.sources import connectors, publish
from quillwork.streaming import flows

from .registry import query

AS_OF = "2024-06-30"
COS = "list_cosine_similarity({}::DOUBLE[], {}::DOUBLE[])"


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


# pages

SLOPES = (-0.02, -0.01, 0.0, 0.01, 0.02)


def _skewed(spark, sf):
    """Words of invented pages: a line's words lie 100 apart and fall by a hundredth on every third page."""
    slope = F.when(F.col("l_orderkey") % 3 == 0, 0.01).otherwise(0.0)
    x = F.col("l_linenumber") * 100.0
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("page"), "l_linenumber", x.alias("x"), (F.col("l_suppkey") % 3 * 12.0 + slope * x).alias("y"), F.col("l_returnflag").alias("text")
    )


@query("N21", """WITH w AS (SELECT l_orderkey AS page, l_linenumber * 100.0::DOUBLE AS x, (l_suppkey % 3) * 12.0::DOUBLE + CASE WHEN l_orderkey % 3 = 0 THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END * (l_linenumber * 100.0::DOUBLE) AS y FROM lineitem),
    t AS (SELECT page, s AS slope, y - s * x AS v FROM w, (VALUES (-0.02::DOUBLE), (-0.01::DOUBLE), (0.0::DOUBLE), (0.01::DOUBLE), (0.02::DOUBLE)) q(s)),
    n AS (SELECT page, slope, sum(CASE WHEN d <= 2.5 THEN 0 ELSE 1 END) AS lines FROM (SELECT page, slope, v - lag(v) OVER (PARTITION BY page, slope ORDER BY v) AS d FROM t) GROUP BY 1, 2)
    SELECT page, slope, CAST(lines AS BIGINT) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY lines, abs(slope), slope) AS r FROM n) WHERE r = 1""")
def page_skew(spark, sf):
    return pages.skew(_skewed(spark, sf), "page", SLOPES)


@query("N22 S13", """WITH w AS (SELECT DISTINCT l_orderkey AS page, l_linenumber, l_quantity * 4 AS x FROM lineitem), c AS (SELECT DISTINCT l_orderkey AS page, floor(l_extendedprice / 1000) * 25 AS "column" FROM lineitem),
    m AS (SELECT w.page, l_linenumber, "column", row_number() OVER (PARTITION BY w.page, l_linenumber, x ORDER BY abs(x - "column") NULLS LAST, "column") AS r FROM w LEFT JOIN c ON c.page = w.page AND abs(x - "column") <= 30)
    SELECT page, l_linenumber, "column" FROM m WHERE r = 1""")
def nearest_columns(spark, sf):
    rows = table(spark, sf, "lineitem")
    words = rows.select(F.col("l_orderkey").alias("page"), "l_linenumber", (F.col("l_quantity") * 4).alias("x")).distinct()
    columns = rows.select(F.col("l_orderkey").alias("page"), (F.floor(F.col("l_extendedprice") / 1000) * 25).cast("double").alias("column")).distinct()
    return pages.nearest_column(words, columns, "page", 30.0).select("page", "l_linenumber", "column")


@query("N22", """WITH RECURSIVE l AS (SELECT l_orderkey AS page, l_linenumber AS k, l_quantity * 1.0::DOUBLE AS x, fmod(l_extendedprice::DOUBLE, 50.0) AS z FROM lineitem),
    p AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY distance, a, b) AS n FROM (SELECT DISTINCT n.page, n.k AS a, m.k AS b, abs(n.x - m.z) AS distance FROM l n JOIN l m USING (page) WHERE abs(n.x - m.z) <= 6)),
    r AS (SELECT page, n, a, b, distance, true AS made, [a] AS left_used, [b] AS right_used FROM p WHERE n = 1
      UNION ALL SELECT page, n, a, b, distance, ok, CASE WHEN ok THEN list_append(left_used, a) ELSE left_used END, CASE WHEN ok THEN list_append(right_used, b) ELSE right_used END
      FROM (SELECT p.*, r.left_used, r.right_used, NOT list_contains(r.left_used, p.a) AND NOT list_contains(r.right_used, p.b) AS ok FROM r JOIN p ON p.page = r.page AND p.n = r.n + 1))
    SELECT page, a, b, distance FROM r WHERE made""")
def greedy_pairs(spark, sf):
    """Names and marks of a page paired by height, nearest first."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("k"), "l_quantity", "l_extendedprice")
    names = rows.select("page", "k", (F.col("l_quantity") * 1.0).alias("y"))
    marks = rows.select("page", "k", F.pmod(F.col("l_extendedprice"), F.lit(50.0)).alias("y"))
    return pages.paired(names, marks, "page", "k", "y", 6.0)


@query("S14", """WITH b AS (SELECT p_partkey, replace(p_name, ' ', '  ') || CASE WHEN p_partkey % 2 = 0 THEN 'SI' ELSE ' NO' END AS said FROM part), f AS (SELECT p_partkey, regexp_replace(trim(regexp_replace(regexp_replace(said, '([a-zA-Z]{4})(SI|NO|ABST)\\s*$', '\\1 \\2'), '\\s+', ' ', 'g')), '\\s+$', '') AS t FROM b),
    w AS (SELECT p_partkey, t, unnest(string_split(t, ' ')) AS word, generate_subscripts(string_split(t, ' '), 1) - 1 AS position FROM f)
    SELECT p_partkey, CAST(position AS INT) AS position, word, round(CASE WHEN position > 0 AND position = len(string_split(t, ' ')) - 1 AND word IN ('SI', 'NO', 'ABST') THEN 10 + length(t) * 5 - 5.0 * length(word)
      ELSE 10 + 5.0 * (length(array_to_string(string_split(t, ' ')[1:position], ' ')) + CASE WHEN position > 0 THEN 1 ELSE 0 END) END, 6) AS x FROM w""")
def words_of_boxes(spark, sf):
    boxes = table(spark, sf, "part").withColumn("text", F.concat(F.replace("p_name", F.lit(" "), F.lit("  ")), F.when(F.col("p_partkey") % 2 == 0, "SI").otherwise(" NO")))
    plain = F.trim(F.regexp_replace(F.regexp_replace("text", r"(?<=\p{L}{4})(SI|NO|ABST)\s*$", " $1"), r"\s+", " "))
    boxes = boxes.select("p_partkey", F.lit(10.0).alias("x0"), (10 + F.length(plain) * 5.0).alias("x1"), "text")
    return pages.box_words(boxes, ["p_partkey"]).withColumn("x", F.round("x", 6))


@query("S13", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'voting' ELSE 'attendance' END AS kind, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) END AS day,
    CASE WHEN o_orderkey % 3 > 0 THEN CAST((o_orderkey % 12) * 60 + o_orderkey % 60 + CASE WHEN o_orderkey % 2 = 0 THEN 720 ELSE 0 END AS INT) END AS minute FROM orders""")
def page_headers(spark, sf):
    rows = table(spark, sf, "orders")
    clock = F.concat((F.when(F.col("o_orderkey") % 12 == 0, 12).otherwise(F.col("o_orderkey") % 12)).cast("string"), F.lit(":"), F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0"))
    kind = F.when(F.col("o_orderkey") % 3 == 0, "NOTE").when(F.col("o_orderkey") % 3 == 1, "VOTING").otherwise("Attendance of")
    line = F.concat_ws(" ", kind, F.lit("session,"), F.date_format("o_orderdate", "d/M/yyyy"), F.lit("at"), clock, F.when(F.col("o_orderkey") % 2 == 0, "PM").otherwise("a.m."))
    return rows.select("o_orderkey", pages.header(line).alias("h")).select("o_orderkey", "h.kind", "h.day", "h.minute")


@query("S13 C6", """WITH v AS (SELECT l_orderkey, l_linenumber, l_returnflag AS truth, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
    SELECT l_orderkey, CAST(r AS INT) AS voter, CASE WHEN l_orderkey % 7 = 0 AND r <= 2 AND n > 1 THEN '?' ELSE truth END AS vote FROM v""")
def repaired_votes(spark, sf):
    """One misread vote is set right by the totals; two on one roll call stay."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    truth = table(spark, sf, "lineitem").select("l_orderkey", place.alias("voter"), F.col("l_returnflag").alias("vote"))
    totals = truth.groupBy("l_orderkey", "vote").agg(F.count("*").alias("n"))
    bad = ((F.col("l_orderkey") % 5 == 0) & (F.col("voter") == 1)) | ((F.col("l_orderkey") % 7 == 0) & (F.col("voter") <= 2))
    read = truth.withColumn("unsure", bad).withColumn("vote", F.when(bad, "?").otherwise(F.col("vote")))
    return pages.repaired(read, totals, "l_orderkey", "vote", "unsure").select("l_orderkey", "voter", "vote")


@query("N23", """WITH v AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey END AS member FROM lineitem), k AS (SELECT l_orderkey FROM v GROUP BY 1 HAVING 2 * count(member) >= count(*))
    SELECT l_orderkey, l_linenumber, member FROM v WHERE member IS NOT NULL AND l_orderkey IN (SELECT l_orderkey FROM k)""")
def majority_resolved_votes(spark, sf):
    member = F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey"))
    return pages.majority_resolved(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", member.alias("member")), "l_orderkey", "member")


# state kept between runs


@query("C7", f"""WITH s AS (SELECT o_orderkey, o_orderstatus AS now, CASE WHEN o_orderkey % 6 = 1 THEN 'X' ELSE o_orderstatus END AS was, CASE WHEN o_orderkey % 6 <> 2 THEN o_orderdate END AS fetched_at FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'new' WHEN now <> was THEN 'changed' WHEN fetched_at IS NULL THEN 'never' WHEN fetched_at < TIMESTAMP '{AS_OF}' - INTERVAL 400 DAY THEN 'old' ELSE 'forced' END AS reason
    FROM s WHERE o_orderkey % 6 <= 2 OR fetched_at < TIMESTAMP '{AS_OF}' - INTERVAL 400 DAY OR o_orderkey % 11 = 0""")
def refetch_set(spark, sf):
    rows = table(spark, sf, "orders")
    fetched = F.when(F.col("o_orderkey") % 6 != 2, F.col("o_orderdate")).alias("fetched_at")
    stored = rows.where("o_orderkey % 6 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 6 == 1, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), fetched)
    return upkeep.to_refetch(rows, stored, "o_orderkey", ["o_orderstatus"], _as_of(), 400, F.col("o_orderkey") % 11 == 0)


@query("X13", f"""WITH l AS (SELECT event_id, event_id % 7 AS tries, ts, event_id % 5 = 0 AS done, event_id % 3 > 0 AS known FROM events)
    SELECT event_id FROM l WHERE NOT known OR (NOT done AND tries < 5 AND epoch(ts) + 86400 * 30 * power(2.0, tries - 1) <= epoch(TIMESTAMP '{AS_OF}'))""")
def due_work(spark, sf):
    rows = table(spark, sf, "events")
    ledger = rows.where("event_id % 3 > 0").select("event_id", (F.col("event_id") % 7).alias("tries"), F.col("ts").alias("tried_at"), (F.col("event_id") % 5 == 0).alias("done"))
    return upkeep.due(rows.select("event_id"), ledger, "event_id", _as_of(), 5, 86400 * 30)


@query("X13", """SELECT event_id, CAST(CASE WHEN event_id % 3 > 0 THEN event_id % 7 ELSE 0 END + CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS tries, (event_id % 3 > 0 AND event_id % 5 = 0) OR (event_id % 4 = 0 AND event_id % 8 = 0) AS done
    FROM events WHERE event_id % 3 > 0 OR event_id % 4 = 0""")
def next_ledger(spark, sf):
    rows = table(spark, sf, "events")
    ledger = rows.where("event_id % 3 > 0").select("event_id", (F.col("event_id") % 7).alias("tries"), F.col("ts").alias("tried_at"), (F.col("event_id") % 5 == 0).alias("done"))
    outcomes = rows.where("event_id % 4 = 0").select("event_id", (F.col("event_id") % 8 == 0).alias("ok"))
    return upkeep.ledgered(ledger, outcomes, "event_id", _as_of()).select("event_id", "tries", "done")


@query("N13", "SELECT event_id FROM events WHERE event_id % 4 = 0 UNION SELECT event_id FROM events WHERE event_id % 3 = 0 AND event_id % 5 > 0")
def seen_if_sent(spark, sf):
    rows = table(spark, sf, "events").select("event_id")
    delivered = rows.select("event_id", (F.col("event_id") % 5 > 0).alias("ok"))
    return upkeep.seen_after(rows.where("event_id % 4 = 0"), rows.where("event_id % 3 = 0"), delivered, "event_id")


@query("X14 S7", """SELECT event_id FROM (SELECT event_id, epoch(max(ts) OVER ()) - epoch(ts) AS age, event_id % 3 > 0 AS ok FROM events) WHERE age < CASE WHEN ok THEN 864000 ELSE 86400 END""")
def cache_entries(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.col("ts").alias("at"), (F.col("event_id") % 3 > 0).alias("ok"))
    last = rows.agg(F.max("at").alias("last"))
    return upkeep.cached(rows.crossJoin(F.broadcast(last)), F.col("last"), 864000, 86400).select("event_id")  # one row


@query("C14 S7", """WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 4 = 0 THEN 'new' ELSE 'old' END AS body, max(ts) OVER () AS last FROM events),
    k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM e WHERE body IS NOT NULL AND ts >= last - INTERVAL 45 DAY)
    SELECT user_id, event_id, body FROM k WHERE r <= 20""")
def inbox_state(spark, sf):
    """Entries of users' inboxes after changes: every fourth is rewritten, every tenth taken out, forty-five days are kept."""
    rows = table(spark, sf, "events").select("user_id", "event_id", "ts")
    last = rows.agg(F.max("ts").alias("last"))
    state = rows.withColumn("body", F.lit("old"))
    changes = rows.where("event_id % 4 = 0 or event_id % 10 = 0").withColumn("body", F.when(F.col("event_id") % 10 != 0, "new"))
    both = [df.crossJoin(F.broadcast(last)) for df in (state, changes)]  # one row
    return upkeep.inbox(*both, "user_id", "event_id", "ts", F.col("last"), 45, 20).select("user_id", "event_id", "body")


@query("C14 S7 K4", """SELECT c_nationkey, '[' || string_agg('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}', ',' ORDER BY c_custkey) || ']' AS document FROM customer GROUP BY 1""")
def state_documents(spark, sf):
    rows = table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_name")
    return upkeep.as_documents(rows, "c_nationkey", [F.col("c_custkey")])


@query("V6 V7", """SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'insert' WHEN doc_id % 5 = 0 THEN 'update' WHEN doc_id % 4 = 0 THEN 'model' ELSE 'same' END AS change, doc_id % 9 = 0 OR doc_id % 5 = 0 OR doc_id % 4 = 0 AS embedded FROM documents""")
def refreshed_index(spark, sf):
    """An index after its model changed for some rows: only what must be is embedded again (64 numbers instead of 1)."""
    items = table(spark, sf, "documents").select("doc_id", X.content_id("text").alias("hash"), "text")  # as many characters as are embedded
    held = items.where("doc_id % 9 <> 0").select(
        "doc_id", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("hash")).alias("hash"), F.when(F.col("doc_id") % 4 == 0, "v1").otherwise("v2").alias("model"), F.array(F.lit(1.0)).alias("vector")
    )
    out = upkeep.index_refreshed(held, items, "doc_id", "v2", retrieval.hashed_vector)
    return out.select("doc_id", "change", (F.size("vector") > 1).alias("embedded"))


@query("V8", f"""WITH a AS (SELECT vec_id AS alert, label AS client, 'a' || vec_id AS title, vec_id // 4 AS day, embedding FROM embeddings WHERE vec_id % 3 = 0), i AS (SELECT vec_id, vec_id // 4 AS day, embedding FROM embeddings WHERE vec_id % 3 = 1)
    SELECT vec_id, client, alert, title FROM (SELECT i.vec_id, client, alert, title, row_number() OVER (PARTITION BY i.vec_id, client ORDER BY a.day, alert) AS r FROM i JOIN a ON a.day <= i.day AND a.day >= i.day - 30
      AND {COS.format('i.embedding', 'a.embedding')} >= 0.2) WHERE r = 1""")
def alerted_before(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("day", F.floor(F.col("vec_id") / 4))
    alerts = rows.where("vec_id % 3 = 0").select(F.col("vec_id").alias("alert"), F.col("label").alias("client"), F.concat(F.lit("a"), F.col("vec_id").cast("string")).alias("title"), "day", "embedding")
    return upkeep.already_alerted(rows.where("vec_id % 3 = 1"), alerts, "vec_id", "client", "day", "embedding", 0.2)


@query("N5", "SELECT doc_id, CASE WHEN lang = 'en' AND doc_id % 3 = 0 THEN CAST(length(text) AS VARCHAR) END AS extra FROM documents")
def gated_enrichment(spark, sf):
    """The expensive step fails if a row meets it that the gate should have kept back."""

    def measure(text: str) -> str:
        head, _, body = text.partition("|")
        if head != "en":
            raise ValueError("a row passed the gate")
        return str(len(body))

    rows = table(spark, sf, "documents").select("doc_id", "lang", F.concat_ws("|", "lang", "text").alias("said"))
    return upkeep.gated(rows, (F.col("lang") == "en") & (F.col("doc_id") % 3 == 0), "said", measure).select("doc_id", "extra")


@query("N24", """WITH h AS (SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the ') AND turn % 2 = 0), w AS (SELECT conv_id, t AS turn, bool_or(t = turn) AS hit FROM (SELECT conv_id, turn, unnest(generate_series(turn - 1, turn + 1)) AS t FROM h) GROUP BY 1, 2)
    SELECT c.conv_id, c.turn, c.text, hit FROM conversations c JOIN w ON w.conv_id = c.conv_id AND w.turn = c.turn""")
def turns_in_context(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    hits = rows.where(F.contains(F.lower("text"), F.lit("the ")) & (F.col("turn") % 2 == 0))
    return upkeep.with_context(hits, rows, "conv_id", "turn")


@query("N20 C6", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'again' WHEN doc_id % 4 = 0 THEN 'by hand' END AS speaker FROM documents")
def reparse_keeps_gains(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id")
    parsed = rows.withColumn("speaker", F.when(F.col("doc_id") % 3 == 0, "again"))
    before = rows.where("doc_id % 2 = 0").withColumn("speaker", F.when(F.col("doc_id") % 4 == 0, "by hand"))
    return cdc.regained(parsed, before, ["doc_id"], "speaker")


@query("X15", "SELECT * FROM (VALUES ('kept', 2, 'RuntimeError: no source'), ('made', 1, 'ok')) t(section, version, state)")
def sections_keep_last_version(spark, sf):
    """Two sections are made; then one fails, keeps its last version and is reported."""
    root = f"{retrieval.shared_folder(spark)}/sections-{uuid.uuid4().hex}"

    def failing():
        raise RuntimeError("no source")

    def write(name, df):
        publish.publish(df, f"{root}/{name}", publish.version(spark, f"{root}/{name}"))

    some = lambda: table(spark, sf, "region")
    for _ in range(2):
        flows.materialised(spark, {"kept": some}, write)
    states = flows.materialised(spark, {"kept": failing, "made": some}, write)
    found = [(name, publish.version(spark, f"{root}/{name}"), state) for name, state in states.items()]
    assert publish.read_published(spark, f"{root}/kept").count() == some().count()
    return spark.createDataFrame(found, "section string, version int, state string")


@query("K9", "SELECT count(*) AS sent, true AS bounded FROM events")
def delivered_rows(spark, sf):
    """Rows handed over in bounded lists, counted by the receiver."""
    sent, over = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def send(rows):
        sent.add(len(rows))
        over.add(len(rows) > 200)

    publish.delivering(send, 200)(table(spark, sf, "events").select("event_id"), 0)
    return spark.createDataFrame([(sent.value, over.value == 0)], "sent long, bounded boolean")


# people, titles, texts

PEOPLE = (("p1", "PE", "milagros del carmen", "jauregui"), ("p2", "PE", "jose", "yarrow"), ("p3", "PE", "ana maria", "torres"), ("p4", "PE", "luis", "torres"), ("p5", "EC", "rosa", "yarrow"))
SAID = (
    "la congresista yarrow pidio la palabra", "hablo milagros jauregui ante el pleno", "torres y yarrow se reunieron", "el senador torres voto en contra", "luis alberto torres presento el texto",
    "carmen de la cruz jauregui no asistio", "diputada jauregui", "jose de los santos yarrow", "milagros en lima y jauregui en cusco", "la legisladora rosa yarrow",
)
ROLES = "congresista|senadora?|diputad[oa]|legislador[a]?"


@query("T12", f"""WITH p(id, country, given, surname) AS (VALUES {', '.join(map(str, PEOPLE))}), s(n, said) AS (VALUES {', '.join(str(x) for x in enumerate(SAID))}), n AS (SELECT event_id, said, CASE WHEN event_id % 4 = 0 THEN 'EC' ELSE 'PE' END AS country FROM events JOIN s ON s.n = event_id % 10),
    q AS (SELECT id, country, surname, array_to_string(list_filter(string_split(given, ' '), lambda w: length(w) >= 4), '|') || CASE WHEN count(*) OVER (PARTITION BY country, surname) = 1 THEN '|{ROLES}' ELSE '' END AS who FROM p)
    SELECT event_id, id FROM n JOIN q ON n.country = q.country AND regexp_matches(said, '(^|\\W)(' || who || ')\\s+(\\w+\\s+){{0,2}}?' || surname || '(\\W|$)')""")
def named_in_media(spark, sf):
    people = spark.createDataFrame(PEOPLE, "id string, country string, given string, surname string")
    said = F.array(*map(F.lit, SAID))[(F.col("event_id") % 10).cast("int")]
    news = table(spark, sf, "events").select("event_id", said.alias("said"), F.when(F.col("event_id") % 4 == 0, "EC").otherwise("PE").alias("country"))
    return matching.named_in_media(news, people, "event_id", "said", "id", "given", "surname", "country", ROLES)


@query("T10", """WITH s AS (SELECT s_suppkey, list_distinct(string_split('great ' || lower(regexp_replace(n_name, '[^A-Za-z0-9]+', ' ', 'g')) || ' ' || lower(r_name), ' ')) AS w FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
    m AS (SELECT n_nationkey, list_distinct(string_split(lower(regexp_replace(n_name, '[^A-Za-z0-9]+', ' ', 'g')) || ' ' || lower(r_name), ' ')) AS w FROM nation JOIN region ON r_regionkey = n_regionkey),
    c AS (SELECT s_suppkey, n_nationkey, len(list_filter(list_intersect(s.w, m.w), lambda x: x <> '')) AS n FROM s, m)
    SELECT s_suppkey, n_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY n DESC, n_nationkey) AS r FROM c WHERE n >= 2) WHERE r = 1""")
def best_overlap_names(spark, sf):
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nations = nations.select("n_nationkey", F.concat_ws(" ", "n_name", "r_name").alias("name"))
    said = table(spark, sf, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat(F.lit("Great "), F.col("name")).alias("spoken"))
    return matching.best_overlap(said, nations, "s_suppkey", "spoken", "n_nationkey", "name")


@query("V13", """WITH t AS (SELECT item_id, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: length(w) >= 2) AS w FROM benchmark),
    e AS (SELECT item_id, unnest(w) AS token FROM t), f AS (SELECT item_id, token, count(*) AS tf FROM e GROUP BY 1, 2), d AS (SELECT token, ln((1.0 + (SELECT count(*) FROM t)) / (1 + count(*))) + 1 AS idf FROM f GROUP BY 1),
    v AS (SELECT item_id, token, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY item_id)) AS x FROM f JOIN d USING (token))
    SELECT a.item_id AS a, b.item_id AS b, round(sum(a.x * b.x), 6) AS score FROM v a JOIN v b ON a.token = b.token AND a.item_id < b.item_id GROUP BY 1, 2 HAVING sum(a.x * b.x) >= 0.05""")
def tfidf_pairs(spark, sf):
    plain = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    rows = table(spark, sf, "benchmark").select("item_id", F.filter(F.split(plain, " "), lambda w: F.length(w) >= 2).alias("w"))
    return retrieval.similar_by_tfidf(retrieval.tfidf(rows, "item_id", "w"), "item_id", 0.05).withColumn("score", F.round("score", 6))


@query("T7 T14", """WITH b AS (SELECT p_partkey, list_distinct(list_filter(string_split(lower(p_name || ' ' || p_type), ' '), lambda w: length(w) >= 5)) AS w FROM part WHERE p_partkey % 40 = 0), m AS (SELECT p_partkey AS motion, string_split(lower('vote on the project ' || p_name || ' ' || p_type || ' in second debate'), ' ') AS w FROM part WHERE p_partkey % 8 = 0)
    SELECT motion, p_partkey FROM m, b WHERE len(b.w) > 0 AND len(list_filter(b.w, lambda x: list_contains(m.w, x))) >= greatest(2, ceil(0.7 * len(b.w)))""")
def motions_of_bills(spark, sf):
    """Motions and the bills of which they say most of the distinctive words after "project"."""
    rows = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("title"))
    motions = rows.where("p_partkey % 8 = 0").select(F.col("p_partkey").alias("motion"), F.concat(F.lit("Vote on the project "), F.col("title"), F.lit(" in second debate")).alias("said"))
    return matching.motions(motions, rows.where("p_partkey % 40 = 0"), "motion", "said", "p_partkey", "title", after="project")


@query("F25 F19 F15", """SELECT c_custkey, array_to_string(CASE WHEN c_mktsegment IN ('BUILDING', 'all') THEN ['BUILDING', 'all'] ELSE [c_mktsegment, 'BUILDING', 'all'] END, ',') AS held, -(CAST('0x' || substr(md5(c_name), 1, 12) AS BIGINT)) - 1 AS made_id,
    substr(c_name, greatest(1, strpos(c_name, '#') - 4), strpos(c_name, '#') + 1 + 4 - greatest(1, strpos(c_name, '#') - 4)) AS around FROM customer""")
def small_functions(spark, sf):
    rows = table(spark, sf, "customer")
    held = values.prepend_if_absent(F.array(F.lit("BUILDING"), F.lit("all")), F.col("c_mktsegment"))
    at = F.instr("c_name", "#")
    return rows.select("c_custkey", F.array_join(held, ",").alias("held"), X.negative_id("c_name").alias("made_id"), X.snippet("c_name", at, F.lit(1), 4).alias("around"))


@query("N25 N11", """WITH t AS (SELECT doc_id, source, '# one' || chr(10) || lang || chr(10) || '12' || chr(10) || '# Two things' || chr(10) || source || chr(10) || 'more' || chr(10) || '# three' || chr(10) || 'x' AS body FROM documents) SELECT doc_id, source || chr(10) || 'more' AS section FROM t""")
def whole_sections(spark, sf):
    """A section from its heading to the next one, all lines; page numbers go."""
    line = F.lit("\n")
    body = F.concat(F.lit("# one\n"), "lang", F.lit("\n12\n# Two things\n"), "source", line, F.lit("more\n7\n# three\nx"))
    return table(spark, sf, "documents").select("doc_id", X.section(body, "two things").alias("section"))


# pluggable sources and recognisers


@query("N4 S16", "SELECT 'p' || n AS key, CAST(n AS INT) AS n FROM (VALUES (0), (2), (4)) t(n)")
def kept_pages(spark, sf):
    """Pages until three are kept; those that the filter rejects do not count."""
    body = [{"key": f"p{i}", "body": json.dumps({"n": i, "even": i % 2 == 0})} for i in range(10)]
    rows = connectors.pages(spark, "fixture", pages=json.dumps(body), most="3", keep=r'"even": true')
    return rows.select("key", F.get_json_object("body", "$.n").cast("int").alias("n"))


@query("N27 S17", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'echo' ELSE 'count' END AS kind, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE CAST(i AS VARCHAR) END AS body FROM supplier, (VALUES (0), (1)) t(i) WHERE s_suppkey % 3 > 0 OR i = 0")
def dispatched_sources(spark, sf):
    """Each source of a catalogue is read by the fetcher that its row names; an unknown kind gives no pages."""
    kind = F.when(F.col("s_suppkey") % 3 == 0, "echo").otherwise("count")
    catalogue = table(spark, sf, "supplier").select("s_suppkey", kind.alias("kind"), F.when(kind == "echo", F.col("s_name")).otherwise("2").alias("options"))
    more = catalogue.limit(1).withColumn("kind", F.lit("nobody knows"))
    return connectors.dispatched(catalogue.union(more), "s_suppkey", "kind", "options").select("s_suppkey", "kind", "body")


@query("S18 M9", """WITH t AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) AS n FROM documents) SELECT doc_id, CAST(ceil(n / 50.0) AS BIGINT) AS segments, CAST(n AS BIGINT) AS words FROM t WHERE n > 0""")
def recognised_segments(spark, sf):
    """A recogniser's segments of every recording; the stub reads text as if it were sound, fifty words a segment."""
    rows = judging.recognised(table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r"[ \t\n\r]+", " ").alias("sound")), "doc_id", "sound", judging.stub_recogniser(50))
    good = rows.where("no_speech <= 0.6 and logprob >= -1.0")
    return good.groupBy("doc_id").agg(F.count("*").alias("segments"), F.sum(F.size(F.split("said", " "))).alias("words"))


@query("N14", "SELECT k, min(source) AS source FROM (SELECT 'a' AS source, o_custkey AS k FROM orders UNION ALL SELECT 'b', user_id FROM events) GROUP BY 1")
def alternates_first_source(spark, sf):
    """Candidates of two producers, each once, from the first producer that has it."""
    from quillwork.operators.relational import first_per_key

    a = table(spark, sf, "orders").select(F.lit("a").alias("source"), F.col("o_custkey").alias("k"))
    both = a.unionByName(table(spark, sf, "events").select(F.lit("b").alias("source"), F.col("user_id").alias("k")))
    return first_per_key(both, ["k"], [F.col("source")])
