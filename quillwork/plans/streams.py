"""Queries over stateful and streaming operators: the batch form of each, and streams replayed over the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillwork.operators import suppression
from quillwork.session import table
from quillwork.streaming import flows, folds
from quillwork.streaming import timed as deadlines

from .registry import query


def timed(spark, sf):
    return table(spark, sf, "events").withColumn("t", F.unix_micros("ts") / 1e6)


@query("X1 N13", "SELECT event_id FROM events WHERE event_id > 500 AND user_id % 2 = 0 OR user_id % 2 = 1")
def high_water_mark(spark, sf):
    events = table(spark, sf, "events").withColumn("grp", (F.col("user_id") % 2).cast("int"))
    marks = spark.createDataFrame([(0, 500)], "grp int, mark long")
    return flows.since(events, marks, "grp", "event_id").select("event_id")


@query("X1 A13", "SELECT (user_id % 3)::INT AS grp, greatest(max(event_id), CASE user_id % 3 WHEN 0 THEN 100000000 ELSE 0 END) AS mark FROM events GROUP BY user_id % 3")
def advanced_marks(spark, sf):
    events = table(spark, sf, "events").withColumn("grp", (F.col("user_id") % 3).cast("int"))
    return flows.advanced(events, spark.createDataFrame([(0, 100000000)], "grp int, mark long"), "grp", "event_id")


@query("X2", "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events WHERE event_type = 'signup' AND value < 20)")
def since_last_success(spark, sf):
    events = table(spark, sf, "events")
    runs = events.where("event_type = 'signup'").select((F.col("value") < 20).alias("ok"), F.col("ts").alias("finished_at"))
    return flows.since_last_success(events, "ts", runs, F.expr("timestamp'2024-01-01'")).select("event_id")


@query("X3", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS t FROM events),
    first AS (SELECT user_id, arg_min(event_id, (t, event_id)) AS event_id, min(t) AS t FROM e GROUP BY 1),
    r AS (SELECT user_id, event_id, t FROM first UNION ALL
      SELECT user_id, event_id, t FROM (SELECT e.user_id, e.event_id, e.t, row_number() OVER (PARTITION BY e.user_id ORDER BY e.t, e.event_id) AS n FROM r JOIN e ON e.user_id = r.user_id AND e.t - r.t >= 43200) WHERE n = 1)
    SELECT user_id, event_id FROM r""")
def cooldown_alerts(spark, sf):
    out = folds.folded(timed(spark, sf).select("user_id", "event_id", "t"), ["user_id"], ["t", "event_id"], folds.cooldown("t", 43200, ["event_id"]), "t double, event_id long")
    return out.select("user_id", "event_id")


@query("X4", "SELECT event_type, user_id % 10 AS slot FROM events GROUP BY 1, 2")
def fire_once_per_version(spark, sf):
    rows = table(spark, sf, "events").select("event_type", (F.col("user_id") % 10).alias("slot"))
    return flows.once_per_version(rows, ["event_type"], F.col("slot").cast("string")).select("event_type", "slot")


# per source, a minute a document: pairs that share half their words within six hours, then the rows in order
REPEATS = r"""WITH RECURSIVE d AS (SELECT coalesce(source, '') || (source IS NULL) AS s, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{4,}')) AS w FROM documents),
    p AS (SELECT b.doc_id, a.doc_id AS a, len(list_intersect(a.w, b.w)) AS k, len(a.w) + len(b.w) AS total FROM d a JOIN d b ON a.s = b.s AND b.doc_id > a.doc_id AND b.doc_id <= a.doc_id + 360),
    e AS (SELECT doc_id, list(a ORDER BY a) AS near FROM p WHERE k > 0 AND 2 * k >= total - k GROUP BY 1),
    m AS (SELECT d.s, d.n, d.doc_id, e.near FROM d LEFT JOIN e USING (doc_id)),
    r AS (SELECT s, n, doc_id, doc_id AS leader, [doc_id] AS kept FROM m WHERE n = 1
      UNION ALL SELECT m.s, m.n, m.doc_id, coalesce(list_min(list_intersect(m.near, r.kept)), m.doc_id), CASE WHEN list_has_any(coalesce(m.near, []), r.kept) THEN r.kept ELSE list_append(list_filter(r.kept, lambda x: x > m.doc_id - 360), m.doc_id) END FROM r JOIN m ON m.s = r.s AND m.n = r.n + 1)"""


def repeats(spark, sf):
    rows = table(spark, sf, "documents").select("source", "doc_id", (F.col("doc_id") * 60).alias("t"), "text")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]{4,}"), F.lit(0))
    return rows.select("source", "doc_id"), suppression.unlike_recent(rows, "source", "t", "doc_id", words, 6 * 3600, 0.5)


@query("X5", REPEATS + " SELECT doc_id, leader FROM r")
def suppressed_repeats(spark, sf):
    """Whom each document repeats: the oldest document let through within six hours in its source that shares half its words."""
    return repeats(spark, sf)[1]


@query("X5", REPEATS + " SELECT CASE WHEN s LIKE '%true' THEN NULL ELSE left(s, len(s) - 5) END AS source, count(*) AS n FROM r WHERE doc_id = leader GROUP BY 1")
def near_duplicate_window(spark, sf):
    rows, found = repeats(spark, sf)
    return found.where("doc_id = leader").join(rows, "doc_id").groupBy("source").agg(F.count("*").alias("n"))


@query("X6", """SELECT conv_id, turn, count(*) OVER w AS parts, CAST(sum(length(text)) OVER w AS BIGINT) AS chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def append_accumulate(spark, sf):
    def carry(step):
        def with_turn(state, row):
            state, out = step(state, row)
            return state, [(row["turn"], *x) for x in out]

        return with_turn

    rows = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return folds.folded(rows, ["conv_id"], ["turn"], carry(folds.accumulated("text")), "turn long, parts long, chars long")


PHRASES = """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS a, epoch_us(ts) + CAST(floor(coalesce(value, 0)) AS BIGINT) * 60000000 AS b, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT user_id, n, a AS first_a, b AS last_b, 1 AS g FROM e WHERE n = 1
      UNION ALL SELECT user_id, n, CASE WHEN new THEN a ELSE first_a END, CASE WHEN new THEN b ELSE greatest(b, last_b) END, g + new::INT
      FROM (SELECT e.*, r.first_a, r.last_b, r.g, e.a >= r.last_b + 3600000000 OR e.b - r.first_a >= 86400000000 AS new FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
    SELECT user_id, first_a AS start, max(last_b) AS "end", count(*) AS n FROM r GROUP BY user_id, g, first_a"""
PHRASE = (["user_id"], "at", ["event_id"], deadlines.Phrases("at", "til", 3_600_000_000, 86_400_000_000), "start long, end long, n long")


def segments(spark, sf):
    at = F.unix_micros("ts")
    return table(spark, sf, "events").select("user_id", "event_id", at.alias("at"), (at + F.floor(F.coalesce("value", F.lit(0.0))) * 60_000_000).alias("til"))


@query("X7", PHRASES)
def phrase_segmentation(spark, sf):
    return deadlines.timed_folded(segments(spark, sf), *PHRASE)


@query("X7 X12", PHRASES)
def stream_phrases(spark, sf):
    """The same as a stream: rows wait for the watermark, the last phrase of a source is closed by a timer."""
    keys, at, order, step, out = PHRASE
    return deadlines.streamed(segments(spark, sf), keys, at, "1 hour", order, step, out, "phrases")


BATCHES = """WITH RECURSIVE e AS (SELECT conv_id, (turn + 1) * 600000000::BIGINT AS t, length(coalesce(text, '')) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(coalesce(text, ''))) AS i FROM conversations),
    r AS (SELECT conv_id, i, t, t AS since, c::BIGINT AS size, false AS closed, 1 AS g FROM e WHERE i = 1
      UNION ALL SELECT conv_id, i, t, since, size, t - since >= 900000000 AND size >= 800, g FROM
        (SELECT e.conv_id, e.i, e.t, CASE WHEN new THEN e.t ELSE o.since END AS since, e.c + CASE WHEN new THEN 0 ELSE o.size END AS size, o.g + new::INT AS g
         FROM (SELECT r.*, e.t AS next_t FROM r JOIN e ON e.conv_id = r.conv_id AND e.i = r.i + 1) o0, LATERAL (SELECT o0.*, o0.closed OR o0.next_t >= o0.since + 3600000000 AS new) o JOIN e ON e.conv_id = o.conv_id AND e.i = o.i + 1))
    SELECT conv_id, CASE WHEN bool_or(closed) THEN max(t) ELSE min(since) + 3600000000 END AS t, max(size) AS chars, count(*) AS n FROM r GROUP BY conv_id, g"""
BATCH = (["conv_id"], "at", ["size"], deadlines.Batches("at", "size"), "t long, chars long, n long")


def said(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", ((F.col("turn").cast("long") + 1) * 600_000_000).alias("at"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))


@query("X8", BATCHES)
def volume_time_batches(spark, sf):
    return deadlines.timed_folded(said(spark, sf), *BATCH)


@query("X8 X12", BATCHES)
def stream_batches(spark, sf):
    """The same as a stream: what a conversation has left is handed out when its time is up."""
    keys, at, order, step, out = BATCH
    return deadlines.streamed(said(spark, sf), keys, at, "10 minutes", order, step, out, "batches")


@query("X9", """SELECT user_id, t AS "last", t + 86400000000 AS given_up FROM (SELECT user_id, epoch_us(ts) AS t, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM events) WHERE following IS NULL OR following - t >= 86400000000""")
def stream_silence(spark, sf):
    """Sources that fell silent for two looks of twelve hours, noticed by timers."""
    step = deadlines.Silence("at", 43_200_000_000, 2)
    return deadlines.streamed(segments(spark, sf).drop("til"), ["user_id"], "at", "1 hour", ["event_id"], step, "last long, given_up long", "silence")


@query("J14 X10 X12", """WITH p AS (SELECT user_id, event_id, epoch_us(ts) AS a, epoch_us(ts) + 3600000000 AS b FROM events WHERE event_type <> 'error'),
    v AS (SELECT user_id, event_type, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(least(value, 100)) AS BIGINT) * 36000000 + 3600000000 AS e FROM events WHERE event_type <> 'view'),
    o AS (SELECT p.user_id, event_id, event_type, sum(least(b, e) - greatest(a, s)) AS us FROM p JOIN v ON p.user_id = v.user_id AND a < e AND s < b GROUP BY 1, 2, 3)
    SELECT user_id, event_id, event_type, us / 1e6 AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_id ORDER BY us DESC, event_type) AS n FROM o) WHERE n = 1""")
def stream_overlap_argmax(spark, sf):
    """Captions and voices as two streams, joined by time range; what either side keeps is bounded by three hours."""
    events = table(spark, sf, "events")
    later = lambda us: F.timestamp_micros(F.unix_micros("ts") + us)
    phrases = events.where("event_type <> 'error'").select("user_id", "event_id", F.col("ts").alias("start"), later(F.lit(3_600_000_000)).alias("end"))
    long = (F.floor(F.least(F.col("value"), F.lit(100.0))) * 36_000_000 + 3_600_000_000).cast("long")
    voices = events.where("event_type <> 'view'").select("user_id", "event_type", F.col("ts").alias("start"), later(long).alias("end"))
    folders = []
    for side, name in ((phrases, "phrases"), (voices, "voices")):
        folders.append(deadlines.feed(spark, side.schema, name))
        side.write.mode("append").parquet(folders[-1])
    a, b = (spark.readStream.schema(x.schema).parquet(f) for x, f in zip((phrases, voices), folders, strict=True))
    pairs = deadlines.overlapping(a, b, "user_id", "event_id", "event_type", "1 hour", "3 hours")
    deadlines.run(pairs, f"{folders[0]}-out")
    return deadlines.longest_overlap(spark.read.schema(pairs.schema).parquet(f"{folders[0]}-out/rows"), "user_id", "event_id", "event_type")


@query("X9", """WITH e AS (SELECT user_id, event_id, ts, event_type = 'error' AS miss, lag(event_type = 'error') OVER w AS p1, lag(event_type = 'error', 2) OVER w AS p2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT *, sum((NOT miss)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, run, miss ORDER BY ts, event_id) AS k FROM g)
    SELECT user_id, count(*) AS ended FROM n WHERE miss AND k = 2 GROUP BY 1""")
def liveness_misses(spark, sf):
    rows = timed(spark, sf).select("user_id", "event_id", "t", (F.col("event_type") != "error").alias("alive"))
    return folds.folded(rows, ["user_id"], ["t", "event_id"], folds.ended("t", "alive"), "t double").groupBy("user_id").agg(F.count("*").alias("ended"))


@query("X10 W5", """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 7200000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, session""")
def session_windows(spark, sf):
    rows = flows.sessions(table(spark, sf, "events"), "ts", ["user_id"], "2 hours")
    return rows.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("X11", """SELECT sha1(array_to_string(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')[5:25], ' ')) AS print, count(*) AS n FROM conversations GROUP BY 1""")
def repeated_advert_prints(spark, sf):
    return table(spark, sf, "conversations").groupBy(flows.fingerprint(F.col("text")).alias("print")).agg(F.count("*").alias("n"))


@query("X12", "SELECT event_id, TIMESTAMP '2024-01-20' - INTERVAL 7 DAY > ts AS late FROM events")
def late_rows(spark, sf):
    rows = table(spark, sf, "events").withColumn("seen", F.expr("timestamp'2024-01-20 00:00:00'"))
    return flows.late_split(rows, "ts", "seen", 7).select("event_id", "late")


@query("X16", "SELECT event_type, round((epoch(TIMESTAMP '2024-01-31') - epoch(max(ts))) / 3600, 4) AS hours FROM events GROUP BY 1")
def staleness_hours(spark, sf):
    return flows.staleness(table(spark, sf, "events"), "event_type", "ts", F.expr("timestamp'2024-01-31 00:00:00'")).select("event_type", F.round("hours", 4).alias("hours"))


@query("X17 U4", """WITH a AS (SELECT DISTINCT user_id FROM events WHERE value < 5 AND ts < TIMESTAMP '2024-01-15'), b AS (SELECT DISTINCT user_id FROM events WHERE value < 5 AND ts >= TIMESTAMP '2024-01-15')
    SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 'new' ELSE 'resolved' END AS state FROM a FULL JOIN b USING (user_id) WHERE a.user_id IS NULL OR b.user_id IS NULL""")
def health_changes(spark, sf):
    low = table(spark, sf, "events").where("value < 5")
    return flows.health_changes(low.where("ts < timestamp'2024-01-15'"), low.where("ts >= timestamp'2024-01-15'"), "user_id")


@query("N16", """WITH r AS (SELECT event_type, ts AS s, CASE WHEN event_id % 3 <> 0 THEN ts + INTERVAL 5 MINUTE END AS f FROM events), l AS (SELECT event_type, arg_max(f IS NULL, s) AS open, max(s) AS s, max(f) AS f FROM r GROUP BY 1)
    SELECT event_type, CASE WHEN NOT open THEN 'finished' WHEN s >= TIMESTAMP '2024-01-31' - INTERVAL 15 MINUTE THEN 'running' ELSE 'stalled' END AS state FROM l""")
def run_states(spark, sf):
    rows = table(spark, sf, "events").select("event_type", F.col("ts").alias("started_at"), F.when(F.col("event_id") % 3 != 0, F.col("ts") + F.expr("interval 5 minutes")).alias("finished_at"))
    return flows.run_states(rows, "event_type", F.expr("timestamp'2024-01-31 00:00:00'")).select("event_type", "state")


def event_stream(spark, sf):
    plain = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(plain.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("X1 X6 X15", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_counts(spark, sf):
    """A running count over a stream, in complete mode, over all that its source holds."""
    return flows.replayed(event_stream(spark, sf).groupBy("event_type").agg(F.count("*").alias("n")), f"q{uuid.uuid4().hex}", "complete")


@query("X3", """WITH RECURSIVE e AS (SELECT event_type, event_id, epoch(ts) AS t FROM events),
    first AS (SELECT event_type, min(t) AS t FROM e GROUP BY 1),
    r AS (SELECT event_type, t FROM first UNION ALL SELECT event_type, t FROM (SELECT e.event_type, e.t, row_number() OVER (PARTITION BY e.event_type ORDER BY e.t, e.event_id) AS n FROM r JOIN e ON e.event_type = r.event_type AND e.t - r.t >= 86400) WHERE n = 1)
    SELECT event_type, count(*) AS n FROM r GROUP BY 1""")
def stream_cooldown(spark, sf):
    """The cooldown as keyed state of a stream, equal to its batch form."""
    rows = event_stream(spark, sf).select("event_type", "event_id", (F.unix_micros("ts") / 1e6).alias("t"))
    out = folds.folded_stream(rows, ["event_type"], ["t", "event_id"], folds.cooldown("t", 86400, ["event_id"]), "t double, event_id long")
    return flows.replayed(out, f"q{uuid.uuid4().hex}").groupBy("event_type").agg(F.count("*").alias("n"))


@query("X11", "SELECT count(DISTINCT (user_id, event_type)) AS n FROM events")
def stream_deduplicated(spark, sf):
    rows = flows.without_repeats(event_stream(spark, sf), "ts", "60 days", ["user_id", "event_type"])
    return flows.replayed(rows.select("user_id"), f"q{uuid.uuid4().hex}").agg(F.count("*").alias("n"))
