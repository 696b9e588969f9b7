"""Queries over roll calls and keyed sync."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillwork.functions import dates
from quillwork.functions.text import natural_key
from quillwork.operators import cdc as C
from quillwork.operators import votes as V
from quillwork.operators.retrieval import shared_folder
from quillwork.session import table
from quillwork.sources import publish as K

from .registry import query

VOTES = """votes AS (SELECT strftime(o_orderdate, '%Y-%m') AS rollcall, c_nationkey AS party, o_custkey AS member, CASE o_orderstatus WHEN 'F' THEN 'SI' WHEN 'O' THEN 'NO' ELSE 'ABST' END AS position
      FROM orders JOIN customer ON c_custkey = o_custkey)"""
MODE = """counts AS (SELECT rollcall, party, position, count(*) AS n FROM votes GROUP BY 1, 2, 3),
    top AS (SELECT *, rank() OVER (PARTITION BY rollcall, party ORDER BY n DESC) AS r FROM counts),
    mode AS (SELECT rollcall, party, min(position) AS mode, max(n) AS n_mode FROM top WHERE r = 1 GROUP BY 1, 2 HAVING count(*) = 1)"""


def roll_calls(spark, sf):
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    said = F.when(F.col("o_orderstatus") == "F", "SI").when(F.col("o_orderstatus") == "O", "NO").otherwise("ABST")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(dates.month("o_orderdate").alias("rollcall"), F.col("c_nationkey").alias("party"), F.col("o_custkey").alias("member"), said.alias("position"))


@query("A8", f"WITH {VOTES} SELECT rollcall, party, position, count(*) AS n FROM votes GROUP BY 1, 2, 3")
def vote_tallies(spark, sf):
    return V.tallies(roll_calls(spark, sf), ["rollcall", "party"], "position")


@query("A9", f"WITH {VOTES}, {MODE} SELECT * FROM mode")
def strict_mode_by_group(spark, sf):
    return V.strict_mode(roll_calls(spark, sf), ["rollcall", "party"], "position")


@query("A10", f"WITH {VOTES}, {MODE} SELECT party, member, count(*) AS n_votes, round(avg((position = mode)::INT), 6) AS share FROM votes JOIN mode USING (rollcall, party) GROUP BY 1, 2")
def alignment_pct(spark, sf):
    return V.alignment(roll_calls(spark, sf), "rollcall", "party", "member", "position").withColumn("share", F.round("share", 6))


@query("A10", f"""WITH {VOTES}, numbered AS (SELECT *, row_number() OVER () AS id FROM votes),
    others AS (SELECT a.id, a.party, a.member, a.position, b.position AS p, count(*) AS n FROM numbered a JOIN numbered b ON a.rollcall = b.rollcall AND a.party = b.party AND a.id <> b.id GROUP BY ALL),
    top AS (SELECT *, rank() OVER (PARTITION BY id ORDER BY n DESC) AS r FROM others), m AS (SELECT id, party, member, position, min(p) AS p FROM top WHERE r = 1 GROUP BY ALL HAVING count(*) = 1)
    SELECT party, member, count(*) AS n_votes, round(avg((position = p)::INT), 6) AS share FROM m GROUP BY 1, 2""")
def alignment_pct_excl_self(spark, sf):
    return V.alignment(roll_calls(spark, sf), "rollcall", "party", "member", "position", include_self=False).withColumn("share", F.round("share", 6))


@query("A11", f"WITH {VOTES} SELECT member, count(*) AS n, count(*) FILTER (position NOT IN ('SI', 'NO')) AS absent, round(avg((position IN ('SI', 'NO'))::INT), 6) AS present FROM votes GROUP BY 1")
def participation(spark, sf):
    return V.participation(roll_calls(spark, sf), "member", "position", ["SI", "NO"]).withColumn("present", F.round("present", 6))


@query("A10", "SELECT c_nationkey, min_by(c_name || repeat('x', (c_custkey % 4)::INT), (-length(c_name || repeat('x', (c_custkey % 4)::INT)), c_name || repeat('x', (c_custkey % 4)::INT))) AS name FROM customer GROUP BY 1")
def longest_spelling(spark, sf):
    rows = table(spark, sf, "customer").select("c_nationkey", F.concat("c_name", F.repeat(F.lit("x"), (F.col("c_custkey") % 4).cast("int"))).alias("name"))
    return V.longest_spelling(rows, ["c_nationkey"], "name")


@query("A12 D8", """SELECT topic, author, n, place FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, author) AS place FROM
    (SELECT o_orderpriority AS topic, author, count(*) AS n FROM (SELECT o_orderpriority, unnest([o_custkey, o_custkey % 10]) AS author FROM orders) GROUP BY 1, 2)) WHERE place <= 30""")
def contributions_by_topic(spark, sf):
    rows = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "topic")
    return V.contributions(rows, F.array("o_custkey", F.col("o_custkey") % 10), "topic").withColumn("place", F.col("place").cast("long"))


@query("Y9", "SELECT c_mktsegment, count(*) AS seats, (SELECT floor(count(*) / 2)::BIGINT + 1 FROM customer) AS majority FROM customer GROUP BY 1")
def seats_and_majority(spark, sf):
    return V.seats(table(spark, sf, "customer"), "c_mktsegment")


@query("Y10", """WITH v AS (SELECT o_custkey AS member, max_by(o_orderstatus, o_orderkey) AS position FROM orders GROUP BY 1)
    SELECT CASE WHEN position IN ('F', 'O') THEN position ELSE 'no vote' END AS position, count(*) AS n FROM customer LEFT JOIN v ON member = c_custkey GROUP BY 1""")
def tally_over_members(spark, sf):
    members = table(spark, sf, "customer").select(F.col("c_custkey").alias("member"))
    last = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("member")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("position"))
    return V.tally_over_members(members, last, "member", "position", ["F", "O"])


def snapshots(spark, sf):
    """Two versions of the orders: some rows gone, some new, some values changed."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
    old = rows.where("o_orderkey % 7 <> 0")
    status = F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus"))
    new = rows.where("o_orderkey % 13 <> 0").withColumn("o_orderstatus", status).withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("")))
    return old, new


SNAPSHOTS = """o AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 7 <> 0),
    n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 13 <> 0)"""


@query("C1 W10", f"""WITH {SNAPSHOTS} SELECT o_orderkey, 'o_orderstatus' AS field, o.o_orderstatus AS before, n.o_orderstatus AS after FROM o JOIN n USING (o_orderkey) WHERE o.o_orderstatus <> n.o_orderstatus""")
def snapshot_diff_history(spark, sf):
    old, new = snapshots(spark, sf)
    return C.history(old, new, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


@query("C1 C2 C8 C7", f"""WITH {SNAPSHOTS} SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, CASE WHEN n.o_orderkey IS NULL THEN o.o_orderstatus ELSE n.o_orderstatus END AS o_orderstatus,
    CASE WHEN o.o_orderkey IS NULL THEN '2024-02' ELSE '2024-01' END AS first_seen, CASE WHEN n.o_orderkey IS NULL THEN '2024-01' ELSE '2024-02' END AS last_seen,
    CASE WHEN n.o_orderkey IS NOT NULL AND (o.o_orderkey IS NULL OR o.o_orderstatus <> n.o_orderstatus) THEN '2024-02' ELSE '2024-01' END AS last_changed FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey""")
def tracked_upsert(spark, sf):
    old, new = snapshots(spark, sf)
    before = F.lit("2024-01")
    old = old.withColumns({"first_seen": before, "last_seen": before, "last_changed": before})
    rows = C.upserted(old, new, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"], F.lit("2024-02"))
    return rows.select("o_orderkey", "o_orderstatus", "first_seen", "last_seen", "last_changed")


@query("C2 V6 A19", f"""WITH {SNAPSHOTS}, c AS (SELECT CASE WHEN o.o_orderkey IS NULL THEN 'insert' WHEN n.o_orderkey IS NULL THEN 'missing' WHEN o.o_orderstatus <> n.o_orderstatus THEN 'update' ELSE 'same' END AS change FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey)
    SELECT change, count(*) AS n FROM c GROUP BY 1""")
def change_counters(spark, sf):
    old, new = snapshots(spark, sf)
    return C.compared(old, new, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"]).groupBy("change").agg(F.count("*").alias("n"))


@query("C3", f"""WITH {SNAPSHOTS} SELECT o_orderkey, o_orderstatus FROM o UNION ALL SELECT o_orderkey, o_orderstatus FROM n WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o)""")
def insert_ignore(spark, sf):
    old, new = snapshots(spark, sf)
    return C.inserted_only(old, new, ["o_orderkey"]).select("o_orderkey", "o_orderstatus")


@query("C4 N33", f"""WITH {SNAPSHOTS} SELECT o_orderkey, o_orderstatus FROM n UNION ALL SELECT o_orderkey, o_orderstatus FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n)""")
def insert_or_replace(spark, sf):
    old, new = snapshots(spark, sf)
    return C.replaced(old, new, ["o_orderkey"]).select("o_orderkey", "o_orderstatus")


@query("C5", """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 4 = 0 THEN 0 ELSE l_quantity END AS l_quantity FROM lineitem WHERE l_orderkey % 4 <> 0 OR l_linenumber <= 2""")
def replace_children(spark, sf):
    old = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    fresh = old.where("l_orderkey % 4 = 0 and l_linenumber <= 2").withColumn("l_quantity", F.lit(0.0))
    return C.children_replaced(old, fresh, ["l_orderkey"], old.where("l_orderkey % 4 = 0"))


@query("C6 N20", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN 'old' ELSE 'new' END AS version FROM orders""")
def checksum_guarded_replace(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey")
    old = rows.withColumns({"version": F.lit("old"), "ok": F.col("o_orderkey") % 2 == 0})
    new = rows.withColumns({"version": F.lit("new"), "ok": F.col("o_orderkey") % 3 == 0})
    return C.checksum_guarded(old, new, ["o_orderkey"], "ok").select("o_orderkey", "version")


@query("C9", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-28' - INTERVAL 10 DAY")
def purge_retention(spark, sf):
    return C.purged(table(spark, sf, "events"), "ts", F.expr("timestamp'2024-01-28 00:00:00'"), 10).select("event_id")


@query("C10", """SELECT s_suppkey, s_acctbal > 0 AND s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2) AS active,
    CASE WHEN s_acctbal > 0 AND s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2) THEN 'not in catalogue' END AS note FROM supplier""")
def orphan_deactivate(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"), (F.col("s_acctbal") > 0).alias("active"), F.lit(None).cast("string").alias("note"))
    return C.orphans_off(rows, table(spark, sf, "nation").where("n_regionkey <> 2").select("n_nationkey"), ["n_nationkey"], "active", "note").select("s_suppkey", "active", "note")


@query("C11", "SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'large' ELSE 'small' END AS size FROM orders")
def rederive(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 250000, "large").otherwise("small").alias("size"))


@query("C12", """SELECT member, grp FROM (SELECT o_custkey AS member, o_orderpriority AS grp, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def exclusive_grouping(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("member"), F.col("o_orderpriority").alias("grp"), "o_orderdate", "o_orderkey")
    return C.exclusive_groups(rows, "member", "grp", [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query("C12", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def stub_members(spark, sf):
    known = table(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    return C.stubs(table(spark, sf, "lineitem"), known, "l_partkey")


@query("C13 N19", f"""WITH {SNAPSHOTS} SELECT o_orderkey, o.o_orderstatus AS before, n.o_orderstatus AS after FROM o JOIN n USING (o_orderkey) WHERE o.o_orderstatus <> n.o_orderstatus""")
def state_diff(spark, sf):
    old, new = snapshots(spark, sf)
    return C.state_changes(old, new.select("o_orderkey", "o_orderstatus"), ["o_orderkey"], "o_orderstatus")


@query("C14 X13 N13", "SELECT event_id FROM events WHERE event_type = 'purchase' AND event_id NOT IN (SELECT event_id FROM events WHERE value > 50)")
def pending_ledger(spark, sf):
    events = table(spark, sf, "events")
    return C.pending(events.where("event_type = 'purchase'"), events.where("value > 50"), ["event_id"]).select("event_id")


@query("M5", """SELECT doc_id, CASE WHEN confidence >= 0.85 THEN 'x' ELSE lang END AS lang, CASE WHEN confidence >= 0.85 THEN 'applied' WHEN confidence >= 0.70 THEN 'suggested' WHEN confidence IS NOT NULL THEN 'ignored' END AS outcome
    FROM documents LEFT JOIN (SELECT doc_id AS d, (doc_id % 100) / 100 AS confidence FROM documents WHERE doc_id % 2 = 0) ON d = doc_id""")
def suggest_apply_split(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    model = docs.where("doc_id % 2 = 0").select("doc_id", F.lit("x").alias("suggested_label"), ((F.col("doc_id") % 100) / 100).alias("confidence"))
    return C.suggestions_applied(docs, model, ["doc_id"], "lang").select("doc_id", "lang", "outcome")


@query("M5", """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'accepted' WHEN doc_id % 3 = 0 AND doc_id % 7 <> 0 THEN 'rejected' ELSE CASE WHEN doc_id % 7 = 0 AND doc_id % 3 = 0 THEN 'rejected' ELSE 'pending' END END AS state FROM documents""")
def decisions_idempotent(spark, sf):
    ids = table(spark, sf, "documents").select("doc_id")
    held = ids.withColumn("state", F.when(F.col("doc_id") % 5 == 0, "accepted").otherwise("pending"))
    one = ids.where("doc_id % 3 = 0").select("doc_id", F.lit("rejected").alias("decision"), F.lit(1).alias("decided_at"))
    again = one.withColumns({"decision": F.lit("accepted"), "decided_at": F.lit(2)})
    return C.decided(held, one.union(again), ["doc_id"])


@query("V14", """SELECT k, max(CASE src WHEN 0 THEN 'human' END) IS NOT NULL AS human, CASE WHEN max(CASE src WHEN 0 THEN 1 END) = 1 THEN 'human' WHEN max(CASE src WHEN 1 THEN 1 END) = 1 THEN 'model' ELSE 'rule' END AS source
    FROM (SELECT event_id % 500 AS k, event_id % 3 AS src FROM events) GROUP BY 1""")
def verdict_precedence(spark, sf):
    from quillwork.operators.retrieval import verdicts

    names = F.array(*map(F.lit, ("human", "model", "rule")))
    rows = table(spark, sf, "events").select((F.col("event_id") % 500).alias("k"), names[(F.col("event_id") % 3).cast("int")].alias("source"))
    out = verdicts(rows.distinct(), ["k"], "source", ["human", "model", "rule"])
    return out.select("k", (F.col("source") == "human").alias("human"), "source")


@query("K1 K2 K3", "SELECT count(*) AS n, 2::BIGINT AS version FROM documents WHERE doc_id % 3 <> 0")
def versioned_publish(spark, sf):
    """Publishes twice, the second time merging, and reads what is current."""
    root = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}"
    docs = table(spark, sf, "documents").select("doc_id")
    K.publish_merged(spark, root, lambda old: docs.where("doc_id % 3 = 1"))
    at = K.publish_merged(spark, root, lambda old: old.union(docs.where("doc_id % 3 = 2")))
    return K.read_published(spark, root).agg(F.count("*").alias("n")).withColumn("version", F.lit(at).cast("long"))


@query("K4 S7", "SELECT count(*) AS n, CAST(sum(n_turns) AS BIGINT) AS turns FROM (SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY 1)")
def nested_json_export(spark, sf):
    conv = table(spark, sf, "conversations")
    rows = K.nested(conv.select("conv_id").distinct(), {"turns": (conv.select("conv_id", "turn", "role"), ["turn", "role"])}, ["conv_id"])
    path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    K.exported_json(rows, path)
    back = spark.read.schema("conv_id long, turns array<struct<turn:long,role:string>>").json(path)
    return back.agg(F.count("*").alias("n"), F.sum(F.size("turns")).cast("long").alias("turns"))


@query("K8", "SELECT c_custkey, c_name FROM customer")
def encrypted_round_trip(spark, sf):
    key = F.lit("0123456789abcdef")
    rows = table(spark, sf, "customer").select("c_custkey", K.encrypted(F.col("c_name"), key).alias("x"))
    return rows.select("c_custkey", F.aes_decrypt(F.unbase64("x"), key, F.lit("GCM")).cast("string").alias("c_name"))


@query("Y4", "SELECT c_custkey FROM customer WHERE c_custkey < 200")
def natural_sort_of_names(spark, sf):
    rows = table(spark, sf, "customer").where("c_custkey < 200")
    return rows.orderBy(natural_key("c_name").asc_nulls_last()).select("c_custkey")


@query("Y4", "SELECT c_custkey FROM customer")
def natural_sort_of_all_names(spark, sf):
    return table(spark, sf, "customer").orderBy(natural_key("c_name").asc_nulls_last()).select("c_custkey")

