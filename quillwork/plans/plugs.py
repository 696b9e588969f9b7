"""Queries over pluggable parts: connectors, judges, delivery, delimited sources, text cutting."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillwork.operators import judging as J
from quillwork.operators.retrieval import shared_folder
from quillwork.session import table
from quillwork.sources import connectors, parsers, pieces, tables

from .registry import query


@query("S5", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 11 <> 0")
def delimited_scan(spark, sf):
    """Writes customers as delimited text with a literal null and lines without the required name, and reads them back."""
    path = f"{shared_folder(spark)}/delimited-{uuid.uuid4().hex}"
    rows = table(spark, sf, "customer").select(
        F.concat_ws(";", F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 11 == 0, "").otherwise(F.col("c_name")),
                    F.when(F.col("c_custkey") % 7 == 0, "null").otherwise(F.concat(F.lit('"'), "c_mktsegment", F.lit('"')))).alias("line")
    )
    rows.write.text(path)
    schema = T.StructType.fromDDL("c_custkey long, c_name string, segment string")
    plain = spark.read.schema(schema).options(sep=";", header=False, nullValue="null").csv(path)
    return tables.with_columns_of(plain, schema).dropna(subset=["c_name"])


@query("S16 N4", "SELECT 'p' || n AS key, n::INT AS n FROM (VALUES (0), (1), (2), (3)) t(n)")
def paged_connector(spark, sf):
    pages = [{"key": f"p{i}", "body": json.dumps({"n": i})} for i in range(5)]
    rows = connectors.pages(spark, "fixture", pages=json.dumps(pages), most="4")
    return rows.select("key", F.get_json_object("body", "$.n").cast("int").alias("n"))


@query("U1", "SELECT source, count(*) AS n FROM (SELECT 'a' AS source, o_custkey AS k FROM orders UNION ALL SELECT 'b', user_id FROM events) GROUP BY 1")
def cross_source_alternates(spark, sf):
    a = table(spark, sf, "orders").select(F.lit("a").alias("source"), F.col("o_custkey").alias("k"))
    return a.unionByName(table(spark, sf, "events").select(F.lit("b").alias("source"), F.col("user_id").alias("k"))).groupBy("source").agg(F.count("*").alias("n"))


@query("N28", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN CASE WHEN source = 'src0' THEN NULL ELSE upper(source) END ELSE lang END AS lang FROM documents")
def backfilled_values(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("lang"))
    return J.backfilled(rows, "source", "lang", lambda s: None if s == "src0" else s.upper()).select("doc_id", "lang")


@query("M7", "SELECT item_id, contains(lower(text), 'tion') AS verdict FROM benchmark")
def judged_items(spark, sf):
    """A judge that fails and the fallback that answers."""
    return J.judged(table(spark, sf, "benchmark"), "item_id", "text", [J.failing_judge, J.keyword_judge(["tion"])])


@query("F20", "SELECT c_custkey, c_name FROM customer")
def path_parameter_round_trip(spark, sf):
    key = F.lit("0123456789abcdef")
    hidden = F.base64(F.aes_encrypt("c_name", key, F.lit("ECB")))
    return table(spark, sf, "customer").select("c_custkey", F.aes_decrypt(F.unbase64(hidden), key, F.lit("ECB")).cast("string").alias("c_name"))


@query("W8", "SELECT doc_id, md5(text) AS digest FROM documents WHERE length(text) > 0")
def overlapping_chunks(spark, sf):
    """The chunks of every text put together again without their overlaps."""
    rows = parsers.parsed(table(spark, sf, "documents"), "doc_id", "text", pieces.chunks(1000, 100), pieces.CHUNK_FIELDS)
    chunks = F.array_sort(F.collect_list(F.struct("start", "chunk")))
    whole = F.aggregate(chunks, F.lit(""), lambda said, c: F.concat(F.substring(said, F.lit(1), c["start"]), c["chunk"]))
    return rows.groupBy("doc_id").agg(F.md5(whole).alias("digest"))


@query("W9")
def paragraph_fragments(spark, sf):
    rows = parsers.parsed(table(spark, sf, "documents"), "doc_id", "text", pieces.fragments(), pieces.FRAGMENT_FIELDS)
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("fragment")).alias("longest"))


@query("M9", "SELECT event_id FROM events WHERE value / 100 <= 0.6 AND -user_id / 50.0 >= -1.0")
def segments_filtered(spark, sf):
    """Recognised segments that are speech: confident and not silence; the models' outputs are rows like any other."""
    rows = table(spark, sf, "events").select("event_id", (F.col("value") / 100).alias("no_speech"), (-F.col("user_id") / 50).alias("logprob"))
    return rows.where("no_speech <= 0.6 and logprob >= -1.0").select("event_id")
