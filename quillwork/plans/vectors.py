"""Queries over vectors, ranking, clustering and models."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillwork.functions import values
from quillwork.operators import cells as C
from quillwork.operators import events as E
from quillwork.operators import greedy as G
from quillwork.operators import learning as L
from quillwork.operators import postings as P
from quillwork.operators import relational as R
from quillwork.operators import retrieval as V
from quillwork.session import table

from .registry import query
from .texts import fold_sql, words_sql

COS = "list_cosine_similarity({}::DOUBLE[], {}::DOUBLE[])"


@query("F22", f"SELECT a.vec_id, round({COS.format('a.embedding', 'b.embedding')}, 5) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - 1")
def cosine_of_neighbours(spark, sf):
    a = table(spark, sf, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(values.cosine("embedding", "other"), 5).alias("score"))


@query("V2", f"""SELECT query_id, vec_id, rank FROM (SELECT q.vec_id AS query_id, x.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS.format('q.embedding', 'x.embedding')} DESC, x.vec_id) AS rank
    FROM embeddings q JOIN embeddings x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0 AND x.label <> 3) WHERE rank <= 5""")
def cosine_topk(spark, sf):
    rows = table(spark, sf, "embeddings")
    out = V.nearest(rows.where("vec_id % 20 = 0"), rows.where("label <> 3"), 5)
    return out.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


@query("V2", f"""SELECT query_id, vec_id, rank FROM (SELECT q.vec_id AS query_id, x.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS.format('q.embedding', 'x.embedding')} DESC, x.vec_id) AS rank
    FROM embeddings q JOIN embeddings x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0 AND x.label IN (1, 4)) WHERE rank <= 5""")
def filtered_nearest(spark, sf):
    """Neighbours with two labels over a stored index of cells, all of them probed; only those labels' partitions are read."""
    rows = table(spark, sf, "embeddings")
    folder = f"{V.shared_folder(spark)}/cells-{uuid.uuid4().hex}"
    C.build(rows, folder, "vec_id", "embedding", ["label"])
    found = C.search(spark, folder, rows.where("vec_id % 20 = 0"), 5, "vec_id", "embedding", F.col("label").isin(1, 4))
    return found.select(F.col("vec_id").alias("query_id"), F.col("key").alias("vec_id"), F.col("rank").cast("long").alias("rank"))


@query("V5 A20", f"""SELECT e.vec_id, p.label AS profile, round(max({COS.format('e.embedding', 'p.embedding')}), 5) AS affinity FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id < 12) p GROUP BY 1, 2""")
def affinity_max_fragment(spark, sf):
    rows = table(spark, sf, "embeddings")
    fragments = rows.where("vec_id < 12").select(F.col("label").alias("profile"), F.col("embedding").alias("fragment"))
    out = V.affinity(rows, fragments, "vec_id", "profile", "embedding", "fragment")
    return out.withColumn("affinity", F.round("affinity", 5))


@query("V3", """WITH t AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]+', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: w <> '') AS w FROM documents WHERE regexp_matches(text, '^[\\x00-\\x7F]*$')),
    s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t), f AS (SELECT doc_id, term, len(list_filter(w, lambda x: x = term)) AS tf, len(w) AS size FROM t, (VALUES ('the'), ('of')) q(term)),
    d AS (SELECT term, count(*) AS df FROM f WHERE tf > 0 GROUP BY 1)
    SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM f JOIN d USING (term), s WHERE tf > 0 GROUP BY 1 HAVING count(*) = 2""")
def bm25_scores(spark, sf):
    docs = table(spark, sf, "documents").where(F.col("text").rlike(r"^[\x00-\x7F]*$"))
    return V.bm25(docs, "doc_id", {"text": 1.0}, ["the", "of"]).withColumn("score", F.round("score", 6))


@query("V3 V4 D15")
def hybrid_rrf(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    words = V.bm25(docs, "doc_id", {"source": 3.0, "text": 1.0}, ["the", "of"])
    words = _ranked(words)
    vectors = docs.select("doc_id", V.hashed_vector(F.col("text")).alias("v"))
    probe = vectors.where("doc_id = 1").select(F.col("v").alias("q"))
    near = vectors.crossJoin(F.broadcast(probe)).select("doc_id", F.coalesce(values.cosine("v", "q"), F.lit(0.0)).alias("score"))  # one query row
    return V.fused(words, _ranked(near), "doc_id").orderBy(F.desc("score"), F.col("ra").asc_nulls_last(), "doc_id").limit(20)


def _ranked(df, most: int = 40):
    """The best rows of a list with their rank: a top-k, so the numbering sees `most` rows only."""
    from pyspark.sql import Window

    best = df.orderBy(F.desc("score"), "doc_id").limit(most)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id"))).select("doc_id", "rank")


@query("V3 V6", f"""WITH d AS (SELECT CASE WHEN doc_id % 7 = 3 THEN NULL WHEN doc_id % 5 = 0 THEN source ELSE text END AS t FROM documents),
    w AS (SELECT DISTINCT row_number() OVER () AS r, list_filter(string_split({words_sql("coalesce(t, '')")}, ' '), lambda x: x <> '') AS ws FROM d)
    SELECT term, count(*) AS df FROM (SELECT DISTINCT r, unnest(ws) AS term FROM w) GROUP BY 1""")
def maintained_postings(spark, sf):
    """Document frequencies of stored postings after inserts, updates and deletes."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    folder = f"{V.shared_folder(spark)}/postings-{uuid.uuid4().hex}"
    P.build(docs.where("doc_id % 9 <> 0"), folder, "doc_id", "text")
    said = F.when(F.col("doc_id") % 7 == 3, F.lit(None)).when(F.col("doc_id") % 5 == 0, F.col("source")).otherwise(F.col("text"))
    changes = docs.where("doc_id % 9 = 0 or doc_id % 7 = 3 or doc_id % 5 = 0").select("doc_id", said.alias("text"), F.col("doc_id").alias("at"))
    P.change(spark, folder, changes, "doc_id", "text", "at")
    return P.read(spark, folder, part="df").select("term", "df")


QUESTION_WORDS = "list_distinct(list_filter(string_split({}, ' '), lambda w: w <> ''))".format(words_sql("text"))


@query("N24 V3 V4 D15", rf"""WITH docs AS (SELECT doc_id, source, lang, text, list_filter(string_split({words_sql("coalesce(text, '')")}, ' '), lambda w: w <> '') AS ws FROM documents),
    s AS (SELECT count(*) AS docs, avg(len(ws)) AS mean FROM docs), ask AS (SELECT item_id, unnest({QUESTION_WORDS}) AS term FROM benchmark),
    t AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM docs) WHERE term IN (SELECT term FROM ask) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
    g AS (SELECT doc_id, term, ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)) AS gain FROM t JOIN f USING (term), s),
    b AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rw FROM (SELECT item_id, doc_id, round(sum(gain), 9) AS score FROM ask JOIN g USING (term) GROUP BY 1, 2) QUALIFY rw <= 40),
    m AS (SELECT q.vec_id AS item_id, x.vec_id AS doc_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS.format('q.embedding', 'x.embedding')} DESC, x.vec_id) AS rm
      FROM embeddings q JOIN benchmark ON item_id = q.vec_id JOIN embeddings x ON x.vec_id <> q.vec_id JOIN docs ON docs.doc_id = x.vec_id QUALIFY rm <= 40),
    r AS (SELECT coalesce(b.item_id, m.item_id) AS item_id, coalesce(b.doc_id, m.doc_id) AS doc_id, rw, rm FROM b FULL JOIN m ON b.item_id = m.item_id AND b.doc_id = m.doc_id),
    o AS (SELECT r.*, '- [' || coalesce(lang, '?') || ' · ' || doc_id // 10 || '] ' || coalesce(source, '') AS line, row_number() OVER (PARTITION BY item_id ORDER BY round(coalesce(1 / (60 + rw), 0) + coalesce(1 / (60 + rm), 0), 12) DESC, rw NULLS LAST, doc_id) AS place
      FROM r JOIN docs USING (doc_id) WHERE doc_id <> item_id AND source IS DISTINCT FROM 'src' || item_id % 20)
    SELECT item_id, doc_id, place::INT AS place, CASE WHEN rm IS NULL THEN 'words' WHEN rw IS NULL THEN 'meaning' ELSE 'both' END AS source, line FROM o WHERE place <= 8""")
def related_documents(spark, sf):
    """For every benchmark item as a question, the documents related to it by words and by meaning."""
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    asked = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("asked"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("url"))
    asked = asked.join(vectors.withColumnRenamed("vec_id", "item_id"), "item_id", "left")
    docs = table(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("url"), F.col("lang").alias("kind"), F.floor(F.col("doc_id") / 10).alias("date"), F.col("source").alias("title"))
    docs = docs.join(vectors.withColumnRenamed("vec_id", "doc_id"), "doc_id", "left")
    return V.context(asked, docs, 8, query="item_id", key="doc_id")


PAIRS = f"""SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id AND abs(a.vec_id // 50 - b.vec_id // 50) <= 1 AND a.vec_id % 3 <> b.vec_id % 3
    WHERE {COS.format('a.embedding', 'b.embedding')} >= 0.2"""


def banded(spark, sf):
    rows = table(spark, sf, "embeddings").withColumns({"day": F.floor(F.col("vec_id") / 50), "source": F.col("vec_id") % 3})
    return V.banded_pairs(rows, "vec_id", "embedding", ["label"], "day", 1, 0.2, ["source"])


@query("J13 V11", PAIRS)
def constrained_pairs(spark, sf):
    return banded(spark, sf).select("a", "b")


@query("V12", f"""WITH RECURSIVE p AS ({PAIRS}), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r(node, other) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other)
    SELECT node, min(other) AS component FROM r GROUP BY 1""")
def event_components(spark, sf):
    return V.components(banded(spark, sf))


def leaders_sql(least: float) -> str:
    """The loop over sorted rows as a recursion, block by block, that carries the leaders."""
    return f"""e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
    r AS (SELECT label, n, vec_id, vec_id AS leader, [{{'k': vec_id, 'v': v}}] AS heads FROM e WHERE n = 1
      UNION ALL SELECT label, n, vec_id, coalesce(f[1].k, vec_id), CASE WHEN len(f) = 0 THEN list_append(heads, {{'k': vec_id, 'v': v}}) ELSE heads END
      FROM (SELECT e.*, r.heads, list_filter(r.heads, lambda h: list_cosine_similarity(h.v, e.v) >= {least}) AS f FROM r JOIN e ON e.label = r.label AND e.n = r.n + 1))"""


@query("V10", f"WITH RECURSIVE {leaders_sql(0.25)} SELECT label, vec_id, leader FROM r")
def leader_clusters(spark, sf):
    return G.leaders(table(spark, sf, "embeddings"), "label", ["vec_id"], "vec_id", "embedding", 0.25)


def stories(spark, sf):
    """Documents as items of one day in 25, their texts as headlines, a third of them under a norm's number."""
    number = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" DS "), (200 + F.col("doc_id") % 2).cast("string"), F.lit("-2026-EF"))).otherwise("")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("k"), F.concat(F.coalesce("text", F.lit("")), number).alias("title"), "source", F.floor(F.col("doc_id") / 25).alias("day"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("k"), F.col("embedding").alias("v"))
    said = table(spark, sf, "labels").select(F.col("doc_id").alias("k"), (F.col("quality") == 1).alias("important"))
    return docs.join(vectors, "k", "left").join(said, "k", "left")


def story_verdicts(spark, sf):
    """Verdicts of a person and of a model on a document and the next one."""
    return table(spark, sf, "labels").where("doc_id % 4 = 0").select(
        F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"), F.explode(F.array(
            F.struct((F.col("toxic") == 0).alias("same"), F.lit("model").alias("by")), F.struct(F.when(F.col("doc_id") % 8 == 0, F.col("quality") == 1).alias("same"), F.lit("person").alias("by")),
        )).alias("s")).select("a", "b", "s.*")


STORIES = rf"""i AS (SELECT d.doc_id AS k, coalesce(text, '') || CASE WHEN d.doc_id % 3 = 0 THEN ' DS ' || (200 + d.doc_id % 2) || '-2026-EF' ELSE '' END AS title, source, d.doc_id // 25 AS day, embedding::DOUBLE[] AS v, coalesce(quality = 1, false) AS important
      FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id),
    w AS (SELECT k, list_distinct(regexp_extract_all({fold_sql(r"regexp_replace(title, '\s+[-|–—]\s+[^-|–—]{2,60}\z', '')")}, '[\p{{L}}\p{{N}}_]{{4,}}')) AS ws, regexp_extract_all(title, '\b\d{{1,6}}-\d{{4}}(?:-[A-Z]+)?\b') AS norms FROM i),
    t AS (SELECT k, unnest(ws) AS t FROM w WHERE len(ws) >= 3),
    shared AS (SELECT x.k AS a, y.k AS b, count(*) AS n FROM t x JOIN t y ON x.t = y.t AND x.k < y.k GROUP BY 1, 2),
    titled AS (SELECT a, b FROM shared JOIN w wa ON wa.k = a JOIN w wb ON wb.k = b WHERE 10 * n >= 6 * (len(wa.ws) + len(wb.ws) - n)),
    near AS (SELECT x.k AS a, y.k AS b FROM i x JOIN i y ON x.k < y.k AND abs(x.day - y.day) <= 1 AND x.important AND y.important AND x.source IS DISTINCT FROM y.source WHERE {COS.format('x.v', 'y.v')} >= 0.4),
    said AS (SELECT doc_id AS a, doc_id + 1 AS b, coalesce(CASE WHEN doc_id % 8 = 0 THEN quality = 1 END, toxic = 0) AS same FROM labels WHERE doc_id % 4 = 0 AND doc_id + 1 IN (SELECT k FROM i)),
    pairs AS (SELECT a, b FROM said WHERE same UNION
      SELECT p.a, p.b FROM (SELECT * FROM titled UNION SELECT * FROM near) p LEFT JOIN said USING (a, b) JOIN w wa ON wa.k = p.a JOIN w wb ON wb.k = p.b WHERE same IS NULL AND NOT (len(wa.norms) > 0 AND len(wb.norms) > 0 AND NOT list_has_any(wa.norms, wb.norms))),
    e AS (SELECT a, b FROM pairs JOIN i x ON x.k = a JOIN i y ON y.k = b WHERE x.important OR y.important), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"""


@query("V11 V12 V14 T21", f"""WITH RECURSIVE {STORIES}, r(k, other) AS (SELECT k, k FROM i UNION SELECT r.k, b FROM r JOIN both_ways ON a = r.other)
    SELECT r.k, min(other) AS event FROM r JOIN i ON i.k = r.other WHERE i.important GROUP BY 1""")
def story_groups(spark, sf):
    """Documents on one event: verdicts first, then norms, then headlines, then vectors; groups without an important one go."""
    items = stories(spark, sf)
    links = E.linked_pairs(items, story_verdicts(spark, sf), least_vector=0.4)
    return E.event_groups(items, links)


@query("V6", """SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'insert' WHEN doc_id % 5 = 0 THEN 'update' ELSE 'same' END AS change FROM documents""")
def index_maintenance(spark, sf):
    from quillwork.functions.text import content_id
    from quillwork.operators.cdc import compared

    docs = table(spark, sf, "documents").select("doc_id", content_id("text").alias("hash"))
    held = docs.where("doc_id % 9 <> 0").withColumn("hash", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("hash")))
    return compared(held, docs, ["doc_id"], ["hash"]).select("doc_id", "change")


@query("V9", """SELECT kind, count(*) AS n FROM (SELECT 'document' AS kind FROM documents UNION ALL SELECT 'page' FROM pages UNION ALL SELECT 'item' FROM benchmark) GROUP BY 1""")
def heterogeneous_corpus(spark, sf):
    rows = [table(spark, sf, t).select(F.lit(k).alias("kind"), F.concat_ws("_", F.lit(k), F.col(i).cast("string")).alias("key"), F.col(x).alias("text"))
            for k, t, i, x in (("document", "documents", "doc_id", "text"), ("page", "pages", "page_id", "html"), ("item", "benchmark", "item_id", "text"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("kind").agg(F.count("*").alias("n"))


@query("V1")
def hashed_embedding(spark, sf):
    rows = table(spark, sf, "benchmark").select("item_id", V.hashed_vector(F.col("text")).alias("v"))
    return rows.select("item_id", F.round(values.dot("v", "v"), 6).alias("norm"))


@query("M1 M2 M3")
def validated_topics(spark, sf):
    """Every document's language as a model says that has not seen its fold, with the next likeliest."""
    out = L.validated(table(spark, sf, "documents"), "text", "lang", "doc_id", k=3, most=2, features=512, rounds=8)
    label = lambda i: F.try_element_at("top", F.lit(i))
    return out.select("doc_id", "lang", "fold", label(1)["label"].alias("said"), F.round(label(1)["p"], 3).alias("confidence"), label(2)["label"].alias("next"))


@query("M1 A16", """WITH s AS (SELECT lang AS t, CASE WHEN regexp_matches(text, '(^|[^\\p{L}])the($|[^\\p{L}])') THEN 'en' WHEN regexp_matches(text, '(^|[^\\p{L}])und($|[^\\p{L}])') THEN 'de' WHEN regexp_matches(text, '(^|[^\\p{L}])que($|[^\\p{L}])') THEN 'es' END AS s FROM documents WHERE lang IS NOT NULL),
    l AS (SELECT label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (SELECT t AS label, (t = s)::INT AS tp, 0 AS fp, (s IS NULL OR t <> s)::INT AS fn FROM s UNION ALL SELECT s, 0, (t <> s)::INT, 0 FROM s WHERE s IS NOT NULL) GROUP BY 1),
    r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS "precision", CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, tp + fn AS support FROM l),
    a AS (SELECT * FROM r UNION ALL SELECT 'macro', sum(tp), sum(fp), sum(fn), avg("precision"), avg(recall), avg(f1), sum(support) FROM r
      UNION ALL SELECT 'weighted', sum(tp), sum(fp), sum(fn), sum("precision" * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM r)
    SELECT label, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM a""")
def topic_report(spark, sf):
    """Precision, recall and F1 of a rule, by label and as macro and weighted means."""
    says = lambda w, label: F.when(F.col("text").rlike(rf"(^|[^\p{{L}}]){w}($|[^\p{{L}}])"), label)
    rows = table(spark, sf, "documents").select("lang", F.coalesce(says("the", "en"), says("und", "de"), says("que", "es")).alias("said"))
    out = L.report(rows, "lang", "said")
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("M3")
def ml_topic_predict(spark, sf):
    docs = table(spark, sf, "benchmark").select("item_id", "text").withColumn("topic", F.when(F.length("text") > 200, "long").otherwise("short"))
    model = L.train_topics(docs, "text", "topic", features=256, rounds=5)
    return L.predicted(model, docs.select("item_id", "text"), "text").select("item_id", "topic", F.round("confidence", 3).alias("confidence"))


@query("M2", "SELECT lang, f::INT AS fold, (n + 4 - f) // 5 AS n FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1), (VALUES (0), (1), (2), (3), (4)) t(f) WHERE n > f")
def stratified_folds(spark, sf):
    return L.folds(table(spark, sf, "documents"), "lang", "doc_id").groupBy("lang", "fold").agg(F.count("*").alias("n"))


@query("M4", """SELECT doc_id, coalesce(CASE WHEN quality = 0 THEN 'manual' END, CASE WHEN (doc_id % 10) / 10 >= 0.5 THEN 'model' END, 'keywords') AS topic FROM documents LEFT JOIN labels USING (doc_id)""")
def cascaded_classifier(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    topic = L.cascade(F.when(F.col("quality") == 0, "manual"), F.lit("model"), (F.col("doc_id") % 10) / 10, F.lit("keywords"))
    return rows.select("doc_id", topic.alias("topic"))


@query("M6")
def pair_judge(spark, sf):
    """Every vector's pairs with the six nearest, judged by a model trained on labelled ones, if it beats the cosine threshold on held-out pairs."""
    vectors = table(spark, sf, "embeddings")
    ids = V.written(vectors.select("vec_id"), "vec-ids")  # the size of a table of its own is known: a column's is overrated beside vectors
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text").join(R.small(ids), "vec_id", "left_semi")
    rows = vectors.join(texts, "vec_id", "left")
    near = V.nearest(vectors, vectors, 6).select(F.col("query_id").alias("a"), F.col("vec_id").alias("b"))
    near = V.written(near, "near")  # the features read the pairs more than once
    V.release(spark)  # the search has sent each vector to every block
    truth = vectors.select(F.col("vec_id").alias("a"), F.col("label").alias("x"))
    other = vectors.select(F.col("vec_id").alias("b"), F.col("label").alias("y"))
    pairs = near.join(truth, "a").join(other, "b").select("a", "b", (F.col("x") == F.col("y")).alias("one"))
    told = L.pair_features(pairs, rows.withColumn("day", F.col("vec_id") / 50), "vec_id", "text", "embedding", "day")
    V.discard(near, ids)
    model, said = L.train_judge(told, "one")
    return L.judged_pairs(told, model, said["useful"]).select("a", "b", "one", "same", "by")


@query("M6", """SELECT vec_id, score >= 0.82 AS same FROM (SELECT a.vec_id, round(""" + COS.format("a.embedding", "b.embedding") + """, 9) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - 1)""")
def pair_judge_stub(spark, sf):
    """The cosine threshold that a trained judge must beat to be used."""
    a = table(spark, sf, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", (F.round(values.cosine("embedding", "other"), 9) >= 0.82).alias("same"))
