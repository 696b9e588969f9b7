"""Words of texts are made once, and what meets and is counted is read from what was written."""

import uuid

from quillwork.operators import matching as M
from quillwork.operators import postings as P
from quillwork.operators import retrieval as V
from quillwork.operators.retrieval import shared_folder


def stored(spark, rows, schema):
    folder = f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}"
    spark.createDataFrame(rows, schema).write.parquet(folder)
    return spark.read.parquet(folder), folder


def test_texts_are_read_once(spark):
    docs, folder = stored(spark, [(1, "alpha beta gamma delta"), (2, "SENATE votes"), (3, "alpha beta lorem SENATE"), (None, "alpha beta gamma"), (4, None), (5, "gamma, beta; Álpha!")], "k long, text string")
    items = spark.createDataFrame([(7, "Alpha beta gamma epsilon"), (8, "The SENATE"), (None, "alpha beta gamma")], "i long, title string")
    linked = M.linked_by_words(docs, items, "k", "text", "i", "title", least=3, letters=4, acts=["lorem"])
    assert sorted(tuple(r) for r in linked.collect()) == [(1, 7, "words", 3), (2, 8, "acronym", 1), (5, 7, "words", 3)]
    assert not any(folder in f for f in linked.inputFiles())
    both = docs.selectExpr("k", "split(text, ' ') as w"), items.selectExpr("i", "split(lower(title), ' ') as v")
    shared = M.token_overlap(both[1], both[0], "i", "k", "v", "w", 2)
    assert sorted(tuple(r) for r in shared.collect()) == [(7, 1, 3), (7, 3, 2)]
    assert not any(folder in f for f in shared.inputFiles())


def test_questions_read_documents_once(spark):
    docs, folder = stored(spark, [(1, "a b b c"), (2, "b"), (3, None), (4, ""), (5, "b, B; x")], "k long, text string")
    asked = spark.createDataFrame([(7, "b b c"), (8, None), (9, "zzz")], "q long, asked string")
    found = V.bm25_many(asked, docs, "q", "asked", "k", "text", 2)
    assert [(r.q, r.k, r.rank) for r in found.orderBy("rank").collect()] == [(7, 1, 1), (7, 2, 2)]
    assert not any(folder in f for f in found.inputFiles())


def test_words_are_counted_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, "b a b, B"), (2, ""), (3, None), (None, "a"), (4, "é e")], "k long, text string")
    found = P.of_docs(docs, "k", "text")
    assert sorted((r.key, r.term, r.tf) for r in found.collect()) == [(1, "a", 1), (1, "b", 3), (4, "e", 2)]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_bm25_splits_texts_once_for_words_and_lengths(spark):
    from quillwork.operators import retrieval

    docs = spark.createDataFrame([(1, "the law of water"), (2, "the the of"), (3, None), (4, "water")], "k long, said string")
    got = retrieval.bm25(docs, "k", {"said": 1.0}, ["the", "of"])
    assert {r.k for r in got.collect()} == {1, 2}
    assert "said#" not in got._jdf.queryExecution().optimizedPlan().toString()
