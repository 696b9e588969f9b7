"""The pipeline's stages, one after the other, against brute force on the smallest tables."""

from pyspark.sql import functions as F

import corpus_pipeline
from quillwork.llm import decontaminate, jaccard, secrets
from quillwork.llm.common import table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns, rest = docs.columns, docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = rest
        rest = stage(spark, rest, sf)
        if name != "packing":
            assert rest.columns == columns
            assert rest.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
        if name == "quality":
            labels = table(spark, sf, "labels")
            kept = rest.select("doc_id", F.lit(True).alias("kept"))
            said = labels.join(kept, "doc_id", "left").groupBy("quality").agg(F.avg(F.coalesce("kept", F.lit(False)).cast("int")).alias("share")).collect()
            share = {r.quality: r.share for r in said}
            assert share[1] > 0.95 and share[0] < 0.1
        if name == "near_duplicates":
            again = jaccard.components(rest, shingle=5, percent=80)
            assert again.where("doc_id <> component_id").count() == 0
        if name == "decontamination":
            found = decontaminate.find(rest, table(spark, sf, "benchmark"), keep=["doc_id"])
            assert found.where(decontaminate.contaminated(decontaminate.hits(), F.col("n_words"))).count() == 0
        if name == "secrets":
            assert secrets.scan(rest, limits=secrets.thresholds(before)).where("size(spans) > 0").count() == 0
            assert rest.count() == before.count()
        if name == "packing":
            tokens = rest.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"))
            assert tokens.where("n <> m").count() == 0 and tokens.count() == before.count()


def test_stages_take_any_rows(spark, sf):
    """Nulls in any column, empty texts, repeated rows, columns whose names the stages use, and empty tables."""
    kind = "doc_id long, text string, n_chars int, score double, quality_score int, spans string, secret_spans string, d1 int, row1 int"
    prose = table(spark, sf, "documents").where("length(text) > 400").orderBy("doc_id").limit(6).collect()
    rows = [(r.doc_id, r.text, len(r.text), 0.5, 7, "own", "own", 1, 2) for r in prose]
    secret = "a line with password=hunter2hunter2 in it"
    rows += [(901, secret, len(secret), None, 7, "own", "own", 1, 2), (None, None, None, None, 7, "own", "own", None, None), (902, "", 0, None, 7, "own", "own", None, None), (902, "", 0, None, 7, "own", "own", None, None)]
    docs = spark.createDataFrame(rows, kind)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        found = out.collect()
        assert all(r.quality_score == 7 and r.spans == r.secret_spans == "own" for r in found)
        assert all(r.n_chars == len(r.text) for r in found if r.text is not None)
        if name != "quality":
            assert sorted(str(r.doc_id) for r in found if not r.text) == ["902", "902", "None"]
        if name == "secrets":
            assert [r.text for r in found if r.doc_id == 901] == ["a line with [SECRET] in it"]
        assert stage(spark, docs.limit(0), sf).count() == 0
    pieces = corpus_pipeline.packed(spark, docs, sf).where("doc_id = 902 or doc_id is null").collect()
    assert [(p.start, p.length) for p in pieces] == [(0, 1)] * 3


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0 and corpus_pipeline.ORACLE_SQL is None
