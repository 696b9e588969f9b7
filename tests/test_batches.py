"""Python workers read batches of bounded bytes and rows, whatever the session had before."""

import pytest

from quillwork.operators import judging, suppression
from quillwork.sources import parsers, publish

BYTES, ROWS = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("name", ["parsed", "recognised", "packed", "suppressed"])
def test_batches_are_bounded(spark, name):
    spark.conf.set(BYTES, "64m")
    spark.conf.set(ROWS, "10000")
    docs = spark.createDataFrame([(1, "a", "x y " * 5000), (2, "a", None)], "k long, s string, t string")
    if name == "parsed":
        assert parsers.parsed(docs, "k", "t", lambda t: ((w,) for w in t.split()), "w string").count() == 10000
    elif name == "recognised":
        assert judging.recognised(docs, "k", "t", judging.stub_recogniser(1)).count() == 10000
    elif name == "packed":
        assert publish.packed_messages(docs, "s", "k", "t", ["k"]).count() == 2
    else:
        words = docs.selectExpr("k", "s", "k as at", "split(t, ' ') as w")
        assert suppression.unlike_recent(words, "s", "at", "k", "w", 10).count() == 2
    assert (spark.conf.get(BYTES), spark.conf.get(ROWS)) == ("8m", "2000")
