"""Items leave a parser in pieces of a bounded size."""

from quillwork.sources import parsers


def test_items_leave_in_pieces(spark, monkeypatch):
    sizes = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(k, " ".join(str(k) for _ in range(300))) for k in range(40)], "k long, t string").coalesce(1)
    keep = type(df).mapInPandas

    def wrapped(self, inner, schema):
        def outer(batches):
            for piece in inner(batches):
                sizes.add(int(len(piece) > 2000))
                yield piece

        return keep(self, outer, schema)

    monkeypatch.setattr(type(df), "mapInPandas", wrapped)
    found = parsers.parsed(df, "k", "t", lambda t: ((w,) for w in t.split()), "w string")
    rows = sorted(map(tuple, found.collect()))
    assert rows == [(k, i, str(k)) for k in range(40) for i in range(300)]
    assert sizes.value == 0
