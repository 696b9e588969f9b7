"""Every registered query runs, and equals its SQL where it has one."""

import uuid

import duckdb
import pytest

from quillwork.operators.retrieval import shared_folder
from quillwork.plans import REGISTRY

from .compare import connection, difference


@pytest.fixture(scope="session")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if q.sql))
def test_equals_sql(spark, sf, con, name):
    found = REGISTRY[name]
    assert difference(found.run(spark, sf), con, found.sql) is None


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if not q.sql))
def test_runs(spark, sf, name):
    df = REGISTRY[name].run(spark, sf)
    assert len(df.columns) == len(set(df.columns))
    assert df.count() >= 0


def ran(spark, name, table, data, schema):
    """The rows of a query over one small table."""
    folder = f"{shared_folder(spark)}/small-{uuid.uuid4().hex}"
    spark.createDataFrame(data, schema).write.parquet(f"{folder}/{table}.parquet")
    return sorted(tuple(r) for r in REGISTRY[name].run(spark, folder).collect())


def test_queries_read_all_rows(spark):
    lines = [(k, 1, 10.0, "A") for k in (1, 299, 300, 70000)]
    found = ran(spark, "positioned_words", "lineitem", lines, "l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string")
    assert [r[0] for r in found] == [1, 299, 300, 70000]
    events = [(1, 7), (2, 0), (6, 1006), (29000, 5), (29001, 5), (40000, 0)]
    found = ran(spark, "ref_extract_of_all_events", "events", events, "event_id long, user_id long")
    assert found == [(1, "7,1001"), (2, "1002"), (6, "1006"), (29000, "5,30000"), (29001, "5"), (40000, "")]
    names = [(k, f"Customer {k}") for k in (1000, 2, 10, 199, 200)]
    found = ran(spark, "natural_sort_of_all_names", "customer", names, "c_custkey long, c_name string")
    assert [k for (k,) in found] == [2, 10, 199, 200, 1000]


def test_queries_read_whole_texts(spark):
    docs = "doc_id long, source string, text string"
    ends = [" ".join(f"{c}{i}x" for i in range(150)) for c in "uv"]
    assert ran(spark, "near_duplicate_window", "documents", [(i, "s", "same " * 100 + e) for i, e in enumerate(ends)], docs) == [("s", 2)]
    assert ran(spark, "keyword_queries", "documents", [(1, "s", "a " * 150 + "Parliament")], docs) == [(1, "Parliament")]
    assert ran(spark, "mojibake_repair", "documents", [(1, "s", "x" * 100 + "Á")], docs) == [(1, False)]
    found = ran(spark, "packed_messages", "conversations", [(1, "user", "y" * 1500, 0)], "conv_id long, role string, text string, turn long")
    assert found == [(1, 1, 1, 1505)]


def test_references_of_larger_user_ids(spark):
    events = [(1, 7), (2, 30001), (3, 89999), (4, 99_999_998), (5, 0), (6, 1006), (20000, 5)]
    found = ran(spark, "ref_extract_dedupe", "events", events, "event_id long, user_id long")
    assert found == [(1, "7,1001"), (2, "30001,1002"), (3, "89999,1003"), (4, "99999998,1004")]


def test_labels_come_in_the_order_of_the_rules(spark):
    docs = [(1, "A license !! and a Token"), (2, "password!!"), (3, "license released, token!!"), (4, ""), (5, None)]
    found = ran(spark, "multilabel_with_veto", "documents", docs, "doc_id long, text string")
    assert found == [(1, "norm,shout,secret"), (2, "shout,secret"), (3, "shout,secret"), (4, ""), (5, "")]


def test_references_of_all_events(spark):
    """Late events, users without a number and equal numbers are rows too; what is out of range is no reference, and a null text has none known."""
    events = [(1, 0), (6, 1006), (20000, 5), (40000, 41000), (99_998_999, 7), (100_000_000, 0), (8, -3), (9, None)]
    kind = "event_id long, user_id long"
    found = ran(spark, "ref_extract_dedupe", "events", events, kind)
    assert found == [(1, "1001"), (6, "1006"), (8, "3,1008"), (9, None), (20000, "5,21000"), (40000, "41000"), (99_998_999, "7"), (100_000_000, "")]
    folder = f"{shared_folder(spark)}/small-{uuid.uuid4().hex}"
    spark.createDataFrame(events, kind).write.parquet(f"{folder}/events.parquet")
    small = duckdb.connect()
    small.execute("CREATE TABLE events (event_id BIGINT, user_id BIGINT)")
    small.executemany("INSERT INTO events VALUES (?, ?)", events)
    assert difference(REGISTRY["ref_extract_dedupe"].run(spark, folder), small, REGISTRY["ref_extract_dedupe"].sql) is None
