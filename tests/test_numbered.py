"""Numbers over so many rows that what Spark samples of them for ranges differs from plan to plan."""

import os

import duckdb
from pyspark.sql import functions as F

from tidewater.operators import catalog
from tidewater.plans import registry

DATA = "/root/testdata/sf0.01"


def equal_to_sql(spark, name):
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.sql(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{t}')")
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = lambda r: sorted(tuple(map(str, x)) for x in r)
    return rows(df.select(*cols).collect()) == rows(c.sql(f"select {', '.join(cols)} from ({registry.ORACLES[name]})").fetchall())


def test_custom_records(spark):
    assert equal_to_sql(spark, "custom_records")


def test_numbers_are_gapless_and_in_order(spark):
    d = spark.range(0, 20_000, 1, 3).select("id", F.when(F.col("id") % 5 != 0, F.pmod(F.hash("id"), F.lit(3000))).alias("x"), F.when(F.col("id") % 7 != 0, (F.col("id") % 50).cast("string")).alias("y"))
    rows = sorted(catalog.numbered(d, [F.col("x"), F.collate(F.col("y"), "UNICODE")], "nth").collect(), key=lambda r: r.nth)
    assert [r.nth for r in rows] == list(range(20_000)) and {r.id for r in rows} == set(range(20_000))
    order = [((r.x is not None, r.x or 0), (r.y is not None, r.y or "")) for r in rows]  # nulls first; equal rows in any order
    assert order == sorted(order)
    assert catalog.numbered(d.filter("id < 0"), [F.col("x")], "nth").collect() == []
    assert sorted(r.nth for r in catalog.numbered(d.withColumn("x", F.lit(1)), [F.col("x")], "nth").select("nth").collect()) == list(range(20_000))


def test_storage_namespaces(spark):
    assert equal_to_sql(spark, "storage_namespaces")


def test_option_order(spark):
    assert equal_to_sql(spark, "option_order")


def test_option_order_of_odd_labels(spark, tmp_path, monkeypatch):
    """No labels, and such as locales order in another way than the SQL's bytes."""
    label = "CASE c_custkey % 13 WHEN 0 THEN NULL WHEN 1 THEN lower(c_mktsegment) WHEN 2 THEN '' WHEN 3 THEN 'Ärger' WHEN 4 THEN 'zebra' WHEN 5 THEN 'a-b' WHEN 6 THEN 'e' || chr(769) WHEN 7 THEN 'é' WHEN 8 THEN '😀' WHEN 9 THEN chr(65533) ELSE c_mktsegment END"
    duckdb.sql(f"copy (select * replace ({label} as c_mktsegment, nullif(c_custkey, 28) as c_custkey) from read_parquet('{DATA}/customer.parquet')) to '{tmp_path}/customer.parquet' (format parquet)")
    monkeypatch.setitem(globals(), "DATA", str(tmp_path))
    assert equal_to_sql(spark, "option_order")


def test_options_in_locale_order(spark):
    d = spark.createDataFrame([(0, "b"), (1, None), (2, "B"), (3, "a-b"), (4, "Ä"), (None, "b"), (5, "b"), (6, "")], "seq long, label string")
    assert [r.seq for r in catalog.options(d).orderBy("ordinal").collect()] == [6, 4, 3, 0, 5, None, 2, 1]


def test_storage_namespaces_of_odd_events(spark, tmp_path, monkeypatch):
    """No ids, negative ones and ids of several events."""
    key = "CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 97 = 0 THEN -event_id WHEN event_id % 89 = 0 THEN 7 ELSE event_id END"
    user = "CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 11 = 0 THEN -user_id WHEN event_id % 89 = 0 THEN 3 ELSE user_id END"
    duckdb.sql(f"copy (select * replace ({key} as event_id, {user} as user_id) from read_parquet('{DATA}/events.parquet')) to '{tmp_path}/events.parquet' (format parquet)")
    monkeypatch.setitem(globals(), "DATA", str(tmp_path))
    assert equal_to_sql(spark, "storage_namespaces")
