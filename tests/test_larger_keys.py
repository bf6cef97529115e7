"""Queries on rows that the test tables lack: requests without a schedule, keys beyond a million, ties."""

import datetime

import duckdb
from pyspark.sql import functions as F

from waymark.catalogue_parts import analytics, details
from waymark.functions import text
from waymark.operators import terrain


def test_capped_combos_of_a_request_without_any(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 9)
    events = [(0, at, 0), (2, at, 1), (24, at, 0), (26, at, 0)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in details.capped_combos(spark, str(tmp_path)).collect()}
    assert got == {(0, True, 0, None), (1, True, 2, "26")}


def test_count_label_beyond_a_long(spark, tmp_path):
    orders = [(10**7, 10**6), (3, 4), (0, 9), (36_000_000, 899_999)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = dict(analytics.count_label(spark, str(tmp_path)).collect())
    assert got == {10**7: "10000경", 3: "45", 0: "0", 36_000_000: "116640경"}


def test_count_label_keeps_every_digit(spark):
    rows = spark.createDataFrame([(99999999999999999,), (9999,), (10000,), (1099999,), (-20000,), (None,)], "n long")
    assert [r[0] for r in rows.select(text.count_label(F.col("n"))).collect()] == ["9.9경", "9999", "1만", "109만", "-20000", None]


def test_entrance_numbers_by_key_where_places_tie(spark, tmp_path):
    suppliers = [(k * 485, 1, 5.0) for k in range(200)]
    spark.createDataFrame(suppliers[::-1], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    got = sorted((r.no, r.s_suppkey) for r in details.entrance_numbers(spark, str(tmp_path)).collect())
    assert [k for _, k in got] == [k * 485 for k in range(200)] and [n for n, _ in got] == list(range(1, 201))


def test_entrance_numbers_of_odd_suppliers(spark, tmp_path):
    """Nulls, NaN and heights beyond a long stand where the SQL has them."""
    inf, nan = float("inf"), float("nan")
    heights = {1: None, 2: nan, 3: inf, 4: -inf, 6: 1e19, 7: 2e19, 8: 3.5, 9: 2e9, 11: 1e9, 12: -0.5, 13: 0.2, 14: -3e19, 16: -2e19, 5: 7.0, 10: None, -7: 3.9, -5: 8.0, None: 4.0}
    suppliers = [(k, 1, h) for k, h in heights.items()] + [(None, 2, 1.0), (21, None, 5.0), (22, None, None)]
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    got = [tuple(r) for r in details.entrance_numbers(spark, str(tmp_path)).collect()]
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    assert sorted(got, key=str) == sorted(duck.execute(details.ORACLE_SQL["entrance_numbers"]).fetchall(), key=str)


def test_chunk_times_of_points_at_one_time(spark):
    """The nearest point comes first, whatever the order of the rows, and only the three columns are moved."""
    rows = [("a", 0.0, 0.0, "x"), ("a", 10.0, 100.0, "x"), ("a", 10.0, 60.0, "x")]
    df = terrain.chunk_times(spark.createDataFrame(rows, "who string, t double, s double, other string").coalesce(1))
    assert [(r.chunk, round(r.seconds, 6)) for r in df.orderBy("chunk").collect()] == [(0, 8.333333), (1, 1.666667)]
    assert "other" not in next(line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FlatMapGroupsInPandas" in line)


def test_chunk_times_between_two_points(spark):
    """Clock times of this century add no noise to the seconds, and a task sends a walk's points together."""
    rows = [("a", 1704067211.0, 1 / 3), ("a", 1704067211.0 + 3339, 1 / 3 + 4500), ("b", 1704067211.0, 7.0), ("c", 5.0, 0.0), ("c", 15.0, 20.0), ("c", 15.0, 60.0), ("c", 115.0, 160.0)]
    df = terrain.chunk_times(spark.createDataFrame(rows, "who string, t double, s double"))
    got = df.orderBy("who", "chunk").collect()
    assert [r.chunk for r in got if r.who == "a"] == list(range(90)) and {round(r.seconds, 9) for r in got if r.who == "a"} == {37.1}
    assert [(r.chunk, r.from_s, r.to_s, r.seconds) for r in got if r.who == "b"] == [(0, 7.0, 7.0, 0.0)]
    assert [(r.chunk, r.from_s, r.to_s, round(r.seconds, 9)) for r in got if r.who == "c"] == [(0, 0.0, 50.0, 10.0), (1, 50.0, 100.0, 40.0), (2, 100.0, 160.0, 60.0)]
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "Sort [who" in plan[plan.index("FlatMapGroupsInPandas") :]
