"""Aggregates by merged states and table functions over partitioned tables, on awkward rows."""

import datetime
import statistics

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import udfs
from tessera.functions.udfs import Sessions, mergeable_deviation
from tessera.plans.catalog import REGISTRY


def test_states_merge_to_the_whole(spark, monkeypatch):
    monkeypatch.setattr(udfs, "HELD_KEYS", 2)
    rows = [(k % 3, 1e6 + k * 0.5) for k in range(300)] + [(7, 1.5)] * 200 + [(8, 2.0), (9, None), (None, 4.0), (None, 6.0), (7, None)]
    df = spark.createDataFrame(rows, "key int, n double").repartition(6)
    got = {r["key"]: (r["n"], r["mean"], r["deviation"]) for r in mergeable_deviation(df, "key", "n").collect()}
    assert got.keys() == {0, 1, 2, 7, 8, 9, None}
    assert got[8] == (1, 2.0, None) and got[9] == (0, None, None) and got[7] == (200, 1.5, 0.0)
    for key in (0, 1, 2, None):
        own = [x for k, x in rows if k == key]
        assert got[key][0] == len(own)
        assert abs(got[key][1] - statistics.fmean(own)) < 1e-6 and abs(got[key][2] - statistics.stdev(own)) < 1e-6
    assert mergeable_deviation(df.limit(0), "key", "n").collect() == []


def test_sessions_of_awkward_rows(spark):
    t = datetime.datetime(2024, 1, 1)
    at = lambda m: t + datetime.timedelta(minutes=m)
    rows = [("a", at(0)), ("a", at(9)), ("a", at(19)), ("a", at(19)), ("a", None), ("b", at(5)), (None, at(1)), (None, at(2)), ("c", None)]
    spark.createDataFrame(rows, "who string, at timestamp_ntz").repartition(4).createOrReplaceTempView("awkward_visits")
    spark.udtf.register("tessera_sessions", F.udtf(Sessions))
    got = {tuple(r) for r in spark.sql("SELECT * FROM tessera_sessions(TABLE(awkward_visits), 10)").collect()}
    assert got == {("a", at(0), at(9), 2), ("a", at(19), at(19), 2), ("b", at(5), at(5), 1), (None, at(1), at(2), 2)}
    assert spark.sql("SELECT * FROM tessera_sessions(TABLE(SELECT * FROM awkward_visits WHERE false), 10)").collect() == []


def test_grouped_map_adds_as_sql_does(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    per_user = [(1, [29.27]), (2, [0.1, 0.7]), (3, [20.88, 16.54, 18.71]), (4, [1.1, None]), (5, [None]), (6, [2.0, float("nan")]), (7, [3.3, 3.3, 9.9])]
    rows = [(u, x) for _ in range(60) for u, own in per_user for x in own]
    df = spark.createDataFrame([(k, t, u, x) for k, (u, x) in enumerate(rows)], "event_id long, ts timestamp_ntz, user_id long, value double")
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: r["above"] for r in REGISTRY.queries["udf_grouped_map"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute("SET threads = 1")
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    expected = {r[1]: r[2] for r in c.execute(REGISTRY.oracle["udf_grouped_map"]).fetchall()}
    assert got == expected and len(got) == len(rows)


def sql_of_grouped_map(path) -> dict:
    c = duckdb.connect()
    c.execute("SET threads = 1")
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/events.parquet/*.parquet')")
    return {r[1]: (r[0], r[2]) for r in c.execute(REGISTRY.oracle["udf_grouped_map"]).fetchall()}


def test_grouped_map_adds_in_the_order_of_the_files(spark, tmp_path):
    # of these three values one equals the mean, and the order of the sum decides whether it is above
    t = datetime.datetime(2024, 1, 1)
    orders = [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]
    rows = [(10 * u + k, t, u, (20.88, 16.54, 18.71)[k]) for u, order in enumerate(orders) for k in order]
    rows = [r for k in range(3) for r in rows[k::3]]
    for part in range(3):
        df = spark.createDataFrame(rows[6 * part : 6 * part + 6], "event_id long, ts timestamp_ntz, user_id long, value double").coalesce(1)
        df.write.parquet(f"{tmp_path}/parts/{part}")
        (tmp_path / "events.parquet").mkdir(exist_ok=True)
        next((tmp_path / "parts" / str(part)).glob("*.parquet")).rename(tmp_path / f"events.parquet/{part}.parquet")
    got = {r["event_id"]: (r["user_id"], r["above"]) for r in REGISTRY.queries["udf_grouped_map"](spark, str(tmp_path)).collect()}
    assert got == sql_of_grouped_map(tmp_path) and len(got) == len(rows)
    assert {got[10 * u + 2][1] for u in range(len(orders))} == {True, False}


@pytest.mark.parametrize("call_rows", (1, 7, 1_000_000))
def test_grouped_map_of_many_groups_a_call(spark, tmp_path, monkeypatch, call_rows):
    monkeypatch.setattr(udfs, "CALL_ROWS", call_rows)
    t = datetime.datetime(2024, 1, 1)
    users, values = [1, 2, None, 2**53, 2**53 + 1], [0.1, 0.7, None, float("nan"), float("inf"), -0.0, 1e308, 20.88]
    rows = [(k, None if k % 11 == 0 else t + datetime.timedelta(hours=7 * (k % 13)), users[k % 5], values[k * k % 7 if k % 5 else k % 8]) for k in range(400)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double")
    df.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    found = REGISTRY.queries["udf_grouped_map"](spark, str(tmp_path))
    got = {r["event_id"]: (r["user_id"], r["above"]) for r in found.collect()}
    assert got == sql_of_grouped_map(tmp_path) and len(got) == len(rows)
    df.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
    assert REGISTRY.queries["udf_grouped_map"](spark, str(tmp_path)).collect() == []


def test_grouped_map_makes_few_calls(spark, tmp_path):
    # the groups of the call are slices of rows, not the 20,000 users' days
    df = spark.range(20_000).selectExpr("id AS event_id", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts", "id AS user_id", "double(id) AS value")
    df.write.parquet(f"{tmp_path}/events.parquet")
    found = REGISTRY.queries["udf_grouped_map"](spark, str(tmp_path))
    assert found.count() == 20_000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow [call#" in plan
