"""Cases that the given tables don't hold: nulls, ties, orphans, session edges, late events, name collisions."""

import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F

from tessera.functions.scalars import daily_counts
from tessera.operators.joins import asof_join, range_join
from tessera.operators.relational import placed, top_k_per_group
from tessera.sources.files import apply_renames, list_files, read_jdbc, rename_plan, replace_in_names, round_trip, write_jdbc
from tessera.streaming.windows import arrivals, run_in_steps, run_to_end


def at(h, m=0, us=0):
    return dt.datetime(2024, 1, 1, h, m, 0, us)


def test_asof_takes_the_last_row_at_or_before(spark):
    left = spark.createDataFrame([(1, at(1), "a"), (1, at(0), "b"), (2, at(5), "c"), (1, None, "d"), (None, at(9), "e")], "k int, ts timestamp, x string")
    right = spark.createDataFrame([(1, at(1), 10), (1, at(1), 11), (1, at(2), 12), (2, None, 13), (None, at(8), 14)], "k int, ts timestamp, v int")
    got = {r["x"]: r["v"] for r in asof_join(left, right, ["k"], "ts", ["v"]).collect()}
    assert got == {"a": 11, "b": None, "c": None, "d": None, "e": 14}  # keys are grouped, so null meets null


def test_range_join_equals_nested_loop(spark):
    points = spark.range(200).select((F.col("id") * 0.37 - 5).alias("p"))
    ranges = spark.createDataFrame([(1, -4.0, 2.5), (2, 3.0, 3.0), (3, 10.0, 47.25), (4, 5.0, 4.0)], "r int, lo double, hi double")
    got = range_join(points, F.col("p"), ranges, F.col("lo"), F.col("hi"), 3.0).select("p", "r").collect()
    want = points.crossJoin(ranges).filter("p >= lo AND p < hi").select("p", "r").collect()
    assert sorted(got) == sorted(want) and want


def test_not_in_with_null_is_empty(spark):
    spark.createDataFrame([(1,), (2,)], "k int").createOrReplaceTempView("a")
    spark.createDataFrame([(2,), (None,)], "k int").createOrReplaceTempView("b")
    assert spark.sql("SELECT * FROM a WHERE k NOT IN (SELECT k FROM b)").count() == 0


def test_top_k_with_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("a", 5, 3), (None, 1, 4)], "g string, v int, id int")
    got = top_k_per_group(df, ["g"], [F.desc_nulls_last("v"), "id"], 1).collect()
    assert sorted(r["id"] for r in got) == [2, 4]


def test_daily_counts_fill_gaps_and_leave_out_no_user(spark):
    on = lambda day: dt.datetime(2024, 2, day, 23, 59)
    rows = [(u, on(27), "signup") for u in range(1, 7)] + [(7, on(27), "view"), (8, None, "signup"), (9, dt.datetime(2024, 3, 2), "signup")]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, event_type string")
    got = [(r["day"].isoformat(), r["n"]) for r in daily_counts(df, "event_type = 'signup'").orderBy("day").collect()]
    assert got == [("2024-02-27", 6), ("2024-02-28", 0), ("2024-02-29", 0), ("2024-03-01", 0), ("2024-03-02", 1)]
    assert daily_counts(df.limit(0), "true").count() == 0


def test_all_signups_of_the_given_table_are_counted(spark):
    from tessera.plans.catalog import REGISTRY

    sf = "/root/testdata/sf0.001"
    want = spark.read.parquet(f"{sf}/events.parquet").filter("event_type = 'signup'").count()
    assert REGISTRY.queries["fn_gap_fill"](spark, sf).agg(F.sum("n")).first()[0] == want


def test_places_of_null_keys(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "P", 2), ("a", "O", 3), ("b", None, 4), ("a", None, 5)], "g string, k string, id int")
    last = {r["id"]: r["place"] for r in placed(df, ["g"], [F.asc_nulls_last("k"), "id"]).collect()}
    first = {r["id"]: r["place"] for r in placed(df, ["g"], [F.desc_nulls_first("k"), "id"]).collect()}
    assert last == {3: 1, 2: 2, 1: 3, 5: 4, 4: 1} and first == {1: 1, 5: 2, 2: 3, 3: 4, 4: 1}


def test_null_order_returns_every_order(spark):
    from tessera.plans.catalog import REGISTRY

    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey", "o_orderstatus")
    got = REGISTRY.queries["sort_null_order"](spark, "/root/testdata/sf0.001").join(orders, "o_orderkey")
    assert got.count() == orders.count()
    assert got.filter("o_orderstatus = 'F'").count() == orders.filter("o_orderstatus = 'F'").count() > 0


def test_session_gap_edges(spark):
    gap = dt.timedelta(minutes=30)
    rows = [(1, at(0)), (1, at(0) + gap), (2, at(0)), (2, at(0) + gap - dt.timedelta(microseconds=1)), (3, at(0)), (3, at(0) + gap + dt.timedelta(microseconds=1))]
    df = spark.createDataFrame(rows, "u int, ts timestamp")
    n = {r["u"]: r["n"] for r in df.groupBy("u", F.session_window("ts", "30 minutes")).count().groupBy("u").agg(F.count("*").alias("n")).collect()}
    assert n == {1: 1, 2: 1, 3: 2}  # a gap of exactly half an hour still joins


def events(spark, folder, batches):
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
        df.coalesce(1).write.parquet(f"{folder}/part{k}")
        (src,) = (folder / f"part{k}").glob("*.parquet")
        src.rename(folder / f"events{k}.parquet")


def test_late_rows_are_dropped(spark, tmp_path):
    row = lambda i, t: (i, t, 1, "view", 1.0, "{}")
    events(spark, tmp_path, [[row(1, at(0, 10))], [row(2, at(8))], [row(3, at(12))], [row(4, at(0, 20))], [row(5, at(20))]])
    schema = spark.read.parquet(f"{tmp_path}/events0.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "events*.parquet").parquet(str(tmp_path))
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    got = run_to_end(stream.groupBy(F.window("ts", "1 hour")).count()).select("window.start", "count").collect()
    assert {r[0].hour: r[1] for r in got}[0] == 1  # event 4 came too late


def test_stream_equals_batch_for_any_number_of_files(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    spark.read.parquet(f"{sf}/events.parquet").repartitionByRange(5, "ts").write.parquet(f"{tmp_path}/x/events.parquet")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/x/events.parquet")
    counts = run_to_end(stream.groupBy("event_type").count(), "complete").collect()
    assert sorted(counts) == sorted(spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").count().collect())


def test_file_queries_equal_the_directory(spark):
    import os

    from tessera.plans.catalog import REGISTRY

    sf = "/root/testdata/sf0.001"
    files = {e.name: e.stat().st_size for e in os.scandir(sf) if e.name.endswith(".parquet") and e.is_file()}
    assert {(r["name"], r["length"]) for r in REGISTRY.queries["src_list_files"](spark, sf).collect()} == set(files.items())
    renamed = {(r["name"], r["new_name"]) for r in REGISTRY.queries["src_replace_in_names"](spark, sf).collect()}
    assert renamed == {(n, n.replace(".parquet", "_old.parquet") if n.startswith("p") else n) for n in files}
    plan = [r.asDict() for r in REGISTRY.queries["src_rename_plan"](spark, sf).collect()]
    assert plan == [{"name": "part.parquet", "new_name": "nation.parquet", "collides": True}]


def test_samples_take_about_their_share_and_nothing_else(spark):
    from tessera.plans.catalog import REGISTRY

    sf = "/root/testdata/sf0.01"
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    got = REGISTRY.queries["proj_sample"](spark, sf)
    assert got.exceptAll(orders).count() == 0
    n = {r["o_orderstatus"]: r["count"] for r in orders.groupBy("o_orderstatus").count().collect()}
    for r in got.groupBy("o_orderstatus").count().collect():
        share = {"F": 0.1, "O": 0.1, "P": 0.5}[r["o_orderstatus"]]
        assert abs(r["count"] - share * n[r["o_orderstatus"]]) < 6 * (n[r["o_orderstatus"]] * share * (1 - share)) ** 0.5


def test_asof_of_one_hot_key_is_dealt_by_time(spark):
    left = spark.range(500).select((F.col("id") % 50 == 0).cast("int").alias("k"), F.timestamp_seconds(F.col("id") * 7919 % 100_000).alias("ts"), F.col("id").alias("x"))
    right = spark.range(300).select((F.col("id") % 40 == 0).cast("int").alias("k"), F.timestamp_seconds(F.col("id") * 104729 % 100_000).alias("ts"), F.col("id").alias("v"))
    whole = {(r["x"], r["v"]) for r in asof_join(left, right, ["k"], "ts", ["v"]).collect()}
    for by in (["k"], []):
        want = whole if by else {(r["x"], r["v"]) for r in asof_join(left, right, [], "ts", ["v"]).collect()}
        for span in (F.floor(F.unix_seconds("ts") / 3600), F.lit(0)):
            assert {(r["x"], r["v"]) for r in asof_join(left, right, by, "ts", ["v"], span).collect()} == want


def test_file_operations(spark, tmp_path):
    for name in ("a.b.txt", "ab.txt", "c.txt", "sub/d.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    assert list_files(spark, str(tmp_path), recursive=False).count() == 3
    assert list_files(spark, str(tmp_path), recursive=True).count() == 4
    files = list_files(spark, str(tmp_path), recursive=False)
    clash = rename_plan(replace_in_names(files, "a.b", "ab", F.lit(True)))
    assert [(r["name"], r["collides"]) for r in clash.collect()] == [("a.b.txt", True)]
    with pytest.raises(ValueError):
        apply_renames(clash)
    plan = rename_plan(replace_in_names(files, ".", "_", F.col("name") == "c.txt"))
    assert apply_renames(plan) == 1
    assert (tmp_path / "c_txt").exists() and (tmp_path / "ab.txt").exists()


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_formats_keep_awkward_text(spark, kind):
    df = spark.createDataFrame([(1, 'a "quoted", text'), (2, "two\nlines"), (3, "ß日🙂"), (4, None)], "id int, s string")
    assert sorted(round_trip(df, kind).collect()) == sorted(df.collect())


def test_plans_prune_push_and_limit(spark):
    from tessera.plans.catalog import REGISTRY

    def plan(name):
        df = REGISTRY.queries[name](spark, "/root/testdata/sf0.001")
        return df._jdf.queryExecution().executedPlan().toString()

    scan = plan("scan_pruned")
    assert "LessThan(l_shipdate" in scan and "l_comment" not in scan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in scan
    assert "WindowGroupLimit" in plan("sort_top_k_per_group")
    assert "TakeOrderedAndProject" in plan("sort_top_k")
    assert "NestedLoop" not in plan("join_range") and "Cartesian" not in plan("join_range")
    assert plan("src_bucketed_join").count("Exchange hashpartitioning(l_orderkey") == 0


@pytest.mark.parametrize("column", ["k", "price", "day", None])
def test_database_round_trip(spark, column):
    rows = [(k, decimal.Decimal(k * 7).scaleb(-2), dt.date(2024, 1, 1) + dt.timedelta(k % 40), f"name {k}") for k in range(100)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "k long, price decimal(10,2), day date, name string")
    url, driver = f"jdbc:derby:memory:tessera_{column};create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    write_jdbc(df, url, "items", driver=driver)
    write_jdbc(df.filter("k < 5"), url, "items", driver=driver)
    got = read_jdbc(spark, url, "items", column, parts=4, driver=driver)
    assert got.rdd.getNumPartitions() == (4 if column else 1)
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r) for r in got.collect()), key=key)[:-1] == sorted(rows[:-1] + rows[:5], key=key)
    assert got.filter("name IS NULL").count() == 1
    write_jdbc(df.limit(0), url, "nothing", mode="overwrite", driver=driver)
    assert read_jdbc(spark, url, "nothing", column, driver=driver).count() == 0


def test_streams_read_a_folder_as_they_read_a_file(spark, tmp_path):
    from tessera.plans.catalog import REGISTRY

    sf = "/root/testdata/sf0.001"
    spark.read.parquet(f"{sf}/events.parquet").repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("stream_tumbling", "stream_replayed_late"):
        one, many = (sorted(REGISTRY.queries[name](spark, d).collect()) for d in (sf, str(tmp_path)))
        assert one == many != []


def hourly(stream):
    return stream.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour").alias("w")).count().select("w.start", "count")


def test_replay_drops_late_rows(spark):
    rows = [(k, at(k % 24, k % 60)) for k in range(200)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp")
    late = F.when(F.col("event_id") % 10 == 0, 5 * 3_600_000_000).otherwise(0)
    parts = arrivals(df, late, 4)
    assert [p.count() for p in parts] and sum(p.count() for p in parts) == 200
    whole = sorted(map(tuple, run_in_steps(parts, hourly).collect()))
    # what the batches must keep: rows whose window ends after the watermark of the parts before
    held, last, mark = {}, None, None
    for part in parts:
        for r in part.collect():
            start = r["ts"].replace(minute=0)
            if mark is None or start + dt.timedelta(hours=1) > mark:
                held[start] = held.get(start, 0) + 1
            last = max(last or r["ts"], r["ts"])
        mark = last - dt.timedelta(hours=1)
    assert whole == sorted((s, n) for s, n in held.items() if s + dt.timedelta(hours=1) <= mark)
    assert 0 < 200 - sum(held.values()) < 20  # rows that came too late


def test_a_failed_batch_is_counted_once(spark, tmp_path):
    df = spark.createDataFrame([(k, at(k % 20)) for k in range(100)], "event_id long, ts timestamp")
    parts = arrivals(df, F.lit(0), 3)
    want = sorted(map(tuple, run_in_steps(parts, hourly).collect()))
    failed = []

    def broken(number):
        if number in (0, 2) and number not in failed:
            failed.append(number)
            raise RuntimeError("the sink breaks after it has written")

    assert sorted(map(tuple, run_in_steps(parts, hourly, broken, tries=2).collect())) == want and failed == [0, 2]


def test_funnel_expires_and_takes_rows_in_order(spark):
    from tessera.streaming.processor import funnel

    us = dt.timedelta(microseconds=1)
    rows = [(1, 1, "click", at(1)), (2, 1, "purchase", at(7)), (3, 2, "click", at(1)), (4, 2, "purchase", at(7) + us), (5, 3, "purchase", at(2)), (6, 3, "click", at(2)),
            (7, 4, "click", at(3)), (8, 4, "click", at(4)), (9, 4, "purchase", at(5)), (10, 4, "purchase", at(6)), (11, 5, "click", at(18)), (12, 9, "view", at(20))]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp")
    want = [(1, 2), (3, None), (6, None), (7, 9), (8, 9)]
    for steps in (1, 4):
        got = run_in_steps(arrivals(df, F.lit(0), steps), lambda s: funnel(s.withWatermark("ts", "1 hour")))
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_columns_named_as_inside_are_kept(spark):
    points = spark.createDataFrame([(1.0, "a"), (4.0, "b")], "p double, _bucket string")
    ranges = spark.createDataFrame([(0.0, 3.0, "x")], "lo double, hi double, __bucket string")
    got = range_join(points, F.col("p"), ranges, F.col("lo"), F.col("hi"), 2.0).collect()
    assert [(r["p"], r["_bucket"], r["__bucket"]) for r in got] == [(1.0, "a", "x")]
    df = spark.createDataFrame([("a", 5, 7, 9), ("a", 6, 8, 9)], "g string, v int, rn int, place int")
    assert [(r["rn"], r["_rn"]) for r in top_k_per_group(df, ["g"], [F.desc("v")], 1).collect()] == [(8, 1)]
    assert sorted((r["place"], r["_place"]) for r in placed(df, ["g"], ["v"]).collect()) == [(9, 1), (9, 2)]


def test_word_counts_shuffle_no_words(spark):
    from tessera.functions.scalars import word_counts

    rows = [(1, "b a  a b a"), (2, ""), (3, None), (4, "  "), (5, "x"), (6, "a " * 5000 + "é z é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts = word_counts(docs)
    assert "hashpartitioning" not in counts._jdf.queryExecution().executedPlan().toString()
    expected = {(1, "a", 3), (1, "b", 2), (5, "x", 1), (6, "a", 5000), (6, "é", 2), (6, "z", 1)}
    assert sorted(map(tuple, counts.collect())) == sorted(expected)
    twice = docs.union(spark.createDataFrame([(1, "a c"), (None, "n"), (None, "n m"), (5, None)], docs.schema))
    expected = expected - {(1, "a", 3)} | {(1, "a", 4), (1, "c", 1), (None, "n", 2), (None, "m", 1)}
    got = [tuple(r) for r in word_counts(twice).collect()]
    assert len(got) == len(expected) and set(got) == expected


def test_funnel_keeps_users_together_in_bounded_groups(spark):
    from tessera.streaming.processor import BUCKETS, funnel

    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    users = range(3 * BUCKETS)
    rows = [(2 * u, u, "click", at(1)) for u in users] + [(2 * u + 1, u, "purchase", at(2 + u % 700)) for u in users]
    rows += [(90_000, None, "click", at(1)), (90_001, None, "purchase", at(2)), (90_002, 0, "purchase", at(3000))]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp")
    stream = []

    def built(s):
        stream.append(funnel(s.withWatermark("ts", "1 hour")))
        return stream[-1]

    got = {r["click"]: r["purchase"] for r in run_in_steps(arrivals(df, F.lit(0), 1), built).collect()}
    assert got == {2 * u: 2 * u + 1 if 1 + u % 700 <= 360 else None for u in users} | {90_000: None}
    assert "bucket" in stream[0]._jdf.queryExecution().analyzed().toString()
