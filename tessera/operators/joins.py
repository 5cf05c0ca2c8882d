"""Joins: every kind Spark has, and the as-of and range joins that it lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.relational import unused
from tessera.plans.registry import Registry
from tessera.session import table


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], span: Column | None = None) -> DataFrame:
    """Backward as-of join: each left row with the last right row of the same key at or before its time.

    Both sides are united and sorted by (key, time), right rows first at equal times, and the last right row is
    carried forward: one shuffle on the key, no pair of rows is ever formed. Of right rows at one time the last
    in order of `values` counts. Left rows without a match keep nulls; a null time matches nothing.

    A key with a large share of the rows, or no key at all, would meet in one task. `span`, an expression over `on`
    that never falls as time goes on (the day, say), deals rows by (key, span) instead: the last right row of each
    span, one row per key and span, is carried over to the spans after it.
    """
    kept = [c for c in left.columns if c not in by and c != on]
    a = left.select(*by, on, F.struct(*(kept or [F.lit(1).alias("_none")])).alias("_l"), F.lit(None).alias("_r"), F.lit(1).alias("_side"))
    b = right.filter(F.col(on).isNotNull()).select(*by, on, F.lit(None).alias("_l"), F.struct(*values).alias("_r"), F.lit(0).alias("_side"))
    both, keys = a.unionByName(b), list(by)
    if span is not None:
        both, keys = both.withColumn("_span", span), [*by, "_span"]
    w = Window.partitionBy(*keys).orderBy(on, "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_seen", F.last("_r", ignorenulls=True).over(w))
    if span is not None:
        last = both.filter(F.col(on).isNotNull()).groupBy(*keys).agg(F.max_by("_r", F.when(F.col("_side") == 0, F.struct(on, "_r"))).alias("_last"))
        before = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
        last = last.select(*(F.col(k).alias(f"_key_{k}") for k in keys), F.last("_last", ignorenulls=True).over(before).alias("_before"))
        on_keys = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
        out = out.filter("_side = 1").join(last, on_keys, "left").withColumn("_seen", F.coalesce("_seen", "_before"))
    out = out.filter("_side = 1").withColumn("_seen", F.when(F.col(on).isNotNull(), F.col("_seen")))
    return out.select(*by, on, *(F.col(f"_l.{c}").alias(c) for c in kept), *(F.col(f"_seen.{v}").alias(v) for v in values))


def range_join(points: DataFrame, at: Column, ranges: DataFrame, low: Column, high: Column, width: float) -> DataFrame:
    """Pairs with low <= at < high, by an equi-join on buckets of `width` instead of a nested loop.

    A range is copied to each bucket it touches and each point lies in one, so every pair is found once; choose
    a width near the usual length of a range.
    """
    bucket = unused([*points.columns, *ranges.columns], "_bucket")
    a = points.withColumn(bucket, F.floor(at / width))
    last = F.greatest(F.ceil(high / width) - 1, F.floor(low / width))
    b = ranges.withColumn(bucket, F.explode(F.sequence(F.floor(low / width), last)))
    return a.join(b, bucket).filter((at >= low) & (at < high)).drop(bucket)


def register_queries(r: Registry) -> None:
    r.sql(
        "join_inner",
        "orders customer",
        "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0",
    )
    r.sql(
        "join_left",
        "customer orders",
        "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000 GROUP BY c_custkey",
    )
    r.sql(
        "join_right",
        "customer orders",
        "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'P'",
    )
    r.sql(
        "join_full",
        "customer supplier",
        """SELECT c_custkey, s_suppkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) c
        FULL OUTER JOIN (SELECT * FROM supplier WHERE s_acctbal < 5000) s ON c_custkey = s_suppkey""",
    )

    @r.query("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        big = table(spark, sf_dir, "orders").filter("o_totalprice > 200000")
        customer = table(spark, sf_dir, "customer")
        return customer.join(big, customer.c_custkey == big.o_custkey, "left_semi").select("c_custkey")

    @r.query("join_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
        return orders.join(items, orders.o_orderkey == items.l_orderkey, "left_anti").select("o_orderkey")

    r.sql(
        "join_not_in",
        "supplier customer",
        "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
    )
    r.sql(
        "join_not_in_null",
        "supplier customer",
        "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT nullif(c_custkey, 1) FROM customer)",
    )
    r.sql("join_cross", "region nation", "SELECT r_name, n_name FROM region CROSS JOIN nation")

    @r.query(
        "join_range",
        """SELECT s_suppkey, count(*) AS parts FROM supplier JOIN part ON p_retailprice >= s_acctbal AND p_retailprice < s_acctbal + 50
        GROUP BY 1""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        part, supplier = table(spark, sf_dir, "part").select("p_retailprice"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
        low = F.col("s_acctbal")
        return range_join(part, F.col("p_retailprice"), supplier, low, low + 50, 50.0).groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("parts"))

    r.sql(
        "join_interval",
        "events",
        """SELECT a.event_id AS click, b.event_id AS purchase FROM events a JOIN events b ON a.user_id = b.user_id
        AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL '6' HOUR""",
    )

    @r.query(
        "join_asof",
        """SELECT p.event_id, p.user_id, p.ts, v.event_id AS view_id
        FROM (SELECT * FROM events WHERE event_type = 'purchase') p
        ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
        views = events.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
        return asof_join(events.filter("event_type = 'purchase'").drop("event_type"), views, ["user_id"], "ts", ["view_id"])

    @r.query("join_using", "SELECT quality, toxic, count(*) AS n, sum(n_chars) AS chars FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        both = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
        return both.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))

    lateral = """SELECT c_custkey, o_orderkey, o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders
        WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2)"""
    r.sql("join_lateral", "customer orders", lateral, lateral + " t")

    @r.query(
        "join_strategies",
        """SELECT n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        # orders and customer both grow, so they merge; nation has 25 rows at any scale, so it is broadcast
        orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
        both = orders.select("o_custkey").join(customer.select("c_custkey", "c_nationkey").hint("merge"), F.col("o_custkey") == F.col("c_custkey"))
        return both.join(nation.hint("broadcast"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))

    @r.query("join_shuffle_hash", "SELECT o_orderstatus, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
        items = table(spark, sf_dir, "lineitem").select("l_orderkey")
        both = items.join(orders.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
        return both.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))

    @r.query("join_replicate", "SELECT r_name, n_name FROM region, nation WHERE r_regionkey < n_regionkey")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        # 5 by 25 rows at any scale
        region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
        return region.join(nation.hint("shuffle_replicate_nl"), F.col("r_regionkey") < F.col("n_regionkey")).select("r_name", "n_name")

    r.sql(
        "join_six_tables",
        "customer orders lineitem supplier nation region",
        """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""",
    )
    r.sql(
        "join_correlated_scalar",
        "part lineitem",
        """SELECT round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN part ON p_partkey = l_partkey
        WHERE l_quantity < (SELECT 0.5 * avg(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)""",
    )
