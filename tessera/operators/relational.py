"""Projections, filters, sorts, limits and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.plans.registry import Registry
from tessera.session import table


def unused(columns: list[str], name: str) -> str:
    """`name`, with as many underscores in front as keep it apart from the columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def top_k_per_group(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group with their number in `rn` (`_rn` if there is an `rn`); planned with a per-partition
    group limit before the shuffle."""
    w, rn = Window.partitionBy(*group).orderBy(*order), unused(df.columns, "rn")
    return df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) <= k)


def placed(df: DataFrame, group: list[str], order: list) -> DataFrame:
    """Every row with its place in the order of its group, from 1, in `place` (`_place` if there is a `place`)."""
    return df.withColumn(unused(df.columns, "place"), F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def register_queries(r: Registry) -> None:
    @r.query("scan_pruned", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz"))
        return rows.select("l_orderkey", "l_quantity")

    r.sql(
        "proj_between_in",
        "part",
        "SELECT p_partkey, p_retailprice * 2 AS twice FROM part WHERE p_size BETWEEN 5 AND 15 AND p_brand IN (SELECT min(p_brand) FROM part)",
    )
    r.sql(
        "proj_like",
        "part",
        "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_type ILIKE '%S%' AND regexp_like(p_brand, '[0-9]')",
        "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_type ILIKE '%S%' AND regexp_matches(p_brand, '[0-9]')",
    )
    r.sql(
        "proj_case",
        "orders",
        """SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'high' WHEN o_totalprice > 10000 THEN 'mid' ELSE 'low' END AS band,
        coalesce(nullif(o_orderstatus, 'F'), 'done') AS status FROM orders""",
    )

    @r.query("proj_sample")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "orders").sampleBy("o_orderstatus", {"F": 0.1, "O": 0.1, "P": 0.5}, seed=7)

    @r.query("sort_offset_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(20)

    @r.query("sort_top_k", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(10)

    @r.query(
        "sort_top_k_per_group",
        """SELECT o_custkey, o_orderkey, o_totalprice, rn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey
        ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rn FROM orders) WHERE rn <= 3""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
        return top_k_per_group(orders, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3)

    @r.query(
        "sort_null_order",
        """SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY nullif(o_orderstatus, 'F') ASC NULLS LAST, o_orderkey) AS INT) AS last,
        CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY nullif(o_orderstatus, 'F') DESC NULLS FIRST, o_orderkey) AS INT) AS first FROM orders""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = F.nullif(F.col("o_orderstatus"), F.lit("F"))
        orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
        last = placed(orders, ["o_custkey"], [key.asc_nulls_last(), "o_orderkey"]).withColumnRenamed("place", "last")
        first = placed(last, ["o_custkey"], [key.desc_nulls_first(), "o_orderkey"]).withColumnRenamed("place", "first")
        return first.drop("o_orderstatus")

    @r.query("sort_within_partitions", "SELECT o_orderkey, o_custkey FROM orders")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartition("o_custkey").sortWithinPartitions("o_custkey", "o_orderkey")

    r.sql("set_union", "customer supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
    r.sql("set_union_all", "customer supplier", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
    r.sql("set_intersect_all", "customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
    r.sql("set_except_all", "customer supplier", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
    r.sql("set_intersect", "customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
    r.sql("set_except", "nation supplier", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")

    @r.query(
        "set_union_by_name",
        "SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
        supplier = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("k"))
        return customer.unionByName(supplier, allowMissingColumns=True)

    r.sql(
        "set_recursive_cte",
        "nation",
        """WITH RECURSIVE steps(k, depth) AS (SELECT n_nationkey AS k, 0 AS depth FROM nation WHERE n_nationkey = 0
        UNION ALL SELECT k + 1, depth + 1 FROM steps WHERE depth < 20) SELECT k, depth FROM steps""",
    )
    r.sql("set_distinct", "lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
