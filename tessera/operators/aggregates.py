"""Aggregations: grouped, distinct, grouping sets, ordered and map-valued."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.registry import Registry
from tessera.session import table


def pricing_summary(lineitem: DataFrame) -> DataFrame:
    """Rounded sums and an average by return flag and line status; one shuffle of partial sums."""
    price, off = F.col("l_extendedprice"), F.col("l_discount")
    return (
        lineitem.filter(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum(price), 2).alias("sum_base_price"),
            F.round(F.sum(price * (1 - off)), 2).alias("sum_disc_price"),
            F.round(F.avg(off), 6).alias("avg_disc"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def _near_medians(orders: DataFrame, about: DataFrame, most: float) -> DataFrame:
    """(o_orderstatus, near): whether the share of prices up to the estimate is within `most` of a half, by counting them."""
    share = F.count_if(F.col("o_totalprice") <= F.col("about")) / F.count(F.lit(1))
    return orders.join(about, "o_orderstatus").groupBy("o_orderstatus").agg((F.abs(share - 0.5) <= most).alias("near"))


def register_queries(r: Registry) -> None:
    @r.query(
        "agg_pricing_summary",
        """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
        round(sum(l_extendedprice), 2) AS sum_base_price,
        round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
        round(avg(l_discount), 6) AS avg_disc, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY 1, 2""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pricing_summary(table(spark, sf_dir, "lineitem"))

    @r.query(
        "agg_basic",
        """SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS lo,
        max(o_totalprice) AS hi, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        price = F.col("o_totalprice")
        return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(
            F.count(F.lit(1)).alias("n"), F.round(F.sum(price), 2).alias("total"), F.min(price).alias("lo"), F.max(price).alias("hi"), F.round(F.avg(price), 4).alias("mean")
        )

    @r.query(
        "agg_count_distinct",
        """SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers,
        count(DISTINCT l_shipdate) AS days FROM lineitem GROUP BY 1""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
            F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_shipdate").alias("days")
        )

    grouping = """SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS INT) AS g_flag,
        CAST(grouping(l_linestatus) AS INT) AS g_status, count(*) AS n FROM lineitem
        GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())"""
    r.sql("agg_grouping_sets", "lineitem", grouping)

    @r.query("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))

    @r.query(
        "agg_cube",
        """SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS gid,
        count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(
            F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty")
        )

    r.sql(
        "agg_filter_having",
        "orders",
        """SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS done
        FROM orders GROUP BY o_custkey HAVING count(*) > 12""",
    )
    r.sql(
        "agg_statistics",
        "lineitem",
        """SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_discount), 6) AS vp,
        round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY l_returnflag""",
    )
    r.sql(
        "agg_percentile",
        "orders",
        "SELECT o_orderstatus, round(median(o_totalprice), 4) AS med, round(percentile(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY o_orderstatus",
        "SELECT o_orderstatus, round(median(o_totalprice), 4) AS med, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY o_orderstatus",
    )
    r.sql(
        "agg_mode",
        "part",
        "SELECT p_brand, mode() WITHIN GROUP (ORDER BY p_size) AS common FROM part GROUP BY p_brand",
        """WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2)
        SELECT p_brand, arg_min(p_size, (-n, p_size)) AS common FROM c GROUP BY 1""",
    )

    @r.query(
        "agg_arg_max",
        """SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS dearest, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest
        FROM orders GROUP BY 1""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        by = F.struct("o_totalprice", "o_orderkey")
        return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", by).alias("dearest"), F.min_by("o_orderkey", by).alias("cheapest"))

    r.sql(
        "agg_listagg",
        "nation",
        "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    )

    @r.query(
        "agg_conversation_turns",
        """SELECT conv_id, count(*) AS turns, array_to_string(list(role || ':' || strlen(text) ORDER BY turn), ' ') AS shape
        FROM conversations GROUP BY conv_id""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        # turns in order: the pairs are sorted after collection, as collection has no order
        turns = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(":", "role", F.octet_length("text")).alias("at"))))
        return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
            F.count(F.lit(1)).alias("turns"), F.array_join(F.transform(turns, lambda x: x["at"]), " ").alias("shape")
        )

    r.sql(
        "agg_bool_bit",
        "orders",
        """SELECT o_orderpriority, bool_and(o_totalprice > 0) AS positive, bool_or(o_orderstatus = 'P') AS any_p,
        bit_or(o_custkey) AS bits_or, bit_xor(o_orderkey) AS bits_xor FROM orders GROUP BY o_orderpriority""",
    )

    # Estimates are compared with what they estimate, so the oracle can tell whether they are within three deviations.
    @r.query("agg_approx_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, true AS near FROM orders GROUP BY o_orderstatus")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        by = table(spark, sf_dir, "orders").groupBy("o_orderstatus")
        both = by.agg(F.count_distinct("o_custkey").alias("customers"), F.approx_count_distinct("o_custkey", 0.02).alias("about"))
        return both.select("o_orderstatus", "customers", (F.abs(F.col("about") - F.col("customers")) <= 0.06 * F.col("customers")).alias("near"))

    @r.query(
        "agg_sketches",
        """SELECT count(DISTINCT o_custkey) AS customers, true AS near_customers,
        (SELECT count(DISTINCT o_orderstatus) FROM orders) AS near_medians, (SELECT count(DISTINCT o_orderstatus) FROM orders) AS statuses FROM orders""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        # mergeable sketches: per status first, then their union
        orders = table(spark, sf_dir, "orders")
        by = orders.groupBy("o_orderstatus").agg(
            F.hll_sketch_agg("o_custkey", F.lit(12)).alias("hll"),
            F.percentile_approx("o_totalprice", 0.5, 10000).alias("about"),
        )
        merged = by.agg(F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("about"), F.count(F.lit(1)).alias("statuses"))
        merged = merged.crossJoin(_near_medians(orders, by.select("o_orderstatus", "about"), 0.02).agg(F.count_if("near").alias("near_medians")))  # one row each
        exact = orders.agg(F.count_distinct("o_custkey").alias("customers"))
        joined = merged.crossJoin(exact)  # one row each
        return joined.select("customers", (F.abs(F.col("about") - F.col("customers")) <= 0.06 * F.col("customers")).alias("near_customers"), "near_medians", "statuses")

    @r.query("agg_kll_quantiles", "SELECT DISTINCT o_orderstatus, true AS near FROM orders")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = table(spark, sf_dir, "orders")
        by = orders.groupBy("o_orderstatus").agg(F.expr("kll_sketch_agg_double(o_totalprice)").alias("kll"))
        return _near_medians(orders, by.select("o_orderstatus", F.expr("kll_sketch_get_quantile_double(kll, 0.5)").alias("about")), 0.05)

    @r.query(
        "agg_map_histogram",
        """WITH c AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2)
        SELECT l_returnflag, array_to_string(list(l_linestatus || '=' || n ORDER BY l_linestatus), ',') AS histogram FROM c GROUP BY 1""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        counts = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").count()
        as_map = F.map_from_entries(F.sort_array(F.collect_list(F.struct("l_linestatus", "count"))))
        grouped = counts.groupBy("l_returnflag").agg(as_map.alias("m"))
        pairs = F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
        return grouped.select("l_returnflag", F.array_join(pairs, ",").alias("histogram"))

    @r.query(
        "agg_pivot",
        """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O,
        count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        # the values are named, so no job runs to find them
        return table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)

    @r.query(
        "agg_unpivot",
        """SELECT p_partkey, 'size' AS what, CAST(p_size AS DOUBLE) AS value FROM part
        UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
        return part.unpivot("p_partkey", ["size", "price"], "what", "value")

    @r.query(
        "agg_moments",
        """WITH m AS (SELECT avg(l_quantity) AS mu FROM lineitem), d AS (SELECT l_quantity - mu AS d FROM lineitem, m)
        SELECT round(avg(d * d * d) / pow(avg(d * d), 1.5), 6) AS skewness, round(avg(d * d * d * d) / pow(avg(d * d), 2) - 3, 6) AS kurtosis FROM d""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "lineitem").agg(F.round(F.skewness("l_quantity"), 6).alias("skewness"), F.round(F.kurtosis("l_quantity"), 6).alias("kurtosis"))

    @r.query(
        "agg_decimal_sum",
        """SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2))) AS VARCHAR) AS total FROM lineitem GROUP BY 1""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).cast("string").alias("total"))

    r.sql("agg_global_empty", "orders", "SELECT count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_orderkey < 0")
