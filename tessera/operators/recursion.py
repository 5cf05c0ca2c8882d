"""Recursion over data: the nodes that links lead to, by rounds that only follow what is new."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.selection import kept
from tessera.plans.registry import Registry
from tessera.session import table

#: New nodes up to which a round broadcasts them, and the share of all links, 1/HOT, beyond which a node's are kept apart.
BROADCAST_NODES, HOT = 100_000, 512

log = logging.getLogger(__name__)


def reach(links: DataFrame, start: DataFrame, hops: int | None = None) -> DataFrame:
    """node, hops: every node that `links` (from, to) lead to from the nodes of `start` (node), and in how few steps.

    Semi-naive: a round joins the links only with the nodes that the round before found first, so each link is followed
    once however many ways lead to it, and cycles end. What a round finds is written, so plans don't grow and lost
    executors cost one round. While a round's nodes are few they are broadcast, and the links aren't shuffled. Beyond
    that they are joined by node; links of nodes that have more than 1/HOT of all links, fewer than HOT nodes, are
    kept apart and always meet a broadcast. The driver sees one count a round; rounds are as many as the longest
    shortest way, or `hops`. Null nodes and links with a null end lead nowhere; repeated links and nodes count once.
    """
    links = kept(links.select(F.col("from").alias("node"), F.col("to").alias("next")).dropna())
    sizes = links.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    hot = kept(sizes.join(F.broadcast(links.agg(F.count(F.lit(1)).alias("whole"))), F.col("n") * HOT > F.col("whole")).select("node"))
    of_hot = kept(links.join(F.broadcast(hot), "node", "left_semi"))
    of_others = kept(links.join(F.broadcast(hot), "node", "left_anti"))
    seen = new = kept(start.select("node").dropna().distinct().withColumn("hops", F.lit(0)))
    done = 0
    while (found := new.count()) and (hops is None or done < hops):
        log.info("round %d starts from %d new nodes", done, found)
        done += 1
        few = F.broadcast(new) if found <= BROADCAST_NODES else new
        few_hot = F.broadcast(new.join(F.broadcast(hot), "node", "left_semi"))
        ends = of_others.join(few, "node").select("next").unionByName(of_hot.join(few_hot, "node").select("next"))
        ends = ends.distinct().withColumnRenamed("next", "node")
        new = kept(ends.join(seen, "node", "left_anti").withColumn("hops", F.lit(done)))
        seen = seen.unionByName(new)
    return seen


def register_queries(r: Registry) -> None:
    @r.query(
        "set_reach",
        """WITH RECURSIVE links AS (SELECT DISTINCT -l_suppkey AS a, l_partkey AS b FROM lineitem UNION SELECT DISTINCT l_partkey, -l_suppkey FROM lineitem),
        ways(node, hops) AS (SELECT -min(s_suppkey), 0 FROM supplier UNION SELECT b, hops + 1 FROM ways JOIN links ON a = node WHERE hops < 12)
        SELECT node, min(hops) AS hops FROM ways GROUP BY 1""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        # suppliers are the nodes below 0, parts those above
        items = table(spark, sf_dir, "lineitem").select((-F.col("l_suppkey")).alias("from"), F.col("l_partkey").alias("to"))
        both = items.unionByName(items.select(F.col("to").alias("from"), F.col("from").alias("to")))
        return reach(both, table(spark, sf_dir, "supplier").agg((-F.min("s_suppkey")).alias("node")))
