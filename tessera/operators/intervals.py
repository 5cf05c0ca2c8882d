"""Joins of points with ranges, and of ranges with ranges, whatever their lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.relational import unused
from tessera.operators.selection import kept
from tessera.plans.registry import Registry
from tessera.session import table

#: A node with more than 1/HOT of the copies of a side is dealt; so at most HOT nodes of a side are, each in at most HOT parts.
HOT = 64
#: Nodes are at least 2^-FINEST of the points' span, so there are at most FINEST + 1 sizes.
FINEST = 50

#: Different values, and ranges that begin or end among them, that one task of `range_totals` holds, about.
CHUNK = 250_000
#: Stands for no value where the least is sought.
NONE = np.iinfo(np.int64).max


def _names(df: DataFrame, others: list[str], *names: str) -> list[str]:
    return [unused([*df.columns, *others], n) for n in names]


def exponent(lo: Column, hi: Column, span: float) -> Column:
    """The e of the nodes of a range from lo to hi: a quarter to a half of its length, if no less than 2^-FINEST of `span`."""
    return F.floor(F.log2(F.greatest(hi / 2 - lo / 2, F.lit(span / 2**FINEST)))).cast("int")


def cell(value: Column, e: Column) -> Column:
    """The node of size 2^e that holds the value."""
    return F.floor(value / F.pow(F.lit(2.0), e))


def point_join(points: DataFrame, at: Column, ranges: DataFrame, low: Column, high: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs with low <= at < high, and equal in the columns `by` if given, by an equi-join on dyadic nodes.

    Nodes are intervals of 2^e, for every whole e, that start at multiples of their size. A range is copied to the
    nodes it touches whose size is a quarter to a half of its length, five at most however long it is; a point is
    copied to its node of each size that some range uses, FINEST + 1 at most. So each pair meets once, in nodes that are
    on average at most half again as long as the range. No width has to be chosen, as in `range_join`.

    A node with more than 1/HOT of the rows of a side is dealt in parts: its rows of that side fall into the parts by
    their hash, and those of the other side are copied to each part. The driver sees the points' bounds, the sizes in
    use and the dealt nodes, at most 2 * HOT. `by` columns that are null match nothing, nor do points that are null,
    NaN or infinite, nor ranges with a null bound or low >= high; bounds may be infinite. The result has the columns of
    `points`, then those of `ranges` but `by`.
    """
    x, lo, hi, e, node, part, rank = _names(points, ranges.columns, "_x", "_lo", "_hi", "_e", "_node", "_part", "_rank")
    inf = F.lit(float("inf"))
    a = points.withColumn(x, at.cast("double")).filter(F.abs(F.col(x)) < inf)
    least, most = a.agg(F.min(x), F.max(x)).first()
    if least is None:
        least = most = 0.0
    # bounds beyond the points are drawn in, so that an endless range has a length too
    b = ranges.filter(low < high).withColumn(lo, F.greatest(low.cast("double"), F.lit(least))).withColumn(hi, F.least(high.cast("double"), F.lit(most)))
    b = b.filter(F.col(lo) <= F.col(hi))
    span = max(most / 2 - least / 2, abs(most) / 2**FINEST, abs(least) / 2**FINEST, 2.0**-900) * 2
    b = b.withColumn(e, exponent(F.col(lo), F.col(hi), span))
    sizes = sorted(r[0] for r in b.select(e).distinct().collect())
    a = a.withColumn(e, F.explode(F.array(*(F.lit(s) for s in sizes)).cast("array<int>"))).withColumn(node, cell(F.col(x), F.col(e)))
    b = b.withColumn(node, F.explode(F.sequence(cell(F.col(lo), F.col(e)), cell(F.col(hi), F.col(e)))))
    keys = [*by, e, node]

    # parts of the hot nodes of each side: at most HOT nodes, as each has more than 1/HOT of the side's rows
    def shares(df: DataFrame, name: str) -> DataFrame:
        sizes_ = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
        whole = df.agg(F.count(F.lit(1)).alias(rank))
        return sizes_.join(F.broadcast(whole), F.col(name) * HOT > F.col(rank)).select(*keys, F.ceil(F.col(name) * HOT / F.col(rank)).cast("int").alias(name))

    p_parts, r_parts = _names(points, ranges.columns, "_points", "_ranges")
    hot = F.broadcast(shares(a, p_parts).join(shares(b, r_parts), keys, "full"))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in (s := f.dataType.simpleString()) and "variant" not in s]
        mine, copies = F.coalesce(own, F.lit(1)), F.coalesce(other, F.lit(1))
        out = df.join(hot, keys, "left").withColumn(part, F.pmod(F.xxhash64(*hashed), mine).cast("int"))
        return out.withColumn(rank, F.explode(F.sequence(F.lit(0), copies - 1))).drop(own, other)

    left = dealt(a, p_parts, r_parts).withColumnRenamed(part, p_parts).withColumnRenamed(rank, r_parts)
    right = dealt(b, r_parts, p_parts).withColumnRenamed(part, r_parts).withColumnRenamed(rank, p_parts)
    met = left.join(right, [*keys, p_parts, r_parts]).filter((at >= low) & (at < high))
    return met.select(*(F.col(f"`{c}`") for c in points.columns), *(F.col(f"`{c}`") for c in ranges.columns if c not in by))


def overlap_join(
    left: DataFrame, left_low: Column, left_high: Column, right: DataFrame, right_low: Column, right_high: Column, by: tuple[str, ...] = ()
) -> DataFrame:
    """Pairs of ranges [low, high) that share a point, and are equal in the columns `by` if given.

    Two ranges overlap if one starts within the other, so this is two joins of starts with ranges: the left one
    starts in the right one, or the right one starts in the left one and after its start. Each pair is found once.
    Empty ranges and those with a null bound overlap nothing. Starts must be finite; no column but `by` may stand in both sides.
    """
    lefts, rights = left.filter(left_low < left_high), right.filter(right_low < right_high)
    first = point_join(lefts, left_low, rights, right_low, right_high, by)
    second = point_join(rights, right_low, lefts, left_low, left_high, by).filter(right_low > left_low)
    return first.unionByName(second)


class _Totals:
    """Count, count of known values and least value of any run of rows that lie in order."""

    def __init__(self, n: np.ndarray, known: np.ndarray, first: np.ndarray) -> None:
        self.n, self.known = (np.concatenate([[0], np.cumsum(c)]) for c in (n, known))
        self.least = [first]  # of 2^k rows from each on
        while len(row := self.least[-1]) > (step := 1 << (len(self.least) - 1)):
            self.least.append(np.minimum(row[:-step], row[step:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Totals of the rows from a to before b, a < b."""
        first = np.full(len(a), NONE)
        level = np.frexp(b - a)[1] - 1
        for k in np.unique(level).tolist():
            at = level == k
            first[at] = np.minimum(self.least[k][a[at]], self.least[k][b[at] - (1 << k)])
        return self.n[b] - self.n[a], self.known[b] - self.known[a], first


def range_totals(points: DataFrame, at: Column, value: Column, ranges: DataFrame, low: Column, high: Column, by: list[str]) -> DataFrame:
    """`by`, n, least: for the ranges of each `by` how many points they hold (low <= at < high), and the least whole `value`.

    No pair is formed, so the work grows with points and ranges, not with how many meet. Points of one place become one
    row; these are dealt in parts of about CHUNK by ranges of the place. Whole parts that a range covers are totals that
    every task knows; only the parts where it begins and ends are asked, at most two, and those asked often are copied to
    several tasks. The driver sees one row a part. Points and ranges that can't meet are as in `point_join`; a `by`
    without points is left out, and least is null where no value is known.
    """
    inf = F.lit(float("inf"))
    rows = points.select(at.cast("double").alias("x"), value.cast("long").alias("v")).filter(F.abs(F.col("x")) < inf)
    values = kept(rows.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("known"), F.coalesce(F.min("v"), F.lit(int(NONE))).alias("first")))
    values = kept(values.repartitionByRange(max(1, -(-values.count() // CHUNK)), "x").withColumn("part", F.spark_partition_id()))
    totals = [F.sum("n").alias("n"), F.sum("known").alias("known"), F.min("first").alias("first")]
    ends = values.groupBy("part").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), *totals).orderBy("lo").toArrow()
    parts = ranges.sparkSession.sparkContext.broadcast([ends.column(c).to_numpy() for c in ("part", "lo", "hi", "n", "known", "first")])
    names = [f"_by{k}" for k in range(len(by))]
    kinds = [f"{n} {ranges.schema[c].dataType.simpleString()}" for n, c in zip(names, by, strict=True)]
    counts = "n long, known long, first long"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, los, his, *more = parts.value
        whole = _Totals(*more)
        for batch in batches:
            lo, hi = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi"))
            a, b = np.searchsorted(his, lo), np.searchsorted(los, hi) - 1
            asked = [(np.flatnonzero(a <= b), a), (np.flatnonzero(a < b), b)]
            for rows, of in asked:
                none = pa.nulls(len(rows), pa.int64())
                yield pa.record_batch([*batch.take(pa.array(rows)).columns, pa.array(part[of[rows]], pa.int32()), none, none, none], names=columns)
            rows = np.flatnonzero(b - a > 1)
            found = [pa.array(c, pa.int64()) for c in whole.of(a[rows] + 1, b[rows])]
            yield pa.record_batch([*batch.take(pa.array(rows)).columns, pa.nulls(len(rows), pa.int32()), *found], names=columns)

    columns = [*names, "lo", "hi", "part", "n", "known", "first"]
    asked = ranges.filter(low < high).select(*(F.col(f"`{c}`").alias(n) for n, c in zip(names, by, strict=True)), low.cast("double").alias("lo"), high.cast("double").alias("hi"))
    asked = kept(asked.mapInArrow(deal, ", ".join([*kinds, "lo double, hi double, part int", counts])))
    inner = asked.filter("part IS NULL").select(*names, "n", "known", "first")
    edges = asked.filter("part IS NOT NULL").select(*names, "lo", "hi", "part")
    copies = F.broadcast(kept(edges.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("copies"))))
    edges = edges.join(copies, "part").withColumn("copy", F.pmod(F.xxhash64("lo", "hi", *names), F.col("copies")).cast("int")).drop("copies")
    values = values.join(copies, "part").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")

    def look_up(some: pa.Table, held: pa.Table) -> pa.Table:
        held = held.sort_by("x")
        x, *more = (held.column(c).to_numpy() for c in ("x", "n", "known", "first"))
        a, b = (np.searchsorted(x, some.column(c).to_numpy()) for c in ("lo", "hi"))
        rows = np.flatnonzero(a < b)
        found = _Totals(*more).of(a[rows], b[rows])
        return pa.table([*some.select(names).take(pa.array(rows)).columns, *(pa.array(c, pa.int64()) for c in found)], names=[*names, "n", "known", "first"])

    found = edges.groupBy("part", "copy").cogroup(values.groupBy("part", "copy")).applyInArrow(look_up, ", ".join([*kinds, counts]))
    out = inner.unionByName(found).groupBy(*names).agg(*totals)
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, by, strict=True)), "n", F.when(F.col("known") > 0, F.col("first")).alias("least"))


def register_queries(r: Registry) -> None:
    @r.query(
        "join_points_in_ranges",
        """SELECT p_partkey, count(*) AS orders, min(o_orderkey) AS first_order FROM part JOIN orders
        ON o_totalprice >= p_retailprice * p_size AND o_totalprice < p_retailprice * p_size + p_size * p_size / 4.0 GROUP BY 1""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
        low, size = F.col("p_retailprice") * F.col("p_size"), F.col("p_size")
        part = table(spark, sf_dir, "part").select("p_partkey", low.alias("low"), (low + size * size / 4.0).alias("high"))
        found = range_totals(orders, F.col("o_totalprice"), F.col("o_orderkey"), part, F.col("low"), F.col("high"), ["p_partkey"])
        return found.select("p_partkey", F.col("n").alias("orders"), F.col("least").alias("first_order"))

    @r.query(
        "join_overlap",
        """WITH visits AS (SELECT user_id, event_type, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1, 2)
        SELECT x.user_id, x.event_type AS one, y.event_type AS other FROM visits x JOIN visits y
        ON x.user_id = y.user_id AND x.event_type < y.event_type AND x.a < y.b AND y.a < x.b WHERE x.a < x.b AND y.a < y.b""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        micros = lambda c: F.unix_micros(c.cast("timestamp"))
        visits = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
        one = visits.select("user_id", F.col("event_type").alias("one"), micros(F.col("a")).alias("one_low"), micros(F.col("b")).alias("one_high"))
        other = one.toDF("user_id", "other", "other_low", "other_high")
        met = overlap_join(one, F.col("one_low"), F.col("one_high"), other, F.col("other_low"), F.col("other_high"), ("user_id",))
        return met.filter("one < other").select("user_id", "one", "other")
