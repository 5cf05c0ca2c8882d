"""Exact percentiles of groups of any size, by narrowing in on their ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.registry import Registry
from tessera.session import table
from tessera.sources.files import scratch

#: Values of a range that are sorted at last, parts that a range is cut into, and ranges up to which they are broadcast.
SORTED, PARTS, BROADCAST_RANGES = 100_000, 4096, 100_000


def kept(df: DataFrame) -> DataFrame:
    """The rows written and read again, so that later jobs neither repeat their work nor see them change."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def part_of(x: Column, lo: Column, hi: Column) -> Column:
    """The part, from 0 to PARTS - 1, of a range that the value is in: a function that never falls.

    A range within a factor of two is cut into parts of equal width, any other by its logarithms (of both signs, zero
    between them), so a part is about an octave of the doubles at most after the first pass, and a PARTS-th of it less
    with each pass after the second.
    """

    def place(v: Column) -> Column:
        size = F.abs(v)
        scaled = F.when(size == float("inf"), 2200.0).otherwise(F.log2(size) + 1100)
        return F.when(v == 0, 0.0).when(v > 0, scaled).otherwise(-scaled)

    near = ((lo > 0) & (hi < float("inf")) & (hi / 2 <= lo)) | ((hi < 0) & (lo > float("-inf")) & (lo / 2 >= hi))
    share = F.when(near, (x - lo) / (hi - lo)).otherwise((place(x) - place(lo)) / (place(hi) - place(lo)))
    return F.least(F.floor(share * PARTS), F.lit(PARTS - 1)).cast("int")


def exact_percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """`by` and one column for each of `shares`: the value at that share of the group's ranks, between two ranks in line.

    No group's values meet in one buffer. Each rank asked for has a range of values that holds it. A pass cuts the
    ranges of more than SORTED values into PARTS (see part_of), counts the parts exactly and keeps the part with the
    rank; ranks in one range share its pass, which is one aggregate over the rows. A range of one value, however often it
    stands there, is done. The driver sees no value. Null and NaN values don't count; a group without others is left out; null keys are a group.
    """
    rows = df.select(*(F.col(c).alias(f"_{k}") for k, c in enumerate(by)), F.col(value).cast("double").alias("x")).filter("x IS NOT NULL AND NOT isnan(x)")
    keys = [f"_{k}" for k in range(len(by))]
    whole = kept(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")))
    ranks = F.array_distinct(F.array(*(f(F.lit(s) * (F.col("n") - 1)).cast("long") for s in shares.values() for f in (F.floor, F.ceil))))
    state = kept(whole.select(*keys, "n", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), F.explode(ranks).alias("rank")))

    def within(ranges: DataFrame) -> DataFrame:
        """The values of each range."""
        some = ranges.select(*(F.col(k).alias(f"r{k}") for k in keys), *(c for c in ranges.columns if c in ("lo", "hi", "below", "rank")))
        side = F.broadcast(some) if ranges.count() <= BROADCAST_RANGES else some
        on: Column = (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"r{k}"))
        return rows.join(side, on)

    wide = (F.col("lo") < F.col("hi")) & (F.col("inside") > SORTED)
    at = [*keys, "lo", "hi", "below"]
    while not (open_ := state.filter(wide)).isEmpty():
        # ranks that are still in one range share its counts
        counts = within(open_.select(*at).distinct()).groupBy(*keys, F.col("lo").alias("from"), F.col("hi").alias("to"), "below", part_of(F.col("x"), F.col("lo"), F.col("hi")).alias("part"))
        counts = counts.agg(F.count(F.lit(1)).alias("inside"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        before = F.coalesce(F.sum("inside").over(Window.partitionBy(*keys, "from", "to", "below").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.select(*(F.col(k).alias(f"c{k}") for k in keys), "from", "to", "lo", "hi", (F.col("below") + before).alias("below"), "inside")
        ranks_ = open_.select(*keys, "n", "rank", F.col("lo").alias("a"), F.col("hi").alias("b"))
        held = (F.col("a") == F.col("from")) & (F.col("b") == F.col("to")) & (F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("inside"))
        for k in keys:
            held = held & F.col(k).eqNullSafe(F.col(f"c{k}"))
        state = kept(state.filter(~wide).unionByName(ranks_.join(counts, held).select(*state.columns)))
    done = state.filter("lo = hi").select(*keys, "rank", F.col("lo").alias("v"))
    w = Window.partitionBy(*keys, "rank").orderBy("x")
    rest = within(state.filter("lo < hi")).withColumn("at", F.row_number().over(w) - 1 + F.col("below")).filter("at = rank").select(*keys, "rank", F.col("x").alias("v"))
    values = done.unionByName(rest).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("m"))
    totals = whole.select(*(F.col(k).alias(f"t{k}") for k in keys), "n")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"t{k}"))
    out = values.join(totals, same)

    def at_share(s: float) -> Column:
        place = F.lit(s) * (F.col("n") - 1)
        low, high = (F.element_at("m", f(place).cast("long")) for f in (F.floor, F.ceil))
        return low + (high - low) * (place - F.floor(place))

    return out.select(*(F.col(k).alias(c) for k, c in zip(keys, by, strict=True)), *(at_share(s).alias(name) for name, s in shares.items()))


def register_queries(r: Registry) -> None:
    @r.query(
        "agg_percentile_exact",
        """SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 4) AS med, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90
        FROM lineitem GROUP BY 1, 2""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = exact_percentiles(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", {"med": 0.5, "p90": 0.9})
        return found.select("l_returnflag", "l_linestatus", F.round("med", 4).alias("med"), F.round("p90", 4).alias("p90"))
