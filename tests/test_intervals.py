"""Point and range joins against the nested loop: any length, endless ranges, hot points, awkward values."""

import random

from pyspark.sql import functions as F

from tessera.operators import intervals
from tessera.operators.intervals import cell, exponent, overlap_join, point_join, range_totals

INF, NAN = float("inf"), float("nan")


def pairs(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def test_points_meet_ranges_of_any_length(spark):
    rng = random.Random(5)
    values = [rng.gauss(0, 1) * 10.0 ** rng.randint(-3, 6) for _ in range(300)] + [7.0] * 40 + [0.0, 1.0, None, NAN, INF, -INF]
    points = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "p int, x double")
    cuts = [(rng.gauss(0, 1) * 10.0 ** rng.randint(-3, 6), 10.0 ** rng.randint(-6, 7)) for _ in range(120)]
    ends = [(a, a + length) for a, length in cuts] + [(-INF, INF), (7.0, 7.0), (7.0, 7.5), (8.0, 7.0), (None, 9.0), (0.0, None), (0.0, 1.0), (1e7, INF), (-INF, 0.0)]
    ranges = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(ends)], "r int, a double, b double")
    got = pairs(point_join(points, F.col("x"), ranges, F.col("a"), F.col("b")), "p", "r")
    finite = [(p, v) for p, v in enumerate(values) if v is not None and abs(v) < INF]
    want = [(p, k) for p, v in finite for k, (a, b) in enumerate(ends) if a is not None and b is not None and a <= v < b]
    assert got == sorted(want, key=repr)
    assert point_join(points.limit(0), F.col("x"), ranges, F.col("a"), F.col("b")).columns == ["p", "x", "r", "a", "b"]
    assert point_join(points.limit(0), F.col("x"), ranges, F.col("a"), F.col("b")).collect() == []
    assert point_join(points, F.col("x"), ranges.limit(0), F.col("a"), F.col("b")).collect() == []
    one = spark.createDataFrame([(1, 3.0)], "p int, x double")
    around = [(k,) for k, (a, b) in enumerate(ends) if a is not None and b is not None and a <= 3.0 < b]
    assert pairs(point_join(one, F.col("x"), ranges, F.col("a"), F.col("b")), "r") == sorted(around, key=repr)


def test_ranges_of_any_length_are_copied_a_few_times(spark):
    rng = random.Random(4)
    ends = [(a, a + 10.0 ** rng.uniform(-12, 9)) for a in (rng.uniform(-1e9, 1e9) for _ in range(500))] + [(-1e9, 1e9), (0.0, 0.0), (-5.0, -5.0)]
    lo, hi = F.col("a"), F.col("b")
    nodes = spark.createDataFrame(ends, "a double, b double").withColumn("e", exponent(lo, hi, 2e9))
    sizes = nodes.agg(F.max(cell(hi, F.col("e")) - cell(lo, F.col("e")) + 1).alias("most"), F.countDistinct("e").alias("levels")).first()
    assert sizes["most"] <= 5 and sizes["levels"] <= intervals.FINEST + 1
    points = spark.range(10_000).select(F.col("id").alias("p"))
    ranges = spark.createDataFrame([(1, -INF, INF)], "r int, a double, b double")
    assert point_join(points, F.col("p"), ranges, lo, hi).count() == 10_000


def test_hot_points_and_ranges_are_dealt(spark):
    """Two thirds of the points at one value, and most ranges alike: the parts hold them all, none in one task."""
    points = spark.range(3_000).select(F.col("id").alias("p"), F.when(F.col("id") % 3 > 0, 5).otherwise(F.col("id")).alias("x"), F.lit(None).cast("map<string,int>").alias("m"))
    ranges = spark.range(200).select(F.col("id").alias("r"), F.when(F.col("id") < 150, 4).otherwise(F.col("id") * 9).alias("a"))
    low, high = F.col("a"), F.col("a") + F.lit(3)
    met = point_join(points, F.col("x"), ranges, low, high)
    want = points.crossJoin(ranges).filter((F.col("x") >= low) & (F.col("x") < high))
    assert pairs(met, "p", "r") == pairs(want, "p", "r")


def test_overlaps_equal_the_nested_loop(spark):
    rng = random.Random(8)

    def ranges(n, grid):
        out = []
        for k in range(n):
            a = rng.randint(0, 200) * grid
            out.append((k, rng.choice(["u", "v", None]), a, a + rng.choice([0, -1, 1, 3, 40, 1000]) * grid))
        return [*out, (n, "u", None, 3), (n + 1, "u", 2, None)]

    one, two = ranges(90, 1), ranges(70, 2)
    a = spark.createDataFrame(one, "i int, k string, a long, b long")
    b = spark.createDataFrame(two, "j int, k string, c long, d long")
    fits = lambda x, y: None not in (*x[2:], *y[2:]) and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3]
    bounds = (F.col("a"), F.col("b")), (F.col("c"), F.col("d"))
    got = overlap_join(a, *bounds[0], b, *bounds[1], ("k",))
    assert pairs(got, "i", "j") == sorted(((x[0], y[0]) for x in one for y in two if x[1] is not None and x[1] == y[1] and fits(x, y)), key=repr)
    got = overlap_join(a.drop("k"), *bounds[0], b.drop("k"), *bounds[1])
    assert pairs(got, "i", "j") == sorted(((x[0], y[0]) for x in one for y in two if fits(x, y)), key=repr)


def test_totals_of_ranges_form_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(intervals, "CHUNK", 40)
    rng = random.Random(4)
    points = [(rng.choice([rng.uniform(-50, 50), float(rng.randint(-50, 50)), 7.0]), rng.choice([None, rng.randint(-99, 99)])) for _ in range(1500)]
    points += [(None, 1), (float("nan"), 2), (float("inf"), 3), (7.25, None)]
    inf = float("inf")
    ranges = [(rng.choice([None, *range(60)]), a := rng.uniform(-60, 60), a + rng.choice([0, 0.01, 1, 30, 200])) for _ in range(400)]
    ranges += [(100, -inf, inf), (101, 7.0, 7.0), (102, 7.25, 7.2500001), (103, 7.0, 7.0000001), (104, None, 2.0), (105, 2.0, 1.0), (106, 90.0, 91.0)]
    ranges += [(200 + k, 6.9, 7.1) for k in range(300)]
    p = spark.createDataFrame(points, "at double, v long").repartition(4)
    r = spark.createDataFrame(ranges, "who long, low double, high double").repartition(3)
    found = range_totals(p, F.col("at"), F.col("v"), r, F.col("low"), F.col("high"), ["who"])
    got = {x["who"]: (x["n"], x["least"]) for x in found.collect()}
    expected = {}
    for who, low, high in ranges:
        own = [v for at, v in points if at is not None and low is not None and abs(at) < inf and low <= at < high]
        expected[who] = expected.get(who, []) + own
    assert got == {w: (len(own), min((v for v in own if v is not None), default=None)) for w, own in expected.items() if own}
    for some, other in ((p.limit(0), r), (p, r.limit(0))):
        assert range_totals(some, F.col("at"), F.col("v"), other, F.col("low"), F.col("high"), ["who"]).collect() == []
