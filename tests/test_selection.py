"""Exact percentiles against numpy, with ranges that have to be narrowed."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import selection
from tessera.operators.selection import exact_percentiles


def test_percentiles_equal_numpy(spark, monkeypatch):
    monkeypatch.setattr(selection, "SORTED", 20)
    monkeypatch.setattr(selection, "PARTS", 8)
    rng = random.Random(3)
    rows = [("ties", 5.0)] * 700 + [("ties", float(k)) for k in range(300)] + [("one", 1.5)] + [("two", 1.0), ("two", 2.0)]
    rows += [("far", rng.choice([-1, 1]) * 10.0 ** rng.randint(-200, 200)) for _ in range(500)] + [(None, rng.gauss(0, 1)) for _ in range(400)]
    rows += [("ties", None), ("ties", float("nan")), ("none", None)]
    df = spark.createDataFrame([(g, x, 1, 2) for g, x in rows], "g string, x double, n int, rank int").repartition(5)
    shares = {"low": 0.0, "q": 0.25, "med": 0.5, "most": 0.99, "n": 1.0}
    found = exact_percentiles(df, ["g"], "x", shares)
    assert "percentile(" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r["g"]: tuple(r)[1:] for r in found.collect()}
    assert got.keys() == {"ties", "one", "two", "far", None}
    for g, values in got.items():
        own = sorted(x for h, x in rows if h == g and x is not None and x == x)
        assert np.allclose(values, [np.quantile(own, s) for s in shares.values()], rtol=1e-12)
    assert exact_percentiles(df.limit(0), ["g"], "x", shares).collect() == []
    assert exact_percentiles(df.filter(F.col("g") == "two"), [], "x", {"med": 0.5}).collect()[0]["med"] == 1.5


def test_ranks_of_a_range_share_a_pass_without_quantiles(spark, monkeypatch):
    passes, seen = [], selection.kept

    def counted(df):
        passes.append(df._jdf.queryExecution().optimizedPlan().toString())
        return seen(df)

    monkeypatch.setattr(selection, "kept", counted)
    monkeypatch.setattr(selection, "SORTED", 50)
    rng = random.Random(5)
    values = [round(rng.uniform(900, 105_000), 2) for _ in range(4000)] + [float("inf"), float("-inf"), -0.0, 0.0, 5e-324, -5e-324]
    found = exact_percentiles(spark.createDataFrame([(x,) for x in values], "x double"), [], "x", {"q": 0.2, "med": 0.5, "most": 0.99})
    got = tuple(found.collect()[0])
    assert np.allclose(got, [np.quantile(sorted(values), s) for s in (0.2, 0.5, 0.99)], rtol=1e-12)
    assert len(passes) <= 4 and not any("percentile" in p for p in passes)
