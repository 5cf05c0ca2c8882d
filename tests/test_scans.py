"""Window columns over a whole table against one ordered pass in Python."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import scans
from tessera.operators.scans import over_all
from tessera.operators.selection import kept


def expected(rows, lag):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] if r[1] is not None else 0, r[0]))
    out, total, seen, most, last, first = {}, None, 0, None, None, None
    for k, (i, _, v) in enumerate(rows):
        if v is not None:
            total, seen, most, last = (total or 0) + v, seen + 1, v if most is None else max(most, v), v
            first = v if first is None else first
        other = rows[k - lag][0] if 0 <= k - lag < len(rows) else None
        out[i] = (k + 1, total, seen, most, last, first, other)
    return out


@pytest.mark.parametrize("lag", [1, 3, -2, 700, -700])
def test_running_columns_of_a_whole_table(spark, lag):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 5, 5, 5, rng.randint(0, 400)]), rng.choice([None, rng.randint(-50, 50)])) for i in range(1_500)]
    df = spark.createDataFrame(rows, "i int, k int, _part int").repartition(7)
    columns = {
        "n": ("number",),
        "total": ("sum", F.col("_part")),
        "seen": ("count", F.col("_part")),
        "most": ("max", F.col("_part")),
        "last": ("last", F.col("_part")),
        "first": ("first", F.col("_part")),
        "other": ("lag", F.col("i"), lag),
    }
    got = over_all(df, [F.col("k"), F.col("i")], columns)
    assert got.columns == ["i", "k", "_part", *columns]
    assert {r["i"]: tuple(r)[3:] for r in got.collect()} == expected(rows, lag)


def test_ties_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(1, {"a": 1})] * 400 + [(0, None)] * 3, "k int, m map<string,int>")
    got = over_all(df, [F.desc("k")], {"k": ("number",), "n": ("sum", F.lit(1))}).collect()
    assert sorted(r["k"] for r in got) == list(range(1, 404)) and all(r["k"] == r["n"] for r in got)
    assert all((r["m"] is None) == (r["k"] > 400) for r in got)
    assert over_all(df.limit(0), [F.col("k")], {"n": ("number",), "b": ("lag", F.col("k"), 1)}).collect() == []
    with pytest.raises(ValueError):
        over_all(df, [F.col("k")], {"n": ("median", F.col("k"))})


def test_no_task_gets_all_rows(spark, monkeypatch):
    """A hot value of the order is dealt to several parts, and only one row a part passes through one task."""
    df = spark.range(20_000).select(F.col("id"), F.lit(1).alias("k")).repartition(4)
    written = []
    monkeypatch.setattr(scans, "kept", lambda rows: written.append(kept(rows)) or written[-1])
    got = over_all(df, [F.col("k")], {"n": ("number",), "b": ("lag", F.col("id"), 1)})
    sizes = [r["count"] for r in written[0].groupBy("_part").count().collect()]
    assert len(sizes) == 8 and sum(sizes) == 20_000 and max(sizes) < 5_000
    assert written[1].count() == 8
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan
