"""Nearest vectors against all pairs, with hot cells, ties, awkward rows and chunks of a few rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import vectors
from tessera.operators.vectors import nearest

SCHEMA = "vec_id long, row int, v array<double>"


def brute(rows, queries, k):
    def ok(r):
        x = r[2]
        return r[0] is not None and x is not None and len(x) == 4 and all(c is not None and np.isfinite(c) for c in x) and any(x)

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / np.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    out = []
    for q in filter(ok, queries):
        best = sorted((-cosine(q[2], r[2]), r[0]) for r in rows if ok(r) and r[0] != q[0])[:k]
        out += [(q[0], n, at, round(-s, 9)) for at, (s, n) in enumerate(best, 1)]
    return sorted(out)


def found(spark, rows, queries, k):
    got = nearest(spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(queries, SCHEMA), k, 4, "vec_id", "v").collect()
    return sorted((r["query"], r["neighbor"], r["rank"], round(r["similarity"], 9)) for r in got)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 16)
    monkeypatch.setattr(vectors, "STEP", 8)


def test_equals_all_pairs(spark, small):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 4))
    rows = [(k, 0, [float(x) for x in centres[k % 12] + rng.normal(size=4) * 0.1]) for k in range(400)]
    rows += [(k, 0, [1.0, 2.0, 2.0, 0.5]) for k in range(400, 600)]  # one vector with a third of the rows
    queries = rows[::25] + [(400, 1, [1.0, 2.0, 2.0, 0.5])] * 20 + [(-1, 0, [9.0, -1.0, 0.0, 0.0])]
    want = brute(rows, queries, 7)
    assert found(spark, rows, queries, 7) == want
    assert len(want) == 7 * len(queries)


def test_awkward_rows(spark, small):
    big, nan, inf = 1e200, float("nan"), float("inf")
    rows = [(1, 0, [1.0, 0.0, 0.0, 0.0]), (1, 0, [1.0, 0.0, 0.0, 0.0]), (2, 0, [1.0, 0.0, 0.0, 0.0]), (3, 0, [0.0, 1.0, 0.0, 0.0]), (3, 0, [0.0, 1.0, 0.0, 0.0])]
    rows += [(4, 0, None), (5, 0, []), (6, 0, [1.0]), (7, 0, [1.0, None, 0.0, 0.0]), (8, 0, [nan, 1.0, 1.0, 1.0]), (9, 0, [inf, 1.0, 1.0, 1.0])]
    rows += [(10, 0, [0.0] * 4), (None, 0, [1.0, 1.0, 0.0, 0.0]), (11, 0, [-1.0, -1.0, 0.0, 0.0])]
    assert found(spark, rows, rows, 10) == brute(rows, rows, 10)
    assert found(spark, rows, [], 3) == [] and found(spark, [], rows, 3) == []
    far = [(1, 0, [big, big, 0.0, 0.0]), (2, 0, [-big, -big, 0.0, 0.0]), (3, 0, [1 / big, 1 / big, 0.0, 0.0])]
    assert found(spark, far, far[:1], 3) == [(1, 2, 2, -1.0), (1, 3, 1, 1.0)]
    assert found(spark, rows[3:4], rows[:1], 5) == [(1, 3, 1, 0.0)]


def test_far_cells_are_left_out(spark, small, monkeypatch):
    """Clusters far from a query are not read, and the result is whole."""
    rng = np.random.default_rng(7)
    centres = np.eye(4)
    rows = [(k, 0, [float(x) for x in centres[k % 4] + rng.normal(size=4) * 0.01]) for k in range(800)]
    read = spark.sparkContext.accumulator(0)
    plain = vectors._nearest_in_chunk

    def counting(key, a, b, dim, k):
        read.add(a.num_rows * b.num_rows)
        return plain(key, a, b, dim, k)

    monkeypatch.setattr(vectors, "_nearest_in_chunk", counting)
    queries = rows[::40]
    assert found(spark, rows, queries, 5) == brute(rows, queries, 5)
    assert 0 < read.value < len(rows) * len(queries) / 2


def test_no_cross_join(spark):
    df = spark.range(300).select(F.col("id").alias("vec_id"), F.array(*(F.rand(k) + 0.1 for k in range(4))).alias("v"))
    plan = nearest(df, df.limit(5), 3, 4, "vec_id", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan
