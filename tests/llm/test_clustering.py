"""Centroid clustering against plain Python on whole numbers."""

import hashlib
import math

from oracle import TESTDATA, compare

from tessera.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, label int, v string, cluster string, distance string"


def by_brute_force(rows, plan):
    kept = [(i, [math.floor(x) * plan.scale if abs(x) > 2.0**60 else math.floor(plan.scale * x) for x in v], v) for i, v in rows]
    name = lambda i: hashlib.sha256(f"{plan.seed}:{i}".encode()).hexdigest()
    start = sorted((name(i), raw, q) for i, q, raw in kept if i is not None)
    c = [q for _, _, q in start[: plan.clusters]]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, m, strict=True)), k) for k, m in enumerate(c))

    for _ in range(plan.rounds):
        own = {}
        for _, q, _ in kept:
            own.setdefault(nearest(q)[1], []).append(q)
        for k, qs in own.items():
            c[k] = [sum(x) // len(qs) for x in zip(*qs, strict=True)]
    found = [(i, *nearest(q)) for i, q, _ in kept]
    long = lambda x: x if x < 1 << 63 else None
    total = long(sum(d for _, d, _ in found))
    return sorted(
        (repr(i), k, long(d), long(sum(e for _, e, m in found if m == k)), total, hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest())
        for i, d, k in found
    )


def found(df):
    return sorted((repr(r[0]), *r[1:]) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, v, None, "a", "b", "c") for i, v in rows], SCHEMA)


def test_equals_sql(spark):
    assert compare(spark, clustering.op13_centroids, clustering.SQL, f"{TESTDATA}/sf0.001") == 500


def test_awkward_vectors(spark):
    plan = clustering.Plan(clusters=4, rounds=3, dims=3)
    good = [(k, [float(k % 7) / 3, -float(k % 5), 0.1 * k]) for k in range(60)] + [(7, [1.0, 2.0, 3.0])] * 3 + [(None, [0.5, 0.5, -0.5])]
    bad = [(100, None), (101, []), (102, [1.0, 2.0]), (103, [1.0, 2.0, 3.0, 4.0]), (104, [1.0, None, 2.0]), (105, [float("nan"), 0.0, 0.0]), (106, [0.0, float("-inf"), 0.0])]
    rows = clustering.cluster(frame(spark, good + bad).repartition(5), plan)
    assert rows.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert found(rows) == by_brute_force(good, plan)


def test_large_components_stay_exact(spark):
    plan = clustering.Plan(clusters=3, rounds=2, dims=2)
    rows = [(k, [float(1 << (k % 100)), -float(k)]) for k in range(40)] + [(200, [2.0**120, 2.0**90]), (201, [-(2.0**126), 1.5])]
    assert found(clustering.cluster(frame(spark, rows).repartition(4), plan)) == by_brute_force(rows, plan)


def test_few_and_no_vectors(spark):
    plan = clustering.Plan(clusters=16, dims=2)
    few = [(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [5.0, 5.0])]
    assert found(clustering.cluster(frame(spark, few), plan)) == by_brute_force(few, plan)
    assert clustering.cluster(frame(spark, []), plan).collect() == []
    assert clustering.cluster(frame(spark, [(None, [1.0, 2.0])]), plan).collect() == []
