"""Centroid clustering: plain Lloyd rounds on whole numbers, exact whatever the order of rows and tasks."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import map_pandas
from tessera.session import table


@dataclass(frozen=True)
class Plan:
    """`clusters` centroids, `rounds` of assigning and moving, vectors of `dims` components turned into floor(scale * x).

    `scale` is a power of two, so scale * x is exact. The first centroids are the vectors with the smallest
    sha256 of "`seed`:<id>".
    """

    clusters: int = 16
    rounds: int = 3
    dims: int = 64
    scale: int = 64
    seed: int = 1


#: Below this, squared distances of 64 components fit 64 bits; larger components are handled as Python's whole numbers.
SMALL = 1 << 27
#: Sums travel as digits of so many bits, so that no total overflows.
DIGIT = 40


def kept_vectors(vectors: DataFrame, plan: Plan, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors with exactly `dims` components, none of them null, NaN or infinite."""
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v")).filter((F.size("v") == plan.dims) & sound)


def whole(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of a matrix of finite doubles: 64-bit integers, or Python's where one is large."""
    with np.errstate(over="ignore"):
        scaled = np.floor(v * scale)
    if not v.size or np.abs(scaled).max() < SMALL:
        return scaled.astype(np.int64)
    # from 2**53 on, a double is a whole number
    exact = [[int(x) * scale if abs(x) >= 1 << 53 else math.floor(x * scale) for x in row] for row in v.tolist()]
    out = np.empty(v.shape, object)
    out[:] = exact
    return out


def assign(v: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid; of equally near ones the lowest number."""
    c = np.array(centroids, object)
    if v.dtype != object and max(abs(x) for row in centroids for x in row) < SMALL:
        c = c.astype(np.int64)
    else:
        v = v.astype(object)
    squared = np.empty((len(c), len(v)), v.dtype)
    for k in range(len(c)):
        d = v - c[k]
        squared[k] = (d * d).sum(axis=1)
    nearest = squared.argmin(axis=0)
    return nearest, squared[nearest, np.arange(len(v))]


def _matrices(frames: Iterator[pd.DataFrame], scale: int) -> Iterator[tuple[pd.Series, np.ndarray]]:
    for frame in frames:
        if len(frame):
            yield frame["vec_id"], whole(np.stack(frame["v"].to_numpy()).astype(np.float64), scale)


def _totals(kept: DataFrame, centroids: list[list[int]], plan: Plan) -> dict[int, tuple[int, int, list[int]]]:
    """By cluster: its vectors, their summed distance, and their sum.

    A task returns a row for each cluster and component (place 0: vectors, 1: distance, then the sums), which one
    groupBy adds up; the driver gets clusters * (dims + 2) totals, or a few digits of each if they are very large.
    """
    shared = kept.sparkSession.sparkContext.broadcast(centroids)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(shared.value), plan.dims + 2), object)
        for _, v in _matrices(frames, plan.scale):
            nearest, distance = assign(v, shared.value)
            for k in np.unique(nearest).tolist():
                own = nearest == k
                sums[k, 0] += int(own.sum())
                sums[k, 1] += sum(distance[own].tolist())
                sums[k, 2:] += v[own].sum(axis=0).astype(object)
        rows = []
        for (k, place), total in np.ndenumerate(sums):
            digit, left = 0, int(total)
            while sums[k, 0] and (left or not digit):
                top = -1 << DIGIT < left < 1 << DIGIT
                rows.append((k, place, digit, left if top else left & ((1 << DIGIT) - 1)))
                digit, left = digit + 1, 0 if top else left >> DIGIT
        yield pd.DataFrame(rows, columns=["cluster", "place", "digit", "value"])

    partial = map_pandas(kept, run, "cluster int, place int, digit int, value long")
    found: dict[int, list[int]] = {}
    for k, place, digit, value in partial.groupBy("cluster", "place", "digit").agg(F.sum(F.col("value").cast("decimal(20,0)"))).collect():
        found.setdefault(k, [0] * (plan.dims + 2))[place] += int(value) << (DIGIT * digit)
    shared.destroy()
    return {k: (x[0], x[1], x[2:]) for k, x in found.items()}


def first_centroids(kept: DataFrame, plan: Plan) -> list[list[int]]:
    """The starting vectors in order of their digest; of a repeated id the vector that sorts first. Null ids never start."""
    digest = F.sha2(F.concat(F.lit(f"{plan.seed}:"), F.col("vec_id").cast("string")), 256)
    top = kept.filter("vec_id IS NOT NULL").select("v", digest.alias("digest")).orderBy("digest", "v").limit(plan.clusters).collect()
    return [whole(np.array([r["v"]], np.float64), plan.scale)[0].tolist() for r in top]


def lloyd(kept: DataFrame, plan: Plan) -> list[list[int]]:
    """The centroids after `rounds` rounds. Each round is one pass over the vectors; the driver holds only centroids."""
    centroids = first_centroids(kept, plan)
    for _ in range(plan.rounds if centroids else 0):
        for k, (n, _, sums) in _totals(kept, centroids, plan).items():
            centroids[k] = [s // n for s in sums]
    return centroids


def _long(x: int) -> int | None:
    return x if -(1 << 63) <= x < 1 << 63 else None


def cluster(vectors: DataFrame, plan: Plan = Plan(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:  # noqa: B008
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each kept vector.

    Vectors that are null, of another length, or hold a null, NaN or infinity are left out. Equally near centroids:
    the lowest number; a cluster without vectors keeps its centroid. With fewer ids than clusters there are as many
    centroids as ids; without any, or on an empty table, the result is empty. A null id is assigned but never starts a
    centroid; repeated rows count each; other columns of any name are ignored. Components of any size are exact; a
    distance or inertia beyond 64 bits is null.
    """
    kept = kept_vectors(vectors, plan, id_col, vec_col)
    centroids = lloyd(kept, plan)
    totals = _totals(kept, centroids, plan) if centroids else {}
    own = [_long(totals[k][1]) if k in totals else 0 for k in range(len(centroids))]
    every = _long(sum(x[1] for x in totals.values()))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    shared = kept.sparkSession.sparkContext.broadcast(centroids)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, v in _matrices(frames, plan.scale):
            if not shared.value:
                continue
            nearest, distance = assign(v, shared.value)
            yield pd.DataFrame(
                {
                    "vec_id": ids,
                    "cluster": nearest.astype(np.int32),
                    "distance": pd.array([_long(x) for x in distance.tolist()], "Int64"),
                    "cluster_inertia": pd.array([own[k] for k in nearest.tolist()], "Int64"),
                    "inertia": pd.array([every] * len(nearest), "Int64"),
                    "centroid_sha256": [digests[k] for k in nearest.tolist()],
                }
            )

    schema = T.StructType([kept.schema["vec_id"], T.StructField("cluster", T.IntegerType())])
    for name in ("distance", "cluster_inertia", "inertia"):
        schema.add(name, T.LongType())
    return map_pandas(kept, run, schema.add("centroid_sha256", T.StringType()))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rows over all of `embeddings`."""
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql(plan: Plan) -> str:
    """The same in SQL, the rounds written out."""
    steps = [
        f"""kept AS (
    SELECT vec_id, embedding AS e, list_transform(embedding, lambda x: CAST(floor({plan.scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {plan.dims} AND len(embedding) = {plan.dims})""",
        f"""c0 AS (
    SELECT CAST(row_number() OVER (ORDER BY d, e) - 1 AS INTEGER) AS k, v
    FROM (SELECT sha256('{plan.seed}:' || vec_id) AS d, e, v FROM kept WHERE vec_id IS NOT NULL ORDER BY d, e LIMIT {plan.clusters}))""",
    ]
    for i in range(plan.rounds + 1):
        steps.append(
            f"""a{i} AS (
    SELECT kept.vec_id, kept.v, c.k,
           CAST(list_sum(list_transform(list_zip(kept.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
    FROM kept, c{i} c QUALIFY row_number() OVER (PARTITION BY kept.vec_id, kept.e ORDER BY d, c.k) = 1)"""
        )
        if i < plan.rounds:
            steps.append(
                f"""s{i} AS (
    SELECT k, i, sum(x) AS s, count(*) AS n
    FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY k, i),
c{i + 1} AS (
    SELECT c.k, coalesce(m.v, c.v) AS v
    FROM c{i} c LEFT JOIN (
        SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{i} GROUP BY k) m ON c.k = m.k)"""
            )
    last = plan.rounds
    return f"""
WITH {", ".join(steps)}
SELECT a.vec_id, a.k AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{last} a JOIN c{last} c ON a.k = c.k
"""


SQL = _sql(Plan())
