"""Nearest vectors by cosine, exactly: cells around pivots, left out by the triangle inequality."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.selection import kept
from tessera.plans.registry import Registry
from tessera.session import table

#: Pivots at most (they are held by the driver and every task), and rows or queries of a chunk.
MAX_PIVOTS, CHUNK = 4096, 4096
#: Queries whose similarities to a chunk a task holds at once.
STEP = 256
#: Added to each bound, far above what rounding can do to unit vectors.
SLACK = 1e-7


def _usable(vector: Column, dim: int) -> Column:
    """Whether all `dim` components are there and finite, and not all are zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (F.size(vector) == dim) & ~bad & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _scaled(m: np.ndarray) -> np.ndarray:
    """The rows times a power of two that brings the largest component near one, so that no square is lost or overflows."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(1, keepdims=True))[1])


def _units(m: np.ndarray) -> np.ndarray:
    """The rows at length one."""
    m = _scaled(m)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _chords(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (units @ pivots.T), 0))


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, added up component by component, so that equal vectors give equal sums wherever they stand."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def _nearest_in_chunk(key: tuple, rows: pa.Table, queries: pa.Table, dim: int, k: int) -> pa.Table:
    """The k best of the chunk's rows for each query, and all that tie with the last by rounding."""
    schema = pa.schema([("row", pa.int64()), ("query", pa.int64()), ("neighbor", pa.int64()), ("similarity", pa.float64())])
    if not rows.num_rows or not queries.num_rows:
        return schema.empty_table()
    ids, m = rows.column("id").to_numpy(), _matrix(rows.column("v").combine_chunks(), dim)
    q_rows, q_ids, q = queries.column("row").to_numpy(), queries.column("query").to_numpy(), _matrix(queries.column("v").combine_chunks(), dim)
    floor = queries.column("floor").to_numpy()
    m_units, q_units = _units(m), _units(q)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(q), STEP):
        sims = q_units[at : at + STEP] @ m_units.T
        sims[q_ids[at : at + STEP, None] == ids[None]] = -np.inf  # a query is not its own neighbour
        least = floor[at : at + STEP]
        if sims.shape[1] > k:
            least = np.maximum(least, np.partition(sims, -k, axis=1)[:, -k])
        i, j = np.nonzero((sims >= least[:, None] - SLACK) & np.isfinite(sims))
        found.append((i + at, j))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    a, b = _scaled(q)[i], _scaled(m)[j]
    sim = _dots(a, b) / np.sqrt(_dots(a, a) * _dots(b, b))
    order = np.lexsort((ids[j], -sim, i))
    i, j, sim = i[order], j[order], sim[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    keep = place < k
    return pa.table([q_rows[i[keep]], q_ids[i[keep]], ids[j[keep]], sim[keep]], schema=schema)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, dim: int, id_col: str, vector_col: str) -> DataFrame:
    """query, neighbor, rank (from 1) and similarity: for each row of `queries` the k rows of `vectors` with the largest
    cosine, ties by the smaller id; rows with the query's own id are no neighbours. Exact.

    Each vector belongs to its nearest pivot (about the root of their number, at most MAX_PIVOTS, chosen by a hash). A
    query searches the nearest cells that hold 4 k vectors; its k-th best chord then bounds the rest: a cell is left out
    if its radius, or the plane halfway to the query's own pivot, keeps all of it farther away. Cells and their queries
    meet in chunks of about CHUNK each, so neither a cell with a third of the rows nor one that all queries ask for is
    one task, and a vector travels once for CHUNK queries. Pivots and one row a cell are all that the driver holds.

    Rows with a null id, or a vector that is null, has another length than `dim`, null, infinite or NaN components, or is
    all zero, are left out on both sides. Repeated rows each count. Rows with fewer than k others get fewer.
    """

    def some(df: DataFrame) -> DataFrame:
        two = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        return two.filter(F.col("id").isNotNull() & _usable(F.col("v"), dim))

    rows = some(vectors)
    count = rows.count()
    wanted = min(MAX_PIVOTS, math.isqrt(count) + 1)
    heads = rows.select("v").orderBy(F.xxhash64("id", "v"), "v").limit(wanted).toArrow()
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query long, neighbor long, rank int, similarity double")
    if not heads.num_rows:
        return empty
    pivots = np.unique(_units(_matrix(heads.column(0).combine_chunks(), dim)), axis=0)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = _chords(_units(_matrix(batch.column("v"), dim)), pivots)
                cell = far.argmin(1)
                yield pa.record_batch(
                    [*batch.columns, pa.array(cell, pa.int32()), pa.array(far[np.arange(len(cell)), cell])], names=["row", "id", "v", "cell", "far"]
                )

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", "v")
    placed = kept(numbered.mapInArrow(place, "row long, id long, v array<double>, cell int, far double"))
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).toArrow()  # a row a pivot at most
    held, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    held[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    radius[cells.column("cell").to_numpy()] = cells.column("radius").to_numpy()
    parts = -(-held // CHUNK)

    def visits(first: bool):
        """The cells of each query: the nearest ones with 4 k vectors, or the others within its bound."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, STEP):
                    batch = whole.slice(at, STEP)
                    far = _chords(_units(_matrix(batch.column("v"), dim)), pivots)
                    order = np.argsort(far, axis=1, kind="stable")
                    enough = np.cumsum(held[order], axis=1) - held[order] < 4 * k  # those before don't hold enough
                    near = np.zeros(far.shape, bool)
                    np.put_along_axis(near, order, enough, axis=1)
                    if not first:
                        bound = np.sqrt(np.maximum(2 - 2 * batch.column("floor").to_numpy(), 0))[:, None] + 1e-3 * math.sqrt(SLACK)
                        reach = np.maximum(far - radius[None], (far - far.min(1, keepdims=True)) / 2)
                        near = ~near & (reach <= bound)
                    i, j = np.nonzero(near & (held > 0)[None])
                    taken = batch.take(pa.array(i))
                    yield pa.record_batch([*taken.columns, pa.array(j, pa.int32())], names=[*batch.schema.names, "cell"])

        return run

    def search(asked: DataFrame, first: bool) -> DataFrame:
        """The best of each chunk for every query that visits it."""
        pairs = kept(asked.select("row", "query", "v", "floor").mapInArrow(visits(first), "row long, query long, v array<double>, floor double, cell int"))
        sides = spark.createDataFrame([(c, int(p)) for c, p in enumerate(parts)], "cell int, parts int")
        blocks = pairs.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("blocks"))  # a row a pivot at most
        both = F.broadcast(blocks.join(sides, "cell"))
        chunk = placed.join(both, "cell").select(
            "cell", F.pmod(F.xxhash64("row"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "v"
        )
        ask = pairs.join(both, "cell").select(
            "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("row"), "blocks").cast("int").alias("block"), "row", "query", "v", "floor"
        )
        keys = ["cell", "part", "block"]
        met = chunk.groupBy(*keys).cogroup(ask.groupBy(*keys))
        return met.applyInArrow(lambda key, a, b: _nearest_in_chunk(key, a, b, dim, k), "row long, query long, neighbor long, similarity double")

    order = Window.partitionBy("row").orderBy(F.desc("similarity"), "neighbor")
    asked = kept(some(queries).select(F.monotonically_increasing_id().alias("row"), F.col("id").alias("query"), "v", F.lit(-2.0).alias("floor")))
    best = kept(search(asked, True).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
    # fewer than k found: everything may still be one of the best
    floors = best.groupBy("row").agg(F.when(F.count(F.lit(1)) == k, F.min("similarity")).otherwise(-2.0).alias("least"))
    bounded = kept(asked.join(floors, "row", "left").select("row", "query", "v", F.coalesce("least", F.lit(-2.0)).alias("floor")))
    merged = best.drop("rank").unionByName(search(bounded, False))
    ranked = merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query", "neighbor", "rank", "similarity")


def register_queries(r: Registry) -> None:
    @r.query(
        "vec_nearest",
        """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) = 64
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s AS (SELECT a.vec_id AS query, b.vec_id AS neighbor, list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) AS sim
            FROM v a JOIN v b ON b.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0)
        SELECT query, neighbor, CAST(row_number() OVER (PARTITION BY query ORDER BY sim DESC, neighbor) AS INT) AS rank, round(sim, 5) AS similarity
        FROM s QUALIFY rank <= 10""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        vectors = table(spark, sf_dir, "embeddings")
        found = nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0), 10, 64, "vec_id", "embedding")
        return found.withColumn("similarity", F.round("similarity", 5))
