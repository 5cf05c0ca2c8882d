"""User-defined functions of every kind: scalar, vectorised, aggregate, grouped, partition-wise, table, SQL."""

from __future__ import annotations

import datetime
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from tessera.plans.registry import Registry
from tessera.session import register, table

#: Keys of which a task holds states before it sends them on.
HELD_KEYS = 50_000
#: Rows that a call of a grouped map gets on average, where groups are small.
CALL_ROWS = 32_768


def merged(a: tuple[int, float, float], b: tuple[int, float, float]) -> tuple[int, float, float]:
    """Count, mean and summed squared deviations of two sets of numbers together."""
    n = a[0] + b[0]
    if not n:
        return a
    off = b[1] - a[1]
    return n, a[1] + off * b[0] / n, a[2] + b[2] + off * off * (a[0] / n) * b[0]


def _states(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Key, count, mean and summed squared deviations of each key in the batch; null values don't count."""
    coded = batch.column("key").dictionary_encode(null_encoding="encode")
    valid = pc.is_valid(batch.column("x")).to_numpy(zero_copy_only=False)
    codes, x = coded.indices.to_numpy()[valid], batch.column("x").drop_null().to_numpy()
    size = len(coded.dictionary)
    n = np.bincount(codes, minlength=size)
    mean = np.bincount(codes, x, size) / np.maximum(n, 1)
    m2 = np.bincount(codes, (x - mean[codes]) ** 2, size)
    yield from zip(coded.dictionary.to_pylist(), n.tolist(), mean.tolist(), m2.tolist(), strict=True)


def mergeable_deviation(df: DataFrame, by: str, value: str) -> DataFrame:
    """`by`, n, mean and deviation (of a sample) of each key: an aggregate of one's own by states that can be merged.

    Each task folds its Arrow batches into one state a key, and sends its states on when it holds more than HELD_KEYS; so
    a key with any share of the rows arrives as a state a task. The states of a key are merged by Chan's formula. Null values
    don't count; a null key is a group; a key without values has n = 0, a null mean, and one with fewer than two a null deviation.
    """
    kind = df.schema[by].dataType
    schema = StructType().add("key", kind).add("n", "long").add("mean", "double").add("m2", "double")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        names = out_schema = None

        def sent() -> pa.RecordBatch:
            keys, states = list(held), list(zip(*held.values(), strict=True)) or [[], [], []]
            held.clear()
            return pa.record_batch([pa.array(keys, out_schema), *(pa.array(c, t) for c, t in zip(states, (pa.int64(), pa.float64(), pa.float64()), strict=True))], names=names)

        for batch in batches:
            names, out_schema = ["key", "n", "mean", "m2"], batch.schema.field("key").type
            for key, *state in _states(batch):
                held[key] = merged(held[key], tuple(state)) if key in held else tuple(state)
            if len(held) > HELD_KEYS:
                yield sent()
        if held:
            yield sent()

    def merge(states: pa.Table) -> pa.Table:
        total = (0, 0.0, 0.0)
        for one in sorted(zip(*(states[c].to_pylist() for c in ("n", "mean", "m2")), strict=True)):  # whatever order they came in
            total = merged(total, one)
        n, mean, m2 = total
        return pa.table({"key": states["key"].slice(0, 1), "n": [n], "mean": pa.array([mean if n else None], pa.float64()), "m2": pa.array([math.sqrt(m2 / (n - 1)) if n > 1 else None], pa.float64())})

    partial = df.select(F.col(by).alias("key"), F.col(value).cast("double").alias("x")).mapInArrow(fold, schema)
    return partial.groupBy("key").applyInArrow(merge, schema).select(F.col("key").alias(by), "n", "mean", F.col("m2").alias("deviation"))


class Sessions:
    """Table function over a table of a key and a time: a row for each run of rows of one key with gaps of less than
    `minutes`. It asks for its input by key, in order of time, and holds one run at a time, however many rows a key has."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, minutes: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or len(rows.dataType.fields) != 2:
            raise ValueError("sessions need a table of a key and a time")
        key, at = rows.dataType.fields
        out = StructType().add(key.name, key.dataType).add("first", at.dataType).add("last", at.dataType).add("n", LongType())
        return AnalyzeResult(out, partitionBy=[PartitioningColumn(key.name)], orderBy=[OrderingColumn(at.name)])

    def __init__(self):
        self._open = None

    def eval(self, row, minutes: int):
        key, at = row[0], row[1]
        if at is None:
            return
        if self._open and at - self._open[2] < datetime.timedelta(minutes=minutes):
            self._open[2], self._open[3] = at, self._open[3] + 1
            return
        done, self._open = self._open, [key, at, at, 1]
        if done:
            yield tuple(done)

    def terminate(self):
        if self._open:
            yield tuple(self._open)


def register_queries(r: Registry) -> None:
    same = "SELECT p_partkey, p_name || '!' AS loud FROM part"

    @r.query("udf_scalar", same)
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        loud = F.udf(lambda s: None if s is None else s + "!", "string")
        return table(spark, sf_dir, "part").select("p_partkey", loud("p_name").alias("loud"))

    @r.query("udf_pandas", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        @F.pandas_udf("double")
        def net(price: pd.Series, off: pd.Series) -> pd.Series:
            return price * (1 - off)

        return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", net("l_extendedprice", "l_discount").alias("net"))

    @r.query("udf_arrow", same)
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        @F.arrow_udf("string")
        def loud(s: pa.Array) -> pa.Array:
            return pc.binary_join_element_wise(s, "!", "")

        return table(spark, sf_dir, "part").select("p_partkey", loud("p_name").alias("loud"))

    @r.query("udf_aggregate", "SELECT o_orderstatus, round(sqrt(avg(o_totalprice * o_totalprice)), 4) AS rms FROM orders GROUP BY 1")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        @F.pandas_udf("double")
        def mean_square(x: pd.Series) -> float:
            return float((x * x).sum())

        # sums per (status, slice) first, so that no group of unbounded size meets in one call
        part = table(spark, sf_dir, "orders").groupBy("o_orderstatus", (F.col("o_orderkey") % 64).alias("slice"))
        squares = part.agg(mean_square("o_totalprice").alias("s"))
        counts = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("o_totalprice").alias("n"))
        return squares.groupBy("o_orderstatus").agg(F.sum("s").alias("s")).join(counts, "o_orderstatus").select(
            "o_orderstatus", F.round(F.sqrt(F.col("s") / F.col("n")), 4).alias("rms")
        )

    @r.query("udf_grouped_map", "SELECT user_id, event_id, value - avg(value) OVER (PARTITION BY user_id, CAST(ts AS DATE)) > 0 AS above FROM events")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        # A call costs as much as thousands of rows and most days of a user have few, so a call gets many whole groups. As SQL
        # does: values are added one by one, in the order in which the rows lie in the files (a mean's last digit depends on it
        # and decides where a value equals the mean), null values give null, and NaN is above all.
        def above(rows: pa.Table) -> pa.Table:
            file, user, day = (rows[c].dictionary_encode(null_encoding="encode").combine_chunks() for c in ("file", "user_id", "day"))
            rank = np.argsort(np.argsort(file.dictionary.to_numpy(zero_copy_only=False)))
            order = np.lexsort((rows["place"].to_numpy(), rank[file.indices.to_numpy()]))
            _, group = np.unique(user.indices.to_numpy().astype(np.int64) * len(day.dictionary) + day.indices.to_numpy(), return_inverse=True)
            known = pc.is_valid(rows["value"]).to_numpy()
            value = rows["value"].fill_null(np.nan).to_numpy()
            added = order[known[order]]
            n = np.bincount(group[added], minlength=rows.num_rows)
            with np.errstate(invalid="ignore", over="ignore"):
                mean = np.bincount(group[added], value[added], rows.num_rows) / np.maximum(n, 1)  # adds in the order given
                more = value - mean[group]
            found = pa.array((more > 0) | np.isnan(more), mask=~known)
            return pa.table({"user_id": rows["user_id"], "event_id": rows["event_id"], "above": found})

        events = table(spark, sf_dir, "events")
        call = F.pmod(F.xxhash64("user_id", "day"), F.lit(events.count() // CALL_ROWS + 1))
        place = F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place")
        events = events.select("user_id", "event_id", F.col("value").cast("double").alias("value"), F.to_date("ts").alias("day"), *place)
        return events.groupBy(call.alias("call")).applyInArrow(above, "user_id long, event_id long, above boolean")

    @r.query("udf_map_in_arrow", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        def big(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pc.greater(b.column(1), 100000)).select([0])

        return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").mapInArrow(big, "o_orderkey long")

    @r.query("udf_table", "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        @F.udtf(returnType="word string")
        class Words:
            def eval(self, text: str):
                for w in text.split(" "):
                    yield (w,)

        spark.udtf.register("tessera_words", Words)
        register(spark, sf_dir, "part")
        return spark.sql("SELECT p_partkey, word FROM part, LATERAL tessera_words(p_type)")

    @r.query("udf_sql", "SELECT p_partkey, p_retailprice * 1.1 AS taxed FROM part")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, "part")
        spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tessera_taxed(x DOUBLE) RETURNS DOUBLE RETURN x * 1.1D")
        return spark.sql("SELECT p_partkey, tessera_taxed(p_retailprice) AS taxed FROM part")

    @r.query(
        "udf_table_sessions",
        """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 90 MINUTE THEN 0 ELSE 1 END AS opens FROM events
            WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, k""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.udtf.register("tessera_sessions", F.udtf(Sessions))
        register(spark, sf_dir, "events")
        return spark.sql("SELECT * FROM tessera_sessions(TABLE(SELECT user_id, ts FROM events), 90)")

    @r.query(
        "udf_mergeable_aggregate",
        "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation FROM events GROUP BY 1",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = mergeable_deviation(table(spark, sf_dir, "events"), "event_type", "value")
        return found.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))
