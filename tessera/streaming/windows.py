"""Structured Streaming: windows, sessions, watermarks, deduplication, joins and custom state, with batch forms."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.plans.registry import Registry
from tessera.session import table
from tessera.sources.files import scratch


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """`events` as a stream; `ts` becomes a zoned timestamp, as a watermark needs."""
    schema = table(spark, sf_dir, "events").schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # as a pattern the path may name a file or, as Spark writes tables, a folder
    return reader.parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def run_in_steps(steps: Iterable[DataFrame], build: Callable[[DataFrame], DataFrame], broken: Callable[[int], None] | None = None, tries: int = 1) -> DataFrame:
    """Plays the tables of `steps` into a folder one after the other and returns all rows that `build`'s stream appends.

    The stream of that folder is stopped after each step and goes on from its checkpoint at the next, so its watermark
    and state outlive it. Each batch writes a folder of its own and replaces what an attempt before left there; so a
    batch that fails after it has written (`broken` is called then, with its number) is counted once when run again. A
    failed stream is started again until it has been tried `tries` times.
    """
    source, sink, out = None, None, None
    for step in steps:
        spark = step.sparkSession
        if source is None:
            source, sink = scratch(spark), scratch(spark)
        step.write.mode("append").parquet(source)
        out = build(spark.readStream.schema(step.schema).parquet(source))

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")
            if broken:
                broken(number)

        for left in range(tries - 1, -1, -1):
            try:
                out.writeStream.option("checkpointLocation", f"{sink}-state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
                break
            except StreamingQueryException:
                if not left:
                    raise
    if out is None:
        raise ValueError("no steps")
    return spark.read.schema(out.schema).parquet(sink).drop("batch")


def arrivals(events: DataFrame, delay: Column, steps: int) -> list[DataFrame]:
    """`events` in `steps` parts, equal spans of the time at which they arrive, `delay` microseconds after `ts`."""
    at = F.unix_micros("ts") + delay
    first, last = events.agg(F.min(at), F.max(at)).first()
    if first is None:
        return [events]
    span = last - first + 1
    since = (at - first) * steps
    return [events.filter((since >= k * span) & (since < (k + 1) * span)) for k in range(steps)]


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now into Parquet and returns its rows.

    Results are written by foreachBatch to a folder of their own per batch, so a batch that is run again replaces its
    own rows; nothing is held on the driver. In complete mode each batch has all rows, and only the last one's are
    read.
    """
    spark, path = stream.sparkSession, scratch(stream.sparkSession)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
    last = -1

    def keep(batch: DataFrame, number: int) -> None:
        nonlocal last
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        last = max(last, number)

    writer.foreachBatch(keep).start().awaitTermination()
    if last < 0:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{path}/batch={last}")
    return spark.read.schema(stream.schema).parquet(path).drop("batch")


def running_counts(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Count and sum of a key's values so far, kept in state."""
    n, total = state.get if state.exists else (0, 0.0)
    for pdf in pdfs:
        n, total = n + len(pdf), total + float(pdf.value.sum())
    state.update((n, total))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})


def register_queries(r: Registry) -> None:
    tumbling = "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"
    utc = lambda c: F.col(c).cast("timestamp_ntz")

    @r.query("batch_tumbling", tumbling)
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        by = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
        return by.select(utc("w.start").alias("start"), "event_type", "n")

    @r.query("stream_tumbling", tumbling)
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        by = event_stream(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
        return run_to_end(by, "complete").select(utc("w.start").alias("start"), "event_type", "n")

    # an append stream returns the windows that end before the watermark, an hour before the last event
    @r.query(
        "stream_tumbling_append",
        """WITH m AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR AS mark FROM events)
        SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, count(*) AS n FROM events
        WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT mark FROM m) GROUP BY 1""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        by = event_stream(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
        return run_to_end(by).select(utc("w.start").alias("start"), "n")

    sliding = """WITH b AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS b FROM events), s AS (SELECT unnest([b, b - INTERVAL 30 MINUTE]) AS start FROM b)
        SELECT CAST(start AS TIMESTAMP) AS start, count(*) AS n FROM s GROUP BY 1"""

    @r.query("batch_sliding", sliding)
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        by = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
        return by.select(utc("w.start").alias("start"), "n")

    @r.query("stream_sliding", sliding)
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        by = event_stream(spark, sf_dir).groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
        return run_to_end(by, "complete").select(utc("w.start").alias("start"), "n")

    # a session takes an event in as long as the gap is at most half an hour
    sessions = """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh
        FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
        SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""

    @r.query("batch_session", sessions)
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        by = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
        return by.select("user_id", utc("w.start").alias("start"), "n")

    @r.query(
        "stream_session",
        sessions + " HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        by = event_stream(spark, sf_dir).withWatermark("ts", "1 hour").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
        return run_to_end(by).select("user_id", utc("w.start").alias("start"), "n")

    @r.query("stream_dedup_watermark", "SELECT event_id, min(user_id) AS user_id FROM events GROUP BY event_id")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        once = event_stream(spark, sf_dir).withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"])
        return run_to_end(once.select("event_id", "user_id"))

    @r.query(
        "stream_interval_join",
        """SELECT a.event_id AS click, b.event_id AS purchase FROM events a JOIN events b ON a.user_id = b.user_id
        AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = event_stream(spark, sf_dir).select("event_id", "user_id", "ts", "event_type")
        a = events.filter("event_type = 'click'").select(F.col("event_id").alias("click"), "user_id", F.col("ts").alias("t")).withWatermark("t", "1 hour")
        b = events.filter("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), F.col("user_id").alias("u"), "ts").withWatermark("ts", "1 hour")
        on = (F.col("user_id") == F.col("u")) & (F.col("ts") >= F.col("t")) & (F.col("ts") <= F.col("t") + F.expr("INTERVAL 6 HOURS"))
        return run_to_end(a.join(b, on).select("click", "purchase"))

    counts = "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1"

    @r.query("stream_state_pandas", counts)
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        by = event_stream(spark, sf_dir).groupBy("user_id").applyInPandasWithState(
            running_counts, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout
        )
        seen = run_to_end(by, "update").groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total"))
        return seen.select("user_id", "n", F.round("total", 4).alias("total"))

    @r.query("stream_state_processor", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tessera.streaming.processor import counting

        return run_to_end(counting(event_stream(spark, sf_dir)), "update").groupBy("user_id").agg(F.max("n").alias("n"))

    # every tenth event comes five hours late; a row is dropped if its window has ended an hour before the last event of
    # the parts before its own
    @r.query(
        "stream_replayed_late",
        """WITH a AS (SELECT *, epoch_us(ts) + CASE WHEN event_id % 10 = 0 THEN 18000000000 ELSE 0 END AS arrives FROM events),
        b AS (SELECT *, ((arrives - min(arrives) OVER ()) * 6) // (max(arrives) OVER () - min(arrives) OVER () + 1) AS part FROM a),
        m AS (SELECT part, max(ts) AS last FROM b GROUP BY part),
        w AS (SELECT p.part, date_trunc('milliseconds', max(m.last)) - INTERVAL 1 HOUR AS mark FROM range(1, 7) p(part), m WHERE m.part < p.part GROUP BY p.part)
        SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM b LEFT JOIN w USING (part)
        WHERE (mark IS NULL OR date_trunc('hour', ts) + INTERVAL 1 HOUR > mark)
        AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT mark FROM w WHERE part = 6) GROUP BY 1, 2""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        def hourly(stream: DataFrame) -> DataFrame:
            marked = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
            return marked.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))

        events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
        late = F.when(F.col("event_id") % 10 == 0, 5 * 3_600_000_000).otherwise(0)
        parts = [p.select("event_id", "event_type", "ts") for p in arrivals(events, late, 6)]
        return run_in_steps(parts, hourly).select(utc("w.start").alias("start"), "event_type", "n")

    # each click and the first purchase of its user within six hours, or none; known once the watermark has passed either
    @r.query(
        "stream_state_funnel",
        """WITH m AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR AS mark FROM events WHERE event_type IN ('click', 'purchase')),
        j AS (SELECT c.event_id AS click, c.ts, min(p.ts) AS bought, arg_min(p.event_id, (p.ts, p.event_id)) AS purchase
        FROM events c LEFT JOIN events p ON p.user_id = c.user_id AND p.event_type = 'purchase' AND p.ts <= c.ts + INTERVAL 6 HOUR
        AND (p.ts > c.ts OR p.ts = c.ts AND p.event_id > c.event_id) WHERE c.event_type = 'click' GROUP BY 1, 2)
        SELECT click, purchase FROM j, m WHERE coalesce(bought, j.ts + INTERVAL 6 HOUR) < mark""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tessera.streaming.processor import funnel

        events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "user_id", "event_type", "ts")
        return run_in_steps(arrivals(events, F.lit(0), 3), lambda stream: funnel(stream.withWatermark("ts", "1 hour")))

    @r.query("stream_update_mode", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        by = event_stream(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
        return run_to_end(by, "update").groupBy("event_type").agg(F.max("n").alias("n"))
