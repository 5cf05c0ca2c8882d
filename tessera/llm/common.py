"""Helpers that the operators share: lineage cuts in the shared folder, skew-proof lookups, ASCII case."""

from __future__ import annotations

import atexit
import re
import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without; it gets a
    folder of its own, as its executors are threads of the driver."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes `df` as Parquet below the shared folder and reads it back: no lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_intermediates() -> None:
    """Deletes the tables that `cut` wrote. Results that still read them must be written before; runs when the driver ends."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; what it can't reach any more stays
            return


atexit.register(remove_intermediates)


def fresh(columns: list[str], name: str) -> str:
    """`name`, or if columns have it already, that with more underscores in front; case counts for nothing."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII text takes the byte-wise path, other text is translated."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


#: A key with more than this share of the rows is looked up by broadcast instead of by shuffle; so
#: there are fewer such keys than its inverse, whatever the size of the input.
HOT_SHARE = 1 / 512


def hot_digests(df: DataFrame, keys: list[str]) -> list[int]:
    """64-bit digests of the keys that may hold more than HOT_SHARE of the rows (fewer than 1/HOT_SHARE).

    One pass, one small state per task; it only steers how keys are dealt out, never which rows count.
    """
    top = F.call_function("approx_top_k", F.xxhash64(*keys), F.lit(int(1 / HOT_SHARE)), F.lit(16384))
    got = df.agg(F.count(F.lit(1)).alias("n"), top.alias("top")).first()
    return sorted(x["item"] for x in got["top"] or [] if x["count"] > max(64, got["n"] * HOT_SHARE))


def look_up(rows: DataFrame, keys: list[str], make, spread: Column) -> DataFrame:
    """Joins `make(rows)`, one row per distinct key, back to `rows`, however unevenly the keys are spread.

    Hot keys are aggregated apart (partial sums, one row per key and task) and broadcast: there are
    fewer than 1/HOT_SHARE of them. For them the shuffled key is replaced by `spread`, which must differ
    from row to row, so no task receives a hot key's rows. `make(df, hot)` returns keys plus new columns.
    """
    hot = hot_digests(rows, keys)
    if not hot:
        return rows.join(make(rows, False), keys, "left")
    is_hot = F.xxhash64(*keys).isin(hot)
    of_hot, of_cold = cut(make(rows.filter(is_hot), True)), make(rows.filter(~is_hot), False)
    new = [c for c in of_hot.columns if c not in keys]
    first = of_hot.select(*keys, *(F.col(c).alias(f"_hot_{c}") for c in new), F.lit(True).alias("_hot"))
    both = rows.join(F.broadcast(first), keys, "left")
    held = [
        F.when(F.col("_hot"), spread.cast(rows.schema[k].dataType) if i == 0 else F.lit(None)).otherwise(F.col(k)).alias(f"_key_{k}")
        for i, k in enumerate(keys)
    ]
    second = of_cold.select(*(F.col(k).alias(f"_key_{k}") for k in keys), *(F.col(c).alias(f"_cold_{c}") for c in new))
    joined = both.select("*", *held).join(second, [f"_key_{k}" for k in keys], "left")
    # A spread value may happen to equal a cold key; the hot value wins then, and cold keys are distinct, so no row doubles.
    return joined.select(
        *rows.columns, *(F.when(F.col("_hot"), F.col(f"_hot_{c}")).otherwise(F.col(f"_cold_{c}")).alias(c) for c in new)
    )


def slices(column, limit: int = 1 << 22):
    """Pairs (start, stop) that cut an Arrow string column into runs of at most `limit` bytes, or one row."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(sizes):
        stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), limit, side="right")))
        yield start, stop
        start = stop


#: Bytes of the batches that go to Python and back, unless the session asks for smaller ones.
BATCH_BYTES = 8 << 20
_held: dict = {"owner": None, "values": {}}


def held(owner: str) -> dict:
    """What a worker process keeps for `owner` between tasks. Another owner's things are dropped, as all share its memory."""
    if _held["owner"] != owner:
        _held.update(owner=owner, values={})
    return _held["values"]


def _bounded(spark: SparkSession) -> None:
    """Lowers the session's bound on Arrow batches, if it is larger; it is read when the plan runs, so it stays lowered."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def _release() -> None:
    """Gives freed memory back to the system, which a reused worker would keep."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow with batches of bounded bytes, in workers that give their memory back after each task."""
    _bounded(df.sparkSession)

    def guarded(batches):
        try:
            yield from run(batches)
        finally:
            _release()

    return df.mapInArrow(guarded, schema)


def map_groups(df: DataFrame, keys: list[str], run, schema) -> DataFrame:
    """df.groupBy(keys).applyInArrow with batches of bounded bytes; `run` takes the key and the group's table."""
    _bounded(df.sparkSession)
    return df.groupBy(*keys).applyInArrow(lambda key, t: run(key, t), schema)


def map_cogroups(df: DataFrame, keys: list[str], other: DataFrame, other_keys: list[str], run, schema) -> DataFrame:
    """df.groupBy(keys).cogroup(other.groupBy(other_keys)).applyInArrow with batches of bounded bytes."""
    _bounded(df.sparkSession)
    return df.groupBy(*keys).cogroup(other.groupBy(*other_keys)).applyInArrow(lambda key, a, b: run(key, a, b), schema)


def map_pandas(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInPandas with batches of bounded bytes, in workers that give their memory back after each task."""
    _bounded(df.sparkSession)

    def guarded(frames):
        try:
            yield from run(frames)
        finally:
            _release()

    return df.mapInPandas(guarded, schema)
