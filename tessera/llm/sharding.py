"""Sharding by longest-processing-time scheduling through a heap."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, fresh
from tessera.session import table

#: Items that the heap sees for each shard, at most twice this many: groups of at least 1/ITEMS of a
#: shard's bytes one by one, all smaller groups in ITEMS bundles per shard.
ITEMS = 1024
#: Rows that one task numbers within a shard, about.
SLOT_ROWS = 1_000_000


def schedule(items: list[tuple[int, tuple]], shards: int) -> dict[tuple, int]:
    """item -> shard: items (size, id), largest first (ties by id), each to the least-loaded shard (ties by number)."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for size, item in sorted(items, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        placed[item] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def shard_by_size(rows: DataFrame, size: Column, group: Column, shards: int) -> DataFrame:
    """Adds `size`, `shard` and `slot` (gapless from 0 in each shard); rows of one group stay together.

    Longest-processing-time scheduling: groups sorted by size go to the least-loaded shard through a heap.
    A group of at least total / (shards * ITEMS) bytes is an item of its own, of which there are at most
    shards * ITEMS; all smaller groups fall by a hash of their key into shards * ITEMS bundles, each an
    item with the sum of its groups. So the heap, which runs on the driver, sees at most 2 * shards * ITEMS
    items at any input size, and every group counts. Two shards differ by no more than the largest item that went to
    the fuller one after the other was as full: a bundle, which holds a thousandth of a shard or little more, unless
    a group is larger than a shard should be.

    Group sums are partial per task, so one group may hold any share of the rows. A null size counts as 0, null groups
    are one group; equal sizes are ties that go by the groups' hashes; repeated rows are rows of their own; long texts
    count by their size only. Columns of `rows` that are named size, shard or slot are replaced; all others, of any
    name and type, stay. An empty table gives an empty result.
    """
    kept = [c for c in rows.columns if c.lower() not in ("size", "shard", "slot")]
    g64, place = (fresh([*rows.columns, "size", "shard", "slot"], f"_tessera_{x}") for x in ("group", "place"))
    # A group is known by 64 bits from here on: two groups of equal bits would only stay together.
    sized = cut(
        rows.select(
            *(F.col(f"`{c}`") for c in kept),
            F.coalesce(size.cast("long"), F.lit(0)).alias("size"),
            F.xxhash64(group).alias(g64),
            F.monotonically_increasing_id().alias(place),  # written with the rows, so it stays
        )
    )
    groups = cut(sized.groupBy(F.col(g64).alias("g")).agg(F.sum("size").alias("bytes")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    least, bundles = max(1, -(-total // (shards * ITEMS))), shards * ITEMS
    of_big = [(r["bytes"], r["g"]) for r in groups.filter(F.col("bytes") >= least).collect()]
    of_small = groups.filter(F.col("bytes") < least).groupBy(F.pmod("g", F.lit(bundles)).alias("b")).agg(F.sum("bytes").alias("bytes")).collect()
    placed = schedule([*((s, (0, g)) for s, g in of_big), *((r["bytes"], (1, r["b"])) for r in of_small)], shards)
    to = rows.sparkSession.createDataFrame([(kind, key, s) for (kind, key), s in placed.items()], "kind int, key long, shard int")
    names = [fresh([*sized.columns, "shard", "slot"], f"_tessera_{x}") for x in ("big", "of_big", "small", "of_small")]
    big = to.filter("kind = 0").select(F.col("key").alias(names[0]), F.col("shard").alias(names[1]))
    small = to.filter("kind = 1").select(F.col("key").alias(names[2]), F.col("shard").alias(names[3]))
    # both have at most shards * ITEMS rows
    dealt = sized.join(F.broadcast(big), F.col(g64) == F.col(names[0]), "left").join(F.broadcast(small), F.pmod(g64, F.lit(bundles)) == F.col(names[2]), "left")
    dealt = dealt.select(*(F.col(f"`{c}`") for c in sized.columns if c != g64), F.coalesce(names[1], names[3]).alias("shard"))
    return with_slots(dealt, place)


def with_slots(dealt: DataFrame, place: str) -> DataFrame:
    """Adds `slot`, gapless from 0 within `shard`: numbered within (shard, part) and moved by the parts before.

    `place`, a column of distinct numbers that were written with the rows, deals the rows of each shard into as many
    parts as it takes for SLOT_ROWS rows each, so neither a hot group nor equal rows nor a large shard meet in one
    task. It is left out of the result.
    """
    from pyspark.sql import Window

    part, number, moved = (fresh([*dealt.columns, "slot"], f"_tessera_{x}") for x in ("part", "number", "moved"))
    most = dealt.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    parts = max(8, -(-most // SLOT_ROWS))
    parted = cut(dealt.withColumn(part, F.pmod(F.xxhash64(place), F.lit(parts))))
    counts = parted.groupBy("shard", part).count()  # at most shards * parts rows
    before = Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", part, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(moved))
    numbered = parted.withColumn(number, F.row_number().over(Window.partitionBy("shard", part).orderBy(place)))
    joined = numbered.join(F.broadcast(starts), ["shard", part])
    return joined.select(*(F.col(f"`{c}`") for c in dealt.columns if c != place), (F.col(moved) + F.col(number) - 1).alias("slot"))


#: The shards of the registered query.
SHARDS = 40


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents` in 40 shards of near-equal bytes; equal texts stay together (null counts as empty).

    Null doc_id and repeated rows are ordinary rows; an empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).alias("_len"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("_sha"))
    put = shard_by_size(rows.select("doc_id", "text_crc32", "_len", "_sha"), F.col("_len") + 16, F.col("_sha"), SHARDS)
    return put.select(
        "doc_id",
        F.col("size").cast("long").alias("size"),
        F.col("text_crc32").cast("long").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
