"""Exact deduplication by deterministic block naming, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, cut, look_up
from tessera.session import table

#: Bytes of a block. Larger blocks mean fewer rows and levels; smaller ones share more names.
BLOCK_BYTES = 2048
#: Keeps the names of hot keys apart from those of the others.
HOT_BASE = 1 << 62


def _names(keys: list[str]):
    """Distinct keys, sorted within their partition, numbered: partition number and place make the integer name."""

    def make(rows: DataFrame, hot: bool) -> DataFrame:
        distinct = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).sortWithinPartitions(*keys)
        name = F.monotonically_increasing_id()
        return distinct.select(*keys, (name + HOT_BASE if hot else name).alias("name"))

    return make


def block_identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, row_id, text_sha256, and (level, name), its collision-free identity.

    The normalised text (A-Z lower-cased, null as empty) is cut into blocks of `block_bytes` bytes. Equal
    blocks get one integer name from their sorted order; then adjacent pairs of names are named, level by
    level, until each document has one name. Names decode uniquely, so two documents have the same (level,
    name) if and only if their normalised texts are equal. Empty text is one empty block. Nulls in doc_id,
    repeated rows and extra columns are fine: rows are told apart by `row_id`, made in a single scan.
    """
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), norm.cast("binary").alias("norm")
    )
    last = F.greatest(F.lit(0), F.ceil(F.octet_length("norm") / block_bytes) - 1).cast("int")
    blocks = rows.select(
        "row_id",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), last),
                lambda i: F.struct(
                    F.substring(F.col("norm"), i * block_bytes + 1, F.lit(block_bytes)).alias("block"),
                    # what the document needs at the end travels with its first block
                    F.when(i == 0, F.struct(F.col("doc_id"), F.sha2("norm", 256).alias("text_sha256"))).alias("own"),
                ),
            )
        ).alias("place", "at"),
        (last + 1).alias("n"),
    ).select("row_id", "place", "n", "at.block", "at.own")
    named = look_up(blocks, ["block"], _names(["block"]), F.col("row_id").cast("string").cast("binary"))
    level_rows = cut(named.drop("block"))
    most = level_rows.agg(F.max("n")).first()[0] or 1
    done = [level_rows.filter("n = 1").withColumn("level", F.lit(0))]
    for level in range(1, math.ceil(math.log2(most)) + 1):
        odd = F.col("place") % 2 == 1
        pairs = (
            level_rows.filter("n > 1")
            .groupBy("row_id", F.floor(F.col("place") / 2).cast("int").alias("place"))
            .agg(
                F.max(F.when(~odd, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1)).alias("right"),  # -1: none
                F.first("own", ignorenulls=True).alias("own"),
                F.first("n").alias("n"),
            )
            .withColumn("n", F.ceil(F.col("n") / 2).cast("int"))
        )
        level_rows = cut(look_up(pairs, ["left", "right"], _names(["left", "right"]), F.col("row_id")).drop("left", "right"))
        done.append(level_rows.filter("n = 1").withColumn("level", F.lit(level)))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("own.doc_id", "row_id", "own.text_sha256", "level", "name")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256, row_id.

    Of equal texts the row with the largest doc_id stays; a null doc_id counts as the smallest; of repeated
    rows with the same doc_id exactly one stays. An empty table gives an empty result.
    """
    whole = cut(block_identities(docs, id_col, text_col, block_bytes))

    def make(rows: DataFrame, hot: bool) -> DataFrame:
        return rows.groupBy("level", "name").agg(
            F.max(F.struct(F.col("doc_id"), F.col("row_id"))).alias("keep"), F.count(F.lit(1)).alias("group_size")
        )

    # (name, level): the spread value stands in for the name of a hot group
    found = look_up(whole.select("name", "level", "doc_id", "row_id", "text_sha256"), ["name", "level"], make, F.col("row_id"))
    return found.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("keep.row_id") == F.col("row_id")).alias("kept"),
        "text_sha256",
        "row_id",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, all columns.

    Rows are found again by their id and the digest of their normalised text, never by their place in a scan,
    which may change when executors come and go. Of rows that repeat an id and a text the one whose JSON is smallest
    stays. Null text counts as empty, a null id as the smallest; texts of any length and other columns of any name and
    type are fine; an empty table gives an empty one.
    """
    found = cut(exact_duplicates(docs, id_col, text_col))
    keys = ["_tessera_id", "_tessera_sha"]
    key = lambda df: df.select(F.col("doc_id").alias(keys[0]), F.col("text_sha256").alias(keys[1]))
    marked = docs.withColumn(keys[0], F.col(id_col)).withColumn(keys[1], F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256))

    def at(other: DataFrame):
        return marked[keys[0]].eqNullSafe(other[keys[0]]) & (marked[keys[1]] == other[keys[1]])

    repeated = cut(key(found).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"))
    stays = key(found.filter("kept"))
    if not repeated.limit(1).count():
        return marked.join(stays, at(stays), "left_semi").drop(*keys)
    stays = cut(stays)
    once = stays.join(repeated, stays[keys[0]].eqNullSafe(repeated[keys[0]]) & (stays[keys[1]] == repeated[keys[1]]), "left_anti")
    again = stays.join(repeated, stays[keys[0]].eqNullSafe(repeated[keys[0]]) & (stays[keys[1]] == repeated[keys[1]]), "left_semi")
    single = marked.join(once, at(once), "left_semi").drop(*keys)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    least = marked.join(again, at(again), "left_semi").groupBy(*keys).agg(F.min_by(row, F.to_json(row)).alias("_tessera_row"))
    return single.unionByName(least.select("_tessera_row.*"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rows over all of `documents`."""
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("row_id")


SQL = """
WITH d AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
