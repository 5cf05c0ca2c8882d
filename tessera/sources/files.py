"""Sources and sinks: file formats, databases, directory listings, rename plans, partitioned and bucketed writes."""

from __future__ import annotations

import atexit
import math
import os
import re
import tempfile
import uuid
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.registry import Registry
from tessera.session import table

#: Formats that read back what they write, with the options for it.
FORMATS: dict[str, dict[str, str]] = {
    "parquet": {},
    "orc": {},
    "json": {},
    "csv": {"header": "true", "escape": '"', "multiLine": "true"},
    "xml": {"rowTag": "row"},
}


def list_files(spark: SparkSession, directory: str, recursive: bool, glob: str | None = None) -> DataFrame:
    """The files of a directory: path, name, length, modificationTime. Contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    found = reader.load(directory).select("path", "length", "modificationTime")
    return found.withColumn("name", F.element_at(F.split("path", "/"), -1))


def replace_in_names(files: DataFrame, old: str, new: str, selected: Column) -> DataFrame:
    """Adds `new_name`: the literal `old` replaced by `new` in the names of selected rows; others keep theirs."""
    return files.withColumn("new_name", F.when(selected, F.replace("name", F.lit(old), F.lit(new))).otherwise(F.col("name")))


def rename_plan(files: DataFrame) -> DataFrame:
    """Rows whose name changes, with `collides`: another row of the same directory has or gets the new name."""
    directory = F.regexp_replace("path", "/[^/]*$", "")
    rows = files.withColumn("dir", directory)
    uses = rows.groupBy("dir", F.col("new_name").alias("target")).agg(F.count(F.lit(1)).alias("uses"))
    changed = rows.filter("name <> new_name")
    return changed.join(uses, (changed.dir == uses.dir) & (changed.new_name == uses.target)).select(
        changed.path, changed.name, changed.new_name, (F.col("uses") > 1).alias("collides")
    )


def apply_renames(plan: DataFrame) -> int:
    """Renames local files by a plan without collisions; returns how many. Existing targets are never overwritten."""
    if plan.filter("collides").limit(1).count():
        raise ValueError("two files would have one name")
    done = 0
    for row in plan.toLocalIterator():
        source = row["path"].removeprefix("file:")
        target = os.path.join(os.path.dirname(source), row["new_name"])
        if os.path.exists(target):
            raise FileExistsError(target)
        os.rename(source, target)
        done += 1
    return done


def scratch(spark: SparkSession) -> str:
    """A new folder path where every executor can write, below spark.checkpoint.dir. Only a local session, whose executors
    are threads of the driver, may do without and gets a local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{os.path.join(tempfile.gettempdir(), 'tessera-scratch')}"
    path = f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"
    _folders.append((spark, path))
    return path


_folders: list[tuple[SparkSession, str]] = []
_tables: list[tuple[SparkSession, str]] = []


def remove_intermediates() -> None:
    """Drops the bucketed tables and deletes the folders that the queries wrote; runs when the driver ends."""
    try:
        while _tables:
            spark, name = _tables.pop()
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        while _folders:
            spark, path = _folders.pop()
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; what it can't reach any more stays
        return


atexit.register(remove_intermediates)


def round_trip(df: DataFrame, kind: str) -> DataFrame:
    """`df` written in a format and read back with its schema."""
    path, options = scratch(df.sparkSession), FORMATS[kind]
    df.write.format(kind).options(**options).save(path)
    return df.sparkSession.read.format(kind).options(**options).schema(df.schema).load(path)


def write_jdbc(df: DataFrame, url: str, name: str, mode: str = "append", **options: str) -> None:
    """Writes `df` to a database table, one connection per partition."""
    df.write.format("jdbc").options(url=url, dbtable=name, **options).mode(mode).save()


def read_jdbc(spark: SparkSession, url: str, name: str, column: str | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A database table. With a numeric, date or timestamp `column` it is read by `parts` connections, each of a range of the
    column between its least and greatest value, which the database finds; null values come with the first range."""
    reader = spark.read.format("jdbc").options(url=url, **options)
    if column:
        quoted = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(column)
        query = f"SELECT min({quoted}) AS low, max({quoted}) AS high FROM {name}"
        low, high = spark.read.format("jdbc").options(url=url, query=query, **options).load().first()
        if low is not None:
            if isinstance(low, float | Decimal):  # bounds of numbers are whole
                low, high = math.floor(low), math.ceil(high)
            reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.option("dbtable", name).load()


def register_queries(r: Registry) -> None:
    @r.query("src_list_files")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return list_files(spark, sf_dir, recursive=True, glob="*.parquet").select("name", "length")

    @r.query("src_replace_in_names")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = list_files(spark, sf_dir, recursive=False, glob="*.parquet")
        return replace_in_names(files, ".parquet", "_old.parquet", F.col("name").startswith("p")).select("name", "new_name")

    @r.query("src_rename_plan")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = list_files(spark, sf_dir, recursive=False, glob="*.parquet")
        return rename_plan(replace_in_names(files, "part", "nation", F.col("name") == "part.parquet")).drop("path")

    @r.query("src_metadata", "SELECT count(*) AS n FROM nation")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "nation").select("_metadata.file_name", "_metadata.file_size", "_metadata.row_index")
        return rows.filter("file_size > 0").agg(F.count_distinct("file_name", "row_index").alias("n"))

    for kind in FORMATS:

        @r.query(f"src_{kind}_round_trip", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
        def _(spark: SparkSession, sf_dir: str, kind: str = kind) -> DataFrame:
            return round_trip(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), kind)

    @r.query("src_text_round_trip", "SELECT n_name AS value FROM nation")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch(spark)
        table(spark, sf_dir, "nation").select(F.col("n_name").alias("value")).write.text(path)
        return spark.read.text(path)

    @r.query("src_partitioned_write", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'P'")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch(spark)
        table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
        return spark.read.parquet(path).filter("o_orderstatus = 'P'")  # reads one folder

    @r.query(
        "src_bucketed_join",
        "SELECT o_orderstatus, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        # both tables are dealt by the join key when written, so the join needs no shuffle
        names = {t: f"tessera_{t}_{uuid.uuid4().hex[:12]}" for t in ("orders", "lineitem")}
        keys = {"orders": ("o_orderkey", "o_orderstatus"), "lineitem": ("l_orderkey",)}
        for t, name in names.items():
            _tables.append((spark, name))
            table(spark, sf_dir, t).select(*keys[t]).write.bucketBy(8, keys[t][0]).sortBy(keys[t][0]).format("parquet").saveAsTable(name)
        orders, items = spark.table(names["orders"]), spark.table(names["lineitem"])
        return orders.join(items, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
