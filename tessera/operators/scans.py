"""Window functions over a whole table, by a prefix scan over parts in place of one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.relational import unused
from tessera.operators.selection import kept
from tessera.plans.registry import Registry
from tessera.session import table

#: Rows at the ends of the parts up to which they are broadcast.
EDGES = 100_000

#: How the value up to the part before and the value within the part make the running value.
JOINED = {
    "sum": lambda before, own: F.coalesce(before + own, before, own),
    "count": lambda before, own: F.coalesce(before, F.lit(0)) + own,
    "min": F.least,
    "max": F.greatest,
    "last": lambda before, own: F.coalesce(own, before),
    "first": lambda before, own: F.coalesce(before, own),
}
WITHIN = {
    "sum": F.sum,
    "count": F.count,
    "min": F.min,
    "max": F.max,
    "last": lambda c: F.last(c, ignorenulls=True),
    "first": lambda c: F.first(c, ignorenulls=True),
}


def over_all(df: DataFrame, order: list[Column], columns: dict[str, tuple]) -> DataFrame:
    """`df` with window columns over the order of the whole table, as ROWS frames from its start to the row.

    `columns` names each: ``("number",)`` is the row's number from 1; ``("sum", column)``, and likewise `count`, `min`,
    `max`, and `first` and `last` of the values that aren't null, run up to the row; ``("lag", column, n)`` is the value
    n rows before, or after for a negative n, null beyond the table.

    Spark sorts such a window in one task. Here rows are dealt to parts by ranges of the order, each part is computed
    by itself and written, one row a part is carried over to the parts after it, and the rows at parts' ends are looked
    up for lags. Rows equal in `order` follow the hash of their columns, which also deals a hot value to several parts;
    only rows alike in all columns always stay in one part. Sums of doubles depend on the parts in their last digits.
    New columns replace columns of the same name.
    """
    part, place, size, tie, number, before, value, at = (
        unused([*df.columns, *columns], n) for n in ("_part", "_place", "_size", "_tie", "_number", "_before", "_value", "_at")
    )
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in (s := f.dataType.simpleString()) and "variant" not in s]
    running = {n: c for n, c in columns.items() if c[0] in WITHIN}
    lags = {n: c for n, c in columns.items() if c[0] == "lag"}
    if unknown := [c[0] for c in columns.values() if c[0] not in WITHIN and c[0] not in ("lag", "number")]:
        raise ValueError(f"unknown window columns: {unknown}")
    own, near = ({n: unused([*df.columns, *columns], f"_{kind}_{k}") for k, n in enumerate(columns)} for kind in ("own", "near"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn(tie, F.xxhash64(*hashed) if hashed else F.lit(0))
    rows = rows.repartitionByRange(parts, *order, F.col(tie)).withColumn(part, F.spark_partition_id())
    w = Window.partitionBy(part).orderBy(*order, tie)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(
        "*",
        F.row_number().over(w).cast("long").alias(place),
        F.count(F.lit(1)).over(Window.partitionBy(part)).alias(size),
        *(WITHIN[c[0]](c[1]).over(upto).alias(own[n]) for n, c in running.items()),
        *(c[1].alias(own[n]) for n, c in lags.items()),
        *(F.lag(c[1], c[2]).over(w).alias(near[n]) for n, c in lags.items()),
    )
    rows = kept(rows.drop(tie))

    # one row a part, so one task over all of them stays small
    ends = rows.filter(F.col(place) == F.col(size)).select(part, size, *(own[n] for n in running))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = {n: unused([*rows.columns, *columns], f"_carried_{k}") for k, n in enumerate(running)}
    carry = ends.select(
        F.col(part),
        F.coalesce(F.sum(size).over(earlier), F.lit(0)).alias(before),
        *(WITHIN["sum" if c[0] == "count" else c[0]](F.col(own[n])).over(earlier).alias(carried[n]) for n, c in running.items()),
    )
    rows = rows.join(F.broadcast(kept(carry)), part).withColumn(number, F.col(before) + F.col(place))
    out = {n: JOINED[c[0]](F.col(carried[n]), F.col(own[n])) for n, c in running.items()}
    out |= {n: F.col(number) for n, c in columns.items() if c[0] == "number"}

    for n, c in lags.items():
        at_end = F.col(place) > F.col(size) - c[2] if c[2] > 0 else F.col(place) <= -c[2]
        edge = rows.filter(at_end).select(F.col(number).alias(at), F.col(own[n]).alias(value))
        edge = F.broadcast(edge) if abs(c[2]) * parts <= EDGES else edge
        beyond = (F.col(place) - c[2] < 1) | (F.col(place) - c[2] > F.col(size))
        wanted = F.when(beyond, F.col(number) - c[2])
        rows = rows.join(edge, wanted == F.col(at), "left").withColumn(near[n], F.when(beyond, F.col(value)).otherwise(F.col(near[n]))).drop(at, value)
        out[n] = F.col(near[n])
    return rows.select(*(F.col(f"`{c}`") for c in df.columns if c not in columns), *(out[n].alias(n) for n in columns))


def register_queries(r: Registry) -> None:
    @r.query(
        "win_whole_table",
        """SELECT doc_id, row_number() OVER w AS place, sum(n_chars) OVER w AS chars, max(n_chars) OVER w AS longest,
        last_value(CASE WHEN n_chars > 5000 THEN doc_id END IGNORE NULLS) OVER w AS last_long,
        lag(doc_id, 1) OVER (ORDER BY lang NULLS FIRST, doc_id) AS before, lead(doc_id, 3) OVER (ORDER BY lang NULLS FIRST, doc_id) AS third_after
        FROM documents WINDOW w AS (ORDER BY lang NULLS FIRST, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
        columns = {
            "place": ("number",),
            "chars": ("sum", F.col("n_chars")),
            "longest": ("max", F.col("n_chars")),
            "last_long": ("last", F.when(F.col("n_chars") > 5000, F.col("doc_id"))),
            "before": ("lag", F.col("doc_id"), 1),
            "third_after": ("lag", F.col("doc_id"), -3),
        }
        return over_all(documents, [F.col("lang"), F.col("doc_id")], columns).drop("lang", "n_chars")
