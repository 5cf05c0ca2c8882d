"""Scalar functions: strings, patterns, dates, numbers, JSON, arrays, maps, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.selection import kept
from tessera.plans.registry import Registry
from tessera.session import table

#: Ids that several rows share up to which they are broadcast.
BROADCAST_IDS = 1_000_000


def cosine(a: str, b: str):
    """Cosine similarity of two array columns, in doubles, inside code generation."""
    x, y = F.col(a).cast("array<double>"), F.col(b).cast("array<double>")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda s, t: s + t)
    return dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))


def daily_counts(events: DataFrame, condition: str, ts_col: str = "ts") -> DataFrame:
    """day, n for every day from the first to the last event: how many events meet the condition, 0 where none does."""
    events = events.withColumn("day", F.to_date(ts_col))
    days = events.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("day"))
    seen = events.filter(condition).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return days.join(seen, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def _runs(words: Column) -> Column:
    """(word, n) of an array's different words, by the runs of equal words in their order."""

    def of(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(w)), lambda k: (k == 1) | (F.get(w, k - 1) != F.get(w, k - 2)))
        ends = lambda at, k: F.coalesce(F.get(at, k + 1), F.size(w) + 1)
        counted = lambda at: F.transform(at, lambda start, k: F.struct(F.get(w, start - 1).alias("word"), (ends(at, k) - start).cast("long").alias("n")))
        return F.element_at(F.transform(F.array(starts), counted), 1)

    # as the variable of a lambda the sorted array is computed once a row
    return F.when(F.size(words) > 0, F.element_at(F.transform(F.array(F.sort_array(words)), of), 1))


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, word, n: how often each word between spaces stands in the texts of a doc_id.

    Words are counted within their row, so neither texts nor words are shuffled, only ids; the counts of rows that
    share their id (a null id too) are then added up by id and word. Null texts have no words.
    """
    repeated = kept(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(F.col("doc_id").alias("again")))
    many = repeated.count()
    counts = lambda rows: rows.select("doc_id", F.inline(_runs(F.filter(F.split("text", " "), lambda x: x != ""))))
    docs = docs.select("doc_id", "text")
    if not many:
        return counts(docs)
    side = F.broadcast(repeated) if many <= BROADCAST_IDS else repeated
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    added = counts(docs.join(side, same, "left_semi")).groupBy("doc_id", "word").agg(F.sum("n").alias("n"))
    return counts(docs.join(side, same, "left_anti")).unionByName(added)


def register_queries(r: Registry) -> None:
    r.sql(
        "fn_string",
        "part",
        """SELECT p_partkey, upper(p_name) AS u, substr(p_name, 2, 3) AS s, trim(p_type) AS t, replace(p_name, 'a', '_') AS r,
        lpad(p_brand, 12, '*') AS l, reverse(p_name) AS rev, CAST(locate('e', p_name) AS INT) AS at, CAST(length(p_name) AS INT) AS n FROM part""",
        """SELECT p_partkey, upper(p_name) AS u, substr(p_name, 2, 3) AS s, trim(p_type) AS t, replace(p_name, 'a', '_') AS r,
        lpad(p_brand, 12, '*') AS l, reverse(p_name) AS rev, CAST(instr(p_name, 'e') AS INT) AS at, CAST(length(p_name) AS INT) AS n FROM part""",
    )
    r.sql(
        "fn_regex",
        "part",
        """SELECT p_partkey, regexp_extract(p_brand, '([0-9])', 1) AS d, regexp_replace(p_name, '[aeiou]', '.') AS v,
        CAST(size(regexp_extract_all(p_name, '[a-z]+', 0)) AS INT) AS words FROM part""",
        """SELECT p_partkey, regexp_extract(p_brand, '([0-9])', 1) AS d, regexp_replace(p_name, '[aeiou]', '.', 'g') AS v,
        CAST(len(regexp_extract_all(p_name, '[a-z]+')) AS INT) AS words FROM part""",
    )

    @r.query(
        "fn_split_explode",
        """WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents)
        SELECT doc_id, word, count(*) AS n FROM w WHERE word <> '' GROUP BY 1, 2""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return word_counts(table(spark, sf_dir, "documents"))

    @r.query(
        "fn_posexplode",
        """SELECT p_partkey, CAST(generate_subscripts(string_split(p_type, ' '), 1) - 1 AS INT) AS pos, unnest(string_split(p_type, ' ')) AS word FROM part""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_type", " ")).alias("pos", "word"))

    r.sql(
        "fn_dates",
        "orders",
        """SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q, CAST(month(o_orderdate) AS INT) AS m,
        CAST(dayofyear(o_orderdate) AS INT) AS doy, CAST(weekofyear(o_orderdate) AS INT) AS w,
        CAST(date_trunc('month', o_orderdate) AS DATE) AS mon, last_day(CAST(o_orderdate AS DATE)) AS last,
        CAST(o_orderdate + INTERVAL '7' DAY AS DATE) AS later FROM orders""",
    )
    r.sql(
        "fn_datediff",
        "orders lineitem",
        "SELECT o_orderkey, CAST(datediff(max(l_shipdate), min(o_orderdate)) AS INT) AS days FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey",
        """SELECT o_orderkey, CAST(date_diff('day', min(o_orderdate), max(l_shipdate)) AS INT) AS days
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
    )

    @r.query(
        "fn_gap_fill",
        """WITH d AS (SELECT unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS day FROM events),
        u AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY 1)
        SELECT CAST(d.day AS DATE) AS day, coalesce(n, 0) AS n FROM d LEFT JOIN u ON CAST(d.day AS DATE) = u.day""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return daily_counts(table(spark, sf_dir, "events"), "event_type = 'signup'")

    r.sql(
        "fn_math",
        "lineitem",
        """SELECT l_orderkey, l_linenumber, round(ln(l_extendedprice), 6) AS ln, CAST(floor(l_quantity / 3) AS BIGINT) AS f,
        CAST(ceil(l_quantity / 3) AS BIGINT) AS c, abs(l_discount - 0.05) AS a, round(sqrt(l_quantity), 6) AS s, l_orderkey % 7 AS m FROM lineitem""",
    )
    r.sql(
        "fn_json",
        "events",
        "SELECT event_id, get_json_object(props, '$.k') AS k FROM events",
        "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    )
    r.sql(
        "fn_json_parsed",
        "events",
        """SELECT event_id, from_json(props, 'k STRING').k AS k, variant_get(parse_json(props), '$.k', 'string') AS v FROM events""",
        "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k') AS v FROM events",
    )

    @r.query(
        "fn_array_higher_order",
        """SELECT vec_id, round(list_sum(list_transform(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x > 0), lambda x: x * x)), 5) AS energy,
        CAST(len(list_filter(embedding, lambda x: x > 0)) AS INT) AS n FROM embeddings""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        up = F.filter(F.col("embedding").cast("array<double>"), lambda x: x > 0)
        return table(spark, sf_dir, "embeddings").select(
            "vec_id", F.round(F.aggregate(up, F.lit(0.0), lambda s, x: s + x * x), 5).alias("energy"), F.size(up).alias("n")
        )

    @r.query(
        "fn_vector_cosine",
        """SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))
        / sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))
        * list_inner_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 5) AS sim
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        vectors = table(spark, sf_dir, "embeddings")
        a = vectors.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
        b = vectors.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"), (F.col("vec_id") - 1).alias("a"))
        return a.join(b, "a").select("a", "b", F.round(cosine("x", "y"), 5).alias("sim"))

    @r.query(
        "fn_array_sets",
        """WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(lower(p_type), ' ') AS b FROM part)
        SELECT p_partkey, array_to_string(list_sort(list_distinct(a)), ' ') AS d, array_to_string(list_sort(list_intersect(a, b)), ' ') AS i,
        array_to_string(list_sort(list_distinct(list_concat(a, b))), ' ') AS u FROM w""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("a"), F.split(F.lower("p_type"), " ").alias("b"))
        text = lambda c: F.array_join(F.array_sort(c), " ")
        return w.select("p_partkey", text(F.array_distinct("a")).alias("d"), text(F.array_intersect("a", "b")).alias("i"), text(F.array_union("a", "b")).alias("u"))

    @r.query(
        "fn_maps",
        """SELECT p_partkey, CAST(p_size AS VARCHAR) || '|' || p_brand AS vals, 'brand,size' AS keys,
        CASE WHEN p_size > 25 THEN 'size' ELSE '' END AS big FROM part""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"))
        big = F.map_filter(m, lambda k, v: (k == "size") & (F.try_to_number(v, F.lit("999")) > 25))
        return table(spark, sf_dir, "part").select(
            "p_partkey", F.array_join(F.map_values(m), "|").alias("vals"), F.array_join(F.sort_array(F.map_keys(m)), ",").alias("keys"),
            F.array_join(F.map_keys(big), ",").alias("big"),
        )

    r.sql("fn_hash", "part", "SELECT p_partkey, md5(p_name) AS m, sha2(p_name, 256) AS s FROM part", "SELECT p_partkey, md5(p_name) AS m, sha256(p_name) AS s FROM part")
    r.sql("fn_levenshtein", "nation", "SELECT a.n_name AS a, b.n_name AS b, CAST(levenshtein(a.n_name, b.n_name) AS INT) AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
