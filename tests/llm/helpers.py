"""Fixtures that the tests of these operators share."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as extra columns of the input.
CLASHES = "row_id name level kept shard slot size part bin key n fp sig label node hub band place own score lang_pred spans near".split()
CLASHES += "_bytes _group _part _at _before _g64 _bundle _big _small _n _hot _len _sha _tessera_lang".split()

A = "the quick brown fox jumps over the lazy dog while seven wizards mix a potion of red moss and old rain " * 3
AWKWARD = [
    (1, A, "en", "s", 1),
    (2, A.upper(), "en", None, 1),
    (3, A.replace("seven", "eight", 1), None, "s", None),
    (4, None, None, None, None),
    (5, "", "en", "s", 0),
    (6, "   \n\t ", "en", "s", 0),
    (7, "12 + 34 %%% ...", "en", "s", 0),
    (8, "hi", "en", "s", 2),
    (8, "hi", "en", "s", 2),
    (9, "word " * 40000 + "end", "en", "s", None),
    (10, "x" * 150000, "en", "s", None),
    (11, "Ünïcödé ÀÉ ß 日本語 🙂 café", "fr", "s", None),
    (12, "ünïcödé ÀÉ ß 日本語 🙂 café", "fr", "s", None),
    (None, A, "en", "s", 1),
    (None, None, None, None, None),
    (13, "write to bob.k@mail.example.org or +1 (988) 555-2485, ip 10.2.3.4, card 4041894974608795.", "en", "s", None),
]


def awkward(spark):
    """Nulls in all columns, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    df = spark.createDataFrame(AWKWARD, SCHEMA)
    for k, name in enumerate(CLASHES):
        df = df.selectExpr("*", f"CAST({k} AS STRING) AS {name}")
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def big(spark, tmp_path, df):
    """`df` as a parquet table, as the operators get it."""
    df.write.parquet(f"{tmp_path}/docs.parquet")
    return spark.read.parquet(f"{tmp_path}/docs.parquet")
