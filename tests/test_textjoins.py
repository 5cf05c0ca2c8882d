"""Shared n-grams and word overlap on small tables, against plain Python."""

import pytest

from tessera.operators import textjoins
from tessera.operators.textjoins import Overlap, alike_documents, alike_pairs, shared_ngrams

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return [w for w in "".join(" " if c in "\t\n\r\v\f" else c for c in (text or "").translate(LOWER)).split(" ") if w]


def grams(text, n):
    w = split(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def shared_by_brute_force(docs, items, n):
    def by_id(rows):
        out = {}
        for k, t in rows:
            out.setdefault(k, set()).update(grams(t, n))
        return out

    d, b = by_id(docs), by_id(items)
    return {(k, m): (len(x & y), len(y)) for k, x in d.items() for m, y in b.items() if x & y}


DOCS = [
    (1, "The quick  brown\tfox jumps over the lazy dog"),
    (2, "say: the QUICK brown fox jumps\nover"),
    (3, "quick brown"),
    (4, None),
    (5, ""),
    (6, "Ünï cödé the quick brown fox Ünï cödé"),
    (7, "a b a b a b a b a b"),
    (7, "the quick brown fox"),
    (None, "brown fox jumps over"),
    (8, "word " * 5000 + "the quick brown fox"),
]
ITEMS = [(1, "the quick brown fox jumps over the lazy dog"), (2, "a b a b a"), (3, "ünï cödé the"), (4, "Ünï cödé THE"), (5, None), (6, "too short"), (None, "brown fox jumps")]


@pytest.mark.parametrize("most", [1 << 22, 0])
def test_shared_ngrams(spark, monkeypatch, most):
    monkeypatch.setattr(textjoins, "BROADCAST_GRAMS", most)
    docs = spark.createDataFrame([(k, t, "x") for k, t in DOCS], "doc_id long, text string, gram string")
    items = spark.createDataFrame([(k, t, 0) for k, t in ITEMS], "item_id long, text string, item_grams int")
    found = {(r["doc_id"], r["item_id"]): (r["n_shared"], r["item_grams"]) for r in shared_ngrams(docs, items, 3).collect()}
    assert found == shared_by_brute_force(DOCS, ITEMS, 3) and found
    assert shared_ngrams(docs.limit(0), items, 3).collect() == [] == shared_ngrams(docs, items.limit(0), 3).collect()


def test_no_text_is_shuffled_and_the_filter_comes_before_the_explode(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    df = shared_ngrams(docs, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    scan = plan[plan.index("HashAggregate") :]
    assert "BroadcastHashJoin" in scan and "SortMergeJoin" not in plan
    exchanges = [line for line in plan.splitlines() if " Exchange" in line and "hashpartitioning(doc_id" in line]
    assert exchanges and not [line for line in plan.splitlines() if "Exchange" in line and "text" in line]


def test_filter_holds_all_and_little_else(spark):
    from pyspark.sql import functions as F

    inside = spark.range(3000).select(F.xxhash64("id").alias("h"))
    held, size = textjoins.bloom_filter(inside, 3000)
    assert inside.filter(textjoins.might_hold(held, size, F.col("h"))).count() == 3000
    others = spark.range(10_000, 40_000).select(F.xxhash64("id").alias("h"))
    assert others.filter(textjoins.might_hold(held, size, F.col("h"))).count() < 600


def overlap_by_brute_force(rows, percent):
    """(doc_id, n_words, class_id, n_links) of each row, and the pairs of classes."""
    sets = [frozenset(split(t)) for _, t in rows]
    ids = {}
    for (d, _), s in zip(rows, sets, strict=True):
        ids[s] = d if ids.get(s) is None else ids[s] if d is None else min(ids[s], d)
    links, pairs = dict.fromkeys(ids, 0), []
    some = [s for s in ids if s]
    for i, s in enumerate(some):
        for t in some[:i]:
            if 100 * len(s & t) >= percent * len(s | t):
                links[s] += 1
                links[t] += 1
                a, b = sorted((s, t), key=lambda x: ids[x])
                pairs.append((ids[a], ids[b], len(a), len(b), len(a & b)))
    return sorted(((d, len(s), ids[s] if s else d, links[s]) for (d, _), s in zip(rows, sets, strict=True)), key=repr), sorted(pairs)


def texts(seed):
    """Sets that differ by few words, in groups that share rare words, and sets alike by none."""
    import random

    rng = random.Random(seed)
    rare = [f"r{k}" for k in range(400)]
    common = [f"c{k}" for k in range(20)]
    rows = []
    for g in range(12):
        base = rng.sample(rare, rng.randint(1, 30)) + rng.sample(common, rng.randint(0, 12))
        for _ in range(rng.randint(1, 25)):
            own = [w for w in base if rng.random() > 0.06] + rng.sample(rare, rng.randint(0, 3))
            rng.shuffle(own)
            rows.append((len(rows), " ".join(w.upper() if rng.random() < 0.1 else w for w in own)))
    passage = " ".join(f"p{k}" for k in range(6))
    rows += [(1000 + k, passage + " " + " ".join(rng.sample(rare, 3 + k % 9))) for k in range(40)]
    rows += [(2000 + k, rows[k][1]) for k in range(10)] + [rows[0], rows[0], (3000, None), (3001, ""), (3002, " \n"), (3003, "w " * 9000)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_word_overlap(spark, monkeypatch, small):
    if small:  # words of several chunks, groups by product, an order that says little, ids shuffled
        for name, value in (("CHUNK", 7), ("FEW", 3), ("COUNTERS", 4), ("AT_ONCE", 50), ("BROADCAST_ROWS", 0)):
            monkeypatch.setattr(textjoins, name, value)
    rows = texts(4)
    for percent in (80, 50):
        docs, pairs = overlap_by_brute_force(rows, percent)
        df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, h string, n int").repartition(5)
        assert sorted(map(tuple, alike_documents(df, Overlap(percent)).collect()), key=repr) == docs
        assert sorted(map(tuple, alike_pairs(df, Overlap(percent)).collect())) == pairs and len(pairs) > 300
    assert alike_documents(df.limit(0)).collect() == []


def test_null_ids_and_candidates(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (None, "q r s"), (7, "q r s t u v w x"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, alike_documents(df).collect()), key=repr) == overlap_by_brute_force(rows, 80)[0]
    # sets that share only frequent words never meet, whatever their number
    apart = spark.createDataFrame([(k, " ".join(["the", "of", "and", *(f"x{k}y{j}" for j in range(17))])) for k in range(300)], "doc_id long, text string")
    assert textjoins._likely(textjoins._classes(textjoins._word_sets(apart, Overlap(), "doc_id", "text")), Overlap()).count() == 0


def test_marks_of_all_widths_lose_no_pair():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    sets = []
    for size in (3, 60, 110, 128, 129, 240, 256, 257, 900, 1024, 1025, 4000, 4096, 4097, 6000):
        base = rng.integers(-(1 << 63), 1 << 63, size)
        sets += [base, base[: -(-size * 8 // 10)], np.append(base, rng.integers(-(1 << 63), 1 << 63, size // 5))]
        sets.append(np.append(base[: size // 2], rng.integers(-(1 << 63), 1 << 63, size // 2)))
    n, zero = np.array([len(s) for s in sets]), np.zeros(len(sets), np.int64)
    t = pa.table({"n": n, "pos": zero, "own": zero, "lo": zero, "hi": zero, "mark": pa.array([textjoins._mark(s) for s in sets], pa.binary())})
    found = textjoins._close(t, np.array([0]), Overlap())
    whole = [set(s.tolist()) for s in sets]
    alike = [any(a is not b and 100 * len(a & b) >= 80 * len(a | b) for b in whole) for a in whole]
    assert found[alike].all() and sum(alike) > 30 and (found & ~np.array(alike))[4:].sum() < 6


def test_sets_with_a_rare_word_in_common_part_where_they_meet(spark, monkeypatch):
    """Sets of like size that share a rare word and frequent ones leave no row behind; those that are alike do."""
    import random

    written = []
    kept = textjoins._kept

    def spy(df):
        written.append(kept(df))
        return written[-1]

    frequent = [f"f{k}" for k in range(20)]
    rng = random.Random(6)
    pool, large = [f"w{k}" for k in range(400)], [f"l{k}" for k in range(1400)]
    apart = [(k, " ".join([f"x{k % 50}", *frequent[: 10 + k % 7], *rng.sample(pool, 40)])) for k in range(300)]
    long = [(1000 + k, " ".join([f"z{k % 5}", *rng.sample(large, 700)])) for k in range(30)]
    alike = [(2000 + k, " ".join(["a", "b", *frequent, f"own{k}"])) for k in range(3)]
    for rows, n in ((apart + long, 0), (apart + long + alike, 3)):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        classes = textjoins._classes(textjoins._word_sets(df, Overlap(), "doc_id", "text"))
        with monkeypatch.context() as m:
            m.setattr(textjoins, "_kept", spy)
            written.clear()
            textjoins._likely(classes, Overlap())
        sizes = [w.select("cls").distinct().count() for w in written if "cls" in w.columns]
        assert sizes and set(sizes) == {n}
        assert sorted(map(tuple, alike_documents(df).collect()), key=repr) == overlap_by_brute_force(rows, 80)[0]
