"""The manifest against a tree built in plain Python, and its proofs against the roots."""

import hashlib

import pytest
from helpers import awkward, empty
from oracle import TESTDATA, compare
from pyspark.sql import functions as F

from tessera.llm import manifest
from tessera.llm.manifest import COVERED, Shape


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in COVERED))


def climb(nodes, fanout):
    """The root, and the siblings of each node from below."""
    if len(nodes) == 1:
        return nodes[0], [[]]
    runs = [nodes[k : k + fanout] for k in range(0, len(nodes), fanout)]
    root, above = climb([sha(*r) for r in runs], fanout)
    return root, [[(r[:i], r[i + 1 :]), *above[k]] for k, r in enumerate(runs) for i in range(len(r))]


def by_brute_force(leaves, fanout):
    """Rows of manifest() for (source, doc_id, leaf, claim) tuples."""
    least = lambda x: (x is not None, x)
    sources = sorted({x[0] for x in leaves}, key=lambda s: (s is not None, (s or "").encode()))
    groups = [sorted((x for x in leaves if x[0] == s), key=lambda x: tuple(least(y) for y in x[1:])) for s in sources]
    trees = [climb([x[2] for x in g], fanout) for g in groups]
    root, tops = climb([r for r, _ in trees], fanout) if trees else (None, [])
    out = []
    for g, (subroot, paths), top in zip(groups, trees, tops, strict=True):
        for (_, doc, leaf, claim), path in zip(g, paths, strict=True):
            node = claim or leaf
            for a, b in path + top:
                node = sha(*a, node, *b)
            out.append((doc, leaf, subroot, root, sha(*(x for a, b in path + top for x in a + b)), node, node == root))
    return sorted(out, key=repr)


def test_equals_sql(spark):
    assert compare(spark, manifest.op12_manifest, manifest.SQL, f"{TESTDATA}/sf0.001") == 200


@pytest.mark.parametrize("shape", [Shape(), Shape(2, 1), Shape(2, 2), Shape(3, 1), Shape(4, 2)])
def test_shapes(spark, shape):
    leaves = [(None if k % 9 == 0 else "hot" if k % 3 else f"s{k % 7}é", None if k % 11 == 0 else k, sha(str(k)), sha("x") if k % 5 == 0 else None) for k in range(90)]
    leaves += [("lone", 5, sha("lone"), None)] + [("same", 1, sha("same"), None)] * 20
    found = manifest.manifest(spark.createDataFrame(leaves, "source string, doc_id long, leaf string, claim string").repartition(6), shape, paths=True).collect()
    assert sorted((tuple(r)[:7] for r in found), key=repr) == by_brute_force(leaves, shape.fanout)
    for r in found:
        assert manifest.fold(r["leaf"], r["lefts"], r["rights"]) == r["root"]
        assert sha(*(a + b for a, b in zip(r["lefts"], r["rights"], strict=True))) == r["proof_sha256"]
        assert r["verified"] == (r["folded_root"] == r["root"])


def test_awkward_and_empty_documents(spark, tmp_path):
    awkward(spark).write.parquet(f"{tmp_path}/a/documents.parquet")
    rows = spark.read.parquet(f"{tmp_path}/a/documents.parquet").collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import zlib

    leaves = []
    for r in (r.asDict() for r in rows):
        changed = r | {"text": r["text"] and r["text"].translate(lower)}
        tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        leaves.append((r["source"], r["doc_id"], leaf_of(r), leaf_of(changed) if tampered else None))
    found = manifest.op12_manifest(spark, f"{tmp_path}/a")
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, found.collect()), key=repr) == by_brute_force(leaves, 16)
    empty(spark).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert manifest.op12_manifest(spark, f"{tmp_path}/b").collect() == []


def test_tampering_shows(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet")
    found = manifest.op12_manifest(spark, f"{TESTDATA}/sf0.001")
    touched = docs.filter((F.crc32(F.col("doc_id").cast("string")) % 5 == 0) & F.col("text").rlike("[A-Z]")).select("doc_id")
    assert {r[0] for r in found.filter("NOT verified").collect()} == {r[0] for r in touched.collect()} != set()
