"""Merkle manifest of a table: levels of a digest tree in contiguous matrices, one aligned block of leaves a task."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, cut, map_cogroups, map_groups
from tessera.session import table

#: Bytes of a digest as text.
WIDTH = 64


@dataclass(frozen=True)
class Shape:
    """Nodes under one parent, and levels that a block of leaves climbs in one task (fanout ** levels leaves a block)."""

    fanout: int = 16
    levels: int = 3

    @property
    def block(self) -> int:
        return self.fanout**self.levels

    def height(self, n: int) -> int:
        """Levels above n nodes, at most those of a block."""
        h = 0
        while n > 1 and h < self.levels:
            n, h = -(-n // self.fanout), h + 1
        return h


def digest_of(columns: list[Column]) -> Column:
    """sha256 of the values, each `-` if null, else its UTF-8 byte count, a colon and the value as text."""
    texts = (c.cast("string") for c in columns)
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def _climb(level: np.ndarray, fanout: int) -> np.ndarray:
    """The parents of a level, both as (nodes, 64) bytes: rows of `fanout` nodes are hashed as they lie."""
    whole = len(level) // fanout * fanout
    rows = [*level[:whole].reshape(-1, fanout * WIDTH), *([level[whole:].reshape(-1)] if whole < len(level) else [])]
    return np.frombuffer("".join(hashlib.sha256(r).hexdigest() for r in rows).encode(), np.uint8).reshape(-1, WIDTH)


def _levels(nodes: list[str], n: int, shape: Shape) -> list[np.ndarray]:
    """The levels of a block whose tree has n nodes at its lowest level, lowest first."""
    found = [np.frombuffer("".join(nodes).encode(), np.uint8).reshape(-1, WIDTH)]
    for _ in range(shape.height(n)):
        found.append(_climb(found[-1], shape.fanout))
    return found


def _siblings(levels: list[bytes], i: int, fanout: int) -> Iterator[tuple[bytes, bytes]]:
    """What stands left and right of node i's ancestor within its run, level by level."""
    for level in levels[:-1]:
        run = i - i % fanout
        yield level[run * WIDTH : i * WIDTH], level[(i + 1) * WIDTH : (run + fanout) * WIDTH]
        i //= fanout


def _placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """`nodes` (tree, ...) with pos, the place in its tree in `order`, and n, the tree's nodes.

    One range shuffle sorts all trees; a tree of any share lies over as many partitions as it needs, and only
    counts by tree and partition are summed up.
    """
    at = cut(nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("_at", F.monotonically_increasing_id()))
    at = at.withColumn("_part", F.shiftright("_at", 33))
    runs = at.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_c"))
    own = Window.partitionBy("tree")
    earlier = F.coalesce(F.sum("_c").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("tree", "_part", (earlier - F.col("_first")).alias("_shift"), F.sum("_c").over(own).alias("n"))
    return at.join(runs, ["tree", "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _tops(nodes: DataFrame, shape: Shape) -> DataFrame:
    """(tree, n, pos, node): the top of each block of `nodes`, and how many its tree has."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        n = t.column("n")[0].as_py()
        top = _levels(t.column("node").to_pylist(), n, shape)[-1]
        # a block below the root of its tree has climbed all its levels to one node
        return pa.table({"tree": t.column("tree").slice(0, 1), "n": [-(-n // shape.block)], "pos": [key[1].as_py()], "node": [top.tobytes().decode()]})

    blocks = nodes.select("tree", "n", "pos", "node").withColumn("block", F.expr(f"pos div {shape.block}"))
    return map_groups(blocks, ["tree", "block"], run, "tree string, n long, pos long, node string")


def _forest(nodes: DataFrame, shape: Shape) -> list[DataFrame]:
    """Tables of nodes, from `nodes` up to one node a tree; each is smaller by the size of a block."""
    stages = [nodes]
    while stages[-1].filter("n > 1").limit(1).count():
        stages.append(cut(_tops(stages[-1], shape)))
    return stages


_TEXTS = pa.list_(pa.string())
_PATH = "tree string, pos long, lefts array<string>, rights array<string>, subroot string, root string"


def _down(nodes: DataFrame, above: DataFrame, run, schema: str, shape: Shape) -> DataFrame:
    """Cogroups each block of `nodes` with the path of its top; `run` takes levels, the sorted block and the path's row."""

    def both(key: tuple, block: pa.Table, paths: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        levels = _levels(block.column("node").to_pylist(), block.column("n")[0].as_py(), shape)
        return run([x.tobytes() for x in levels], block, paths.slice(0, 1).to_pylist()[0])

    blocks = nodes.withColumn("block", F.expr(f"pos div {shape.block}"))
    return map_cogroups(blocks, ["tree", "block"], above, ["tree", "pos"], both, schema)


def _paths(stages: list[DataFrame], top: DataFrame, shape: Shape) -> DataFrame:
    """The paths of the nodes in stages[0], from those of the trees' tops."""

    def run(levels: list[bytes], block: pa.Table, above: dict) -> pa.Table:
        found = [list(_siblings(levels, i, shape.fanout)) for i in range(len(block))]
        lefts = [[a.decode() for a, _ in own] + above["lefts"] for own in found]
        rights = [[b.decode() for _, b in own] + above["rights"] for own in found]
        constant = {c: pa.array([above[c]] * len(block), pa.string()) for c in ("subroot", "root")}
        sides = {"lefts": pa.array(lefts, _TEXTS), "rights": pa.array(rights, _TEXTS)}
        return pa.table({"tree": block.column("tree"), "pos": block.column("pos"), **sides, **constant})

    path = top
    for nodes in reversed(stages):
        path = cut(_down(nodes, path, run, _PATH, shape))
    return path


def fold(leaf: str, lefts: list[str], rights: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for a, b in zip(lefts, rights, strict=True):
        leaf = hashlib.sha256(f"{a}{leaf}{b}".encode()).hexdigest()
    return leaf


def manifest(leaves: DataFrame, shape: Shape = Shape(), paths: bool = False) -> DataFrame:  # noqa: B008
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of `leaves`.

    `leaves` has source, doc_id, leaf (a hex digest) and claim (the digest to verify in its place, null for the leaf
    itself). The leaves of a source ascend by doc_id, nulls first, then by leaf and claim, so repeated rows have a
    defined place. Every `fanout` consecutive nodes become one until one is left, the source's subroot; the subroots,
    null first, then bytewise, give the root likewise. proof_sha256 hashes a leaf's siblings from the leaf up. With
    `paths`, these stand in lefts and rights, a text of joined digests a level, for `fold`.

    Blocks of fanout ** levels leaves are one task each, whatever a source's share; the driver holds no node. An
    empty table gives an empty result.
    """
    tree = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("source")))
    rows = leaves.select(tree.alias("tree"), "doc_id", F.col("leaf").alias("node"), "claim").withColumn("uid", F.monotonically_increasing_id())
    placed = cut(_placed(cut(rows), ["doc_id", "node", "claim", "uid"]).drop("uid"))
    stages = _forest(placed, shape)
    subroots = stages[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node")
    roots = cut(_placed(subroots, ["name"]))
    forest = _forest(roots, shape)
    no = F.array().cast("array<string>")
    top = forest[-1].select("tree", "pos", no.alias("lefts"), no.alias("rights"), F.lit("").alias("subroot"), F.col("node").alias("root"))
    own = _paths(forest, top, shape).join(roots.select("pos", "name", "node"), "pos")
    path = own.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "lefts", "rights", F.col("node").alias("subroot"), "root")
    if len(stages) > 1:
        path = _paths(stages[1:], path, shape)

    def run(levels: list[bytes], block: pa.Table, above: dict) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("proof_sha256", "folded_root", "lefts", "rights")}
        upper = [(a.encode(), b.encode()) for a, b in zip(above["lefts"], above["rights"], strict=True)]
        tail = b"".join(a + b for a, b in upper)
        leaf, claim = block.column("node").to_pylist(), block.column("claim").to_pylist()
        for i in range(len(leaf)):
            inner = list(_siblings(levels, i, shape.fanout))
            out["proof_sha256"].append(hashlib.sha256(b"".join(a + b for a, b in inner) + tail).hexdigest())
            node = (claim[i] or leaf[i]).encode()
            for a, b in inner + upper:
                node = hashlib.sha256(a + node + b).hexdigest().encode()
            out["folded_root"].append(node.decode())
            if paths:
                out["lefts"].append([a.decode() for a, _ in inner] + above["lefts"])
                out["rights"].append([b.decode() for _, b in inner] + above["rights"])
        constant = {c: pa.array([above[c]] * len(leaf), pa.string()) for c in ("subroot", "root")}
        verified = pa.array([x == above["root"] for x in out["folded_root"]], pa.bool_())
        more = {c: pa.array(out[c], _TEXTS) for c in ("lefts", "rights")} if paths else {}
        proof, folded = (pa.array(out[c], pa.string()) for c in ("proof_sha256", "folded_root"))
        return pa.table({"doc_id": block.column("doc_id"), "leaf": block.column("node"), **constant, "proof_sha256": proof, "folded_root": folded, "verified": verified, **more})

    kind = leaves.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _down(placed, path, run, schema + (", lefts array<string>, rights array<string>" if paths else ""), shape)


#: What a leaf covers, in this order.
COVERED = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rows over all of `documents`; where 5 divides the crc32 of the id, A-Z of the text is lower-cased."""
    docs = table(spark, sf_dir, "documents")
    changed = digest_of([ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in COVERED])
    claim = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, changed)
    return manifest(docs.select("source", "doc_id", digest_of([F.col(c) for c in COVERED]).alias("leaf"), claim.alias("claim")))


SQL = """
WITH RECURSIVE l AS (
    SELECT source, doc_id, leaf, claim, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, claim) - 1 AS pos,
           count(*) OVER (PARTITION BY source) AS n, row_number() OVER (ORDER BY source, doc_id) AS id
    FROM (SELECT source, doc_id, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                 CASE WHEN crc % 5 = 0 THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS claim
          FROM (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                       || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
                       xor(4294967295, list_reduce(string_split(CAST(doc_id AS VARCHAR), ''), lambda c, x:
                           list_reduce(range(8), lambda a, b: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, CAST(ascii(x) AS BIGINT))),
                           CAST(4294967295 AS BIGINT))) AS crc
                FROM documents))),
t AS (
    SELECT source, 0 AS level, pos, leaf AS node, n FROM l
    UNION ALL
    SELECT source, level + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), (n + 15) // 16
    FROM t WHERE n > 1 GROUP BY source, level, pos // 16, n),
s AS (SELECT source, level, node, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
    SELECT 0 AS level, pos, node, n FROM s
    UNION ALL
    SELECT level + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), (n + 15) // 16
    FROM u WHERE n > 1 GROUP BY level, pos // 16, n),
up AS (  -- all nodes under one root: those of a source's tree, then those over the subroots
    SELECT s.pos AS tree, t.level, t.pos, t.node FROM t JOIN s ON t.source IS NOT DISTINCT FROM s.source WHERE t.n > 1
    UNION ALL SELECT s.pos, s.level + u.level, u.pos, u.node FROM s, u WHERE u.n > 1),
f AS (
    SELECT l.id, s.pos AS tree, s.level AS height, s.pos AS top, 0 AS level, CASE WHEN s.level = 0 THEN s.pos ELSE l.pos END AS pos,
           coalesce(claim, leaf) AS node, '' AS proof
    FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source
    UNION ALL
    SELECT f.id, f.tree, f.height, f.top, f.level + 1, CASE WHEN f.level + 1 = f.height THEN f.top ELSE f.pos // 16 END,
           sha256(string_agg(CASE WHEN up.pos = f.pos THEN f.node ELSE up.node END, '' ORDER BY up.pos)),
           f.proof || coalesce(string_agg(CASE WHEN up.pos <> f.pos THEN up.node END, '' ORDER BY up.pos), '')
    FROM f JOIN up ON f.tree = up.tree AND f.level = up.level AND f.pos // 16 = up.pos // 16
    GROUP BY f.id, f.tree, f.height, f.top, f.level, f.pos, f.proof),
r AS (SELECT node AS root FROM u WHERE n = 1)
SELECT l.doc_id, l.leaf, s.node AS subroot, r.root, sha256(f.proof) AS proof_sha256, f.node AS folded_root, f.node = r.root AS verified
FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source JOIN f ON f.id = l.id CROSS JOIN r
WHERE f.level = s.level + (SELECT max(level) FROM u)
"""
