"""Near-duplicate documents: SetSketch registers, banded and estimated jointly, then exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, held, look_up, map_arrow, map_groups, slices
from tessera.session import table


@dataclass(frozen=True)
class Rule:
    """What counts as near: `words` per shingle, Jaccard similarity of at least `percent` hundredths.

    `bands` bands of `rows` registers each: a pair at the threshold misses all of them with probability
    (1 - (percent / 100) ** rows) ** bands, 3e-10 at 85 and 1e-7 at 80 hundredths, and a pair above it less.
    `slack` is how far below the threshold the joint estimate may lie before a pair is left out, about
    five standard errors of the estimate.
    """

    words: int = 5
    percent: int = 80
    bands: int = 30
    rows: int = 4

    @property
    def registers(self) -> int:
        return self.bands * self.rows

    @property
    def least_estimate(self) -> float:
        t = self.percent / 100
        return t - 5 * math.sqrt(t * (1 - t) / self.registers)

    def holds(self, common: int, n: int, m: int) -> bool:
        return 100 * common >= self.percent * (n + m - common)


#: Base, rate and largest register value of the sketch.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_KEPT_WORDS, _CHUNK = 200_000, 1 << 20


def _digests(words: list[bytes]) -> np.ndarray:
    """64-bit digests of words; those of a worker's frequent words are kept."""
    import xxhash

    known = held("near_dup")
    try:
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(known) > _KEPT_WORDS:
            known.clear()
        out = np.empty(len(words), np.uint64)
        for k, w in enumerate(words):
            d = known.get(w)
            if d is None:
                d = xxhash.xxh3_64_intdigest(w)
                if len(w) <= 40:
                    known[w] = d
            out[k] = d
        return out


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit digests of the text's shingles of `words` words; A-Z lower-cased, ASCII white space splits.

    A text with fewer words is one shingle, one without words has none. Long texts are read in pieces.
    """
    data = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    if len(data) <= _CHUNK:
        w = _digests(data.split())
    else:
        parts, at = [], 0
        while at < len(data):
            stop = min(at + _CHUNK, len(data))
            while stop < len(data) and data[stop] not in b" \t\n\r\x0b\x0c":
                stop += 1
            parts.append(_digests(data[at:stop].split()))
            at = stop
        w = np.concatenate(parts)
    if not len(w):
        return w
    n = min(words, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = (h ^ w[k : len(w) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ (h >> np.uint64(29)))


def _register_keys(registers: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 1 << 63, registers, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, registers, dtype=np.uint64)


def sketches(sets: list[np.ndarray], registers: int) -> np.ndarray:
    """SetSketch registers of non-empty sets, one row each.

    Register i is max(1 - log_BASE(h_i(x)), rounded down) over the elements x, with h_i(x) exponential of rate
    RATE: a truncated minimum on an exponential scale. The sketch of a union is the registers' maximum.
    """
    mult, add = _register_keys(registers)
    x = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    least = np.empty((len(sets), registers), np.uint64)
    for i in range(registers):
        least[:, i] = np.minimum.reduceat((x + add[i]) * mult[i], starts)
    h = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(h) / math.log(BASE)), 0, TOP).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def joint_estimate(greater: np.ndarray, less: np.ndarray, equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarities from how many registers are greater, less and equal, and the set sizes.

    A register of the first set is the greater with probability p(u - vJ), of the second with p(v - uJ), where
    u and v are the sets' shares of n + m and p(x) = -log_BASE(1 - x (BASE - 1) / BASE).
    """
    u, v = n / (n + m), m / (n + m)
    grid = np.linspace(0, 1, 101)[None, :] * (np.minimum(n, m) / np.maximum(n, m))[:, None]

    def p(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE), 1e-9, 1)

    a, b = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
    like = greater[:, None] * np.log(a) + less[:, None] * np.log(b) + equal[:, None] * np.log(np.clip(1 - a - b, 1e-9, 1))
    return grid[np.arange(len(grid)), like.argmax(1)]


def _fingerprint(s: np.ndarray) -> bytes | None:
    """128-bit digest of a whole set."""
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def sketch_table(docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (set size), fp (128-bit digest of the whole set), sig (registers) for each row; no text goes further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, fps, sigs = [], [], []
            for start, stop in slices(batch.column(1), 1 << 20):
                sets = [shingles(t, rule.words) for t in batch.column(1).slice(start, stop - start).to_pylist()]
                full = [s for s in sets if len(s)]
                rows = iter(sketches(full, rule.registers)) if full else iter(())
                for s in sets:
                    sizes.append(len(s))
                    fps.append(_fingerprint(s))
                    sigs.append(next(rows).astype("<u2").tobytes() if len(s) else None)
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(fps, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "n", "fp", "sig"]
            )

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)), run, "doc_id long, n long, fp binary, sig binary")


def _counts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (a > b).sum(-1), (a < b).sum(-1), (a == b).sum(-1)


def _likely(pairs: DataFrame, reps: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (rep, hub) whose joint estimate comes near the threshold."""
    of_hub = reps.select(F.col("rep").alias("hub"), F.col("n").alias("hub_n"), F.col("sig").alias("hub_sig"))
    both = pairs.join(of_hub, "hub").join(reps.select("rep", "n", "sig"), "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in ("n", "hub_n"))
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(len(n), -1) for k in ("sig", "hub_sig"))
            yield batch.select(["rep", "hub"]).filter(pa.array(joint_estimate(*_counts(a, b), n, m) >= rule.least_estimate))

    return map_arrow(both.select("rep", "hub", "n", "hub_n", "sig", "hub_sig"), run, "rep long, hub long")


#: Rows up to which a table of ids is broadcast (16 bytes each); beyond, it is shuffled.
BROADCAST_ROWS = 1_000_000


def _sets(docs: DataFrame, reps: DataFrame, ids: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """(rep, set) with the sorted shingle digests of the classes in `ids`, whose texts are read again by a doc_id of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for start, stop in slices(batch.column(1)):
                sets += [shingles(t, rule.words) for t in batch.column(1).slice(start, stop - start).to_pylist()]
            yield pa.record_batch(
                [pa.array([_fingerprint(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.large_binary()).cast(pa.binary())], names=["fp", "set"]
            )

    wanted = cut(reps.join(ids, "rep", "left_semi").select("doc").distinct())
    few = wanted.count() <= BROADCAST_ROWS
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col))
    found = texts.join(F.broadcast(wanted) if few else wanted, "doc", "left_semi")
    return cut(map_arrow(found, run, "fp binary, set binary").filter(F.octet_length("set") > 0).select(F.xxhash64("fp").alias("rep"), "set"))


def _verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (rep, hub) that hold on their full sets."""
    both = pairs.join(sets.select(F.col("rep").alias("hub"), F.col("set").alias("hub_set")), "hub").join(sets, "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column("set"), batch.column("hub_set"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                ok.append(_holds(x, y, rule))
            yield batch.select(["rep", "hub"]).filter(pa.array(ok, pa.bool_()))

    return map_arrow(both.select("rep", "hub", "set", "hub_set"), run, "rep long, hub long")


def _holds(x: np.ndarray, y: np.ndarray, rule: Rule) -> bool:
    if 100 * min(len(x), len(y)) < rule.percent * max(len(x), len(y)):
        return False
    return rule.holds(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of undirected links (a, b); the label is the component's smallest node.

    Large-star and small-star rounds in turn, whose edges never grow in number; each round is written to the
    shared folder, and hubs with any share of the edges are looked up by broadcast.
    """
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    state = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")))
    before = edges.agg(state).first()[0]
    while before[0]:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        found = look_up(both, ["u"], lambda rows, hot: rows.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), F.col("v"))
        edges = cut(found.filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
        found = edges.join(least, "hi")
        edges = cut(found.select("hi", F.col("m").alias("lo")).union(found.filter("lo > m").select("lo", "m")).distinct())
        now = edges.agg(state).first()[0]
        if now == before:
            break
        before = now
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("label")).union(edges.select("lo", "lo").distinct())


#: Members and shingles of a chunk of a bucket, about; two chunks meet in one task.
CHUNK_MEMBERS, CHUNK_SHINGLES = 512, 1 << 19


def _dealt(roles: DataFrame) -> DataFrame:
    """`roles` of buckets with members of both roles, with the chunks of their bucket and size: gm of any members, gl of odd ones."""

    def sizes(rows: DataFrame, hot: bool) -> DataFrame:
        def chunks(of: Column) -> Column:
            members, shingles_ = F.count_if(of), F.sum(F.when(of, F.col("n")).otherwise(0))
            return F.ceil(F.greatest(members / CHUNK_MEMBERS, shingles_ / CHUNK_SHINGLES)).cast("int")

        return rows.groupBy("key", "cell").agg(chunks(~F.col("odd")).alias("gm"), chunks(F.col("odd")).alias("gl"), F.count_if(~F.col("odd")).alias("c"))

    return cut(look_up(roles, ["key", "cell"], sizes, F.col("rep")).filter("gl > 0 AND c > 1").drop("c"))


def _open_links(members: DataFrame, labels: DataFrame, reps: DataFrame, docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """Links between documents of one bucket that the links so far leave in different components.

    In each bucket with several components, every member outside the largest one meets the other members whose
    set size allows a link, chunk by chunk, so a bucket of any size is many tasks. Sizes are cut into levels, a
    factor of the threshold apart: two sets that can be linked lie in one level or in adjacent ones. Pairs in one
    component are passed over, the others estimated and verified on full sets; a chunk pair returns at most one
    link per component it joins, never all pairs. A pair is tried in its first common band only, and in each bucket
    alike, whatever its size.
    """
    # a little wider than the threshold's factor, so rounding never puts a pair at the threshold two levels apart
    step = max(math.log(100 / rule.percent), 1e-9) * (1 + 1e-6)
    level = F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("long").alias("level")
    found = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").join(reps.select("rep", "n"), "rep")
    marked = cut(found.select("key", "band", "rep", F.coalesce("label", "rep").alias("label"), "n", level))

    def mains(rows: DataFrame, hot: bool) -> DataFrame:
        per_label = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
        return per_label.groupBy("key").agg(F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("c", "label")).alias("main"))

    inside = look_up(marked, ["key"], mains, F.col("rep")).filter("labels > 1")
    inside = cut(inside.withColumn("odd", F.col("label") != F.col("main")).drop("labels", "main"))
    # a member outside the largest component in the cell of its level, and each member in those that it can be met from
    role = lambda cell, odd: (F.col("key"), cell.alias("cell"), "band", "rep", "label", odd.alias("odd"), "n")
    beside = F.explode(F.array(F.col("level") - 1, F.col("level"), F.col("level") + 1))
    roles = inside.filter("odd").select(*role(F.col("level"), F.lit(True))).union(inside.select(*role(beside, F.lit(False))))
    dealt = _dealt(roles)
    at = lambda g: F.array(F.pmod(F.xxhash64("rep"), F.col(g)).cast("int"))
    every = lambda g: F.sequence(F.lit(0), F.col(g) - 1)
    rows = dealt.withColumn("lc", F.explode(F.when(F.col("odd"), at("gl")).otherwise(every("gl"))))
    rows = rows.withColumn("mc", F.explode(F.when(F.col("odd"), every("gm")).otherwise(at("gm"))))
    rows = rows.join(reps.select("rep", "sig"), "rep").select("key", "cell", "lc", "mc", "band", "rep", "label", "odd", "n", "sig")

    def candidates(t: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
        """For each odd row the rows of other components to try, likeliest first."""
        label, odd, sizes = (t.column(k).to_numpy() for k in ("label", "odd", "n"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u2").reshape(len(label), -1)
        band, any_ = t.column("band")[0].as_py(), np.flatnonzero(~odd)
        for x in np.flatnonzero(odd).tolist():
            other = any_[(label[any_] != label[x]) & (np.minimum(sizes[any_], sizes[x]) * 100 >= rule.percent * np.maximum(sizes[any_], sizes[x]))]
            same = sig[other] == sig[x]
            near = same.sum(1) >= (rule.least_estimate - 0.03) * rule.registers
            other, same = other[near], same[near]
            shared = same.reshape(len(other), rule.bands, rule.rows).all(2)
            other = other[shared.argmax(1) == band]
            if len(other):
                est = joint_estimate(*_counts(sig[other], sig[x]), sizes[other].astype(float), np.full(len(other), float(sizes[x])))
                order = np.argsort(-est, kind="stable")
                if len(other := other[order[est[order] >= rule.least_estimate]]):
                    yield x, other

    def likely(t: pa.Table) -> pa.Table:
        chosen = np.zeros(len(t), bool)
        for x, other in candidates(t):
            chosen[x] = True
            chosen[other] = True
        return t.filter(pa.array(chosen))

    def run(t: pa.Table) -> pa.Table:
        rep, label = t.column("rep").to_numpy(), t.column("label").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("set")]
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        out = []
        for x, other in candidates(t):
            for y in other.tolist():
                a, b = root(int(label[x])), root(int(label[y]))
                if a != b and _holds(sets[x], sets[y], rule):
                    parent[max(a, b)] = min(a, b)
                    out.append((int(rep[x]), int(rep[y])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    # the registers first; full sets travel only for rows that have a likely partner in their chunk
    left = cut(map_groups(rows, ["key", "cell", "lc", "mc"], lambda key, t: likely(t), rows.schema))
    sets = _sets(docs, reps, left.select("rep").distinct(), rule, id_col, text_col)
    return map_groups(left.join(sets, "rep"), ["key", "cell", "lc", "mc"], lambda key, t: run(t), "a long, b long")


def near_duplicates(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """doc_id, n_shingles, component_id, kept for every row.

    Rows with equal sets form a class (128-bit digest of the whole set), known by a hash of that digest. Classes
    that agree on all registers of a band fall into a bucket. First each member is tried against the bucket's
    smallest class, then members that stayed in different components against each other, so that a group
    of any size costs tasks of bounded size and no link is lost. Links are estimated jointly from the registers
    and confirmed on the full sets; component_id is the smallest doc_id of the connected component.

    A text without words has an empty set, is its own component and is kept. Rows with a null doc_id get a null
    component_id unless a row with an id has the same set; they are kept then. Rows that repeat a doc_id with
    equal sets are one document; those with other sets are judged each by its own. An empty table gives an empty
    result.
    """
    return _judged(docs, rule, id_col, text_col).drop("fp")


def _judged(docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """near_duplicates with the digest of each row's set, fp."""
    rows = cut(sketch_table(docs, rule, id_col, text_col))
    reps = rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    reps = cut(reps.withColumn("rep", F.xxhash64("fp")))
    width = 2 * rule.rows
    bands = reps.select(
        "rep",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(rule.bands - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * width + 1, F.lit(width))))).alias("band", "key"),
    )
    hubs = lambda rows, hot: rows.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("c"))
    members = cut(look_up(bands, ["key"], hubs, F.col("rep")).filter("c > 1").drop("c"))
    pairs = cut(_likely(members.filter("rep <> hub").select("rep", "hub").distinct(), reps, rule))
    sets = _sets(docs, reps, pairs.select("rep").union(pairs.select("hub")).distinct(), rule, id_col, text_col)
    links = cut(_verified(pairs, sets, rule).select(F.col("rep").alias("a"), F.col("hub").alias("b")))
    labels = cut(components(links))
    more = cut(_open_links(members.select("key", "band", "rep"), labels, reps, docs, rule, id_col, text_col))
    labels = cut(components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more)))
    linked = cut(reps.join(labels.withColumnRenamed("node", "rep"), "rep").select("rep", "label", F.struct("doc", "fp").alias("own")))
    # the class that stands for a component: the one with the smallest doc_id, then the smallest digest
    least = look_up(linked, ["label"], lambda rows, hot: rows.groupBy("label").agg(F.min("own").alias("least")), F.col("rep")).select("rep", "least")
    classes = cut(
        reps.join(least, "rep", "left").select("fp", F.coalesce("least.doc", "doc").alias("component"), F.coalesce("least.fp", "fp").alias("first"))
    )

    def make(asked: DataFrame, hot: bool) -> DataFrame:
        return classes.join(F.broadcast(asked.select("fp").distinct()), "fp") if hot else classes

    found = look_up(rows.select("doc_id", "n", "fp"), ["fp"], make, F.col("doc_id").cast("string").cast("binary"))
    stays = (F.col("doc_id") == F.col("component")) & (F.col("fp") == F.col("first"))
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"),
        F.when(F.col("doc_id").isNull() | F.col("first").isNull(), True).otherwise(stays).alias("kept"),
        "fp",
    )


def drop_near_duplicates(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """`docs` with one document of each group: the one with the smallest id. Rows without an id stay.

    Rows go by their id, but where an id has rows of both kinds, by id and set, so that only copies go. Rows that repeat
    an id with equal sets are one document and stay or go together. A null text or one without words is no copy of
    anything and stays; whole texts count, however long; an empty table gives an empty one.
    """
    judged = cut(_judged(docs, rule, id_col, text_col).filter("doc_id IS NOT NULL").select(F.col("doc_id").alias(id_col), "fp", "kept"))
    gone = judged.filter("NOT kept").select(id_col).distinct()
    mixed = cut(gone.join(judged.filter("kept"), id_col, "left_semi"))
    n = mixed.count()
    if not n:
        return docs.join(cut(gone), id_col, "left_anti").select(*docs.columns)
    part = F.broadcast(mixed) if n <= BROADCAST_ROWS else mixed
    whole = docs.join(cut(gone.join(mixed, id_col, "left_anti")), id_col, "left_anti").join(part, id_col, "left_anti").select(*docs.columns)
    some = cut(docs.join(part, id_col, "left_semi").select(*docs.columns))
    at, name = some.columns.index(text_col), "_tessera_fp"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = []
            for start, stop in slices(batch.column(at)):
                fps += [_fingerprint(shingles(t, rule.words)) for t in batch.column(at).slice(start, stop - start).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(fps, pa.binary())], names=[*batch.schema.names, name])

    marked = map_arrow(some, run, T.StructType([*some.schema.fields, T.StructField(name, T.BinaryType())]))
    copies = judged.filter("NOT kept").select(id_col, F.col("fp").alias(name)).distinct().join(part, id_col, "left_semi")
    return whole.unionByName(marked.join(cut(copies), [id_col, name], "left_anti").select(*docs.columns))


#: The contract's rule for the registered query.
CONTRACT = Rule(words=3, percent=85)


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups over all of `documents`: three-word shingles, similarity of 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), CONTRACT)
