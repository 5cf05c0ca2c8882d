"""Joins of texts by their words: shared n-grams of two tables, and pairs of texts with nearly the same words."""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.registry import Registry
from tessera.session import table
from tessera.sources.files import scratch

#: n-grams of the smaller table up to which their Bloom filter and they themselves are broadcast (8 and about 400 MB).
BROADCAST_GRAMS = 1 << 22
#: Bits and probes of the filter for each n-gram: one in 200 others passes.
BITS, PROBES = 16, 3


def words(text: Column) -> Column:
    """The words of a text between ASCII white space, A-Z lower-cased; null has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase + "\t\n\v\f\r", string.ascii_lowercase + " " * 5)
    return F.array_remove(F.split(plain, " "), "")


def _starts(w: Column, n: int) -> Column:
    """Places (from 1) where an n-gram begins."""
    return F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))


def _gram(w: Column, at: Column, n: int) -> Column:
    return F.array_join(F.slice(w, at, n), " ")


def _hash(w: Column, at: Column, n: int) -> Column:
    return F.xxhash64(F.slice(w, at, n))


def bloom_filter(hashes: DataFrame, count: int) -> tuple[bytes, int]:
    """A filter of `count` 64-bit hashes, seven bits a byte (so that each byte is a character), and its size in bits."""
    size = max(7, count * BITS)
    held = np.array([r[0] for r in hashes.collect()], np.int64)
    bits = np.zeros(-(-size // 7) * 7, np.uint8)
    for k in range(PROBES):
        bits[_probe_of(held, k) % size] = 1
    return (bits.reshape(-1, 7) << np.arange(7, dtype=np.uint8)).sum(1).astype(np.uint8).tobytes(), size


def _probe_of(h, k: int):
    """Three overlapping windows of the hash's bits, never negative."""
    return (h >> (15 * k)) & ((1 << 33) - 1)


def might_hold(held: bytes, size: int, h: Column) -> Column:
    """Whether the filter may hold the hash."""

    def probe(k: int) -> Column:
        at = F.shiftright(h, 15 * k).bitwiseAND(F.lit((1 << 33) - 1)) % size
        byte = F.ascii(F.substring(F.lit(held), (F.floor(at / 7) + 1).cast("int"), F.lit(1)).cast("string"))
        return F.getbit(byte.cast("long"), (at % 7).cast("int")) == 1

    found = probe(0)
    for k in range(1, PROBES):
        found = found & probe(k)
    return found


def shared_ngrams(docs: DataFrame, items: DataFrame, n: int = 8, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, item_grams, share): documents and items with an n-gram of words in common.

    n_shared counts the different n-grams of the item that the document has, share is their part of the item's. The
    items' n-grams go into a Bloom filter that the scan of the documents applies to hashes, so hardly an n-gram
    leaves the scan that no item has, and no text is shuffled. The rest is joined by the n-gram itself: against a
    broadcast table while the items have at most BROADCAST_GRAMS n-grams, shuffled and without a filter beyond.
    Items and documents of fewer than n words, or without text, share nothing; rows that repeat an id count as one
    text; a null id is an id.
    """
    of_items = items.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("w"))
    grams = F.transform(_starts(F.col("w"), n), lambda i: F.struct(_gram(F.col("w"), i, n).alias("gram"), _hash(F.col("w"), i, n).alias("h")))
    of_items = of_items.select("item_id", F.explode(F.array_distinct(grams)).alias("g")).select("item_id", "g.gram", "g.h").distinct()
    hashes = of_items.select("h").distinct()
    count = hashes.limit(BROADCAST_GRAMS + 1).count()
    few = count <= BROADCAST_GRAMS
    w = F.col("w")
    places = _starts(w, n)
    if few:
        held, size = bloom_filter(hashes, count)
        places = F.filter(places, lambda i: might_hold(held, size, _hash(w, i, n)))
    of_docs = docs.select(F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("w")).select(
        "doc_id", F.explode(F.array_distinct(F.transform(places, lambda i: _gram(w, i, n)))).alias("gram")
    )
    totals = of_items.groupBy(F.col("item_id").alias("_item")).agg(F.count(F.lit(1)).alias("item_grams"))
    counted = of_items.join(totals, F.col("item_id").eqNullSafe(F.col("_item"))).select("item_id", "gram", "item_grams")
    both = of_docs.join(F.broadcast(counted) if few else counted, "gram")
    shared = both.groupBy("doc_id", "item_id").agg(F.count_distinct("gram").alias("n_shared"), F.first("item_grams").alias("item_grams"))
    return shared.withColumn("share", F.round(F.col("n_shared") / F.col("item_grams"), 6))


@dataclass(frozen=True)
class Overlap:
    """Sets of words are alike if their Jaccard similarity is at least `percent` hundredths."""

    percent: int = 80

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """How many of a set's first words, in one order for all sets, a set alike must share one of."""
        return np.where(n > 0, n + (-self.percent * n // 100) + 1, 0)

    def enough(self, common: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return common * (100 + self.percent) >= self.percent * (n + m)


#: Counters that words are hashed to for their order, members of a chunk of a word's sets, rows up to which ids are broadcast.
COUNTERS, CHUNK, BROADCAST_ROWS = 1 << 22, 1024, 1_000_000
#: Least and most bits of the bitmap of a set's words that goes with each of its first words; between, a bit a word or more.
MARK_LEAST, MARK_MOST = 128, 4096
#: Bytes of the batches that go to Python, rows that are compared at once, and members up to which pairs are listed.
BATCH_BYTES, AT_ONCE, FEW = 16 << 20, 50_000, 64


def _kept(df: DataFrame) -> DataFrame:
    """`df` written to a scratch folder and read back."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _flat(batch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a column of lists of longs."""
    lists = batch.column(name)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py(), lists.flatten().to_numpy()


def _hashes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h): the hashes of each row's different words."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs.select(F.col(id_col).alias("doc_id"), F.array_distinct(F.transform(words(F.col(text_col)), lambda x: F.xxhash64(x))).alias("h"))


def _digest(h: np.ndarray) -> bytes:
    """128 bits that tell a set of hashes from others."""
    return hashlib.blake2b(np.sort(h), digest_size=16).digest()


def _signature(h: np.ndarray) -> bytes:
    """A bitmap of the set with two to four bits a word."""
    bits = np.zeros(max(8, 2 << max(len(h) - 1, 0).bit_length()), np.uint8)
    bits[h & (len(bits) - 1)] = 1
    return np.packbits(bits).tobytes()


def _mark(h: np.ndarray) -> bytes:
    """A bitmap of the set with one or two bits a word, within bounds."""
    bits = np.zeros(min(MARK_MOST, max(MARK_LEAST, 1 << max(len(h) - 1, 0).bit_length())), np.uint8)
    bits[h & (len(bits) - 1)] = 1
    return np.packbits(bits).tobytes()


def _most_common(x: np.ndarray, n: int, y: np.ndarray, m: int) -> int:
    """How many words two sets can have in common at most, by their signatures."""
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    return min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))


def _word_sets(docs: DataFrame, rule: Overlap, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, fp, n, prefix, pos, often, mark, sig): each row's set of words by digest, its size, its first words with
    their places and whether many rows may have them, and two bitmaps. First words that no other row has are left out.

    The words are in an order from rare to frequent, by a small counter of those that all words are hashed to: one
    order for all sets, whatever the counters hold, from a table of fixed size.
    """
    sets = _hashes(docs, id_col, text_col)
    cells = sets.select(F.explode("h").alias("x")).groupBy(F.pmod("x", F.lit(COUNTERS)).alias("cell")).agg(F.count(F.lit(1)).alias("c")).toArrow()
    counts = np.zeros(COUNTERS, np.int32)
    counts[cells.column("cell").to_numpy()] = cells.column("c").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at, h = _flat(batch, "h")
            n = np.diff(at)
            own = [h[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            digests, marks, signatures = (pa.array([f(x) for x in own], pa.binary()) for f in (_digest, _mark, _signature))
            count = shared.value[h % COUNTERS]
            order = np.lexsort((h, count, np.repeat(np.arange(len(n)), n)))
            h, count = h[order], count[order]
            pos = np.arange(len(h)) - np.repeat(at[:-1], n)
            meets = (pos < np.repeat(rule.prefix(n), n)) & (count > 1)
            ends = pa.array(np.append(0, np.cumsum(meets))[at], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, v) for v in (pa.array(h[meets], pa.int64()), pa.array(pos[meets], pa.int32()), pa.array(count[meets] > CHUNK))]
            yield pa.record_batch([batch.column("doc_id"), digests, pa.array(n, pa.int64()), *lists, marks, signatures], names=["doc_id", "fp", "n", "prefix", "pos", "often", "mark", "sig"])

    kind = sets.schema["doc_id"].dataType.simpleString()
    return _kept(sets.mapInArrow(run, f"doc_id {kind}, fp binary, n long, prefix array<long>, pos array<int>, often array<boolean>, mark binary, sig binary"))


def _classes(sets: DataFrame) -> DataFrame:
    """(cls, fp, id, n, prefix, pos, often, mark, sig): a row for each set that is not empty, numbered, with its smallest doc_id."""
    by = sets.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in ("n", "prefix", "pos", "often", "mark", "sig")))
    return _kept(by.withColumn("cls", F.monotonically_increasing_id()))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables that hold whole groups of (word, lo, hi), with the first row of each group."""
    held: list[pa.Table] = []

    def cut(rows: pa.Table) -> np.ndarray:
        new = np.zeros(len(rows), bool)
        for c in ("word", "lo", "hi"):
            v = rows.column(c).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        new[0] = True
        return np.flatnonzero(new)

    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
        if sum(map(len, held)) < AT_ONCE:
            continue
        rows = pa.concat_tables(held).combine_chunks()
        first = cut(rows)
        if len(first) > 1:
            yield rows.slice(0, first[-1]), first[:-1]
        held = [rows.slice(first[-1])]
    if held:
        rows = pa.concat_tables(held).combine_chunks()
        yield rows, cut(rows)


def _candidates(t: pa.Table, first: np.ndarray, rule: Overlap) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, ys): rows that may be alike with a row x of their group. A pair counts in its first common word only."""
    n, pos, own = (t.column(c).to_numpy() for c in ("n", "pos", "own"))
    at, words_ = _flat(t, "earlier")
    lo, hi = t.column("lo").to_numpy(), t.column("hi").to_numpy()
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(t)], strict=True):
        if b - a < 2:
            continue
        if b - a <= FEW:
            earlier = [frozenset(words_[at[k] : at[k + 1]].tolist()) for k in range(a, b)]
            disjoint = None
        else:  # which members have an earlier word in common: a product of 0/1 rows
            code, inverse, times = np.unique(words_[at[a] : at[b]], return_inverse=True, return_counts=True)
            more = (times > 1)[inverse]
            row, column = np.repeat(np.arange(b - a), np.diff(at[a : b + 1]))[more], (np.cumsum(times > 1) - 1)[inverse][more]
            disjoint = np.ones((b - a, b - a), bool)
            for k in range(0, int((times > 1).sum()), 4096):
                part = (column >= k) & (column < k + 4096)
                held = np.zeros((b - a, min(4096, len(code))), np.float32)
                held[row[part], column[part] - k] = 1
                disjoint &= held @ held.T == 0
        for x in range(a, b):
            if lo[a] == hi[a]:
                ys = np.arange(x + 1, b)
            elif own[x] == lo[a]:
                ys = a + np.flatnonzero(own[a:b] == hi[a])
            else:
                continue
            most = np.minimum(n[x] - pos[x], n[ys] - pos[ys])  # words from here on, this one included
            ys = ys[rule.enough(most, n[x], n[ys])]
            if disjoint is None:
                ys = np.array([y for y in ys.tolist() if earlier[x - a].isdisjoint(earlier[y - a])], np.int64)
            else:
                ys = ys[disjoint[x - a, ys - a]]
            if len(ys):
                yield x, ys


def _links(t: pa.Table, first: np.ndarray, rule: Overlap) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(x, ys, common): the candidates that are alike, counted on their whole sets."""
    at, h = _flat(t, "h")
    code = np.unique(h, return_inverse=True)[1]
    mark = np.zeros(len(h) + 1, bool)
    n = np.diff(at)
    for x, ys in _candidates(t, first, rule):
        mark[code[at[x] : at[x + 1]]] = True
        sizes = n[ys]
        ends = np.cumsum(sizes)
        flat = np.arange(ends[-1]) + np.repeat(at[ys] - (ends - sizes), sizes)
        common = np.add.reduceat(mark[code[flat]].astype(np.int64), ends - sizes)
        mark[code[at[x] : at[x + 1]]] = False
        alike = rule.enough(common, n[x], sizes)
        if alike.any():
            yield x, ys[alike], common[alike]


def _folded(marks: list[bytes]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The width of each mark in words of 64 bits, and for each width the marks that have it or are folded to it."""
    width = np.array([len(m) // 8 for m in marks])
    by_width: dict[int, np.ndarray] = {}
    w = MARK_MOST // 64
    while w >= MARK_LEAST // 64:
        by_width[w] = np.zeros((len(marks), w), np.uint64)
        own = np.flatnonzero(width == w)
        if len(own):
            by_width[w][own] = np.frombuffer(b"".join(marks[k] for k in own.tolist()), np.uint64).reshape(-1, w)
        if 2 * w in by_width:
            more = np.flatnonzero(width > w)
            wide = by_width[2 * w][more]
            by_width[w][more] = wide[:, :w] | wide[:, w:]
        w //= 2
    return width, by_width


def _close(t: pa.Table, first: np.ndarray, rule: Overlap) -> np.ndarray:
    """Which rows have another in their group that size, place and marks leave: all groups at once, one step further apart a round.

    Each bit that only one of two marks has is a word that the other set lacks. The wider mark is folded to the other's width.
    """
    n, pos, own, lo, hi = (t.column(c).to_numpy() for c in ("n", "pos", "own", "lo", "hi"))
    width, marks = _folded(t.column("mark").to_pylist())
    size = np.diff(np.append(first, len(t)))
    last = np.repeat(first + size, size)
    found = np.zeros(len(t), bool)
    rows, step = np.arange(len(t)), 1
    while len(rows := rows[rows + step < last[rows]]):
        other = rows + step
        ok = rule.enough(np.minimum(n[rows] - pos[rows], n[other] - pos[other]), n[rows], n[other])
        ok &= (lo[rows] == hi[rows]) | (own[rows] != own[other])
        for w, mark in marks.items():
            some = np.flatnonzero(ok & (np.minimum(width[rows], width[other]) == w))
            x, y = rows[some], other[some]
            both = mark[x] & mark[y]
            lacks = [np.bitwise_count(mark[k] ^ both).sum(1).astype(np.int64) for k in (x, y)]
            ok[some] = rule.enough(np.minimum(n[x] - lacks[0], n[y] - lacks[1]), n[x], n[y])
        found[rows[ok]] = True
        found[other[ok]] = True
        step += 1
    return found


def _few(ids: DataFrame) -> DataFrame:
    """`ids`, to be broadcast if they are few."""
    ids = _kept(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def _chunked(members: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """`members` (word, cls, ...) sorted by word and pair of chunks of its members; nearly all words have one chunk.

    `counted` may be less than `members`, but must have all rows of words with more than CHUNK.
    """
    many = (members if counted is None else counted).groupBy("word").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > CHUNK)
    g = F.coalesce(F.ceil(F.col("c") / CHUNK).cast("int"), F.lit(1))
    own = members.join(_few(many), "word", "left").withColumn("own", F.pmod(F.xxhash64("cls", "word"), g).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), g - 1))).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    return _sorted(dealt.drop("c", "other"))


def _sorted(members: DataFrame) -> DataFrame:
    return members.repartition("word", "lo", "hi").sortWithinPartitions("word", "lo", "hi")


def _chosen(pairs, rows: int) -> pa.Array:
    """The rows that stand in a pair."""
    found = np.zeros(rows, bool)
    for x, ys in pairs:
        found[x] = True
        found[ys] = True
    return pa.array(found)


def _by_signature(t: pa.Table, first: np.ndarray, rule: Overlap) -> Iterator[tuple[int, np.ndarray]]:
    """The candidates whose signatures leave enough words in common."""
    n, sig = t.column("n").to_numpy(), [np.frombuffer(x, np.uint8) for x in t.column("sig").to_pylist()]
    for x, ys in _candidates(t, first, rule):
        most = np.array([_most_common(sig[x], n[x], sig[y], n[y]) for y in ys.tolist()])
        if len(ys := ys[rule.enough(most, n[x], n[ys])]):
            yield x, ys


def _likely(classes: DataFrame, rule: Overlap) -> DataFrame:
    """Members of the words that several sets have among their first, by word and pair of chunks, if they have a candidate.

    Size, place and marks decide first, where the words meet: a word takes its set's mark along, so what leaves that step
    grows with the sets that are nearly alike and not with those that only have a word in common. Only that is grouped by
    set again, so that each member knows the earlier words that it shares with others. Signatures of the whole sets decide last.
    """
    entries = classes.select("cls", "n", "mark", F.explode(F.arrays_zip("prefix", "pos", "often")).alias("e"))
    often = entries.filter("e.often").select(F.col("e.prefix").alias("word"))
    entries = entries.select("cls", "n", "mark", "e.pos", F.col("e.prefix").alias("word"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, first in _groups(batches):
            yield from t.filter(pa.array(_close(t, first, rule))).select(["cls", "n", "pos", "word"]).to_batches()

    schema = "cls long, n long, pos int, word long"
    left = _chunked(entries, often).mapInArrow(near, schema)
    by_set = left.groupBy("cls", "n").agg(F.array_sort(F.collect_set(F.struct("pos", "word"))).alias("all"))
    earlier = F.transform(F.slice("all", F.lit(1), F.col("k")), lambda x: x["word"])
    members = _kept(by_set.select("cls", "n", "all", F.posexplode("all").alias("k", "e")).select("cls", "n", "e.pos", "e.word", earlier.alias("earlier")))

    def first_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, first in _groups(batches):
            yield from t.filter(_chosen(_candidates(t, first, rule), len(t))).to_batches()

    dealt = _chunked(members)
    found = _kept(dealt.mapInArrow(first_common, dealt.schema))
    names = found.columns

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, first in _groups(batches):
            yield from t.filter(_chosen(_by_signature(t, first, rule), len(t))).select(names).to_batches()

    return _kept(_sorted(found.join(classes.select("cls", "sig"), "cls")).mapInArrow(signed, found.schema))


def _compared(docs: DataFrame, classes: DataFrame, rule: Overlap, id_col: str, text_col: str, emit, schema: str) -> DataFrame:
    """What `emit` makes of each link; whole sets are read again, and travel, only for members with a candidate."""
    likely = _likely(classes, rule)
    asked = _few(classes.join(likely.select("cls").distinct(), "cls", "left_semi").select("cls", "fp", "id"))
    rows = _hashes(docs.join(asked.select("id"), docs[id_col].eqNullSafe(F.col("id")), "left_semi"), id_col, text_col)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, h = _flat(batch, "h")
            fps = [_digest(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.record_batch([pa.array(fps, pa.binary()), batch.column("h")], names=["fp", "h"])

    whole = rows.select("h").mapInArrow(digest, "fp binary, h array<long>").join(asked.select("cls", "fp"), "fp").groupBy("cls").agg(F.first("h").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, first in _groups(batches):
            yield emit(t, _links(t, first, rule))

    return _sorted(likely.join(whole, "cls")).mapInArrow(run, schema)


def alike_pairs(docs: DataFrame, rule: Overlap = Overlap(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """(a, b, n_a, n_b, common): pairs of different sets of words that are alike, each known by its smallest doc_id, a < b."""
    classes = _classes(_word_sets(docs, rule, id_col, text_col))

    def emit(t: pa.Table, links) -> pa.RecordBatch:
        cls, n = t.column("cls").to_numpy(), t.column("n").to_numpy()
        rows = [(cls[x], cls[y], n[x], n[y], c) for x, ys, common in links for y, c in zip(ys.tolist(), common.tolist(), strict=True)]
        return pa.record_batch([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names=["f", "g", "n_f", "n_g", "common"])

    pairs = _compared(docs, classes, rule, id_col, text_col, emit, "f long, g long, n_f long, n_g long, common long")
    side = lambda cls, as_: classes.select(F.col("cls").alias(cls), F.col("id").alias(as_))
    pairs = pairs.join(side("f", "i"), "f").join(side("g", "j"), "g")
    swap = F.col("i") > F.col("j")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return pairs.select(pick("i", "j").alias("a"), pick("j", "i").alias("b"), pick("n_f", "n_g").alias("n_a"), pick("n_g", "n_f").alias("n_b"), "common")


def alike_documents(docs: DataFrame, rule: Overlap = Overlap(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """doc_id, n_words, class_id, n_links for each row: its different words, the smallest doc_id with the same set of
    words, and how many other sets are alike.

    Two sets alike share one of their first words in an order from rare to frequent, so sets meet by these words only,
    in pairs of chunks of a word's sets, and are left out there by size and by how many words can still follow. A
    pair is compared once, in its first common word, on whole sets. No pair leaves a task, only counts.

    Words are told apart by 64-bit hashes, sets by 128-bit digests. Rows without a word are classes of their own and
    have no links; a null id is the smallest of a class only if no row of it has an id; repeated rows are one class;
    texts of any length count whole, other columns are ignored; an empty table gives an empty result.
    """
    sets = _word_sets(docs, rule, id_col, text_col)

    def emit(t: pa.Table, links) -> pa.RecordBatch:
        counts = np.zeros(len(t), np.int64)
        for x, ys, _ in links:
            counts[x] += len(ys)
            counts[ys] += 1
        found = np.flatnonzero(counts)
        return pa.record_batch([t.column("cls").combine_chunks().take(pa.array(found)), pa.array(counts[found])], names=["cls", "links"])

    classes = _classes(sets)
    links = _compared(docs, classes, rule, id_col, text_col, emit, "cls long, links long").groupBy("cls").agg(F.sum("links").alias("links"))
    classes = classes.select("cls", "fp", "id").join(links, "cls", "left").select("fp", "id", F.coalesce("links", F.lit(0)).alias("links"))
    own = F.col("n") == 0
    return sets.select("doc_id", "fp", "n").join(classes, "fp", "left").select(
        "doc_id", F.col("n").alias("n_words"), F.when(own, F.col("doc_id")).otherwise(F.col("id")).alias("class_id"), F.when(own, 0).otherwise(F.col("links")).alias("n_links")
    )


_SQL_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[ \t\n\r\v\f]+'), lambda x: x <> '')"""


def _sql_grams(name: str, key: str, n: int) -> str:
    return f"""{name} AS (
    SELECT DISTINCT {key}, array_to_string(w[i : i + {n - 1}], ' ') AS gram
    FROM (SELECT {key}, w, unnest(generate_series(1, len(w) - {n - 1})) AS i FROM (SELECT {key}, {_SQL_WORDS} AS w FROM {"documents" if key == "doc_id" else "benchmark"})))"""


def register_queries(r: Registry) -> None:
    @r.query(
        "text_contamination",
        f"""WITH {_sql_grams("d", "doc_id", 8)}, {_sql_grams("b", "item_id", 8)},
        t AS (SELECT item_id, count(*) AS item_grams FROM b GROUP BY 1)
        SELECT doc_id, b.item_id, count(*) AS n_shared, any_value(item_grams) AS item_grams, round(count(*) / any_value(item_grams), 6) AS share
        FROM d JOIN b USING (gram) JOIN t ON t.item_id = b.item_id GROUP BY doc_id, b.item_id""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shared_ngrams(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

    @r.query(
        "text_word_overlap",
        f"""WITH w AS (SELECT doc_id, list_sort(list_distinct({_SQL_WORDS})) AS w FROM documents),
        c AS (SELECT w, min(doc_id) AS id, len(w) AS n FROM w WHERE len(w) > 0 GROUP BY w),
        u AS (SELECT id, n, unnest(w) AS x FROM c),
        p AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.x = b.x AND a.id < b.id AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n
              GROUP BY a.id, b.id, a.n, b.n HAVING count(*) * 180 >= 80 * (a.n + b.n)),
        l AS (SELECT id, count(*) AS links FROM (SELECT a AS id FROM p UNION ALL SELECT b FROM p) GROUP BY id)
        SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(c.id, w.doc_id) AS class_id, CAST(coalesce(l.links, 0) AS BIGINT) AS n_links
        FROM w LEFT JOIN c ON w.w = c.w LEFT JOIN l ON l.id = c.id""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return alike_documents(table(spark, sf_dir, "documents"))
