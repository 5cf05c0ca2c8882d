"""Long passages that a document repeats from earlier ones, found with run-length indexes over the text that recurs.

Windows of `length` bytes are dealt by content: a window goes where the smallest hash of its k-grams, its anchor, sends
it, so equal windows meet whatever document they stand in. Neighbouring windows of one anchor form a segment. Segments
that are equal as a whole are settled by their digests. Only segments that share an anchor and differ are indexed, in
blocks of bounded size: the Burrows-Wheeler transform of the block in runs, whose ends sample the smallest document,
through which each segment streams backwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, map_arrow, slices
from tessera.session import table


@dataclass(frozen=True)
class Rule:
    """A repeat is `length` bytes that also start in a document with a smaller id; anchors are `anchor` bytes long (a
    multiple of 8). Anchors with about `wide` segments or more are dealt by their whole windows instead."""

    length: int = 50
    anchor: int = 24
    wide: int = 1 << 16

    @property
    def grams(self) -> int:
        """Anchors that begin in a window."""
        return self.length - self.anchor + 1


#: Windows of a segment at most, bytes hashed at once, and bytes of an indexed block, about (one anchor's at least).
SEGMENT, PART, BLOCK = 64, 1 << 20, 1 << 20
#: One text of SAMPLE tells which anchors are wide; of these at most so many are held by every task.
SAMPLE, WIDE_KEYS = 64, 1 << 22
#: Bytes up to which what is known of documents is broadcast; beyond, it is shuffled with the texts.
BROADCAST_BYTES = 64 << 20
#: The order of a row without an id: after all others.
LAST = (1 << 63) - 1

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * _M1
    h ^= h >> np.uint64(32)
    h *= _M2
    return h ^ (h >> np.uint64(29))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    inverse = np.uint64(pow(int(_M3), -1, 1 << 64))
    one = np.ones(1, np.uint64)
    return tuple(np.concatenate([one, np.cumprod(np.full(n, x, np.uint64))]) for x in (_M3, inverse))


def segments(parts: list[bytes], rule: Rule, wide: np.ndarray) -> tuple[np.ndarray, ...]:
    """(part, start, n, h, d) of the segments of texts of at least `length` bytes: which text, first window, windows,
    anchor and digest. Windows of an anchor in `wide` (sorted) are segments of their own, with a hash of theirs for h."""
    data = b"".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    first = np.cumsum(sizes) - sizes
    grams, windows = len(data) - rule.anchor + 1, len(data) - rule.length + 1
    words = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    h = np.zeros(grams, np.uint64)
    for at in range(0, rule.anchor, 8):
        h = _mix(h ^ words[at : at + grams])
    least, span = h, 1
    while span * 2 <= rule.grams:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    least = np.minimum(least[:windows], least[rule.grams - span : rule.grams - span + windows])
    # windows over the end of a text are none; a segment ends with its anchor or its text
    valid = np.ones(windows, bool)
    for k in range(1, rule.length):
        ends = first[1:] - k
        valid[ends[ends < windows]] = False
    new = np.ones(windows, bool)
    new[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    start = np.flatnonzero(new & valid)
    n = np.diff(np.append(np.flatnonzero(new | ~valid), windows))[np.searchsorted(np.flatnonzero(new | ~valid), start)]
    most = np.full(len(start), SEGMENT)
    anchor = least[start]
    if len(wide):
        is_wide = wide[np.minimum(np.searchsorted(wide, anchor), len(wide) - 1)] == anchor
        most[is_wide] = 1
    pieces = -(-n // most)
    within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    most = np.repeat(most, pieces)
    start, n, anchor = np.repeat(start, pieces) + within * most, np.minimum(np.repeat(n, pieces) - within * most, most), np.repeat(anchor, pieces)
    power, inverse = (p[: grams + 1] for p in _powers(PART + rule.length))

    def digest(letters: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * power[:grams])])
        return _mix((total[start + n + rule.grams - 1] - total[start]) * inverse[start] ^ n.astype(np.uint64))

    d = digest(_mix(h ^ _M2))
    if len(wide) and is_wide.any():
        alone = np.repeat(is_wide, pieces)
        anchor = np.where(alone, digest(_mix(h ^ _M3)), anchor)
    part = np.searchsorted(first, start, side="right") - 1
    return part, start - first[part], n, anchor, d


def _parts(texts: list[bytes | None], rule: Rule) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Texts in runs of at most PART bytes or so, with row and place of each; longer ones in parts that share no window."""
    some, rows, at, size = [], [], [], 0
    for row, text in enumerate(texts):
        if text is None or len(text) < rule.length:
            continue
        step = PART - rule.length
        for a in range(0, len(text) - rule.length + 1, step):
            piece = text if len(text) <= PART else text[a : a + step + rule.length - 1]
            if size and size + len(piece) > PART:
                yield some, np.array(rows), np.array(at)
                some, rows, at, size = [], [], [], 0
            some.append(piece)
            rows.append(row)
            at.append(a)
            size += len(piece)
            if piece is text:
                break
    if some:
        yield some, np.array(rows), np.array(at)


def _all_segments(texts: list[bytes | None], rule: Rule, wide: np.ndarray) -> list[np.ndarray]:
    """(row, start, n, h, d) of all the texts."""
    found = []
    for some, rows, at in _parts(texts, rule):
        part, start, n, h, d = segments(some, rule, wide)
        found.append((rows[part], start + at[part], n, h, d))
    kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64)
    return [np.concatenate(x) if found else np.zeros(0, k) for x, k in zip(zip(*found, strict=True) if found else kinds, kinds, strict=True)]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, doc, tkey, text): doc orders the rows, doc and tkey tell texts apart. The key is a digest of the text where an
    id is null or ids repeat, and 0 where ids alone will do."""
    ids = docs.select(F.col(id_col).alias("id"))
    repeats = not ids.filter("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").isEmpty()
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    key = F.xxhash64("text") if repeats else F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), text.alias("text")).withColumn("tkey", key)


def _column(batch, name: str, kind=np.int64) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(kind, copy=False)


def wide_anchors(texts: DataFrame, rule: Rule) -> np.ndarray:
    """Anchors of about `rule.wide` segments or more, by one text of SAMPLE; sorted. They only steer how windows are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(0)):
                h = _all_segments(batch.column(0).slice(start, stop - start).to_pylist(), rule, np.zeros(0, np.uint64))[3]
                yield pa.record_batch([pa.array(h.view(np.int64))], names=["h"])

    sampled = texts.filter((F.octet_length("text") >= rule.length) & (F.pmod(F.xxhash64("text", F.lit(1)), F.lit(SAMPLE)) == 0))
    counts = map_arrow(sampled.select("text"), run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    found = counts.filter(F.col("c") * SAMPLE >= rule.wide).orderBy(F.desc("c"), "h").limit(WIDE_KEYS).select("h").collect()
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


def _dealt(texts: DataFrame, rule: Rule) -> DataFrame:
    """(h, d, doc, tkey, loc) of the segments, loc being 256 times the place plus the windows.

    Where a batch has equal segments, only those of its smallest document are dealt by anchor; so the copies of a
    segment, however many, are as many rows as batches. The others are repeats already: loc has no windows, d their
    number, and h spreads them.
    """
    wide = texts.sparkSession.sparkContext.broadcast(wide_anchors(texts, rule))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, start, n, h, d = _all_segments(batch.column("text").to_pylist(), rule, wide.value)
            doc, key = _column(batch, "doc")[row], _column(batch, "tkey")[row]
            order = np.argsort(_mix(h ^ d))
            a, b = h[order], d[order]
            new = np.ones(len(order), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            least = np.zeros(len(order), np.int64)
            if len(order):
                least[order] = np.minimum.reduceat(doc[order], np.flatnonzero(new))[np.cumsum(new) - 1]
            done = doc > least
            # repeated rows of one document count once
            same = np.lexsort((start, key, doc, d, h)) if (key != 0).any() else np.zeros(0, np.int64)
            fields = (start, key, doc, d, h)
            again = np.zeros(len(row), bool)
            again[same[1:]] = np.logical_and.reduce([f[same[1:]] == f[same[:-1]] for f in fields]) if len(same) else False
            yield _records(h, d.view(np.int64), doc, key, start * 256 + n, ~done & ~again)
            # neighbours among the repeats are joined
            x = np.flatnonzero(done)
            if len(x):
                head = np.ones(len(x), bool)
                head[1:] = (row[x[1:]] != row[x[:-1]]) | (start[x[1:]] != start[x[:-1]] + n[x[:-1]])
                total = np.add.reduceat(n[x], np.flatnonzero(head))
                x = x[head]
                spread = _mix(doc[x].view(np.uint64) ^ _mix((start[x] ^ key[x]).view(np.uint64)))
                yield _records(spread, total, doc[x], key[x], start[x] * 256, np.ones(len(x), bool))

    return map_arrow(texts.filter(F.octet_length("text") >= rule.length).select("doc", "tkey", "text"), run, "h long, d long, doc long, tkey long, loc long")


def _records(h: np.ndarray, d: np.ndarray, doc: np.ndarray, key: np.ndarray, loc: np.ndarray, kept: np.ndarray) -> pa.RecordBatch:
    fields = {"h": h.view(np.int64), "d": d, "doc": doc, "tkey": key, "loc": loc}
    return pa.record_batch([pa.array(f[kept], pa.int64()) for f in fields.values()], names=list(fields))


def _whole_groups(batches: Iterator[pa.RecordBatch], least: int, size) -> Iterator[pa.Table]:
    """Sorted batches joined to tables that hold all rows of each of their `h`, of `least` or more by `size`."""
    held: list[pa.Table] = []
    total = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        total += size(batch)
        if total < least:
            continue
        last = held[-1].column("h").to_numpy()
        if held[0].column("h")[0].as_py() == last[-1]:
            continue  # one group so far
        rows = pa.concat_tables(held)
        stop = int(np.searchsorted(rows.column("h").to_numpy(), last[-1]))
        yield rows.slice(0, stop).combine_chunks()
        held = [rows.slice(stop).combine_chunks()]
        total = sum(size(b) for t in held for b in t.to_batches())
    if held:
        yield pa.concat_tables(held).combine_chunks()


_SETTLED = "doc long, tkey long, h long, start long, n long, asks boolean"


def _settle(dealt: DataFrame) -> DataFrame:
    """(doc, tkey, h, start, n, asks): windows that are repeats (asks is null), and segments that share their anchor with
    others and differ from them; of these the first documents of an anchor ask for nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, 200_000, lambda b: b.num_rows):
            h, d, doc, key, loc = (_column(t, c) for c in ("h", "d", "doc", "tkey", "loc"))
            start, n = loc >> 8, loc & 255
            done = n == 0
            out = [(doc[done], key[done], h[done], start[done], d[done], np.full(done.sum(), 2))]
            some = np.zeros(len(h), bool)
            some[1:] = h[1:] == h[:-1]
            some[:-1] |= some[1:].copy()
            x = np.flatnonzero(some & ~done)
            if len(x):
                x = x[np.lexsort((doc[x], d[x], h[x]))]
                newh = np.append(True, h[x[1:]] != h[x[:-1]])
                news = newh | np.append(True, d[x[1:]] != d[x[:-1]])
                group, seg = np.cumsum(newh) - 1, np.cumsum(news) - 1
                at = np.flatnonzero(newh)
                first, last = np.minimum.reduceat(doc[x], at), np.maximum.reduceat(doc[x], at)
                kinds = np.add.reduceat(news.astype(np.int64), at)
                own = doc[x[np.flatnonzero(news)]]  # sorted by document, so the first is the smallest
                repeat = doc[x] > own[seg]
                differ = ~repeat & (kinds[group] > 1) & (first < last)[group]
                for chosen, asks in ((repeat, np.full(len(x), 2)), (differ, (doc[x] > first[group]).astype(np.int64))):
                    y = x[chosen]
                    out.append((doc[y], key[y], h[y], start[y], n[y], asks[chosen]))
            doc, key, h, start, n, asks = (np.concatenate(c) for c in zip(*out, strict=True))
            asks = pa.array(asks == 1, pa.bool_(), mask=asks == 2)
            yield pa.record_batch([*(pa.array(c, pa.int64()) for c in (doc, key, h, start, n)), asks], names=["doc", "tkey", "h", "start", "n", "asks"])

    return map_arrow(dealt.repartition("h").sortWithinPartitions("h"), run, _SETTLED)


def _with_known(texts: DataFrame, known: DataFrame, how: str) -> DataFrame:
    """`texts` joined with (doc, tkey, known), which is broadcast if it is small."""
    size = known.agg(F.sum(F.octet_length("known") + 64)).first()[0] or 0
    return texts.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, ["doc", "tkey"], how)


_WANTED = np.dtype([("h", "<i8"), ("start", "<i8"), ("n", "u1"), ("asks", "u1")])


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, pa.Array]:
    """Offsets and values of a column of lists."""
    lists = batch.column(name)
    return lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()


def _wanted_texts(texts: DataFrame, settled: DataFrame, rule: Rule) -> DataFrame:
    """(h, doc, tkey, start, asks, seg): the bytes of the segments that differ."""
    rows = settled.filter("asks IS NOT NULL").groupBy("doc", "tkey").agg(F.collect_set(F.struct("h", "start", "n", "asks")).alias("all"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values = _lists(batch, "all")
            wanted = np.zeros(len(values), _WANTED)
            for name in _WANTED.names:
                wanted[name] = values.field(name).to_numpy(zero_copy_only=False)
            known = [wanted[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.record_batch([batch.column("doc"), batch.column("tkey"), pa.array(known, pa.binary())], names=["doc", "tkey", "known"])

    known = cut(map_arrow(rows, pack, "doc long, tkey long, known binary"))

    def slice_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column("text"), 1 << 20):
                part = batch.slice(lo, hi - lo)
                out: list[list] = [[], [], [], []]
                wanted = []
                for doc, key, text, what in zip(*(part.column(c).to_pylist() for c in ("doc", "tkey", "text", "known")), strict=True):
                    w = np.frombuffer(what, _WANTED)
                    wanted.append(w)
                    out[0] += [doc] * len(w)
                    out[1] += [key] * len(w)
                    out[2] += [text[a : a + n + rule.length - 1] for a, n in zip(w["start"].tolist(), w["n"].tolist(), strict=True)]
                w = np.concatenate(wanted)
                yield pa.record_batch(
                    [pa.array(w["h"]), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(w["start"]), pa.array(w["asks"] == 1), pa.array(out[2], pa.binary())],
                    names=["h", "doc", "tkey", "start", "asks", "seg"],
                )

    found = _with_known(texts.select("doc", "tkey", "text"), known, "inner")
    return map_arrow(found.select("doc", "tkey", "text", "known"), slice_, "h long, doc long, tkey long, start long, asks boolean, seg binary")


class RunIndex:
    """Run-length Burrows-Wheeler index of some segments, read as one ring, in the order of `length` bytes.

    A run ends where the byte before its rows changes or where a context ends, the rows that agree on `length`
    bytes. Each run end samples the smallest document among its rows; a context's sample is that of its runs. Rows
    whose bytes go beyond their segment count for no document. So the index grows with the runs and different
    contexts, not with the text.
    """

    def __init__(self, text: np.ndarray, starts: np.ndarray, docs: np.ndarray, length: int):
        n = len(text)
        ring = np.concatenate([text, np.resize(text, length + 8)]).tobytes()
        key = np.ndarray((n,), ">u8", buffer=ring, strides=(1,)).astype(np.uint64)
        done = 8
        while True:
            order = np.argsort(key)
            new = np.append(False, key[order[1:]] != key[order[:-1]])
            rank = np.empty(n, np.uint64)
            rank[order] = np.cumsum(new)
            if done >= length:
                break
            step = min(done, length - done)
            key = rank << np.uint64(32) | np.roll(rank, -step)
            done += step
        before = text[order - 1]
        size = np.diff(np.append(starts, n))
        left = np.repeat(starts + size, size) - np.arange(n)
        owner = np.where(left >= length, np.repeat(docs, size), LAST)[order]
        cuts = new | np.append(True, before[1:] != before[:-1])
        cuts[0] = True
        self.first = np.flatnonzero(cuts)
        lengths, byte = np.diff(np.append(self.first, n)), before[self.first].astype(np.int64)
        sample = np.minimum.reduceat(owner, self.first)
        self.context = np.cumsum(new)[self.first]
        head = np.flatnonzero(np.append(True, self.context[1:] != self.context[:-1]))
        self.smallest, self.row = np.minimum.reduceat(sample, head), self.first[head]
        # runs by byte, and what a step back needs of them
        by = np.argsort(byte, kind="stable")
        self.byte, self.start, self.size = byte[by], self.first[by], lengths[by]
        self.key = self.byte << 32 | self.start
        self.to = np.cumsum(self.size) - self.size
        self.least = np.searchsorted(self.byte, np.arange(257))
        self.total = np.append(self.to, n)
        # where the last window of each segment stands
        self.entry = rank[starts + size - length].astype(np.int64)

    def back(self, context: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The contexts that begin a byte earlier, for contexts that have this byte before them."""
        at = self.row[context]
        k = np.searchsorted(self.key, byte << 32 | at) - 1
        known = (k >= 0) & (self.byte[k] == byte)
        row = np.where(known, self.to[k] + np.minimum(self.size[k], at - self.start[k]), self.total[self.least[byte]])
        return self.context[np.searchsorted(self.first, row, side="right") - 1]


def repeated_windows(text: np.ndarray, starts: np.ndarray, docs: np.ndarray, asks: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, place, n): runs of windows, of the segments that ask, that also start in a smaller document.

    All segments stream through the index at once, each from its last window backwards, a byte a step.
    """
    index = RunIndex(text, starts, docs, length)
    windows = np.diff(np.append(starts, len(text))) - length + 1
    lane = np.flatnonzero(asks)
    place, context = windows[lane] - 1, index.entry[lane]
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    while len(lane):
        found = index.smallest[context] < docs[lane]
        hits.append((lane[found], place[found]))
        on = place > 0
        lane, place, context = lane[on], place[on] - 1, context[on]
        context = index.back(context, text[starts[lane] + place].astype(np.int64))
    seg, at = (np.concatenate(x) if hits else np.zeros(0, np.int64) for x in (zip(*hits, strict=True) if hits else ((), ())))
    order = np.lexsort((at, seg))
    seg, at = seg[order], at[order]
    head = np.ones(len(seg), bool)
    head[1:] = (seg[1:] != seg[:-1]) | (at[1:] != at[:-1] + 1)
    return seg[head], at[head], np.diff(np.append(np.flatnonzero(head), len(seg)))


def _indexed(segs: DataFrame, rule: Rule) -> DataFrame:
    """(doc, tkey, start, n): the windows of segments that differ, that also start in a smaller document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, BLOCK, lambda b: b.column("seg").nbytes):
            seg = t.column("seg").combine_chunks()
            text = np.frombuffer(b"".join(seg.to_pylist()), np.uint8)
            sizes = pc.binary_length(seg).to_numpy().astype(np.int64)
            doc, key, start, asks = (_column(t, c, k) for c, k in (("doc", np.int64), ("tkey", np.int64), ("start", np.int64), ("asks", bool)))
            who, at, n = repeated_windows(text, np.cumsum(sizes) - sizes, doc, asks, rule.length)
            yield pa.record_batch([pa.array(x, pa.int64()) for x in (doc[who], key[who], start[who] + at, n)], names=["doc", "tkey", "start", "n"])

    return map_arrow(segs.repartition("h").sortWithinPartitions("h"), run, "doc long, tkey long, start long, n long")


def _spans(marks: DataFrame, rule: Rule) -> DataFrame:
    """(doc, tkey, known): the spans of bytes [start, stop) to remove of each document, joined and in order, 16 bytes each."""
    rows = marks.groupBy("doc", "tkey").agg(F.collect_list(F.struct("start", "n")).alias("all"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values = _lists(batch, "all")
            start = values.field("start").to_numpy()
            stop = start + values.field("n").to_numpy() + rule.length - 1
            known = []
            for a, b in zip(at[:-1], at[1:], strict=True):
                order = np.argsort(start[a:b], kind="stable")
                s, e = start[a:b][order], np.maximum.accumulate(stop[a:b][order])
                head = np.flatnonzero(np.append(True, s[1:] > e[:-1]))
                known.append(np.stack([s[head], e[np.append(head[1:], len(s)) - 1]], 1).astype("<i8").tobytes())
            yield pa.record_batch([batch.column("doc"), batch.column("tkey"), pa.array(known, pa.binary())], names=["doc", "tkey", "known"])

    return cut(map_arrow(rows, run, "doc long, tkey long, known binary"))


def repeats(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:  # noqa: B008
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row; with `whole` also spans and kept.

    Each byte is removed that is covered by `length` bytes of the text, in UTF-8, that also start in a document with a
    smaller id; matches lie within a document, overlaps count, and texts are judged as given. spans are the removed
    runs as (start, stop), kept the remaining bytes. Null text counts as empty. A null id counts as the largest
    possible one; rows with one id, repeated rows included, remove nothing from each other. Texts of any length are
    read in parts; other columns of any name are ignored; an empty table gives an empty result.
    """
    texts = _texts(docs, id_col, text_col)
    settled = cut(_settle(_dealt(texts, rule)))
    more = _indexed(_wanted_texts(texts, settled, rule), rule)
    marks = settled.filter("asks IS NULL").select("doc", "tkey", "start", "n").unionByName(more)
    found = _with_known(texts, _spans(marks, rule), "left").select("id", "text", "known")
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", spans array<struct<start: long, stop: long>>, kept binary" if whole else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, known in zip(batch.column("text").to_pylist(), batch.column("known").to_pylist(), strict=True):
                spans = np.frombuffer(known or b"", "<i8").reshape(-1, 2).tolist()
                at, kept = 0, []
                for a, b in spans:
                    kept.append(text[at:a])
                    at = b
                kept = b"".join([*kept, text[at:]])
                row = [len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()]
                rows.append([*row, [{"start": a, "stop": b} for a, b in spans], kept] if whole else row)
            kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
            columns = [pa.array([r[k] for r in rows], kinds[k]) for k in range(6 if whole else 4)]
            yield pa.record_batch([batch.column("id"), *columns], names=names[: len(columns) + 1])

    return map_arrow(found, run, schema)


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rows over all of `documents`: 50 bytes that also start in a document with a smaller id go."""
    return repeats(table(spark, sf_dir, "documents"))
