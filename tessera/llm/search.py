"""Exact top-k search: BM25 over per-shard inverted indexes with block-max pruning."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, map_arrow, slices
from tessera.session import table

K1, B = 1.2, 0.75
#: Results per query, and the share of the ids that are queries.
TOP, EVERY = 10, 100
#: Bytes of a block of queries, which is broadcast; more queries mean more passes over the documents' terms.
QUERY_BYTES = 1 << 25
#: Postings and documents of one index that a task holds at a time, and documents of a block in it.
SHARD_POSTINGS, SHARD_DOCS, BLOCK = 2_400_000, 8192, 64
#: A term that more than one in so many documents of a shard hold has its impacts laid out by document.
COMMON = 24
#: Groups of documents with like common terms in a shard, and the most terms that tell them apart.
GROUPS, MARKS = 16, 256
#: Queries that search a shard together. One that leaves more than one in DENSE documents is added up by whole blocks.
TOGETHER, DENSE = 512, 24
#: Laid-out terms that are added between two looks at what may still reach the threshold.
STEP = 64
#: One in so many documents is searched before the others; the k-th score among them is where thresholds start.
PILOT = 8
#: Scores are rounded to this many digits before they are compared; ties go to the smaller doc_id.
DIGITS = 6
SLACK = 10.0**-DIGITS
_EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SPACES = b" \t\n\r\x0b\x0c"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Of each byte value: 0 inside a term, 1 punctuation, 2 white space.
_KIND = np.array([2 if b in _SPACES else 1 if b in _EDGES else 0 for b in range(256)], np.uint8)
#: Longest term that the digest table covers, and bytes that are read at a time.
_WIDTH, _WINDOW = 32, 1 << 20
_TABLE = np.random.default_rng(20240607).integers(0, 1 << 64, (_WIDTH, 256), dtype=np.uint64)


def _digests(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit digests of all terms of `data` in order, and where each begins.

    The digest of a term is the sum of a random number for each byte at its place, so two terms agree with a
    probability of 2^-64 whatever they are; long terms go through a hash function.
    """
    import xxhash

    data = data.translate(_LOWER)
    values = np.frombuffer(data, np.uint8)
    kind = _KIND[values]
    core = np.flatnonzero(kind == 0)
    if not len(core):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    run = np.cumsum(kind == 2, dtype=np.int32)[core]
    first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    start = core[first]
    size = core[np.append(first[1:], len(core)) - 1] + 1 - start
    short = np.minimum(size, _WIDTH)
    at = np.concatenate([[0], np.cumsum(short)])
    place = np.arange(at[-1]) - np.repeat(at[:-1], short)
    out = np.add.reduceat(_TABLE[place, values[place + np.repeat(start, short)]], at[:-1])
    for k in np.flatnonzero(size > _WIDTH).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[start[k] : start[k] + size[k]])
    return out, start


def _windows(data: bytes) -> Iterator[bytes]:
    """`data` in parts of about _WINDOW bytes that end at white space."""
    at = 0
    while at < len(data):
        stop = at + _WINDOW
        while stop < len(data) and data[stop] not in _SPACES:
            stop += 1
        yield data[at:stop]
        at = stop


def terms_of(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the sorted distinct 64-bit digests of its terms, and how often each occurs.

    A term is a run between ASCII white space, A-Z lower-cased, without ASCII punctuation at its ends. Long texts
    are read in windows.
    """
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    if sum(map(len, encoded)) <= 2 * _WINDOW:
        digests, start = _digests(b" ".join(encoded))
        ends = np.searchsorted(start, np.cumsum([len(x) + 1 for x in encoded]))
        parts = [digests[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    else:
        parts = [np.concatenate([np.zeros(0, np.uint64), *(_digests(w)[0] for w in _windows(x))]) for x in encoded]
    return [np.unique(p, return_counts=True) for p in parts]


@dataclass
class Queries:
    """A block of queries: ids, where each one's terms start, the terms' places in the block's list of terms, their
    weights (occurrences times idf), and a score that the k-th result of each reaches at least."""

    ids: list[int]
    starts: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    floors: np.ndarray
    mean_length: float

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.starts[k], self.starts[k + 1]
        return self.terms[a:b], self.weights[a:b]


@dataclass
class Shard:
    """An inverted index of some documents over numbered terms.

    Documents lie in groups with like common terms (texts of one language, say), in order of length within, and in
    blocks, so that the impacts of a term in a block are alike and most terms of a block's strangers are missing there. A
    rare term has its postings (documents and impacts); a common one has its impacts laid out by document, in single
    precision, and the largest of each block. `of` holds each document's terms again, for exact scores.
    """

    ids: list = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    terms: list[np.ndarray] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)
    postings: int = 0
    scored: int = 0  # postings that searches have added up
    met: int = 0  # postings of the terms that they asked for

    def add(self, doc_id: int, length: int, terms: np.ndarray, counts: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.lengths.append(length)
        self.terms.append(terms)
        self.counts.append(counts)
        self.postings += len(terms)

    def full(self) -> bool:
        return self.postings >= SHARD_POSTINGS or len(self.ids) >= SHARD_DOCS

    def build(self, n_terms: int, mean_length: float) -> None:
        n = len(self.ids)
        sizes = np.array([len(t) for t in self.terms], np.int64)
        term = np.concatenate([np.zeros(0, np.int32), *self.terms]).astype(np.int32)
        self.df = np.bincount(term, minlength=n_terms)
        order = np.lexsort((self.lengths, _groups(np.repeat(np.arange(n), sizes), term, self.df, n)))
        lengths = np.asarray(self.lengths, float)[order]
        self.ids = [self.ids[k] for k in order.tolist()]
        self.term = np.concatenate([np.zeros(0, np.int32), *(self.terms[k] for k in order.tolist())]).astype(np.int32)
        count = np.concatenate([np.zeros(0), *(self.counts[k] for k in order.tolist())])
        self.starts = np.concatenate([[0], np.cumsum(sizes[order])])
        doc = np.repeat(np.arange(n), sizes[order])
        self.impact = count * (K1 + 1) / (count + (K1 * (1 - B + B * lengths / mean_length))[doc])
        common = np.flatnonzero(self.df * COMMON > n)
        self.row = np.full(n_terms, -1)
        self.row[common] = np.arange(len(common))
        self.blocks = -(-n // BLOCK)
        self.laid = np.zeros((len(common), self.blocks * BLOCK), np.float32)
        row = self.row[self.term]
        here = row >= 0
        self.laid[row[here], doc[here]] = self.impact[here]
        self.block_max = self.laid.reshape(len(common), self.blocks, BLOCK).max(2)
        rare = np.flatnonzero(~here)
        rare = rare[np.argsort(self.term[rare], kind="stable")]  # by term, then document
        self.at = np.concatenate([[0], np.cumsum(np.bincount(self.term[rare], minlength=n_terms))])
        self.rare_doc, self.rare_impact = doc[rare], self.impact[rare]
        self.terms, self.counts = [], []

    def search(self, terms: np.ndarray, weights: np.ndarray, least: float, top: int) -> list[tuple[float, int]]:
        """`search_all` for one query."""
        return self.search_all([(terms, weights)], [least], top)[0]

    def search_all(self, queries: list[tuple[np.ndarray, np.ndarray]], least: list[float], top: int) -> list[list[tuple[float, int]]]:
        """For each query (score, place) of every document that may be among its `top` with a score of its `least` or more.

        Rare terms come first: their postings are added up. What the common terms can still add to a document of a
        block is bounded by their largest impacts there, for all queries and blocks by one product. Only documents whose
        bound reaches the threshold (the pivots) go on. If they are few, common terms are added to them a few at a time,
        from the highest weight on, and after each few those whose new bound falls below the threshold are left;
        if not, all queries that have pivots in a block are added up there by one product. Both are in single precision,
        with a margin for its error (no term is negative, so it is a share of the score); what still reaches the threshold
        is scored again from its own terms in double precision.
        """
        n, n_laid = len(self.ids), len(self.laid)
        error = (n_laid + 8) * 2.0**-23
        limit = np.maximum(np.asarray(least, float) - SLACK, 0) * (1 - error)
        common = np.zeros((len(queries), n_laid), np.float32)
        for k, (terms, weights) in enumerate(queries):
            self.met += int(self.df[terms].sum())
            row = self.row[terms]
            common[k, row[row >= 0]] = weights[row >= 0]
        rest = common @ self.block_max
        score = np.zeros((len(queries), self.blocks * BLOCK), np.float32)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        wanted = np.zeros((len(queries), self.blocks), bool)
        for k, (terms, weights) in enumerate(queries):
            a, b = self.at[terms], self.at[terms + 1]
            here = np.flatnonzero(b > a)
            if len(here):
                a, sizes = a[here], b[here] - a[here]
                ends = np.cumsum(sizes)
                at = np.arange(ends[-1]) + np.repeat(a - ends + sizes, sizes)
                score[k] = np.bincount(self.rare_doc.take(at), weights=self.rare_impact.take(at) * np.repeat(weights[here], sizes), minlength=self.blocks * BLOCK)
                self.scored += len(at)
            own = score[k].reshape(-1, BLOCK)
            most = own.max(1) + rest[k]
            pivots = np.flatnonzero((most >= limit[k]) & (most > 0))
            docs = np.flatnonzero(own[pivots] >= (limit[k] - rest[k][pivots])[:, None])
            if len(docs) * DENSE > n:
                wanted[k, pivots] = True
                continue
            docs = pivots[docs // BLOCK] * BLOCK + docs % BLOCK
            total = self._narrowed(common[k], rest[k], score[k].take(docs), docs, limit[k])
            found.append((np.full(len(total[0]), k), *total))
        for block in np.flatnonzero(wanted.any(0)).tolist():
            some = np.flatnonzero(wanted[:, block])
            at = slice(block * BLOCK, (block + 1) * BLOCK)
            here = np.flatnonzero(self.block_max[:, block])
            total = score[some, at] + common[some[:, None], here] @ self.laid[here, at]
            self.scored += total.size * len(here)
            k, d = np.nonzero((total >= limit[some][:, None]) & (total > 0))
            found.append((some[k], d + block * BLOCK, total[k, d]))
        out: list[list[tuple[float, int]]] = [[] for _ in queries]
        if not found:
            return out
        owner, docs, total = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(owner, kind="stable")
        ends = np.searchsorted(owner[order], np.arange(len(queries) + 1))
        dense = np.zeros(len(self.row))
        for k, (terms, weights) in enumerate(queries):
            own = order[ends[k] : ends[k + 1]]
            if len(own) > top:
                own = own[total[own] >= np.partition(total[own], -top)[-top] * (1 - 4 * error)]
            if len(own):
                dense[terms] = weights
                out[k] = list(zip(self._exact(dense, docs[own]).tolist(), docs[own].tolist(), strict=True))
                dense[terms] = 0
        return out

    def _narrowed(self, common: np.ndarray, rest: np.ndarray, total: np.ndarray, docs: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """Those of `docs` that reach the limit with all common terms, and their scores."""
        rows = np.flatnonzero(common)
        rows = rows[np.argsort(-common[rows], kind="stable")]
        rest = rest.astype(float)
        for k in range(0, len(rows), STEP):
            if not len(docs):
                break
            some = rows[k : k + STEP]
            total = total + common[some] @ self.laid.reshape(-1).take(some[:, None] * self.laid.shape[1] + docs[None, :])
            self.scored += len(some) * len(docs)
            rest = np.maximum(rest - common[some] @ self.block_max[some], 0)
            # what is left of `rest` carries the error of the sums that were taken off it
            stay = np.flatnonzero(total + rest.take(docs // BLOCK) >= limit - 1e-4 * limit)
            docs, total = docs.take(stay), total.take(stay)
        good = (total >= limit) & (total > 0)
        return docs[good], total[good]

    def _exact(self, weights: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Scores of `docs` for a query whose weights lie by term."""
        sizes = self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[docs] - ends + sizes, sizes)
        self.scored += len(docs)
        return np.add.reduceat(weights.take(self.term.take(at)) * self.impact.take(at), ends - sizes)


def _groups(doc: np.ndarray, term: np.ndarray, df: np.ndarray, n: int) -> np.ndarray:
    """A group for each of `n` documents, by likeness in the most common terms; it decides their order only."""
    common = np.argsort(-df, kind="stable")[:MARKS]
    common = common[df[common] * COMMON > n]
    column = np.full(len(df), -1)
    column[common] = np.arange(len(common))
    here = column[term] >= 0
    held = np.zeros((n, len(common) + 1), np.float32)
    held[doc[here], column[term[here]]] = 1
    held[:, -1] = 1e-3  # so that no row is empty
    held *= np.log(1.5 + n / np.append(df[common], n)).astype(np.float32)
    held /= np.linalg.norm(held, axis=1, keepdims=True)
    # each centre starts at the row least like those before it, then follows its rows
    near, centres = np.full(n, -1, np.float32), [held[0]]
    for _ in range(min(GROUPS, n) - 1):
        near = np.maximum(near, held @ centres[-1])
        centres.append(held[int(near.argmin())])
    centres = np.array(centres)
    for _ in range(5):
        group = (held @ centres.T).argmax(1)
        for g in np.unique(group).tolist():
            total = held[group == g].sum(0)
            centres[g] = total / np.linalg.norm(total)
    # like groups side by side, so that few blocks hold unlike documents
    alike = centres @ centres.T
    place, now = np.zeros(len(centres), np.int64), 0
    for k in range(1, len(centres)):
        alike[:, now] = -1
        now = int(alike[now].argmax())
        place[now] = k
    return place[group]


def _best(rows: list[tuple[float, int]], top: int) -> list[tuple[float, int]]:
    """The `top` of (score, doc_id): highest rounded score first, then the smaller id."""
    return sorted(((round(s, DIGITS), d) for s, d in rows), key=lambda x: (-x[0], x[1] is None, x[1]))[:top]


def bm25_top(docs: DataFrame, queries: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """query_id, rank, doc_id, score: the `top` documents of highest BM25 score for each row (id, text) of `queries`.

    Texts are read once, into a table of terms, whatever the number of queries. Each task indexes its part of it, shard
    after shard, and searches it for every query with block-max pruning; a query's running top-k carries over from shard to shard as its threshold, which starts at
    the k-th score among samples of the documents, smallest first. Document frequencies, number and mean length come from all
    documents first, so a score is the same in every shard, and the parts' results merge exactly. Queries go out in
    blocks of bounded bytes, each block in passes over the table of terms.

    Only documents with a common term are results: a query or document without terms (null or empty text, an empty
    table) has none. Null ids of queries are left out; queries that repeat an id and its terms are one query, those
    that repeat only the id are ranked each by its own. Repeated documents are rows of their own; of equal scores the
    smaller id is first, null ids last. Long texts are read in windows. Only the two named columns are read, so
    others may have any names.
    """
    spark = docs.sparkSession

    def as_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(1), _WINDOW):
                got = terms_of(batch.column(1).slice(start, stop - start).to_pylist())
                yield pa.record_batch(
                    [batch.column(0).slice(start, stop - start), pa.array([t.tobytes() for t, _ in got], pa.binary()), pa.array([c.astype("<i4").tobytes() for _, c in got], pa.binary())],
                    names=["id", "terms", "counts"],
                )

    def written(df: DataFrame) -> DataFrame:
        rows = map_arrow(df.select(F.col(id_col).cast("long").alias("id"), text_col), as_terms, "id long, terms binary, counts binary")
        return rows if df is docs else rows.filter(F.octet_length("terms") > 0).distinct()

    asked = cut(written(queries.filter(F.col(id_col).isNotNull())))
    rows, results = None, []
    for number, block in enumerate(_blocks(asked)):
        rows = rows if rows is not None else cut(written(docs))
        results.append(_search_block(spark, rows, block, top).withColumn("block", F.lit(number)))
    if not results:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    merged = results[0]
    for more in results[1:]:
        merged = merged.unionByName(more)
    w = Window.partitionBy("block", "query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return merged.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("query_id", "rank", "doc_id", "score")


def _blocks(asked: DataFrame) -> Iterator[list]:
    """Blocks of (id, terms, counts) rows of at most QUERY_BYTES, one at a time on the driver."""
    block, size = [], 0
    for row in asked.toLocalIterator():
        more = len(row["terms"]) * 2
        if block and size + more > QUERY_BYTES:
            yield block
            block, size = [], 0
        block.append((row["id"], bytes(row["terms"]), bytes(row["counts"])))
        size += more
    if block:
        yield block


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each row of a binary column starts and ends, in numbers of `kind`, and all its numbers."""
    ends = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    size = np.dtype(kind).itemsize
    return (ends - ends[0]) // size, np.frombuffer(data, kind, (ends[-1] - ends[0]) // size, ends[0]) if ends[-1] > ends[0] else np.zeros(0, kind)


def _asked(batch: pa.RecordBatch, every: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each row (terms, counts) its length; where the terms of each row that occur in `every` end, their places there and counts."""
    ends, terms = _flat(batch.column("terms"), "<u8")
    counts = _flat(batch.column("counts"), "<i4")[1]
    at = np.searchsorted(every, terms)
    at[at == len(every)] = 0
    hit = every[at] == terms
    lengths = np.diff(np.append(0, np.cumsum(counts, dtype=np.int64))[ends])
    return lengths, np.append(0, np.cumsum(hit))[ends], at[hit].astype(np.int32), counts[hit]


def _search_block(spark: SparkSession, rows: DataFrame, block: list, top: int) -> DataFrame:
    """query_id, query (its number in the block), doc_id, score: each task's best, over the documents' terms in `rows`."""
    block = sorted(block)
    terms = [np.frombuffer(t, np.uint64) for _, t, _ in block]
    every = np.unique(np.concatenate(terms))
    wanted = spark.sparkContext.broadcast(every)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = wanted.value
        df, n, words = np.zeros(len(names), np.int64), 0, 0
        for batch in batches:
            if batch.num_rows:
                lengths, _, at, _ = _asked(batch, names)
                n, words = n + len(lengths), words + int(lengths.sum())
                df += np.bincount(at, minlength=len(names))
        seen = np.flatnonzero(df)
        yield pa.record_batch(
            [pa.array([-1, *seen], pa.int64()), pa.array([n, *df[seen]], pa.int64()), pa.array([words, *[0] * len(seen)], pa.int64())], names=["term", "n", "words"]
        )

    # as many rows as the block has terms, whatever the number of documents
    counted = map_arrow(rows, count, "term long, n long, words long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).toArrow()
    place, n, words = (counted.column(c).to_numpy() for c in ("term", "n", "words"))
    total = int(n[place == -1].sum())
    mean = max(1.0, float(words[place == -1].sum()) / max(1, total))
    df = np.zeros(len(every))
    df[place[place >= 0]] = n[place >= 0]
    idf = np.log1p((total - df + 0.5) / (df + 0.5))
    places = [np.searchsorted(every, t) for t in terms]
    weights = [np.frombuffer(c, "<i4") * idf[at] for at, (_, _, c) in zip(places, block, strict=True)]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in terms])])
    asked = Queries([q for q, _, _ in block], starts, np.concatenate(places).astype(np.int32), np.concatenate(weights), np.zeros(len(block)), mean)

    def searched(docs: DataFrame, asked: Queries) -> DataFrame:
        sent = spark.sparkContext.broadcast(asked)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, names = sent.value, wanted.value
            best: list[list[tuple[float, int]]] = [[] for _ in asked.ids]

            def flush(shard: Shard) -> None:
                shard.build(len(names), asked.mean_length)
                for start in range(0, len(asked.ids), TOGETHER):
                    some = range(start, min(start + TOGETHER, len(asked.ids)))
                    least = [max(asked.floors[k], best[k][-1][0] if len(best[k]) == top else 0.0) for k in some]
                    for k, found in zip(some, shard.search_all([asked.of(k) for k in some], least, top), strict=True):
                        if found:
                            best[k] = _best([*best[k], *((s, shard.ids[d]) for s, d in found)], top)

            shard = Shard()
            for batch in batches:
                if not batch.num_rows:
                    continue
                lengths, ends, at, counts = _asked(batch, names)
                for doc_id, length, a, b in zip(batch.column("id").to_pylist(), lengths.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    if b > a:
                        shard.add(doc_id, length, at[a:b], counts[a:b])
                    if shard.full():
                        flush(shard)
                        shard = Shard()
            if shard.ids:
                flush(shard)
            out = [(q, k, d, s) for k, (q, found) in enumerate(zip(asked.ids, best, strict=True)) for s, d in found if s >= asked.floors[k] - SLACK]
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["query_id", "query", "doc_id", "score"])

        return map_arrow(docs, search, "query_id long, query int, doc_id long, score double")

    # The k-th score among some documents is no more than that among all: a threshold that loses nothing. Each
    # sample's threshold lets only a few documents a query out of the tasks of the next, PILOT times as large.
    by_query = Window.partitionBy("query").orderBy(F.desc("score"))
    levels = int(math.log(max(1.0, total / SHARD_DOCS), PILOT)) if total else 0
    for share in (PILOT**level for level in range(levels, 0, -1)):
        some = rows.filter(F.pmod(F.xxhash64(F.col("id")), F.lit(share)) == 0).repartition(-(-total // share // SHARD_DOCS))
        kth = searched(some, asked).withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") == top).select("query", "score").toArrow()
        at = kth.column("query").to_numpy()
        asked.floors[at] = np.maximum(asked.floors[at], kth.column("score").to_numpy())
    return searched(rows, asked)


def op6_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 100, over all of `documents`."""
    docs = table(spark, sf_dir, "documents")
    return bm25_top(docs, docs.filter(F.col("doc_id") % EVERY == 0))
