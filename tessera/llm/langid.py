"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import map_arrow, slices
from tessera.session import table

#: Lengths of the n-grams, and hash buckets for each length.
GRAMS, BUCKETS = (1, 2, 3, 4), 1 << 15
#: Labelled documents that the model learns from, for each language, about.
TRAIN_DOCS = 3000
#: Languages that the model holds at most (131,072 log probabilities, half a MB, each).
LANGUAGES = 128
#: Added to each count.
SMOOTH = 0.5
#: Log probabilities are whole multiples of 1 / SCALE, so sums don't depend on their order.
SCALE = 1 << 12
#: What a document without any letter gets.
NONE = "und"


@dataclass
class Model:
    """Languages in order, per n-gram bucket and language the scaled log probability, and for each language the mean
    log probability of an n-gram of its training texts that the rest of them foretells."""

    langs: list[str]
    log_p: np.ndarray  # int32, (len(GRAMS) * BUCKETS, languages)
    usual: np.ndarray | None = None


#: Characters that are scored at a time; longer texts are cut, and their sums added up.
SLICE = 1 << 18


def _slices(texts: list[str]) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """Runs of at most about SLICE characters: places of the texts, parts of them, and how many n-grams start in each part.

    Texts are in lower case, opened by a space and closed by one. A part goes on for the length of an n-gram, so that
    those at its end are whole.
    """
    at, parts, own, size = [], [], [], 0
    for k, text in enumerate(texts):
        spaced = f" {text.lower()} "
        for start in range(0, len(spaced), SLICE):
            part = spaced[start : start + SLICE + GRAMS[-1] - 1]
            if parts and size + len(part) > SLICE:
                yield at, parts, own
                at, parts, own, size = [], [], [], 0
            at.append(k)
            parts.append(part)
            own.append(min(SLICE, len(spaced) - start))
            size += len(part)
    if parts:
        yield at, parts, own


_IS_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point whether it is a letter; made once per process."""
    global _IS_LETTER
    if _IS_LETTER is None:
        _IS_LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _IS_LETTER


def gram_buckets(parts: list[str], own: list[int]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each n-gram length the bucket at each place of the joined parts (-1 where an n-gram would leave its part, or
    starts beyond what is the part's own), the starts, and the letters of each part's own.

    What is no letter counts as a space, so digits, marks and addresses say nothing; n-grams that start
    with two spaces, or are a lone space, are marked by -1 as well.
    """
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len(p) for p in parts])
    starts = np.cumsum(sizes) - sizes
    letter = _letters()[points]
    points = np.where(letter, points, np.uint32(32))
    place = np.arange(len(points)) - np.repeat(starts, sizes)
    theirs = place >= np.repeat(own, sizes)
    n_letters = np.add.reduceat((letter & ~theirs).astype(np.int64), starts)
    left = np.repeat(sizes, sizes) - place  # places to the end of the part
    out, h = [], np.zeros(len(points), dtype=np.uint64)
    for k, n in enumerate(GRAMS):
        last = np.zeros_like(points)
        last[: max(0, len(points) - n + 1)] = points[n - 1 :]
        h = (h + last.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        bucket = ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(49)).astype(np.int64) + k * BUCKETS
        bad = (left < n) | theirs
        if n == 1:
            bad |= ~letter
        else:
            bad[:-1] |= ~letter[:-1] & ~letter[1:]
        out.append(np.where(bad, -1, bucket))
    return out, starts, n_letters


def _counts(texts: list[str], size: int) -> np.ndarray:
    """How often each bucket occurs in the texts together."""
    total = np.zeros(size, dtype=np.int64)
    for _, parts, own in _slices(texts):
        for b in gram_buckets(parts, own)[0]:
            total += np.bincount(b[b >= 0], minlength=size)
    return total


def _totals(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the scaled log probability in each language, the number of n-grams, and that of letters.

    A sparse product: each text's n-grams pick rows of the log-probability matrix, which are added up per text.
    """
    table_ = np.vstack([model.log_p, np.zeros((1, len(model.langs)), np.int32)])  # row -1 adds nothing
    total, n, letters = (np.zeros(shape, dtype=np.int64) for shape in ((len(texts), len(model.langs)), len(texts), len(texts)))
    for at, parts, own in _slices(texts):
        buckets, starts, n_letters = gram_buckets(parts, own)
        np.add.at(letters, at, n_letters)
        for b in buckets:
            np.add.at(n, at, np.add.reduceat((b >= 0).astype(np.int64), starts))
            for k in range(len(model.langs)):
                np.add.at(total[:, k], at, np.add.reduceat(table_[b, k].astype(np.int64), starts))
    return total, n, letters


def _best(total: np.ndarray, n_letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    odds = (total - total.max(1, keepdims=True)) / SCALE
    p = 1 / np.exp(np.maximum(odds, -700)).sum(1)
    none = n_letters == 0
    return np.where(none, -1, total.argmax(1)), np.where(none, 0.0, p)


def score(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The index of the best language (-1: no letter) and its posterior for each text.

    Priors are equal; ties go to the first language.
    """
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0)
    total, _, n_letters = _totals(texts, model)
    return _best(total, n_letters)


def fit_of(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As score, and how far the mean log probability of the text's n-grams in that language is from the usual one (0: like
    the training texts; the lower, the less any language fits)."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    total, n, n_letters = _totals(texts, model)
    best, p = _best(total, n_letters)
    usual = np.zeros(len(model.langs)) if model.usual is None else model.usual
    return best, p, total.max(1) / SCALE / np.maximum(n, 1) - usual[best]


def is_held_out(id_col: str):
    """crc32 of the id as text, mod 5, is 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bound: int = TRAIN_DOCS, languages: int = LANGUAGES) -> Model:
    """Learns from the text and non-null language of documents that are not held out.

    Of each language about `bound` documents are read, and of more than `languages` languages only those with the most
    documents (of equal ones the first by name), so a column of dirty values can't make the model larger. A document
    counts if its id and text hash into a share of its language; rows that repeat both count together. N-grams
    are counted where they lie: a task returns one row of bucket counts per language, and these are added up, so what
    reaches the driver is (buckets x languages), whatever the number of documents.

    Rows with a null id are held out; null texts and null languages teach nothing; long texts count whole; equal rows give
    equal counts, whatever their order; an empty table gives a model without a language.
    """
    labelled = docs.filter(~is_held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = labelled.groupBy(lang_col).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.orderBy(F.desc("_n"), lang_col).limit(languages)
    share = F.greatest(F.lit(1), F.floor(F.col("_n") / bound))
    # one row per language, as the model has one column for each: at most `languages`
    chosen = labelled.select(F.col(lang_col), text_col, id_col).join(F.broadcast(sizes), lang_col)
    chosen = chosen.filter(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("lang"), F.col(text_col)), share) == 0).select(lang_col, text_col)
    size = len(GRAMS) * BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for start, stop in slices(batch.column(1)):
                texts = batch.column(1).slice(start, stop - start).to_pylist()
                for lang in sorted(set(langs[start:stop])):
                    got = _counts([t for t, x in zip(texts, langs[start:stop], strict=True) if x == lang], size)
                    kept[lang] = kept.get(lang, 0) + got
        for lang, counts in kept.items():
            at = np.flatnonzero(counts)
            yield pa.record_batch(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["lang", "bucket", "n"]
            )

    counted = map_arrow(chosen, run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counted.column("lang").to_pylist()))
    counts = np.full((size, max(1, len(langs))), SMOOTH)
    if langs:
        place = np.array([langs.index(x) for x in counted.column("lang").to_pylist()])
        counts[counted.column("bucket").to_numpy(), place] += counted.column("n").to_numpy()
    by_length = counts.reshape(len(GRAMS), BUCKETS, -1)
    log_p = np.log(by_length / by_length.sum(1, keepdims=True)).reshape(size, -1)
    seen = counts - SMOOTH
    # each n-gram is foretold by all the others, so a small sample doesn't seem to fit better than texts that it lacks
    others = np.log(np.maximum(by_length - 1, SMOOTH) / (by_length.sum(1, keepdims=True) - 1)).reshape(size, -1)
    usual = (seen * others).sum(0) / np.maximum(seen.sum(0), 1)
    return Model(langs or [NONE], np.round(log_p * SCALE).astype(np.int32), usual)


def predict(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """`docs` with lang_pred and score (0 to 1), and given a third name, the fit (see fit_of); only the text is read for it. The matrix is a broadcast of fixed size.

    Columns that have those names already are replaced.

    Null texts and texts without a letter get `und` and 0; so does every text if nothing could be learned. Of languages
    that are equally likely the first by name is taken. Long texts are scored in parts whose sums are added up. Repeated
    rows, null ids and other columns stay as they are; an empty table gives an empty one.
    """
    docs = docs.drop(*names)
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            langs, scores, fits = [], [], []
            for start, stop in slices(batch.column(at), 1 << 19):
                texts = [t or "" for t in batch.column(at).slice(start, stop - start).to_pylist()]
                best, p, far = fit_of(texts, model)
                fits += far.tolist()
                langs += [NONE if b < 0 else model.langs[b] for b in best.tolist()]
                scores += [0.0 if model.langs == [NONE] else x for x in p.tolist()]
            yield pa.record_batch(
                [*batch.columns, pa.array(langs, pa.string()), *(pa.array(x, pa.float64()) for x in (scores, fits)[: len(names) - 1])],
                names=[*batch.schema.names, *names],
            )

    more = [T.StructField(names[0], T.StringType()), *(T.StructField(x, T.DoubleType()) for x in names[1:])]
    return map_arrow(docs, run, T.StructType([*docs.schema.fields, *more]))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of `documents`."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", is_held_out("doc_id").alias("held_out"), "text")
    return predict(rows, fit(docs)).drop("text")


#: Posterior below which the pipeline rejects a document's language. It is near 1 for almost any letters, as it only
#: compares the languages with each other; so there is a least fit, too: nats an n-gram may be less likely than usual.
LEAST_SCORE, LEAST_FIT = 0.5, -4.0


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is identified: not `und`, with a score of at least LEAST_SCORE and a fit of at least
    LEAST_FIT; columns as before. If nothing could be learned, no language can be ruled out, and all with a letter stay.

    A null text, an empty one and one without a letter go. Equal texts have equal scores, so repeated rows stay or go
    together; long texts are scored whole, in parts; an empty table gives an empty one.
    """
    names = ("_tessera_lang", "_tessera_score", "_tessera_fit")
    model = fit(docs)
    if model.langs == [NONE]:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    sure = (F.col(names[0]) != NONE) & (F.col(names[1]) >= LEAST_SCORE) & (F.col(names[2]) >= LEAST_FIT)
    return predict(docs, model, names=names).filter(sure).select(*docs.columns)
