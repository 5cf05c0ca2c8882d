"""Best-fit packing with certified bin counts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, map_arrow, map_groups, slices
from tessera.llm.tokens import WordBpe, ready
from tessera.session import table

#: Pieces that one part holds, about.
PIECES_PER_PART = 4_000
#: Bins that a certified part gives up at most (an eighth of its bins, if that is less): the emptiest.
RELEASED = 16
#: The id that ends each document.
END_ID = 1

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", row long, bin long, offset long, certified boolean, loose boolean, part long"


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """The largest bin count that dual feasible functions prove for integer lengths from 1 to `size`.

    Covers the identity (total length), the step function at each threshold t <= size / 2 (lengths above
    size - t count as a whole bin, those below t as nothing) and the rounding functions
    u_k(x) = x if (k + 1) x is whole, else floor((k + 1) x) / k, for k up to 40.
    """
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    x = np.arange(size + 1, dtype=np.int64)
    weight, count = np.concatenate([[0], np.cumsum(n * x)]), np.concatenate([[0], np.cumsum(n)])
    t = np.arange(1, size // 2 + 1)
    whole = count[size + 1] - count[size - t + 1]
    steps = whole + -(-(weight[size - t + 1] - weight[t]) // size)
    best = max(-(-int(weight[-1]) // size), int(steps.max(initial=0)))
    for k in range(1, 41):
        scaled = (k + 1) * x
        u = np.where(scaled % size == 0, x * k, (scaled // size) * size)  # u_k times k * size
        best = max(best, -(-int((n * u).sum()) // (k * size)))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, and the number of bins: longest first, into the fullest bin with room."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]  # by room left
    has = bytearray(size + 1)
    used = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        room = has.find(1, need)
        if room < 0:
            room, at, used = size, used, used + 1
        else:
            at = open_bins[room].pop()
            if not open_bins[room]:
                has[room] = 0
        bins[i], offsets[i] = at, size - room
        left = room - need
        if left:
            open_bins[left].append(at)
            has[left] = 1
    return bins, offsets, used


def cut_into_pieces(docs: DataFrame, tokenizer_path: str, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each document's ids, the end id included; only documents over `size` ids are cut.

    A null or empty text is its end id alone; repeated rows and null ids are documents like others; whole texts count,
    however long; only the two named columns are read, so others may have any names; an empty table gives no piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ready(WordBpe, tokenizer_path)
        end = np.asarray([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for start, stop in slices(batch.column(1)):
                for k, text in enumerate(batch.column(1).slice(start, stop - start).to_pylist(), start):
                    whole = encoder.ids(text or "") + end
                    for piece, at in enumerate(range(0, len(whole) // 4, size)):
                        part = whole[4 * at : 4 * (at + size)]
                        rows.append((ids[k], piece, at, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(docs.select(F.col(id_col).cast("long"), text_col), run, PIECES)


def settle(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Packs one part: bin, offset and whether the bin is given up for each length, and whether the bound certifies the count.

    A certified part gives up its emptiest few bins. A part with a gap between its count and the bound gives up the
    emptier half of its bins, but no full one.
    """
    bins, offsets, used = best_fit_decreasing(lengths, size)
    fill = np.bincount(bins, weights=lengths, minlength=used)
    certified = used == lower_bound(lengths, size)
    loose = np.argsort(fill, kind="stable")[: max(1, min(RELEASED, used // 8) if certified else used // 2)]
    return bins, offsets, np.isin(bins, loose[fill[loose] < size]), certified


def pack(pieces: DataFrame, size: int, per_part: int = PIECES_PER_PART) -> DataFrame:
    """Adds sequence_id, offset and certified to rows (doc_id, piece, start, length, ids_crc32).

    Pieces are numbered and written, and dealt by a hash of their number, so no null or repeated id makes a large part,
    into parts of about `per_part`; each part packs by best-fit decreasing, and
    dual feasible functions certify its bin count. Certified parts keep their bins but for the emptiest few; parts
    with gaps give up the emptier half of theirs. What was given up is exchanged (dealt anew, into fewer parts of the
    same size) and packed again, until one part holds the rest; so the bins in question halve at least from round to
    round. Each round is written to the shared folder. `certified` says whether the part that made the sequence met its
    bound.

    Rows that are repeated or have a null doc_id are packed like others; pieces of equal length are ties, which may go
    either way; other columns, whatever their names, are left out; an empty table gives an empty result.
    """

    def run(key: tuple, t: pa.Table) -> pa.Table:
        bins, offsets, loose, certified = settle(t.column("length").to_numpy(), size)
        out = t.select([*columns, "row"])
        more = (("bin", bins), ("offset", offsets), ("certified", np.full(len(bins), certified)), ("loose", loose), ("part", np.full(len(bins), key[0].as_py())))
        for name, column in more:
            out = out.append_column(name, pa.array(column))
        return out

    columns = [c.split()[0] for c in PIECES.split(", ")]
    rest = cut(pieces.select(*columns, F.monotonically_increasing_id().alias("row")))
    done, level = [], 0
    parts = max(1, -(-rest.count() // per_part))
    while True:
        # the level is hashed too, so parts exchange their documents
        part = F.pmod(F.xxhash64("row", F.lit(level)), F.lit(parts)).alias("part")
        packed = cut(map_groups(rest.select(*columns, "row", part), ["part"], run, PACKED))
        # a sequence's number: level, part, bin
        number = F.lit(level << 56) + F.shiftleft(F.col("part"), 28) + F.col("bin")
        stays = F.lit(True) if parts == 1 else ~F.col("loose")
        done.append(packed.filter(stays).select(*columns, number.alias("sequence_id"), "offset", "certified"))
        if parts == 1:
            break
        rest, level = packed.filter(~stays), level + 1
        parts = max(1, min(-(-rest.count() // per_part), -(-parts // 2)))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


#: Tokens of a sequence in the registered query.
SEQUENCE = 4096


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents` in sequences of at most 4096 ids of word_bpe_49k.json; null text is empty (one end id)."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return pack(cut_into_pieces(table(spark, sf_dir, "documents"), path, SEQUENCE), SEQUENCE)
