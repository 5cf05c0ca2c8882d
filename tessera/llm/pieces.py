"""SentencePiece encoding and decoding by a streaming Viterbi search."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, slices
from tessera.llm.tokens import ready
from tessera.session import table

SPACE = "▁"
#: Chunks and pairs that a worker keeps, and the longest kept chunk; these only bound memory.
KEPT, KEPT_CHARS, PAIRS = 300_000, 40, 400_000
#: How many places the search goes on before it looks for a boundary to commit.
STRIDE = 64
#: Characters that are marked and cut into chunks at a time, and ids that are packed at a time.
SLICE, FLUSH = 1 << 16, 1 << 12
_CHUNKS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Lattice:
    """Segments text over a vocabulary of scored pieces, left to right, with a bounded window.

    For each place the search keeps one backpointer. In a unigram vocabulary it is that of the largest sum of
    scores. In a merge (BPE) vocabulary each prefix has exactly one segmentation that merging would give, and a
    segmentation is that one if and only if merging leaves each adjacent pair of its pieces as it is; so the
    backpointer is the one whose last two pieces are such a pair. All backpointers of the last `longest` places
    are followed back: up to the boundary where they meet nothing can change, and its pieces are committed.
    """

    def __init__(self, scores: dict[str, float], merges: bool) -> None:
        self.scores, self.merges = scores, merges
        self.longest = max(map(len, scores), default=1)
        self.lowest = min(scores.values(), default=0.0) - 10
        self.by_last: dict[str, dict[str, bool]] = {}  # pairs asked for before
        self.n_pairs = 0
        self.automaton = None
        if merges and scores:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for piece in scores:
                self.automaton.add_word(piece, piece)
            self.automaton.make_automaton()
        self.ends: dict = {}  # pieces spelled backwards, letter by letter; None holds (piece, score)
        for piece, score in scores.items():
            node = self.ends
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[None] = (piece, score)
        self.split: dict[str, tuple[str, str] | None] = {}
        self.known_regular: dict[str, bool] = {}

    def merged(self, text: str) -> list[str]:
        """Merges the best-scored adjacent pair, leftmost first, until none is a piece; for short texts."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge, the last one, makes `piece`; None for a character, or if it isn't made so.

        Asked only for regular pieces: each merge in them comes after those that made its halves.
        """
        if piece not in self.split:
            found: tuple[str, str] | None = None
            if len(piece) > 1:
                parts = list(piece)
                while len(parts) > 2:
                    best, at = None, -1
                    for k in range(len(parts) - 1):
                        whole = parts[k] + parts[k + 1]
                        score = self.scores.get(whole)
                        if score is not None and whole != piece and (best is None or score > best):
                            best, at = score, k
                    if best is None:
                        break
                    parts[at : at + 2] = [parts[at] + parts[at + 1]]
                if len(parts) == 2:
                    found = (parts[0], parts[1])
            self.split[piece] = found
        return self.split[piece]

    def regular(self, piece: str) -> bool:
        """Whether `piece` comes from merges of falling score, each after those of its halves."""
        got = self.known_regular.get(piece)
        if got is None:
            if len(piece) == 1:
                got = True
            else:
                both = self.halves(piece)
                got = both is not None and all(
                    self.regular(x) and (len(x) == 1 or self.scores[x] > self.scores[piece]) for x in both
                )
            self.known_regular[piece] = got
        return got

    def check(self, a: str, b: str) -> bool:
        if a and self.regular(a) and self.regular(b):
            return self._boundary_holds(a, b)
        return self.merged(a + b) == [p for p in (a, b) if p]

    def stays(self, a: str, b: str) -> bool:
        """Whether merging leaves the pieces a and b (a may be empty, at the start) as they are."""
        row = self.by_last.get(a)
        if row is None:
            if self.n_pairs > PAIRS:
                self.n_pairs = 0
                self.by_last.clear()
            row = self.by_last[a] = {}
        got = row.get(b)
        if got is None:
            self.n_pairs += 1
            got = row[b] = self.check(a, b)
        return got

    def _boundary_holds(self, a: str, b: str) -> bool:
        """Undoes the merges at the boundary of two regular pieces, latest first: at no time may a merge across
        it have been due before the one that was made. Of equal merges the one further left was made first."""
        scores = self.scores
        across = scores.get(a + b)
        if across is not None:
            return False
        while len(a) > 1 or len(b) > 1:
            if len(b) == 1 or (len(a) > 1 and scores[a] < scores[b]):
                limit, a = scores[a], self.split[a][1]
                across = scores.get(a + b)
                if across is not None and across > limit:
                    return False
            else:
                limit, b = scores[b], self.split[b][0]
                across = scores.get(a + b)
                if across is not None and across >= limit:
                    return False
        return True

    def stream(self, text: str) -> Iterator[str]:
        """The pieces in order, each as soon as it is certain; a character without a piece is a piece of its own."""
        return self._stream_merges(text) if self.merges else self._stream_sums(text)

    def _stream_merges(self, text: str) -> Iterator[str]:
        """The search under merges: `lasts` holds for each place of the window the piece that ends there, its backpointer."""
        if self.n_pairs > PAIRS:
            self.n_pairs = 0
            self.by_last.clear()
        pairs, check, window = self.by_last, self.check, 2 * STRIDE + self.longest
        base, end, limit = 0, 0, window  # places before `base` are certain, those up to `end` have their backpointer
        lasts = [""]  # of the places from `base` on
        for at, piece in self.automaton.iter(text):  # at each place the longest piece first
            if at < end:
                continue
            while at > end:  # a character without any piece
                lasts.append(text[end])
                end += 1
            begin = at + 1 - len(piece) - base
            if begin < 0:  # goes back beyond what is certain
                continue
            last = lasts[begin]
            try:
                ok = pairs[last][piece]
            except KeyError:
                self.n_pairs += 1
                ok = pairs.setdefault(last, {})[piece] = check(last, piece)
            if ok:
                lasts.append(piece)
                end += 1
                if end >= limit:
                    meet = self._meeting(lasts, end - base)
                    yield from self._path(lasts, meet)
                    del lasts[:meet]
                    base, limit = base + meet, end + window
        lasts += text[end:]
        yield from self._path(lasts, len(text) - base)

    def _meeting(self, lasts: list[str], done: int) -> int:
        """The last place through which the paths back from all places that a later piece may start at go."""
        alive = set(range(max(1, done - self.longest + 1), done + 1))
        while len(alive) > 1:  # the furthest goes a piece back until all meet
            far = max(alive)
            alive.discard(far)
            alive.add(far - len(lasts[far]))
        return alive.pop()

    @staticmethod
    def _path(lasts: list[str], at: int) -> list[str]:
        """The pieces on the path back from a place to the start of the window, in order."""
        out = []
        while at:
            out.append(lasts[at])
            at -= len(lasts[at])
        out.reverse()
        return out

    def _stream_sums(self, text: str) -> Iterator[str]:
        """The search for the largest sum of scores."""
        window = 2 * STRIDE + self.longest
        base, limit, lasts, sums = 0, window, [""], [0.0]
        for end in range(1, len(text) + 1):
            # all pieces that end here, shortest first; a character alone always counts as one
            top, piece, node, at = -float("inf"), "", self.ends, end
            while at > base:
                node = node.get(text[at - 1])
                if node is None:
                    break
                at -= 1
                if None in node and sums[at - base] + node[None][1] >= top:
                    top, piece = sums[at - base] + node[None][1], node[None][0]
            if text[end - 1] not in self.scores and sums[end - 1 - base] + self.lowest > top:
                top, piece = sums[end - 1 - base] + self.lowest, text[end - 1]
            lasts.append(piece)
            sums.append(top)
            if end >= limit:
                meet = self._meeting(lasts, end - base)
                yield from self._path(lasts, meet)
                base, limit, lasts, sums = base + meet, end + window, lasts[meet:], [x - sums[meet] for x in sums[meet:]]
        yield from self._path(lasts, len(text) - base)


class Encoder:
    """Ids of whole texts under a SentencePiece model file with the identity normaliser."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        if spec.normalizer_spec.precompiled_charsmap or spec.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models that keep the text as it is are supported")
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.vocab_size()
        self.pieces = [lib.id_to_piece(k) for k in range(size)]
        plain = [k for k in range(size) if not (lib.is_control(k) or lib.is_unknown(k) or lib.is_unused(k) or lib.is_byte(k))]
        self.ids = {self.pieces[k]: k for k in plain}
        self.byte_ids = {int(self.pieces[k][3:5], 16): k for k in range(size) if lib.is_byte(k)}
        self.byte_of = {k: b for b, k in self.byte_ids.items()}
        self.is_byte = np.isin(np.arange(size), list(self.byte_of))
        self.unknown, self.prefix = lib.unk_id(), spec.normalizer_spec.add_dummy_prefix
        self.text_of = ["" if lib.is_control(k) else " ⁇ " if k == self.unknown else self.pieces[k] for k in range(size)]
        self.lattice = Lattice({p: lib.get_score(k) for p, k in self.ids.items()}, spec.trainer_spec.model_type == 2)
        self.chunked = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the generation before

    def _chunk(self, chunk: str) -> Iterator[bytes]:
        """The ids of a chunk, as the search commits them."""
        stream = self.lattice.stream(chunk)
        while some := list(islice(stream, FLUSH)):
            out = list(map(self.ids.get, some))
            if None in out:
                out = [x for k, piece in zip(out, some, strict=True) for x in ((k,) if k is not None else self._without_piece(piece))]
            yield struct.pack(f"<{len(out)}I", *out)

    def _without_piece(self, text: str) -> list[int]:
        """Ids of a character that is no piece: its bytes, if the vocabulary has them."""
        return [self.byte_ids[b] for b in text.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]

    def _parts(self, text: str) -> Iterator[str]:
        """The text with its spaces marked, in parts of about SLICE characters that end where a boundary is certain."""
        at = 0
        while at < len(text):
            stop = at + SLICE
            if stop < len(text) and self.chunked:
                while stop < len(text) and not (text[stop] in (" ", SPACE) and text[stop - 1] not in (" ", SPACE)):
                    stop += 1
            else:
                stop = len(text)
            yield (SPACE if self.prefix and not at else "") + text[at:stop].replace(" ", SPACE)
            at = stop

    def encode_parts(self, text: str) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of `text`, in parts whose size doesn't grow with it.

        Where no piece goes on after a space sign, all paths of the search meet before one: what lies between two
        such places is searched alone, and its ids, once certain, are kept for the next time.
        """
        for part in self._parts(text):
            if not self.chunked:
                yield from self._chunk(part)
                continue
            chunks, kept, out = _CHUNKS.findall(part), self.kept, []
            try:
                yield b"".join(map(kept.__getitem__, chunks))
                continue
            except KeyError:
                pass
            for chunk in chunks:
                got = kept.get(chunk)
                if got is None:
                    got = self.older.get(chunk)
                    if got is None:
                        if len(chunk) > KEPT_CHARS:
                            yield b"".join(out)
                            out.clear()
                            yield from self._chunk(chunk)
                            continue
                        got = b"".join(self._chunk(chunk))
                    if len(kept) >= KEPT:
                        self.older, self.kept = kept, {}
                        kept = self.kept
                    kept[chunk] = got
                out.append(got)
            yield b"".join(out)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return b"".join(self.encode_parts(text))

    def decode_parts(self, parts: Iterable[bytes]) -> Iterator[str]:
        """The text of ids that come in parts: byte pieces are joined as UTF-8, control pieces are silent, the added space is taken off."""
        run, first = bytearray(), self.prefix
        for part in parts:
            ids, out, at = np.frombuffer(part, "<u4"), [], 0
            known = ids.tolist()
            for k in [*np.flatnonzero(self.is_byte[ids]).tolist(), len(known)]:
                if k > at:
                    if run:
                        out.append(run.decode("utf-8", "replace"))
                        run.clear()
                    out += map(self.text_of.__getitem__, known[at:k])
                if k < len(known):
                    run.append(self.byte_of[known[k]])
                at = k + 1
            if len(run) > FLUSH:  # all but a character that may still go on
                whole = len(run)
                while whole > len(run) - 4 and run[whole - 1] & 0xC0 == 0x80:
                    whole -= 1
                whole -= 1 if run[whole - 1] >= 0xC0 else 0
                out.append(bytes(run[:whole]).decode("utf-8", "replace"))
                del run[:whole]
            text = "".join(out).replace(SPACE, " ")
            if text:
                yield text[1:] if first and text.startswith(" ") else text
                first = False
        if run:
            yield run.decode("utf-8", "replace")

    def decode(self, ids: bytes) -> str:
        """The text of ids."""
        return "".join(self.decode_parts([ids]))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) for every row: ids as little-endian unsigned 32-bit bytes; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ready(Encoder, path)
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                ids = [encoder.encode(t or "") for t in batch.column(1).slice(start, stop - start).to_pylist()]
                yield pa.record_batch([batch.column(0).slice(start, stop - start), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return map_arrow(docs.select(F.col(id_col).cast("long"), text_col), run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) for rows (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ready(Encoder, path)
        for batch in batches:
            texts = [encoder.decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def there_and_back(encoder: Encoder, text: str) -> tuple[int, int, str, bool]:
    """The number of ids, their crc32, the sha256 of the decoded text and whether it equals `text`; part by part."""
    n, crc, digest, at, same = 0, 0, hashlib.sha256(), 0, True

    def ids() -> Iterator[bytes]:
        nonlocal n, crc
        held_, size = [], 0
        for part in encoder.encode_parts(text):
            held_.append(part)
            size += len(part)
            if size >= 4 * FLUSH:
                whole = b"".join(held_)
                n, crc = n + size // 4, zlib.crc32(whole, crc)
                held_, size = [], 0
                yield whole
        whole = b"".join(held_)
        n, crc = n + size // 4, zlib.crc32(whole, crc)
        yield whole

    for back in encoder.decode_parts(ids()):
        digest.update(back.encode("utf-8", "surrogatepass"))
        same = same and text.startswith(back, at)
        at += len(back)
    return n, crc, digest.hexdigest(), same and at == len(text)


def encode_and_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_sha256, round_trip for every row, in one pass over the texts.

    round_trip says whether the decoded text equals the text (a text that holds the space sign itself comes
    back with spaces, as with the library). Null text is empty; empty tables, repeated rows, null ids and extra
    columns are fine, whatever their names. Texts go through in parts: search window, ids and decoded text of a long
    text are never held as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ready(Encoder, path)
        for batch in batches:
            n, crc, sha, same = [], [], [], []
            for start, stop in slices(batch.column(1)):
                for text in batch.column(1).slice(start, stop - start).to_pylist():
                    row = there_and_back(encoder, text or "")
                    for column, value in zip((n, crc, sha, same), row, strict=True):
                        column.append(value)
            yield pa.record_batch(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())],
                names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"],
            )

    return map_arrow(
        docs.select(F.col(id_col).cast("long"), text_col), run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean"
    )


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents` encoded with piece_bpe_32k.model and decoded again."""
    import public_tokenizers

    return encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
