"""Tokenising whole texts with public vocabularies: counts, and ids as bytes."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import held, map_arrow, slices
from tessera.session import table

# The split patterns of the two vocabularies.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_SPLIT = re.compile(r"[^\W\d_]+|'(?:[stmd]|re|ve|ll)|\d|(?:[^\s\w]|_)+")

#: Characters on which the fast merger and the vocabulary's own library split and merge alike: printable
#: ASCII and the Latin-1 letters, which no normal form changes. Pieces with others go to the library.
PLAIN = re.compile(r"[ -~À-ÖØ-öø-ÿ]*")
#: A space after another character than those is no safe boundary.
UNSAFE_SPACE = re.compile(r"[^!-~À-ÖØ-öø-ÿ] ")
SAFE_BOUNDARY = re.compile(r"(?<=[!-~À-ÖØ-öø-ÿ])(?= )")
#: Pieces kept by a worker, and the longest kept piece; both only bound memory.
KEPT_PIECES, KEPT_CHARS = 200_000, 48


def byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable bytes as themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """Token counts of a byte-level BPE vocabulary (a tokenizers .json file), special strings as the library takes them.

    A text is split before each single space that follows a printable character: no token crosses such a
    boundary, so counts of pieces add up. Counts of short pieces are kept.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = byte_of_symbol()
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        self.fast = tiktoken.Encoding(path, pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = sorted(special)
        self.after_space: dict[str, int] = {}

    def by_library(self, piece: str) -> int:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return len(self.library.encode(piece, add_special_tokens=False).ids)

    def piece(self, piece: str) -> int:
        """Tokens of one piece that stands between safe boundaries."""
        if PLAIN.fullmatch(piece.replace("\n", "")) and not any(s in piece for s in self.special):
            return len(self.fast.encode_ordinary(piece))
        return self.by_library(piece)

    def count(self, text: str) -> int:
        if UNSAFE_SPACE.search(text):
            return sum(self.piece(p) for p in SAFE_BOUNDARY.split(text))
        first, *rest = text.split(" ")  # every space here follows a printable character, or opens the text
        kept = self.after_space
        try:
            total = sum(map(kept.__getitem__, rest))
        except KeyError:
            total = 0
            for word in rest:
                n = kept.get(word)
                if n is None:
                    n = self.piece(" " + word)
                    if len(word) <= KEPT_CHARS:
                        if len(kept) >= KEPT_PIECES:
                            kept.clear()
                        kept[word] = n
                total += n
        return total + (self.piece(first) if first else 0)


class WordBpe:
    """Ids of a word-level BPE vocabulary (lower case, white space dropped), as little-endian unsigned 32-bit bytes.

    White space only separates, so texts are split at spaces and line ends and ids of chunks are joined.
    The end-of-word sign becomes the byte 1, which no plain chunk holds; its merges come first, as in the vocabulary.
    """

    END = "\x01"

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte, end = byte_of_symbol(), spec["model"]["end_of_word_suffix"]
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {}
        for s, i in spec["model"]["vocab"].items():
            if s not in special:
                whole = s.endswith(end)
                ranks[bytes(byte[c] for c in (s[: -len(end)] if whole else s)) + self.END.encode() * whole] = i
        self.fast = tiktoken.Encoding(path, pat_str="[^\x01]*\x01", mergeable_ranks=ranks, special_tokens={})
        self.kept: dict[str, bytes] = {"": b""}

    def chunk(self, chunk: str) -> bytes:
        import numpy as np

        if PLAIN.fullmatch(chunk) and "<|" not in chunk:
            words = WORD_SPLIT.findall(chunk.lower())
            ids = self.fast.encode_ordinary(self.END.join(words) + self.END) if words else []
        else:
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
                self.library.no_truncation()
                self.library.no_padding()
            ids = self.library.encode(chunk, add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        chunks = text.replace("\n", " ").split(" ")
        kept = self.kept
        try:
            return b"".join(map(kept.__getitem__, chunks))
        except KeyError:
            out = []
            for chunk in chunks:
                got = kept.get(chunk)
                if got is None:
                    got = self.chunk(chunk)
                    if len(chunk) <= KEPT_CHARS:
                        if len(kept) >= KEPT_PIECES:
                            kept.clear()
                            kept[""] = b""
                        kept[chunk] = got
                out.append(got)
            return b"".join(out)


def ready(kind: type, path: str):
    """One encoder for a worker process, which later tasks use again."""
    kept = held(f"{kind.__name__} {path}")
    if "encoder" not in kept:
        kept["encoder"] = kind(path)
    return kept["encoder"]


def count_tokens(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; null text counts as empty.

    Only lengths leave the Arrow function; its batches are cut into runs of equal bytes, so one long text
    is a run of its own. Empty tables, repeated rows, null ids and extra columns need no special care.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ready(ByteBpe, path)
        for batch in batches:
            sizes, counts = [], []
            for start, stop in slices(batch.column(1)):
                for text in batch.column(1).slice(start, stop - start).to_pylist():
                    sizes.append(len(text.encode()) if text else 0)
                    counts.append(encoder.count(text) if text else 0)
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return map_arrow(docs.select(F.col(id_col).cast("long"), text_col), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


#: Tokens above which a document counts as over the limit in the registered query.
LIMIT = 1024


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all of `documents` under byte_bpe_50k.json."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), LIMIT)
