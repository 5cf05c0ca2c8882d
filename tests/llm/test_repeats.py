"""Repeated passages against a set of all windows, and the run-length index against plain sorting."""

import hashlib
import random

import numpy as np
import pytest
from helpers import awkward, empty
from oracle import TESTDATA

from tessera.llm import repeats
from tessera.llm.repeats import Rule

SCHEMA = "doc_id long, text string"


def by_brute_force(rows, length=50):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of (doc_id, text) rows."""
    order = lambda d: repeats.LAST if d is None else d
    first = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, t in sorted(data, key=lambda x: order(x[0])):
        for i in range(len(t) - length + 1):
            first.setdefault(t[i : i + length], order(d))
    out = []
    for d, t in data:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < order(d):
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((d, len(t), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_given_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet").collect()]
    assert found(repeats.op11_repeats(spark, f"{TESTDATA}/sf0.001")) == by_brute_force(rows)


def passages(seed):
    """Texts that share passages of all lengths about the threshold, whole texts, and stretches of one letter."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(2, 6)))
    shared = [" ".join(word() for _ in range(30))[:k] for k in (30, 49, 50, 51, 60, 75, 120)]
    rows = []
    for d in range(120):
        parts = []
        for _ in range(rng.randint(1, 6)):
            parts.append(rng.choice(shared) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 25))))
        rows.append((rng.randint(0, 1000), rng.choice(["", " "]).join(parts)))
    rows += [(d, t) for d, (_, t) in zip(range(2000, 2040), rows, strict=False)]
    rows += [(5000 + k, "z" * (45 + 11 * k)) for k in range(12)] + [(6000, "ab" * 400), (6001, "ba" * 300), (6002, "x\0" * 90), (6003, "\0" * 200)]
    rows += [rows[3]] * 3 + [(None, rows[4][1]), (None, rows[4][1]), (None, "no other text has these words, " * 4), (None, None), (7000, ""), (7001, None)]
    return rows


@pytest.mark.parametrize("wide", [1 << 16, 2])
def test_passages(spark, wide, monkeypatch):
    if wide == 2:  # all shared anchors are wide, blocks are small, and nothing is broadcast
        for name, value in (("SAMPLE", 1), ("BLOCK", 4096), ("BROADCAST_BYTES", 0)):
            monkeypatch.setattr(repeats, name, value)
    rows = passages(wide)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert found(repeats.repeats(df, Rule(wide=wide))) == by_brute_force(rows)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 2000)
    rows = passages(7)
    assert found(repeats.repeats(spark.createDataFrame(rows, SCHEMA).repartition(3))) == by_brute_force(rows)


@pytest.mark.parametrize("wide", [False, True])
def test_segments_hold_each_window_once(monkeypatch, wide):
    monkeypatch.setattr(repeats, "PART", 256)
    repeats._powers.cache_clear()
    texts = [(t or "").encode() for _, t in passages(3)] + [None]
    known = np.zeros(0, np.uint64)
    if wide:
        known = np.unique(repeats._all_segments(texts, Rule(), known)[3])
    seen, anchor, digests = set(), {}, {}
    for row, start, n, h, d in zip(*(x.tolist() for x in repeats._all_segments(texts, Rule(), known)), strict=True):
        assert 1 <= n <= (1 if wide else repeats.SEGMENT)
        for i in range(start, start + n):
            assert (row, i) not in seen
            seen.add((row, i))
            assert anchor.setdefault(texts[row][i : i + 50], h) == h
        assert digests.setdefault((h, d), texts[row][start : start + n + 49]) == texts[row][start : start + n + 49]
    assert seen == {(r, i) for r, t in enumerate(texts) if t for i in range(len(t) - 49)}
    repeats._powers.cache_clear()


def test_awkward_and_empty_documents(spark):
    df = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert found(repeats.repeats(df)) == by_brute_force(rows)
    for r in repeats.repeats(df, whole=True).collect():
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]
        assert sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"] and len(r["spans"]) == r["n_spans"]
    assert repeats.repeats(empty(spark)).collect() == []
    assert repeats.repeats(empty(spark)).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_index_walks_back_as_sorting_does():
    rng = np.random.default_rng(5)
    segs = [rng.integers(97, 99, rng.integers(12, 40)).astype(np.uint8) for _ in range(60)]
    text, sizes = np.concatenate(segs), np.array([len(s) for s in segs])
    starts, docs = np.cumsum(sizes) - sizes, rng.integers(0, 30, len(segs))
    index = repeats.RunIndex(text, starts, docs, 12)
    data = text.tobytes()
    windows = {}
    for k, s in enumerate(starts):
        for i in range(sizes[k] - 11):
            w = data[s + i : s + i + 12]
            windows[w] = min(windows.get(w, repeats.LAST), docs[k])
    for k, s in enumerate(starts):
        context = index.entry[k : k + 1]
        for i in range(sizes[k] - 12, -1, -1):
            assert index.smallest[context[0]] == windows[data[s + i : s + i + 12]]
            if i:
                context = index.back(context, text[s + i - 1 : s + i].astype(np.int64))
    assert len(index.first) < len(text)  # runs, not rows
