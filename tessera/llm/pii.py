"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what they miss."""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, slices
from tessera.session import table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)

# The contract's patterns. Where they start with an unbounded run, the run is anchored, so that a long run
# is read once; the matches are the same.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]")
_SPACE = re.compile(r"\s")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    """The check sum of card numbers: every second digit from the right doubled, the sum a multiple of ten."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """All matches of the fixed patterns, leftmost and non-overlapping per kind, in order of kind and start."""
    found: list[Span] = []
    if "@" in text:
        end, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            m = _DOMAIN.match(text, at) if start < at else None
            if m:
                end = m.end()
                found.append((0, start, end))
            at = text.find("@", max(at + 1, end))
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(int(p) <= 255 if len(p) < 20 else not p.strip("0")[3:] and int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split(".")):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def tokens_of(text: str) -> list[tuple[int, int]]:
    """White-space tokens that hold a digit or @, the only ones that can be labelled; each text part is read once."""
    out, end, m = [], 0, _MARK.search(text)
    while m:
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        stop = _SPACE.search(text, m.end())
        end = stop.start() if stop else len(text)
        out.append((start, end))
        m = _MARK.search(text, end)
    return out


_EDGE = " \t\n.,;:!?\"'<>[]{}"


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _check(digits: str) -> int:
    """0: no length of a card number, 1: a card number by its check sum, 2: of that length but no card number."""
    return 0 if not 13 <= len(digits) <= 19 else 1 if luhn(digits) else 2


def _parts(core: str) -> int:
    """0: not four numbers with points between, 1: four of at most 255, 2: four of which one is larger."""
    parts = core.split(".", 4)
    if len(parts) != 4 or not all(p and len(p) < 20 and p.isascii() and p.isdigit() for p in parts):
        return 0
    return 1 if all(int(p) <= 255 for p in parts) else 2


def features(token: str, near: bool, run: int = 0) -> tuple[int, ...]:
    """Indices of the token's features: all are shapes, none is a word, so the set is fixed (N_FEATURES).

    `run` is the check of all digits of the token and those beside it; it and the token's own checks keep apart what
    the fixed patterns match and then reject.
    """
    core = token.strip(_EDGE)
    digits, letters = _digits(core), sum(c.isalpha() for c in core)
    groups = len(re.findall(r"[0-9]+", core)) if len(core) <= 64 else 9
    return (
        0,
        1 + min(len(digits), 20),
        22 + min(letters, 5),
        28 + min(core.count("."), 4),
        33 + min(core.count("-"), 3),
        37 + ("@" in core) * 2 + ("." in core[core.find("@") + 1 :]),
        41 + core.startswith("+"),
        43 + (core[:1] == "(") + 2 * (core[-1:] == ")"),
        47 + min(groups, 5),
        53 + near,
        55 + ("=" in token) + 2 * ('"' in token),
        59 + _check(digits),
        62 + _parts(core),
        65 + run,
    )


N_FEATURES = 68


def key_of(token: str) -> str:
    """Tokens with the same key are repeats: equal digits, or without digits enough, equal lower-case text."""
    digits = _digits(token)
    return digits if len(digits) >= 4 else token.strip(_EDGE).lower()


def similar_keys(token: str) -> list[tuple]:
    """Tokens that share one of these keys are similar: addresses of one name or one domain, numbers with the same last
    seven digits, and numbers of 6 to 19 digits that differ in one."""
    core = token.strip(_EDGE).lower()
    name, at, domain = core.partition("@")
    if at:
        return [("name", name)] * bool(name) + [("domain", domain)] * bool(domain)
    digits = _digits(core)
    keys: list[tuple] = [("end", digits[-7:])] if len(digits) >= 7 else []
    if 6 <= len(digits) <= 19:
        keys += [(len(digits), k, digits[:k] + digits[k + 1 :]) for k in range(len(digits))]
    return keys


@dataclass
class Model:
    """Log potentials: unary (features x labels), chain, skip (repeats) and similar (labels x labels)."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    similar: np.ndarray


Edges = list[tuple[int, int]]


def graph(text: str, spans: list[tuple[int, int]]) -> tuple[list[tuple[int, ...]], Edges, Edges, Edges]:
    """Features of each node, chain edges (tokens with at most a space between), skip edges and similar edges.

    A skip edge joins a token with the last one of equal key before it, however far, a similar edge with the last one
    that is similar but no repeat; their number is linear in that of the tokens.
    """
    near = [k > 0 and spans[k][0] - spans[k - 1][1] <= 1 for k in range(len(spans))]
    runs, at = [0] * len(spans), 0
    while at < len(spans):
        stop = at + 1
        while stop < len(spans) and near[stop]:
            stop += 1
        check = _check(_digits(text[spans[at][0] : min(spans[stop - 1][1], spans[at][0] + 200)]))
        runs[at:stop] = [check] * (stop - at)
        at = stop
    nodes = [features(text[a:b], near[k] or (k + 1 < len(spans) and near[k + 1]), runs[k]) for k, (a, b) in enumerate(spans)]
    chain = [(k - 1, k) for k in range(len(spans)) if near[k]]
    seen: dict = {}
    skip, similar = [], []
    for k, (a, b) in enumerate(spans):
        key = key_of(text[a:b])
        last = seen.get(key)
        if last is not None and not (near[k] and last == k - 1):
            skip.append((last, k))
        seen[key] = k
        keys = similar_keys(text[a:b])
        like = max((j for j in map(seen.get, keys) if j is not None and j != last), default=None)
        if like is not None and not (near[k] and like == k - 1):
            similar.append((like, k))
        seen.update(dict.fromkeys(keys, k))
    return nodes, chain, skip, similar


def weak_labels(spans: list[tuple[int, int]], base: list[Span]) -> list[int]:
    """The label of each token by the base span that overlaps it, or 0."""
    out = [0] * len(spans)
    starts = [a for a, _ in spans]
    for kind, s, e in reversed(base):  # of several kinds the first wins
        k = max(0, bisect.bisect_right(starts, s) - 1)
        while k < len(spans) and spans[k][0] < e:
            if spans[k][1] > s:
                out[k] = 1 + kind
            k += 1
    return out


#: Added to each count of label pairs.
SMOOTH = 0.1


#: What learning needs of documents: how often each (unary: features, label; edges: the two labels) occurs.
Counts = dict[tuple[int, tuple[int, ...]], int]
_UNARY, _CHAIN, _SKIP, _SIMILAR = 0, 1, 2, 3


def counted(nodes: list, chain: Edges, skip: Edges, similar: Edges, labels: list[int], into: Counter) -> None:
    """Adds one document's counts; their number of keys doesn't grow with the length of the text."""
    into.update((_UNARY, (*f, y)) for f, y in zip(nodes, labels, strict=True))
    for what, edges in ((_CHAIN, chain), (_SKIP, skip), (_SIMILAR, similar)):
        into.update((what, (labels[i], labels[j])) for i, j in edges)


def train(examples: list[tuple[list, Edges, Edges, Edges, list[int]]], steps: int = 300) -> Model:
    """Learns from nodes, the three kinds of edges and weak labels of documents; see learn."""
    counts: Counter = Counter()
    for example in examples:
        counted(*example, counts)
    return learn(counts, steps)


def learn(counts: Counts, steps: int = 300) -> Model:
    """Piecewise training: softmax regression for the unary potentials, smoothed log odds for the edges.

    The odds of skip and similar edges are against the labels' frequency among all nodes, which the unary potentials
    hold already; those of chain edges against that among nodes with such an edge, which a feature tells.

    Without any example all potentials are zero, and nothing is ever added.
    """
    n = len(LABELS)
    rows = [(key, c) for (what, key), c in sorted(counts.items()) if what == _UNARY]  # the order of tasks has no say
    unary = np.zeros((N_FEATURES, n))
    if rows:
        width = len(rows[0][0]) - 1
        x = np.zeros((len(rows), N_FEATURES))
        x[np.repeat(np.arange(len(rows)), width), np.concatenate([key[:-1] for key, _ in rows])] = 1
        y = np.eye(n)[[key[-1] for key, _ in rows]]
        weight = np.array([c for _, c in rows], dtype=float)[:, None]
        weight /= weight.sum()
        for _ in range(steps):
            p = np.exp(x @ unary - (x @ unary).max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            unary -= 1.0 * (x.T @ (weight * (p - y)) + 1e-4 * unary)
    of_nodes = np.full(n, SMOOTH)
    for key, c in rows:
        of_nodes[key[-1]] += c
    of_nodes /= of_nodes.sum()
    pair = []
    for which in (_CHAIN, _SKIP, _SIMILAR):
        c = np.full((n, n), SMOOTH)
        for (what, key), times in counts.items():
            if what == which:
                c[key] += times
        c = c / c.sum()
        pair.append(np.clip(np.log(c / (np.outer(c.sum(1), c.sum(0)) if which == _CHAIN else np.outer(of_nodes, of_nodes))), -3, 3) if counts else np.zeros((n, n)))
    return Model(unary, *pair)


#: Change of a log message from which it is passed on.
STILL = 1e-4
#: Rounds without a smaller largest change after which messages count as swinging, and the least part of a change that is then still taken.
PATIENCE, LEAST_RATE = 100, 1 / 64


#: Digits of a card and a phone number, and of each part of a card number that white space divides.
CARD_DIGITS, PHONE_DIGITS, CARD_PART = (13, 19), (9, 15), 3
#: Log potential of a label for the tokens of a whole number of that kind, as large as an edge can have.
WHOLE = 3.0
_PLAIN = re.compile(r"[+(]?[0-9][0-9().-]*")

#: Kind, first and last token.
Window = tuple[int, int, int]


def whole_numbers(text: str, spans: list[tuple[int, int]], taken: list[int]) -> list[Window]:
    """Cards and phone numbers made of whole tokens that no base span touches, first to last, longest first.

    The patterns miss them where they read them together with what stands behind or before, and then fail the check.
    A window ends with its kind's most digits, so the work is linear in the text.
    """
    cores = []
    for (a, b), label in zip(spans, taken, strict=True):
        core = "" if label or b - a > 64 else text[a:b].strip(_EDGE)
        cores.append(core if _PLAIN.fullmatch(core) else "")
    out: list[Window] = []
    k = 0
    while k < len(spans):
        best = None
        if cores[k]:
            phone = cores[k][0] == "+"
            least, most = PHONE_DIGITS if phone else CARD_DIGITS
            start = spans[k][0] + text[spans[k][0] : spans[k][1]].find(cores[k])
            digits, j = "", k
            while j < len(spans) and cores[j] and (j == k or spans[j][0] - spans[j - 1][1] <= 1):
                more = _digits(cores[j])
                if not phone and len(more) < CARD_PART or len(digits) + len(more) > most:
                    break
                digits += more
                end = spans[j][0] + text[spans[j][0] : spans[j][1]].find(cores[j]) + len(cores[j])
                if len(digits) >= least and (_PHONE if phone else _CARD).fullmatch(text, start, end) and (phone or luhn(digits)):
                    best = (3 if phone else 2, k, j)
                j += 1
        if best:
            out.append(best)
        k = best[2] + 1 if best else k + 1
    return out


def marginals(nodes: list[tuple[int, ...]], chain: Edges, skip: Edges, similar: Edges, clamped: list[int], model: Model, rounds: int | None = None, wholes: list[Window] | None = None) -> np.ndarray:
    """Label marginals by loopy sum-product message passing; tokens in base spans are clamped to their label, those of
    whole numbers lean to theirs.

    Messages are passed until none changes any more (or for `rounds`), however long the chains; a round only
    works on those that may still change. Half of each change is taken. Where messages swing in a loop and don't
    settle, ever smaller parts of it are taken, and in the end they are left as they are.
    """
    own = np.array([model.unary[list(f)].sum(0) for f in nodes])
    for k, label in enumerate(clamped):
        if label:
            own[k] = np.where(np.arange(len(LABELS)) == label, 0.0, -30.0)
    for kind, first, last in wholes or ():
        own[first : last + 1, 1 + kind] += WHOLE
    edges = [*chain, *skip, *similar]
    if edges:
        a, half = np.array(edges), len(edges)
        frm, to = np.concatenate([a[:, 0], a[:, 1]]), np.concatenate([a[:, 1], a[:, 0]])
        pots = np.stack([model.chain, model.skip, model.similar, model.chain.T, model.skip.T, model.similar.T])
        kinds = np.repeat([0, 1, 2], [len(chain), len(skip), len(similar)])
        pot = np.concatenate([kinds, kinds + 3])
        back = np.r_[np.arange(half, 2 * half), np.arange(half)]
        msg = np.zeros((2 * half, len(LABELS)))
        total, at = own.copy(), np.arange(2 * half)
        rate, least, since, done = 0.5, np.inf, 0, 0
        while len(at) and rate >= LEAST_RATE and (rounds is None or done < rounds):
            inner = (total[frm[at]] - msg[back[at]])[:, :, None] + pots[pot[at]]
            top = inner.max(1)
            new = top + np.log(np.exp(inner - top[:, None]).sum(1))
            new -= new.max(1, keepdims=True)
            change = new - msg[at]
            size = np.abs(change).max(1)
            moved = at[size >= STILL]
            msg[at] += rate * change
            np.add.at(total, to[at], rate * change)
            touched = np.zeros(len(own), bool)
            touched[to[moved]] = True
            again = touched[frm]
            again[moved] = True
            at, done, since = np.flatnonzero(again), done + 1, since + 1
            if size.max() < 0.99 * least:
                least, since = size.max(), 0
            elif since >= PATIENCE:
                rate, since = rate / 2, 0
        own = own.copy()
        np.add.at(own, to, msg)
    p = np.exp(own - own.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


#: Marginal from which a token's label is taken.
SURE = 0.6


def all_spans(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """Base spans, and base spans plus those that the field adds, each in order of kind and start.

    A whole number is added with all its tokens or not at all; other tokens that follow each other with one label are
    one span while their digits can be those of one number.
    """
    base = base_spans(text)
    spans = tokens_of(text)
    if not spans:
        return base, base
    labels = weak_labels(spans, base)
    if all(labels):
        return base, base
    wholes = whole_numbers(text, spans, labels)
    p = marginals(*graph(text, spans), labels, model, wholes=wholes)
    added: list[list[int]] = []
    cores = {k: text[a:b].strip(_EDGE) for k, (a, b) in enumerate(spans) if not labels[k]}
    starts = {k: spans[k][0] + text[slice(*spans[k])].find(core) for k, core in cores.items()}
    inside = set()
    for kind, first, last in wholes:
        inside.update(range(first, last + 1))
        if p[first : last + 1, 1 + kind].mean() >= SURE:
            added.append([kind, starts[first], starts[last] + len(cores[last])])
    most = {2: CARD_DIGITS[1], 3: PHONE_DIGITS[1]}
    open_, held = None, 0  # the span that may go on, and its digits
    for k, core in cores.items():
        kind = int(p[k].argmax()) - 1
        if k in inside or not core or kind < 0 or p[k].max() < SURE:
            continue
        start, more = starts[k], len(_digits(core)) if kind in most else 0
        if open_ and open_[0] == kind in most and start - open_[2] <= 1 and held + more <= most[kind]:
            open_[2], held = start + len(core), held + more  # parts of one number
        else:
            open_, held = [kind, start, start + len(core)], more
            added.append(open_)
    return base, sorted({*base, *map(tuple, added)})


#: Documents that the field learns from, about: those whose id and text hash into a share of the table.
TRAIN_DOCS = 4000


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = TRAIN_DOCS) -> Model:
    """Learns the field from about `bound` documents, whole texts labelled by their base spans.

    A document counts if its id and text hash into a share of the table; rows that repeat both count together.
    Only counts leave the executors, so nothing that arrives grows with the number or length of the documents.
    """
    share = max(1, docs.count() // bound)
    some = docs.filter(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("train"), F.col(text_col)), F.lit(share)) == 0).select(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                spans = tokens_of(text or "")
                if spans:
                    counted(*graph(text, spans), weak_labels(spans, base_spans(text)), counts)
        yield pa.RecordBatch.from_pylist([{"what": what, "key": list(key), "n": n} for (what, key), n in counts.items()], schema=kind)

    kind = pa.schema([("what", pa.int32()), ("key", pa.list_(pa.int64())), ("n", pa.int64())])
    got = map_arrow(some, run, "what int, key array<long>, n long").groupBy("what", "key").agg(F.sum("n").alias("n")).toArrow().to_pylist()
    return learn({(r["what"], tuple(r["key"])): r["n"] for r in got})


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """doc_id, counts per kind of the base spans, base_sha256 and spans (base and added) for every row.

    Null text counts as empty and has no spans; whole texts are searched in linear time; repeated rows, null
    ids and extra columns are fine; an empty table gives an empty result.
    """
    model = model or fit(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, texts = [], [], []
            for start, stop in slices(batch.column(1)):
                for text in batch.column(1).slice(start, stop - start).to_pylist():
                    base, every = all_spans(text or "", model)
                    counts.append([sum(s[0] == k for s in base) for k in range(4)])
                    digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    texts.append(joined(every))
            by_kind = zip(*counts, strict=True) if counts else [[]] * 4
            yield pa.record_batch(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in by_kind), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    return map_arrow(
        docs.select(F.col(id_col).cast("long"), text_col), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )


def redacted(text: str, spans: list[Span]) -> str:
    """`text` with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """`docs` with personal data replaced in the text, and the length column, if there, brought up to date.

    A null text stays null (so does its length), an empty one empty; repeated rows, null ids and other columns, whatever
    their names, stay as they are; whole texts are searched in linear time; an empty table gives an empty one.
    """
    model = fit(docs, id_col, text_col)
    at = docs.columns.index(text_col)
    n_at = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(at)):
                part = batch.slice(start, stop - start)
                texts = [t if t is None else redacted(t, all_spans(t, model)[1]) for t in part.column(at).to_pylist()]
                columns = list(part.columns)
                columns[at] = pa.array(texts, pa.string())
                if n_at is not None:
                    columns[n_at] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
                yield pa.record_batch(columns, names=batch.schema.names)

    changed = docs if n_at is None else docs.withColumn(length_col, F.col(length_col).cast("long"))
    return map_arrow(changed, run, changed.schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text of `documents`."""
    return find_pii(table(spark, sf_dir, "documents"))
