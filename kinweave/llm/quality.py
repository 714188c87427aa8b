"""Document quality by a linear-chain conditional random field over lines.

Every line of a text is a position of the chain and is labelled good (1) or
bad (0).  A line's evidence is its own shape features and those of the lines
before and after it.  Forward-backward gives each line's marginal probability
of being good; their mean weighted by line length is the document's quality, which
a logistic curve fitted on the learning documents turns into a probability.

Defined results: a null text counts as the empty text, which is one empty
line; copies score alike, as only the text enters a score; columns other than
those named are ignored.  Without labelled rows of both kinds the model has no
evidence and every score is the share of good labels (0.5 without labels).

Learning reads at most ``max_train_docs`` labelled documents (those with the
smallest hashes of their ids), of these only texts of up to ``max_doc_lines``
lines, and in all ``max_lines`` lines, which bounds what reaches the driver.
Scoring reads every line of every document.  Long texts pass in blocks: a stretch
of the chain is a product of 2 x 2 matrices, so forward and backward messages at
the blocks' ends come first, and memory holds a number for each line.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, cut, map_batches, sample_ids, texts

#: Classes of bytes that a line's shape is told from.
_LOWER, _UPPER, _DIGIT, _SPACE, _BANG, _PIPE, _MARK, _ODD, _HIGH, _REST = range(10)
_N_CLASSES = 10


def _byte_classes() -> np.ndarray:
    out = np.full(256, _REST, dtype=np.int64)
    out[ord("a") : ord("z") + 1] = _LOWER
    out[ord("A") : ord("Z") + 1] = _UPPER
    out[ord("0") : ord("9") + 1] = _DIGIT
    out[[9, 11, 12, 13, 32]] = _SPACE
    out[ord("!")] = _BANG
    out[ord("|")] = _PIPE
    out[[ord(c) for c in ".,;:?'\"()-"]] = _MARK
    out[[ord(c) for c in "#$%&*@^~<>=\\_{}[]+`/"]] = _ODD
    out[128:] = _HIGH
    return out


_CLASS = _byte_classes()
_N_OWN = _N_CLASSES + 13
#: Own features, those of both neighbours, first line, last line, constant.
N_FEATURES = 3 * _N_OWN + 3


def _own(kinds: np.ndarray, size: np.ndarray, again: np.ndarray, doubled: np.ndarray, varied: np.ndarray) -> np.ndarray:
    """A line's own features from its bytes by class, its size, and whether it and its words repeat."""
    share = kinds / np.maximum(size, 1)[:, None].astype(np.float32)
    own = np.empty((len(size), _N_OWN), dtype=np.float32)
    own[:, :_N_CLASSES] = share
    own[:, _N_CLASSES] = np.log1p(size) / 8
    own[:, _N_CLASSES + 1] = np.minimum(size / (kinds[:, _SPACE] + 1), 40) / 10
    own[:, _N_CLASSES + 2] = again
    own[:, _N_CLASSES + 3] = share[:, _UPPER] > 0.4
    own[:, _N_CLASSES + 4] = share[:, _ODD] > 0.06
    own[:, _N_CLASSES + 5] = share[:, _PIPE] > 0.02
    own[:, _N_CLASSES + 6] = share[:, _BANG] > 0.03
    own[:, _N_CLASSES + 7] = share[:, _DIGIT] > 0.2
    own[:, _N_CLASSES + 8] = size == 0
    own[:, _N_CLASSES + 9] = doubled
    own[:, _N_CLASSES + 10] = doubled > 0.2
    own[:, _N_CLASSES + 11] = varied
    own[:, _N_CLASSES + 12] = varied < 0.3
    return own


def _kinds(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes by class and size of each line; every line of ``block`` ends with a line end."""
    ends = np.flatnonzero(block == 10)
    n = len(ends)
    size = np.diff(ends, prepend=-1) - 1
    line_of = np.repeat(np.arange(n, dtype=np.int64) * _N_CLASSES, size + 1)
    kinds = np.bincount(line_of + _CLASS[block], minlength=n * _N_CLASSES).reshape(n, _N_CLASSES).astype(np.float32)
    kinds[:, _REST] -= 1  # the line end itself
    return kinds, size


def line_features(docs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of ``docs``: (lines x features, line bytes, lines of each document)."""
    raw = [d.encode("utf-8", "surrogatepass") for d in docs]
    counts = np.array([r.count(b"\n") + 1 for r in raw], dtype=np.int64)
    kinds, size = _kinds(np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8))
    n = len(size)

    again = np.zeros(n, dtype=np.float32)
    doubled = np.zeros(n, dtype=np.float32)
    varied = np.ones(n, dtype=np.float32)
    at = 0
    for r, k in zip(raw, counts):
        seen: dict[bytes, int] = {}
        for i, line in enumerate(r.split(b"\n"), at):
            if line and seen.setdefault(line, i) != i:
                again[i] = again[seen[line]] = 1.0
            words = line.split()
            if len(words) > 1:
                doubled[i] = sum(map(eq, words, words[1:])) / (len(words) - 1)
                varied[i] = len(set(words)) / len(words)
        at += int(k)

    own = _own(kinds, size, again, doubled, varied)
    first = np.zeros(n, dtype=bool)
    first[np.cumsum(counts) - counts] = True
    last = np.zeros(n, dtype=bool)
    last[np.cumsum(counts) - 1] = True
    x = np.zeros((n, N_FEATURES), dtype=np.float32)
    x[:, :_N_OWN] = own
    x[1:, _N_OWN : 2 * _N_OWN] = own[:-1]
    x[first, _N_OWN : 2 * _N_OWN] = 0
    x[:-1, 2 * _N_OWN : 3 * _N_OWN] = own[1:]
    x[last, 2 * _N_OWN : 3 * _N_OWN] = 0
    x[:, -3], x[:, -2], x[:, -1] = first, last, 1
    return x, size, counts


def _line_blocks(raw: bytes, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of whole lines, their line ends included, of about ``most`` bytes; a longer line is a range of its own."""
    at, n = 0, len(raw)
    while at <= n:
        end = raw.rfind(b"\n", at, min(n, at + most)) + 1
        if end <= at:
            end = raw.find(b"\n", at) + 1 or n + 1
        yield at, end
        at = end


def _long_line(raw: bytes, at: int, end: int, step: int = 1 << 20) -> tuple[np.ndarray, float, float]:
    """Bytes by class, share of doubled words and of different words of one line, read a piece at a time."""
    kinds = np.zeros(256, dtype=np.int64)
    hashes, rest = [], b""
    for a in range(at, end, step):
        part = raw[a : min(end, a + step)]
        kinds += np.bincount(np.frombuffer(part, dtype=np.uint8), minlength=256)
        words = (rest + part).split()
        rest = words.pop() if words and not part[-1:].isspace() else b""
        hashes.append(np.fromiter(map(hash, words), dtype=np.int64, count=len(words)))
    if rest:
        hashes.append(np.array([hash(rest)], dtype=np.int64))
    h = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.int64)
    by_class = np.bincount(_CLASS, kinds, _N_CLASSES).astype(np.float32)
    if len(h) < 2:
        return by_class, 0.0, 1.0
    return by_class, float((h[1:] == h[:-1]).sum()) / (len(h) - 1), len(np.unique(h)) / len(h)


def long_emission(raw: bytes, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Evidence and size of each line of one long text; the lines pass in blocks."""
    # lines that occur again, by their hashes
    kept: list[np.ndarray] = []
    repeats: list[np.ndarray] = []

    def merge() -> None:
        u, c = np.unique(np.concatenate(kept), return_counts=True) if kept else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        repeats.append(u[c > 1])
        kept[:] = [u]

    for a, z in _line_blocks(raw):
        u, c = np.unique(np.fromiter((hash(x) for x in raw[a:z].removesuffix(b"\n").split(b"\n") if x), dtype=np.int64), return_counts=True)
        repeats.append(u[c > 1])
        kept.append(u)
        if sum(map(len, kept[1:])) > 2_000_000:
            merge()
    merge()
    twice = np.unique(np.concatenate(repeats))
    del kept, repeats
    w = weights.astype(np.float32)
    es, sizes, tail = [], [], np.float32(0)
    for a, z in _line_blocks(raw):
        body = raw[a:z].removesuffix(b"\n")
        lines = body.split(b"\n")
        doubled, varied = np.zeros(len(lines), dtype=np.float32), np.ones(len(lines), dtype=np.float32)
        if len(body) > 1 << 18:
            by_class, d, v = _long_line(raw, a, a + len(body))
            kinds, size, doubled[0], varied[0] = by_class[None], np.array([len(body)]), d, v
        else:
            kinds, size = _kinds(np.frombuffer(body + b"\n", dtype=np.uint8))
            for i, line in enumerate(lines):
                if len(line) > 1 and len(words := line.split()) > 1:
                    doubled[i] = sum(map(eq, words, words[1:])) / (len(words) - 1)
                    varied[i] = len(set(words)) / len(words)
        again = np.isin(np.fromiter(map(hash, lines), dtype=np.int64, count=len(lines)), twice) & (size > 0)
        own = _own(kinds, size, again, doubled, varied)
        e = own @ w[:_N_OWN] + w[-1]
        left, right = own @ w[_N_OWN : 2 * _N_OWN], own @ w[2 * _N_OWN : 3 * _N_OWN]
        e[1:] += left[:-1]
        e[:-1] += right[1:]
        if es:
            e[0] += tail
            es[-1][-1] += right[0]
        tail = left[-1]
        es.append(e)
        sizes.append(size.astype(np.int32))
    es[0][0] += w[-3]
    es[-1][-1] += w[-2]
    return np.concatenate(es), np.concatenate(sizes)


def long_mean(emission: np.ndarray, size: np.ndarray, pairs: np.ndarray, segment: int = 1 << 19) -> float:
    """Length-weighted mean of the marginals of one chain, a segment at a time."""
    move = np.exp(pairs)
    cuts = list(range(0, len(emission), segment))
    q = []
    for a in cuts:
        psi = _forces(emission[a : a + segment])
        begin = np.arange(0, len(psi), 1024)
        parts = transfer(psi, begin, np.minimum(1024, len(psi) - begin), move)
        whole = parts[0]
        for m in parts[1:]:
            whole = whole @ move @ m
            whole = whole / whole.sum()
        q.append(whole)
    left, right = _messages(np.array(q), np.array([False] + [True] * (len(q) - 1)), move, _HALF, _ONE)
    total = weight = 0.0
    for j, a in enumerate(cuts):
        part = emission[a : a + segment]
        w = size[a : a + segment] + 1.0
        total += float(marginals(part, np.array([len(part)]), pairs, before=left[j], after=right[j]) @ w)
        weight += float(w.sum())
    return total / weight


@dataclass
class Crf:
    """Weights of the features for label 1 (label 0 weighs 0) and of label pairs."""

    weights: np.ndarray
    pairs: np.ndarray
    prior: float = 0.5
    learned: bool = True
    #: Of the logistic curve from a document's weighted mean to its probability.
    curve: tuple[float, float] = (1.0, 0.0)


def _forces(emission: np.ndarray) -> np.ndarray:
    psi = np.empty((len(emission), 2))
    e = np.clip(emission, -30, 30)
    np.exp(e / 2, out=psi[:, 1])
    np.divide(1.0, psi[:, 1], out=psi[:, 0])
    return psi


def transfer(psi: np.ndarray, begin: np.ndarray, length: np.ndarray, move: np.ndarray) -> np.ndarray:
    """What each stretch does to a message, as 2 x 2 matrices up to a factor: from before its first position to its last."""
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    q = psi[begin][:, None, :] * np.eye(2)[None]
    for t in range(1, int(length[0]) if len(length) else 0):
        k = int(np.searchsorted(-length, -t, side="left"))
        one = (q[:k] @ move) * psi[begin[:k] + t][:, None, :]
        q[:k] = one / one.sum(axis=(1, 2), keepdims=True)
    out = np.empty_like(q)
    out[order] = q
    return out


def _messages(q: np.ndarray, joined: np.ndarray, move: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Messages that enter each stretch from the left and from the right; ``joined`` stretches go on from the one before."""
    left, right = np.tile(before, (len(q), 1)), np.tile(after, (len(q), 1))
    for j in range(1, len(q)):
        if joined[j]:
            m = left[j - 1] @ q[j - 1] @ move
            left[j] = m / m.sum()
    for j in range(len(q) - 2, -1, -1):
        if joined[j + 1]:
            m = move @ (q[j + 1] @ right[j + 1])
            right[j] = m / m.sum()
    return left, right


_HALF, _ONE = np.full(2, 0.5), np.ones(2)


def marginals(emission: np.ndarray, counts: np.ndarray, pairs: np.ndarray, expected: bool = False, before: np.ndarray = _HALF, after: np.ndarray = _ONE, piece: int = 1024):
    """Forward-backward over chains laid end to end.

    Returns each position's probability of label 1 and, if asked, the expected
    number of each label pair.  Chains run side by side, longest first, so that
    step t touches just the chains with more than t positions; chains of more
    than two pieces are cut into pieces, which run side by side as well.
    """
    begin, length = np.cumsum(counts) - counts, counts
    psi, move = _forces(emission), np.exp(pairs)
    longest = int(counts.max(initial=0))
    left, right, joined = np.tile(before, (len(counts), 1)), np.tile(after, (len(counts), 1)), np.zeros(len(counts), dtype=bool)
    if longest > 2 * piece:
        n = np.where(counts > 2 * piece, -(-counts // piece), 1)
        chain = np.repeat(np.arange(len(counts)), n)
        nth = np.arange(len(chain)) - np.repeat(np.cumsum(n) - n, n)
        begin = begin[chain] + nth * piece
        length = np.where(n[chain] > 1, np.minimum(piece, counts[chain] - nth * piece), counts[chain])
        joined = nth > 0
        left, right = _messages(transfer(psi, begin, length, move), joined, move, before, after)
        longest = int(length.max())
    order = np.argsort(-length, kind="stable")
    begin, length, left, right = begin[order], length[order], left[order], right[order]
    active = np.searchsorted(-length, -np.arange(longest), side="left")  # stretches with more than t positions
    alpha = np.empty_like(psi)
    a = left
    for t in range(longest):
        k = int(active[t])
        at = begin[:k] + t
        a = (a[:k] if t == 0 else a[:k] @ move) * psi[at]
        a /= a.sum(axis=1, keepdims=True)
        alpha[at] = a
    both = np.zeros((2, 2))
    p = np.empty(len(psi))
    b = right.copy()
    ends = begin + length - 1
    g = alpha[ends] * b
    p[ends] = g[:, 1] / g.sum(axis=1)
    for t in range(longest - 1, 0, -1):
        k = int(active[t])
        at = begin[:k] + t
        force = psi[at] * b[:k]
        was = alpha[at - 1]
        if expected:
            xi = was[:, :, None] * move[None] * force[:, None, :]
            xi /= xi.sum(axis=(1, 2), keepdims=True)
            both += xi.sum(axis=0)
        nb = force @ move.T
        nb /= nb.sum(axis=1, keepdims=True)
        b[:k] = nb
        g = was * nb
        p[at - 1] = g[:, 1] / g.sum(axis=1)
    if expected and joined.any():
        # between pieces
        on = joined[order]
        at = begin[on]
        xi = alpha[at - 1][:, :, None] * move[None] * (psi[at] * b[on])[:, None, :]
        both += (xi / xi.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return (p, both) if expected else p


def fit(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, sizes: np.ndarray | None = None, rounds: int = 120, rate: float = 0.08, decay: float = 1e-4) -> Crf:
    """Maximise the conditional likelihood of the line labels by Adam; a line has its document's label."""
    prior = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or labels.min() == labels.max():
        return Crf(np.zeros(N_FEATURES), np.zeros((2, 2)), prior, learned=False)
    y = np.repeat(labels, counts).astype(np.float64)
    same = np.repeat(labels, np.maximum(counts - 1, 0))
    seen = np.diag([float((same == 0).sum()), float((same == 1).sum())])
    w, pairs = np.zeros(N_FEATURES), np.zeros((2, 2))
    m, v = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
    for i in range(1, rounds + 1):
        p, both = marginals(x @ w, counts, pairs, expected=True)
        grad = np.concatenate((x.T @ (y - p), (seen - both).ravel())) / len(y) - decay * np.concatenate((w, pairs.ravel()))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        w, pairs = w + step[:N_FEATURES], pairs + step[N_FEATURES:].reshape(2, 2)
    model = Crf(w, pairs, prior)
    weight = np.ones(len(y)) if sizes is None else sizes + 1.0
    model.curve = _calibrate(_logit(_weighted(marginals(x @ w, counts, pairs), weight, counts)), labels)
    return model


def _weighted(p: np.ndarray, weight: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts) - counts
    return np.add.reduceat(p * weight, ends) / np.add.reduceat(weight, ends)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _calibrate(z: np.ndarray, labels: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and shift of the logistic curve through (z, label), by Newton's method on smoothed targets."""
    n1 = int(labels.sum())
    n0 = len(labels) - n1
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    # each kind of label weighs the same, so that a rare kind isn't given up for the frequent one
    weight = np.where(labels == 1, 0.5 / n1, 0.5 / n0)
    d = np.stack((z, np.ones(len(z))), axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(d @ beta, -30, 30)))
        grad = d.T @ (weight * (target - p)) - 1e-6 * beta
        hess = (d * (weight * p * (1 - p))[:, None]).T @ d + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta + step * min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
    return (float(beta[0]), float(beta[1])) if beta[0] > 0 else (1.0, 0.0)


def score(docs: list[str], model: Crf, most_bytes: int = 4_000_000) -> np.ndarray:
    """Scores of ``docs``, some megabytes of text at a time; longer texts, and those of very many lines, by blocks."""
    if not model.learned:
        return np.full(len(docs), model.prior)
    out = np.empty(len(docs))
    sizes = [len(d) + 100 * d.count("\n") for d in docs]
    for a, z in by_bytes(sizes, most_bytes):
        if sizes[a] > most_bytes:
            out[a] = long_mean(*long_emission(docs[a].encode("utf-8", "surrogatepass"), model.weights), model.pairs)
            continue
        x, size, counts = line_features(docs[a:z])
        p = marginals(x @ model.weights, counts, model.pairs)
        out[a:z] = _weighted(p, size + 1.0, counts)
    slope, shift = model.curve
    return 1 / (1 + np.exp(-np.clip(slope * _logit(out) + shift, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, max_train_docs: int = 4000, max_doc_lines: int = 2000, max_lines: int = 200_000) -> Crf:
    """Fit on a bounded sample of ``docs`` (doc_id, text) with ``labels`` (doc_id, label).

    Rows of ``labels`` that contradict each other, and null ids or labels, teach
    nothing.  Of several texts with one id the smallest teaches.
    """
    agreed = (
        labels.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other")
        .select("doc_id", "label")
    )
    chosen = sample_ids(agreed, "doc_id", max_train_docs)

    def shapes(batch: pa.RecordBatch) -> dict[str, list]:
        docs_here = texts(batch)
        n = [t.count("\n") + 1 for t in docs_here]
        short = [t if k <= max_doc_lines else "" for t, k in zip(docs_here, n)]
        x, size, counts = line_features(short)
        parts = np.split(np.column_stack((x, size)).astype(np.float32), np.cumsum(counts)[:-1])
        return {"n": n, "x": [p.tobytes() for p in parts]}

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    made = cut(map_batches(rows, shapes, {"n": T.LongType(), "x": T.BinaryType()}, keep=["doc_id", "label"]))
    # the lines are counted before they come to the driver
    ids, total = [], 0
    for r in made.where(F.col("n") <= max_doc_lines).select("doc_id", "n").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").collect():
        total += r["n"]
        if total > max_lines:
            break
        ids.append(r["doc_id"])
    if not ids:
        return Crf(np.zeros(N_FEATURES), np.zeros((2, 2)), 0.5, learned=False)
    found = sorted(made.where(F.col("doc_id").isin(ids)).select("doc_id", "label", "x").collect(), key=lambda r: r["doc_id"])
    x = [np.frombuffer(r["x"], dtype=np.float32).reshape(-1, N_FEATURES + 1) for r in found]
    lines = np.concatenate(x)
    return fit(lines[:, :-1], np.array([len(part) for part in x]), np.array([int(r["label"]) for r in found]), lines[:, -1])


def annotate(docs: DataFrame, model: Crf, threshold: float = 0.3, keep: list[str] | None = None, only_kept: bool = False) -> DataFrame:
    """Add ``score`` and ``predicted`` to ``docs``; with ``only_kept``, rows predicted 0 go."""
    new = {"score": T.DoubleType(), "predicted": T.IntegerType()} | ({"kept": T.BooleanType()} if only_kept else {})

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        s = score(texts(batch), model)
        good = s >= threshold
        return {"score": s, "predicted": good.astype(np.int32)} | ({"kept": good} if only_kept else {})

    return map_batches(docs, run, new, keep=keep, where="kept" if only_kept else None)
