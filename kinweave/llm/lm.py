"""Document scores of a gated recurrent language model with class-factored output.

Tokens are the white-space separated words of the text, ASCII letters
lower-cased, and one end token.  Word counts are taken over all learning
documents.  Output words are factored into classes: the most frequent words form
head classes, in each of which a softmax depends on the hidden state; all other
words fall into tail classes by their last two bytes, in each of which words
have their discounted relative counts and what the discount leaves is the
unknown word's.  The probability of a word is that of its class given the hidden
state times that of the word in its class; over all known words and the unknown
word it sums to one.

The recurrent weights are learned in numpy by backpropagation truncated to
windows.  They begin as a fit on a bounded sample of learning documents
(``sample_docs`` with the smallest hashes of their ids, of ``sample_chars``
characters at most), and then learn on the executors from all tokens of all
learning documents: each is dealt to one of ``rounds`` rounds, in which every
worker learns on about a thousand documents from the same weights, and the mean
of the workers' weights, weighted by tokens, is what the next round begins with.  Counts, classes and discounts come from all learning
documents.  Scoring carries the state over windows through the whole document,
many documents side by side.

Only the most frequent words, ``vocabulary`` at most, travel to the tasks.  Other words
leave their score open until a join with all counts.

Defined results: a null or empty text is the end token alone; rows may repeat
and each is scored, equal texts alike; without learning documents all words are
unknown and both scores are 0 (probability 1); an empty table gives an empty
result; only doc_id and text are read.  A text of any length is split into words
as a whole in its task and scored window by window, its state carried along.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, column, cut, give_back, sample_ids, small, texts

END = b""
HEAD_SIZE, HEAD_CLASSES, TAIL_CLASSES = 40, 48, 96
_HEAD = HEAD_SIZE * HEAD_CLASSES
_CLASSES = HEAD_CLASSES + TAIL_CLASSES
#: Input ids: head words, tail classes, the start of a document.
_START = _HEAD + TAIL_CLASSES
_LOG10 = math.log(10)


def words_of(text: str) -> list[bytes]:
    """Words by ASCII white space, ASCII letters lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAIL_CLASSES


def count_words(docs: DataFrame, most: int = 250_000) -> DataFrame:
    """(word, kind, c) over all texts, the end tokens included; kind is the word's tail class.

    A task sums up to ``most`` different words before it hands them on.
    """

    def rows(held: dict[bytes, int]) -> pa.RecordBatch:
        words = list(held)
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.binary()), pa.array([tail_class(w) for w in words], pa.int32()), pa.array(list(held.values()), pa.int64())], names=["word", "kind", "c"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        get = held.get
        for batch in small(batches):
            for text in texts(batch):
                for w in words_of(text):
                    held[w] = get(w, 0) + 1
                held[END] = get(END, 0) + 1
                if len(held) >= most:
                    yield rows(held)
                    held.clear()
        if held:
            yield rows(held)

    return docs.select("text").mapInArrow(run, "word binary, kind int, c long").groupBy("word", "kind").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Counts of the most frequent words (the end token first) and of the tail classes."""

    words: list[bytes]
    counts: np.ndarray
    kinds: np.ndarray
    n: int
    v: int
    discount: float
    tail_n: np.ndarray
    tail_types: np.ndarray
    #: The least step of counts whose words are all in.
    least_step: int = 0

    @property
    def base_unit(self) -> float:
        return self.n + 0.5 * (self.v + 1)

    def tables(self) -> tuple[np.ndarray, ...]:
        """By word: base log10, class, log10 within a tail class, input id."""
        i = np.arange(len(self.words))
        head = i < _HEAD
        base = np.log10((self.counts + 0.5) / self.base_unit)
        kind = np.where(head, np.minimum(i, _HEAD - 1) // HEAD_SIZE, HEAD_CLASSES + self.kinds)
        inside = np.where(head, 0.0, np.log10(np.maximum(self.counts - self.discount, 1e-9) / np.maximum(self.tail_n[self.kinds], 1)))
        return base, kind.astype(np.int32), inside, np.where(head, i, _HEAD + self.kinds).astype(np.int32)

    def unknown(self) -> np.ndarray:
        """Share of the unknown word in each tail class."""
        return np.where(self.tail_n > 0, self.discount * self.tail_types / np.maximum(self.tail_n, 1), 1.0)


def count_step(c: Column) -> Column:
    """A number that grows with the logarithm of a count: some hundred steps for any corpus."""
    return F.floor(F.log2(c) * 16).cast("int")


def make_vocabulary(counts: DataFrame, size: int = 262_144) -> Vocabulary:
    """From all counts, a stored table.

    The words from a count on are taken, as many whole steps of counts as fit
    ``size``; so no task sorts all words.
    """
    total = counts.agg(
        F.sum("c"), F.count(F.lit(1)), F.count(F.when(F.col("c") == 1, 1)), F.count(F.when(F.col("c") == 2, 1))
    ).first()
    n, v, n1, n2 = (int(x or 0) for x in total)
    room, least = size - 1, 1 << 20
    for r in sorted(counts.groupBy(count_step(F.col("c")).alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["step"]):
        if r["n"] > room:
            break
        room, least = room - r["n"], r["step"]
    taken = (count_step(F.col("c")) >= least) | (F.col("word") == F.lit(END))
    top = counts.where(taken).toArrow().to_pylist()
    top.sort(key=lambda r: (bytes(r["word"]) != END, -r["c"], bytes(r["word"])))
    kinds = np.array([r["kind"] for r in top], dtype=np.int64)
    c = np.array([r["c"] for r in top], dtype=np.int64)
    tail_n, tail_types = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
    for r in counts.groupBy("kind").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("types")).collect():
        tail_n[r["kind"]], tail_types[r["kind"]] = r["n"], r["types"]
    tail_n -= np.bincount(kinds[:_HEAD], c[:_HEAD], TAIL_CLASSES)[:TAIL_CLASSES]
    tail_types -= np.bincount(kinds[:_HEAD], minlength=TAIL_CLASSES)[:TAIL_CLASSES]
    discount = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
    return Vocabulary([bytes(r["word"]) for r in top], c, kinds, n, v, discount, tail_n, tail_types, least)


class Network:
    """The recurrent weights; float32 throughout."""

    def __init__(self, vocabulary: Vocabulary, hidden: int = 32, seed: int = 5):
        rng = np.random.default_rng(seed)
        h = hidden
        f = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        head = vocabulary.counts[:_HEAD].astype(np.float64)
        padded = np.zeros(_HEAD)
        padded[: len(head)] = head
        inside = padded.reshape(HEAD_CLASSES, HEAD_SIZE)
        mass = np.concatenate((inside.sum(axis=1), vocabulary.tail_n)) + 0.1
        here = np.full((HEAD_CLASSES, HEAD_SIZE), -30.0)
        some = inside > 0
        here[some] = np.log(inside[some] / np.broadcast_to(inside.sum(axis=1, keepdims=True), inside.shape)[some])
        # the output starts as the class unigram model
        self.p = {
            "e": f(_START + 1, 3 * h, scale=0.2),
            "u": f(h, 3 * h, scale=1 / math.sqrt(h)),
            "b": np.zeros(3 * h, dtype=np.float32),
            "c": np.zeros((h, _CLASSES), dtype=np.float32),
            "cb": np.log(mass / mass.sum()).astype(np.float32),
            "w": np.zeros((HEAD_CLASSES, h, HEAD_SIZE), dtype=np.float32),
            "wb": here.astype(np.float32),
        }
        self.hidden = h

    def run(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool = False):
        """Hidden states of a window: ``x`` (steps x lanes) inputs; ``fresh`` lanes begin a document."""
        k, u, b = self.hidden, self.p["u"], self.p["b"]
        gx = self.p["e"][x]
        out = np.empty((*x.shape, k), dtype=np.float32)
        held = []
        h = h.copy()
        begins = fresh.any(axis=1).tolist()
        for t in range(len(x)):
            if begins[t]:
                h = h * ~fresh[t][:, None]
            gh = h @ u
            gh += b
            zr = gh[:, : 2 * k] + gx[t, :, : 2 * k]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r = zr[:, :k], zr[:, k:]
            n = gh[:, 2 * k :]
            if keep:
                ghn, n = n, n.copy()
            n *= r
            n += gx[t, :, 2 * k :]
            np.tanh(n, out=n)
            if keep:
                held.append((h, z, r, n, ghn))
            new = out[t]
            np.subtract(h, n, out=new)
            new *= z
            new += n
            h = new
        return out, h, held

    def classes(self, h: np.ndarray) -> np.ndarray:
        """Log probabilities of all classes."""
        y = h @ self.p["c"]
        y += self.p["cb"]
        y -= y.max(axis=1, keepdims=True)
        y -= np.log(np.exp(y).sum(axis=1, keepdims=True))
        return y

    def outcome(self, h: np.ndarray, kind: np.ndarray, unknown: np.ndarray, rows: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of the classes ``kind`` and of the unknown word, without those of all others; ``rows`` at a time stay in a cache."""
        # states lie between -1 and 1, which bounds the exponents
        wide = float((np.abs(self.p["c"]).sum(axis=0) + np.abs(self.p["cb"])).max()) > 80
        weigh = np.stack((np.ones(_CLASSES, dtype=np.float32), np.concatenate((np.zeros(HEAD_CLASSES, dtype=np.float32), unknown))), axis=1)
        own, other = np.empty(len(kind), dtype=np.float32), np.empty(len(kind), dtype=np.float32)
        for a in range(0, len(kind), rows):
            y = h[a : a + rows] @ self.p["c"]
            y += self.p["cb"]
            if wide:
                y -= y.max(axis=1, keepdims=True)
            here = y[np.arange(len(y)), kind[a : a + rows]]
            np.exp(y, out=y)
            sums = y @ weigh
            total = np.log(sums[:, 0])
            own[a : a + rows], other[a : a + rows] = here - total, np.log(np.maximum(sums[:, 1], 1e-30)) - total
        return own, other

    def groups(self, kind: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Head classes with the places of their words."""
        order = np.argsort(kind, kind="stable")
        edges = np.searchsorted(kind[order], np.arange(HEAD_CLASSES + 1))
        for c in range(HEAD_CLASSES):
            if edges[c + 1] > edges[c]:
                yield c, order[edges[c] : edges[c + 1]]

    @staticmethod
    def shares(y: np.ndarray) -> np.ndarray:
        """Probabilities, in place of their unnormalised logarithms."""
        y -= y.max(axis=1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=1, keepdims=True)
        return y

    def inside(self, c: int, h: np.ndarray) -> np.ndarray:
        y = h @ self.p["w"][c]
        y += self.p["wb"][c]
        y -= y.max(axis=1, keepdims=True)
        y -= np.log(np.exp(y).sum(axis=1, keepdims=True))
        return y


def fit(
    documents: list[tuple[np.ndarray, np.ndarray]], vocabulary: Vocabulary, hidden: int = 32, epochs: int = 2, lanes: int = 64, window: int = 24, rate: float = 4e-3, seed: int = 5,
    start: Network | None = None, until: float = 0.0,
) -> Network:
    """Learn on documents of (input ids, classes with head words' ids): see ``Reader.arrays``.

    Learning goes on from ``start`` if given; the rate falls to the share
    ``until`` of its first value.  Where the tokens don't fill all lanes, some
    are learned from twice, and none is left out.
    """
    net = Network(vocabulary, hidden, seed) if start is None else start
    documents = [d for d in documents if len(d[0])]
    if not documents:
        return net
    rng = np.random.default_rng(seed)
    p, k = net.p, net.hidden
    m = {n: np.zeros_like(a) for n, a in p.items()}
    v = {n: np.zeros_like(a) for n, a in p.items()}
    step, total = 0, 0
    for epoch in range(epochs):
        order = rng.permutation(len(documents))
        x = np.concatenate([documents[i][0] for i in order])
        y = np.concatenate([documents[i][1] for i in order])
        width = max(1, min(lanes, len(x) // window))
        long = -(-len(x) // width)
        x, y = np.resize(x, width * long), np.resize(y, width * long)
        x, y = x[: width * long].reshape(width, long).T, y[: width * long].reshape(width, long).T
        total = total or epochs * -(-long // window)
        h = np.zeros((width, k), dtype=np.float32)
        for a in range(0, long, window):
            step += 1
            xs, ys = x[a : a + window], y[a : a + window]
            fresh = xs == _START
            hs, h, held = net.run(xs, fresh, h, keep=True)
            flat, target = hs.reshape(-1, k), ys.reshape(-1)
            kind = np.where(target < _HEAD, target // HEAD_SIZE, HEAD_CLASSES + target - _HEAD)
            n = len(target)
            g = {name: np.zeros_like(q) for name, q in p.items()}
            d = flat @ p["c"]
            d += p["cb"]
            net.shares(d)
            d[np.arange(n), kind] -= 1
            d /= n
            g["c"], g["cb"] = flat.T @ d, d.sum(axis=0)
            dh = d @ p["c"].T
            for c, at in net.groups(kind):
                own = flat[at]
                q = own @ p["w"][c]
                q += p["wb"][c]
                net.shares(q)
                q[np.arange(len(at)), target[at] % HEAD_SIZE] -= 1
                q /= n
                g["w"][c], g["wb"][c] = own.T @ q, q.sum(axis=0)
                dh[at] += q @ p["w"][c].T
            dh = dh.reshape(hs.shape)
            back = np.zeros((width, k), dtype=np.float32)
            dgx = np.empty((len(xs), width, 3 * k), dtype=np.float32)
            for t in range(len(xs) - 1, -1, -1):
                h0, z, r, nn, ghn = held[t]
                one = dh[t] + back
                dn = one * (1 - z) * (1 - nn * nn)
                dgx[t, :, :k] = one * (h0 - nn) * z * (1 - z)
                dgx[t, :, k : 2 * k] = dn * ghn * r * (1 - r)
                dgx[t, :, 2 * k :] = dn
                dgh = dgx[t].copy()
                dgh[:, 2 * k :] *= r
                g["u"] += h0.T @ dgh
                g["b"] += dgh.sum(axis=0)
                back = (one * z + dgh @ p["u"].T) * ~fresh[t][:, None]
            ids = xs.reshape(-1)
            by_id = np.argsort(ids, kind="stable")
            firsts = np.flatnonzero(np.diff(ids[by_id], prepend=-1))
            g["e"][ids[by_id][firsts]] = np.add.reduceat(dgx.reshape(-1, 3 * k)[by_id], firsts, axis=0)
            norm = math.sqrt(sum(float(np.vdot(q, q)) for q in g.values()))
            clip = min(1.0, 1.0 / (norm + 1e-9))
            now = rate * min(1.0, step / 50) * (until + (1 - until) * (0.5 + 0.5 * math.cos(math.pi * step / (total + 1))))
            for name, q in p.items():
                gr, mm, vv = g[name], m[name], v[name]
                gr *= clip
                mm *= 0.9
                mm += np.float32(0.1) * gr
                gr *= gr
                vv *= 0.99
                gr *= 0.01
                vv += gr
                np.divide(vv, 1 - 0.99**step, out=gr)
                np.sqrt(gr, out=gr)
                gr += 1e-8
                np.divide(mm, gr, out=gr)
                gr *= now / (1 - 0.9**step)
                q -= gr
    return net


class Reader:
    """Turns texts into ids and scores them; made once a task."""

    def __init__(self, vocabulary: Vocabulary, network: Network | None):
        self.vocabulary, self.network = vocabulary, network
        self.number = {w: i for i, w in enumerate(vocabulary.words)}
        self.base, self.kind, self.inside, self.input = vocabulary.tables()
        self.unknown = vocabulary.unknown().astype(np.float32)

    def read(self, docs: list[str]):
        """Word numbers (-1: not in the vocabulary) of all tokens, tokens of each document, other words and their places."""
        get = self.number.get
        ids, sizes, others, places = [], [], [], []
        at = 0
        for text in docs:
            words = words_of(text)
            own = [get(w, -1) for w in words]
            if -1 in own:
                for i, x in enumerate(own):
                    if x < 0:
                        others.append(words[i])
                        places.append(at + i)
            own.append(get(END, -1))
            ids.append(np.array(own, dtype=np.int32))
            sizes.append(len(own))
            at += len(own)
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.array(sizes, dtype=np.int64), others, np.array(places, dtype=np.int64)

    def arrays(self, docs: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(input ids, targets) of each document; a target is a head word's number or the head plus a tail class."""
        ids, sizes, others, places = self.read(docs)
        own, _ = self._inputs(ids, sizes, others, places)
        ends = np.cumsum(sizes)[:-1]
        shifted = np.concatenate(([_START], own[:-1]))
        shifted[np.cumsum(sizes) - sizes] = _START
        return list(zip(np.split(shifted, ends), np.split(own, ends)))

    def _inputs(self, ids, sizes, others, places):
        own = self.input[ids] if len(self.input) else np.full(len(ids), _HEAD, dtype=np.int32)
        kind = self.kind[ids] if len(self.kind) else np.full(len(ids), HEAD_CLASSES, dtype=np.int32)
        if len(others):
            tail = np.array([tail_class(w) for w in others], dtype=np.int32)
            own[places], kind[places] = _HEAD + tail, HEAD_CLASSES + tail
        return own, kind

    def score(self, docs: list[str], lanes: int = 256, window: int = 32):
        """Base and model sums of the words of the vocabulary by document, and of each other word: document, word, class log10, unknown log10."""
        ids, sizes, others, places = self.read(docs)
        own, kind = self._inputs(ids, sizes, others, places)
        begin = np.cumsum(sizes) - sizes
        x = np.concatenate(([_START], own[:-1])).astype(np.int32)
        x[begin] = _START
        # documents side by side: each goes to the lane with the fewest tokens
        n_lanes = min(lanes, len(docs))
        heap = [(0, i) for i in range(n_lanes)]
        heapify(heap)
        lane: list[list[int]] = [[] for _ in range(n_lanes)]
        for d in np.argsort(-sizes, kind="stable").tolist():
            load, i = heap[0]
            lane[i].append(d)
            heapreplace(heap, (load + int(sizes[d]), i))
        rows = [np.concatenate([np.arange(begin[d], begin[d] + sizes[d]) for d in own_docs]) for own_docs in lane]
        rows.sort(key=len, reverse=True)
        length = np.array([len(r) for r in rows])
        net, p_class, p_unknown, p_inside = self.network, np.empty(len(ids), np.float32), np.empty(len(ids), np.float32), np.zeros(len(ids), np.float32)
        h = np.zeros((n_lanes, net.hidden), dtype=np.float32)
        for a in range(0, int(length[0]), window):
            active = int(np.searchsorted(-length, -a, side="left"))
            steps = min(window, int(length[0]) - a)
            token = np.full((active, steps), -1, dtype=np.int64)
            for i in range(active):
                part = rows[i][a : a + steps]
                token[i, : len(part)] = part
            token = np.ascontiguousarray(token.T)
            there = token >= 0
            xs = np.where(there, x[token], _START)
            hs, h, _ = net.run(xs, xs == _START, h[:active])
            at = token[there]
            flat = hs[there]
            k = kind[at]
            p_class[at], p_unknown[at] = net.outcome(flat, k, self.unknown)
            for c, where in net.groups(k):
                inner = net.inside(c, flat[where])
                p_inside[at[where]] = inner[np.arange(len(where)), ids[at[where]] % HEAD_SIZE]
        doc = np.repeat(np.arange(len(docs)), sizes)
        known = ids >= 0
        model = (p_class + p_inside) / _LOG10 + np.where(known, self.inside[ids] if len(self.inside) else 0.0, 0.0)
        base = np.where(known, self.base[ids] if len(self.base) else 0.0, 0.0)
        sums = [np.bincount(doc, np.where(known, q, 0.0), len(docs)) for q in (base, model)]
        return sizes, np.bincount(doc[known], minlength=len(docs)), sums[0], sums[1], doc[places], others, p_class[places] / _LOG10, p_unknown[places] / _LOG10


def refine(net: Network, vocab: Vocabulary, texts_: DataFrame, rounds: int = 4, worker_docs: int = 1000, rate: float = 3e-3, worker_tokens: int = 1_000_000) -> Network:
    """Go on learning on all of ``texts_`` (h, text), each row in one round and by one worker.

    Each round deals its documents to workers of about ``worker_docs`` each, so
    there are more workers, not longer ones, where there is more text.  A worker
    holds ``worker_tokens`` or one document at a time, and goes on with the next.
    """

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(vocab, None)
        for batch in small(batches):
            own = pa.array([y.astype("<u2").tobytes() for _, y in reader.arrays(texts(batch))], pa.binary())
            yield pa.RecordBatch.from_arrays([column(batch, "h"), own], names=["h", "own"])

    held = cut(texts_.select("h", "text").mapInArrow(numbered, "h long, own binary"))
    n = held.count()
    if not n:
        return net
    rounds = max(1, min(rounds, n // worker_docs))
    workers = max(1, -(-n // (rounds * worker_docs)))
    # by the text too: rows of one id, or of none, are spread
    slot = F.pmod(F.xxhash64("h", "own", F.lit(7)), F.lit(rounds * workers))
    dealt = held.select("h", "own", (slot % rounds).alias("round"), F.floor(slot / rounds).cast("int").alias("worker"))
    names = sorted(net.p)
    size, chunk = sum(net.p[x].size for x in names), 32_768
    for r in range(rounds):
        begin = rate * (1 - 0.75 * r / rounds)

        def learn(batches: Iterator[pa.RecordBatch], net: Network = net, r: int = r, begin: float = begin) -> Iterator[pa.RecordBatch]:
            def begun() -> Network:
                own = Network.__new__(Network)
                own.hidden, own.p = net.hidden, {x: net.p[x].copy() for x in names}
                return own

            def more(own: Network, worker: int, docs: list[np.ndarray]) -> None:
                docs = [y.astype(np.int64) for y in docs]
                inputs = [np.concatenate(([_START], y[:-1])) for y in docs]
                fit(list(zip(inputs, docs)), None, epochs=1, lanes=128, rate=begin, seed=1000 * r + worker % 1000, start=own, until=0.3 * (r + 1 < rounds))

            def learned(own: Network, worker: int, tokens: int) -> pa.RecordBatch:
                flat = np.concatenate([own.p[x].ravel() for x in names])
                parts = [flat[a : a + chunk].tobytes() for a in range(0, size, chunk)]
                m = len(parts)
                return pa.RecordBatch.from_arrays([pa.array(range(m), pa.int32()), pa.array([worker] * m, pa.int32()), pa.array([float(tokens)] * m), pa.array(parts, pa.binary())], names=["chunk", "worker", "tokens", "weights"])

            current, own, docs, held_, total = None, None, [], 0, 0
            for batch in batches:
                for worker, raw in zip(column(batch, "worker").to_pylist(), column(batch, "own").to_pylist()):
                    if worker != current:
                        if own is not None:
                            more(own, current, docs)
                            yield learned(own, current, total)
                        current, own, docs, held_, total = worker, begun(), [], 0, 0
                    y = np.frombuffer(raw, dtype="<u2")
                    if docs and held_ + len(y) > worker_tokens:
                        more(own, current, docs)
                        docs, held_ = [], 0
                    docs.append(y)
                    held_, total = held_ + len(y), total + len(y)
            if own is not None:
                more(own, current, docs)
                yield learned(own, current, total)
            give_back()

        def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, total, tokens = None, None, 0.0

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([(total / tokens).astype(np.float32).tobytes()], pa.binary())], names=["chunk", "weights"])

            for batch in batches:
                for c, n_tokens, raw in zip(column(batch, "chunk").to_pylist(), column(batch, "tokens").to_pylist(), column(batch, "weights")):
                    if c != current:
                        if current is not None:
                            yield made()
                        current, total, tokens = c, 0.0, 0.0
                    total = total + n_tokens * np.frombuffer(raw.as_buffer(), dtype=np.float32).astype(np.float64)
                    tokens += n_tokens
            if current is not None:
                yield made()

        own = dealt.where(F.col("round") == r).repartition(workers, "worker").sortWithinPartitions("worker", "h", "own")
        each = own.select("worker", "own").mapInArrow(learn, "chunk int, worker int, tokens double, weights binary")
        means = each.repartition("chunk").sortWithinPartitions("chunk", "worker").mapInArrow(mean, "chunk int, weights binary").collect()
        if not means:
            continue
        flat = np.concatenate([np.frombuffer(x["weights"], dtype=np.float32) for x in sorted(means, key=lambda x: x["chunk"])])
        after, at = Network.__new__(Network), 0
        after.hidden, after.p = net.hidden, {}
        for x in names:
            after.p[x] = flat[at : at + net.p[x].size].reshape(net.p[x].shape).copy()
            at += net.p[x].size
        net = after
    return net


def score_documents(
    docs: DataFrame, learns: Column, hidden: int = 32, sample_docs: int = 1500, sample_chars: int = 100_000, vocabulary: int = 262_144, epochs: int = 2, rounds: int = 4
) -> DataFrame:
    """Scores of ``docs`` (doc_id, text) by a model of the rows where ``learns`` holds.

    Rows: doc_id, learned, n_tokens, n_known, train_tokens, base_score, score.
    """
    marked = docs.select("doc_id", "text", F.coalesce(learns, F.lit(False)).alias("learned"))
    counts = cut(count_words(marked.where("learned")))
    vocab = make_vocabulary(counts, vocabulary)
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    teaching = marked.where("learned").where(F.coalesce(F.char_length("text"), F.lit(0)) <= sample_chars)
    chosen = sample_ids(teaching.select("doc_id").distinct(), "doc_id", sample_docs)
    same = marked["doc_id"].eqNullSafe(chosen["doc_id"])
    sample = teaching.join(F.broadcast(chosen), same, "left_semi").groupBy(key.alias("h"), "doc_id").agg(F.min("text").alias("text")).collect()
    sample = [r["text"] or "" for r in sorted(sample, key=lambda r: (r["h"], r["doc_id"] or 0))]
    net = fit(Reader(vocab, None).arrays(sample), vocab, hidden, epochs) if vocab.n else Network(vocab, hidden)
    if vocab.n:
        net = refine(net, vocab, marked.where("learned").select(key.alias("h"), "text"), rounds)
    schema = "uid long, doc_id %s, learned boolean, n_tokens long, n_known long, base double, model double, word binary, n long, p_class double, p_unknown double" % docs.schema["doc_id"].dataType.simpleString()
    names = ["uid", "doc_id", "learned", "n_tokens", "n_known", "base", "model", "word", "n", "p_class", "p_unknown"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(vocab, net)
        uid = TaskContext.get().partitionId() << 36
        for batch in small(batches):
            docs_here = texts(batch)
            for a, z in by_bytes([len(t) for t in docs_here], 6_000_000):
                sizes, known, base, model, doc, words, p_class, p_unknown = reader.score(docs_here[a:z])
                m = z - a
                own = uid + np.arange(m)
                # the open words of a document, each once with its sums
                place: dict[tuple[int, bytes], int] = {}
                at = np.array([place.setdefault(x, len(place)) for x in zip(doc.tolist(), words)], dtype=np.int64)
                k = len(place)
                sums = [np.bincount(at, q, k) if k else np.zeros(0) for q in (np.ones(len(at)), p_class, p_unknown)]
                open_doc = np.fromiter((d for d, _ in place), np.int64, k)
                none = lambda t: pa.nulls(k, t)
                # a document's own row has a word that no text holds, another for each, so that the rows are spread
                mine = [b" " + int(u).to_bytes(8, "little") for u in own]
                ids = batch.column(batch.schema.get_field_index("doc_id")).slice(a, m)
                learned = batch.column(batch.schema.get_field_index("learned")).slice(a, m)
                columns = [
                    pa.array(np.concatenate((own, own[open_doc]))),
                    pa.concat_arrays([ids, none(ids.type)]),
                    pa.concat_arrays([learned, none(pa.bool_())]),
                    *(pa.concat_arrays([pa.array(q, t), none(t)]) for q, t in ((sizes, pa.int64()), (known, pa.int64()), (base, pa.float64()), (model, pa.float64()))),
                    pa.array(mine + [w for _, w in place], pa.binary()),
                    *(pa.array(np.concatenate((np.zeros(m), q)), t) for q, t in zip(sums, (pa.int64(), pa.float64(), pa.float64()))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                uid += m

    rows = marked.mapInArrow(run, schema)
    rare = counts.where(count_step(F.col("c")) < vocab.least_step)
    share = F.create_map(*[F.lit(x) for i in range(TAIL_CLASSES) for x in (i, float(max(vocab.tail_n[i], 1.0)))])
    inside = F.log10(F.greatest(F.col("c") - vocab.discount, F.lit(1e-9)) / share[F.col("kind")])
    known = F.col("c").isNotNull()
    joined = rows.join(rare, "word", "left").select(
        *[x for x in names if x != "word"],
        F.when(known, F.col("n")).otherwise(0).alias("own_known"),
        (F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 0.5) / vocab.base_unit)).alias("own_base"),
        F.when(known, F.col("p_class") + F.col("n") * inside).otherwise(F.col("p_unknown")).alias("own_model"),
    )
    first = lambda c: F.max(c).alias(c)
    summed = joined.groupBy("uid").agg(
        first("doc_id"), first("learned"), first("n_tokens"),
        (F.max("n_known") + F.sum("own_known")).alias("n_known"),
        (F.max("base") + F.sum("own_base")).alias("base_score"),
        (F.max("model") + F.sum("own_model")).alias("score"),
    )
    score = F.col("score") if vocab.n else F.lit(0.0)
    return summed.select(
        "doc_id", "learned", "n_tokens", "n_known", F.lit(vocab.n).cast("long").alias("train_tokens"), "base_score", score.alias("score")
    )
