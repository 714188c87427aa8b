"""Language identification with string kernels.

A text is the set of its n-grams of one to three symbols (a blended spectrum,
presence only).  Symbols are letters, any run of other characters is one gap,
and case is folded.  The kernel of two texts is the number of n-grams that both
have, over the square root of the product of their set sizes; the sets count
n-grams that the landmarks know.  Landmark texts give the Nyström features, on
which ridge regression is fitted for each language against the rest.  A batch of
texts is scored by two matrix products: presence times landmark n-grams, then
kernel times coefficients.

Defined results: a text that is null or has no letter is ``und`` with score 0;
equal texts get equal results; ties go to the smaller language name; without
any learned language all is ``und``; an empty table gives an empty result; of
other columns those in ``keep`` stay, those named like a result are replaced.  A
text of any length is one array of symbols in its task.

Learning reads a bounded sample: ``per_language`` documents of each language
with the smallest hashes of their ids, ``max_docs`` in all, of the
``max_languages`` most frequent languages, whole texts of up to ``max_chars``
characters and ``max_total_chars`` in all, which bounds what reaches the driver.
Scoring reads whole texts of all documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, texts

UNKNOWN = "und"
_GAP = 0
#: Symbols: the gap, 254 letters and one for all rarer letters.
_RARE, _SYMBOLS = 255, 256
_CODES = 0x110000


@dataclass
class Model:
    languages: list[str]
    alphabet: np.ndarray
    grams: np.ndarray
    landmarks: np.ndarray
    landmark_sizes: np.ndarray
    coefficients: np.ndarray
    sharpness: float = 6.0
    tables: tuple = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"tables": None}

    def ready(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of each code point, and number of each known n-gram; built once a process."""
        if self.tables is None:
            self.tables = (_symbol_table(self.alphabet), _gram_table(self.grams))
        return self.tables


_letters: np.ndarray | None = None


def _letter_mask() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.zeros(_CODES, dtype=bool)
        _letters[[c for c in range(_CODES) if chr(c).isalpha()]] = True
    return _letters


def _symbol_table(alphabet: np.ndarray) -> np.ndarray:
    out = np.where(_letter_mask(), _RARE, _GAP).astype(np.uint8)
    out[alphabet] = np.arange(1, len(alphabet) + 1, dtype=np.uint8)
    return out


def _gram_table(grams: np.ndarray) -> np.ndarray:
    """n-gram code to 1 + its number, 0 for unknown n-grams."""
    out = np.zeros(_SYMBOLS**3, dtype=np.uint16)
    out[grams] = np.arange(1, len(grams) + 1, dtype=np.uint16)
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _codes(symbols: np.ndarray) -> np.ndarray:
    """Codes of all n-grams; a gap stands before and after the text, runs of gaps are one."""
    s = np.concatenate(([_GAP], symbols, [_GAP])).astype(np.int32)
    s = s[np.concatenate(([True], (s[1:] != _GAP) | (s[:-1] != _GAP)))]
    # the gap is symbol 0, so "gap a b" and "a b" share a code: an n-gram that begins a word counts as its shorter rest
    two = s[:-1] * _SYMBOLS + s[1:]
    return np.concatenate((s, two, two[:-1] * _SYMBOLS + s[2:]))


def presence(docs: list[str], model_tables: tuple[np.ndarray, np.ndarray], n_grams: int) -> np.ndarray:
    """Which known n-grams each text has: (texts x n-grams) of 0 and 1."""
    return evidence(docs, model_tables, n_grams)[0]


def evidence(docs: list[str], model_tables: tuple[np.ndarray, np.ndarray], n_grams: int) -> tuple[np.ndarray, np.ndarray]:
    """``presence``, and the share of each text's n-grams, repeats included, that are known."""
    symbol, number = model_tables
    out, known = np.zeros((len(docs), n_grams + 1), dtype=np.uint8), np.zeros(len(docs))
    for i, text in enumerate(docs):
        # long texts pass in parts that share two symbols
        seen, total = 0, 0
        for a in range(0, max(1, len(text)), 1 << 20):
            at = number[_codes(symbol[_points(text[max(0, a - 2) : a + (1 << 20)])])]
            out[i, at] = 1
            seen, total = seen + np.count_nonzero(at), total + len(at)
        known[i] = seen / max(1, total)
    return out[:, 1:], known


def fit(docs: list[str], langs: list[str], n_landmarks: int = 160, max_grams: int = 12000, ridge: float = 1e-3) -> Model | None:
    """Fit on texts given in round-robin order of their languages."""
    languages = sorted(set(langs))
    if not languages:
        return None
    marks = docs[:n_landmarks]
    seen = np.zeros(_CODES, dtype=np.int64)
    for text in marks:
        p = _points(text)
        seen += np.bincount(p, minlength=_CODES)[:_CODES]
    seen[~_letter_mask()] = 0
    frequent = np.argsort(-seen, kind="stable")[: _RARE - 1]
    alphabet = np.sort(frequent[seen[frequent] > 0])
    symbol = _symbol_table(alphabet)
    held = np.zeros(_SYMBOLS**3, dtype=np.uint16)
    for text in marks:
        held[np.unique(_codes(symbol[_points(text)]))] += 1
    known = np.flatnonzero(held)
    # most telling first: n-grams of more than one landmark, but not of all
    order = np.argsort(-np.minimum(held[known], len(marks) + 1 - held[known].astype(np.int64)), kind="stable")
    grams = np.sort(known[order[:max_grams]])
    tables = (symbol, _gram_table(grams))
    z = presence(marks, tables, len(grams)).astype(np.float32)
    size = np.sqrt(np.maximum(z.sum(axis=1), 1))
    kmm = ((z @ z.T) / size[:, None] / size[None, :]).astype(np.float64)
    value, vector = np.linalg.eigh(kmm)
    keep = value > 1e-6 * max(value.max(), 1e-12)
    root = vector[:, keep] / np.sqrt(value[keep])
    k = np.concatenate([_kernel(presence(docs[a : a + 256], tables, len(grams)), z, size) for a in range(0, len(docs), 256)])
    phi = np.column_stack((k @ root, np.ones(len(k))))
    y = np.array([[1.0 if x == lang else -1.0 for lang in languages] for x in langs])
    w = np.linalg.solve(phi.T @ phi + ridge * len(docs) * np.eye(phi.shape[1]) / 100, phi.T @ y)
    coefficients = np.vstack((root @ w[:-1], w[-1:]))
    return Model(languages, alphabet, grams, z.astype(np.uint8), size, coefficients)


def _kernel(p: np.ndarray, landmarks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    p = p.astype(np.float32)
    own = np.sqrt(np.maximum(p.sum(axis=1), 1))
    return (p @ landmarks.astype(np.float32).T) / own[:, None] / sizes[None, :]


def predict(docs: list[str | None], model: Model | None, chunk: int = 256) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language and score of each text, and the share of its n-grams that the model knows."""
    langs, scores, shares = [UNKNOWN] * len(docs), np.zeros(len(docs)), np.zeros(len(docs))
    some = [i for i, d in enumerate(docs) if d and any(map(str.isalpha, d))]
    if model is None:
        return langs, scores, shares
    tables, marks = model.ready(), model.landmarks.astype(np.float32)
    for a in range(0, len(some), chunk):
        at = some[a : a + chunk]
        present, shares[at] = evidence([docs[i] for i in at], tables, len(model.grams))
        k = _kernel(present, marks, model.landmark_sizes)
        margin = k @ model.coefficients[:-1] + model.coefficients[-1]
        best = margin.argmax(axis=1)
        e = np.exp(model.sharpness / 2 * (margin - margin.max(axis=1, keepdims=True)))
        scores[at] = 1 / e.sum(axis=1)
        for i, b in zip(at, best):
            langs[i] = model.languages[b]
    return langs, scores, shares


def train(docs: DataFrame, per_language: int = 300, max_docs: int = 2400, max_chars: int = 200_000, max_total_chars: int = 20_000_000, max_languages: int = 1000) -> Model | None:
    """Fit on a bounded sample of ``docs`` (doc_id, text, lang)."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.char_length("text") <= max_chars))
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(max_languages).collect()
    if not counts:
        return None
    # ids first, by a bar on their hash that about twice as many as needed pass: no text is sorted and no language meets in one task
    bar = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, (2 * per_language + 50) / r["n"])) for r in counts], "lang string, bar double")
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    passed = (
        usable.select("lang", "doc_id", key.alias("h"), F.char_length("text").alias("chars"))
        .join(F.broadcast(bar), "lang")
        .where((F.col("h").cast("double") / 2.0**64 + 0.5) < F.col("bar"))
        .groupBy("lang", "doc_id", "h")
        .agg(F.max("chars").alias("chars"))
        .collect()
    )
    ranked: list[tuple] = []
    place: dict[str, int] = {}
    for r in sorted(passed, key=lambda r: (r["h"], r["doc_id"] or 0)):
        n = place[r["lang"]] = place.get(r["lang"], 0) + 1
        if n <= per_language:
            ranked.append((n, r["lang"], r["doc_id"], r["chars"]))
    # round robin over the languages until the characters are used up
    ranked = sorted(ranked, key=lambda x: x[:2])[:max_docs]
    ends = np.cumsum([x[3] for x in ranked])
    ranked = [x[:3] for x, end in zip(ranked, ends) if end <= max_total_chars]
    id_type = usable.schema["doc_id"].dataType.simpleString()
    chosen = docs.sparkSession.createDataFrame(ranked, f"n long, lang string, doc_id {id_type}")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.lang") == F.col("b.lang"))
    rows = (
        usable.alias("a")
        .join(F.broadcast(chosen).alias("b"), same)
        .groupBy("b.n", "a.lang", "a.doc_id")
        .agg(F.min("a.text").alias("text"))
        .select("n", "lang", "text")
        .collect()
    )
    rows = sorted(rows, key=lambda r: (r["n"], r["lang"]))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def annotate(docs: DataFrame, model: Model | None, min_score: float = 0.0, min_known: float = 0.0, keep: list[str] | None = None, only_kept: bool = False) -> DataFrame:
    """Add ``lang_pred`` and ``score``; with ``only_kept``, rows go that are ``und``, score under ``min_score`` or know under ``min_known`` of their n-grams.

    The score weighs the learned languages against each other; it is the share of
    known n-grams that tells a text in none of them.
    """
    new = {"lang_pred": T.StringType(), "score": T.DoubleType()} | ({"kept": T.BooleanType()} if only_kept else {})

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        langs, scores, shares = predict(texts(batch), model)
        made = {"lang_pred": langs, "score": scores}
        if only_kept:
            made["kept"] = [x != UNKNOWN and s >= min_score and k >= min_known for x, s, k in zip(langs, scores, shares)]
        return made

    return map_batches(docs, run, new, keep=keep, where="kept" if only_kept else None)
