"""Operator 9: language by nearest centroid over TF-IDF character n-grams.

A text's n-grams (of one to three UTF-8 bytes of its lower-cased letters,
word ends included) are hashed to ``FEATURES`` counters; counts are damped,
weighted by inverse document frequency and normalised.  Each language has a
few centroids (spherical k-means over its training vectors) and a text takes
the language of the centroid with the largest cosine.

A text is rejected when that cosine is below the bound of its language and
class of length (the power of two of its different n-grams, so that a word
repeated a thousand times is a short text).  The bounds come from beginnings
of the training texts of several lengths: ``SAFE`` of the ``QUANTILE`` that a
language's own beginnings reach, raised to what the other languages' beginnings
reach against its centroids but never above ``NEAR`` of its own.

Training reads at most about ``TRAIN_PER_LANGUAGE`` documents of each language,
picked by a hash of the id among the labelled rows that are not held out; the
bound is a parameter.  Prediction reads whole texts, row by row, so skew and
lost executors need no care; a very long text costs one row of counters.

Defined results: only ``doc_id``, ``text`` and ``lang`` are read, so extra columns
may have any names, and rows without id are predicted like others; null texts and texts without a letter are ``und`` with score
0 and rejected; a text whose n-grams the training never met takes the first
language with score 0 and is rejected; without training rows every text is ``und``; repeated
rows get equal results; empty tables give empty tables.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, held_out, last_place, place

FEATURES = 1 << 13
TRAIN_PER_LANGUAGE = 400
CENTROIDS = 3
ROUNDS = 10
QUANTILE = 0.01            # of the cosines of a language's own beginnings
SAFE, NEAR = 0.4, 0.6      # shares of that quantile between which the bound lies
STARTS = (16, 64, 256, 1024, 4096)   # characters of the beginnings that set the bounds
ENOUGH = 20                # beginnings that a class of length needs for a bound of its own
ROWS_AT_ONCE = 64
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return bool(text) and (any(map(str.isalpha, text[:64])) or any(c.isalpha() for c in LETTERISH.findall(text)))


LETTERISH = re.compile(r"[^\W\d_]")


class Grams:
    """Hashed n-gram counts of texts."""

    def __init__(self, features: int = FEATURES):
        self.features = features
        t = np.arange(256, dtype=np.uint32)
        t[:97] = 32
        t[123:128] = 32
        self.clean = t
        self.shift = np.uint32(32 - (features.bit_length() - 1))

    def _hash(self, code: np.ndarray, seed: int) -> np.ndarray:
        """Multiplicative hash of n-gram codes into the counters."""
        h = code.astype(np.uint32) * np.uint32(2654435761) ^ np.uint32(seed)
        h ^= h >> np.uint32(15)
        return h * np.uint32(2246822519) >> self.shift

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """One row of counters per text."""
        out = np.zeros((len(texts), self.features), np.float32)
        for r, t in enumerate(texts):
            b = self.clean[np.frombuffer((" " + (t or "").lower() + " ").encode("utf-8", "replace"), np.uint8)]
            b = b[np.append(True, (b[1:] != 32) | (b[:-1] != 32))]   # runs of other signs are one space
            if len(b) < 3:
                continue
            pair = b[:-1] << 8 | b[1:]
            grams = np.concatenate([self._hash(b[b != 32], 1), self._hash(pair, 2), self._hash(pair[:-1] << 8 | b[2:], 3)])
            out[r] = np.bincount(grams, minlength=self.features)
        return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped, weighted, normalised rows."""
    v = np.log1p(counts) * idf
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


def spherical_means(v: np.ndarray, k: int) -> np.ndarray:
    """k unit centroids; starts are taken far apart, so nothing is random."""
    start = [int(np.argmax(v @ v.mean(axis=0)))]
    for _ in range(min(k, len(v)) - 1):
        start.append(int(np.argmin((v @ v[start].T).max(axis=1))))
    centre = v[start]
    for _ in range(ROUNDS):
        mine = np.argmax(v @ centre.T, axis=1)
        new = np.stack([v[mine == c].mean(axis=0) if (mine == c).any() else centre[c] for c in range(len(centre))])
        norm = np.sqrt((new * new).sum(axis=1, keepdims=True))
        new = new / np.where(norm > 0, norm, 1)
        if np.allclose(new, centre):
            break
        centre = new
    return centre


def length_class(counts: np.ndarray) -> np.ndarray:
    """Power of two of the number of different n-grams of each row."""
    return np.log2(1 + (counts > 0).sum(axis=1)).astype(np.int64)


def rejection_bounds(rows: list[tuple[str, str]], model: dict, grams: "Grams") -> np.ndarray:
    """The least cosine that is accepted, by language and class of length."""
    names, of = model["names"], model["of"]
    pieces = [(t[:n], y) for t, y in rows for n in (*(n for n in STARTS if n < len(t)), len(t)) if has_letter(t[:n])]
    reached, size = np.zeros((len(pieces), len(names))), np.zeros(len(pieces), np.int64)
    for i in range(0, len(pieces), ROWS_AT_ONCE):
        counts = grams.counts([t for t, _ in pieces[i:i + ROWS_AT_ONCE]])
        cosine = weighted(counts, model["idf"]) @ model["centre"].T
        size[i:i + ROWS_AT_ONCE] = length_class(counts)
        for c in range(len(names)):
            reached[i:i + ROWS_AT_ONCE, c] = cosine[:, of == c].max(axis=1)
    y = np.array([names.index(x) for _, x in pieces], np.int64)
    classes = grams.features.bit_length()
    low = np.zeros((len(names), classes))
    for c in range(len(names)):
        known = [k for k in range(classes) if ((y == c) & (size == k)).sum() >= ENOUGH] or [None]
        for k in range(classes):
            at = min(known, key=lambda j: (abs(j - k), j)) if known != [None] else None
            here = np.ones(len(size), bool) if at is None else size == at
            own, other = reached[here & (y == c), c], reached[here & (y != c), c]
            least = float(np.quantile(own, QUANTILE)) if len(own) else 0.0
            foreign = float(np.quantile(other, 1 - QUANTILE)) if len(other) else 0.0
            low[c, k] = min(NEAR * least, max(SAFE * least, foreign))
    return low


def train(rows: list[tuple[str, str]], features: int = FEATURES, centroids: int = CENTROIDS) -> dict:
    """The model of ``(text, language)`` rows: languages, idf, centroids, rejection bounds."""
    rows = [(t, y) for t, y in rows if y is not None and has_letter(t)]
    names = sorted({y for _, y in rows})
    counts = Grams(features).counts([t for t, _ in rows])
    seen = (counts > 0).sum(axis=0)
    idf = (np.log((1 + len(rows)) / (1 + seen)) + 1).astype(np.float32)
    v = weighted(counts, idf)
    y = np.array([names.index(x) for _, x in rows], np.int64)
    centre = [spherical_means(v[y == c], centroids) for c in range(len(names))]
    model = {"names": names, "idf": idf, "of": np.repeat(np.arange(len(names)), [len(c) for c in centre]),
             "centre": np.concatenate(centre).astype(np.float32) if centre else np.zeros((0, features), np.float32)}
    return model | {"low": rejection_bounds(rows, model, Grams(features))}


def predict(model: dict, grams: Grams, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, cosine and rejection of each text."""
    names, scores, out = model["names"], np.zeros(len(texts)), [UNKNOWN] * len(texts)
    rejected = np.ones(len(texts), bool)
    for i in range(0, len(texts), ROWS_AT_ONCE):
        part = texts[i:i + ROWS_AT_ONCE]
        if not names:
            break
        counts = grams.counts(part)
        cosine, size = weighted(counts, model["idf"]) @ model["centre"].T, length_class(counts)
        best = np.argmax(cosine, axis=1)
        for r, t in enumerate(part):
            if has_letter(t):
                c = int(model["of"][best[r]])
                out[i + r] = names[c]
                scores[i + r] = min(1.0, max(0.0, float(cosine[r, best[r]])))
                rejected[i + r] = scores[i + r] < model["low"][c, size[r]]
    return out, scores, rejected


def training_rows(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> list[tuple[str, str]]:
    """Bounded labelled rows: of each language those with the least hashes of their
    id, among rows that are not held out."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
                        & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    sizes = known.groupBy("lang").count().collect()
    if not sizes:
        return []
    limit = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(last_place(per_language, r["count"])).cast("bigint"))])[F.col("lang")]
    return sorted((r["text"], r["lang"]) for r in known.filter(place(F.col("doc_id")) <= limit).select("text", "lang").collect())


def _predict(shared, features: int):
    def run(batches):
        grams, model = Grams(features), shared.value
        for batch in batches:
            names, score, rejected = predict(model, grams, batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(names, pa.string()), pa.array(score), pa.array(rejected)],
                                             ["doc_id", "lang_pred", "score", "rejected"])
    return run


def _shared_model(docs: DataFrame, per_language: int):
    """Size of the model: languages x centroids x features numbers."""
    return docs.sparkSession.sparkContext.broadcast(train(training_rows(docs, per_language)))


def languages(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, rejected)`` per row of ``docs(doc_id, text, lang)``."""
    arrow_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _predict(_shared_model(docs, per_language), FEATURES), f"doc_id {kind}, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def _keep(shared, features: int):
    def run(batches):
        grams, model = Grams(features), shared.value
        for batch in batches:
            yield batch.filter(pa.array(~predict(model, grams, batch["text"].to_pylist())[2]))
    return run


def drop_rejected(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> DataFrame:
    """The rows of ``docs`` whose language is known; all columns stay."""
    arrow_batches(docs.sparkSession)
    return docs.mapInArrow(_keep(_shared_model(docs, per_language), FEATURES), docs.schema)
