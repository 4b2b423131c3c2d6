"""Language identification by nearest centroid.

A text becomes counts of hashed character n-grams (one to three letters, word ends included), damped by a logarithm, weighted
by inverse document frequency and scaled to length one.  Each language has a few centroids, found by spherical k-means on its
training texts; a text gets the language of the centroid with the largest cosine.  A text is rejected if that cosine is below the
floor of its language and length.  Floors come from cosines with centroids of texts that had no part in them (each half of the sample is
judged by the other): a floor is what a share ``FOREIGN`` of texts of other languages stays below, but at most the quantile ``OWN`` of
the language's own texts.  Whole texts and, so that short ones are known too, excerpts are judged.  Letters of the own texts in
random order stand for other languages where only one is known.

The fit uses at most ``FIT_DOCS`` rows of a language (a hash sample over the whole table) and ``FIT_ALL`` in all; prediction covers whole texts.

Defined cases: null text and text without a letter is ``und`` with score 0, and rejected; with nothing to learn from, all
rows are ``und``; texts of fewer than 16 n-grams (four letters) are not rejected for their cosine; ties go to the language first in order; rows with null doc_id are predicted and never learnt from;
repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_fraction, id_crc_mod

#: Hash buckets of n-grams; centroids of a language; bounds of the training sample.
BITS, CENTROIDS = 13, 4
FIT_DOCS, FIT_ALL = 800, 12_800
#: Floors: the quantile of a language's own texts; shares of other languages' texts from so many n-grams on (the shorter, the less a cosine proves).
OWN, FOREIGN = 0.01, ((128, 0.95), (64, 0.5), (0, 0.05))
#: Characters of excerpts, and rows up to which a language's texts give one of every length; length classes, and rows that a class has to have
#: for a floor of its own (else it takes that of the next shorter one).
EXCERPTS, FEW, CLASSES, ENOUGH = (8, 20, 45, 80, 300), 300, 24, 10
UNKNOWN = "und"

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Of each code point whether it is a letter; made once in a Python worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of a whole text, or None if it has no letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    letter = _letter_table()[points]
    if not letter.any():
        return None
    c = np.zeros(len(points) + 2, np.uint32)
    c[1:-1] = np.where(letter, points, 0)
    c = c[np.append(True, (c[1:] | c[:-1]) != 0)]  # runs between words become one mark
    bigram = (c[:-1] * np.uint32(0x9E3779B1)) ^ (c[1:] * np.uint32(0x85EBCA6B))
    trigram = (bigram[:-1] * np.uint32(0xC2B2AE35)) ^ (c[2:] * np.uint32(0x27D4EB2F))
    shift = np.uint32(32 - BITS)
    size = 1 << BITS
    counts = np.bincount(((bigram * np.uint32(0x2545F491)) >> shift).view(np.int32), minlength=size)
    counts += np.bincount(((trigram * np.uint32(0x2545F491)) >> shift).view(np.int32), minlength=size)
    counts += np.bincount(((c[c != 0] * np.uint32(0xB5297A4D)) >> shift).view(np.int32), minlength=size)
    return counts


@dataclass
class LanguageModel:
    """Centroids (rows of length one), the language of each, n-gram weights, and by centroid and length class the least cosine accepted."""

    languages: list[str] = field(default_factory=list)
    centroids: np.ndarray | None = None
    weights: np.ndarray | None = None
    floors: np.ndarray | None = None

    def vector(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts).astype(np.float32) * self.weights
        return v / max(1e-12, float(np.sqrt(v @ v)))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine with its nearest centroid (0 to 1), and whether the text is rejected."""
        counts = ngram_counts(text)
        if counts is None or self.centroids is None:
            return UNKNOWN, 0.0, True
        cosines = self.centroids @ self.vector(counts)
        best = int(cosines.argmax())
        score = min(1.0, max(0.0, float(cosines[best])))
        return self.languages[best], score, bool(score < self.floors[best, length_class(counts)])


def length_class(counts: np.ndarray) -> int:
    """Texts of like numbers of n-grams: powers of two."""
    return min(CLASSES - 1, int(np.log2(max(1, counts.sum()))))


def excerpts(text: str, every: bool) -> Iterator[tuple[str, str]]:
    """Parts of a text, of every length or of one that varies from text to text, and the same letters in random order."""
    random = np.random.default_rng(zlib.crc32(text.encode("utf-8", "replace")))
    for size in EXCERPTS if every else (EXCERPTS[random.integers(len(EXCERPTS))],):
        start = int(random.integers(max(1, len(text) - size + 1)))
        part = text[start : start + size]
        yield part, "".join(part[i] for i in random.permutation(len(part)))


def floors_of(own: list[tuple[int, float]], foreign: list[tuple[int, float]]) -> np.ndarray:
    """The least accepted cosine of each length class, from (class, cosine) of a language's own and of other texts."""
    floors, before = np.zeros(CLASSES), 0.0
    for c in range(CLASSES):
        mine, others = ([x for k, x in side if k == c] for side in (own, foreign))
        if min(len(mine), len(others)) >= ENOUGH:
            share = next(p for n, p in FOREIGN if 1 << c >= n)
            before = min(float(np.quantile(mine, OWN)), float(np.quantile(others, share)))
        floors[c] = before
    return floors


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Up to ``k`` centroids of length one; starts from the mean's nearest row and then from the rows farthest from the starts."""
    starts = [int((x @ x.mean(0)).argmax())]
    near = x @ x[starts[0]]
    while len(starts) < min(k, len(x)):
        far = int(near.argmin())
        if near[far] > 0.999:
            break
        starts.append(far)
        near = np.maximum(near, x @ x[far])
    centres = x[starts].copy()
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        sums = np.stack([x[own == j].sum(0) if (own == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, fit_all: int = FIT_ALL, centroids: int = CENTROIDS) -> LanguageModel:
    """A model from documents with a language whose crc32 of doc_id leaves 0 or 2 modulo three.

    The executors take n-gram counts of the sampled texts; the driver gets these sparse counts of at most about ``fit_all`` rows.
    """
    known = docs.selectExpr("cast(doc_id as long) cw_id", "lang cw_lang", "text").where("cw_lang is not null and text is not null")
    known = known.where(id_crc_mod("cw_id", 3) != 1)
    n = {r.cw_lang: r.n for r in known.groupBy("cw_lang").agg(F.count("*").alias("n")).collect()}
    if not n:
        return LanguageModel()
    each = max(1, min(fit_docs, fit_all // len(n)))
    sampled = pa.schema([("cw_lang", pa.string()), ("kind", pa.int32()), ("fold", pa.int32()), ("at", pa.binary()), ("n", pa.binary())])
    rate = F.element_at(F.create_map(*(F.lit(v) for lang, k in n.items() for v in (lang, min(1.0, each / k)))), F.col("cw_lang"))
    sample = known.where(hash_fraction("cw_id", "cw_lang") < rate).select("cw_lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                fold = zlib.crc32((text := value.as_py()).encode("utf-8", "replace")) & 1  # copies of a text are in one half
                parts = [(0, text)]
                for part, shuffled in excerpts(text, n[lang] <= FEW):
                    parts += [(1, part), (2, shuffled)] if len(n) == 1 else [(1, part)]
                for kind, part in parts:
                    if (counts := ngram_counts(part)) is not None:
                        at = np.flatnonzero(counts).astype(np.int32)
                        rows.append((lang, kind, fold, at.tobytes(), counts[at].astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_pylist([dict(zip(sampled.names, row, strict=True)) for row in rows], sampled)

    found = sample.mapInArrow(run, "cw_lang string, kind int, fold int, at binary, n binary").collect()
    found = sorted((r.cw_lang, r.kind, r.fold, bytes(r.at), bytes(r.n)) for r in found)
    rows = [r for r in found if r[1] == 0]
    if not rows:
        return LanguageModel()

    def dense(at: bytes, times: bytes) -> np.ndarray:
        counts = np.zeros(1 << BITS, np.float32)
        counts[np.frombuffer(at, np.int32)] = np.frombuffer(times, np.int32)
        return counts

    seen = np.zeros(1 << BITS)
    for *_, at, _ in rows:
        seen[np.frombuffer(at, np.int32)] += 1
    model = LanguageModel(weights=np.log((len(rows) + 1) / (seen + 1)).astype(np.float32) + 1)
    vectors = np.stack([model.vector(dense(at, times)) for *_, at, times in rows])
    owners, folds = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    languages = sorted(set(owners.tolist()))
    centres, halves = [], {}
    for lang in languages:
        centres.append(spherical_kmeans(vectors[owners == lang], centroids))
        for fold in (0, 1):
            if (others := (owners == lang) & (folds != fold)).any():
                halves[lang, fold] = spherical_kmeans(vectors[others], centroids)
    del vectors
    own, foreign = ({lang: [] for lang in languages} for _ in range(2))
    for owner, kind, fold, at, times in found:
        counts = dense(at, times)
        vector, size = model.vector(counts), length_class(counts)
        for lang in languages:
            if (lang, fold) in halves:
                (own if lang == owner and kind < 2 else foreign)[lang].append((size, float((halves[lang, fold] @ vector).max())))
    model.languages = [lang for lang, c in zip(languages, centres, strict=True) for _ in c]
    model.centroids = np.concatenate(centres).astype(np.float32)
    floors = {lang: floors_of(own[lang], foreign[lang]) for lang in languages}
    model.floors = np.stack([floors[lang] for lang in model.languages])
    return model


def _predicted(model: LanguageModel, texts: pa.Array) -> list[tuple[str, float, bool]]:
    return [model.predict(t.as_py()) for t in texts]


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for each row: a narrow map over Arrow batches; the model is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, rejected = zip(*rows, strict=True) if (rows := _predicted(shared.value, batch.column(1))) else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    marked = docs.selectExpr("cast(doc_id as long) doc_id", "text").withColumn("held_out", F.coalesce(id_crc_mod("doc_id", 3) == 1, F.lit(False)))
    return marked.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not rejected."""
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not r for _, _, r in _predicted(shared.value, batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
