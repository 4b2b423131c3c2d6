"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic passages.  The training text of the toxic one is
those words of toxic passages that ordinary ones hardly use: words with a stem (or short words, parts from inside words, pairs of words) whose over-use
is beyond chance; of whole passages a dictionary would mostly learn ordinary prose, which tells nothing.  Both compressors also
know the ordinary dictionary's text, at the same distance, so that ordinary prose costs the same in both.
A window is ``WINDOW`` words, each after marks of its own so that matches begin where words do, and a fixed tail, because zstandard looks for no
match in the last bytes of a block; pairs that were learnt are further windows.  A window without six bytes in common with the toxic dictionary, the
shortest match, counts as one without gain and is not compressed (both lengths were the same for all of 739,533 such windows tried); a vectorised look at all bytes finds these.  Its gain is its compressed length with the ordinary dictionary less that with the toxic one.  A
text's evidence is the number and sum of gains that reach the thresholds, by themselves and per window.  A logistic model of that
evidence gives the score; it and the thresholds (the choice of ``THRESHOLDS`` with the least log loss, each half of the sample judged by the
other) are calibrated on labelled texts that the dictionaries have not seen.

The fit uses at most ``FIT_DOCS`` labelled rows of each class for dictionaries (a passage of at most ``PASSAGE`` characters of
each, and ``SAMPLES`` windows of the ordinary ones, chosen by hash) and as many whole texts for calibration; scoring covers all windows of all texts.

Defined cases: null and empty texts have no window and get the score of no evidence; texts of any length are read whole;
with no labelled rows of one class the score is the share of toxic labels (0 without labels) for all rows, and so it is if nothing is over-used; repeated
rows each give a row; null doc_ids are scored, and never learnt from; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_fraction, id_crc_mod

#: Bounds of the fit: labelled rows of each class, and characters of a passage.
FIT_DOCS, PASSAGE = 3000, 2048
#: A stem has this many characters at least, and is so many times likelier in toxic text at least.
SHORTEST, TIMES = 4, 20.0
#: Bytes of parts learnt from inside words (zstandard has no shorter match); longest words, of which each next part begins half of that later.
INNER, LONGEST = (6, 12), 48
#: Words of a window; windows of ordinary text to train on at most; most bytes of the two dictionaries.
WINDOW, SAMPLES, ORDINARY_BYTES, TOXIC_BYTES = 2, 40_000, 4096, 2048
#: Segment and match lengths of the training.
SEGMENT, DMER = 24, 8
#: Bytes of the fixed tail of windows.
TAIL = 24
#: Choices of thresholds of a window's gain; the largest gain told apart; windows compressed at once.
THRESHOLDS, MOST, AT_ONCE = ((2, 3, 4, 5), (3, 4, 5, 6), (3, 5), (4, 6)), 12, 4096
#: Bytes of the compressors' shortest match.
MATCH = 6

_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


_SIGNED = re.compile(
    rb"[0-9$@*#]*[a-z\x80-\xff]+(?:[!-@\[-`{-~]+[a-z\x80-\xff]+)+[0-9$@*#]*|[0-9$@*#]+[a-z\x80-\xff]+[0-9$@*#]*|[a-z\x80-\xff]+[0-9$@*#]+"
)
#: Kinds of bytes: what a word may have beside letters, signs, and letters.
_KINDS = bytes(48 if c in b"0123456789$@*#" else 46 if 33 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126 else 97 if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
#: In names of words and stems: after a short whole word, before what begins inside a word.
_END, _INSIDE = b"\x01", b"\x02"


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in lower case and UTF-8, cut at everything of ASCII but letters, and then the words that have digits or signs inside."""
    if not text:
        return []
    raw = text.lower().encode("utf-8", "replace")
    words = raw.translate(_LETTERS).split()
    kinds = raw.translate(_KINDS)
    if b"0" in kinds or b".a" in kinds:  # else the pattern finds nothing
        words += _SIGNED.findall(raw)
    if max(map(len, words), default=0) <= LONGEST:
        return words
    out = []
    for w in words:
        out.append(w[:LONGEST])
        out += [_INSIDE + w[i : i + LONGEST] for i in range(LONGEST // 2, len(w) - LONGEST // 2, LONGEST // 2)]
    return out


def _stems(word: bytes) -> Iterator[bytes]:
    """What may be learnt from a word: its beginnings, the whole of a short one, and parts from inside."""
    inside = word.startswith(_INSIDE)
    word = word[1:] if inside else word
    if not inside:
        if 2 <= len(word) < SHORTEST:
            yield word + _END
        for n in range(SHORTEST, len(word) + 1):
            yield word[:n]
    for i in range(0 if inside else 1, len(word) - INNER[0] + 1):
        for n in range(INNER[0], min(INNER[1], len(word) - i) + 1):
            yield _INSIDE + word[i : i + n]


_TURNED = bytes(c ^ 0x80 for c in range(256))
#: What goes before a word, by its first byte: a match that ends with the word before hardly goes on into it.
_MARKS = [bytes([1, 2 + c % 8]) for c in range(256)]


def marked(words: list[bytes]) -> bytes:
    """Words as they stand in windows and dictionaries."""
    return b"".join([_MARKS[w[0]] + w for w in words]) + b"\x01"


def _stem_counts(passages: list[list[bytes]], wanted: Counter | None = None) -> tuple[Counter, Counter, int]:
    """How often each stem and each pair of words occurs between different neighbours, at most twice a passage; and all words.

    Pairs are of words that three passages have at least; with ``wanted`` only its pairs are counted.
    """
    counts, pairs, seen, total = Counter(), Counter(), set(), 0
    common = Counter(w for words in passages for w in set(words)) if wanted is None else {}
    for words in passages:
        here, both = Counter(), Counter()
        for around in zip([b"", *words], words, [*words[1:], b""], strict=False):
            if around in seen:
                continue
            seen.add(around)
            total += 1
            for stem in _stems(around[1]):
                here[stem] += here[stem] < 2
            pair = around[1:]
            if pair in wanted if wanted is not None else common[pair[0]] >= 3 and common.get(pair[1], 0) >= 3:
                both[pair] += both[pair] < 2
        counts.update(here)
        pairs.update(both)
    return counts, pairs, total


def _sure(counts: Counter, other: Counter, n_toxic: int, n_ordinary: int) -> set:
    """Stems beyond chance (log likelihood against the share of all words, over the logarithm of the number of stems tried) and ``TIMES`` the ordinary rate."""
    tried = [s for s, k in counts.items() if k >= 3]
    share, least = n_toxic / (n_toxic + n_ordinary), math.log(len(tried) + 1) + 3
    sure = set()
    for stem in tried:
        k, o = counts[stem], other[stem]
        likelihood = k * math.log(k / (k + o) / share) + (o * math.log(o / (k + o) / (1 - share)) if o else 0)
        if k / n_toxic >= TIMES * o / n_ordinary and likelihood >= least:
            sure.add(stem)
    return sure


def over_used(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> tuple[list[bytes], frozenset[tuple[bytes, bytes]]]:
    """Of each toxic passage the words, and pairs of words, that ordinary passages hardly use, marked; and these pairs."""
    counts, pairs, n_toxic = _stem_counts(toxic)
    other, other_pairs, n_ordinary = _stem_counts(ordinary, pairs)
    if not n_toxic or not n_ordinary:
        return [], frozenset()
    sure: set[bytes] = set()
    for inside in (False, True):
        sure |= _sure(Counter({s: k for s, k in counts.items() if s.startswith(_INSIDE) == inside}), other, n_toxic, n_ordinary)
    pairs = frozenset(p for p in _sure(pairs, other_pairs, n_toxic, n_ordinary) if not any(stem in sure for word in p for stem in _stems(word)))
    kept = ([part for w in words for part in _parts(w, sure)] + as_words(words, pairs) for words in toxic)
    return [marked(words) for words in kept if words], pairs


def _parts(word: bytes, sure: set[bytes]) -> list[bytes]:
    """The whole of a word that begins with a sure stem or is one; else its runs of bytes that sure parts cover."""
    found = [stem for stem in _stems(word) if stem in sure]
    if any(not stem.startswith(_INSIDE) for stem in found):
        return [word]
    word, parts = word.removeprefix(_INSIDE), {stem[1:] for stem in found}
    covered, out = bytearray(len(word)), []
    for part in parts:
        at = word.find(part)
        while at >= 0:
            covered[at : at + len(part)] = b"\x01" * len(part)
            at = word.find(part, at + 1)
    for run in re.finditer(rb"\x01+", covered):
        out.append(word[run.start() : run.end()])
    return out


def as_words(words: list[bytes], pairs: frozenset[tuple[bytes, bytes]]) -> list[bytes]:
    """The neighbours among ``words`` that are one of ``pairs``, each as a word in turned bytes, which ordinary text saves nothing on."""
    return [b" ".join(p).translate(_TURNED) for p in zip(words, words[1:], strict=False) if p in pairs] if pairs else []


#: Fixed value: the three repeat offsets that end the header of a trained dictionary.
_REPEATS = b"".join(n.to_bytes(4, "little") for n in (1, 4, 8))


def trained(samples: list[bytes], size: int) -> bytes:
    """The content of a zstandard dictionary trained on the samples; their end if they are too few to train on."""
    try:
        whole = zstandard.train_dictionary(size + 256, samples, k=SEGMENT, d=DMER).as_bytes()
        return whole[whole.index(_REPEATS) + len(_REPEATS) :][-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _slots(data: bytes) -> np.ndarray:
    """A hash of 16 bits of each four bytes in a row."""
    n = max(0, len(data) - 3)
    codes = np.empty(n, np.uint32)
    for at in range(min(4, n)):
        own = codes[at::4]
        own[:] = np.frombuffer(data, "<u4", len(own), at)
    return codes * np.uint32(2654435761) >> np.uint32(16)


@dataclass
class ToxicityModel:
    """The dictionaries, the pairs of words learnt, thresholds of a window's gain, and weights of the evidence.  ``prior`` is the score without a fit."""

    ordinary: bytes = b""
    toxic: bytes = b""
    pairs: frozenset[tuple[bytes, bytes]] = frozenset()
    thresholds: tuple[int, ...] = ()
    weights: list[float] = field(default_factory=list)
    prior: float = 0.0

    def __post_init__(self):
        self._compressors = self._shared = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        """The compressors that know ordinary text, and toxic text as well."""
        if self._compressors is None:
            settings = zstandard.ZstdCompressionParameters(
                window_log=14, chain_log=13, hash_log=13, search_log=4, min_match=MATCH, target_length=16, strategy=zstandard.STRATEGY_LAZY,
                write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
            )
            self._compressors = tuple(
                zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=settings)
                for d in (self.ordinary, self.toxic + self.ordinary)
            )
        return self._compressors

    def windows(self, text: str | None) -> list[bytes]:
        """All windows of a whole text."""
        return [b + b"\n" + self.ordinary[-TAIL:] for b in self.blocks(text)]

    def blocks(self, text: str | None) -> list[bytes]:
        """All windows of a whole text, without their tails."""
        words = words_of(text)
        blocks = [marked(words[i : i + WINDOW]) for i in range(0, len(words), WINDOW)]
        return blocks + [marked([pair]) for pair in as_words(words, self.pairs)]

    def matching(self, blocks: list[bytes]) -> list[bytes]:
        """Those that may match the toxic dictionary: three four-byte strings in a row, hashed, are among its own."""
        if self._shared is None:
            self._shared = np.zeros(1 << 16, bool)
            self._shared[_slots(self.toxic + self.ordinary[: MATCH - 1])] = True
        hits = self._shared[_slots(b"".join(blocks))]
        hits = np.flatnonzero(hits[:-2] & hits[1:-1] & hits[2:])
        ends = np.cumsum(np.fromiter(map(len, blocks), np.int64, len(blocks)))
        return [blocks[i] for i in np.unique(np.searchsorted(ends, hits, "right")).tolist()]

    def gains(self, text: str | None) -> np.ndarray:
        """How many windows of a text have the gain 0 (or less), 1, 2 and so on."""
        blocks, seen, tail = self.blocks(text), np.zeros(MOST + 1, np.int64), b"\n" + self.ordinary[-TAIL:]
        for at in range(0, len(blocks), AT_ONCE):
            part = blocks[at : at + AT_ONCE]
            found = [b + tail for b in self.matching(part)]
            seen[0] += len(part) - len(found)
            if found:
                plain, toxic = (np.array([len(b) for b in c.multi_compress_to_buffer(found)]) for c in self.compressors())
                seen += np.bincount(np.clip(plain - toxic, 0, MOST), minlength=MOST + 1)
        return seen

    def score(self, text: str | None) -> float:
        if not self.weights:
            return self.prior
        z = self.weights[0] + float(np.dot(self.weights[1:], evidence(self.gains(text), self.thresholds)))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def evidence(gains: np.ndarray, thresholds: tuple[int, ...]) -> list[float]:
    """By threshold the number and sum of gains that reach it, by themselves and per window."""
    windows, out = max(1, int(gains.sum())), []
    for t in thresholds:
        n, total = int(gains[t:].sum()), int((gains[t:] * np.arange(t, MOST + 1)).sum())
        out += [math.log1p(n), math.log1p(total), min(1.0, 4 * n / windows), min(1.0, total / windows)]
    return out


def logistic_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, steps: int = 60) -> list[float]:
    """Intercept and weights by Newton steps with a small ridge, the classes weighed by the square root of their odds."""
    x1 = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x1.shape[1])
    heavy = np.where(y == 1, math.sqrt(max(1.0, (y == 0).sum() / max(1, (y == 1).sum()))), 1.0)
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        gradient = x1.T @ (heavy * (p - y)) / len(y) + penalty * w / len(y) * 10
        hessian = (x1 * (heavy * p * (1 - p))[:, None]).T @ x1 / len(y) + np.diag(penalty / len(y) * 10 + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> ToxicityModel:
    """A model from labelled documents whose crc32 of doc_id is not divisible by five.

    A bounded hash sample of each class's labels (about 4 * ``fit_docs`` ids in all, so they are broadcast and texts stay in place) is joined
    by doc_id.  The driver gets passages for dictionaries from one half, and the evidence of whole texts, taken by the executors,
    from the other.
    """
    known = labels.selectExpr("cast(doc_id as long) cw_id", "cast(toxic as int) cw_toxic").where("cw_toxic in (0, 1)")
    known = known.where(id_crc_mod("cw_id", 5) != 0).withColumn("cw_at", hash_fraction("cw_id"))
    # Thresholds of the hash that leave about fit_docs rows for each half of each class, whatever the size of the input.
    n = {r.cw_toxic: r.n for r in known.groupBy("cw_toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return ToxicityModel(prior=float(bool(n.get(1))))
    bound = F.when(F.col("cw_toxic") == 1, min(1.0, 2 * fit_docs / n[1])).otherwise(min(1.0, 2 * fit_docs / n[0]))
    chosen = known.where(F.col("cw_at") < bound).withColumn("cw_fit", F.xxhash64("cw_id", F.lit(7)) % 2 == 0)
    texts = docs.selectExpr("cast(doc_id as long) cw_id", "text").where("text is not null").join(F.broadcast(chosen), "cw_id")
    start = (F.pmod(F.xxhash64("cw_id", F.lit(11)), F.greatest(F.lit(1), F.length("text") - PASSAGE)) + 1).cast("int")
    passages = texts.where("cw_fit").select("cw_toxic", F.substring("text", start, F.lit(PASSAGE)).alias("passage"))
    rows = sorted((r.cw_toxic, r.passage) for r in passages.collect())
    if not rows or rows[0][0] == rows[-1][0]:
        return ToxicityModel(prior=n[1] / (n[0] + n[1]))
    by_class = {c: [words_of(p) for toxic, p in rows if toxic == c] for c in (0, 1)}
    model = _with_dictionaries(by_class[1], by_class[0])
    model.prior = n[1] / (n[0] + n[1])
    if not model.toxic:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gains = [shared.value.gains(t.as_py()).tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gains, pa.list_(pa.int64()))], ["cw_toxic", "gains"])

    seen = texts.where("not cw_fit").select("cw_toxic", "text").mapInArrow(run, "cw_toxic int, gains array<long>").collect()
    return _calibrated(model, sorted((r.cw_toxic, r.gains) for r in seen))


def _calibrated(model: ToxicityModel, seen: list[tuple[int, list[int]]]) -> ToxicityModel:
    """The model with the best thresholds, and the weights for these, from (class, gains) of texts that the dictionaries have not seen."""
    y = np.array([c for c, _ in seen], dtype=np.float64)
    if not len(seen) or not 0 < y.sum() < len(y):
        return model
    half, least = np.arange(len(y)) % 2 == 0, math.inf
    for thresholds in THRESHOLDS:
        x, loss = np.array([evidence(np.array(g), thresholds) for _, g in seen]), 0.0
        for own in (half, ~half):
            w = np.array(logistic_weights(x[own], y[own]))
            z = np.clip(w[0] + x[~own] @ w[1:], -30, 30)
            loss += float(np.log1p(np.exp(np.where(y[~own] == 1, -z, z))).sum())
        if loss < least:
            least, model.thresholds, model.weights = loss, thresholds, logistic_weights(x, y)
    return model


def _with_dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> ToxicityModel:
    """The two trained dictionaries; the toxic one is empty if nothing is over-used."""
    samples = [marked(words[i : i + 12]) for words in ordinary for i in range(0, len(words), 12)]
    samples = sorted(samples, key=lambda x: (zlib.crc32(x), x))[:SAMPLES]  # a pseudo-random choice, the same each time
    plain = b"\x01" + trained(samples, ORDINARY_BYTES).rjust(TAIL, b"#")
    words, pairs = over_used(toxic, ordinary)
    return ToxicityModel(ordinary=plain, toxic=trained(words, TOXIC_BYTES) if words else b"", pairs=pairs)


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score and predicted for each row: a narrow map over Arrow batches; the model is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [shared.value.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())],
                ["doc_id", "held_out", "score", "predicted"],
            )

    marked = docs.selectExpr("cast(doc_id as long) doc_id", "text").withColumn("held_out", F.coalesce(id_crc_mod("doc_id", 5) == 0, F.lit(False)))
    return marked.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not predicted toxic."""
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(t.as_py()) < 0.5 for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
