"""Hierarchical packing of token documents into sequences of several lengths.

Windows come in tiers (by default 64 to 2048 tokens, powers of two).  A document longer than the top tier gives full
top windows; its rest, like any shorter document, is routed to the smallest tier that holds it.  Each tier is packed by best
fit in falling order of length; what a window leaves open is filled from shorter tiers, with whole pieces while
they fit and a cut piece at last.  So every window is exactly full, except the last one of a task, and a full
window needs no padding because its length is a power of two.  The windows of a packing round are dealt
to step groups of nearly equal token counts.

Defined cases: null and empty text is a document of one token (the end id); repeated rows are packed each by itself; a null
doc_id is carried; text of any length is cut, never dropped; an empty table gives no pieces; other columns are ignored.

Tokens are made and packed in one narrow map over the scan: nothing is shuffled, and a task holds at most
``ROUND`` windows of tokens besides the document at hand.
"""

from __future__ import annotations

import bisect
import heapq
import json
import os
import re
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from .byte_bpe import byte_characters

TIERS = (64, 128, 256, 512, 1024, 2048)
END_ID = 1
#: Top-tier windows of pending tokens that start a packing round, and tokens of a step group in top-tier windows.
ROUND, STEP = 64, 8
#: Distinct words whose ids a Python worker remembers, and bytes of them and their ids, about; the memory is emptied beyond that.
REMEMBERED, REMEMBERED_BYTES = 600_000, 64 << 20

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long"
)

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Before sentence punctuation that ends a word and follows a letter or digit: the tokenizer always splits there (not after İ, whose lower case ends with a mark).
_TAIL = re.compile(r"(?<=[^\W_İ])(?=[.,!?;:]+(?:[ \n]|$))")


class WordTokenizer:
    """Ids of texts by a ``tokenizers`` file that drops white space and never joins text across it.

    Such a tokenizer treats the words of a text one by one, so the ids of a text are those of its words; each distinct word goes
    through the library once.  Words that normalisation leaves as they are and that consist of letters only are one pre-token each; those go
    straight to the file's merge model, many at a time, and the marks of word ends in its pieces tell their ids apart.  A text that holds a
    string of an added token goes through the library as a whole, because such strings are split out before words are.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        self._tokenizer = Tokenizer.from_file(path)
        self.remembered, self._bytes = remembered, 0
        self._known: dict[str, bytes] = {"": b""}
        added = sorted({t.content.lower() for t in self._tokenizer.get_added_tokens_decoder().values()})
        self._added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE)
        kept = json.loads(self._tokenizer.to_str())
        end, steps = kept["model"].get("end_of_word_suffix"), kept["pre_tokenizer"].get("pretokenizers", [])
        self._merges = None
        if end and steps and steps[-1]["type"] == "ByteLevel" and not steps[-1]["add_prefix_space"]:
            self._merges = Tokenizer(self._tokenizer.model)
            self._merges.pre_tokenizer = WhitespaceSplit()
            vocabulary = self._tokenizer.get_vocab()
            self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self._ends[[i for piece, i in vocabulary.items() if piece.endswith(end)]] = True
            self._table = dict(enumerate(byte_characters()))

    def _learn(self, words: list[str]) -> None:
        known, plain, mapped, other = self._known, [], [], []
        for w in words:
            if self._merges is not None and w.isalpha() and w == w.lower() and is_normalized("NFC", w):
                plain.append(w)
                mapped.append(w if w.isascii() else w.encode().decode("latin-1").translate(self._table))
            else:
                other.append(w)
        for at in range(0, len(plain), 100):
            part = plain[at : at + 100]
            ids = np.array(self._merges.encode_batch_fast([" ".join(mapped[at : at + 100])], add_special_tokens=False)[0].ids, "<u4")
            raw, begin = ids.tobytes(), 0
            ends = (4 * (np.flatnonzero(self._ends[ids]) + 1)).tolist()
            for w, end in zip(part, ends, strict=True):
                known[w] = raw[begin:end]
                begin = end
        for at in range(0, len(other), 1000):
            part = other[at : at + 1000]
            for w, e in zip(part, self._tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, "<u4").tobytes()

    def ids(self, text: str) -> np.ndarray:
        if self._added.search(text):
            return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        low = text.lower() if text.isascii() else text.encode().translate(_LOWER).decode()
        words = _TAIL.sub(" ", low).replace("\n", " ").split(" ")
        known = self._known
        new = [w for w in set(words) if w not in known]
        if new:
            if len(known) + len(new) > self.remembered or self._bytes > REMEMBERED_BYTES:
                known.clear()
                known[""] = b""
                new, self._bytes = [w for w in set(words) if w], 0
            self._learn(new)
            self._bytes += 8 * sum(map(len, new))
        return np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4")


_loaded: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a file, loaded once in a Python worker."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


class Piece:
    """Tokens ``start`` to ``start + len(ids)`` of a document."""

    __slots__ = ("doc_id", "start", "ids", "total")

    def __init__(self, doc_id, start, ids, total):
        self.doc_id, self.start, self.ids, self.total = doc_id, start, ids, total

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[:n], self.total), Piece(self.doc_id, self.start + n, self.ids[n:], self.total)


class Shelf:
    """Pieces in order of length; takes out the longest that fits."""

    def __init__(self):
        self._lengths: list[int] = []
        self._pieces: list[Piece] = []

    def __len__(self) -> int:
        return len(self._pieces)

    def add(self, piece: Piece) -> None:
        at = bisect.bisect_left(self._lengths, len(piece.ids))
        self._lengths.insert(at, len(piece.ids))
        self._pieces.insert(at, piece)

    def longest(self, most: int) -> Piece | None:
        at = bisect.bisect_right(self._lengths, most) - 1
        if at < 0:
            return None
        del self._lengths[at]
        return self._pieces.pop(at)


class Packer:
    """Pending pieces of one task.  ``put`` and ``finish`` give windows: (tier, pieces, step group)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, round_windows: int = ROUND, step_windows: int = STEP):
        self.tiers, self.top = tuple(sorted(tiers)), max(tiers)
        self.limit, self.step = round_windows * self.top, step_windows * self.top
        self.shelves = {tier: Shelf() for tier in self.tiers}
        self.pending, self.full, self.steps = 0, [], 0

    def put(self, doc_id, ids: np.ndarray) -> Iterator[tuple[int, list[Piece], int]]:
        whole = Piece(doc_id, 0, ids, len(ids))
        while len(whole.ids) >= self.top:
            head, whole = whole.cut(self.top)
            self.full.append((self.top, [head]))
            self.pending += self.top
            if self.pending >= self.limit:
                yield from self._round()
        if len(whole.ids):
            self._route(whole)
            self.pending += len(whole.ids)
        if self.pending >= self.limit:
            yield from self._round()

    def _route(self, piece: Piece) -> None:
        self.shelves[self.tiers[bisect.bisect_left(self.tiers, len(piece.ids))]].add(piece)

    def _fill(self, tier: int, window: list[Piece], room: int) -> int:
        """Fills a window from its own tier and the shorter ones, whole pieces first, then a cut one; the room that stays."""
        for shorter in reversed([t for t in self.tiers if t <= tier]):
            while room and (piece := self.shelves[shorter].longest(room)):
                window.append(piece)
                room -= len(piece.ids)
        if room:
            for other in self.tiers:
                if piece := self.shelves[other].longest(self.top):
                    head, tail = piece.cut(room)
                    window.append(head)
                    self._route(tail)
                    return 0
        return room

    def _round(self) -> Iterator[tuple[int, list[Piece], int]]:
        """Packs every tier, longest windows first; pieces that would leave a window open stay pending."""
        windows, self.full = self.full, []
        for tier in reversed(self.tiers):
            shelf = self.shelves[tier]
            while len(shelf) and self._left() >= tier:
                first = shelf.longest(tier)
                window = [first]
                if self._fill(tier, window, tier - len(first.ids)):
                    raise AssertionError("a window stayed open although tokens were pending")
                windows.append((tier, window))
        self.pending = self._left()
        yield from self._grouped(windows)

    def _left(self) -> int:
        return sum(sum(shelf._lengths) for shelf in self.shelves.values())

    def _grouped(self, windows: list[tuple[int, list[Piece]]]) -> Iterator[tuple[int, list[Piece], int]]:
        """Deals windows to step groups, each window in falling order of tokens to the lightest group."""
        total = sum(tier for tier, _ in windows)
        groups = max(1, round(total / self.step))
        heap = [(0, g) for g in range(groups)]
        for tier, window in sorted(windows, key=lambda w: -w[0]):
            load, g = heap[0]
            heapq.heapreplace(heap, (load + tier, g))
            yield tier, window, self.steps + g
        if windows:
            self.steps += groups

    def finish(self) -> Iterator[tuple[int, list[Piece], int]]:
        """All that is pending: full windows of the tiers in falling order, then one open window, to be padded."""
        yield from self._round()
        rest = []
        for tier in self.tiers:
            while piece := self.shelves[tier].longest(tier):
                rest.append(piece)
        left, windows = sum(len(p.ids) for p in rest), []
        for tier, least in [*((t, t) for t in reversed(self.tiers)), (self.top, 1)]:
            while left >= least:
                window, room = [], min(tier, left)
                while room:
                    piece = rest.pop()
                    if len(piece.ids) > room:
                        piece, tail = piece.cut(room)
                        rest.append(tail)
                    window.append(piece)
                    room -= len(piece.ids)
                    left -= len(piece.ids)
                windows.append((tier, window))
        yield from self._grouped(windows)


def pack_documents(docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row per piece of a document: where it starts there, its length, and its sequence and place in it.

    ``sequence_id`` holds the task's partition in its upper bits, so the input has to be read the same way again if a task
    is repeated: it should be a scan or a written table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer = word_tokenizer(tokenizer_path), Packer(tiers)
        base = TaskContext.get().partitionId() << 33
        end, sequence = np.array([END_ID], "<u4"), 0
        rows: list[tuple] = []

        def place(windows) -> None:
            nonlocal sequence
            for tier, window, step in windows:
                offset = 0
                for p in window:
                    n = len(p.ids)
                    rows.append((p.doc_id, p.start, n, zlib.crc32(p.ids.tobytes()), p.total, base + sequence, offset, tier, base + step))
                    offset += n
                sequence += 1

        def drained() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * 9
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if i == 7 else pa.int64()) for i, c in enumerate(columns)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                place(packer.put(doc_id, np.concatenate([tokenizer.ids(text.as_py() or ""), end])))
                if len(rows) >= 20_000:
                    yield drained()
        place(packer.finish())
        yield drained()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
