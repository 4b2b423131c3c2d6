"""Near-duplicate documents: SetSketch registers, bands, joint likelihood, exact verification, components.

A document's set holds the hashes of its distinct five-word shingles.  Documents with the same set are one class (similarity 1);
all further work is on classes.  A class has a SetSketch: ``REGISTERS`` truncated minima of hashed values, read on an
exponential scale, so that registers of a union are the maxima of its parts' registers, and two registers agree about as often as the
sets overlap.  Runs of ``ROWS`` registers are bands; classes that share a band meet in a bucket.

Pairs are found without listing a bucket's pairs.  Each bucket has a pivot, its smallest class:
1. every class is compared with the pivot it shares most bands with, and the links give components;
2. it is compared with its other pivots, if they are in another component;
3. buckets whose classes are still in several components are looked at once more.  A class of which so many shingles occur in no other such
   class that nothing can be similar to it is left out.  The others are grouped by the buckets they share, and classes of a group
   in different components are compared exactly, a block of classes with a block, by counting common shingles as a matrix product.
So a group of near copies, however large, costs a few comparisons for each member, and only groups in which classes stayed apart that have
little of their own are compared further; no link within a bucket between components is missed.  A comparison estimates the similarity from both registers and
both set sizes by maximum likelihood; pairs above a bound five standard errors below the threshold are verified on the
full sets.  At the threshold a pair shares no band with probability 2e-5.

Comparisons run in tasks that stream the members of a pivot past it; a pivot with many members is dealt to several tasks.

Texts are not shuffled: rows are picked where they are, by bitmaps of their numbers (a bit a row, or a shuffle where those would be too many).

Defined cases: null text, and text without a word, is linked with nothing (n_shingles 0, its own component, kept); with fewer than
five words the whole sequence is the one shingle; null doc_ids are compared like others, are never a component's id unless all of its
doc_ids are null, and are not kept then; rows that repeat a doc_id are judged by their own text and share a component's id; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, scratch, written

#: Similarity of links in hundredths, words of a shingle.
PERCENT, WORDS = 75, 5
#: Registers, registers of a band; base and rate of the register scale.
REGISTERS, ROWS = 200, 5
BASE, RATE = 1.001, 20.0
#: Pairs are verified if the estimate is this much below the threshold at most (five standard errors).
SLACK = 0.16
#: Tasks that the members of one pivot are dealt to at most.
SALTS = 64
#: Shingles and classes of a block of classes, about, and columns of a matrix product at once.
BLOCK_SHINGLES, BLOCK_CLASSES, CHUNK = 65_536, 2048, 4096
#: Row numbers of a bitmap (2 to this power; 4096 bytes, as Spark makes them), and bitmaps (32 MB in all) that are broadcast at most.
BITMAP_POWER, BITMAPS = 15, 8192

_random = np.random.default_rng(20_240_501)
_BYTE = _random.integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_FACTORS = _random.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_ORDER = _random.integers(0, 1 << 64, WORDS, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


def _mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value scrambled, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse, at least ``n``; a worker keeps those of texts up to four million bytes."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        both = []
        for base in (_STEP, _STEP_BACK):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        if size > 1 << 22:
            return both[0], both[1]
        _powers[:] = both
    return _powers[0], _powers[1]


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    if not text:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(text.encode().lower(), np.uint8)  # bytes.lower() changes A-Z only
    space = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    up, down = _powers_of(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    word = _mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    n = max(1, len(word) - WORDS + 1)
    shingle = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(word))):
        shingle = shingle * _STEP + word[k : k + n] * _ORDER[k]
    return np.unique(_mixed(shingle + np.uint64(min(WORDS, len(word)))))


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers (16 bits) of a set that is not empty."""
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(low, np.multiply.outer(_FACTORS, x[at : at + 2048]).min(axis=1), out=low)
    spaced = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32) / RATE  # the minimum of exponentials
    return np.clip(np.floor(1 - np.log(spaced) / np.log(BASE)), 0, 65535).astype(np.uint16)


def estimate(u: np.ndarray, v: np.ndarray, n_u: int, n_v: int) -> float:
    """The similarity that makes the order of two sketches' registers likeliest, given the sizes of the sets."""
    above, below = int((u > v).sum()), int((u < v).sum())
    same = len(u) - above - below
    a, b = n_u / (n_u + n_v), n_v / (n_u + n_v)
    j = np.linspace(0, min(a / b, b / a), 201)
    chance = lambda x: -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / np.log(BASE)
    p, q = chance(a - b * j), chance(b - a * j)
    return float(j[int((above * np.log(p) + below * np.log(q) + same * np.log(np.clip(1 - p - q, 1e-9, 1))).argmax())])


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """The number of common values of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum())


def _linked(n_x: int, n_y: int, common: int) -> bool:
    return 100 * common >= PERCENT * (n_x + n_y - common)


def numbered(docs: DataFrame) -> DataFrame:
    """A written copy of the rows with their number, cw_row, by which they are known whatever their doc_id is."""
    return written(docs.withColumn("cw_row", F.monotonically_increasing_id()), keep=True)


def _picked(rows: DataFrame, wanted: DataFrame, keep: bool = False) -> DataFrame:
    """The numbered rows whose cw_row is in the one column of ``wanted``; ``keep`` as in :func:`written`.

    The numbers go to the rows as broadcast bitmaps, for the rows are much larger; with more than ``BITMAPS`` of them both sides are shuffled.
    """
    number = F.col(wanted.columns[0])
    # Dealt by bitmap first: partial bitmaps in every task would be tasks times bitmaps.
    dealt = wanted.select(F.shiftright(number, BITMAP_POWER).alias("cw_at"), F.pmod(number, F.lit(1 << BITMAP_POWER)).alias("place")).repartition("cw_at")
    bitmaps = written(dealt.groupBy("cw_at").agg(F.bitmap_construct_agg("place").alias("cw_bits")), keep)
    if bitmaps.count() > BITMAPS:
        drop_written(bitmaps)
        return rows.join(wanted, F.col("cw_row") == number, "left_semi")
    place = f"cast(pmod(cw_row, {1 << BITMAP_POWER}) as int)"
    there = F.expr(f"getbit(cast(conv(hex(substring(cw_bits, {place} div 8 + 1, 1)), 16, 10) as int), {place} % 8) = 1")
    return rows.join(F.broadcast(bitmaps), (F.shiftright("cw_row", BITMAP_POWER) == F.col("cw_at")) & there, "left_semi")


def sketch_documents(docs: DataFrame) -> DataFrame:
    """cw_row, doc_id, n, set_id (128 bits) and sketch of every numbered row; sketch is null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids, sketches = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py())
                sizes.append(len(s))
                ids.append(xxhash.xxh3_128_digest(s.tobytes()))
                sketches.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(sketches, pa.binary())],
                ["cw_row", "doc_id", "n", "set_id", "sketch"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text", "cw_row").mapInArrow(run, "cw_row long, doc_id long, n long, set_id binary, sketch binary")


def _compared(pairs: DataFrame, values: DataFrame, keep: Callable[[bytes, int, bytes, int], bool]) -> DataFrame:
    """The pairs (a, b) that ``keep`` accepts, given value and n of both from ``values`` (node, n, value).

    Members stream past their b, which is sent once to each of the tasks that its members are dealt to.
    """
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int").alias("salt"))
    members = dealt.join(values, F.col("a") == F.col("node")).select("b", "salt", F.lit(1).alias("kind"), "a", "n", "value")
    heads = dealt.select("b", "salt").distinct().join(values, F.col("b") == F.col("node"))
    heads = heads.select("b", "salt", F.lit(0).alias("kind"), F.col("b").alias("a"), "n", "value")
    rows = members.unionByName(heads).repartition("b", "salt").sortWithinPartitions("b", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            b, kind, a, n = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
            value, left, right = batch.column(5), [], []
            for i in range(len(a)):
                own = value[i].as_py()
                if kind[i] == 0:
                    head = b[i], own, n[i]
                elif head[0] == b[i] and keep(own, n[i], head[1], head[2]):
                    left.append(a[i])
                    right.append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _likely(x: bytes, n_x: int, y: bytes, n_y: int) -> bool:
    least = PERCENT / 100 - SLACK
    if min(n_x, n_y) < PERCENT / 100 * max(n_x, n_y):  # too unequal in size whatever they share
        return False
    u, v = np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16)
    return estimate(u, v, n_x, n_y) >= least


def _verified(x: bytes, n_x: int, y: bytes, n_y: int) -> bool:
    return _linked(n_x, n_y, overlap(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, n and value (the full set) of the wanted classes (one column), from the whole text of the numbered row that each is named by."""
    rows = _picked(docs.select("cw_row", "text"), wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "n", "value"]
            )

    return rows.mapInArrow(run, "node long, n long, value binary")


def connected(edges: DataFrame) -> DataFrame:
    """node and comp (the smallest node that it reaches) of all nodes of the edges (a, b).

    Labels are passed along edges and shortened by jumping to the label's label; each round is a written table.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("m"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("comp").alias("was"), F.least("comp", "m").alias("comp"))
        lower = written(lower)
        jump = lower.select(F.col("node").alias("at"), F.col("comp").alias("next"))
        after = written(lower.join(jump, F.col("comp") == F.col("at")).select("node", "was", F.col("next").alias("comp")))
        moved = not after.where("was <> comp").isEmpty()
        drop_written(labels, lower)
        labels = after.select("node", "comp")
        labels._chronoweave_path = after._chronoweave_path
        if not moved:
            drop_written(both)
            return labels


class _Linker:
    """Components of classes so far, and the means to compare further pairs."""

    def __init__(self, docs: DataFrame, nodes: DataFrame):
        self.docs, self.nodes, self.labels = docs, nodes, None
        self.sketches = nodes.select("node", "n", F.col("sketch").alias("value"))
        self.sets: DataFrame | None = None

    def comp(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """``df`` with the component of a node column; classes without links are their own."""
        if self.labels is None:
            return df.withColumn(name, F.col(column))
        labels = self.labels.select(F.col("node").alias(f"{name}_node"), F.col("comp").alias(f"{name}_comp"))
        out = df.join(labels, F.col(column) == F.col(f"{name}_node"), "left")
        return out.withColumn(name, F.coalesce(f"{name}_comp", column)).drop(f"{name}_node", f"{name}_comp")

    def apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose classes are in different components."""
        if self.labels is None:
            return pairs
        return self.comp(self.comp(pairs, "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b")

    def load(self, ends: DataFrame) -> None:
        """Makes the sets of the given classes (end), as far as they are not there."""
        if self.sets is not None:
            ends = ends.join(self.sets.select(F.col("node").alias("had")), F.col("end") == F.col("had"), "left_anti")
        more = written(_sets(self.docs, ends))
        self.sets = more if self.sets is None else self.sets.unionByName(more)

    def link(self, pairs: DataFrame) -> None:
        """Compares pairs and merges the components of those that are linked."""
        likely = written(_compared(pairs, self.sketches, _likely))
        if likely.isEmpty():
            drop_written(likely)
            return
        self.load(likely.select(F.explode(F.array("a", "b")).alias("end")).distinct())
        self.merge(_compared(likely, self.sets, _verified))
        drop_written(likely)

    def merge(self, links: DataFrame) -> None:
        """Merges the components of linked classes (a, b)."""
        links = written(links)
        if links.isEmpty():
            drop_written(links)
            return
        if self.labels is None:
            self.labels = connected(links)
        else:
            joined = connected(self.comp(self.comp(links, "a", "ca"), "b", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
            old = self.labels
            met = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            known = old.unionByName(met.join(old, "node", "left_anti").select("node", F.col("node").alias("comp")))
            to = joined.select(F.col("node").alias("old"), F.col("comp").alias("new"))
            self.labels = written(known.join(to, F.col("comp") == F.col("old"), "left").select("node", F.coalesce("new", "comp").alias("comp")))
            drop_written(old, joined)
        drop_written(links)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row, as a written table; the tables made on the way are deleted."""
    rows = numbered(docs.select("doc_id", "text"))
    with scratch(docs.sparkSession):
        out = written(_judged(rows), keep=True)
    drop_written(rows)
    return out


def _labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sketched rows of numbered documents, and of every class set_id, node (the row of its first document), doc_id, low (its smallest id) and comp."""
    sketched = written(sketch_documents(docs))
    classes = sketched.where("n > 0").groupBy("set_id").agg(
        F.min_by(F.struct("cw_row", "doc_id"), F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), "cw_row")).alias("first"), F.min("doc_id").alias("low")
    )
    classes = written(classes.select("set_id", F.col("first.cw_row").alias("node"), F.col("first.doc_id").alias("doc_id"), "low"))
    nodes = written(_picked(sketched, classes.select("node")).select(F.col("cw_row").alias("node"), "n", "sketch"))

    bands = REGISTERS // ROWS
    each = nodes.select("node", "n", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"), "sketch")
    each = each.select("node", "n", F.expr(f"xxhash64(band, substring(sketch, band * {2 * ROWS} + 1, {2 * ROWS}))").alias("bucket"))
    pivots = each.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("met")).where("met > 1").select(F.col("bucket").alias("at"), "pivot")
    met = written(each.join(pivots, F.col("bucket") == F.col("at")).select("bucket", "node", "n", "pivot"))

    linker = _Linker(docs, nodes)
    stars = met.where("node <> pivot").groupBy(F.col("node").alias("a"), F.col("pivot").alias("b")).agg(F.count("*").alias("shared"))
    best = stars.groupBy("a").agg(F.max_by("b", F.struct("shared", -F.col("b"))).alias("b"))
    linker.link(best)
    tried = best.select(F.col("a").alias("ta"), F.col("b").alias("tb"))
    others = stars.select("a", "b").join(tried, (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")), "left_anti")
    linker.link(linker.apart(others))
    linker.merge(_left_over(linker, met))

    return sketched, linker.comp(classes, "node", "comp")


def _judged(docs: DataFrame) -> DataFrame:
    sketched, labelled = _labelled(docs)
    lows = labelled.groupBy(F.col("comp").alias("c")).agg(F.min("low").alias("lowest"))
    owners = labelled.join(lows, F.col("comp") == F.col("c")).select(F.col("set_id").alias("own_set"), "lowest")
    out = sketched.select("doc_id", "n", "set_id").join(owners, (F.col("set_id") == F.col("own_set")) & (F.col("n") > 0), "left")
    component = F.when(F.col("n") > 0, F.col("lowest")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.when(F.col("n_shingles") == 0, F.lit(True)).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))))


def _shared_counts(sets: DataFrame) -> DataFrame:
    """node and ``common``, the number of its shingles that another class of ``sets`` has too; rows of two numbers are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shingles = np.frombuffer(value.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(shingles), pa.array(np.full(len(shingles), node))], ["shingle", "node"])

    rows = sets.select("node", "value").mapInArrow(run, "shingle long, node long")
    alone = rows.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("other")).where("node = other")
    own = alone.groupBy(F.col("node").alias("owner")).agg(F.count("*").alias("own"))
    counted = sets.select("node", "n").join(own, F.col("node") == F.col("owner"), "left")
    return counted.select("node", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common"))


def _left_over(linker: _Linker, met: DataFrame) -> DataFrame:
    """Links (a, b) between components of classes that share a bucket, as many as are needed to merge them."""
    members = linker.comp(linker.comp(met, "node", "cn"), "pivot", "cp")
    open_buckets = members.where("cn <> cp").select(F.col("bucket").alias("at")).distinct()
    inside = written(members.join(open_buckets, F.col("bucket") == F.col("at"), "left_semi").select("bucket", "node", "n", "cn"))
    nodes = written(inside.select(F.col("node").alias("end")).distinct())
    linker.load(nodes)
    common = _shared_counts(linker.sets.join(nodes, F.col("node") == F.col("end"), "left_semi"))
    able = inside.join(common.select(F.col("node").alias("of"), "common"), F.col("node") == F.col("of"))
    able = written(able.where(100 * F.col("common") >= PERCENT * F.col("n")).select("bucket", "node", "n", "cn"))
    apart = able.groupBy(F.col("bucket").alias("at")).agg(F.min("node").alias("head"), F.min("cn").alias("low"), F.max("cn").alias("high"))
    edges = able.join(apart.where("low <> high").select("at", "head"), F.col("bucket") == F.col("at")).select(F.col("node").alias("a"), F.col("head").alias("b"))
    grouped = connected(edges.distinct()).select(F.col("node").alias("of"), F.col("comp").alias("group"))
    rows = able.select("node", "n", "cn").distinct().join(grouped, F.col("node") == F.col("of")).select("node", "n", "cn", "group")
    blocks = F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_CLASSES)).cast("int").alias("blocks")
    rows = rows.join(rows.groupBy(F.col("group").alias("g")).agg(blocks), F.col("group") == F.col("g"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    sent = rows.select("group", "node", "cn", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    sent = sent.select("group", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "cn", "own")
    values = linker.sets.select(F.col("node").alias("of"), "value")
    sent = sent.join(values, F.col("node") == F.col("of")).select("group", "lo", "hi", "node", "cn", "own", "value")
    sent = sent.repartition("group", "lo", "hi").sortWithinPartitions("group", "lo", "hi", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, []

        def result() -> pa.RecordBatch:
            a, b = _merging_links(block, now[1] if now else 0, now[2] if now else 0)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            node, comp, own = (batch.column(i).to_pylist() for i in (3, 4, 5))
            for i, key in enumerate(keys):
                if key != now:
                    yield result()
                    now, block = key, []
                block.append((node[i], comp[i], own[i], np.frombuffer(batch.column(6)[i].as_py(), np.uint64)))
        yield result()

    return sent.mapInArrow(run, "a long, b long")


def _merging_links(block: list[tuple[int, int, int, np.ndarray]], lo: int, hi: int) -> tuple[list[int], list[int]]:
    """Of classes (node, component, block, set) the links that merge components, between block ``lo`` and block ``hi``."""
    left = [x for x in block if x[2] == lo]
    right = [x for x in block if x[2] == hi]
    if not left or not right:
        return [], []
    common = np.zeros((len(left), len(right)), np.float32)  # whole numbers below 2^24: exact
    here = np.concatenate([x[3] for x in block])
    values, times = np.unique(here, return_counts=True)
    values = values[times > 1]  # a shingle of one class counts for no pair

    def places(side: list) -> tuple[np.ndarray, np.ndarray]:
        flat, of = np.concatenate([x[3] for x in side]), np.repeat(np.arange(len(side)), [len(x[3]) for x in side])
        at = np.searchsorted(values, flat)
        known = (at < len(values)) & (values[np.minimum(at, len(values) - 1)] == flat) if len(values) else np.zeros(len(flat), bool)
        order = np.argsort(at[known], kind="stable")
        return at[known][order], of[known][order]

    (at_l, of_l), (at_r, of_r) = places(left), places(right)
    for start in range(0, len(values), CHUNK):
        width = min(CHUNK, len(values) - start)
        pair = []
        for at, of, rows in ((at_l, of_l, len(left)), (at_r, of_r, len(right))):
            i, j = np.searchsorted(at, [start, start + width])
            dense = np.zeros((rows, width), np.float32)
            dense[of[i:j], at[i:j] - start] = 1
            pair.append(dense)
        common += pair[0] @ pair[1].T
    n_l, n_r = (np.array([len(x[3]) for x in side]) for side in (left, right))
    comp_l, comp_r = (np.array([x[1] for x in side]) for side in (left, right))
    found = (100.0 * common.astype(np.float64) >= PERCENT * (n_l[:, None] + n_r[None, :] - common.astype(np.float64))) & (comp_l[:, None] != comp_r[None, :])
    root: dict[int, int] = {}

    def top(c: int) -> int:
        while root.get(c, c) != c:
            c = root[c]
        return c

    a, b = [], []
    for i, j in zip(*np.nonzero(found), strict=True):
        x, y = top(int(comp_l[i])), top(int(comp_r[j]))
        if x != y:
            root[max(x, y)] = min(x, y)
            a.append(left[i][0])
            b.append(right[j][0])
    return a, b


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns: one of each component, with its smallest doc_id (null if all are), and all that are linked with nothing.

    Rows are judged by a number that they get in a written copy, not by doc_id, which may be null or repeated.
    """
    rows = numbered(docs)
    with scratch(docs.sparkSession):
        sketched, labelled = _labelled(rows)
        first = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), F.col("node").alias("row"))).alias("first")
        stay = labelled.groupBy("comp").agg(first).select(F.col("first.row").alias("cw_stay"))
        stay = written(stay.unionByName(sketched.where("n = 0").select(F.col("cw_row").alias("cw_stay"))), keep=True)
        kept = _picked(rows, stay, keep=True)
    return kept.drop("cw_row")
