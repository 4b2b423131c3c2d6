"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Equal texts form a group that has to stay in one shard.  Groups are put, largest first, into the bin with the tightest room that
holds them, found in a balanced tree of rooms; a search over the capacity gives the least at which a given number of bins
suffices.  So shards get nearly equal bytes, or, for a fixed capacity, the number of shards is small.

The driver packs a histogram, not the groups: groups of equal size are interchangeable, so best fit puts runs of them into bins.  There are
at most sqrt(2 * all bytes) different sizes.  In falling order of size, and by number among equals, the groups of a bin
form a few ranges; a group finds its bin by its place in that order.  Only groups of a size that several bins share are numbered, in parts, each of which starts
where the one before it ends.  A group larger than a shard's fair share gets a shard that nothing else enters while others have room.
Groups with many copies are joined by broadcast (at most ``PARTS`` can have a share of 1/``PARTS`` of the rows), the others by a shuffle of 60 bytes a row.

Defined cases: null text has no bytes and is a group with other null texts; an empty text is another; repeated rows are in
the same shard and each gets a slot; null doc_ids are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch, written

#: Parts in which equal sizes and the rows of a shard are numbered; a group with this share of all rows is joined by broadcast.
PARTS = 1024


class RoomTree:
    """Bins in order of (room, number): a treap with fixed priorities, so that it is balanced whatever comes in."""

    __slots__ = ("_root",)

    def __init__(self):
        self._root = None  # node: [key, priority, left, right]

    @staticmethod
    def _priority(key: tuple[int, int]) -> int:
        return hash((key[1], key[0], 0x9E3779B97F4A7C15)) & 0xFFFFFFFF

    def _split(self, node, key):
        """Nodes below ``key`` and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], high = self._split(node[3], key)
            return node, high
        low, node[2] = self._split(node[2], key)
        return low, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, room: int, number: int) -> None:
        key = (room, number)
        low, high = self._split(self._root, key)
        self._root = self._merge(self._merge(low, [key, self._priority(key), None, None]), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the bin with the least room of at least ``size``."""
        node, found = self._root, None
        while node is not None:
            if node[0] >= (size, -1):
                found, node = node[0], node[2]
            else:
                node = node[3]
        if found is not None:
            low, high = self._split(self._root, found)
            _, high = self._split(high, (found[0], found[1] + 1))
            self._root = self._merge(low, high)
        return found


def best_fit_runs(sizes: list[tuple[int, int]], capacity: int, most_bins: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """Runs (size, first, count, bin) of items, given (size, count) in falling order of size, or None if ``most_bins`` do not suffice.

    The bin that is tightest for an item is so for the next one of the same size while it holds it, so equal items are put in runs.  An
    item larger than the capacity gets a bin of its own.
    """
    tree, bins, out = RoomTree(), 0, []
    for size, count in sizes:
        first = 0
        while first < count:
            found = tree.take_tightest(size) if size <= capacity else None
            if found is None:
                if most_bins is not None and bins == most_bins:
                    return None
                found, bins = (max(capacity, size), bins), bins + 1
            n = min(count - first, found[0] // size)
            out.append((size, first, n, found[1]))
            first += n
            if found[0] - n * size > 0:
                tree.add(found[0] - n * size, found[1])
    return out


def best_fit_decreasing(sizes: list[int], capacity: int, most_bins: int | None = None) -> list[int] | None:
    """The bin of each item, items given in falling order of size, or None if ``most_bins`` do not suffice."""
    runs = best_fit_runs([(s, 1) for s in sizes], capacity, most_bins)
    return None if runs is None else [b for _, _, _, b in runs]


def balanced_runs(sizes: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int, int]]:
    """Runs for the least capacity, to a thousandth of a fair share, at which best fit needs at most ``bins`` bins."""
    if not sizes:
        return []
    fair = -(-sum(size * count for size, count in sizes) // bins)
    low, high = max(fair, 1), sizes[0][0] + fair  # best fit never opens a bin while another has room for an item below the largest
    best = None
    while best is None:
        best = best_fit_runs(sizes, high, bins)
        high = high if best is not None else 2 * high
    while high - low > max(1, fair // 1000):
        middle = (low + high) // 2
        found = best_fit_runs(sizes, middle, bins)
        if found is None:
            low = middle + 1
        else:
            best, high = found, middle
    return best


def _numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with their number from 0 among those with the same ``key``; numbers are made in parts, dealt by cw_row."""
    dealt = rows.withColumn("cw_part", F.pmod(F.xxhash64("cw_row"), F.lit(PARTS)).cast("int"))
    before = Window.partitionBy(key).orderBy("cw_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(key, "cw_part").agg(F.count("*").alias("cw_n"))
    starts = counts.select(F.col(key).alias("cw_key"), F.col("cw_part").alias("cw_of"), F.coalesce(F.sum("cw_n").over(before), F.lit(0)).alias("cw_start"))
    dealt = dealt.withColumn("cw_here", F.row_number().over(Window.partitionBy(key, "cw_part").orderBy("cw_row")))
    dealt = dealt.join(starts, (F.col(key) == F.col("cw_key")) & (F.col("cw_part") == F.col("cw_of")))
    return dealt.withColumn(name, (F.col("cw_start") + F.col("cw_here") - 1).cast("long")).drop("cw_part", "cw_of", "cw_key", "cw_start", "cw_here")


def _placed(groups: DataFrame, shards: int) -> DataFrame:
    """cw_group and shard of every group (cw_row, cw_group, bytes)."""
    histogram = groups.groupBy("bytes").agg(F.count("*").alias("n")).toArrow()
    sizes = sorted(zip(histogram.column("bytes").to_pylist(), histogram.column("n").to_pylist(), strict=True), reverse=True)
    runs = balanced_runs(sizes, shards)
    shared = sorted({size for size, first, _, _ in runs if first})
    # Where the bin changes, in falling order of size and by number: few places, because a bin is left only when it is full.
    ranges = [r for r, before in zip(runs, [None, *runs], strict=False) if before is None or r[3] != before[3]]
    places = _shared(groups, ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, first, bins = places.value
        for batch in batches:
            own, number = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            # Ranges that begin with a larger size, and those of the own size that begin at the number or before it.
            at = np.searchsorted(-size, -own, "left")
            end = np.searchsorted(-size, -own, "right")
            for begun in np.unique(own[end > at]):
                mine = np.flatnonzero(own == begun)
                at[mine] += np.searchsorted(first[at[mine[0]] : end[mine[0]]], number[mine], "right")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bins[at - 1], pa.int32())], ["cw_group", "shard"])

    alone = groups.where(~F.col("bytes").isin(shared)).select("cw_group", "bytes", F.lit(0).cast("long").alias("cw_number"))
    several = _numbered(groups.where(F.col("bytes").isin(shared)), "bytes", "cw_number").select("cw_group", "bytes", "cw_number")
    return alone.unionByName(several).mapInArrow(run, "cw_group binary, shard int")


def _shared(frame: DataFrame, ranges: list[tuple[int, int, int, int]]):
    """Sizes, first numbers and bins of the ranges, sent to the executors."""
    size, first, _, bins = (np.array(x, np.int64) for x in zip(*ranges, strict=True))
    return frame.sparkSession.sparkContext.broadcast((size, first, bins.astype(np.int32)))


def shard_by_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row, as a written table; shards hold nearly equal bytes.

    The text is read once; 60 bytes a row are kept of it.
    """
    spark = docs.sparkSession
    with scratch(spark):
        rows = written(
            docs.select(
                F.monotonically_increasing_id().alias("cw_row"),
                F.col("doc_id").cast("long").alias("doc_id"),
                (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
                F.coalesce(F.crc32("text"), F.lit(0).cast("long")).alias("text_crc32"),
                F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b"")).alias("cw_group"),
            )
        )
        groups = written(rows.groupBy("cw_group").agg(F.min("cw_row").alias("cw_row"), F.sum("size").alias("bytes"), F.count("*").alias("cw_copies")))
        total = groups.agg(F.sum("cw_copies")).first()[0]
        if total is None:
            return spark.createDataFrame([], "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int")
        placed = written(_placed(groups, shards))
        often = groups.where(F.col("cw_copies") * PARTS >= total).select(F.col("cw_group").alias("cw_often"))
        hot = F.broadcast(placed.join(F.broadcast(often), F.col("cw_group") == F.col("cw_often")).select("cw_often", F.col("shard").alias("cw_hot")))
        marked = rows.join(hot, F.col("cw_group") == F.col("cw_often"), "left").drop("cw_often")
        ready = marked.where("cw_hot is not null").withColumnRenamed("cw_hot", "shard").drop("cw_group")
        other = marked.where("cw_hot is null").drop("cw_hot").join(placed, "cw_group").drop("cw_group")
        in_shards = written(ready.unionByName(other))
        return written(
            _numbered(in_shards, "shard", "slot").select(
                "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
            ),
            keep=True,
        )
