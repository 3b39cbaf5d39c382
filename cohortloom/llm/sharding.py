"""Contiguous, byte-balanced shards from global prefix sums; DataFrame functions only.

Documents are put in order of doc_id (nulls first; ties by text checksum, then
size). The order is split at quantiles of doc_id into partitions, whose totals
give each partition its start in the global byte axis; a running sum inside the
partition gives each document its own place. The axis is cut at equal targets:
a document belongs to the shard that holds the middle of its bytes. Shards are
therefore runs of the order, and their sizes differ by a document or so.

An id that fills whole quantiles, and rows without id, have partitions of their
own, split once more by checksum.

An empty table gives no rows. Rows with equal doc_id keep their tie order; rows
equal in all three keys are interchangeable.
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh

#: Rows that a partition of the order has on average, and the most partitions.
PARTITION_ROWS, MOST_PARTITIONS = 200_000, 4096
#: Ranges of checksums that the rows of a very frequent id are split into.
CRC_RANGES = 256


def partition_bounds(rows: DataFrame, doc_id: str, partitions: int | None) -> tuple[list[int], list[int]]:
    """Quantiles of doc_id, fewer than partitions; and the ids that fill whole quantiles. This is all that the driver gets."""
    partitions = partitions or min(MOST_PARTITIONS, max(16, rows.count() // PARTITION_ROWS))
    shares = [(i + 1) / partitions for i in range(partitions - 1)]
    if not shares:
        return [], []
    found = rows.agg(F.percentile_approx(doc_id, shares, max(1000, 20 * partitions)).alias("q")).first()["q"] or []
    frequent = sorted({x for x, y in pairwise(found) if x == y})
    # such an id is alone between two bounds
    return sorted({*found, *(x - 1 for x in frequent if x > -(2**63))}), frequent


def partition_of(bounds: list[int], ordered: Column) -> Column:
    """How many bounds lie below the value; null gives 0. A lookup by halves keeps the expression short."""
    if not bounds:
        return F.lit(0)

    def halves(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(ordered > F.lit(bounds[mid]), halves(mid + 1, high)).otherwise(halves(low, mid))

    return halves(0, len(bounds))


def placed(rows: DataFrame, key: tuple[str, str, str], shards: int, partitions: int | None, shard: str, slot: str) -> DataFrame:
    """rows with their shard and slot. key: the names of doc_id, checksum and size."""
    doc_id, crc, size = key
    bounds, frequent = partition_bounds(rows, doc_id, partitions)
    part = F.when(F.col(doc_id).isNull(), F.lit(-1)).otherwise(partition_of(bounds, F.col(doc_id)))
    alone = F.col(doc_id).isNull() | F.col(doc_id).isin(frequent) if frequent else F.col(doc_id).isNull()
    own = [fresh(rows, n) for n in ("part", "sub", "before", "all", "number", "offset")]
    part_, sub, bytes_before, all_bytes, number, offset = own
    dealt = rows.withColumn(part_, part).withColumn(sub, F.when(alone, F.floor(F.col(crc) / (2**32 // CRC_RANGES))).otherwise(F.lit(0)).cast("int"))

    # One row a partition: this is the whole side that is broadcast. MOST_PARTITIONS bounds the parts, and ids that are split are fewer.
    totals = dealt.groupBy(part_, sub).agg(F.sum(size).alias("bytes"))
    before = Window.orderBy(part_, sub).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        part_, sub,
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias(bytes_before),
        F.sum("bytes").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(all_bytes),
    )
    order = [F.col(doc_id).asc_nulls_first(), crc, size]
    within = Window.partitionBy(part_, sub).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = 2 * (F.col(bytes_before) + F.sum(size).over(within)) - F.col(size)
    sharded = dealt.join(F.broadcast(starts), [part_, sub]).withColumn(shard, F.least(F.lit(shards - 1).cast("long"), F.floor((middle * shards) / (2 * F.col(all_bytes)))).cast("int"))

    # Slots: a running number inside (partition, shard), after the rows that earlier partitions put into the shard.
    counts = sharded.groupBy(part_, sub, shard).agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select(part_, sub, shard, F.coalesce(F.sum("n").over(Window.partitionBy(shard).orderBy(part_, sub).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(offset))
    numbered = sharded.withColumn(number, F.row_number().over(Window.partitionBy(part_, sub, shard).orderBy(*order)))
    out = numbered.join(F.broadcast(offsets), [part_, sub, shard]).withColumn(slot, F.col(offset) + F.col(number) - 1)
    return out.select(*rows.columns, shard, slot)


def size_of(text: str, extra: int) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + extra


def checksum_of(text: str) -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def shard_by_bytes(docs: DataFrame, shards: int = 24, text: str = "text", extra: int = 8, partitions: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard (int), slot (gapless from 0 in the shard) for each row of docs.

    size: UTF-8 bytes of the text (null: none) plus extra. Texts are read once, for size and checksum; all else works on those.
    """
    sized = cut(docs.select("doc_id", size_of(text, extra).alias("size"), checksum_of(text).alias("text_crc32")))
    return placed(sized, ("doc_id", "text_crc32", "size"), shards, partitions, "shard", "slot")


#: Bytes of text that a task writes.
FILE_BYTES = 256 << 20


def write_shards(docs: DataFrame, path: str, shards: int = 24, text: str = "text", partitions: int | None = None, file_bytes: int = FILE_BYTES) -> None:
    """docs as Parquet under path, in one folder a shard (column shard), each in slot order. Repeated rows are rows of their own.

    Rows are dealt by ranges of (shard, slot), so a shard of any size is written by many tasks, with about file_bytes each; its
    files follow each other in slot order.
    """
    shard, slot, size, crc = (fresh(docs, n) for n in ("shard", "slot", "size", "crc"))
    rows = docs.withColumn(size, size_of(text, 8)).withColumn(crc, checksum_of(text))
    files = max(shards, -(-int(rows.agg(F.sum(size)).first()[0] or 0) // file_bytes))
    out = placed(rows, ("doc_id", crc, size), shards, partitions, shard, slot).drop(size, crc)
    out.repartitionByRange(files, shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
