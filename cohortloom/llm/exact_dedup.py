"""Exact deduplication against an index of historical digests.

The index is a table of buckets. Each bucket holds a minimal perfect hash over
its distinct digests; a slot holds the whole digest and the locator of the
winner (its doc_id and row) with the size of its group. A lookup hashes a digest
to a slot and compares all bytes there: equal bytes mean a repeat, anything else
a nonmember. Nonmembers are grouped among themselves, by an index of their own.
A batch that has been looked up can be taken into the index (absorb): its members
add to the sizes and may become winners.

Rules: texts are equal when their UTF-8 bytes are identical after lower-casing
A-Z; null counts as empty; the largest doc_id of a group stays; a null doc_id
is smaller than any other; of repeated rows (same doc_id, equal text) one stays,
in dedup that whose columns come first as JSON.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, cut, filled, fresh, tidy

#: Distinct digests that a bucket holds on average.
BUCKET_DIGESTS = 4096
#: Rows of one bucket that one lookup task handles at once; a bucket with more is dealt out over several copies.
LOOKUP_ROWS = 65_536
#: Bits of a level of the hash for each digest that it still has to place.
GAMMA = 2
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Locator of a group without any doc_id.
NONE = np.iinfo(np.int64).min
INDEX = "bucket long, n int, level_bits array<long>, bits binary, digests binary, winners binary, rows binary, sizes binary"
FOUND = "doc_id long, row long, digest binary, keep_id long, group_size long, member boolean, kept boolean"


def digest_text(text: str | bytes | None) -> bytes:
    raw = text.encode() if isinstance(text, str) else text or b""
    return hashlib.sha256(raw.lower()).digest()  # bytes.lower() changes A-Z alone


def with_digest(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """docs with the SHA-256 of the normalised text in column name."""
    schema = docs.withColumn(name, F.lit(b"")).schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text):
            raw = filled(b.column(text)).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([digest_text(x.as_py()) for x in raw], pa.binary())], names=[*b.schema.names, name])

    return docs.mapInArrow(tidy(add), schema)


def words_of(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, "<u8").reshape(-1, 4)


def level_hash(words: np.ndarray, level: int, bits: int) -> np.ndarray:
    """A place below bits for each digest, drawn anew at each level from its four words in turn."""
    with np.errstate(over="ignore"):
        x = (words[:, level % 4] ^ (words[:, (level + 1) % 4] >> np.uint64(level % 31 + 1))) * (MIX + np.uint64(2 * level))
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return (x % np.uint64(bits)).astype(np.int64)


def build_mphf(words: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes of the levels, their bits on end, and the slot of each (distinct) digest: 0 .. n-1, each once."""
    sizes, planes, at, left = [], [], np.empty(len(words), np.int64), np.arange(len(words))
    base = 0
    for level in range(1000):
        if not len(left):
            break
        bits = max(64, GAMMA * len(left))
        place = level_hash(words[left], level, bits)
        alone = np.bincount(place, minlength=bits) == 1
        hit = alone[place]
        at[left[hit]] = base + place[hit]
        sizes.append(bits)
        planes.append(alone)
        base += bits
        left = left[~hit]
    if len(left):
        raise ValueError("digests are not distinct")
    plane = np.concatenate(planes) if planes else np.zeros(0, bool)
    rank = np.cumsum(plane) - plane
    return sizes, plane, rank[at]


def find_slots(words: np.ndarray, sizes: list[int], plane: np.ndarray) -> np.ndarray:
    """The slot that the hash gives, for members and nonmembers alike; -1 where no level has a bit."""
    slot, left, base = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    rank = np.cumsum(plane) - plane
    for level, bits in enumerate(sizes):
        place = base + level_hash(words[left], level, bits)
        hit = plane[place]
        slot[left[hit]] = rank[place[hit]]
        left = left[~hit]
        base += bits
    return slot


def bucket_of(digest: str, buckets: int):
    return F.pmod(F.xxhash64(digest), F.lit(buckets))


def numbered(digests: DataFrame) -> DataFrame:
    """doc_id, digest and row: a number that tells rows with equal ids and digests apart. digests should be stored, so that it stays the same."""
    return digests.select("doc_id", "digest", "row") if "row" in digests.columns else digests.select("doc_id", "digest", F.monotonically_increasing_id().alias("row"))


def winners_of(digests: DataFrame) -> DataFrame:
    """digest, winner, row, size. Copies meet in map-side sums, so a group of any size shuffles as one row for each task."""
    found = numbered(digests).groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count(F.lit(1)).alias("size"))
    return found.select("digest", F.col("top.doc_id").alias("winner"), F.col("top.row").alias("row"), "size")


def locators(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winners (the smallest long where a group has no doc_id), their rows, and sizes."""
    return pdf["winner"].astype("Int64").fillna(NONE).to_numpy(np.int64), pdf["row"].to_numpy(np.int64), pdf["size"].to_numpy(np.int64)


def build_index(digests: DataFrame, buckets: int | None = None) -> DataFrame:
    """Index over (doc_id, digest) rows: one row a bucket, with schema INDEX and the bucket count in column buckets."""
    groups = cut(winners_of(digests))
    buckets = buckets or max(1, groups.count() // BUCKET_DIGESTS)

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        words = words_of(b"".join(pdf["digest"]))
        sizes, plane, slot = build_mphf(words)
        place = np.argsort(slot)
        winner, row, size = (x[place].tobytes() for x in locators(pdf))
        return pd.DataFrame({"bucket": [key[0]], "n": [len(pdf)], "level_bits": [sizes], "bits": [np.packbits(plane).tobytes()], "digests": [words[place].tobytes()], "winners": [winner], "rows": [row], "sizes": [size]})

    index = groups.withColumn("bucket", bucket_of("digest", buckets)).groupBy("bucket").applyInPandas(build, INDEX)
    return cut(index.withColumn("buckets", F.lit(buckets)))


def absorb(index: DataFrame, members: DataFrame) -> DataFrame:
    """The index with (doc_id, digest) rows counted in that lookups have found in it."""
    first = index.select("buckets").first()
    buckets = first["buckets"] if first else 1

    def add(key: tuple, entry: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        own = entry.drop(columns="buckets")
        if not len(own) or not len(more):
            return own
        slot = slots_of(words_of(b"".join(more["digest"])), own.iloc[0])[0]
        winner, row, size = (np.frombuffer(own.iloc[0][c], np.int64).copy() for c in ("winners", "rows", "sizes"))
        new_winner, new_row, new_size = locators(more)
        later = (new_winner > winner[slot]) | (new_winner == winner[slot]) & (new_row > row[slot])
        winner[slot], row[slot] = np.where(later, new_winner, winner[slot]), np.where(later, new_row, row[slot])
        size[slot] += new_size
        return own.assign(winners=[winner.tobytes()], rows=[row.tobytes()], sizes=[size.tobytes()])

    more = winners_of(members).withColumn("bucket", bucket_of("digest", buckets))
    return cut(index.groupBy("bucket").cogroup(more.groupBy("bucket")).applyInPandas(add, INDEX).withColumn("buckets", F.lit(buckets)))


def slots_of(words: np.ndarray, entry: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each digest in the bucket's index entry, and whether its bytes are there."""
    sizes = [int(x) for x in entry["level_bits"]]
    plane = np.unpackbits(np.frombuffer(entry["bits"], np.uint8), count=sum(sizes)).astype(bool)
    slot = find_slots(words, sizes, plane)
    there = np.maximum(slot, 0)
    return there, (slot >= 0) & (words_of(entry["digests"])[there] == words).all(axis=1)


def lookup_bucket(words: np.ndarray, entry: pd.Series | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """member, winner, the winner's row and group size of each digest by the bucket's index entry."""
    n = len(words)
    if entry is None or not n:
        return np.zeros(n, bool), *(np.zeros(n, np.int64) for _ in range(3))
    there, member = slots_of(words, entry)
    return member, *(np.frombuffer(entry[c], np.int64)[there] for c in ("winners", "rows", "sizes"))


def lookup(digests: DataFrame, index: DataFrame) -> DataFrame:
    """Each (doc_id, digest) row with its member flag; members get the winner's doc_id and the group's size.

    A bucket with more than LOOKUP_ROWS rows is dealt out by row over copies of its index entry. Such
    buckets are fewer than one for LOOKUP_ROWS rows, and Spark joins their list as it sees fit.
    """
    first = index.select("buckets").first()
    buckets = first["buckets"] if first else 1
    rows = numbered(digests).withColumn("bucket", bucket_of("digest", buckets))
    heavy = cut(rows.groupBy("bucket").count().where(F.col("count") > LOOKUP_ROWS).select("bucket", F.ceil(F.col("count") / (LOOKUP_ROWS // 2)).alias("parts")))
    salt = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("row"), F.col("parts"))).otherwise(F.lit(0).cast("long"))
    rows = rows.join(heavy, "bucket", "left").withColumn("salt", salt).drop("parts")
    entries = index.drop("buckets").join(heavy, "bucket", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")

    def find(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        member, winner, row, size = lookup_bucket(words_of(b"".join(left["digest"])), right.iloc[0] if len(right) else None)
        ids = left["doc_id"].astype("Int64")
        keep = pd.Series(pd.array(winner, "Int64")).mask(~member | (winner == NONE))
        kept = member & (ids.fillna(NONE).to_numpy(np.int64) == winner) & (left["row"].to_numpy(np.int64) == row)
        return pd.DataFrame({"doc_id": ids, "row": left["row"], "digest": left["digest"], "keep_id": keep.to_numpy(), "group_size": pd.Series(pd.array(size, "Int64")).mask(~member).to_numpy(), "member": member, "kept": kept})

    return rows.groupBy("bucket", "salt").cogroup(entries.groupBy("bucket", "salt")).applyInPandas(find, FOUND)


def stored_digests(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, digest and row of all rows of docs."""
    return cut(numbered(with_digest(docs.select("doc_id", text), "digest", text)))


def repeats(docs: DataFrame, history: DataFrame | None = None, text: str = "text") -> DataFrame:
    """One row per document: doc_id, row, digest, keep_id, group_size, member, kept.

    history: an index of earlier batches; its members are repeats of documents kept before, so none of them
    stays. Nonmembers are grouped among themselves. Without history the index is built over docs itself.
    """
    digests = stored_digests(docs, text)
    if history is None:
        return lookup(digests, build_index(digests))
    found = cut(lookup(digests, history))
    old = found.where("member").withColumn("kept", F.lit(False))
    new = found.where("NOT member").select("doc_id", "digest", "row")
    return old.unionByName(lookup(new, build_index(new)).withColumn("member", F.lit(False)))


def repeats_of_batches(docs: DataFrame, past: Column, text: str = "text") -> DataFrame:
    """As repeats without history, in two batches: rows for which past holds are indexed, the others are looked up.

    Members of the second batch are taken into the index, so that the winner is the largest doc_id of both; nonmembers get an
    index of their own. Then all rows are looked up. member: whether the row's digest is one of the first batch.
    """
    digests = stored_digests(docs, text)
    old, new = digests.where(past), digests.where(~past)
    index = build_index(old)
    found = cut(lookup(new, index))
    repeated, fresh_ = (found.where(c).select("doc_id", "digest", "row") for c in ("member", "NOT member"))
    both = lookup(old.unionByName(repeated), absorb(index, repeated))
    return both.unionByName(lookup(fresh_, build_index(fresh_)).withColumn("member", F.lit(False)))


def dedup(docs: DataFrame, history: DataFrame | None = None, text: str = "text") -> DataFrame:
    """docs without repeats; all columns stay as they are."""
    mark, key, value = fresh(docs, "digest"), fresh(docs, "key"), fresh(docs, "value")
    found = cut(repeats(docs, history, text).select(F.col("doc_id").alias(key), F.col("digest").alias(value), "kept"))
    marked = with_digest(docs, mark, text)
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(mark) == F.col(value))
    stays = found.groupBy(key, value).agg(F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_n"))
    twice = stays.where("_kept AND _n > 1").select(key, value)
    out = marked.join(stays.where("NOT _kept").select(key, value), same, "left_anti")
    if twice.isEmpty():
        return out.drop(mark)
    row = F.struct(*docs.columns)
    once = out.join(twice, same, "left_semi").groupBy("doc_id", mark).agg(F.min_by(row, F.to_json(row)).alias("first"))
    return out.join(twice, same, "left_anti").drop(mark).unionByName(once.select("first.*"))
