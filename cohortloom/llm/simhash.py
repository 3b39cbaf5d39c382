"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most `radius` bits exactly when some word lies
within half the radius of both. So every distinct fingerprint emits all words
within half the radius (2081 for 64 bits and radius 4), words are shuffled, and
fingerprints that meet at a word are linked after their distance is verified.

2081 words a fingerprint are many to shuffle, so they go in two passes:

1. Fingerprints are kept in blocks of BLOCK. A block's words are hashed by a
   bijection, sorted, and cut by their upper bits into parts; only a few more
   bits of each are sent, as differences of sorted values. A part's task finds
   which of the sent values occur twice and answers with their places.
2. The block makes its words again and sends the whole word with its fingerprint
   for those places alone. Equal words meet; others, which had only agreed in
   the sent bits, drop out.

All fingerprints at one word lie within the radius of each other, so links from
the least of them to the rest lose no component; no pairs within a group are
made. Exact copies share one fingerprint and count once.

Rules: words are runs of bytes other than ASCII white space after lower-casing
A-Z; fewer than `width` words make one shingle; no words give fingerprint zero,
which is linked like any other; null counts as empty. A null doc_id is larger
than any other, and a component without any doc_id has a null component_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_batch, blocks, cut, filled, text_of, tidy
from .components import components, labelled, with_labels, without_repeats

BITS, SEED = 64, 42
#: Fingerprints in a block, and words that a part gets on average; both grow with the number of fingerprints, up to GROWTH times.
BLOCK, PART_WORDS, GROWTH = 4096, 4_000_000, 4
#: Words that a block should have for a part: with few, a row's other values would outweigh them.
CELL_WORDS = 256
#: Bits that are sent beyond those that a part's number of words needs.
SPARE = 9
ODD = 0x9E3779B97F4A7C15
#: In a run of 16-bit differences this value means: add it and go on.
MORE = 0xFFFF
PRINT = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("fp", pa.int64())])
SENT = "part int, block long, width int, n int, gaps binary"
ASKED = "block long, part int, places binary"
MET = "word long, fp long, least long"


def text_hash(text: str = "text") -> Column:
    return F.xxhash64(text_of(text))


def shingle_hashes(text: bytes, width: int) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    stop = np.cumsum([len(w) + 1 for w in words]) - 1
    start = np.concatenate([[0], stop[:-1] + 1])
    k = min(width, len(words))
    return [xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(start[: len(words) - k + 1].tolist(), stop[k - 1 :].tolist(), strict=True)]


def fingerprints(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprint of each text from the hashes of all on end: a bit is set if over half of the text's hashes have it."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        begin = (np.cumsum(counts) - counts)[some]
        ones = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > counts[some, None], axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprint(docs: DataFrame, width: int = 4, text: str = "text") -> DataFrame:
    """(doc_id, hash, fp) for each row of docs; hash tells texts apart, fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text, 1 << 20):
            each = [shingle_hashes(t, width) for t in filled(b.column(text)).cast(pa.binary()).to_pylist()]
            counts = np.array([len(x) for x in each], np.int64)
            flat = np.fromiter((h for x in each for h in x), np.uint64, int(counts.sum()))
            yield as_batch(PRINT, b.column("doc_id").cast(pa.int64()), b.column("_hash"), fingerprints(flat, counts).view(np.int64))

    return docs.select("doc_id", text, text_hash(text).alias("_hash")).mapInArrow(tidy(run), "doc_id long, hash long, fp long")


def ball(half: int) -> np.ndarray:
    """All words with at most half bits set."""
    return np.array([sum(1 << i for i in c) for k in range(half + 1) for c in combinations(range(BITS), k)], np.uint64)


def scattered(fps: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """All words of the fingerprints, by an odd product, which is a bijection of 64-bit words; fingerprint by fingerprint."""
    with np.errstate(over="ignore"):
        return ((fps[:, None] ^ masks) * np.uint64(ODD)).ravel()


def pack_gaps(values: np.ndarray) -> tuple[int, bytes]:
    """Sorted values below 2**32 as differences: 2 or 4 bytes each, whichever is shorter."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.int64)
    more = gaps // MORE
    if 2 * (len(gaps) + int(more.sum())) > 4 * len(gaps):
        return 4, gaps.astype("<u4").tobytes()
    out = np.full(len(gaps) + int(more.sum()), MORE, "<u2")
    out[np.cumsum(more) + np.arange(len(gaps))] = gaps % MORE
    return 2, out.tobytes()


def unpack_gaps(width: int, raw: bytes) -> np.ndarray:
    gaps = np.frombuffer(raw, f"<u{width}")
    values = np.cumsum(gaps, dtype=np.uint64)
    return values if width == 4 else values[gaps != MORE]


def sent(values: np.ndarray, part_bits: int, sent_bits: int) -> np.ndarray:
    """The sent bits of scattered words of one part: those right below the part's."""
    return (values >> np.uint64(BITS - part_bits - sent_bits)) & np.uint64((1 << sent_bits) - 1)


def twice(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one part: for each block the places of the values that are sent more than once."""
    values = [unpack_gaps(w, g) for w, g in zip(pdf["width"], pdf["gaps"], strict=True)]
    sizes = np.array([len(v) for v in values])
    every = np.concatenate(values)
    # value above, place in the part below: one sort brings equal values together
    bits = np.uint64(max(1, int(len(every)).bit_length()))
    mixed = np.sort((every << bits) | np.arange(len(every), dtype=np.uint64))
    value = mixed >> bits
    same = value[1:] == value[:-1]
    hit = np.zeros(len(every), bool)
    hit[1:] |= same
    hit[:-1] |= same
    place = np.sort((mixed[hit] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64))
    begin = np.cumsum(sizes) - sizes
    bounds = np.searchsorted(place, np.append(begin, len(every))).tolist()
    rows = [(b, key[0], (place[s:e] - first).astype("<u4").tobytes()) for b, first, s, e in zip(pdf["block"], begin, bounds[:-1], bounds[1:], strict=True) if e > s]
    return pd.DataFrame(rows, columns=["block", "part", "places"])


def block_sizes(count: int, words: int) -> tuple[int, int]:
    """Fingerprints in a block and words in a part, for count fingerprints with so many words each."""
    grow = 1
    while grow < GROWTH and BLOCK * grow * PART_WORDS * grow < CELL_WORDS * count:
        grow *= 2
    # with fewer words a fingerprint than the largest ball, a block has room for more
    return BLOCK * grow * max(1, 2081 // words), PART_WORDS * grow


def links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) whose closure is that of all pairs within radius."""
    if radius % 2:
        raise ValueError("the radius must be even: words lie within half of it")
    half = radius // 2
    masks = ball(half)
    distinct = cut(prints.select("fp").distinct())
    count = distinct.count()
    size, part_words = block_sizes(count, len(masks))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64)
        for b in batches:
            held = np.concatenate([held, b.column(0).to_numpy(zero_copy_only=False)])
            while len(held) >= size:
                yield pa.RecordBatch.from_arrays([pa.array([held[:size].tobytes()], pa.binary()), pa.array([size], pa.int32())], names=["fps", "n"])
                held = held[size:]
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary()), pa.array([len(held)], pa.int32())], names=["fps", "n"])

    # tasks with some blocks each, so that few blocks are partly filled
    filled_ = distinct.coalesce(max(1, count // (4 * size)))
    kept = cut(filled_.mapInArrow(gather, "fps binary, n int").withColumn("block", F.monotonically_increasing_id()))
    spread = max(1, -(-count // size))
    words = count * len(masks)
    part_bits = max(0, math.ceil(math.log2(max(1, words / part_words))))
    # of the words of a part, about one in 2**SPARE agrees with another in the sent bits alone
    sent_bits = min(32, BITS - part_bits, SPARE + max(1, math.ceil(math.log2(max(2, words / (1 << part_bits))))))
    floors = np.arange(1 << part_bits, dtype=np.uint64) << np.uint64(BITS - part_bits) if part_bits else np.zeros(1, np.uint64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, fps in zip(b.column("block").to_pylist(), b.column("fps").to_pylist(), strict=True):
                every = scattered(np.frombuffer(fps, np.uint64), masks)
                every.sort()
                bounds = [*np.searchsorted(every, floors).tolist(), len(every)]
                rows = [(p, block, *pack_gaps(sent(every[s:e], part_bits, sent_bits)), e - s) for p, (s, e) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if e > s]
                p, k, w, g, n = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(k, pa.int64()), pa.array(w, pa.int32()), pa.array(n, pa.int32()), pa.array(g, pa.binary())], names=["part", "block", "width", "n", "gaps"])

    asked = kept.select("block", "fps").repartition(spread).mapInArrow(tidy(send), SENT).groupBy("part").applyInPandas(twice, ASKED)
    asked = asked.groupBy("block").agg(F.collect_list(F.struct("part", "places")).alias("asked"))  # bounded by the words of a block

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per block: each asked word once, with the least fingerprint there, and links inside the block as words of their own (fp != least)."""
        for b in batches:
            for fps, asked_ in zip(b.column("fps").to_pylist(), b.column("asked").to_pylist(), strict=True):
                own = np.frombuffer(fps, np.uint64)
                every = scattered(own, masks)
                order = np.argsort(every)
                begin = np.searchsorted(every, floors, sorter=order)
                take = order[np.concatenate([begin[a["part"]] + np.frombuffer(a["places"], "<u4") for a in asked_])]
                word, fp = every[take].view(np.int64), own[take // len(masks)].view(np.int64)
                order = np.lexsort((fp, word))
                word, fp = word[order], fp[order]
                first = np.ones(len(word), bool)
                first[1:] = word[1:] != word[:-1]
                least = fp[np.flatnonzero(first)[np.cumsum(first) - 1]]
                inside = np.unique(np.stack([least[~first], fp[~first]], axis=1), axis=0)
                # least is null for the rows that go on to meet other blocks
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([word[first], np.zeros(len(inside), np.int64)])), pa.array(np.concatenate([fp[first], inside[:, 1]])), pa.concat_arrays([pa.nulls(int(first.sum()), pa.int64()), pa.array(inside[:, 0], pa.int64())])], names=["word", "fp", "least"])

    met = cut(kept.select("block", "fps").join(asked, "block").select("fps", "asked").mapInArrow(tidy(meet), MET))
    # a word has one row a block at most
    across = met.where("least IS NULL").withColumn("least", F.min("fp").over(Window.partitionBy("word"))).where("fp != least")
    both = met.where("least IS NOT NULL").unionByName(across)
    return both.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= radius).select(F.col("least").alias("a"), F.col("fp").alias("b")).distinct()


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def grouped(docs: DataFrame, width: int, radius: int, text: str) -> DataFrame:
    """doc_id, hash, fp, component_id and stays (the one document of its component) for each row of docs."""
    prints = cut(fingerprint(docs, width, text))
    labels = labelled(prints.select("doc_id", F.col("fp").alias("node")), components(links(prints, radius)))
    # copies of a text agree in all but doc_id; of unlike texts with the component's id and fingerprint, the least hash stays
    first = labels.where("node = winner").select(F.col("node").alias("fp"), F.col("component_id").alias("doc_id"))
    kept = first.join(prints, ["fp", "doc_id"]).groupBy("fp").agg(F.min("hash").alias("kept"))
    rows = with_labels(prints, "fp", labels).join(kept, "fp", "left")
    return rows.select("doc_id", "hash", "fp", "component_id", ((F.col("fp") == F.col("winner")) & F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("hash").eqNullSafe(F.col("kept"))).alias("stays"))


def near_groups(docs: DataFrame, width: int = 4, radius: int = 4, text: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id (the smallest doc_id that links reach, its own included) for each row of docs."""
    prints = cut(fingerprint(docs, width, text))
    labels = labelled(prints.select("doc_id", F.col("fp").alias("node")), components(links(prints, radius)))
    # one row a distinct fingerprint so far; copies meet them again in this join
    return with_labels(prints, "fp", labels).select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, width: int = 4, radius: int = 4, text: str = "text") -> DataFrame:
    """docs with one document of each component: that with its smallest doc_id (rows repeated with this id and text stay together);
    rows without doc_id stay; columns stay as they are."""
    return without_repeats(docs, grouped(docs, width, radius, text), text_hash(text))
