"""Benchmark decontamination by pigeonhole edit matching.

An item with an error budget of k edits is split into k + 1 pieces; a passage
within k edits of the item holds at least one piece unchanged. Documents are
searched for all pieces at once, and around each piece hit Myers' bit-parallel
algorithm gives the edit distance of the best passage. The budget is ERROR_RATE
of the item's characters, so pieces are nearly as long at any length of item.

Before that, a hit's surroundings must have as many of the item's runs of GRAM
characters as k edits leave at least (each edit breaks GRAM of them); chance hits
of short pieces end here.

Texts are compared after lower-casing and turning white space into one space.
Items shorter than EXACT characters must occur exactly, at word bounds; empty
or null items match nothing, null texts hold nothing.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, as_batch, blocks, cut, filled, tidy

#: Edits allowed as a share of the item's characters; items of fewer characters must occur exactly.
ERROR_RATE, EXACT = 0.08, 16
#: Length of the runs of characters that are compared before the distance is.
GRAM = 4
#: Characters of benchmark items that one pass over the documents looks for; more items take more passes.
PASS_CHARS = 16 << 20
HIT = "doc_id long, item_id long, distance int, budget int"


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def budget(length: int, rate: float = ERROR_RATE) -> int:
    return int(length * rate) if length >= EXACT else 0


def split_pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces with their places; their lengths differ by one at most."""
    bounds = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(s, item[s:e]) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]


def myers(pattern: str, text: str, most: int) -> int | None:
    """The least edit distance of pattern to any substring of text, or None if over most (Myers 1999, words of any width)."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = mask, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            best = min(best, score)
        # a passage may begin anywhere: no carry enters at the first row
        ph, mh = ph << 1 & mask, mh << 1 & mask
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
    return best if best <= most else None


class Matcher:
    """Finds the items in normalised texts."""

    made: dict[tuple[str, float], Matcher] = {}

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        import ahocorasick

        self.items = [(i, t, budget(len(t), rate)) for i, t in items]
        self.grams: dict[int, tuple[list[tuple[str, int]], int]] = {}  # made as items are hit
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, errors) in enumerate(self.items):
            for start, part in split_pieces(text, errors):
                places.setdefault(part, []).append((n, start))
        self.automaton = ahocorasick.Automaton()
        for part, found in places.items():
            self.automaton.add_word(part, (len(part), found))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    @classmethod
    def of(cls, name: str, shared: Broadcast, rate: float) -> Matcher:
        """The matcher of a group of items with this name; a worker process keeps the last one that it made."""
        if (name, rate) not in cls.made:
            cls.made.clear()
            cls.made[name, rate] = cls(shared.value, rate)
        return cls.made[name, rate]

    def could_hold(self, n: int, window: str) -> bool:
        """False only if the window has fewer of the item's runs of characters than its budget of edits leaves."""
        _, item, errors = self.items[n]
        if n not in self.grams:
            counts = Counter(item[i : i + GRAM] for i in range(len(item) - GRAM + 1))
            self.grams[n] = list(counts.items()), counts.total() - GRAM * errors
        counts, least = self.grams[n]
        if least <= 0:
            return True
        there = {window[i : i + GRAM] for i in range(len(window) - GRAM + 1)}
        return sum(k for g, k in counts if g in there) >= least

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item's number, distance, budget) of each item that text holds within its budget."""
        if self.empty or not text:
            return []
        windows: dict[int, list[int]] = {}
        for stop, (size, found) in self.automaton.iter(text):
            for n, start in found:
                windows.setdefault(n, []).append(stop - size + 1 - start)
        out = []
        for n, starts in windows.items():
            _, item, errors = self.items[n]
            best = None
            if not errors:  # one piece: the item itself
                whole = lambda s, m=len(item): not text[max(0, s - 1) : s].isalnum() and not text[s + m : s + m + 1].isalnum()
                best = 0 if len(item) >= EXACT or any(map(whole, starts)) else None
            else:
                low = high = None
                spans = []
                for s in sorted(starts):  # hits of one passage lie within the budget of each other
                    a, b = max(0, s - errors), s + len(item) + errors
                    if high is not None and a <= low + 2 * errors:
                        high = max(high, b)
                    else:
                        if high is not None:
                            spans.append((low, high))
                        low, high = a, b
                spans.append((low, high))
                for a, b in spans:
                    window = text[a:b]
                    if item in window:
                        best = 0
                    elif self.could_hold(n, window):
                        got = myers(item, window, errors)
                        best = got if best is None else best if got is None else min(best, got)
                    if best == 0:
                        break
            if best is not None:
                out.append((n, best, errors))
        return out


def item_passes(items: DataFrame, item_id: str, text: str, most_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in groups of about most_chars characters, one group after another on the driver. The table is read once."""
    clean = cut(items.where(F.length(F.trim(text)) > 0).select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")))
    total = clean.agg(F.sum(F.length("t"))).first()[0] or 0
    parts = -(-total // most_chars)
    for k in range(parts):
        rows = clean.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k).collect()
        yield sorted({(r["i"], normal(r["t"])) for r in rows if normal(r["t"])}, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def name_of(group: list[tuple[int, str]]) -> str:
    return hashlib.sha256(repr(group).encode()).hexdigest()


HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("budget", pa.int32())])


def contaminated(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, text: str = "text", item_id: str = "item_id", item_text: str = "text", most_chars: int = PASS_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, budget) for each document and item that it holds; clean documents give no row.

    Equal items keep their own ids; repeated document rows give repeated hits.
    """
    spark = docs.sparkSession
    parts = []
    for group in item_passes(items, item_id, item_text, most_chars):
        shared, name = spark.sparkContext.broadcast(group), name_of(group)

        def find(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            matcher = Matcher.of(name, shared, rate)
            for b in blocks(batches, text, BLOCK_BYTES // 2):
                rows = [(d, matcher.items[n][0], got, errors) for d, t in zip(b.column("doc_id").to_pylist(), filled(b.column(text)).to_pylist(), strict=True) for n, got, errors in matcher.find(normal(t))]
                yield as_batch(HITS, *(list(c) for c in zip(*rows, strict=True))) if rows else as_batch(HITS, [], [], [], [])

        parts.append(docs.select("doc_id", text).mapInArrow(tidy(find), HIT))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], HIT)


def decontaminate(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, text: str = "text", most_chars: int = PASS_CHARS) -> DataFrame:
    """The rows of docs that hold no item; all columns stay as they are."""
    out = docs
    for group in item_passes(items, "item_id", "text", most_chars):
        shared, name = docs.sparkSession.sparkContext.broadcast(group), name_of(group)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            matcher = Matcher.of(name, shared, rate)
            for b in blocks(batches, text, BLOCK_BYTES // 2):
                yield b.filter(pa.array([not matcher.find(normal(t)) for t in filled(b.column(text)).to_pylist()], pa.bool_()))

        out = out.mapInArrow(tidy(clean), docs.schema)
    return out
