"""Audit of how filters act on each other, by count-weighted decision diagrams.

Each document has a failure mask: one bit a filter. Masks are counted per part on Spark, so what is left of a part, however
large, is one row for each mask that occurs. Of these rows a diagram is built: one level a filter, a node's low edge for
documents that pass, its high edge for those that fail, equal nodes of a level kept once, and at the ends the counts. A node's
weight is the sum of the counts below it.

On the path of low edges from the root, the weight of each node is what the filters above it have kept, and its two children's
weights are what the filter of its level keeps and removes. So one path tells all steps of one order of filters. The next order
differs in two neighbouring filters, which swaps two levels and leaves the others as they are.

Filters of documents (words: runs of characters other than ASCII white space; null text counts as empty):
A: under 200 words. B: 100 * distinct words < 50 * words. C: 100 * (characters A-Z) > 3 * code points. D: any of #$%&*|.
E: a smaller doc_id has the same text. Of rows with the same id and text, none is a repeat of the other; rows without doc_id
come after all others, so each repeats any text that has an id, and none repeats another without one. A text without words
passes B and C.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
#: Rows without doc_id are dealt over so many keys where rows meet by doc_id.
SPREAD = 4096


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: failures of A to D."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    upper = F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))
    fails = [F.size(words) < 200, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), 100 * upper > 3 * F.char_length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "lang", text: str = "text") -> DataFrame:
    """part, mask, docs, good, toxic: how many documents of a part have a mask, and how many of them are labelled good or toxic.

    docs: doc_id, part and text; labels: doc_id, quality, toxic (an id that is labelled more than once is good or toxic if any
    of its labels says so; ids without a label, and rows without doc_id, are neither). The result has 32 rows a part at most.
    """
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SPREAD))).otherwise(-1)
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_mask(text_of(text)).alias("mask"), F.unhex(F.sha2(text_of(text), 256)).alias("digest")).withColumn("salt", salt)
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")).withColumn("none", F.lit(-1).cast("long"))
    met = rows.join(told, (F.col("doc_id") == F.col("id")) & (F.col("salt") == F.col("none")), "left").na.fill(0, ["good", "toxic"])
    of = ["digest", "part", "mask", "good", "toxic"]
    # rows of one id are together after the join; copies of a text are then one row a partition, and one row for each of `of` after that
    by_id = met.groupBy("doc_id", "salt", *of).agg(F.count(F.lit(1)).alias("n"))
    groups = by_id.groupBy(*of).agg(F.sum("n").alias("docs"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n")).alias("first"))
    least = groups.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    both = groups.join(least, "digest")
    passes = F.when(F.col("least").isNull(), F.col("docs")).when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = both.withColumn("unique", passes)
    bits = F.explode(F.array(F.struct(F.col("mask"), F.col("unique").alias("docs")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("docs") - F.col("unique")).alias("docs"))))
    each = split.select("part", "good", "toxic", bits.alias("of")).where("of.docs > 0")
    return each.groupBy("part", F.col("of.mask").alias("mask")).agg(F.sum("of.docs").alias("docs"), F.sum(F.col("of.docs") * F.col("good")).alias("good"), F.sum(F.col("of.docs") * F.col("toxic")).alias("toxic"))


class Diagram:
    """A decision diagram of counts over masks, with one level a filter.

    levels[i] lists the nodes of level i as (low, high), which are places in level i + 1, or in ends below the last; weights[i]
    lists their weights. Nodes of a level are distinct. The root is the only node of level 0.
    """

    def __init__(self, counts: dict[int, tuple[int, ...]], size: int):
        zero = (0,) * len(next(iter(counts.values()), (0,)))
        self.order = list(range(size))
        self.levels: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        self.ends: list[tuple[int, ...]] = []
        known: list[dict] = [{} for _ in range(size + 1)]

        def place(level: int, node: tuple) -> int:
            held = self.ends if level == size else self.levels[level]
            if node not in known[level]:
                known[level][node] = len(held)
                held.append(node)
            return known[level][node]

        def build(level: int, mask: int) -> int:
            if level == size:
                return place(level, counts.get(mask, zero))
            return place(level, (build(level + 1, mask), build(level + 1, mask | 1 << level)))

        build(0, 0)
        self.weights = [*([] for _ in range(size)), self.ends]
        for level in reversed(range(size)):
            self.weigh(level)

    def weigh(self, level: int) -> None:
        below = self.weights[level + 1]
        self.weights[level] = [tuple(a + b for a, b in zip(below[low], below[high], strict=True)) for low, high in self.levels[level]]

    def swap(self, level: int) -> None:
        """Exchanges this level's filter with the next one's. Nodes above and below stay; so do the places and weights of this level's."""
        under, made, known = self.levels[level + 1], [], {}

        def place(node: tuple[int, int]) -> int:
            if node not in known:
                known[node] = len(made)
                made.append(node)
            return known[node]

        # a node's four grandchildren, regrouped by the other filter first
        self.levels[level] = [(place((under[a][0], under[b][0])), place((under[a][1], under[b][1]))) for a, b in self.levels[level]]
        self.levels[level + 1] = made
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]
        self.weigh(level + 1)

    def steps(self) -> Iterator[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """(filter, counts kept, counts removed) of each level on the path on which all filters pass."""
        at = 0
        for level, which in enumerate(self.order):
            low, high = self.levels[level][at]
            yield which, self.weights[level + 1][low], self.weights[level + 1][high]
            at = low


def neighbour_swaps(size: int) -> Iterator[int]:
    """Places i whose items are exchanged with the next one's, one after the other, so that all orders of size items come once."""
    items, ways = list(range(size)), [-1] * size
    while True:
        moves = [i for i, x in enumerate(items) if 0 <= i + ways[x] < size and items[i + ways[x]] < x]
        if not moves:
            return
        at = max(moves, key=items.__getitem__)
        most = items[at]
        to = at + ways[most]
        items[at], items[to] = items[to], items[at]
        yield min(at, to)
        for x in range(most + 1, size):
            ways[x] = -ways[x]


def audit_part(part: str, counts: dict[int, tuple[int, int, int]], names: str = FILTERS) -> list[tuple]:
    """Rows of AUDIT for all orders of the filters."""
    fails = [sum(c[0] for m, c in counts.items() if m >> i & 1) for i in range(len(names))]
    alone = [counts.get(1 << i, (0,))[0] for i in range(len(names))]
    diagram, rows, total = Diagram(counts, len(names)), [], [0] * len(names)
    for swap in (None, *neighbour_swaps(len(names))):
        if swap is not None:
            diagram.swap(swap)
        order = "".join(names[i] for i in diagram.order)
        for step, (i, kept, removed) in enumerate(diagram.steps(), 1):
            total[i] += removed[0]
            rows.append((part, order, step, kept[0], removed[0], fails[i] - removed[0], alone[i], removed[1], removed[2]))
    return [(*r, total[names.index(r[1][r[2] - 1])]) for r in rows]


def audit(counts: DataFrame, names: str = FILTERS) -> DataFrame:
    """One row (AUDIT) for each part of counts (part, mask, docs, good, toxic; 2 ** len(names) rows a part), order of the filters and step.

    kept: documents left after this step; removed: those that it removes; redundant: those that fail its filter and were removed
    before; unique_fails: those that fail this filter alone; good_lost, toxic_lost: labelled ones among the removed; shapley:
    what this filter removes, summed over all orders.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = {int(r.mask): (int(r.docs), int(r.good), int(r.toxic)) for r in pdf.itertuples()}
        return pd.DataFrame(audit_part(key[0], rows, names), columns=[c.split()[0] for c in AUDIT.split(", ")])

    return counts.groupBy("part").applyInPandas(run, AUDIT)
