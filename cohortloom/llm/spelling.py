"""Spelling variants by permuterm rotations.

A word is marked with a terminator and rotated: `y$xa` is the rotation of `xay` that begins behind the letter a. All rotations
of all words are sorted. Words that differ in one letter at one place share all of such a rotation but its last letter, and the
word without that letter is the shared part itself. So each rotation goes to the sorted table twice: whole, as the word that
others lengthen, and without its last letter, as a word that has one there. Equal keys are neighbours of the order; a scan of
each run of them gives all pairs at distance one:

* two words without their last letter: the letter is replaced (exactly one key brings such a pair together);
* a whole rotation and one without its last letter: the letter is inserted or deleted. Of a run of equal letters, all of whose
  deletions give the same word, the first alone counts.

A run has one row a letter of the alphabet and one whole rotation at most, since words are distinct, so no run can grow with
the data. Pairs are not listed: a scan gives each word of a run how many neighbours it has there and the best of them.

Words are told by numbers that follow their code-point order. Keys over LONG letters are digests of what is before and behind
the letter, so a word of any length gives rows in proportion to its length.

Rules: null text has no words; a null doc_id is written as empty text; no words give an empty table; rows that repeat count again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of, tidy

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of letters, after lower-casing.
RUN = "[a-zÀ-ÿ]+"
END = "$"
#: Letters of a key up to which it is spelt out.
LONG = 64
ROTATIONS = "key string, id long, n long, whole boolean, first boolean"
#: Rows that a task hands on at once.
ROWS = 1 << 17


def damaged_words(docs: DataFrame, text: str = "text", one_in: int = 199, least_chars: int = 6) -> DataFrame:
    """word, n: runs of letters of all texts, lower-cased, one letter deleted where one_in divides the crc32 of `doc_id:run`.

    Words of under least_chars letters are left out; n counts occurrences.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate(text_of(text), UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.char_length("run") >= least_chars).withColumn("h", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "utf-8")))
    at = F.pmod("h", F.char_length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.pmod("h", F.lit(one_in)) == 0, less).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.char_length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def sides(word: str) -> tuple[list[str], list[str]]:
    """Digests of what is before, and of what is behind, each place of the word."""
    before, behind = [], []
    for letters, out in ((word, before), (word[::-1], behind)):
        h = hashlib.blake2b(digest_size=16)
        out.append(h.hexdigest())
        for c in letters:
            h.update(c.encode())
            out.append(h.copy().hexdigest())
    return before, behind[::-1]


def rotations(word: str) -> Iterator[tuple[str, bool, bool]]:
    """(key, whole, first): each rotation, and each without its last letter if that is no terminator. first: no equal letter before it."""
    size = len(word)
    before, behind = sides(word) if size > LONG else ([], [])
    for i in range(size + 1):
        yield word[i:] + END + word[:i] if size <= LONG else f"#{behind[i]}{before[i]}", True, False
        if i:
            key = word[i:] + END + word[: i - 1] if size - 1 <= LONG else f"#{behind[i]}{before[i - 1]}"
            yield key, False, i == 1 or word[i - 2] != word[i - 1]


def rotated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ROTATIONS of words (id, word, n)."""
    keys, ids, counts, whole, first = [], [], [], [], []

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(whole), pa.array(first)], names=["key", "id", "n", "whole", "first"])
        for x in (keys, ids, counts, whole, first):
            x.clear()
        return out

    for b in batches:
        for i, word, n in zip(*(b.column(c).to_pylist() for c in ("id", "word", "n")), strict=True):
            for key, w, f in rotations(word):
                keys.append(key)
                ids.append(i)
                counts.append(n)
                whole.append(w)
                first.append(f)
                if len(keys) >= ROWS:
                    yield batch()
    if keys:
        yield batch()


def run_neighbours(ids: np.ndarray, counts: np.ndarray, whole: np.ndarray, first: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
    """id, how many neighbours, count and id of the best of them, for the rows of runs of equal keys that start at begins.

    In a run the whole rotation comes first, if there is one, the others by falling count and rising id.
    """
    size = np.diff(np.append(begins, len(ids)))
    begin, row = np.repeat(begins, size), np.arange(len(ids))
    headed = whole[begins]
    top = np.repeat(begins + headed, size)
    others = np.repeat(size - headed, size)
    # replaced letters: the best of the others is the first of them, and the second for the first itself
    member = ~whole & (others > 1)
    best = np.minimum(np.where(row == top, top + 1, top), len(ids) - 1)
    out = [np.stack([ids[member], others[member] - 1, counts[best[member]], ids[best[member]]])]
    # a letter more: each first letter and the whole rotation are neighbours of each other
    longer = ~whole & first & np.repeat(headed, size)
    head = begin[longer]
    out.append(np.stack([ids[longer], np.ones(len(head), np.int64), counts[head], ids[head]]))
    at = np.flatnonzero(longer)
    lead = np.flatnonzero(np.diff(head, prepend=-1))  # the first such row of each run is the best
    if len(lead):
        n = np.diff(np.append(lead, len(head)))
        out.append(np.stack([ids[head[lead]], n, counts[at[lead]], ids[at[lead]]]))
    return out


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, near, best_n, best: of each word and run of sorted rotations in which it has neighbours."""
    kept = None

    def found(t: pa.Table) -> pa.RecordBatch | None:
        key = t.column("key").combine_chunks()
        new = np.ones(len(key), bool)
        new[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(key)))
        many = np.repeat(size > 1, size)
        if not many.any():
            return None
        ids, counts, whole, first = (t.column(c).to_numpy()[many] for c in ("id", "n", "whole", "first"))
        begins = np.cumsum(size[size > 1]) - size[size > 1]
        rows = np.concatenate(run_neighbours(ids, counts, whole.astype(bool), first.astype(bool), begins), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["id", "near", "best_n", "best"])

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        kept = t if kept is None else pa.concat_tables([kept, t])
        # the last key may go on in the next batch
        keys = kept.column("key").combine_chunks()
        same = pc.equal(keys, keys[-1]).to_numpy(zero_copy_only=False)
        stop = int(np.flatnonzero(same)[0])
        if stop and (out := found(kept.slice(0, stop))):
            yield out
        kept = kept.slice(stop).combine_chunks()
    if kept is not None and (out := found(kept)):
        yield out


def last_forms(forms: DataFrame) -> DataFrame:
    """id, root of forms (id, form): the end of the chain of forms. A form is never its own, so doubling the steps ends."""
    now = cut(forms.select("id", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("id").alias("at"), F.col("root").alias("ahead"))
        now = cut(now.join(ahead, F.col("root") == F.col("at"), "left").select("id", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("id", "root")
        now = now.select("id", "root")


def variant_groups(counted: DataFrame, least_n: int = 5, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of the distinct words of counted (word, n) that occur least_n times or more.

    Near words differ by exactly one inserted, deleted or replaced code point. A word's form is its near word of the largest n
    (of equals, the first in code-point order) if that n is times the word's or more, else null; root is where forms end.
    """
    some = cut(counted.where((F.col("n") >= least_n) & F.col("word").isNotNull()))
    words = cut(some.repartitionByRange("word").sortWithinPartitions("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    # rotations are made twice, once for the bounds of the ranges; that is cheaper than to store them
    order = words.mapInArrow(tidy(rotated), ROTATIONS).repartitionByRange("key").sortWithinPartitions("key", F.desc("whole"), F.desc("n"), "id")
    near = order.mapInArrow(tidy(scanned), "id long, near long, best_n long, best long")
    near = near.groupBy("id").agg(F.sum("near").alias("n_near"), F.max(F.struct("best_n", (-F.col("best")).alias("less"))).alias("top"))
    every = words.join(near, "id", "left").withColumn("holds", F.col("top.best_n") >= times * F.col("n"))
    every = cut(every.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("holds"), -F.col("top.less")).alias("form"), F.when(F.col("holds"), F.col("top.best_n")).alias("form_n")))
    roots = last_forms(every.where("form IS NOT NULL").select("id", "form"))
    names = lambda side: words.select(F.col("id").alias(f"{side}_at"), F.col("word").alias(f"{side}_word"))
    moved = every.where("form IS NOT NULL").select("id", "form").join(roots, "id")
    moved = moved.join(names("form"), F.col("form") == F.col("form_at")).join(names("root"), F.col("root") == F.col("root_at")).select(F.col("id").alias("of"), "form_word", "root_word")
    out = every.join(moved, F.col("id") == F.col("of"), "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
