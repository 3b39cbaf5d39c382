"""Jaccard self-join of documents by their n-grams: a blocked sparse product of the document by n-gram incidence matrix.

Entry (a, b) of the product of the matrix with its transpose is the overlap of documents a and b. Two documents link when
overlap / (n_a + n_b - overlap) reaches the similarity, so an overlap of `similarity * n` at least is needed by either
(the bounds below are derived from sizes alone):

1. Columns are counted. Blocks of documents send their n-grams as differences of sorted, shortened hashes; a part of the column
   space adds them up and answers with a rough count for each. A document with fewer n-grams in common with anybody
   than the bound asks for leaves the product here; most do.
2. All columns are put in one order, rare ones first. Documents that reach the bound have a column in common among their first
   n - bound + 1, so only these make entries. Columns with the same list of documents make the same entries; one of them stays.
3. Overlaps of each list's documents with a few of them (stars) are taken first, and what links is one component. Most lists,
   those of near copies above all, are then of one component, and need no more: no list of pairs is ever made of them.
4. Lists with documents of several components are multiplied block by block inside tasks: a row of the product at a
   time, documents outside of the list's largest component only, against those of other components. An entry is
   dropped before its overlap is accumulated if the sizes, or the sizes and the parities of both sets' hashes, rule it out.

Nothing is capped: a list of any length is dealt in blocks of bounded bytes.

Rules: words are runs of bytes other than ASCII white space after lower-casing A-Z; a document's set has its distinct n-grams
(fewer words than the width make one); null counts as empty. A text without words has an empty set and links with
nothing, or, with empty_links, with all others of its kind. N-grams are told by hashes of 48 bits in overlaps and 64 bits in
n_shingles. A null doc_id is larger than any other; a component without any doc_id has a null component_id.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, cut, filled, text_of, tidy
from .components import components, labelled, met, with_labels
from .simhash import fingerprints, pack_gaps, text_hash, unpack_gaps

#: Bits and bytes of a hash that stands for an n-gram in sets.
BITS, BYTES = 48, 6
#: Text bytes in a block of documents; n-grams that a part of the columns gets on average; bits that are sent beyond those that their number needs.
BLOCK_BYTES, PART, SPARE = 4 << 20, 2_000_000, 9
#: Documents that all others of a list are compared with first; up to FEW documents, one of them.
STARS, FEW = 4, 8
#: Documents and bytes of sets in a block of a list; documents in a task where few of a list are outside of its largest component.
BLOCK_DOCS, BLOCK_SET_BYTES, SPREAD_DOCS = 8192, 32 << 20, 512
#: Bits of a parity sketch for each n-gram of a typical set of a list, and the most of a sketch.
FINE, SKETCH_BITS = 4, 1 << 15
BLOCK = "ids binary, none binary, hashes binary, prints binary, digests binary, distinct binary, sizes binary, grams binary"
FOUND = "doc_id long, hash long, fp long, node binary, n_shingles long, n int, keys array<long>, grams binary"


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts on end, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
    some = pc.not_equal(flat, "")
    flat, owner = flat.filter(some), owner.filter(some).to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    own = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.uint64)
    hashes = own[coded.indices.to_numpy(zero_copy_only=False)] if len(own) else np.zeros(0, np.uint64)
    return hashes, np.bincount(owner, minlength=len(texts)).astype(np.int64)


def shingle_runs(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all n-grams of the texts on end, repeats included, and how many each text has."""
    words, counts = word_hashes(texts)
    size = np.minimum(counts, width)
    many = np.where(counts > 0, counts - size + 1, 0)
    begin = np.repeat(np.cumsum(counts) - counts, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    each = np.repeat(size, many)
    h = mixed(each.astype(np.uint64) + np.uint64(width))
    for k in range(width):
        on = each > k
        h[on] = mixed(h[on] ^ words[begin[on] + k])
    return h, many


def packed(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // BYTES, 8), np.uint8)
    out[:, :BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, BYTES)
    return out.view("<u8").ravel()


def needed(n: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """The least overlap that a set of n must have with a similar one."""
    return -(-similarity[0] * n // similarity[1])


def row_blocks(docs: DataFrame, width: int, text: str, empty_links: bool, with_prints: bool) -> DataFrame:
    """BLOCK and block: documents in blocks, one a row, dealt by block. Per document: doc_id (and whether it is null), hash of the
    text, fingerprint, digest of the set, distinct n-grams, size of the set, set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", BLOCK_BYTES):
            runs, counts = shingle_runs(filled(b.column("text")), width)
            stops = np.cumsum(counts)
            each = [np.unique(runs[e - c : e]) for e, c in zip(stops.tolist(), counts.tolist(), strict=True)]
            if empty_links:
                each = [x if x.size else np.zeros(1, np.uint64) for x in each]
            sets = [x >> np.uint64(64 - BITS) for x in each]
            sets = [x if x.size < 2 or (x[1:] != x[:-1]).all() else np.unique(x) for x in sets]
            raws = [packed(x) for x in sets]
            prints = fingerprints(runs, counts) if with_prints else np.zeros(len(each), np.uint64)
            ids = b.column("doc_id").cast(pa.int64())
            row = [
                pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).tobytes(), pc.is_null(ids).to_numpy(zero_copy_only=False).tobytes(), b.column("hash").to_numpy(zero_copy_only=False).tobytes(), prints.tobytes(),
                b"".join(hashlib.blake2b(r, digest_size=16).digest() for r in raws), np.array([x.size for x in each], np.int64).tobytes(), np.array([x.size for x in sets], np.int32).tobytes(), b"".join(raws),
            ]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], names=[c.split()[0] for c in BLOCK.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(text).alias("hash"), F.col(text).alias("text"))
    return rows.mapInArrow(tidy(run), BLOCK).withColumn("block", F.monotonically_increasing_id()).repartition("block")


def shortened(sizes: bytes, digests: bytes, grams: bytes, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: the distinct shortened hashes, how many different sets have each, and for all hashes on end their place among them; the hashes."""
    n, values = np.frombuffer(sizes, np.int32), unpacked(grams)
    own = np.frombuffer(digests, "V16")
    first = np.zeros(len(n), bool)
    first[np.unique(own, return_index=True)[1]] = True
    short, place = np.unique(values >> np.uint64(shift), return_inverse=True)
    times = np.bincount(place[np.repeat(first, n)], minlength=len(short))
    return short, times, place, values


def column_counts(dealt: DataFrame, total: int) -> tuple[DataFrame, int]:
    """(block, counted): for each block the rough counts (see rough) of its shortened hashes, part by part; and the bits that are cut off."""
    part_bits = max(0, math.ceil(math.log2(max(1, total / PART))))
    sent_bits = min(32, BITS - part_bits, SPARE + max(1, math.ceil(math.log2(max(2, total / (1 << part_bits))))))
    shift = BITS - part_bits - sent_bits
    low = np.uint64((1 << sent_bits) - 1)
    floors = np.arange(1 << part_bits, dtype=np.uint64) << np.uint64(sent_bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, sizes, digests, grams in zip(*(b.column(c).to_pylist() for c in ("block", "sizes", "digests", "grams")), strict=True):
                short, times, *_ = shortened(sizes, digests, grams, shift)
                bounds = [*np.searchsorted(short, floors).tolist(), len(short)]
                rows = [(p, block, *pack_gaps(short[s:e] & low), zlib.compress(rough(times[s:e]).tobytes(), 1)) for p, (s, e) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if e > s]
                if rows:
                    p, k, w, g, t = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(k, pa.int64()), pa.array(w, pa.int32()), pa.array(g, pa.binary()), pa.array(t, pa.binary())], names=["part", "block", "width", "gaps", "times"])

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        values = [unpack_gaps(w, g) for w, g in zip(pdf["width"], pdf["gaps"], strict=True)]
        times = np.concatenate([np.exp2(np.frombuffer(zlib.decompress(t), np.uint8) / 8) - 1 for t in pdf["times"]])
        _, place = np.unique(np.concatenate(values), return_inverse=True)
        found = rough(np.bincount(place, times)[place])
        stops = np.cumsum([len(v) for v in values])
        rows = [(b, key[0], zlib.compress(found[e - len(v) : e].tobytes(), 1)) for b, v, e in zip(pdf["block"], values, stops.tolist(), strict=True)]
        return pd.DataFrame(rows, columns=["block", "part", "counted"])

    # all columns, as in the join with the answers, so that both read one exchange
    sent = dealt.mapInArrow(tidy(send), "part int, block long, width int, gaps binary, times binary")
    counted = sent.groupBy("part").applyInPandas(count, "block long, part int, counted binary")
    return counted.groupBy("block").agg(F.collect_list(F.struct("part", "counted")).alias("counted")), shift  # bounded by the hashes of a block


def rough(times: np.ndarray) -> np.ndarray:
    """Counts on a scale of eighths of powers of two: 0 for none, 8 for one, more for more."""
    return np.minimum(255, np.rint(8 * np.log2(1 + times))).astype(np.uint8)


def candidates(docs: DataFrame, width: int, similarity: tuple[int, int], text: str, empty_links: bool, with_prints: bool) -> DataFrame:
    """FOUND for each row of docs. keys and grams: only where enough of the set is shared with others for a link; keys are the shared ones of its first n-grams."""
    total = (docs.agg(F.sum(F.octet_length(text_of(text)))).first()[0] or 0) // 6
    dealt = row_blocks(docs, width, text, empty_links, with_prints)
    counted, shift = column_counts(dealt, total)
    only_one = int(rough(np.ones(1))[0])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                _, _, place, values = shortened(row["sizes"], row["digests"], row["grams"], shift)
                parts = sorted(row["counted"] or [], key=lambda x: x["part"])
                times = np.frombuffer(b"".join(zlib.decompress(x["counted"]) for x in parts), np.uint8)[place] if parts else np.zeros(0, np.uint8)
                n = np.frombuffer(row["sizes"], np.int32)
                stops = np.cumsum(n, dtype=np.int64)
                shared = np.diff(np.append(0, np.append(0, np.cumsum(times > only_one))[stops]))
                least = needed(n.astype(np.int64), similarity)
                digests = [row["digests"][16 * i : 16 * i + 16] for i in range(len(n))]
                keys, grams, once = [None] * len(n), [None] * len(n), set()
                for i in np.flatnonzero((shared >= least) & (n > 0)).tolist():
                    if digests[i] in once:  # copies in a block have the same entries
                        continue
                    once.add(digests[i])
                    own, t = values[stops[i] - n[i] : stops[i]], times[stops[i] - n[i] : stops[i]]
                    first = np.argsort(t, kind="stable")[: n[i] - least[i] + 1]
                    keys[i] = own[first[t[first] > only_one]].astype(np.int64).tolist()
                    grams[i] = row["grams"][BYTES * int(stops[i] - n[i]) : BYTES * int(stops[i])]
                ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=np.frombuffer(row["none"], bool))
                columns = [ids, pa.array(np.frombuffer(row["hashes"], np.int64)), pa.array(np.frombuffer(row["prints"], np.int64)), pa.array(digests, pa.binary()), pa.array(np.frombuffer(row["distinct"], np.int64)), pa.array(n), pa.array(keys, pa.list_(pa.int64())), pa.array(grams, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FOUND.split(", ")])

    return cut(dealt.join(counted, "block", "left").mapInArrow(tidy(choose), FOUND))


def could_link(na: Column, nb: Column, similarity: tuple[int, int]) -> Column:
    return similarity[1] * F.least(na, nb) >= similarity[0] * F.greatest(na, nb)


def verified(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of nodes that are similar. A node without a set in sets (node, grams) has no partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = []
            for x, y in zip(b.column("of_a").to_pylist(), b.column("of_b").to_pylist(), strict=True):
                both = np.intersect1d(unpacked(x), unpacked(y), assume_unique=True).size
                hit.append(similarity[1] * both >= similarity[0] * ((len(x) + len(y)) // BYTES - both))
            yield b.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("of_b")), "b")
    both = with_b.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("of_a")), "a")
    return both.select("a", "b", "of_a", "of_b").mapInArrow(tidy(run), "a binary, b binary")


def sketches(flat: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each set the parities of how many of its hashes have each remainder: where two differ, a hash is in one of them alone."""
    typical = int(np.percentile(sizes, 90))
    bits = min(SKETCH_BITS, 1 << max(6, (FINE * typical).bit_length()))
    at = owner * bits + (flat & np.uint64(bits - 1)).astype(np.int64)
    odd = np.zeros(len(sizes) * bits, np.uint8)
    where, times = np.unique(at, return_counts=True)
    odd[where] = times & 1
    return np.packbits(odd.reshape(len(sizes), bits), axis=1).view(np.uint64)


def product_links(grams: list[bytes], roots: np.ndarray, main: bytes, rows: np.ndarray, columns: np.ndarray, similarity: tuple[int, int]) -> list[tuple[int, int]]:
    """(row, column) pairs of similar sets that join all components that such pairs between rows and columns join.

    rows, columns: which of the sets are rows and columns of the product; main: the root of the largest component, which has
    no rows. An entry within one component is not needed.
    """
    sizes = np.array([len(g) // BYTES for g in grams], np.int64)
    flat = unpacked(b"".join(grams))
    owner = np.repeat(np.arange(len(grams)), sizes)
    plane = sketches(flat, owner, sizes)
    _, gram = np.unique(flat, return_inverse=True)
    begin = np.cumsum(sizes) - sizes
    names, root = np.unique(roots, return_inverse=True)
    root, done, out = root.astype(np.int64), np.zeros(len(grams), bool), []
    at = np.flatnonzero(names == main)
    main_ = int(at[0]) if len(at) else -1
    # then what joins the largest component on the way needs no row of its own: all others have theirs here
    whole = bool((rows | ~columns | (root == main_)).all())
    inside = np.zeros(int(gram.max()) + 1, bool)
    weight = np.bincount(root)
    up, down = similarity[1] + similarity[0], similarity[1] - similarity[0]
    for i in sorted(np.flatnonzero(rows).tolist(), key=lambda i: (weight[root[i]], i)):
        if whole and root[i] == main_:
            continue
        # a row that is done has met this one if this is a column, too
        open_ = np.flatnonzero(columns & (root != root[i]) & ~(done & columns[i]))
        open_ = open_[similarity[1] * np.minimum(sizes[open_], sizes[i]) >= similarity[0] * np.maximum(sizes[open_], sizes[i])]
        apart = np.bitwise_count(plane[open_] ^ plane[i]).sum(axis=1, dtype=np.int64)
        open_ = open_[up * apart <= down * (sizes[open_] + sizes[i])]
        if open_.size:
            own = gram[begin[i] : begin[i] + sizes[i]]
            inside[own] = True
            # a row of the product: overlaps with all that are left
            at = np.repeat(begin[open_] - (np.cumsum(sizes[open_]) - sizes[open_]), sizes[open_]) + np.arange(int(sizes[open_].sum()))
            overlap = np.add.reduceat(inside[gram[at]].astype(np.int64), np.cumsum(sizes[open_]) - sizes[open_])
            inside[own] = False
            for j in open_[similarity[1] * overlap >= similarity[0] * (sizes[open_] + sizes[i] - overlap)].tolist():
                if root[j] != root[i]:
                    out.append((i, j))
                    old, new = (root[i], root[j]) if root[j] == main_ else (root[j], root[i])
                    root[root == old] = new
        done[i] = columns[i]
    return out


def product_blocks(apart: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Links (a, b) that join the components of lists. apart: h, node, n, root; several roots at each h."""
    weight = apart.groupBy("h", "root").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("grams"))
    lists = weight.groupBy("h").agg(F.max(F.struct("docs", "root")).alias("top"), F.sum("docs").alias("docs"), F.sum("grams").alias("grams"))
    parts = lambda docs, grams: F.greatest(F.lit(1), F.ceil(F.col(docs) / BLOCK_DOCS), F.ceil(F.col(grams) * BYTES / BLOCK_SET_BYTES)).cast("int")
    # blocks of rows have documents outside of the largest component only
    movers = weight.join(lists.select("h", F.col("top.root").alias("main")), "h").where("root != main").groupBy("h").agg(F.sum("docs").alias("moving"), F.sum("grams").alias("moving_grams"))
    # where few move, they meet the others in more tasks; that sends twice the list's rows at most
    spread = F.least(F.ceil(F.col("docs") / SPREAD_DOCS), F.floor(F.col("docs") / F.col("moving"))).cast("int")
    shape = lists.join(movers, "h").select(F.col("h").alias("_key"), F.col("top.root").alias("main"), parts("moving", "moving_grams").alias("high"), F.greatest(parts("docs", "grams"), spread).alias("wide"))
    rows = met(apart.select("h", "node", "root"), "h", shape)
    spot = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    column = rows.select("h", "node", "root", "main", F.explode(F.sequence(F.lit(0), F.col("high") - 1)).alias("i"), spot("wide").alias("j"), F.lit(False).alias("row"))
    moving = rows.where("root != main").select("h", "node", "root", "main", spot("high").alias("i"), F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("j"), F.lit(True).alias("row"))
    dealt = column.unionByName(moving).groupBy("h", "i", "j", "node").agg(F.first("root").alias("root"), F.first("main").alias("main"), F.max("row").alias("row"), F.max(~F.col("row")).alias("column"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if not pdf["row"].any() or not pdf["column"].any():
            return pd.DataFrame({"a": [], "b": []})
        node = pdf["node"].tolist()
        found = product_links(pdf["grams"].tolist(), pdf["root"].to_numpy(), pdf["main"].iloc[0], pdf["row"].to_numpy(bool), pdf["column"].to_numpy(bool), similarity)
        return pd.DataFrame([(min(node[i], node[j]), max(node[i], node[j])) for i, j in found], columns=["a", "b"])

    return dealt.join(sets, "node").groupBy("h", "i", "j").applyInPandas(run, "a binary, b binary").distinct()


def entry_lists(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The product's lists: (h, node, n, g) for each document of a list, and (_key, g, star_0 ...) for each list h. g: documents of the list."""
    shared = found.where("keys IS NOT NULL").select("node", "n", F.explode("keys").alias("h"))
    # copies in other blocks must not count again in what is summed over nodes
    shared = shared.groupBy("h", "node").agg(F.first("n").alias("n"))
    stars = [F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("at"), "node", "n")).alias(f"star_{k}") for k in range(STARS)]
    lists = shared.groupBy("h").agg(F.count(F.lit(1)).alias("g"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(STARS))).alias("y"), *stars).where("g > 1")
    # lists of the same documents: one stays, and stars are the same
    lists = cut(lists.groupBy("g", "x", "y").agg(F.min("h").alias("_key"), *(F.first(f"star_{k}").alias(f"star_{k}") for k in range(STARS))).drop("x", "y"))
    return cut(met(shared, "h", lists.select("_key", "g"))), lists


def links(found: DataFrame, similarity: tuple[int, int], seeds: DataFrame | None = None) -> DataFrame:
    """(a, b): links between nodes of found (FOUND) whose closure is that of all similar pairs. seeds: pairs (a, b) that may be similar, to be compared first."""
    sets = found.where("grams IS NOT NULL").select("node", "grams").dropDuplicates(["node"])
    linked = cut(verified(seeds, sets, similarity)) if seeds is not None else None
    both, lists = entry_lists(found)
    at = both.join(lists.select(F.col("_key").alias("h"), F.when(F.col("g") <= FEW, F.array("star_0")).otherwise(F.array(*(f"star_{k}" for k in range(STARS)))).alias("stars")), "h")
    star = at.select("node", "n", F.explode("stars").alias("star")).where((F.col("star.node") != F.col("node")) & could_link(F.col("star.n"), F.col("n"), similarity))
    star = star.select(F.least("node", "star.node").alias("a"), F.greatest("node", "star.node").alias("b")).distinct()
    if linked is not None:
        star = between(star, components(linked))
    first = cut(verified(star, sets, similarity))
    linked = cut(linked.unionByName(first)) if linked is not None else first

    of = with_roots(both.where("g > 2").select("h", "node", "n"), "node", components(linked)).withColumn("root", F.coalesce("root", "node"))
    several = of.groupBy("h").agg(F.min("root").alias("least"), F.max("root").alias("last")).where("least != last").select(F.col("h").alias("_key"))
    apart = cut(met(of, "h", several))
    return linked.unionByName(product_blocks(apart, sets, similarity))


def with_roots(rows: DataFrame, key: str, roots: DataFrame) -> DataFrame:
    """rows with root of the node in column key, null where it has no edge."""
    return rows.join(roots.select(F.col("node").alias(f"_{key}"), "root"), F.col(key) == F.col(f"_{key}"), "left").drop(f"_{key}")


def between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different components."""
    both = with_roots(with_roots(pairs, "a", roots).withColumnRenamed("root", "of_a"), "b", roots).withColumnRenamed("root", "of_b")
    return both.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def near_groups(docs: DataFrame, width: int = 4, similarity: tuple[int, int] = (85, 100), text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach, its own included) for each row of docs."""
    found = candidates(docs, width, similarity, text, False, False)
    some = found.where("n > 0")
    labels = labelled(some.select("doc_id", "node"), components(links(found, similarity)))
    none = found.where("n = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return with_labels(some.select("doc_id", "n_shingles", "node"), "node", labels).select("doc_id", "n_shingles", "component_id").unionByName(none)
