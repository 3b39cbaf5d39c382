"""Cost-balanced packing of documents into sequences.

Documents are tokenised where they are read and packed there, a window of tokens
at a time, so nothing is shuffled and no state crosses tasks. Inside a window:

1. A document longer than a sequence gives up whole sequences from its front.
2. What is left over goes, longest first, to the sequence with the lowest cost
   among those that have room. A piece of n tokens costs linear * n + quadratic
   * n * n, as attention inside the piece does.
3. A document for which no sequence has room is cut over the sequences that have
   the most room, so that the window's sequences end up full.

A window has exactly as many sequences as its tokens fill. The rest of the last
window of a task is cut into sequences whose lengths are powers of two, which
need no padding.

Null text counts as empty: the document is then its end id alone. Repeated rows
are packed as often as they occur.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import as_batch, blocks, filled, tidy
from .pieces import Pieces, split_chunks

#: Tokens that a task packs at once.
WINDOW_TOKENS = 2_000_000
PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("cost", pa.float64())])
PIECE_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"
#: A part of a document: its row, where it begins in it, its length.
Part = tuple[int, int, int]


def token_ids(texts: pa.Array, pieces: Pieces, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts on end, each followed by end, and the bounds of each text in them."""
    bounds, distinct, number = split_chunks(texts)
    table = pieces.table(distinct)
    sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
    flat = np.frombuffer(b"".join(table), np.uint32)
    begin = np.cumsum(sizes) - sizes
    take = sizes[number]
    stop = np.cumsum(take)
    ids = flat[np.repeat(begin[number] - (stop - take), take) + np.arange(stop[-1] if len(stop) else 0)]
    ends = np.concatenate([[0], stop])[bounds[1:]]
    out = np.insert(ids, ends, np.uint32(end))
    return out, np.concatenate([[0], ends + np.arange(1, len(texts) + 1)])


def pack(lengths: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float | None = None) -> tuple[list[list[Part]], list[Part]]:
    """Full sequences as lists of parts, and the parts left over (fewer tokens than one sequence)."""
    quadratic = 1 / capacity if quadratic is None else quadratic
    full: list[list[Part]] = []
    rest: list[Part] = []
    for row, n in enumerate(lengths.tolist()):
        whole = n // capacity
        full += [[(row, i * capacity, capacity)] for i in range(whole)]
        if n % capacity:
            rest.append((row, whole * capacity, n % capacity))
    rest.sort(key=lambda p: (-p[2], p[0]))
    count = sum(p[2] for p in rest) // capacity
    bins: list[list[Part]] = [[] for _ in range(count)]
    room, cost = np.full(count, capacity), np.zeros(count)
    over: list[Part] = []
    for part in rest:
        n = part[2]
        priced = np.where(room >= n, cost, np.inf)
        i = int(priced.argmin()) if count else 0
        if not count or priced[i] == np.inf:
            over.append(part)
            continue
        bins[i].append(part)
        room[i] -= n
        cost[i] += linear * n + quadratic * n * n
    # cut what found no room, longest first, over the sequences with the most room
    gaps = sorted((i for i in range(count) if room[i]), key=lambda i: (room[i], -i))
    left: list[Part] = []
    for row, start, n in over:
        while n and gaps:
            i = gaps[-1]
            take = min(n, int(room[i]))
            bins[i].append((row, start, take))
            room[i] -= take
            start, n = start + take, n - take
            if not room[i]:
                gaps.pop()
        if n:
            left.append((row, start, n))
    return full + bins, left


def powers(parts: list[Part]) -> list[list[Part]]:
    """The parts, in order, in sequences whose lengths are the powers of two of their total, largest first."""
    total, out = sum(p[2] for p in parts), []
    todo = list(reversed(parts))
    for bit in reversed(range(total.bit_length())):
        size, own = total & (1 << bit), []
        while size:
            row, start, n = todo.pop()
            take = min(n, size)
            own.append((row, start, take))
            size -= take
            if n > take:
                todo.append((row, start + take, n - take))
        if own:
            out.append(own)
    return out


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end: int = 2, linear: float = 1.0, quadratic: float | None = None, text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost.

    sequence_id is unique over the table: the task's partition in the upper bits, a running number below.
    """
    quad = 1 / capacity if quadratic is None else quadratic

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(path)
        base, made = TaskContext.get().partitionId() << 40, 0
        # (doc_id, ids, where they begin in the document, the document's tokens) that wait for a full window
        held: list[tuple[int | None, np.ndarray, int, int]] = []
        waiting = 0

        def rows(sequences: list[list[Part]]) -> pa.RecordBatch:
            nonlocal made
            out = [[] for _ in PIECE]
            for parts in sequences:
                offset = 0
                for row, start, n in parts:
                    doc, ids, first, total = held[row]
                    for column, value in zip(out, (doc, first + start, n, zlib.crc32(ids[start : start + n].astype("<u4").tobytes()), total, base + made, offset, linear * n + quad * n * n), strict=True):
                        column.append(value)
                    offset += n
                made += 1
            return as_batch(PIECE, *out)

        for b in blocks(batches, text, 2 << 20):
            ids, bounds = token_ids(filled(b.column(text)), pieces, end)
            held += [(d, ids[s:e], 0, int(e - s)) for d, s, e in zip(b.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            waiting += len(ids)
            if waiting >= WINDOW_TOKENS:
                full, left = pack(np.array([len(h[1]) for h in held]), capacity, linear, quad)
                yield rows(full)
                held = [(held[r][0], held[r][1][s : s + n].copy(), held[r][2] + s, held[r][3]) for r, s, n in left]
                waiting = sum(len(h[1]) for h in held)
        if held:
            full, left = pack(np.array([len(h[1]) for h in held]), capacity, linear, quad)
            yield rows(full + powers(left))

    return docs.select("doc_id", text).mapInArrow(tidy(run), PIECE_DDL)
