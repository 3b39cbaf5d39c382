"""Token counts without token ids.

For a block of texts, the distinct pre-tokens (white-space separated chunks) get
their number of pieces once each; each document has its pre-tokens as numbers
into that list, so the join to its frequencies is one gather and the count one
sum. Ids of texts are never made. Blocks follow the input's partitions: nothing
is shuffled, and a text of any length is one row of one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import as_batch, blocks, filled
from .pieces import Pieces, split_chunks

COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("n_chunks", pa.int64()), ("n_distinct", pa.int64()), ("over_limit", pa.bool_())])


def count_block(texts: pa.Array, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n_tokens, n_chunks and n_distinct of each text."""
    bounds, distinct, number = split_chunks(texts)
    sizes = np.array(pieces.counts(distinct), np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    # frequency of each (document, pre-token), then the join to the pieces of that pre-token
    pair, frequency = np.unique(row * np.int64(max(1, len(distinct))) + number, return_counts=True)
    at, token = np.divmod(pair, max(1, len(distinct)))
    real = np.array([bool(x) for x in distinct.to_pylist()], bool) if len(distinct) else np.zeros(0, bool)
    total = lambda w: np.bincount(at, w, len(texts)).astype(np.int64)  # noqa: E731  exact: sums stay far below 2**53
    return total(frequency * sizes[token]), total(frequency * real[token]), total(real[token].astype(np.int64))


def token_counts(docs: DataFrame, path: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), and the document's chunks and distinct chunks.

    Null counts as empty; an empty text has no tokens. path: a tokenizers file whose pre-tokens end at ASCII
    white space; special strings inside texts are handled as the library does by default.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(path)
        for b in blocks(batches, text, 2 << 20):
            texts = filled(b.column(text))
            n, chunks, distinct = count_block(texts, pieces)
            yield as_batch(COUNTS, b.column("doc_id").cast(pa.int64()), pc.cast(pc.binary_length(texts), pa.int64()), n, chunks, distinct, n > limit)

    return docs.select("doc_id", text).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, n_chunks long, n_distinct long, over_limit boolean")
