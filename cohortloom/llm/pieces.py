"""Subword pieces of white-space separated chunks, looked up once per distinct chunk.

For tokenizers whose pre-tokens never cross ASCII white space (word_bpe_49k is
one), the pieces of a text are those of its chunks in order. A block of texts is
split and dictionary-encoded by Arrow, so the tokenizer sees each distinct chunk
once, and a worker remembers chunks between blocks.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks that a worker remembers before it starts afresh.
REMEMBERED = 100_000
#: Chunks made of these characters alone are normalised here; all others go through the library's whole pipeline.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: The pre-tokens of word_bpe_49k in lower-cased text of the characters above.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def byte_letters() -> dict[int, str]:
    """The usual byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Pieces:
    """Numbers of pieces, and ids, of chunks by a tokenizers file."""

    loaded: dict[str, Pieces] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        #: Ids as little-endian unsigned 32-bit numbers: a worker remembers very many, and objects would take four times the memory.
        self.parts: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.part_sizes: dict[str, int] = {}
        self.sizes: dict[str, int] = {}

    @classmethod
    def of(cls, path: str) -> Pieces:
        """One instance a worker process."""
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def pieces(self, part: str) -> list:
        return self.model.tokenize(part if part.isascii() else "".join(self.letters[b] for b in part.encode()))

    def part(self, text: str) -> bytes:
        got = self.parts.get(text)
        if got is None:
            got = self.parts[text] = array("I", [t.id for t in self.pieces(text)]).tobytes()
        return got

    def size(self, chunk: str) -> int:
        """The number of pieces of a chunk; ids are not kept."""
        got = self.sizes.get(chunk)
        if got is None:
            if "<|" not in chunk and PLAIN.fullmatch(chunk):
                got = 0
                for part in PARTS.findall(chunk.lower()):
                    n = self.part_sizes.get(part)
                    if n is None:
                        n = self.part_sizes[part] = len(self.pieces(part))
                    got += n
            else:
                got = len(self.tokenizer.encode(chunk, add_special_tokens=False))
            self.sizes[chunk] = got
        return got

    def counts(self, chunks: pa.Array) -> list[int]:
        """The number of pieces of each chunk."""
        if len(self.sizes) > REMEMBERED:
            self.sizes, self.part_sizes = {}, {}
        return [self.size(c) for c in chunks.to_pylist()]

    def chunk(self, chunk: str) -> bytes:
        """The ids of a chunk, which has no ASCII white space."""
        got = self.chunks.get(chunk)
        if got is None:
            if "<|" not in chunk and PLAIN.fullmatch(chunk):
                got = b"".join([self.part(part) for part in PARTS.findall(chunk.lower())])
            else:
                got = array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
            self.chunks[chunk] = got
        return got

    def table(self, chunks: pa.Array) -> list[bytes]:
        if len(self.chunks) > REMEMBERED:
            self.chunks, self.parts = {}, {}
        return [self.chunk(c) for c in chunks.to_pylist()]


def split_chunks(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of the texts of a block: where each one's chunks begin (and the end), the distinct chunks, and each chunk's number among them."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    bounds = lists.offsets.to_numpy()
    bounds = bounds - bounds[0]
    # white space at the ends of a text leaves empty chunks there; they have no pieces
    coded = flat.dictionary_encode()
    return bounds, coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
