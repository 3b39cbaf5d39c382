"""Secret scanning with a password guess-cost model.

Base rules find assignments, access keys and long hex runs. In credential
contexts (assignments, and looser ones such as `pwd is "..."`) the value's guess
cost is the least over all ways to cut it into words, dates, repeats, keyboard
walks and brute-force spans: a dynamic program over the value's characters, in
bits (log2 of guesses). Values that cost LEAST_BITS or more add a span of kind
`guess`. Base spans stay whatever they cost.

A word costs the logarithm of its rank. Ranks are those of a short list of usual
passwords and placeholders, then of the words of the corpus itself by how often
they occur: all texts are counted, and the LEXICON most frequent are kept.

Spans are code points, end exclusive. Null counts as empty. A span row is given
as often as its document row occurs.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, as_batch, blocks, filled, text_of

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Looser credential contexts; the value has no white space or quotes.
CONTEXT = re.compile(r"""\b(?:password|passwd|passphrase|passcode|pwd|secret|token|api[_-]?key|credentials?|private[_-]?key|auth(?:orization)?)["']?\x20*(?:[:=]|=>|is)\x20*["']?([^\s"'<>]{8,})""", re.ASCII | re.IGNORECASE)
#: Any of these in lower case must be in a text before the slower patterns are tried.
HINTS = ("pass", "pwd", "secret", "token", "api", "credential", "private", "auth")
KINDS = ("assign", "access", "hex", "guess")
LEAST_BITS = 40.0

#: Common words of passwords and placeholders, most frequent first; a parameter of guess_bits.
WORDS = tuple(
    "password admin secret token example test welcome login letmein dragon master monkey shadow sunshine princess football baseball superman batman trustno iloveyou "
    "changeme default user root guest demo sample dummy key api access server local host public private data base prod staging dev none null true false your my the "
    "here value string text name pass word code hello world love summer winter spring autumn january february march april may june july august september october "
    "november december monday tuesday wednesday thursday friday saturday sunday abc xyz foo bar".split()
)
#: Words that are learned from the corpus at most, and their lengths.
LEXICON, WORD_CHARS = 20_000, (3, 16)
#: Rows of the keyboard; a walk goes along them in either direction.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("4301$5@7", "aeoissat")
LETTERS = re.compile(r"[^\W\d_]+")
DATES = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:(?:19|20)?\d\d)")
#: The longest unit that a repeat is looked for with.
UNIT = 16
#: Guesses for: a year or date by its digits; the start and turn of a walk.
DAYS, STARTS = 365.25 * 100, 4 * 47


def alphabet(text: str) -> int:
    """Size of the character classes that text draws from."""
    return max(2, 26 * any(c.islower() for c in text) + 26 * any(c.isupper() for c in text) + 10 * any(c.isdigit() for c in text) + 33 * any(not c.isalnum() for c in text))


class Lexicon:
    """Ranks of words from 1, the earlier place where a word occurs twice, and the longest word's length."""

    def __init__(self, words: Iterable[str]):
        self.rank: dict[str, int] = {}
        for w in words:
            self.rank.setdefault(w, len(self.rank) + 1)
        self.longest = max(map(len, self.rank), default=0)


@lru_cache(maxsize=1)
def usual() -> Lexicon:
    return Lexicon(WORDS)


def frequent_words(docs: DataFrame, most: int = LEXICON, text: str = "text") -> list[str]:
    """The words (runs of letters, lower-cased) of all texts that occur most often, ties by name. At most `most` reach the driver.

    Each block of texts is split and counted first, so a word is shuffled once a block however often it occurs.
    """
    low, high = WORD_CHARS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", BLOCK_BYTES // 2):
            chunks = pc.value_counts(pc.ascii_split_whitespace(pc.utf8_lower(filled(b.column("text")))).flatten())
            counts: dict[str, int] = {}
            for chunk, n in zip(chunks.field("values").to_pylist(), chunks.field("counts").to_pylist(), strict=True):
                for w in LETTERS.findall(chunk):
                    if low <= len(w) <= high:
                        counts[w] = counts.get(w, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    counted = docs.select(text_of(text).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(most).collect()]


def next_on_rows() -> dict[tuple[str, str], int]:
    """(character, next one) to the direction of a step along a row."""
    return {(a, b): d for row in ROWS for x, y in zip(row[:-1], row[1:], strict=True) for a, b, d in ((x, y, 1), (y, x, -1))}


STEPS = next_on_rows()


def segments(value: str, words: Lexicon | None = None) -> Iterator[tuple[int, int, str, float]]:
    """(start, end, kind, bits) of each word, date, repeat and walk in value."""
    words = words or usual()
    rank, longest = words.rank, words.longest
    low = value.lower()
    plain = low.translate(LEET)
    n = len(value)
    for i in range(n):
        for j in range(i + 3, min(n, i + longest) + 1):
            for form, extra in ((low, 0.0), (plain, 2.0)):
                if (r := rank.get(form[i:j])) and (form is low or form[i:j] != low[i:j]):
                    part = value[i:j]
                    case = 0.0 if part == low[i:j] else 1.0 if part.isupper() or part[0].isupper() and part[1:] == low[i + 1 : j] else sum(math.log2(j - i) for c in part if c.isupper())
                    yield i, j, "word", math.log2(r) + 1 + extra + case
    for i in range(n):
        for m in (DATES.match(value, i), DATES.match(value, i, i + 4)):
            if m:
                yield i, m.end(), "date", math.log2(100 if m.end() - i == 4 else DAYS) + 2 * any(c in "-/." for c in m[0])
    for size in range(1, min(UNIT, n // 2) + 1):  # from each place, the longest run of a unit that begins there
        same = 0
        for i in range(n - size - 1, -1, -1):
            same = same + 1 if value[i] == value[i + size] else 0
            times = same // size + 1
            if times > 1 and times * size >= 3:
                yield i, i + times * size, "repeat", size * math.log2(alphabet(value[i : i + size])) + math.log2(times)
    i = 0
    while i < n - 2:
        j, turns, way = i, 0, 0
        while j + 1 < n and (d := STEPS.get((low[j], low[j + 1]))):
            turns += d != way
            way = d
            j += 1
        if j - i >= 2:
            yield i, j + 1, "walk", math.log2(STARTS) + turns * math.log2(4) + math.log2(j - i + 1)
        i = max(j, i + 1)


def guess_bits(value: str, words: Lexicon | None = None) -> float:
    """The least guess cost of value in bits; 0 for an empty one. Each further segment costs one bit for its place."""
    n = len(value)
    by_end: dict[int, list[tuple[int, float]]] = {}
    for start, end, _, bits in segments(value, words):
        by_end.setdefault(end, []).append((start, bits))
    each = math.log2(alphabet(value))
    best, brute = [0.0] * (n + 1), [0.0] * (n + 1)  # brute: best ending in a brute-force span
    for j in range(1, n + 1):
        # a brute-force character goes on with a span (no new segment) or begins one
        brute[j] = each + (min(brute[j - 1], best[j - 1] + 1) if j > 1 else 0.0)
        best[j] = min([brute[j], *(best[s] + bits + (s > 0) for s, bits in by_end.get(j, ()))])
    return best[n]


def base_spans(text: str, low: str | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules."""
    low = text.lower() if low is None else low
    out = []
    if any(h in low for h in ("password", "passwd", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def guess_spans(text: str, low: str, least: float = LEAST_BITS, words: Lexicon | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of values in credential contexts that cost least bits or more."""
    if not any(h in low for h in HINTS):
        return []
    values = {m.span(2) for m in ASSIGN.finditer(text)} | {m.span(1) for m in CONTEXT.finditer(text)}
    out, reached = [], 0
    for start, end in sorted(values, key=lambda v: (v[0], -v[1])):
        if end > reached:  # a value inside another one says nothing more
            reached = end
            if guess_bits(text[start:end], words) >= least:
                out.append((start, 3, end))
    return out


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


SCAN = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_guess", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def scan_secrets(docs: DataFrame, least_bits: float = LEAST_BITS, text: str = "text", learned: int = LEXICON) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_guess, base_sha256 and spans for each row of docs, from its whole text.

    learned: how many words of the corpus the guess cost knows besides the usual ones.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Lexicon([*WORDS, *frequent_words(docs, learned, text)]) if learned else usual())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for b in blocks(batches, text):
            rows = []
            for doc, t in zip(b.column("doc_id").to_pylist(), filled(b.column(text)).to_pylist(), strict=True):
                low = t.lower()
                base = base_spans(t, low)
                more = guess_spans(t, low, least_bits, words)
                rows.append((doc, *(sum(x[1] == k for x in base) for k in range(3)), len(more), hashlib.sha256(shown(base).encode()).hexdigest(), shown(base + more)))
            yield as_batch(SCAN, *map(list, zip(*rows, strict=True)))

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")
