"""Scalar column functions with the null, tie and cast rules that profile tables need.

Missing matches are null, unreadable numbers and dates are null, division by zero is null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extract_group(c: C, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null without a match or if the group is empty."""
    return F.nullif(F.regexp_extract(col(c), pattern, group), F.lit(""))


def replace_first(c: C, pattern: str, by: str) -> Column:
    """The first match replaced, the others left. The pattern has no groups; by is literal."""
    return F.regexp_replace(col(c), f"(?s)^(.*?)(?:{pattern})", "$1" + by.replace("\\", "\\\\").replace("$", "\\$"))


def replace_all(c: C, pattern: str, by: str) -> Column:
    return F.regexp_replace(col(c), pattern, by)


def nth_field(c: C, separator: str, n: int) -> Column:
    """The n-th field from 0; null past the end."""
    return F.get(F.split(col(c), separator), F.lit(n))


def last_field(c: C, separator: str) -> Column:
    return F.element_at(F.split(col(c), separator), -1)


def split_fields(c: C, separator: str, names: Sequence[str]) -> Column:
    """A struct of the first len(names) fields; the last takes the rest."""
    parts = F.split(col(c), separator, len(names))
    return F.struct(*(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)))


def drop_last_part(c: C, separator: str = "_") -> Column:
    """Text up to the last separator (the group of a sample id)."""
    return F.regexp_replace(col(c), f"{separator}[^{separator}]*$", "")


def rank_token(c: C, prefix: str, separator: str = ";") -> Column:
    """The name at the rank that prefix marks in a lineage such as d__A;p__B; null if absent or empty."""
    return extract_group(c, f"(?:^|{separator}){prefix}([^{separator}]*)", 1)


def strip_suffix(c: C, pattern: str = "_[A-Z]+") -> Column:
    return F.regexp_replace(col(c), f"{pattern}$", "")


def normal_id(c: C, prefix: str = "", version: str = r"\.\d+") -> Column:
    """An id without a literal prefix and without its version."""
    out = F.regexp_replace(col(c), f"{version}$", "")
    return F.when(out.startswith(prefix), F.substring(out, len(prefix) + 1, 1 << 30)).otherwise(out) if prefix else out


def fraction(c: C) -> Column:
    """a/b as a number."""
    parts = F.split(col(c), "/")
    return F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double"))


def range_width(c: C) -> Column:
    """hi - lo of lo-hi."""
    parts = F.split(col(c), "-")
    return F.get(parts, F.lit(1)).try_cast("double") - F.get(parts, F.lit(0)).try_cast("double")


def ordinal(c: C, levels: Sequence[str], default: int | None = None) -> Column:
    """Position of the value among levels."""
    out = F.when(F.lit(False), F.lit(0))
    for i, level in enumerate(levels):
        out = out.when(col(c) == level, F.lit(i))
    return out.otherwise(F.lit(default).cast("int"))


def safe_double(c: C) -> Column:
    return col(c).try_cast("double")


def safe_date(c: C, shape: str = r"^\d{4}-\d{2}-\d{2}$") -> Column:
    """A date where the text has the shape and names a day; null elsewhere."""
    return F.when(col(c).rlike(shape), col(c).try_cast("date"))


def null_tokens(c: C, tokens: Sequence[str] = ("NA", "-", "", "NULL")) -> Column:
    return F.when(~col(c).isin(*tokens), col(c))


def binned(c: C, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval [edges[i], edges[i+1]); null outside."""
    out = F.when(F.lit(False), F.lit(""))
    for low, high, label in zip(edges[:-1], edges[1:], labels, strict=True):
        out = out.when((col(c) >= low) & (col(c) < high), F.lit(label))
    return out


def stepped(c: C, steps: Sequence[tuple[float, str]], above: str) -> Column:
    """Label of the first threshold that the value lies below; above if none; null for null."""
    out = F.when(col(c).isNull(), F.lit(None).cast("string"))
    for limit, label in steps:
        out = out.when(col(c) < limit, F.lit(label))
    return out.otherwise(F.lit(above))


def keyword_class(c: C, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """Category of the first rule whose pattern (case ignored) is found in the text."""
    out = F.when(F.lit(False), F.lit(""))
    for pattern, label in rules:
        out = out.when(col(c).rlike(f"(?i){pattern}"), F.lit(label))
    return out.otherwise(F.lit(default).cast("string"))


def reverse_complement(c: C) -> Column:
    return F.reverse(F.translate(col(c), "ACGT", "TGCA"))


def count_letter(c: C, letter: str) -> Column:
    return F.length(col(c)) - F.length(F.replace(col(c), F.lit(letter), F.lit("")))


def any_in(c: C, values: Sequence[str]) -> Column:
    """True if an element of the list column is one of the values."""
    return F.exists(col(c), lambda x: x.isin(*values))


def true_count(*flags: C) -> Column:
    """How many flags are true; null counts as false."""
    total = F.lit(0)
    for f in flags:
        total = total + F.coalesce(col(f), F.lit(False)).cast("int")
    return total


def ratio(a: C, b: C) -> Column:
    return F.try_divide(col(a), col(b))


def share(c: C, *by: str) -> Column:
    """The row's share of the sum in its group."""
    return F.try_divide(col(c), F.sum(col(c)).over(Window.partitionBy(*by)))


def average_rank(by: Sequence[C], value: C) -> Column:
    """Rank in the group with ties averaged; null values have no rank and do not count."""
    by = [col(b) for b in by]
    there = col(value).isNotNull()
    tied = Window.partitionBy(*by, col(value))
    return F.when(there, F.rank().over(Window.partitionBy(*by).orderBy(col(value).asc_nulls_last())) + (F.count(col(value)).over(tied) - 1) / 2)


def z_score(value: C, over: WindowSpec, least: int = 2) -> Column:
    """(x - mean) / sd of the partition; null if it has fewer than least values or no spread."""
    sd = F.stddev_samp(col(value)).over(over)
    return F.when((F.count(col(value)).over(over) >= least) & (sd > 0), (col(value) - F.avg(col(value)).over(over)) / sd)


def distinct_with_null(c: C) -> Column:
    """Distinct values, null being one."""
    return F.countDistinct(col(c)) + F.coalesce(F.max(col(c).isNull().cast("int")), F.lit(0))


def wilson(successes: C, n: C, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval; null for n = 0."""
    k, m = col(successes).cast("double"), F.when(col(n) > 0, col(n).cast("double"))
    p = k / m
    middle = (p + z * z / (2 * m)) / (1 + z * z / m)
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    return F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)


def hashed(*parts: C, seed: int = 1) -> Column:
    """A hexadecimal hash of the parts and a seed, for orders and draws that can be repeated anywhere."""
    return F.md5(F.concat_ws(":", *(col(p).cast("string") for p in parts), F.lit(str(seed))).cast("binary"))


def hashed_number(*parts: C, seed: int = 1) -> Column:
    """A number below 2**32 from the same hash."""
    return F.conv(F.substring(hashed(*parts, seed=seed), 1, 8), 16, 10).cast("long")
