"""Approximate distinct counts and quantiles, for tables where the exact ones cost too much; exact is the default everywhere else.

A sketch column has bounded size whatever it has seen, and sketches merge. So a table of sketches by the finest keys, made in
one pass and written once, answers for every coarser key without another scan: a roll-up merges rows of the sketch table.

Distinct counts: HyperLogLog; the relative standard error is about 1.04 / sqrt(2 ** precision), 1.6 % by default. Quantiles:
KLL; the value's rank is within about 1.7 % of n by default (K = 200), so a value of a small group is exact. Nulls do not count.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a HyperLogLog's register number; size of a KLL level.
PRECISION, K = 12, 200


def distinct_error(precision: int = PRECISION) -> float:
    """Relative standard error of a distinct count."""
    return 1.04 / math.sqrt(2**precision)


def sketch(df: DataFrame, keys: Sequence[str], distinct: Sequence[str] = (), numbers: Sequence[str] = (), precision: int = PRECISION, k: int = K) -> DataFrame:
    """keys, n (rows), hll_x for each distinct column and kll_x for each numeric one."""
    counts = [F.hll_sketch_agg(F.col(x), F.lit(precision)).alias(f"hll_{x}") for x in distinct]
    values = [F.kll_sketch_agg_double(F.col(x).cast("double"), F.lit(k)).alias(f"kll_{x}") for x in numbers]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *counts, *values)


def roll_up(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sketch table by fewer, or other, keys of its rows."""
    merged = [F.hll_union_agg(x, F.lit(True)).alias(x) for x in sketches.columns if x.startswith("hll_")]
    merged += [F.kll_merge_agg_double(x).alias(x) for x in sketches.columns if x.startswith("kll_")]
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), *merged)


def roll_up_levels(sketches: DataFrame, levels: Sequence[Sequence[str]]) -> DataFrame:
    """One table for several levels of a hierarchy, finest first: level, and the keys of each (null above it). Each level merges the rows of the one below it."""
    out, now, names = None, sketches, list(levels[0])
    for i, keys in enumerate(levels):
        now = roll_up(now, keys)
        here = now.select(F.lit(i).alias("level"), *(F.col(n).cast("string").alias(n) if n in keys else F.lit(None).cast("string").alias(n) for n in names), *(x for x in now.columns if x not in keys))
        out = here if out is None else out.unionByName(here)
    return out


def estimates(sketches: DataFrame, quantiles: dict[str, float] | None = None) -> DataFrame:
    """The table with distinct_x in place of hll_x, and x_name for each named quantile in place of kll_x."""
    new = {f"distinct_{x[4:]}": F.hll_sketch_estimate(x) for x in sketches.columns if x.startswith("hll_")}
    for x in sketches.columns:
        if x.startswith("kll_"):
            some = F.kll_sketch_get_n_double(x) > 0  # a sketch of nulls alone has no quantile
            new |= {f"{x[4:]}_{name}": F.when(some, F.kll_sketch_get_quantile_double(x, F.lit(float(q)))) for name, q in (quantiles or {"median": 0.5}).items()}
    return sketches.withColumns(new).drop(*(x for x in sketches.columns if x.startswith(("hll_", "kll_"))))
