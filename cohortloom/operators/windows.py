"""Ordered and cumulative measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def occurrence(df: DataFrame, by: Sequence[str], value: str, order: Sequence[Column | str], k: int = 1, name: str = "flag") -> DataFrame:
    """Flags the k-th row with the same value in the order of its group."""
    w = Window.partitionBy(*by, value).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w) == k)


def first_qualifying(df: DataFrame, by: Sequence[str], value: str, order: Sequence[Column | str], qualifies: Column, name: str = "first_ok") -> DataFrame:
    """Flags the first row of each value that qualifies."""
    w = Window.partitionBy(*by, value).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_q", F.coalesce(qualifies, F.lit(False))).withColumn(name, F.col("_q") & (F.sum(F.col("_q").cast("int")).over(w) == 1)).drop("_q")


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], value: Column, name: str) -> DataFrame:
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def blocked_scan(df: DataFrame, by: Sequence[str], block: str, order: Sequence[Column | str], scans: dict[str, tuple[str, Column]], own: bool = True) -> DataFrame:
    """Running sums, maxima or last values (nulls skipped) in the order of (block, order) within a group, with or without the row's own value.

    scans: name to (sum, max or last; column). Each block is brought to one row first, and those rows are scanned; so no task
    holds a whole group. A sum over no rows is 0, the others are null.
    """
    ends = {"sum": F.sum, "max": F.max, "last": lambda v: F.last(v, ignorenulls=True)}
    values = df.withColumns({f"_v_{n}": v for n, (_, v) in scans.items()})
    before = Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*by, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    # the last value of a block is that of the greatest order
    place = F.struct(*order)
    in_block = {"sum": F.sum, "max": F.max, "last": lambda v: F.max_by(v, F.when(v.isNotNull(), place))}
    totals = values.groupBy(*by, block).agg(*(in_block[k](F.col(f"_v_{n}")).alias(f"_t_{n}") for n, (k, _) in scans.items()))
    bases = totals.select(*by, block, *(ends[k](F.col(f"_t_{n}")).over(before).alias(f"_b_{n}") for n, (k, _) in scans.items()))

    def joined(kind: str, base: Column, here: Column) -> Column:
        if kind == "sum":
            return F.coalesce(base, F.lit(0)) + F.coalesce(here, F.lit(0))
        return F.greatest(base, here) if kind == "max" else F.coalesce(here, base)

    # both sides are shuffled by block for the window anyway; the planner's estimate for exploded rows may be far too low to broadcast by
    out = values.join(bases.hint("shuffle_hash"), [*by, block]).withColumns({n: joined(k, F.col(f"_b_{n}"), ends[k](F.col(f"_v_{n}")).over(inside)) for n, (k, _) in scans.items()})
    return out.drop(*(f"_{k}_{n}" for k in "vb" for n in scans))


def blocked_sums(df: DataFrame, by: Sequence[str], block: str, order: Sequence[Column | str], sums: dict[str, Column]) -> DataFrame:
    """Running sums in the order of (block, order) within a group; see blocked_scan."""
    return blocked_scan(df, by, block, order, {n: ("sum", v) for n, v in sums.items()})


def days_since_first(df: DataFrame, subject: str, day: str, name: str = "day") -> DataFrame:
    return df.withColumn(name, F.datediff(F.col(day), F.min(day).over(Window.partitionBy(subject))).cast("long"))


def gaps(df: DataFrame, subject: str, day: str) -> DataFrame:
    """Median and number of the gaps in days between a subject's successive days."""
    days = df.select(subject, day).distinct()
    lagged = days.withColumn("gap", F.datediff(day, F.lag(day).over(Window.partitionBy(subject).orderBy(day))).cast("long"))
    return lagged.groupBy(subject).agg(F.median("gap").alias("median_gap"), F.count("gap").alias("n_gaps"))


def thinned(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], step: int) -> DataFrame:
    """Every step-th row from the first (for curves)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).where(F.col("_rn") % step == 0).drop("_rn")
