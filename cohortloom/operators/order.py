"""Ranks and quantiles of groups of any size.

Both are running counts over a group's distinct values, in their order. Values are counted first, so ties cost nothing. The
counts of a group are then dealt over ranges of values (blocks), whose bounds come from a quantile sketch of all counts: block
totals are summed first, so no task, window or map holds a whole group. Equal values are always in one block. Groups of
few counts each need no blocks, however many they are; both ways give the same rows.

Values are numbers or dates. Nulls have no rank and do not count.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.store import kept

from .windows import blocked_sums

#: Counts of a group up to which a window over it is one task's work.
ONE_TASK = 1 << 20
#: Steps of the search for a value's block: there are 2 ** STEPS of them.
STEPS = 12


def count_values(df: DataFrame, by: Sequence[str], *values: str) -> DataFrame:
    """by, values and _n of each distinct combination, nulls included."""
    return df.groupBy(*by, *values).agg(F.count(F.lit(1)).alias("_n"))


def block_of(value: str, splits: str) -> Column:
    """How many of the sorted splits are at or below the value, by halving."""
    strides = F.array(*(F.lit(1 << i) for i in reversed(range(STEPS))))
    return F.aggregate(strides, F.lit(0), lambda at, stride: F.when(F.get(F.col(splits), at + stride - 1) <= F.col(value), at + stride).otherwise(at))


def extent(df: DataFrame, by: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest group, and of all."""
    found = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).agg(F.max("_rows"), F.sum("_rows")).first()
    return found[0] or 0, found[1] or 0


def over_tasks(df: DataFrame, by: Sequence[str], rows: int) -> DataFrame:
    """df with whole groups over as many tasks as keep the rows of each about ONE_TASK or less, however many there are."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ONE_TASK)), *by) if rows > ONE_TASK else df


def running_counts(counts: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """counts (by, value, _n and more; one row a value) with _before, how many of the group have a smaller value, and _total, how many have one."""
    counts = kept(counts)
    there = F.when(F.col(value).isNotNull(), F.col("_n")).otherwise(0)
    most, rows = extent(counts, by)
    if most <= ONE_TASK:
        counts = over_tasks(counts, by, rows)
        order = Window.partitionBy(*by).orderBy(F.asc_nulls_last(value))
        before = F.coalesce(F.sum(there).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return counts.withColumns({"_before": before, "_total": F.sum(there).over(Window.partitionBy(*by))})
    # one row of numbers, read here so that block totals and the rows that they are for agree on it
    shares = [(i + 1) / (1 << STEPS) for i in range((1 << STEPS) - 1)]
    splits = counts.agg(F.percentile_approx(value, shares, 1 << (STEPS + 2)).alias("_splits"))
    splits = counts.sparkSession.createDataFrame(splits.collect(), splits.schema)
    # a struct is never null, so groups whose key is null meet in joins, too
    group = F.struct(F.lit(0), *by).alias("_group")
    dealt = counts.crossJoin(F.broadcast(splits)).select(*counts.columns, group, block_of(value, "_splits").alias("_block"))
    out = blocked_sums(dealt, ["_group"], "_block", [F.asc_nulls_last(value)], {"_upto": there}).withColumn("_before", F.col("_upto") - there)
    totals = counts.groupBy(group).agg(F.sum(there).alias("_total"))
    return out.join(totals, "_group").drop("_group", "_upto", "_block")


def same(pairs: Sequence[tuple[str, str]]) -> Column:
    """All pairs of columns are equal, null to null."""
    return reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(y)) for x, y in pairs), F.lit(True))


def mean_rank() -> Column:
    """Average rank, from 1, of a value of running_counts."""
    return F.col("_before") + (F.col("_n") + 1) / 2


def quantile_of(value: str, share: float) -> Column:
    """Linear quantile, as an aggregate over running_counts."""
    v, place = F.col(value).cast("double"), (F.col("_total") - 1) * F.lit(float(share))
    at = lambda k: F.max(F.when((F.col("_before") <= k) & (k < F.col("_before") + F.col("_n")) & v.isNotNull(), v))
    low, high, spot = at(F.floor(place)), at(F.ceil(place)), F.max(place)
    return F.when(low == high, low).otherwise((F.ceil(spot) - spot) * low + (spot - F.floor(spot)) * high)


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by, n (values that are not null) and an exact linear quantile for each name; as percentile(), for groups of any size."""
    counts = running_counts(count_values(df, by, value), by, value)
    return counts.groupBy(*by).agg(F.max("_total").alias("n"), *(quantile_of(value, q).alias(name) for name, q in shares.items()))


def with_average_rank(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """df with its average rank in the group (null where value is null) and _total, how many of the group have a value."""
    ranks = running_counts(count_values(df, by, value), by, value)
    right = ranks.select(*(F.col(c).alias(f"_of_{c}") for c in (*by, value)), mean_rank().alias(name), "_total")
    out = df.join(right, same([(c, f"_of_{c}") for c in (*by, value)]), "left").drop(*(f"_of_{c}" for c in (*by, value)))
    return out.withColumn(name, F.when(F.col(value).isNotNull(), F.col(name)))
