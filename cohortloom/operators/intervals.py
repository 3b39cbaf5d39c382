"""Interval unions and alignment summaries, as windows or scans over blocks, without loops over rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pick, windows


def islands(df: DataFrame, axis: Sequence[str], start: str = "start", stop: str = "stop") -> DataFrame:
    """Union of closed integer intervals on each axis; those that touch (gap of at most 1) are one."""
    order = Window.partitionBy(*axis).orderBy(start, stop)
    before = F.max(stop).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.coalesce((F.col(start) > before + 1).cast("int"), F.lit(1)))
    numbered = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*axis, "_island").agg(F.min(start).alias(start), F.max(stop).alias(stop)).drop("_island")


def measured(df: DataFrame, axis: Sequence[str], start: str = "start", stop: str = "stop") -> DataFrame:
    """Adds _add, the positions that an interval covers and none before it on its axis does, and _new, 1 if it touches none before it."""
    before = F.max(stop).over(Window.partitionBy(*axis).orderBy(start, stop).rowsBetween(Window.unboundedPreceding, -1))
    return marked(df.withColumn("_before", before), start, stop).drop("_before")


def marked(df: DataFrame, start: str, stop: str) -> DataFrame:
    """Adds _add and _new, given _before, the greatest stop before an interval in the order of its axis."""
    add = F.greatest(F.lit(0), F.col(stop) - F.greatest(F.col(start) - 1, F.coalesce("_before", F.col(start) - 1)))
    return df.withColumns({"_add": add, "_new": F.coalesce((F.col(start) > F.col("_before") + 1).cast("int"), F.lit(1))})


#: Positions of a bin of starts, and lines of a block of a file, where an axis or a file is dealt over tasks.
BIN, LINES = 1 << 16, 1 << 16


def covered(df: DataFrame, axis: Sequence[str], start: str = "start", stop: str = "stop", bins: bool = False) -> DataFrame:
    """Covered positions and islands of each axis.

    One window an axis, or, with bins, a scan over bins of starts, for axes with any number of intervals.
    """
    rows = binned(df, axis, start, stop) if bins else measured(df, axis, start, stop)
    return rows.groupBy(*axis).agg(F.sum("_add").alias("covered"), F.sum("_new").alias("islands"))


def binned(df: DataFrame, axis: Sequence[str], start: str, stop: str) -> DataFrame:
    """measured for the longest interval of each start (the others cover nothing more), by a scan over bins of starts."""
    ends = df.groupBy(*axis, start).agg(F.max(stop).alias(stop)).withColumns({"_bin": F.floor(F.col(start) / BIN), "_axis": F.struct(F.lit(0), *axis)})
    return marked(windows.blocked_scan(ends, ["_axis"], "_bin", [start], {"_before": ("max", F.col(stop))}, own=False), start, stop).drop("_axis", "_bin")


def in_runs(rows: DataFrame, by: Sequence[str], line: str) -> DataFrame:
    """rows with block, the number of their run of adjacent lines with one query and target, from 1, and _prior, the sum of _use of the run's earlier lines.

    One order of a group's lines, or, without groups, of each block of lines; what a run has before its block comes from one row a block.
    """
    parts = list(by) or ["_lines"]
    rows = rows if by else rows.withColumn("_lines", F.floor(F.col(line) / LINES))
    whole, pair = Window.partitionBy(*parts).orderBy(line), F.struct("qname", "tname")
    before = F.coalesce(F.sum("_use").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"_new": 1 - F.lag(pair).over(whole).eqNullSafe(pair).cast("int"), "_upto": before})
    upto = whole.rowsBetween(Window.unboundedPreceding, 0)
    # sums so far never fall, so the greatest at a run's start is that of the last run
    rows = rows.withColumns({"block": F.sum("_new").over(upto), "_prior": F.col("_upto") - F.max(F.when(F.col("_new") == 1, F.col("_upto"))).over(upto)}).drop("_new", "_upto")
    if by:
        return rows
    ends = rows.groupBy("_lines").agg(F.min_by(pair, line).alias("_first"), F.max_by(pair, line).alias("_last"), F.max("block").alias("_runs"), F.max_by(F.col("_prior") + F.col("_use"), line).alias("_tail"))
    w = Window.partitionBy("_all").orderBy("_lines")
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    goes_on = F.lag("_last").over(w).eqNullSafe(F.col("_first"))
    ends = ends.withColumn("_all", F.lit(0)).withColumns({"_on": goes_on.cast("int"), "_add": F.when(goes_on, F.lag("_tail").over(w)).otherwise(0), "_start": (~goes_on | (F.lag("_runs").over(w) > 1)).cast("int")})
    ends = ends.withColumns({"_base": F.sum("_runs").over(sofar) - F.col("_runs") - F.sum("_on").over(sofar), "_stretch": F.sum("_start").over(sofar)})
    carried = F.sum("_add").over(Window.partitionBy("_all", "_stretch").orderBy("_lines").rowsBetween(Window.unboundedPreceding, 0))
    out = rows.join(ends.select("_lines", "_base", carried.alias("_carried")).hint("shuffle_hash"), "_lines")
    return out.withColumns({"_prior": F.col("_prior") + F.when(F.col("block") == 1, F.col("_carried")).otherwise(0), "block": F.col("_base") + F.col("block")}).drop("_lines", "_base", "_carried")


def alignment_summary(rows: DataFrame, line: str = "line", max_evalue: float = 1e-3, min_length: int = 0, overrun: float = 1.10, groups: Sequence[str] = ()) -> DataFrame:
    """One row for each run of adjacent lines with the same query and target.

    Columns in: (groups), line, qname, tname, pid, len, qstart, qend, tstart, tend, evalue, qlen, tlen; starts do not
    exceed ends. Lines count if their query span is min_length or more and the e-value at most max_evalue. In
    file order, lines are kept until the spans so far reach the query's length or the next one would bring
    them to overrun times it. Out: num_alns; pid, the length-weighted mean identity; qcov and tcov, merged
    coverage in per cent (2 digits). A run with no kept line gives no row. groups: the file, or whatever else bounds the
    runs and fits a task; without it all lines are one file, numbered by line, of which blocks of lines are scanned.
    """
    by = list(groups)
    span = F.col("qend") - F.col("qstart") + 1
    usable = F.coalesce((span >= min_length) & (F.col("evalue") <= max_evalue), F.lit(False))
    lines_of_runs = in_runs(rows.withColumn("_use", F.when(usable, span).otherwise(0)), by, line).where(usable)
    key = [*by, "block"]
    # spans only add up, so every line after one that stops its run stops it as well
    stops = (F.col("_prior") >= F.col("qlen")) | (F.col("_prior") + F.col("_use") >= overrun * F.col("qlen"))
    kept = lines_of_runs.where(~stops)
    side = lambda name, start, stop: F.struct(F.lit(name).alias("side"), start.alias("start"), stop.alias("stop"))
    sides = F.array(side("q", F.col("qstart"), F.col("qend")), side("t", F.least("tstart", "tend"), F.greatest("tstart", "tend")))
    long = kept.select(*key, "qname", "tname", "pid", "len", "qlen", "tlen", F.inline(sides))
    query = F.col("side") == "q"
    lines = [
        F.count_if(query).alias("num_alns"), F.round(F.try_divide(F.sum(F.when(query, F.col("pid") * F.col("len"))), F.sum(F.when(query, F.col("len")))), 2).alias("pid"), F.first("qlen").alias("qlen"), F.first("tlen").alias("tlen"),
    ]
    cover = [F.sum(F.when(query, F.col("_add"))).alias("_q"), F.sum(F.when(~query, F.col("_add"))).alias("_t")]
    # a run keeps no more lines than its query has positions; both sides' intervals by the same windows, where the runs are
    out = measured(long, [*key, "side"]).groupBy(*key, "qname", "tname").agg(*lines, *cover)
    pct = lambda n, m: F.round(100.0 * F.col(n) / F.col(m), 2)
    return out.select(*by, "block", "qname", "tname", "num_alns", "pid", pct("_q", "qlen").alias("qcov"), pct("_t", "tlen").alias("tcov"))


def reciprocal_best(edges: DataFrame, by: Sequence[str], a: str, b: str, forward: str, backward: str) -> DataFrame:
    """Pairs that are each other's best: a's best b by forward, b's best a by backward; ties by name."""
    one = pick.numbered(edges, [*by, a], [F.desc(forward), F.asc(b)], "_f")
    both = pick.numbered(one, [*by, b], [F.desc(backward), F.asc(a)], "_b")
    return both.where("_f = 1 AND _b = 1").drop("_f", "_b")


def orient_edges(edges: DataFrame, left_ids: DataFrame, left_key: str, score: str) -> DataFrame:
    """Bipartite edges with the left entity first: reversed ones are turned and their coverages swapped; one row a pair, the best score."""
    ids = left_ids.select(F.col(left_key).alias("_id")).distinct()
    ahead = edges.join(ids, edges["query"] == F.col("_id"), "left_semi").select("query", "reference", score, "qcov", "rcov")
    back = edges.join(ids, edges["reference"] == F.col("_id"), "left_semi").select(F.col("reference").alias("query"), F.col("query").alias("reference"), score, F.col("rcov").alias("qcov"), F.col("qcov").alias("rcov"))
    return pick.best_per_key(ahead.unionByName(back), ["query", "reference"], [F.desc(score), F.desc("qcov"), F.desc("rcov")])


def prune_edges(edges: DataFrame, parents: DataFrame, entity: str, parent: str, score: str, least: float) -> DataFrame:
    """Edges inside one parent cluster with a score of least or more; for one level of a hierarchy."""
    p = parents.select(F.col(entity).alias("_e"), F.col(parent).alias("_p"))
    q = edges.join(p, edges["query"] == F.col("_e")).withColumnRenamed("_p", "_pq").drop("_e")
    return q.join(p, F.col("reference") == F.col("_e")).where((F.col("_pq") == F.col("_p")) & (F.col(score) >= least)).drop("_e", "_p", "_pq")
