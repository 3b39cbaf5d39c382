"""Accumulation curves and cutoff sweeps."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions import expr as X
from cohortloom.functions.store import kept

from . import shape
from .windows import blocked_sums


#: Leading digits of a hash that deal an order over blocks: 4096 of them.
BLOCK_DIGITS = 3


def hash_order(df: DataFrame, key: str, reps: int, by: Sequence[str] = (), seed: int = 1) -> DataFrame:
    """reps copies of df, each in an order of its own (rep, pos from 1, block); the order is a hash of key and replicate, so it is repeatable."""
    copies = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("_h", X.hashed(key, "rep", seed=seed))
    blocked = copies.withColumn("block", F.substring("_h", 1, BLOCK_DIGITS))
    return blocked_sums(blocked, [*by, "rep"], "block", ["_h", key], {"pos": F.lit(1)}).drop("_h")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """Exactly n rows, by hash order."""
    return df.orderBy(X.hashed(key, seed=seed), key).limit(n)


#: Rows up to which a table is sent to all tasks.
SENT = 1 << 17
#: Positions of a stretch of a curve that one task writes.
STRETCH = 1 << 12
#: Steps of the search among a block's marks: there may be 2 ** SEARCH of them.
SEARCH = 20


def beside(df: DataFrame, other: DataFrame, on: Sequence[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    """df joined to a kept table: sent to all tasks if it is small by count (rows, if known), else by a shuffle, whatever the planner estimates."""
    return df.join(F.broadcast(other) if (other.count() if rows is None else rows) <= SENT else other.hint("merge"), list(on), how)


def passed(marks: str, at: Column) -> Column:
    """How many of the sorted marks are at or before a place, by halving; 0 without marks."""
    strides = F.array(*(F.lit(1 << i) for i in reversed(range(SEARCH))))
    found = F.aggregate(strides, F.lit(0), lambda n, stride: F.when(n + stride > F.size(marks), n).when(F.get(F.col(marks), n + stride - 1) <= at, n + stride).otherwise(n))
    return F.when(F.col(marks).isNull(), F.lit(0)).otherwise(found)


def hashed_copies(rows: DataFrame, reps: int, seed: int) -> DataFrame:
    """reps copies of rows with rep, _h (the hash of _key and rep, which orders them), its block and its first 60 bits as a number."""
    dealt = rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "_key")  # each row is work for all replicates
    hashed = dealt.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("_h", X.hashed("_key", "rep", seed=seed))
    return hashed.withColumns({"block": F.substring("_h", 1, BLOCK_DIGITS), "_short": F.conv(F.substring("_h", 1, 15), 16, 10).cast("long")})


def first_places(copies: DataFrame) -> DataFrame:
    """_g, rep and pos of each label's first row in the order of hash, key and label.

    One aggregate gives each label's least short hash, a mark. Rows past the last mark of their group and replicate are dropped where
    they are read, the others are counted by the marks that they pass; only rows at a mark are kept apart, to be put in order.
    """
    order = ["_g", "rep", "block"]
    # the block is that of the least hash, as it leads it
    marks = kept(copies.groupBy("_g", "rep", "_l").agg(F.min("_short").alias("_mark")))
    last = kept(marks.groupBy("_g", "rep").agg(F.max("_mark").alias("_last")))
    block = F.lower(F.lpad(F.hex(F.shiftright("_mark", 60 - 4 * BLOCK_DIGITS)), BLOCK_DIGITS, "0"))
    lists = kept(marks.groupBy("_g", "rep", block.alias("block")).agg(F.array_sort(F.collect_set("_mark")).alias("_marks")))
    # a bare comparison would have the planner test _short for null before the join, and hash each row twice
    near = beside(copies, last, ["_g", "rep"]).where(F.coalesce(F.col("_short") <= F.col("_last"), F.lit(False)))
    past = beside(near, lists, order, "left").withColumn("_passed", passed("_marks", F.col("_short")))
    at_mark = F.get("_marks", F.col("_passed") - 1) == F.col("_short")
    counts = past.withColumn("_at", F.when(at_mark, F.struct("_h", "_key", "_l"))).groupBy(*order, "_passed", "_at").agg(F.count(F.lit(1)).alias("_n"))
    upto = blocked_sums(counts, ["_g", "rep"], "block", ["_passed", F.asc_nulls_last("_at")], {"_upto": F.col("_n")}).where("_at IS NOT NULL")
    return upto.groupBy("_g", "rep", F.col("_at._l").alias("_l")).agg(F.min(F.col("_upto") - F.col("_n") + 1).alias("pos")).select("_g", "rep", "pos")


def early_places(copies: DataFrame) -> DataFrame:
    """_g, rep, block, _at and _ord (the place in the order), t, s, f: where a label comes first, second and first with the flag.

    One aggregate bounds each label's second hash: the larger of its least hashes among rows of either parity. Only rows up to it are sorted.
    """
    label, short = ["_g", "rep", "_l"], F.col("_short")
    half = lambda i: F.min(F.when(short.bitwiseAND(F.lit(1)) == i, short))
    second = F.when(half(0).isNotNull() & half(1).isNotNull(), F.greatest(half(0), half(1))).otherwise(F.lit((1 << 63) - 1))
    bounds = kept(copies.groupBy(*label).agg(second.alias("_second"), F.min(F.when(F.col("_f"), short)).alias("_first_f")))
    near = beside(copies, bounds, label).where((short <= F.col("_second")) | (F.col("_f") & (short <= F.col("_first_f"))))
    ties = Window.partitionBy("_g", "rep", "_at").orderBy("_l", F.desc("_f"))
    placed = near.select("_g", "rep", "block", "_l", "_f", F.struct("_h", "_key").alias("_at")).withColumn("_ord", F.row_number().over(ties))
    w = Window.partitionBy(*label).orderBy("_at", "_ord")
    n, flags = F.row_number().over(w), F.sum(F.col("_f").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = placed.select("_g", "rep", "block", "_at", "_ord", (n == 1).cast("int").alias("t"), (n == 2).cast("int").alias("s"), (F.col("_f") & (flags == 1)).cast("int").alias("f"))
    return kept(marked.where("t + s + f > 0"))


def accumulation_curve(df: DataFrame, key: str, label: str, flag: Column, reps: int, by: Sequence[str] = (), seed: int = 1) -> DataFrame:
    """For each position: mean over replicates of the labels seen so far, those seen twice, and those seen with the flag; least and most seen.

    Only the places where a label comes first, second and first with the flag count. Rows of all replicates are counted where they
    are read, by block of the order and the marks that they pass, which gives the marks' positions; no whole order is sent or sorted.
    All replicates see the labels in some order, so least labels at a position are those k whose k-th first place is reached in
    every replicate, and most those reached in any. The curve steps at marks alone.
    """
    # a struct is never null, so groups and labels that are null meet in joins, too
    rows = df.select(F.struct(F.lit(0).alias("_0"), *by).alias("_g"), F.col(key).alias("_key"), F.struct(F.lit(0), F.col(label)).alias("_l"), F.coalesce(flag, F.lit(False)).alias("_f"))
    copies = hashed_copies(rows, reps, seed)
    marks = early_places(copies)
    order = ["_g", "rep", "block"]
    lists = kept(marks.groupBy(*order).agg(F.array_sort(F.collect_set("_at")).alias("_marks")))
    counts = beside(copies, lists, order, "left").groupBy(*order, passed("_marks", F.struct("_h", "_key")).alias("_passed")).agg(F.count(F.lit(1)).alias("_n"))
    upto = blocked_sums(counts, ["_g", "rep"], "block", ["_passed"], {"_upto": F.col("_n")})
    numbered = marks.withColumn("_passed", F.dense_rank().over(Window.partitionBy(*order).orderBy("_at")))
    # rows before a mark, then its place among rows of its hash and key
    at = kept(numbered.join(upto.hint("merge"), [*order, "_passed"]).select(*order, (F.col("_upto") - F.col("_n") + F.col("_ord")).alias("pos"), "t", "s", "f"))

    kth = blocked_sums(at.where("t = 1"), ["_g", "rep"], "block", ["pos"], {"_k": F.lit(1)}).groupBy("_g", "_k").agg(F.max("pos").alias("_all"), F.min("pos").alias("_any"))
    sizes = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_size"))
    firsts = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_size") - 1) / STRETCH)), lambda i: i * STRETCH + 1)
    stretches = sizes.select("_g", F.explode(firsts).alias("pos"))
    names = ["t", "s", "f", "_least", "_most"]
    step = lambda rows, pos, **some: rows.select("_g", F.col(pos).alias("pos"), *(some.get(n, F.lit(0)).cast("long").alias(n) for n in names))
    steps = step(at, "pos", t=F.col("t"), s=F.col("s"), f=F.col("f")).unionByName(step(kth, "_all", _least=F.lit(1))).unionByName(step(kth, "_any", _most=F.lit(1))).unionByName(step(stretches, "pos"))
    steps = steps.groupBy("_g", "pos").agg(*(F.sum(n).alias(n) for n in names)).withColumn("_stretch", F.floor((F.col("pos") - 1) / STRETCH))
    curves = blocked_sums(steps, ["_g"], "_stretch", ["pos"], {f"_n{n}": F.col(n) for n in names}).join(sizes.hint("merge"), "_g")
    following = F.lead("pos").over(Window.partitionBy("_g", "_stretch").orderBy("pos"))
    last = F.coalesce(following - 1, F.least((F.col("_stretch") + 1) * STRETCH, "_size"))
    mean = lambda n: F.col(f"_n{n}") / reps
    out = curves.select("*", last.alias("_last")).withColumn("pos", F.explode(F.sequence("pos", "_last")))
    return out.select(*(F.col("_g").getField(b).alias(b) for b in by), "pos", mean("t").alias("total"), mean("s").alias("non_singleton"), mean("f").alias("flagged"), F.col("_n_least").alias("least"), F.col("_n_most").alias("most"))


#: Rows of a label up to which its chance to be missed is a product over them.
PRODUCT_ROWS = 64


def log_factorial(x: Column) -> Column:
    """ln x! of a whole number: from a table of the first ones, then by Stirling's series."""
    known = F.array(*(F.lit(math.lgamma(i + 1)) for i in range(8)))
    far = F.greatest(x, F.lit(8)).cast("double")
    series = (far + 0.5) * F.log(far) - far + 0.5 * math.log(2 * math.pi) + stirling(far)
    return F.when(x < 8, F.get(known, F.greatest(x, F.lit(0)).cast("int"))).otherwise(series)


def stirling(x: Column) -> Column:
    return 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)


def log_missed(m: Column, n: Column, every: Column) -> Column:
    """ln of the chance that a random subset of n of `every` rows has none of m: ln C(every - m, n) - ln C(every, n). The work doesn't grow with m."""
    rest = every - n
    few = F.aggregate(F.sequence(F.lit(0).cast("long"), F.least(m, F.lit(PRODUCT_ROWS)) - 1), F.lit(0.0), lambda a, i: a + F.when(rest - i > 0, F.log(F.greatest(rest - i, F.lit(1)) / (every - i))).otherwise(F.lit(-1e9)))
    a, N = F.greatest(rest, m + 8).cast("double"), every.cast("double")
    # the factorials' difference in terms no larger than m
    many = m * F.log(a / N) - (a - m + 0.5) * F.log1p(-m / a) + (N - m + 0.5) * F.log1p(-m / N) + stirling(a) - stirling(a - m) - stirling(N) + stirling(N - m)
    near = log_factorial(rest) - log_factorial(rest - m) - log_factorial(every) + log_factorial(every - m)
    return F.when(m <= PRODUCT_ROWS, few).when(rest < m, F.lit(-1e9)).when(rest - m < 8, near).otherwise(many)


def expected_curve(df: DataFrame, label: str, points: int, by: Sequence[str] = ()) -> DataFrame:
    """The exact mean of labels seen in a random subset of size n, at about `points` sizes: sum over labels of 1 - C(N - N_i, n) / C(N, n).

    Labels of one size are counted together, so the work is (distinct sizes) x (points) and no order is needed.
    """
    sizes = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("m")).groupBy(*by, "m").agg(F.count(F.lit(1)).alias("labels"))
    totals = sizes.groupBy(*by).agg(F.sum(F.col("m") * F.col("labels")).alias("_all"))
    grid = totals.withColumn("n", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(points)), lambda i: F.greatest(F.lit(1).cast("long"), F.floor(i * F.col("_all") / points))))))
    pairs = grid.join(sizes, list(by)) if by else grid.crossJoin(sizes)
    seen = F.sum(F.col("labels") * (1 - F.exp(log_missed(F.col("m"), F.col("n"), F.col("_all")))))
    return pairs.groupBy(*by, "n").agg(seen.alias("expected"))


def subset_richness(df: DataFrame, key: str, label: str, site: str, points: int, reps: int, least: int = 1, seed: int = 1) -> DataFrame:
    """Per site with least rows or more: mean, least and most distinct labels at about `points` linear subset sizes over reps orders.

    A label counts from its first place on, so the first places are counted by the next subset size, and those sums run over the sizes alone.
    """
    sizes = kept(df.groupBy(site).agg(F.count(F.lit(1)).alias("_size")).where((F.col("_size") >= least) & F.col(site).isNotNull()))
    group = F.struct(F.lit(0).alias("_0"), site).alias("_g")
    rows = beside(df, sizes.select(site), [site]).select(group, F.col(key).alias("_key"), F.struct(F.lit(0), F.col(label)).alias("_l"))
    at = first_places(hashed_copies(rows, reps, seed)).join(sizes.select(group, "_size").hint("merge"), "_g")
    # the first of the sizes i * _size / points that is not below the place
    following = F.expr(f"((pos * {points} + _size - 1) div _size) * _size div {points}")
    found = at.select("_g", "rep", following.alias("n"), F.lit(1).alias("_t"))
    grid = sizes.withColumn("n", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(points)), lambda i: F.greatest(F.lit(1).cast("long"), F.floor(i * F.col("_size") / points))))))
    empty = grid.select(group, F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"), "n", F.lit(0).alias("_t"))
    upto = Window.partitionBy("_g", "rep").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    seen = found.unionByName(empty).groupBy("_g", "rep", "n").agg(F.sum("_t").alias("_t")).withColumn("_seen", F.sum("_t").over(upto))
    out = seen.groupBy("_g", "n").agg((F.sum("_seen") / reps).alias("mean"), F.min("_seen").alias("least"), F.max("_seen").alias("most"))
    return out.select(F.col("_g").getField(site).alias(site), "n", "mean", "least", "most")


def sweep(df: DataFrame, score: str, truth: Column, cutoffs: Sequence[float], by: Sequence[str] = (), at_least: bool = True, min_tp: int = 3) -> DataFrame:
    """tp, fp, fn, precision and recall at each cutoff (score >= t, or <= t); both null under min_tp true positives. One pass."""
    grid = shape.literals(df.sparkSession, "cutoff", cutoffs)
    rows = df.select(*by, score, F.coalesce(truth, F.lit(False)).alias("_t")).crossJoin(F.broadcast(grid))  # a literal list
    called = F.coalesce(F.col(score) >= F.col("cutoff") if at_least else F.col(score) <= F.col("cutoff"), F.lit(False))
    out = rows.groupBy(*by, "cutoff").agg(F.count_if(called & F.col("_t")).alias("tp"), F.count_if(called & ~F.col("_t")).alias("fp"), F.count_if(~called & F.col("_t")).alias("fn"))
    enough = F.col("tp") >= min_tp
    return out.withColumns({"precision": F.when(enough, X.ratio("tp", F.col("tp") + F.col("fp"))), "recall": F.when(enough, X.ratio("tp", F.col("tp") + F.col("fn")))})


def sweep_quartiles(df: DataFrame, score: str, truth: Column, cutoffs: Sequence[float], group: str, min_tp: int = 1) -> DataFrame:
    """The sweep in each group, then median and quartiles over groups."""
    each = sweep(df, score, truth, cutoffs, [group], min_tp=min_tp)
    q = [F.percentile(m, p).alias(f"{m}_{n}") for m in ("precision", "recall") for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    return each.groupBy("cutoff").agg(F.count("precision").alias("groups"), *q)


def two_phase_sweep(df: DataFrame, ratio: str, truth: Column, predicted: Column, cutoffs: Sequence[float]) -> DataFrame:
    """The sweep over a ratio (cutoff 0: no filter) before and after predicted negatives go."""
    filled = df.withColumn("_r", F.coalesce(F.col(ratio), F.lit(0.0)))
    before = sweep(filled, "_r", truth, cutoffs, min_tp=0).withColumn("phase", F.lit("before"))
    after = sweep(filled.where(F.coalesce(predicted, F.lit(False))), "_r", truth, cutoffs, min_tp=0).withColumn("phase", F.lit("after"))
    return before.unionByName(after)
