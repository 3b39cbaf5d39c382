"""Partner ratios and association scans between entities that occur in the same samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions import expr as X
from cohortloom.functions.store import kept

from . import order, pick, shape, stats
from .curves import beside
from .windows import blocked_sums


def ratio_cascade(entities: DataFrame, partners: DataFrame, sample: str, entity: str, value: str, partner_value: str, ranks: Sequence[str], source: DataFrame | None = None) -> DataFrame:
    """Ratio of an entity to its partner in the same sample by the first rank that decides.

    entities: sample, entity (one row each), value and the partner's name at each rank; partners: sample, partner_value and
    their own names at each rank, the first rank being the partner itself. At the first rank the partner is
    present; at later ones exactly one partner of that name is in the sample. Out: rule (the rank) and ratio;
    rows without a rule are left out. A row is sent once, by its sample, and meets the names of all ranks there. source: a table with
    the sample column of which entities and partners were made (else they are counted); samples that have over ONE_TASK of its rows are
    sent by rank and name.
    """
    names = [f"_n{i}" for i in range(len(ranks))]
    own = [F.col(r).cast("string").alias(n) for r, n in zip(ranks, names, strict=True)]
    a = entities.select(sample, entity, F.col(value).alias("_v"), F.lit(False).alias("_p"), *own)
    b = partners.select(sample, F.col(partner_value).alias("_pv"), F.lit(True).alias("_p"), *own)
    rows = a.unionByName(b, allowMissingColumns=True).where(F.col(sample).isNotNull())
    sizes = (rows if source is None else source).groupBy(sample).agg(F.count(F.lit(1)).alias("_rows"))
    large = kept(sizes.where((F.col("_rows") > order.ONE_TASK) & F.col(sample).isNotNull()).select(sample, F.lit(True).alias("_large")))
    by = [sample]
    if not large.isEmpty():
        # at most one in ONE_TASK of the rows
        marked = rows.join(F.broadcast(large), sample, "left")
        one = F.explode(F.when(F.col("_large"), F.sequence(F.lit(0), F.lit(len(ranks) - 1))).otherwise(F.array(F.lit(-1)))).alias("_only")
        rows = marked.select(*rows.columns, one).withColumns({n: F.when(F.col("_only").isin(i, -1), F.col(n)) for i, n in enumerate(names)})
        rows = rows.withColumn("_part", F.when(F.col("_only") >= 0, F.struct("_only", F.coalesce(*names).alias("name")))).drop("_only")
        by = [sample, "_part"]
    met = Window.partitionBy(*by, "_i", "_name")
    flat = rows.repartition(*by).select(*by, entity, "_v", "_p", "_pv", F.posexplode(F.array(*names)).alias("_i", "_name")).where("_name IS NOT NULL")
    flat = flat.select(sample, entity, "_v", "_p", "_i", F.count_if("_p").over(met).alias("_n"), F.max("_pv").over(met).alias("_pv")).where("NOT _p AND (_n = 1 OR _i = 0 AND _n > 1)")
    found = flat.groupBy(sample, entity).agg(F.min(F.struct("_i", "_v", "_pv")).alias("_f"))
    return found.select(sample, entity, F.get(F.array(*map(F.lit, ranks)), F.col("_f._i")).alias("rule"), X.ratio("_f._v", "_f._pv").alias("ratio"))


def closest_ratio(pairs: DataFrame, key: Sequence[str], partner: str, ratio: str) -> DataFrame:
    """Of the candidate partners, the one whose ratio is nearest 1; ties by partner."""
    return pick.best_per_key(pairs.where(F.col(ratio).isNotNull()), list(key), [F.abs(F.col(ratio) - 1), partner])


def combine_ratios(a: DataFrame, b: DataFrame, key: Sequence[str], ratio: str = "ratio") -> DataFrame:
    """Least and greatest of two methods' ratios; one method alone counts for both."""
    both = a.select(*key, F.col(ratio).alias("_a")).join(b.select(*key, F.col(ratio).alias("_b")), list(key), "full")
    return both.select(*key, F.least("_a", "_b").alias("low"), F.greatest("_a", "_b").alias("high"))


def sample_bitmaps(rows: DataFrame, numbers: DataFrame, sample: str, who: str, value: str, side: str) -> DataFrame:
    """who, _chunk, _bits_side and _vals_side: for each 64 samples, which of them have who, as a bitmap, and their values in its order."""
    bit = F.col("_no").bitwiseAND(F.lit(63)).cast("int")
    at = rows.join(numbers, sample).select(who, F.shiftright("_no", 6).alias("_chunk"), bit.alias("_bit"), F.expr("shiftleft(1L, cast(_no & 63 as int))").alias("_one"), F.col(value).alias("v"))
    return at.groupBy(who, "_chunk").agg(F.bit_or("_one").alias(f"_bits_{side}"), F.array_sort(F.collect_list(F.struct("_bit", "v"))).alias(f"_vals_{side}"))


#: A scan compares all of a sample's entities and partners where one in so many of their pairs is a candidate.
DENSE = 16
#: Names of both sides together up to which a sample's sums are one row (a side's names are bits of a long).
COLUMNS = 60
#: Grouping ids of a pair's counts: by value_a, by value_b and by the step of their ratio.
_BY_A, _BY_B, _BY_STEP = 3, 5, 6
_STEPS, _FAR = 100, 1 << 20
#: Samples that a task goes through at once, and values of sides up to which their ranks are sent to all tasks (some 16 MB).
BLOCK = 1 << 16
RANKS = 1 << 19


def sums_in_columns(rows: DataFrame, sample: str, n_left: int, n_right: int) -> DataFrame:
    """A row a sample: _in_e and _in_p, bits of the _e and _p that it has, and _sums_e and _sums_p, its sums of _v by their numbers, from 0.

    Rows are summed before they are sent, so a sample may have any number of them.
    """
    sides = (("_e", n_left), ("_p", n_right))
    bits = [F.coalesce(F.bit_or(F.expr(f"shiftleft(1L, {who})")), F.lit(0)).alias(f"_in{who}") for who, _ in sides]
    sums = [F.array(*(F.sum(F.when(F.col(who) == i, F.col("_v"))) for i in range(n))).alias(f"_sums{who}") for who, n in sides]
    return rows.where("_e IS NOT NULL OR _p IS NOT NULL").groupBy(sample).agg(*bits, *sums)


def meet_in_rows(samples: DataFrame, pairs: DataFrame, n_pairs: int) -> DataFrame:
    """_pair, _a and _b of each row of sums_in_columns that has both of a pair's _e and _p; nothing is sent."""
    has = lambda who: F.getbit(f"_in{who}", F.col(who)) == 1
    left = samples.select("*", F.posexplode("_sums_e").alias("_e", "_a")).where(has("_e"))
    both = left.select("_e", "_a", "_in_p", F.posexplode("_sums_p").alias("_p", "_b")).where(has("_p"))
    return beside(both, pairs, ["_e", "_p"], rows=n_pairs).select("_pair", "_a", "_b")


def step_of(value: str) -> Column:
    """A number that never falls as the value grows: its sign and its logarithm in steps of a hundredth; NaN comes last."""
    v = F.col(value)
    place = lambda x: F.floor(F.least(F.ln(x), F.lit(1000.0)) * _STEPS) + _FAR
    return F.when(F.isnan(v), 2 * _FAR).when(v > 0, place(v)).when(v < 0, -place(-v)).when(v == 0, 0).cast("double")


def steps_of(r: np.ndarray) -> np.ndarray:
    """step_of for an array."""
    size = np.floor(np.minimum(np.log(np.abs(r)), 1000.0) * _STEPS) + _FAR
    return np.where(np.isnan(r), 2.0 * _FAR, np.where(r > 0, size, np.where(r < 0, -size, 0.0)))


def _met(batches: Iterator[pa.RecordBatch], pairs: Sequence[tuple[int, int, int]], sides: tuple[int, int]) -> Iterator[tuple]:
    """_pair, values of _a and _b where it has both, which of them are null, and the ratios that there are, for each pair of a block of samples."""

    def block(some: list[pa.RecordBatch]) -> Iterator[tuple]:
        t = pa.Table.from_batches(some)
        there, sums, nulls = [], [], []
        for who, n in zip(("_e", "_p"), sides, strict=True):
            flat = pa.concat_arrays([c.flatten() for c in t[f"_sums{who}"].chunks])
            bits = t[f"_in{who}"].to_numpy()
            there.append([(bits >> i & 1).astype(bool) for i in range(n)])
            sums.append(np.ascontiguousarray(flat.to_numpy(zero_copy_only=False).reshape(-1, n).T))
            nulls.append(np.ascontiguousarray(flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, n).T))
        for pair, e, p in pairs:
            at = np.flatnonzero(there[0][e] & there[1][p])
            if len(at):
                a, b, no_a, no_b = sums[0][e][at], sums[1][p][at], nulls[0][e][at], nulls[1][p][at]
                both = ~no_a & ~no_b & (b != 0)
                yield pair, a, b, no_a, no_b, a[both] / b[both]

    some, rows = [], 0
    with np.errstate(all="ignore"):
        for batch in batches:
            some.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK:
                yield from block(some)
                some, rows = [], 0
        if rows:
            yield from block(some)


def _counted(pairs: Sequence[tuple[int, int, int]], sides: tuple[int, int]) -> Callable:
    """Rows of sums_in_columns to counts of a pair's values: _pair, _by, _x (null last) and _n, by blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair, a, b, no_a, no_b, r in _met(batches, pairs, sides):
            for by, values, nulls in ((_BY_A, a[~no_a], no_a.sum()), (_BY_B, b[~no_b], no_b.sum()), (_BY_STEP, steps_of(r), len(a) - len(r))):
                x, n = np.unique(values, return_counts=True)
                x, n = np.append(x, 0.0), np.append(n, nulls)
                none = np.arange(len(x)) == len(x) - 1
                upto = len(x) if nulls else len(x) - 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(upto, pair, np.int64)), pa.array(np.full(upto, by, np.int32)), pa.array(x[:upto], mask=none[:upto]), pa.array(n[:upto].astype(np.int64))], ["_pair", "_by", "_x", "_n"])

    return run


def _summed(pairs: Sequence[tuple[int, int, int]], sides: tuple[int, int], info: dict, ranks: dict) -> Callable:
    """Rows of sums_in_columns to a pair's sums over a block, where _near is null, and to counts of its ratios in the steps of the median, _near.

    info: low and high end of those steps and the rank of null on both sides, by pair; ranks: sorted values and their ranks, by pair and side.
    """

    def rank(of: tuple[np.ndarray, np.ndarray], values: np.ndarray, nulls: np.ndarray, last: float) -> np.ndarray:
        return np.where(nulls, last, of[1][np.minimum(np.searchsorted(of[0], values), len(of[1]) - 1)]) if len(of[1]) else np.full(len(values), last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair, a, b, no_a, no_b, r in _met(batches, pairs, sides):
            low, high, last_a, last_b = info[pair]
            none = (np.empty(0), np.empty(0))
            ab = np.dot(rank(ranks.get((pair, _BY_A), none), a, no_a, last_a), rank(ranks.get((pair, _BY_B), none), b, no_b, last_b))
            near, n = np.empty(0), np.empty(0, np.int64)
            if len(r):
                step = steps_of(r)
                near, n = np.unique(r[(step >= low) & (step <= high)], return_counts=True)
            first, rest = [float(v) if len(r) else None for v in (r.sum(), np.dot(r, r), r.max() if len(r) else 0.0)], [None] * len(near)
            yield pa.RecordBatch.from_arrays(
                [pa.array([pair] * (len(near) + 1), pa.int64()), pa.array([None, *near], pa.float64()), pa.array([0, *n], pa.int64()), *(pa.array([v, *rest], pa.float64()) for v in (*first, float(ab)))],
                ["_pair", "_near", "_n", "_sum", "_squares", "_most", "_ab"],
            )

    return run


def association_scan(a: DataFrame, b: DataFrame, candidates: DataFrame, sample: str, entity: str, partner: str, samples: int, least: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """Co-occurrence of candidate pairs over samples; see scan_of_sums, which it hands the rows of both sides.

    a: sample, entity, value_a; b: sample, partner, value_b (one row each).
    """
    rows = a.select(sample, entity, F.col("value_a").alias("_value")).unionByName(b.select(sample, partner, F.col("value_b").alias("_value")), allowMissingColumns=True)
    return scan_of_sums(rows, candidates, sample, entity, partner, "_value", samples, least, keys)


def scan_of_sums(rows: DataFrame, candidates: DataFrame, sample: str, entity: str, partner: str, value: str, samples: int, least: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """Co-occurrence of candidate pairs over samples: the 2x2 table, per cent, ratio statistics, Spearman's rho.

    rows: sample, entity, partner, value; a row counts for its entity and for its partner, null being none, and their values
    (value_a, value_b) are sums by sample. candidates: entity, partner, and keys of which each value has a scan of its own.
    Names are numbered, and sums of both sides made and kept once. A pair meets once, whatever keys it has: where one in DENSE of the
    candidates' entities times partners is a candidate, entities and partners meet by sample, within a row a sample if they are few
    (COLUMNS); else by bitmaps (meet_by_bitmaps). Common samples that are not in one row are counted by (value_a, value_b). They are
    gone through twice: for counts of each side's values and of steps of the ratio, which give ranks and the steps that hold the
    median; then for the sums, and for the ratios in those steps alone. Values that are null rank last, together. A pair that
    never meets has n11 = 0. A candidate whose entity or partner is in no sample is left out.
    """
    pair = [entity, partner]
    wanted = kept(candidates.select(*keys, *pair).where(F.col(entity).isNotNull() & F.col(partner).isNotNull()).distinct())
    n_left, n_right, n_pairs = wanted.agg(F.count_distinct(entity), F.count_distinct(partner), F.count_distinct(*pair)).first()
    dense = n_pairs * DENSE >= n_left * n_right
    few = dense and 0 < n_left + n_right <= COLUMNS
    listed = None
    number = F.monotonically_increasing_id()
    # few names are put in order by one task
    place = lambda name: (F.row_number().over(Window.orderBy(name)) - 1).cast("int")
    left = kept(wanted.select(entity).distinct().withColumn("_e", place(entity) if few else number))
    right = kept(wanted.select(partner).distinct().withColumn("_p", place(partner) if few else -1 - number))
    numbered = lambda df, how: beside(beside(df, left, [entity], how, n_left), right, [partner], how, n_right)
    pairs = kept(numbered(wanted.select(*pair).distinct(), "inner").withColumn("_pair", number))
    ways = pairs.select("_e", "_p", "_pair")

    coded = numbered(rows.select(sample, entity, partner, F.col(value).alias("_v")), "left")
    if few:
        each = kept(sums_in_columns(coded, sample, n_left, n_right))
        totals = each.agg(*(F.array(*(F.count_if(F.getbit(f"_in{who}", F.lit(i)) == 1) for i in range(n))).alias(who) for who, n in (("_e", n_left), ("_p", n_right))))
        size = lambda who, name: totals.select(F.posexplode(who).alias(who, name)).where(F.col(name) > 0)
        each = each.where(F.col(sample).isNotNull())
        met = meet_in_rows(each, ways, n_pairs).withColumn("_n", F.lit(1))
        listed = [(r["_pair"], r["_e"], r["_p"]) for r in ways.collect()]
        in_rows = each.select("_in_e", "_in_p", *(F.col(f"_sums{who}").cast("array<double>").alias(f"_sums{who}") for who in ("_e", "_p")))
    else:
        each = coded.select(sample, F.explode(F.array("_e", "_p")).alias("_who"), "_v").where("_who IS NOT NULL")
        sums = kept(each.groupBy(sample, "_who").agg(F.sum("_v").alias("_v")))
        sizes = kept(sums.groupBy("_who").agg(F.count(F.lit(1)).alias("_size")))
        size = lambda who, name: sizes.select(F.col("_who").alias(who), F.col("_size").alias(name))
        there = sums.where(F.col(sample).isNotNull())
        a, b = there.where("_who >= 0").select(sample, F.col("_who").alias("_e"), F.col("_v").alias("_a")), there.where("_who < 0").select(sample, F.col("_who").alias("_p"), F.col("_v").alias("_b"))
        # sums of many samples take few bytes, so they are not broadcast by estimate
        met = beside(a.hint("shuffle_hash").join(b, sample), ways, ["_e", "_p"], rows=n_pairs) if dense else meet_by_bitmaps(a, b, ways, sample)
        met = kept(met.groupBy("_pair", "_a", "_b").agg(F.count(F.lit(1)).alias("_n")))
    met = met.select("_pair", F.col("_a").cast("double").alias("_a"), F.col("_b").cast("double").alias("_b"), X.ratio("_a", "_b").cast("double").alias("_ratio"), "_n")

    n, x, r = F.col("_n"), F.col("_x"), F.col("_ratio")
    by_values = lambda counts: kept(order.running_counts(counts, ["_pair", "_by"], "_x"))
    sides = (n_left, n_right)
    if listed:
        counts = in_rows.mapInArrow(_counted(listed, sides), "_pair long, _by int, _x double, _n long")
        placed = by_values(counts.groupBy("_pair", "_by", "_x").agg(F.sum("_n").alias("_n")))
        if placed.where(F.col("_by") != _BY_STEP).count() > RANKS:
            listed = None
    if not listed:
        stepped = met.select("_pair", "_a", "_b", step_of("_ratio").alias("_step"), "_n")
        counts = stepped.groupingSets([["_pair", v] for v in ("_a", "_b", "_step")], "_pair", "_a", "_b", "_step").agg(F.sum("_n").alias("_n"), F.grouping_id().cast("int").alias("_by"))
        values = F.when(F.col("_by") == _BY_A, F.col("_a")).when(F.col("_by") == _BY_B, F.col("_b")).otherwise(F.col("_step"))
        placed = by_values(counts.select("_pair", "_by", values.alias("_x"), "_n"))
    of = lambda by, v: F.when(F.col("_by") == by, v)
    total, middle = F.col("_total"), (F.col("_total") - 1) / 2
    holds = lambda k: of(_BY_STEP, x.isNotNull() & (F.col("_before") <= k) & (k < F.col("_before") + n))
    at = lambda k, v: F.min(F.when(holds(k), F.col(v)))
    info = kept(placed.groupBy("_pair").agg(
        F.sum(of(_BY_A, n)).alias("_n11"), F.max(of(_BY_A, total)).alias("_there_a"), F.max(of(_BY_B, total)).alias("_there_b"), F.max(of(_BY_STEP, total)).alias("_w"),
        at(F.floor(middle), "_x").alias("_low"), at(F.ceil(middle), "_x").alias("_high"), at(F.floor(middle), "_before").alias("_below"),
    ))
    # less the mean rank; the mean of ranks of nulls, which are last, is half of the others' number above it
    ranks = beside(placed.where(F.col("_by") != _BY_STEP), info.select("_pair", "_n11"), ["_pair"], rows=n_pairs).withColumn("_r", F.when(x.isNull(), total / 2).otherwise(order.mean_rank() - (F.col("_n11") + 1) / 2))
    spread = ranks.groupBy("_pair").agg(F.sum(of(_BY_A, n * F.col("_r") * F.col("_r"))).alias("_aa"), F.sum(of(_BY_B, n * F.col("_r") * F.col("_r"))).alias("_bb"))
    if listed:
        ends = {i["_pair"]: (np.nan if i["_low"] is None else i["_low"], np.nan if i["_high"] is None else i["_high"], i["_there_a"] / 2, i["_there_b"] / 2) for i in info.collect()}
        got = ranks.where(x.isNotNull()).select("_pair", "_by", "_x", "_r").orderBy("_pair", "_by", "_x").toArrow()
        pair_of, by_of, x_of, r_of = (got[v].to_numpy() for v in ("_pair", "_by", "_x", "_r"))
        starts = np.flatnonzero(np.append(True, (np.diff(pair_of) != 0) | (np.diff(by_of) != 0))) if len(got) else []
        looked = {(int(pair_of[i]), int(by_of[i])): (x_of[i:j], r_of[i:j]) for i, j in zip(starts, [*starts[1:], len(got)], strict=True)}
        ranked = in_rows.mapInArrow(_summed(listed, sides, ends, looked), "_pair long, _near double, _n long, _sum double, _squares double, _most double, _ab double").groupBy("_pair", "_near")
        parts = kept(ranked.agg(F.sum("_n").alias("_n"), F.sum("_sum").alias("_sum"), F.sum("_squares").alias("_squares"), F.max("_most").alias("_most"), F.sum("_ab").alias("_ab")))
    else:
        n_ranks = placed.groupBy("_by").agg(F.count(F.lit(1))).collect()
        with_rank = lambda df, by, v: beside(df, ranks.where((F.col("_by") == by) & x.isNotNull()).select("_pair", x.alias(v), F.col("_r").alias(f"_r{v}")), ["_pair", v], "left", sum(k for b, k in n_ranks if b == by))
        ranked = with_rank(with_rank(beside(met, info, ["_pair"], rows=n_pairs), _BY_A, "_a"), _BY_B, "_b")
        rank = lambda v: F.coalesce(f"_r{v}", F.when(F.col(v).isNull(), F.col(f"_there{v}") / 2))
        near = F.when(step_of("_ratio").between(F.col("_low"), F.col("_high")), r).alias("_near")
        parts = kept(ranked.groupBy("_pair", near).agg(
            F.sum("_n").alias("_n"), F.sum(n * r).alias("_sum"), F.sum(n * r * r).alias("_squares"), F.max("_ratio").alias("_most"), F.sum(n * rank("_a") * rank("_b")).alias("_ab"),
        ))
    sums = parts.groupBy("_pair").agg(F.sum("_sum").alias("_sum"), F.sum("_squares").alias("_squares"), F.max("_most").alias("ratio_max"), F.sum("_ab").alias("_ab"))
    close = order.running_counts(parts.where("_near IS NOT NULL").select("_pair", "_near", "_n"), ["_pair"], "_near")
    close = beside(close, info.select("_pair", "_below", "_w"), ["_pair"], rows=n_pairs).withColumns({"_before": F.col("_before") + F.col("_below"), "_total": F.col("_w")})
    medians = close.groupBy("_pair").agg(order.quantile_of("_near", 0.5).alias("ratio_median"))

    w = F.col("_w")
    var = X.ratio(F.col("_squares") - F.col("_sum") * X.ratio("_sum", w), w - 1)
    found = info.join(spread, "_pair").join(sums, "_pair").join(medians, "_pair", "left")
    rho = F.when((F.col("_n11") >= least) & (F.col("_aa") > 0) & (F.col("_bb") > 0), F.col("_ab") / F.sqrt("_aa") / F.sqrt("_bb"))
    found = found.withColumns({"ratio_mean": X.ratio("_sum", w), "ratio_sd": F.when(w > 1, F.sqrt(F.greatest(var, F.lit(0.0)))), "rho": rho})
    out = wanted.join(pairs, pair).join(size("_e", "n_a"), "_e").join(size("_p", "n_b"), "_p").join(found, "_pair", "left").withColumn("n11", F.coalesce("_n11", F.lit(0)))
    out = out.withColumns({"n10": F.col("n_a") - F.col("n11"), "n01": F.col("n_b") - F.col("n11")}).withColumn("n00", F.lit(samples) - F.col("n11") - F.col("n10") - F.col("n01"))
    return out.select(*keys, *pair, "n11", "ratio_mean", "ratio_sd", "ratio_median", "ratio_max", "rho", "n10", "n01", "n00", X.ratio(100.0 * F.col("n11"), "n_a").alias("pct"))


def meet_by_bitmaps(a: DataFrame, b: DataFrame, pairs: DataFrame, sample: str) -> DataFrame:
    """_pair, _a and _b of each sample that both of a pair's _e and _p are in, for pairs that are few of all that there could be.

    Samples are numbered, and each _e's and _p's are bitmaps of 64 with their values beside them; a pair meets in the chunks where the
    AND of its bitmaps is not 0, and only values of common samples come out.
    """
    numbers = kept(a.select(sample).union(b.select(sample)).distinct().withColumn("_no", F.monotonically_increasing_id()))
    left, right = sample_bitmaps(a, numbers, sample, "_e", "_a", "a"), sample_bitmaps(b, numbers, sample, "_p", "_b", "b")
    both = F.col("_bits_a").bitwiseAND(F.col("_bits_b"))
    common = lambda vals: F.transform(F.filter(vals, lambda x: F.getbit("_both", x["_bit"]) == 1), lambda x: x["v"])
    met = pairs.join(left, "_e").join(right, ["_p", "_chunk"]).withColumn("_both", both).where("_both != 0")
    return met.select("_pair", F.explode(F.arrays_zip(common("_vals_a").alias("a"), common("_vals_b").alias("b"))).alias("_v")).select("_pair", F.col("_v.a").alias("_a"), F.col("_v.b").alias("_b"))


def random_partners(pairs: DataFrame, entity: str, partner: str, pool: DataFrame, reps: int, seed: int = 1) -> DataFrame:
    """For each pair and replicate a partner drawn from the pool by a hash, never the true one.

    Pool members are numbered 0 .. n-1 in hash order; the draw is among n - 1 places, those from the true one on moved up.
    """
    members = pool.select(partner).distinct().withColumn("_h", X.hashed(partner, seed=seed))
    n = members.count()
    numbered = blocked_sums(members.withColumns({"_b": F.substring("_h", 1, 3), "_one": F.lit(1)}), ["_one"], "_b", ["_h", partner], {"_i": F.lit(1)}).select(partner, (F.col("_i") - 1).alias("_i"))
    rows = pairs.join(numbered, partner, "left").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    draw = F.pmod(X.hashed_number(entity, partner, "rep", seed=seed), F.lit(max(1, n - 1)))
    place = F.when(F.col("_i").isNotNull() & (draw >= F.col("_i")), draw + 1).otherwise(draw)
    drawn = numbered.select(F.col(partner).alias("drawn"), F.col("_i").alias("_j"))
    return rows.withColumn("_j", place).drop("_i").join(drawn, "_j").drop("_j")


def congeneric_contrast(scan: DataFrame, pairs: DataFrame, entity: str, partner: str, genus: str, high: float = 50.0) -> DataFrame:
    """Per entity: other members of its partner's genus in the scan, how many co-occur highly, rho of the best and the second."""
    own = pairs.select(entity, F.col(genus).alias("_g"))
    rows = scan.join(own, entity).where(F.col(genus) == F.col("_g"))
    ranked = pick.numbered(rows, [entity], [F.desc_nulls_last("rho"), partner], "_rn")
    return ranked.groupBy(entity).agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("pct") >= high).alias("n_high"), F.max(F.when(F.col("_rn") == 1, F.col("rho"))).alias("rho_1"), F.max(F.when(F.col("_rn") == 2, F.col("rho"))).alias("rho_2"))


def pass_rates(df: DataFrame, kind: str, filters: dict) -> DataFrame:
    """Per kind: n, how many pass each filter, and all of them; null fails."""
    flags = {k: F.coalesce(v, F.lit(False)) for k, v in filters.items()}
    every = F.lit(True)
    for f in flags.values():
        every = every & f
    return df.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(f).alias(f"pass_{k}") for k, f in flags.items()), F.count_if(every).alias("pass_all"))


def dominance_test(samples: DataFrame, presence: str, dominance: str, ratio: str, cutoffs: Sequence[float], present: float = 1.0, dominant: float = 50.0) -> DataFrame:
    """At each ratio cutoff: dominance among present samples at or over it and below it, with the 2x2 table."""
    grid = shape.literals(samples.sparkSession, "cutoff", cutoffs)
    rows = samples.where(F.col(presence) >= present).crossJoin(F.broadcast(grid))
    over, dom = F.col(ratio) >= F.col("cutoff"), F.col(dominance) >= dominant
    out = rows.groupBy("cutoff").agg(F.count_if(over & dom).alias("n11"), F.count_if(over & ~dom).alias("n10"), F.count_if(~over & dom).alias("n01"), F.count_if(~over & ~dom).alias("n00"))
    return stats.fisher_exact(out, "n11", "n10", "n01", "n00").withColumns({"rate_over": X.ratio("n11", F.col("n11") + F.col("n10")), "rate_below": X.ratio("n01", F.col("n01") + F.col("n00"))})


def taxon_association(long: DataFrame, outcome: DataFrame, sample: str, flag: str, least: int = 1) -> DataFrame:
    """2x2 table of each taxon's presence against a sample's flag at each rank, Fisher's p, and q per rank.

    long: sample, rank, taxon; outcome: sample, flag (all samples). Margins come from aggregates, not from a loop.
    """
    totals = outcome.agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(flag)).alias("_pos"))
    here = long.select(sample, "rank", "taxon").distinct().join(outcome, sample)
    counts = here.groupBy("rank", "taxon").agg(F.count(F.lit(1)).alias("_t"), F.count_if(F.col(flag)).alias("n11")).where(F.col("_t") >= least)
    tab = counts.crossJoin(F.broadcast(totals)).select("rank", "taxon", "n11", (F.col("_t") - F.col("n11")).alias("n10"), (F.col("_pos") - F.col("n11")).alias("n01"), (F.col("_n") - F.col("_t") - F.col("_pos") + F.col("n11")).alias("n00"))
    return stats.bh_fdr(stats.fisher_exact(tab, "n11", "n10", "n01", "n00"), "p_two", ["rank"], tie=["taxon"])
