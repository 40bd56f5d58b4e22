"""Joins of streams in time: last, next, nearest and interpolated values, and lag search.

Two streams are put together by a union and two ordered windows on their common key: one shuffle, no row is paired with another,
so the cost is that of a sort. `last` and `next` skip what isn't a source row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import params as P
from .timeline import US, _key


def bracket(targets: DataFrame, sources: DataFrame, key, t: str, order: list[str], value: str) -> DataFrame:
    """Target rows with before and after: (t, value) of the source rows on either side; a source at the same time is both.

    Of source rows at one time the last in order counts before and the first after.
    """
    k = _key(key)
    both = targets.withColumn("__side", F.lit(1)).withColumn("__s", F.lit(None).cast("struct<t:bigint,v:double>"))
    src = sources.where(F.col(t).isNotNull() & F.col(value).isNotNull()).select(*k, t, *order, F.lit(0).alias("__side"), F.struct(F.col(t).cast("bigint").alias("t"), F.col(value).cast("double").alias("v")).alias("__s"))
    both = both.unionByName(src, allowMissingColumns=True)
    back = W.partitionBy(*k).orderBy(t, "__side", *order).rowsBetween(W.unboundedPreceding, W.currentRow)
    forth = W.partitionBy(*k).orderBy(F.col(t).desc(), F.col("__side"), *[F.col(o).desc() for o in order]).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = both.withColumn("before", F.last("__s", ignorenulls=True).over(back)).withColumn("after", F.last("__s", ignorenulls=True).over(forth))
    return out.where("__side = 1").drop("__side", "__s")


def interpolate(targets: DataFrame, sources: DataFrame, key, t: str, order: list[str], value: str, out: str, max_gap_s: float | None = P.MAX_INTERPOLATION_GAP_S) -> DataFrame:
    """Adds out, the linear value between the neighbours; null outside the span, or if the nearest source row is farther than max_gap_s."""
    rows = bracket(targets, sources, key, t, order, value)
    b, a = F.col("before"), F.col("after")
    span = a["t"] - b["t"]
    lerp = F.when(span > 0, b["v"] + (a["v"] - b["v"]) * (F.col(t) - b["t"]) / span).otherwise(b["v"])
    near = F.least(F.col(t) - b["t"], a["t"] - F.col(t)) / US
    ok = b.isNotNull() & a.isNotNull()
    if max_gap_s is not None:
        ok = ok & (near <= max_gap_s)
    return rows.withColumn(out, F.when(ok, lerp)).drop("before", "after")


def interpolate_many(targets: DataFrame, sources: DataFrame, key, t: str, order: list[str], values: dict[str, str], lag_s: Column | float = 0.0) -> DataFrame:
    """Adds, for each out: value of values, the linear value of the sources at t + lag_s, from the rows that have that value; null outside their span, or where fewer than two have it. One shuffle for all values."""
    k = _key(key)
    lag = lag_s if isinstance(lag_s, Column) else F.lit(float(lag_s))
    src = sources.where(F.col(t).isNotNull()).withColumn(t, F.col(t) - F.round(lag * US).cast("bigint"))
    given = [F.when(F.col(v).isNotNull(), F.struct(F.col(t).alias("t"), F.col(v).cast("double").alias("v"))).alias(f"__s_{out}") for out, v in values.items()]
    both = targets.withColumn("__side", F.lit(1)).unionByName(src.select(*k, t, *order, F.lit(0).alias("__side"), *given), allowMissingColumns=True)
    back = W.partitionBy(*k).orderBy(t, "__side", *order).rowsBetween(W.unboundedPreceding, W.currentRow)
    forth = W.partitionBy(*k).orderBy(F.col(t).desc(), F.col("__side"), *[F.col(o).desc() for o in order]).rowsBetween(W.unboundedPreceding, W.currentRow)
    held = {out: F.col(f"__s_{out}") for out in values}
    # All values in the same two windows, so that rows are sorted twice, however many values there are.
    both = both.select("*", *[c.alias(n) for out, s in held.items() for n, c in ((f"__b_{out}", F.last(s, ignorenulls=True).over(back)), (f"__m_{out}", F.count(s).over(back)))])
    both = both.select("*", *[c.alias(n) for out, s in held.items() for n, c in ((f"__a_{out}", F.last(s, ignorenulls=True).over(forth)), (f"__n_{out}", F.count(s).over(forth)))])
    both, found = both.where("__side = 1"), {}
    for out in values:
        b, a = F.col(f"__b_{out}"), F.col(f"__a_{out}")
        span = a["t"] - b["t"]
        two = (span > 0) | (F.col(f"__m_{out}") >= 2) | (F.col(f"__n_{out}") >= 2)  # rows at the target's own time are counted on both sides
        lerp = F.when(span > 0, b["v"] + (a["v"] - b["v"]) * (F.col(t) - b["t"]) / span).otherwise(b["v"])
        found[out] = F.when(b.isNotNull() & a.isNotNull() & two, lerp)
    return both.withColumns(found).drop("__side", *[f"__{x}_{out}" for out in values for x in "sbamn"])


def nearest(targets: DataFrame, sources: DataFrame, key, t: str, order: list[str], value: str, out: str, tolerance_s: float = P.NEAREST_TOLERANCE_S) -> DataFrame:
    """Adds out and out_dt_s of the nearest source row within the tolerance; of two equally near ones the earlier."""
    rows = bracket(targets, sources, key, t, order, value)
    b, a = F.col("before"), F.col("after")
    db, da = (F.col(t) - b["t"]) / US, (a["t"] - F.col(t)) / US
    earlier = a.isNull() | (db <= da)
    dt = F.when(earlier, db).otherwise(da)
    ok = F.coalesce(dt <= tolerance_s, F.lit(False))
    return rows.withColumn(out, F.when(ok, F.when(earlier, b["v"]).otherwise(a["v"]))).withColumn(f"{out}_dt_s", F.when(ok, F.when(earlier, -db).otherwise(da))).drop("before", "after")


def grid(df: DataFrame, key, t: str, step_s: float) -> DataFrame:
    """(key, t) at whole steps from each key's first to its last time."""
    k, us = _key(key), int(round(step_s * US))
    ends = df.groupBy(*k).agg(F.min(t).alias("a"), F.max(t).alias("b"))
    return ends.select(*k, F.explode(F.sequence(F.col("a"), F.col("b"), F.lit(us).cast("bigint"))).alias(t))


def resample(df: DataFrame, key, t: str, order: list[str], value: str, step_s: float, out: str = "value") -> DataFrame:
    return interpolate(grid(df, key, t, step_s), df, key, t, order, value, out, None)


def guarded_corr(x: Column, y: Column, least: int = 2, least_std: float = 1e-12) -> Column:
    """Aggregate: correlation of rows that have both; null for fewer than `least`, or without variation."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    return F.when((F.count(a) >= least) & (sa >= least_std) & (sb >= least_std), F.covar_pop(a, b) / (sa * sb))  # corr itself fails where one of them is exactly zero, whatever stands around it


def lag_search(rows: DataFrame, key, index: str, x: str, y: str, half_width: int, least: int = 10, block: int = 4096) -> DataFrame:
    """A row per key with the lag (in steps of index) at which y best follows x, its correlation, and the margin over the median of all lags.

    Rows of x are dealt into blocks of the index, rows of y into every block that a lag can bring them to (two of them where half_width is below half a block), and a task adds up all lags of a block at once. So a row is shuffled
    once or twice, whatever the number of lags, a long key is spread over its blocks, and a row per block and lag is what comes out. Values are taken from their key's mean first; a spread under a
    millionth of what is left counts as none. Rows that share a key and an index are all paired. Of equal peaks the least lag wins.
    """
    k, h = _key(key), int(half_width)
    means = rows.groupBy(*k).agg(F.avg(x).alias("__mx"), F.avg(y).alias("__my"))
    centred = rows.select(*k, F.col(index).cast("bigint").alias("__i"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).join(means, k)
    first = lambda c: F.floor(c / block).cast("bigint")
    left = centred.where("__x IS NOT NULL").select(*k, first(F.col("__i")).alias("__b"), "__i", (F.col("__x") - F.col("__mx")).alias("__v"), F.lit(True).alias("__left"))
    reach = F.explode(F.sequence(first(F.col("__i") - h), first(F.col("__i") + h))).alias("__b")
    right = centred.where("__y IS NOT NULL").select(*k, reach, "__i", (F.col("__y") - F.col("__my")).alias("__v"), F.lit(False).alias("__left"))
    sums = ["__n", "__sx", "__sxx", "__sy", "__syy", "__sxy"]
    schema = T.StructType([*[left.schema[c] for c in k], T.StructField("lag", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in sums]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        low = int(pdf["__b"].iloc[0]) * block
        parts = []
        for side, start, n in ((True, low, block), (False, low - h, block + 2 * h)):
            own = pdf[pdf["__left"] == side]
            at, v = own["__i"].to_numpy() - start, own["__v"].to_numpy()
            parts.append([np.bincount(at, w, n) for w in (np.ones(len(v)), v, v * v)])
        (cx, sx, qx), (cy, sy, qy) = parts
        over = lambda a, b: np.correlate(a, b, "valid")
        out = pd.DataFrame({"lag": np.arange(-h, h + 1), "__n": over(cy, cx), "__sx": over(cy, sx), "__sxx": over(cy, qx), "__sy": over(sy, cx), "__syy": over(qy, cx), "__sxy": over(sy, sx)})
        out = out[out["__n"] > 0.5]
        for c in reversed(k):
            out.insert(0, c, pdf[c].iloc[0])
        return out

    total = left.unionByName(right).groupBy(*k, "__b").applyInPandas(run, schema).groupBy(*k, "lag").agg(*[F.sum(c).alias(c) for c in sums])
    n = F.round("__n").cast("bigint")
    var = lambda s, q: F.col(q) / n - (F.col(s) / n) ** 2
    spread = lambda s, q: (var(s, q) >= 1e-18) & (var(s, q) >= 1e-12 * F.col(q) / n)
    r = (F.col("__sxy") / n - F.col("__sx") / n * F.col("__sy") / n) / F.sqrt(var("__sx", "__sxx") * var("__sy", "__syy"))
    score = total.where((n >= least) & spread("__sx", "__sxx") & spread("__sy", "__syy")).select(*k, "lag", n.alias("n"), r.alias("r"))
    best = F.max(F.struct(F.round("r", 9).alias("r9"), (-F.col("lag")).alias("first"), "lag", "r", "n")).alias("b")
    return score.groupBy(*k).agg(best, F.median("r").alias("m")).select(*k, F.col("b.lag").alias("lag"), F.col("b.r").alias("correlation"), (F.col("b.r") - F.col("m")).alias("margin"), F.col("b.n").alias("n"))


def offset_search(a: DataFrame, b: DataFrame, coarse: DataFrame, key, t: str, order: list[str], value: str, step_s: float = P.SEARCH_STEP_S, half_width_s: float = P.SEARCH_HALF_WIDTH_S) -> DataFrame:
    """(key, offset_s, correlation, margin): the shift of a's clock against b's, of those around coarse (key, coarse_us), at which a's value, read between its rows, follows b's best.

    b is put on a grid of step_s from its first value on; a on the same grid shifted by coarse and half_width_s longer on both sides, so every candidate is a shift by whole steps. Keys whose b has fewer than ten values, or
    spans less than MIN_OVERLAP_S, have no row.
    """
    k, us, h = _key(key), int(round(step_s * US)), int(round(half_width_s / step_s))
    known = lambda df: df.where(F.col(t).isNotNull() & F.col(value).isNotNull()).select(*k, t, *order, value)
    ends = known(b).groupBy(*k).agg(F.count("*").alias("__n"), F.min(t).alias("__t0"), F.max(t).alias("__t1")).where((F.col("__n") >= 10) & (F.col("__t1") - F.col("__t0") >= P.MIN_OVERLAP_S * US))
    ends = ends.join(coarse.where("coarse_us IS NOT NULL"), k).withColumn("__last", F.ceil((F.col("__t1") - F.col("__t0")) / us).cast("bigint") - 1)

    def on_grid(df: DataFrame, low, high, start, out: str) -> DataFrame:
        at = ends.select(*k, start.alias("__s"), F.explode(F.sequence(low, high)).alias("i")).select(*k, "i", (F.col("__s") + F.col("i") * us).cast("bigint").alias(t))
        return interpolate(at, known(df), key, t, order, value, out, None).select(*k, "i", out)

    zero, last, wide = F.lit(0).cast("bigint"), F.col("__last"), F.lit(h).cast("bigint")
    grid_b = on_grid(b, zero, last, F.col("__t0"), "x")
    grid_a = on_grid(a, -wide, last + wide, F.col("__t0") + F.col("coarse_us"), "y")
    found = lag_search(grid_b.unionByName(grid_a, allowMissingColumns=True), key, "i", "x", "y", h)
    return found.join(coarse, k).select(*k, ((F.col("coarse_us") + F.col("lag") * us) / US).alias("offset_s"), "correlation", "margin")


def overlap(a: DataFrame, b: DataFrame, key, t: str, order: list[str] | None = None) -> DataFrame:
    """Per key, how two streams overlap in time: seconds as the clocks say and with the mean offset taken off (aligned_overlap_s), offsets of a's first and last time from b's, drift in seconds and ppm of b's length, and whole hours in the offset.

    First and last are those of the rows, in the order of the columns `order`, by default of the times themselves.
    """
    k = _key(key)
    at = F.when(F.col(t).isNotNull(), F.struct(*(order or [t])))
    ends = lambda df, s: df.groupBy(*k).agg((F.min_by(t, at) / US).alias(f"{s}0"), (F.max_by(t, at) / US).alias(f"{s}1"))
    rows = ends(a, "a").join(ends(b, "b"), k)
    rows = rows.withColumn("overlap_s", F.greatest(F.lit(0.0), F.least("a1", "b1") - F.greatest("a0", "b0"))).withColumn("offset_start_s", F.col("a0") - F.col("b0")).withColumn("offset_end_s", F.col("a1") - F.col("b1"))
    rows = rows.withColumn("drift_s", F.col("offset_end_s") - F.col("offset_start_s")).withColumn("offset_mean_s", (F.col("offset_end_s") + F.col("offset_start_s")) / 2)
    rows = rows.withColumn("drift_ppm", F.when(F.col("b1") > F.col("b0"), F.col("drift_s") / (F.col("b1") - F.col("b0")) * 1e6)).withColumn("whole_hours", F.bround(F.col("offset_mean_s") / 3600).cast("int"))
    shifted = lambda c: F.col(c) - F.col("offset_mean_s")
    rows = rows.withColumn("aligned_overlap_s", F.greatest(F.lit(0.0), F.least(shifted("a1"), F.col("b1")) - F.greatest(shifted("a0"), F.col("b0"))))
    rows = rows.withColumn("residual_s", F.col("offset_mean_s") - F.col("whole_hours") * 3600)
    steady = F.abs("drift_s") <= P.NEGLIGIBLE_DRIFT_S
    kind = F.when((F.col("whole_hours") != 0) & (F.abs("residual_s") <= P.TIMEZONE_TOLERANCE_S) & steady, "constant_offset_whole_hour_likely_timezone").when(steady, "constant_offset").otherwise("variable_offset_possible_drift")
    return rows.withColumn("interpretation", kind).drop("a0", "a1", "b0", "b1")


def synchronize(pairs: DataFrame, offset: str, correlation: str, margin: str, starts: tuple[str, str, str, str]) -> DataFrame:
    """Adds what a pair's clocks and its best lag decide: clock_offset_s, drift_estimate_s, drift_ppm, drift_detected, estimated_offset_s, offset_method, offset_confidence, the overlap on b's clock and status.

    starts: columns with a's first and last and b's first and last time in seconds. The lag's offset counts if correlation and margin reach MIN_CORRELATION and MIN_PEAK_MARGIN, else the mean difference of the clocks;
    an overlap under MIN_OVERLAP_S after the shift leaves a pair open whatever was found.
    """
    a0, a1, b0, b1 = map(F.col, starts)
    rows = pairs.withColumn("clock_offset_s", ((a0 - b0) + (a1 - b1)) / 2).withColumn("drift_estimate_s", (a1 - b1) - (a0 - b0))
    rows = rows.withColumn("drift_ppm", F.when(b1 > b0, 1e6 * F.col("drift_estimate_s") / (b1 - b0))).withColumn("drift_detected", F.abs("drift_estimate_s") > 1.0)
    by_signal = F.coalesce(F.col(offset).isNotNull() & (F.col(correlation) >= P.MIN_CORRELATION) & (F.col(margin) >= P.MIN_PEAK_MARGIN), F.lit(False))
    rows = rows.withColumn("__s", by_signal).withColumn("estimated_offset_s", F.when(F.col("__s"), F.col(offset)).otherwise(F.col("clock_offset_s")))
    start, end = F.greatest(a0 - F.col("estimated_offset_s"), b0), F.least(a1 - F.col("estimated_offset_s"), b1)
    rows = rows.withColumn("overlap_start_s", start).withColumn("overlap_end_s", end).withColumn("overlap_s", F.greatest(F.lit(0.0), end - start))
    no_clock = F.col("clock_offset_s").isNull()
    short = F.col("overlap_s") < P.MIN_OVERLAP_S
    rows = rows.withColumn("offset_method", F.when(no_clock, "none").when(F.col("__s"), "speed_cross_correlation").otherwise("clock_difference"))
    rows = rows.withColumn("offset_confidence", F.when(no_clock | short, "none").when(F.col("__s") & (F.col(correlation) >= 0.8), "high").when(F.col("__s"), "medium").otherwise("low"))
    return rows.withColumn("status", F.when(no_clock | short, "UNRESOLVED").when(F.col("__s"), "CONFIRMED_BY_SIGNAL").otherwise("CLOCK_ONLY")).drop("__s")


def windows(df: DataFrame, key, order: list[str], t: str, value: str | None = None, flags: str | None = None, seconds: float = P.WINDOW_SECONDS, stride_s: float = P.WINDOW_STRIDE_SECONDS, min_coverage: float = P.WINDOW_MIN_COVERAGE, require_label: bool = True) -> DataFrame:
    """Causal windows [g - seconds, g] on a grid of strides that starts at the first time + seconds.

    Every row is given to the grid points whose window holds it (at most seconds / stride + 1 of them), so windows form in one group-by and no range join is needed.
    Coverage is min(1, n / max(1, seconds / median step)).
    """
    k, length, stride = _key(key), int(round(seconds * US)), int(round(stride_s * US))
    rows = df.where(F.col(t).isNotNull())
    w = W.partitionBy(*k).orderBy(t, *order)
    rows = rows.withColumn("__i", F.row_number().over(w) - 1).withColumn("__dt", F.col(t) - F.lag(t).over(w))
    ends = rows.groupBy(*k).agg(F.min(t).alias("__a"), F.max(t).alias("__b"), F.median(F.when(F.col("__dt") > 0, F.col("__dt"))).alias("__m"))
    rows = rows.join(ends, k).withColumn("__g0", F.col("__a") + length)
    first = F.greatest(F.lit(0), F.ceil((F.col(t) - F.col("__g0")) / stride))
    last = F.least(F.floor((F.col(t) + length - F.col("__g0")) / stride), F.floor((F.col("__b") - F.col("__g0")) / stride))
    rows = rows.withColumn("__first", first.cast("bigint")).withColumn("__last", last.cast("bigint")).where("__first <= __last")
    rows = rows.withColumn("__w", F.explode(F.sequence("__first", "__last")))
    at = F.struct(t, "__i")
    aggs = [F.count("*").alias("n"), F.min("__i").alias("first_row"), F.max("__i").alias("last_row"), F.first("__m").alias("__m"), F.first("__g0").alias("__g0")]
    if value:
        aggs.append(F.max_by(value, at).alias("label"))
    if flags:
        aggs.append(F.bit_or(flags).alias("flags"))
    out = rows.groupBy(*k, "__w").agg(*aggs).withColumn("coverage", F.least(F.lit(1.0), F.col("n") / F.greatest(F.lit(1.0), F.lit(float(length)) / F.col("__m"))))
    out = out.where((F.col("n") >= 2) & (F.col("coverage") >= min_coverage)).withColumn("end_us", F.col("__g0") + F.col("__w") * stride)
    if value and require_label:
        out = out.where("label IS NOT NULL")
    return out.drop("__m", "__g0", "__w")
