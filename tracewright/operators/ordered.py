"""Ordered analytics: held values, trailing time windows, derivatives, integrals and runs. All are windows of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params as P
from .timeline import US, _key


def _rows(key, order: list[str]) -> W:
    return W.partitionBy(*_key(key)).orderBy(*order)


# Held values


def freshness(df: DataFrame, key, order: list[str], t: str, values: list[str], fix: Column | None = None, multiple: float = P.STALE_UPDATE_MULTIPLE, floor_s: float = P.STALE_MIN_SECONDS) -> DataFrame:
    """Adds fresh (a value differs from the row before, and there is a fix), held_s (seconds since the last fresh row) and stale.

    Stale is held_s beyond max(multiple * median interval of fresh rows, floor_s) of the recording; without two fresh rows nothing is stale.
    """
    w = _rows(key, order)
    changed = F.lit(False)
    for v in values:
        changed = changed | ~F.col(v).eqNullSafe(F.lag(v).over(w))
    rows = df.withColumn("fresh", changed & (F.lit(True) if fix is None else fix))
    at = F.last(F.when(F.col("fresh"), F.col(t)), ignorenulls=True)
    rows = rows.withColumn("held_s", (F.col(t) - at.over(w.rowsBetween(W.unboundedPreceding, W.currentRow))) / US)
    rows = rows.withColumn("__gap", F.when(F.col("fresh"), F.col(t) - at.over(w.rowsBetween(W.unboundedPreceding, -1))))
    k = _key(key)
    limit = rows.groupBy(*k).agg(F.median(F.when(F.col("__gap") > 0, F.col("__gap"))).alias("__m"))
    limit = limit.select(*k, F.when(F.col("__m").isNotNull(), F.greatest(F.col("__m") * multiple / US, F.lit(floor_s))).alias("__limit"))
    return rows.join(limit, k).withColumn("stale", F.coalesce(F.col("held_s") > F.col("__limit"), F.lit(False))).drop("__gap", "__limit")


def update_intervals(df: DataFrame, key, order: list[str], t: str, values: list[str], fix: Column | None = None) -> DataFrame:
    """A row per recording: rows, share of rows with a fix, updates, the median, p90 and longest of the positive intervals between updates in seconds, and updates a second."""
    w = _rows(key, order)
    changed = F.lit(False)
    for v in values:
        changed = changed | ~F.col(v).eqNullSafe(F.lag(v).over(w))
    has = F.lit(True) if fix is None else F.coalesce(fix, F.lit(False))
    rows = df.where(F.col(t).isNotNull()).select(*_key(key), *order, t, (changed & has).alias("c"), has.alias("f"))
    if fix is not None:  # the first fix is an observation of its own
        rows = rows.withColumn("c", F.col("c") | (F.col("f") & (F.sum(F.col("f").cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) == 1)))
    at = F.when(F.col("c"), F.col(t))
    gaps = rows.withColumn("u", at).withColumn("g", F.when(F.col("c"), (F.col(t) - F.last(at, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))) / US))
    g = F.when(F.col("g") > 0, F.col("g"))
    span = (F.max("u") - F.min("u")) / US
    return gaps.groupBy(*_key(key)).agg(
        F.count("*").alias("n_rows"), F.avg(F.col("f").cast("int")).alias("availability"), F.count_if("c").alias("updates"), F.median(g).alias("median_s"), F.percentile(g, F.lit(0.9)).alias("p90_s"), F.max(g).alias("max_s"),
        F.when(span > 0, (F.count_if("c") - 1) / span).alias("rate_hz"),
    )


# Trailing windows of time


def trailing_many(df: DataFrame, key, order: list[str], t: str, values: dict[str, str], seconds: float) -> DataFrame:
    """Adds, for each out: value of values, out_n, out_mean and out_std of the rows from t - seconds to this row, by position.

    Time is cut into blocks as long as the window, so a window is the rows of its block up to its own and the last rows of the block before. Each row goes to its block and, as a tail, to the next one, where it counts for
    rows up to its time + seconds: both parts are running sums, the cost doesn't depend on the window's length, and a long recording is spread over its blocks. Values are taken from their block's mean
    first, so a spread that is tiny against the values isn't lost. Times are integer microseconds, so the border is exact. Null values are skipped, a row without time has no window; the deviation is the population's and needs two.
    """
    k, us = _key(key), int(round(seconds * US))
    payload = [c for c in df.columns if c not in k]
    tail, at = F.col("__tail"), F.col(t).cast("bigint")
    twice = df.withColumn("__tail", F.explode(F.array(F.lit(False), F.lit(True)))).where(~tail | F.col(t).isNotNull())
    block = F.floor(at / us).cast("bigint") + tail.cast("int")
    held = [F.when(F.col(t).isNotNull(), F.col(v).cast("double")).alias(f"__x_{out}") for out, v in values.items()]
    rows = twice.select(*k, block.alias("__b"), (at + F.when(tail, us).otherwise(0)).alias("__e"), "__tail", *[F.when(~tail, F.col(c)).alias(c) for c in payload], *held)
    rows = rows.repartition(*k, "__b")  # also where rows lie by key already: a task would hold whole recordings
    each = W.partitionBy(*k, "__b")
    heads = each.orderBy("__tail", t, *order).rowsBetween(W.unboundedPreceding, W.currentRow)
    tails = each.orderBy(F.col("__e").desc(), F.col("__tail").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns({f"__c_{out}": F.avg(f"__x_{out}").over(each) for out in values}).withColumns({f"__x_{out}": F.col(f"__x_{out}") - F.col(f"__c_{out}") for out in values})
    both = lambda of, c: F.coalesce(of(F.when(~tail, c)).over(heads), F.lit(0)) + F.coalesce(of(F.when(tail, c)).over(tails), F.lit(0))
    # All values at once, so that rows are sorted twice, however many values there are.
    rows = rows.withColumns({n: c for out in values for x in [F.col(f"__x_{out}")] for n, c in ((f"{out}_n", both(F.count, x)), (f"__s_{out}", both(F.sum, x)), (f"__q_{out}", both(F.sum, x * x)))})
    rows = rows.where("NOT __tail")
    for out in values:
        n, off = F.col(f"{out}_n"), F.col(f"__s_{out}") / F.col(f"{out}_n")
        rows = rows.withColumn(f"{out}_mean", F.when(n > 0, F.col(f"__c_{out}") + off))
        rows = rows.withColumn(f"{out}_std", F.when(n >= 2, F.sqrt(F.greatest(F.col(f"__q_{out}") / n - off * off, F.lit(0.0)))))
    return rows.select(*df.columns, *[f"{out}_{s}" for out in values for s in ("n", "mean", "std")])


def trailing(df: DataFrame, key, order: list[str], t: str, value: str, seconds: float, out: str = "trailing") -> DataFrame:
    """Adds out_n, out_mean and out_std of the rows from t - seconds to this row, by position."""
    return trailing_many(df, key, order, t, {out: value}, seconds)


# Derivatives and integrals


def central_difference(df: DataFrame, key, order: list[str], t: str, value: str, out: str = "rate") -> DataFrame:
    """(next - last) / (time between them); null at the ends and where time doesn't advance."""
    w = _rows(key, order)
    span = (F.lead(t).over(w) - F.lag(t).over(w)) / US
    return df.withColumn(out, F.when(span > 0, (F.lead(value).over(w) - F.lag(value).over(w)) / span))


def gradient(df: DataFrame, key, order: list[str], t: str, value: str, out: str = "gradient") -> DataFrame:
    """Second-order gradient on uneven steps, one-sided at the ends; rows without value or with a time seen before get null."""
    k = _key(key)
    marked = df.withColumn("__use", F.col(value).isNotNull() & F.col(t).isNotNull())
    marked = marked.withColumn("__use", F.col("__use") & (F.row_number().over(W.partitionBy(*k, t, "__use").orderBy(*order)) == 1))
    w = W.partitionBy(*k, "__use").orderBy(t, *order)
    before, after = (F.col(t) - F.lag(t).over(w)) / US, (F.lead(t).over(w) - F.col(t)) / US
    down, up = F.col(value) - F.lag(value).over(w), F.lead(value).over(w) - F.col(value)
    inner = (before * before * up + after * after * down) / (before * after * (before + after))
    g = F.when(before.isNotNull() & after.isNotNull(), inner).when(after.isNotNull(), up / after).when(before.isNotNull(), down / before)
    return marked.withColumn(out, F.when(F.col("__use"), g)).drop("__use")


def integrate(df: DataFrame, key, order: list[str], t: str, rate: str, out: str = "integral", initial: float = 0.0) -> DataFrame:
    """Running trapezoid from an initial value."""
    w = _rows(key, order)
    area = (F.col(rate) + F.lag(rate).over(w)) / 2 * (F.col(t) - F.lag(t).over(w)) / US
    rows = df.withColumn("__a", F.coalesce(area, F.lit(0.0)))
    return rows.withColumn(out, F.lit(initial) + F.sum("__a").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("__a")


def path_length(df: DataFrame, key, order: list[str], coords: list[str]) -> DataFrame:
    """A row per key: distance along the points, and displacement between the first and last."""
    w = _rows(key, order)
    square = lambda a, b: sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0))
    now = [F.col(c) for c in coords]
    rows = df.withColumn("__d", F.sqrt(square(now, [F.lag(c).over(w) for c in coords])))
    at = F.struct(*order)
    ends = [(F.max_by(c, at), F.min_by(c, at)) for c in coords]
    return rows.groupBy(*_key(key)).agg(F.sum("__d").alias("distance"), F.sqrt(square([a for a, _ in ends], [b for _, b in ends])).alias("displacement"), F.count("*").alias("n"))


# Runs


def runs(df: DataFrame, key, order: list[str], t: str, mask: str) -> DataFrame:
    """A row per stretch of true: n, start, end, and next, the time of the first row after it (null at the end of the recording)."""
    w = _rows(key, order)
    others = F.count_if(~F.coalesce(F.col(mask), F.lit(False))).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))  # the same in a stretch of true, and in no two
    rows = df.withColumns({"run": others, "__next": F.lead(t).over(w)})
    at = F.struct(*order)
    return rows.where(F.col(mask)).groupBy(*_key(key), "run").agg(F.count("*").alias("n"), F.min(t).alias("start_us"), F.max(t).alias("end_us"), F.max_by("__next", at).alias("next_us")).drop("run")


def longest_run(df: DataFrame, key, order: list[str], t: str, mask: str) -> DataFrame:
    """The stretch of true that lasts longest, the first of equals."""
    found = runs(df, key, order, t, mask).withColumn("duration_us", F.col("end_us") - F.col("start_us"))
    best = F.max(F.struct("duration_us", (-F.col("start_us")).alias("first"), "start_us", "end_us", "n")).alias("b")
    return found.groupBy(*_key(key)).agg(best).select(*_key(key), "b.start_us", "b.end_us", "b.n", (F.col("b.duration_us") / US).alias("duration_s"))


def outages(df: DataFrame, key, order: list[str], t: str, invalid: str, min_s: float = P.MIN_OUTAGE_DURATION_S) -> DataFrame:
    """Stretches of invalid rows that last to the next valid row, of min_s or more."""
    end = F.coalesce("next_us", "end_us")
    return runs(df, key, order, t, invalid).withColumn("duration_s", (end - F.col("start_us")) / US).where(F.col("duration_s") >= min_s)


def holds(df: DataFrame, key, order: list[str], t: str, values: list[str], min_s: float = P.POSITION_HOLD_THRESHOLD_S) -> DataFrame:
    """Times between updates for which values stay as they are, of min_s or more; the first row counts as an update, and what follows the last update isn't a hold."""
    k, w = _key(key), _rows(key, order)
    changed = F.lit(False)
    for v in values:
        changed = changed | ~F.col(v).eqNullSafe(F.lag(v).over(w))
    rows = df.withColumn("__c", changed | (F.row_number().over(w) == 1))
    ups = rows.where("__c").withColumn("end_us", F.lead(t).over(w))
    return ups.select(*k, F.col(t).alias("start_us"), "end_us", ((F.col("end_us") - F.col(t)) / US).alias("duration_s")).where(F.col("duration_s") >= min_s)


def rest_seconds(df: DataFrame, key, order: list[str], t: str, mask: str) -> DataFrame:
    """Seconds between neighbours that are both at rest."""
    w = _rows(key, order)
    dt = (F.col(t) - F.lag(t).over(w)) / US
    rows = df.withColumn("__d", F.when(F.col(mask) & F.lag(mask).over(w) & (dt > 0), dt))
    return rows.groupBy(*_key(key)).agg(F.coalesce(F.sum("__d"), F.lit(0.0)).alias("rest_s"))


TIE = 1e-9  # of a limit: nearer than this, running sums of blocks can't tell which side a figure is on


def _plain(window: Column) -> tuple[Column, Column]:
    """Mean and population deviation (null for fewer than two) of an array without nulls, as one pass in its order gives them."""
    start = F.struct(F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(c) for c in "smq"])

    def add(a: Column, x: Column) -> Column:
        n = a["n"] + 1
        m = a["m"] + (x - a["m"]) / n
        return F.struct(n.alias("n"), (a["s"] + x).alias("s"), m.alias("m"), (a["q"] + (x - m) * (x - a["m"])).alias("q"))

    end = F.aggregate(window, start, add)
    return F.when(end["n"] > 0, end["s"] / end["n"]), F.when(end["n"] >= 2, F.sqrt(end["q"] / end["n"]))


def stationary(df: DataFrame, key, order: list[str], t: str, force_norm: str, rate_norm: str | None = None, seconds: float = 2.0, gravity: float = P.STANDARD_GRAVITY_MPS2) -> DataFrame:
    """Adds stationary: over the trailing window the force varies little and averages g, and the rotation, where known, is slow.

    Rows with a figure within TIE of its limit are decided by the plain mean and deviation of their own window's values, in order, so a figure that is its limit counts whatever block it lies in; `order` tells rows of one time apart.
    """
    k, us = _key(key), int(round(seconds * US))
    limits = [P.MAX_STATIONARY_ACCEL_STD_MPS2, P.MAX_STATIONARY_GRAVITY_ERROR_MPS2, P.MAX_STATIONARY_GYRO_RPS]

    def figures(mean: Column, std: Column, rate: Column | None) -> list[Column]:
        return [std, F.abs(mean - gravity), *([rate] if rate is not None else [])]

    def still(mean: Column, std: Column, rate: Column | None) -> Column:
        force = [c <= x for c, x in zip(figures(mean, std, None), limits, strict=False)]
        slow = F.lit(True) if rate is None else F.coalesce(rate <= limits[2], F.lit(True))
        return F.coalesce(force[0] & force[1] & slow, F.lit(False))

    values = {"__f": force_norm} | ({"__g": rate_norm} if rate_norm else {})
    rows = trailing_many(df, key, order, t, values, seconds)
    own = (F.col("__f_mean"), F.col("__f_std"), F.col("__g_mean") if rate_norm else None)
    near = F.lit(False)
    for c, x in zip(figures(*own), limits, strict=False):
        near = near | F.coalesce(F.abs(c - x) <= TIE, F.lit(False))
    rows = rows.withColumns({"__near": near, "__still": still(*own)}).drop(*[f"__{a}_{b}" for a in "fg" for b in ("n", "mean", "std")])

    at = [*k, t, *order]
    block = F.floor(F.col(t) / us).cast("bigint")
    asked = rows.where("__near").select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(at)], F.explode(F.array(block - 1, block)).alias("__block")).distinct()
    held = df.where(F.col(t).isNotNull()).select(*at, block.alias("__b"), *[F.col(v).cast("double").alias(f"{n}_x") for n, v in values.items()])
    mine = [F.col(f"__{i}") for i in range(len(at))]
    same = F.col("__b") == F.col("__block")
    for c, x in zip(k, mine, strict=False):
        same = same & F.col(c).eqNullSafe(x)
    now, then = mine[len(k) :], [F.col(c) for c in at[len(k) :]]
    met = held.join(asked, same & (then[0] >= now[0] - us) & (F.struct(*then) <= F.struct(*now)))
    windows = met.groupBy(*mine).agg(F.sort_array(F.collect_list(F.struct(*then, *[f"{n}_x" for n in values]))).alias("__w"))
    plain = {n: _plain(F.filter(F.col("__w")[f"{n}_x"], lambda x: x.isNotNull())) for n in values}
    decided = windows.select(*mine, still(*plain["__f"], plain["__g"][0] if rate_norm else None).alias("__plain"))
    again = F.col("__near")
    for c, x in zip(at, mine, strict=True):
        again = again & F.col(c).eqNullSafe(x)
    return rows.join(decided, again, "left").select(*df.columns, F.coalesce("__plain", "__still").alias("stationary"))


# Propagation


def mechanize(df: DataFrame, key, order: list[str], t: str, accel: str, max_step_s: float = P.MAX_INTEGRATION_STEP_S) -> DataFrame:
    """Velocity and position by the trapezoid rule, from rest, along one axis whose acceleration is known in navigation axes.

    A step that isn't positive, or longer than max_step_s, or whose acceleration is missing, holds velocity and position; the step after it uses its own
    acceleration for both ends, as does the first. So both states are prefix sums, and no row-by-row scan is needed.
    """
    w = _rows(key, order)
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = df.withColumn("__dt", (F.col(t) - F.lag(t).over(w)) / US)
    rows = rows.withColumn("__ok", F.coalesce((F.col("__dt") > 0) & (F.col("__dt") <= max_step_s) & F.col(accel).isNotNull(), F.lit(False)))
    rows = rows.withColumn("__before", F.when(F.lag("__ok").over(w), F.lag(accel).over(w)).otherwise(F.col(accel)))
    rows = rows.withColumn("__dv", F.when(F.col("__ok"), (F.col("__before") + F.col(accel)) / 2 * F.col("__dt")).otherwise(0.0))
    rows = rows.withColumn("velocity", F.sum("__dv").over(upto))
    rows = rows.withColumn("__dp", F.when(F.col("__ok"), (F.col("velocity") - F.col("__dv") / 2) * F.col("__dt")).otherwise(0.0))
    rows = rows.withColumn("position", F.sum("__dp").over(upto)).withColumn("held", ~F.col("__ok"))
    return rows.drop("__dt", "__ok", "__before", "__dv", "__dp")
