"""Logged channels: gradients, steady states, onsets, grids, interpolation, interval algebra.

Missing is null throughout; NaN becomes null at the scan (`clean`). An absent channel is resolved when the plan is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tunemill.operators.ordered import paced, running_total, with_neighbours

#: The column of the bucket that a history is split by, as dense as its rows.
PACE = "_tm_pace"

#: Steadiness, knock and grid thresholds.
STEADY = {"rpm": 100.0, "tps": 2.0}
ONSET_STEP, SPIKE_FLOOR, MIN_SAMPLES, CLOSED_LOOP = 1.5, -20.0, 20, 8.0


def clean(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN is missing."""
    return df.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns})


def gradient(x: str) -> Column:
    """Half the difference of both neighbours, one-sided at the ends; needs prev_, next_, is_first and is_last."""
    v, p, n = F.col(x), F.col(f"prev_{x}"), F.col(f"next_{x}")
    return F.when(F.col("is_first") & F.col("is_last"), F.lit(0.0)).when(F.col("is_first"), n - v).when(F.col("is_last"), v - p).otherwise((n - p) / 2)


def with_gradients(log: DataFrame, keys: list[str], order: list[str], ts: str, channels: list[str]) -> DataFrame:
    near = with_neighbours(paced(log, keys, ts, PACE), keys, order, F.col(PACE), channels).drop(PACE)
    near = near.withColumns({f"d_{c}": gradient(c) for c in channels})
    return near.drop(*(f"{s}_{c}" for s in ("prev", "next") for c in channels), "is_first", "is_last")


def steady(log: DataFrame, status: str | None = None) -> Column:
    """Is each gradient there small enough, and the loop closed? A channel that isn't there doesn't ask; a missing value is no."""
    ok = F.lit(True)
    for c, most in STEADY.items():
        if f"d_{c}" in log.columns:
            ok = ok & F.coalesce(F.abs(f"d_{c}") <= most, F.lit(False))
    return ok & F.coalesce(F.col(status) == CLOSED_LOOP, F.lit(False)) if status else ok


def despiked(knock: str) -> Column:
    return F.when(F.col(knock) >= SPIKE_FLOOR, F.col(knock))


def onsets(log: DataFrame, keys: list[str], order: list[str], ts: str, knock: str) -> DataFrame:
    """(keys..., onsets, worst): steps down between neighbouring present readings, spikes left out."""
    finite = log.withColumn(knock, despiked(knock)).where(F.col(knock).isNotNull())
    near = with_neighbours(paced(finite, keys, ts, PACE), keys, order, F.col(PACE), [knock])
    return near.groupBy(*keys).agg(F.count_if(F.col(knock) - F.col(f"prev_{knock}") <= -ONSET_STEP).alias("onsets"), F.min(knock).alias("worst"))


def nearest(x: Column, breaks: list[float]) -> Column:
    """Index of the closest break, the lower one of two; null for null."""
    d = F.transform(F.array(*map(F.lit, breaks)), lambda b: F.abs(x - b))
    return F.when(x.isNotNull(), (F.array_position(d, F.array_min(d)) - 1).cast("int"))


def at_or_above(x: Column, breaks: list[float]) -> Column:
    """Index of the highest break that x reaches, within a relative millionth; null below the lowest."""
    arr = F.array(*map(F.lit, breaks))
    n = F.size(F.filter(arr, lambda b: x >= b - F.greatest(F.abs(b) * 1e-6, F.lit(1e-9))))
    return F.when(x.isNotNull() & (n > 0), (n - 1).cast("int"))


def grid_bin(log: DataFrame, keys: list[str], x: str, y: str, xs: list[float], ys: list[float], zero_filled: list[str], means: list[str], min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Cells of the whole grid for each key: count, mean_c and confidence.

    zero_filled channels count a missing value as 0; means skip it. Samples without x or y are left out; samples beyond an
    axis go to its edge; an empty cell has null means.
    """
    cells = log.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("xi", nearest(F.col(x), xs)).withColumn("yi", nearest(F.col(y), ys))
    aggs = [(F.sum(F.coalesce(c, F.lit(0.0))) / F.count("*")).alias(f"mean_{c}") for c in zero_filled] + [F.avg(c).alias(f"mean_{c}") for c in means]
    got = cells.groupBy(*keys, "yi", "xi").agg(F.count("*").alias("count"), *aggs)
    spread = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(ys) - 1)), lambda j: F.transform(F.sequence(F.lit(0), F.lit(len(xs) - 1)), lambda i: F.struct(j.alias("yi"), i.alias("xi"))))))
    full = log.select(*keys).distinct().withColumn("_c", spread).select(*keys, F.col("_c.yi").alias("yi"), F.col("_c.xi").alias("xi"))
    return full.join(got, [*keys, "yi", "xi"], "left").withColumn("count", F.coalesce("count", F.lit(0))).withColumn("confident", F.col("count") >= min_samples)


def weighted_mean(value: str, weight: str, sure: str) -> Column:
    """Weighted over the confident rows; over all sampled ones if there are none; else 0."""
    def over(cond: Column) -> Column:
        ok = cond & F.col(value).isNotNull() & (F.col(weight) > 0)
        return F.try_divide(F.sum(F.when(ok, F.col(value) * F.col(weight))), F.sum(F.when(ok, F.col(weight))))

    return F.coalesce(over(F.col(sure)), over(F.lit(True)), F.lit(0.0))


def interpolated(cells: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """Gaps between anchors filled linearly by index, 0 outside their span. A grid row is short, so one window holds it."""
    back = Window.partitionBy(*keys).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(index).rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(index))
    v0, v1 = F.last(value, True).over(back), F.first(value, True).over(ahead)
    i0, i1 = F.last(at, True).over(back), F.first(at, True).over(ahead)
    blend = F.when(i1 == i0, v0).otherwise(v0 + (v1 - v0) * (F.col(index) - i0) / (i1 - i0))
    return cells.withColumn("filled", F.coalesce(blend, F.lit(0.0)))


def interp(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear through the points, clamped at the ends; a falling axis is read backwards."""
    if xs[0] > xs[-1]:
        xs, ys = xs[::-1], ys[::-1]
    out = F.when(x <= xs[0], F.lit(float(ys[0])))
    for a, b, p, q in zip(xs, xs[1:], ys, ys[1:]):
        out = out.when(x <= b, F.lit(float(p)) + (x - a) * (q - p) / (b - a))
    return F.when(x.isNotNull(), out.otherwise(F.lit(float(ys[-1]))))


def range_histogram(log: DataFrame, keys: list[str], x: str, edges: list[float], companions: list[str], min_count: int = 40) -> DataFrame:
    """Half-open ranges [lo, hi) with at least min_count samples, and the means of other channels in them."""
    b = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        b = F.when((F.col(x) >= edges[i]) & (F.col(x) < edges[i + 1]), F.lit(i)).otherwise(b)
    got = log.withColumn("bin", b).where(F.col("bin").isNotNull()).groupBy(*keys, "bin")
    return got.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in companions)).where(F.col("n") >= min_count)


def sample_hz(log: DataFrame, keys: list[str], order: list[str], ts: str) -> DataFrame:
    """Rate by the median of time steps; null for a single sample or a median of 0."""
    rows = log.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")) / 1e6)
    near = with_neighbours(paced(rows, keys, ts, PACE), keys, order, F.col(PACE), ["_t"])
    # Steps of a log repeat, so that the median is taken over counted steps.
    steps = near.groupBy(*keys, F.round(F.col("_t") - F.col("prev__t"), 6).alias("_step")).agg(F.count("*").alias("_n"))
    return steps.groupBy(*keys).agg(F.try_divide(F.lit(1.0), F.round(F.percentile("_step", 0.5, F.col("_n")), 6)).alias("hz"))


def trailing_run(rows: DataFrame, keys: list[str], order: list[str], ok: Column) -> DataFrame:
    """How many rows at the end of each history satisfy ok in a row."""
    last_bad = F.max(F.when(~F.coalesce(ok, F.lit(False)), F.struct(*order)))
    bad = rows.groupBy(*keys).agg(last_bad.alias("_bad"))
    joined = rows.join(bad, keys)
    return joined.groupBy(*keys).agg(F.count_if(F.col("_bad").isNull() | (F.struct(*order) > F.col("_bad"))).alias("trailing"))


def merged_intervals(rows: DataFrame, keys: list[str], lo: str, hi: str, bucket: Column) -> DataFrame:
    """Unions of intervals that overlap or touch, for each key: (keys..., lo, hi, n).

    The running maximum of hi is taken within buckets of lo and carried over their borders.
    """
    from tunemill.operators.ordered import B, _along, _inside, _joined

    r = rows.where(F.col(lo).isNotNull() & F.col(hi).isNotNull()).select(*keys, F.col(lo).alias("lo"), F.col(hi).alias("hi")).groupBy(*keys, "lo", "hi").agg(F.count("*").alias("n"))
    r = r.withColumn(B, bucket)
    tops = r.groupBy(*keys, B).agg(F.max("hi").alias("_h"))
    tops = tops.select(*keys, B, F.max("_h").over(_along(keys).rowsBetween(Window.unboundedPreceding, -1)).alias("_tm_h"))
    inner = r.withColumn("_tm_i", F.max("hi").over(_inside(keys, ["lo", "hi"]).rowsBetween(Window.unboundedPreceding, -1)))
    reach = F.greatest("_tm_i", "_tm_h")
    starts = _joined(inner, tops, keys).withColumn("_tm_s", F.when(reach.isNull() | (F.col("lo") > reach), 1).otherwise(0)).withColumn("_tm_b", F.col(B)).drop(B)
    islands = running_total(starts, keys, ["lo", "hi"], F.col("_tm_b"), F.col("_tm_s"), "_tm_island")
    return islands.groupBy(*keys, "_tm_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).drop("_tm_island")


def pooled(logs: list[DataFrame]) -> DataFrame:
    """Logs of different channels as one table; what a log doesn't have is null."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log, allowMissingColumns=True)
    return out


#: Fixed value: how far a hold's voltage may be from the warm hold's to count as charging.
CHARGING = 0.6


def observations(holds: DataFrame, keys: list[str], order: str, baseline: tuple[list[float], list[float]], maf_term: bool = True) -> DataFrame:
    """holds(keys..., order, maf, rpm, volts, trim in percent: means of a hold) with air_scale, nominal and trim_fraction.

    The first hold of each key is the warm one: air scales are relative to its airflow, and only holds that charge as it does
    have a nominal airflow, the baseline's at their speed. Keys without a usable airflow in the warm hold give no rows.
    """
    warm = holds.groupBy(*keys).agg(F.min_by(F.struct("maf", "volts"), order).alias("_warm"))
    rows = holds.join(warm, keys).where(F.col("_warm.maf") > 0)
    charging = F.abs(F.col("volts") - F.col("_warm.volts")) <= CHARGING
    nominal = F.when(charging, interp(F.col("rpm"), *baseline)) if maf_term else F.lit(None).cast("double")
    return rows.withColumn("air_scale", F.col("maf") / F.col("_warm.maf")).withColumn("nominal", nominal).withColumn("trim_fraction", F.col("trim") / 100).drop("_warm")


def airflow_ratio(observed: DataFrame, keys: list[str], validated: str) -> DataFrame:
    """(keys..., ratio, validated): the mean of read over nominal airflow of the holds that have one, null without any, and
    whether all of them say that the baseline is validated (true without any)."""
    has = F.col("maf").isNotNull() & ~F.isnan("maf") & (F.col("nominal") != 0)
    return observed.groupBy(*keys).agg(F.avg(F.when(has, F.col("maf") / F.col("nominal"))).alias("ratio"), F.coalesce(F.bool_and(F.when(has, F.col(validated))), F.lit(True)).alias("validated"))
