"""Faulty readings of measured channels: impossible values, stuck runs and spikes, judged by each source's own behaviour.

A source's readings are split into time buckets, so that no task holds a source; every bucket gets the few readings and
the run lengths that border it, which makes the result independent of where buckets end.

1. Per source: a seasonal profile, the mean reading of each hour of the day inside the limits.
2. Per bucket: readings less the season, interpolated between the middles of hours; their residuals from a running median
   of nine, as a log-scaled histogram that merges by addition, and the bucket's edges. Residuals of readings near an edge
   are made where the readings beyond it are known.
3. Per source: the usual scatter (deviation of residuals, those over their 97 % quantile set to it) and the tail cutoff by
   peaks over threshold: a generalised Pareto fit to the residuals over their 98 % quantile, at a fixed risk per reading.
4. Per bucket again: `impossible` outside the physical limits; `stuck` in a run of at least 30 equal readings (a fan at 0
   is off); `spike` for runs of one to three readings whose seasonal residuals, from the levels just before and just after,
   are all over the tail cutoff. What the cutoff finds is confirmed if the readings leave both levels by more than ten times
   the scatter, which is the stated meaning of a spike. Of several defects of a reading the first holds.

Readings that are null or NaN are missing. Each sample_id counts once, as its earliest row. Rows without rig, gpu, ts or
sample_id belong to no source. Equal times are taken in the order of sample_id. A channel without limits has none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunemill.session import settle, small

CHANNELS = ("junction_c", "power_w", "fan1_rpm")
LEVEL = 5
LONGEST_SPIKE = 3
EDGE = LEVEL + LONGEST_SPIKE + 1
#: Readings on either side that a running median takes.
HALF = LEVEL - 1
HOUR, HOURS = 3_600_000_000, 24


@dataclass(frozen=True)
class FaultCfg:
    stuck: int = 30
    times_scatter: float = 10.0
    #: Chance, per reading, that normal behaviour exceeds the tail cutoff.
    risk: float = 1e-5
    tail: float = 0.98
    usual: float = 0.97
    #: Bounds of the shape of the fitted tail.
    shapes: tuple[float, float] = (-0.4, 0.2)
    bucket_rows: int = 32_768
    fans: tuple[str, ...] = ("fan1_rpm", "fan2_rpm")


#: Bins of |residual|: bin 0 holds zeros, bin k the values from _LOW * 2 ** ((k - 1) / 16).
_LOW, _BINS = 1e-6, 800


def _bin(r: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        k = np.floor(16 * np.log2(r / _LOW)) + 1
    return np.where(r < _LOW, 0, np.clip(k, 1, _BINS)).astype(np.int64)


def _runs(v: np.ndarray) -> np.ndarray:
    """For each reading, the number of the run of equal readings it is in."""
    return np.concatenate([[0], np.cumsum(v[1:] != v[:-1])]) if len(v) else np.empty(0, np.int64)


def _ordered(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["ts", "sample_id"], kind="stable").drop_duplicates("sample_id")


def _level_ok(v: np.ndarray, channel: str, limits: dict, cfg: FaultCfg) -> np.ndarray:
    lo, hi = limits.get(channel, (-np.inf, np.inf))
    return (v >= lo) & (v <= hi) & ~((v == 0) & (channel in cfg.fans))


def _season(ts: np.ndarray, profile) -> np.ndarray:
    """The seasonal part at each time (in microseconds): the profile of a day, interpolated between the middles of hours."""
    hours = np.asarray(profile, float)
    hour = (ts / HOUR - 0.5) % HOURS
    k = np.floor(hour).astype(np.int64)
    return hours[k % HOURS] + (hour - k) * (hours[(k + 1) % HOURS] - hours[k % HOURS])


def _residuals(z: np.ndarray) -> np.ndarray:
    return np.abs(z - pd.Series(z).rolling(2 * HALF + 1, center=True, min_periods=1).median().to_numpy())


def _counts(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of residuals, their counts and their sums of squares."""
    bins, at, counts = np.unique(_bin(r), return_inverse=True, return_counts=True)
    return bins, counts, np.bincount(at, weights=r * r, minlength=len(bins))


def _first_pass(limits: dict, cfg: FaultCfg):
    def run(key: tuple, rows: pd.DataFrame, seasons: pd.DataFrame) -> pd.DataFrame:
        rows, out = _ordered(rows), []
        if not len(rows):
            return pd.DataFrame(out, columns=_FIRST_NAMES)
        for channel in CHANNELS:
            v = rows[channel].to_numpy(float)
            there = ~np.isnan(v)
            v, ts = v[there], rows["ts"].to_numpy()[there]
            if not len(v):
                continue
            ok = _level_ok(v, channel, limits, cfg)
            y = v[ok]
            z = y - _season(ts[ok], seasons[channel].iloc[0])
            bins, counts, squares = _counts(_residuals(z)[HALF:-HALF])
            run_no = _runs(v)
            size = np.bincount(run_no)
            out.append((*key, channel, bins, counts, squares, y[:EDGE], y[-EDGE:], z[:EDGE], z[-EDGE:], len(y), len(size) == 1, v[0], size[0], v[-1], size[-1]))
        return pd.DataFrame(out, columns=_FIRST_NAMES)

    return run


_FIRST = "rig string, gpu int, bucket bigint, channel string, bins array<bigint>, counts array<bigint>, squares array<double>, head array<double>, tail array<double>, head_z array<double>, tail_z array<double>, n bigint, one_run boolean, first_value double, first_run bigint, last_value double, last_run bigint"
_FIRST_NAMES = [c.split()[0] for c in _FIRST.split(", ")]


def _fit(cfg: FaultCfg):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Scatter and tail cutoff from the histogram of one source and channel."""
        rows = rows.sort_values("bin")
        b, n, squares = rows["bin"].to_numpy(), rows["n"].to_numpy(float), rows["squares"].to_numpy(float)
        r = np.where(b == 0, 0.0, _LOW * 2.0 ** ((b - 0.5) / 16))
        total = n.sum()
        share = np.cumsum(n) / total
        at = lambda p: min(int(np.searchsorted(share, p)), len(r) - 1)
        k = at(cfg.usual)
        scatter = float(np.sqrt((squares[: k + 1].sum() + n[k + 1 :].sum() * squares[k] / n[k]) / total))
        u = r[at(cfg.tail)]
        # Faults are what the fit must not follow: what exceeds ten times the scatter is left out of it.
        peak = (r > u) & (r <= cfg.times_scatter * scatter)
        over, w = r[peak] - u, n[peak]
        cutoff = cfg.times_scatter * scatter
        if w.sum() >= 10:
            mean = (over * w).sum() / w.sum()
            var = ((over - mean) ** 2 * w).sum() / w.sum()
            if var > 0:
                shape = float(np.clip(0.5 * (1 - mean**2 / var), *cfg.shapes))
                scale = mean * (1 - shape)
                odds = cfg.risk * total / w.sum()
                cutoff = float(u + (scale * np.log(1 / odds) if abs(shape) < 1e-6 else scale / shape * (odds**-shape - 1)))
        return pd.DataFrame([(*key, int(total), scatter, cutoff)], columns=["rig", "gpu", "channel", "readings", "scatter", "tail_cutoff"])

    return run


def _borders():
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """For each bucket of a source and channel: the readings and run lengths that border it, and the residuals that its
        own readings could not give, those within HALF readings of its ends. Holds edges only."""
        rows = rows.sort_values("bucket").reset_index(drop=True)
        n = len(rows)
        before, after = [], [()] * n
        carry_in, carry_out = [], [(np.nan, 0)] * n
        edge, edge_z = np.empty(0), np.empty(0)
        run_value, run_size = np.nan, 0
        for r in rows.itertuples():
            before.append((edge, edge_z))
            carry_in.append((run_value, run_size))
            edge, edge_z = np.concatenate([edge, r.tail])[-EDGE:], np.concatenate([edge_z, r.tail_z])[-EDGE:]
            run_size = r.last_run + (run_size if r.one_run and r.first_value == run_value else 0)
            run_value = r.last_value
        edge, edge_z, run_value, run_size = np.empty(0), np.empty(0), np.nan, 0
        made = [()] * n
        for i in range(n - 1, -1, -1):
            r = rows.iloc[i]
            after[i], carry_out[i] = (edge, edge_z), (run_value, run_size)
            made[i] = _counts(_edge_residuals(before[i][1], r["head_z"], r["tail_z"], int(r["n"]), edge_z))
            edge, edge_z = np.concatenate([r["head"], edge])[:EDGE], np.concatenate([r["head_z"], edge_z])[:EDGE]
            run_size = r["first_run"] + (run_size if r["one_run"] and r["last_value"] == run_value else 0)
            run_value = r["first_value"]
        out = {"rig": key[0], "gpu": key[1], "bucket": rows["bucket"], "channel": key[2]}
        out |= {"before": [y for y, _ in before], "after": [y for y, _ in after], "before_z": [z for _, z in before], "after_z": [z for _, z in after]}
        out |= {"in_value": [v for v, _ in carry_in], "in_run": [s for _, s in carry_in], "out_value": [v for v, _ in carry_out], "out_run": [s for _, s in carry_out]}
        return pd.DataFrame(out | {"bins": [b for b, _, _ in made], "counts": [c for _, c, _ in made], "squares": [q for *_, q in made]})

    return run


def _edge_residuals(before: np.ndarray, head: np.ndarray, tail: np.ndarray, n: int, after: np.ndarray) -> np.ndarray:
    """Residuals of the first and last HALF readings of a bucket of n, each once, with the readings beyond its ends."""
    head, tail = np.asarray(head, float), np.asarray(tail, float)
    if n <= EDGE:
        own = _residuals(np.concatenate([before, head, after]))[len(before) : len(before) + n]
        return own if n <= 2 * HALF else np.concatenate([own[:HALF], own[-HALF:]])
    first = _residuals(np.concatenate([before, head]))[len(before) : len(before) + HALF]
    last = _residuals(np.concatenate([tail, after]))[len(tail) - HALF : len(tail)]
    return np.concatenate([first, last])


_BORDERS = "rig string, gpu int, bucket bigint, channel string, before array<double>, after array<double>, before_z array<double>, after_z array<double>, in_value double, in_run bigint, out_value double, out_run bigint, bins array<bigint>, counts array<bigint>, squares array<double>"


def _medians(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the LEVEL readings before each position, and of those from it on; for positions 0 to len(y)."""
    pad = np.full(LEVEL, np.nan)
    wide = np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, y, pad]), LEVEL)
    with np.errstate(all="ignore"):
        import warnings

        with warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)
            mid = np.median(wide, axis=1)
            holes = np.isnan(mid)
            mid[holes] = np.nanmedian(wide[holes], axis=1)
    return mid[: len(y) + 1], mid[LEVEL:]


def spikes(y: np.ndarray, limit: float, z: np.ndarray | None = None, cutoff: float = 0.0) -> np.ndarray:
    """Which readings of y are in a run of one to LONGEST_SPIKE that the tail cutoff finds and the limit confirms.

    Found: each reading of the run is over the cutoff from the levels before and after it in z, the readings less their
    season (y itself if not given). Confirmed: each leaves both levels in y by more than limit, and the readings beside the
    run don't.
    """
    hit, n = np.zeros(len(y), bool), len(y)
    if n < 3:
        return hit
    z = y if z is None else z
    (before, after), (calm_before, calm_after) = _medians(z), _medians(y)

    def off(x: np.ndarray, i: np.ndarray, size: int, b: np.ndarray, a: np.ndarray) -> np.ndarray:
        run = x[i[:, None] + np.arange(size)]
        up, down = run - np.maximum(a, b)[:, None], np.minimum(a, b)[:, None] - run
        return np.maximum(up, down).min(axis=1)  # each reading on a side of its own

    far = np.flatnonzero(np.abs(z - before[:n]) > cutoff)
    for size in range(1, LONGEST_SPIKE + 1):
        i = far[(far >= 1) & (far + size < n)]
        i = i[off(z, i, size, before[i], after[i + size]) > cutoff]
        b, a = calm_before[i], calm_after[i + size]
        calm = (np.abs(y[i - 1] - b) <= limit) & (np.abs(y[i + size] - a) <= limit)
        for s in i[calm & (off(y, i, size, b, a) > limit)]:
            hit[s : s + size] = True
    return hit


def _label(limits: dict, cfg: FaultCfg):
    def run(key: tuple, rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        rows, out = _ordered(rows), []
        for k in known.itertuples():
            v = rows[k.channel].to_numpy(float)
            there = ~np.isnan(v)
            v, ids, ts = v[there], rows["sample_id"].to_numpy()[there], rows["ts"].to_numpy()[there]
            if not len(v):
                continue
            fan = k.channel in cfg.fans
            lo, hi = limits.get(k.channel, (-np.inf, np.inf))
            kind = np.full(len(v), "", object)
            ok = _level_ok(v, k.channel, limits, cfg)
            y = v[ok]
            z = y - _season(ts[ok], k.profile)
            whole = lambda before, own, after: np.concatenate([np.asarray(before, float), own, np.asarray(after, float)])
            hit = spikes(whole(k.before, y, k.after), cfg.times_scatter * k.scatter, whole(k.before_z, z, k.after_z), k.tail_cutoff)
            kind[np.flatnonzero(ok)[hit[len(k.before) : len(k.before) + len(y)]]] = "spike"
            run_no = _runs(v)
            size = np.bincount(run_no)
            size[0] += k.in_run if v[0] == k.in_value else 0
            size[-1] += k.out_run if v[-1] == k.out_value else 0
            kind[(size[run_no] >= cfg.stuck) & ~(fan & (v == 0))] = "stuck"
            kind[(v < lo) | (v > hi)] = "impossible"
            bad = kind != ""
            out.append(pd.DataFrame({"sample_id": ids[bad], "channel": k.channel, "defect": kind[bad]}))
        return pd.concat(out) if out else pd.DataFrame({"sample_id": np.empty(0, np.int64), "channel": np.empty(0, object), "defect": np.empty(0, object)})

    return run


class Faults:
    """The stages over one table; cutoffs and labels share them. Making one runs jobs: the first pass is settled."""

    def __init__(self, soak: DataFrame, sensor_limit: DataFrame, cfg: FaultCfg = FaultCfg()):
        self.cfg = cfg
        # A row for each channel that is asked for: at most three.
        asked = sensor_limit.where(F.col("channel").isin(*CHANNELS)).groupBy("channel").agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))
        self.limits = {r.channel: (-np.inf if r.lo is None else r.lo, np.inf if r.hi is None else r.hi) for r in asked.collect()}
        rows = soak.select("sample_id", F.col("rig").cast("string").alias("rig"), F.col("gpu").cast("int").alias("gpu"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), *(F.col(c).cast("double").alias(c) for c in CHANNELS)).dropna(subset=["sample_id", "rig", "gpu", "ts"])
        self.sources = settle(self._sources(rows))
        wide = small(self.sources.select("rig", "gpu", "width"))
        self.rows = rows.join(wide, ["rig", "gpu"]).withColumn("bucket", F.floor(F.col("ts") / F.col("width"))).drop("width")
        buckets = settle(self.rows.select("rig", "gpu", "bucket").distinct())
        seasons = buckets.join(small(self.sources.drop("width")), ["rig", "gpu"])
        keys = ["rig", "gpu", "bucket"]
        self.first = settle(self.rows.groupBy(*keys).cogroup(seasons.groupBy(*keys)).applyInPandas(_first_pass(self.limits, cfg), _FIRST))

    def _sources(self, rows: DataFrame) -> DataFrame:
        """(rig, gpu, width, a profile for each channel): a bucket's microseconds from the source's densest hour of history,
        and the means of the hours of the day; an hour without readings has the mean of all."""
        hours = rows.withColumn("_hour", F.floor(F.col("ts") / HOUR)).groupBy("rig", "gpu", "_hour")
        sums = []
        for c in CHANNELS:
            lo, hi = self.limits.get(c, (-np.inf, np.inf))
            fits = F.col(c).between(float(lo), float(hi)) & ~F.isnan(c) & ~((F.col(c) == 0) & F.lit(c in self.cfg.fans))
            sums += [F.sum(F.when(fits, F.col(c))).alias(f"_s_{c}"), F.count_if(fits).alias(f"_n_{c}")]
        per = hours.agg(F.count("*").alias("_n"), *sums).groupBy("rig", "gpu", F.pmod("_hour", F.lit(HOURS)).alias("_h"))
        slots = per.agg(F.max("_n").alias("_n"), *(F.sum(x).alias(x) for c in CHANNELS for x in (f"_s_{c}", f"_n_{c}")))
        means = [F.map_from_entries(F.collect_list(F.struct("_h", F.try_divide(f"_s_{c}", f"_n_{c}")))).alias(f"_m_{c}") for c in CHANNELS]
        every = [F.coalesce(F.try_divide(F.sum(f"_s_{c}"), F.sum(f"_n_{c}")), F.lit(0.0)).alias(f"_a_{c}") for c in CHANNELS]
        one = slots.groupBy("rig", "gpu").agg(F.max("_n").alias("_most"), *means, *every)
        day = F.sequence(F.lit(0).cast("bigint"), F.lit(HOURS - 1).cast("bigint"))

        def profile(c: str) -> Column:
            return F.transform(day, lambda h: F.coalesce(F.try_element_at(F.col(f"_m_{c}"), h), F.col(f"_a_{c}"))).alias(c)

        return one.select("rig", "gpu", F.greatest(F.lit(1_000_000), F.floor(F.lit(HOUR * self.cfg.bucket_rows) / F.col("_most"))).alias("width"), *map(profile, CHANNELS))

    def _bordered(self) -> DataFrame:
        return self.first.drop("bins", "counts", "squares").groupBy("rig", "gpu", "channel").applyInPandas(_borders(), _BORDERS)

    def _fitted(self, borders: DataFrame) -> DataFrame:
        three = F.explode(F.arrays_zip("bins", "counts", "squares")).alias("x")
        bins = self.first.select("rig", "gpu", "channel", three).unionByName(borders.select("rig", "gpu", "channel", three))
        merged = bins.groupBy("rig", "gpu", "channel", F.col("x.bins").alias("bin")).agg(F.sum("x.counts").alias("n"), F.sum("x.squares").alias("squares"))
        return merged.groupBy("rig", "gpu", "channel").applyInPandas(_fit(self.cfg), "rig string, gpu int, channel string, readings bigint, scatter double, tail_cutoff double")

    def cutoffs(self) -> DataFrame:
        """(rig, gpu, channel, readings, scatter, tail_cutoff)"""
        return self._fitted(self._bordered())

    def labels(self) -> DataFrame:
        """(sample_id, channel, defect)"""
        borders = settle(self._bordered())
        known = borders.drop("bins", "counts", "squares").join(self._fitted(borders).drop("readings"), ["rig", "gpu", "channel"], "left").na.fill({"scatter": 0.0, "tail_cutoff": 0.0})
        profiles = self.sources.select("rig", "gpu", F.explode(F.map_from_arrays(F.array(*map(F.lit, CHANNELS)), F.array(*CHANNELS))).alias("channel", "profile"))
        known = known.join(small(settle(profiles)), ["rig", "gpu", "channel"])
        keys = ["rig", "gpu", "bucket"]
        return self.rows.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInPandas(_label(self.limits, self.cfg), "sample_id bigint, channel string, defect string")
