"""The mean-value engine model in closed form, synthetic logs and worlds, rule baselines, and the single-fault estimator."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunemill.operators.calibration import pi_step

#: The model's constants, the probe points (air, volts), search bounds and thresholds.
AFR, DENSITY, IDLE_AIR, SLOPE, V_REF = 14.7, 0.74, 0.10, 0.12, 14.0
K = DENSITY / 60_000
PROBES = ((1.0, 14.0), (2.0, 14.0), (1.0, 12.0))
BOUNDS = {"maf_low": (0.70, 0.999), "maf_high": (1.001, 1.40), "injector_flow_lean": (1.001, 1.40), "injector_flow_rich": (0.70, 0.999), "injector_latency_lean": (0.50, 0.999), "vacuum_leak": (1e-4, 0.10)}
KNOB = {"maf_low": "maf", "maf_high": "maf", "injector_flow_lean": "flow", "injector_flow_rich": "flow", "injector_latency_lean": "latency", "vacuum_leak": None, "healthy": None}
WORST, MARGIN = 0.02**2 * 3, 1.5


def trim(flow_b, lat_b, maf_b, flow_t, lat_t, maf_t, leak, air, volts, xp=np):
    """Steady trim as a fraction, for arrays (xp is numpy) or, in `trim_column`, for columns."""
    dv = xp.maximum(0.0, V_REF - volts)
    pw = IDLE_AIR * air * maf_b / maf_t / AFR / (flow_b * K) + lat_b + SLOPE * lat_b / lat_t * dv
    delivered = xp.maximum(0.0, pw - (lat_t + SLOPE * dv)) * flow_t * K
    with np.errstate(divide="ignore", invalid="ignore"):
        return xp.where(delivered > 0, (IDLE_AIR * air + leak) / AFR / delivered - 1, 1.0)


def trim_column(flow_b: Column, lat_b: Column, maf_b: Column, flow_t: Column, lat_t: Column, maf_t: Column, leak: Column, air: Column, volts: Column) -> Column:
    dv = F.greatest(F.lit(0.0), V_REF - volts)
    pw = IDLE_AIR * air * maf_b / maf_t / AFR / (flow_b * K) + lat_b + SLOPE * lat_b / lat_t * dv
    delivered = F.greatest(F.lit(0.0), pw - (lat_t + SLOPE * dv)) * flow_t * K
    return F.when(delivered > 0, (IDLE_AIR * air + leak) / AFR / delivered - 1).otherwise(1.0)


def _predicted(fault: str, size: np.ndarray, believed: dict[str, np.ndarray]) -> np.ndarray:
    """Trims at the probe points, one row for each world, if only `fault` of that size is there."""
    truth = {k: v.copy() for k, v in believed.items()}
    leak = np.zeros(len(size))
    if fault == "vacuum_leak":
        leak = size
    elif KNOB[fault]:
        truth[KNOB[fault]] = believed[KNOB[fault]] / size
    return np.stack([trim(believed["flow"], believed["latency"], believed["maf"], truth["flow"], truth["latency"], truth["maf"], leak, a, v) for a, v in PROBES], axis=1)


def _squares(fault: str, size: np.ndarray, believed: dict, seen: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    out = np.nansum((_predicted(fault, size, believed) - seen) ** 2, axis=1)
    expected = size if KNOB.get(fault) == "maf" else 1.0
    return out + np.where(np.isnan(ratio), 0.0, (expected - np.nan_to_num(ratio)) ** 2)


def _fit(fault: str, believed: dict, seen: np.ndarray, ratio: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Best size and sum of squares for each world: a golden-section search over all worlds at once."""
    n = len(seen)
    if fault == "healthy":
        return np.zeros(n), _squares(fault, np.ones(n), believed, seen, ratio)
    lo, hi = (np.full(n, x) for x in BOUNDS[fault])
    g = (5**0.5 - 1) / 2
    c, d = hi - g * (hi - lo), lo + g * (hi - lo)
    fc, fd = (_squares(fault, x, believed, seen, ratio) for x in (c, d))
    for _ in range(rounds):
        left = fc < fd
        hi, lo = np.where(left, d, hi), np.where(left, lo, c)
        c2, d2 = hi - g * (hi - lo), lo + g * (hi - lo)
        fresh = np.where(left, c2, d2)
        ff = _squares(fault, fresh, believed, seen, ratio)
        c, d, fc, fd = np.where(left, fresh, d), np.where(left, c, fresh), np.where(left, ff, fd), np.where(left, fc, ff)
    best = (lo + hi) / 2
    return best, _squares(fault, best, believed, seen, ratio)


def _measured(b: pd.DataFrame) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    """Fits by fault, what was seen, the measured ratio and whether its baseline is validated, of a batch of worlds."""
    believed = {k: b[k].to_numpy(float) for k in ("flow", "latency", "maf")}
    seen, measured = b[["t0", "t1", "t2"]].to_numpy(float), b["maf_ratio"].to_numpy(float)
    valid = b["validated"].fillna(False).to_numpy(bool)
    return {f: _fit(f, believed, seen, np.where(valid, measured, np.nan)) for f in KNOB}, seen, measured, valid


def hypotheses(worlds: DataFrame, key: str) -> DataFrame:
    """(key, rank, fault, knob, size, squares): every fault as an explanation of each world, by its sum of squares; of equals
    in the order of the faults."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fits, *_ = _measured(b)
            names = list(fits)
            sse = np.stack([fits[f][1] for f in names], axis=1)
            order = np.argsort(sse, axis=1, kind="stable")
            rows = [(k, r + 1, names[j], KNOB[names[j]], float(fits[names[j]][0][i]), float(sse[i, j])) for i, k in enumerate(b[key]) for r, j in enumerate(order[i])]
            yield pd.DataFrame(rows, columns=[key, "rank", "fault", "knob", "size", "squares"])

    return worlds.mapInPandas(run, f"{key} {worlds.schema[key].dataType.simpleString()}, rank int, fault string, knob string, size double, squares double")


def estimates(worlds: DataFrame, key: str) -> DataFrame:
    """(key, fault, size, margin, reason) for worlds(key, flow, latency, maf, t0, t1, t2, maf_ratio, validated).

    t0 to t2 are measured trims at the probe points, null where one is missing; maf_ratio is reported over nominal airflow
    and counts only against a validated baseline. fault is null with the reason where nothing is identified.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fits, seen, measured, valid = _measured(b)
            names = list(fits)
            sse = np.stack([fits[f][1] for f in names], axis=1)
            order = np.argsort(sse, axis=1, kind="stable")
            rows = []
            for i in range(len(b)):
                best = names[order[i, 0]]
                rival = next(sse[i, j] for j in order[i, 1:] if KNOB[names[j]] != KNOB[best] or (KNOB[best] is None and names[j] != best))
                margin = float(rival / max(sse[i, order[i, 0]], 1e-12))
                few = np.isfinite(seen[i]).sum() < 2
                off = not valid[i] and (KNOB[best] == "maf" or (np.isfinite(measured[i]) and abs(measured[i] - 1) > 0.03))
                reason = "few points" if few else "baseline" if off else "no fit" if sse[i, order[i, 0]] > WORST else "margin" if best != "healthy" and margin < MARGIN else None
                rows.append((b[key].iloc[i], None if reason else best, float(fits[best][0][i]), margin, reason))
            yield pd.DataFrame(rows, columns=[key, "fault", "size", "margin", "reason"])

    return worlds.mapInPandas(run, f"{key} {worlds.schema[key].dataType.simpleString()}, fault string, size double, margin double, reason string")


def worlds(spark: SparkSession, per_fault: int, seed: int = 0) -> DataFrame:
    """(world, truth, size, flow, latency, maf, t0, t1, t2, maf_ratio, validated): per_fault worlds of each fault, sizes by hash."""
    faults = list(KNOB)
    base = spark.range(per_fault * len(faults)).withColumnRenamed("id", "world")
    truth = F.element_at(F.array(*map(F.lit, faults)), (F.col("world") % len(faults) + 1).cast("int"))
    u = F.pmod(F.xxhash64(F.lit(seed), "world"), F.lit(1_000_003)) / 1_000_003
    lo = {"maf_low": 0.85, "maf_high": 1.08, "injector_flow_lean": 1.08, "injector_flow_rich": 0.85, "injector_latency_lean": 0.6, "vacuum_leak": 0.006}
    hi = {"maf_low": 0.93, "maf_high": 1.18, "injector_flow_lean": 1.18, "injector_flow_rich": 0.93, "injector_latency_lean": 0.8, "vacuum_leak": 0.02}
    low, high = (F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) for m in (lo, hi))
    rows = base.withColumn("truth", truth).withColumn("size", F.coalesce(F.try_element_at(low, F.col("truth")) + u * (F.try_element_at(high, F.col("truth")) - F.try_element_at(low, F.col("truth"))), F.lit(1.0)))
    flow, lat, maf, one = F.lit(500.0), F.lit(1.0), F.lit(1.0), F.lit(1.0)
    is_ = lambda *f: F.col("truth").isin(*f)
    t = {"flow": F.when(is_("injector_flow_lean", "injector_flow_rich"), flow / F.col("size")).otherwise(flow), "lat": F.when(is_("injector_latency_lean"), lat / F.col("size")).otherwise(lat), "maf": F.when(is_("maf_low", "maf_high"), maf / F.col("size")).otherwise(maf)}
    leak = F.when(is_("vacuum_leak"), F.col("size")).otherwise(0.0)
    trims = {f"t{i}": trim_column(flow, lat, maf, t["flow"], t["lat"], t["maf"], leak, F.lit(a), F.lit(v)) for i, (a, v) in enumerate(PROBES)}
    return rows.select("world", "truth", "size", flow.alias("flow"), lat.alias("latency"), maf.alias("maf"), *(c.alias(k) for k, c in trims.items()), F.when(is_("maf_low", "maf_high"), F.col("size")).otherwise(one).alias("maf_ratio"), F.lit(True).alias("validated"))


def rules(trim_idle: Column, trim_fast: Column, maf_dev: Column, trim_low_volts: Column | None = None) -> Column:
    """The baseline diagnosis by thresholds; with a trim at low voltage a leak that grows with it is a latency error."""
    ratio = F.coalesce(F.try_divide(trim_fast, trim_idle), F.lit(1.0))
    leak = F.lit("vacuum_leak") if trim_low_volts is None else F.when(trim_low_volts - trim_idle > 1.0, "injector_latency_lean").otherwise("vacuum_leak")
    return F.when(F.abs(trim_idle) < 3.0, "healthy").when(maf_dev < -0.03, "maf_low").when(maf_dev > 0.03, "maf_high").when(trim_idle > 0, F.when(ratio > 0.80, F.lit("injector_flow_lean")).otherwise(leak)).otherwise("injector_flow_rich")


def synthetic_log(spark: SparkSession, n: int, trim_pct: float, seed: int = 0) -> DataFrame:
    """(seq, rpm, maf_gs, tps, af_correction, af_learning, fuel_system_status) around an idle with Gaussian noise."""

    def at(mean: float, sd: float, k: int) -> Column:
        """Normal noise from hashes of row and seed, so that it doesn't depend on partitions."""
        unit = [(F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.lit(i), "id"), F.lit(1 << 52)) + 0.5) / (1 << 52) for i in (0, 1)]
        return F.lit(mean) + sd * F.sqrt(-2 * F.log(unit[0])) * F.cos(2 * np.pi * unit[1])

    short = max(-20.0, min(20.0, trim_pct / 2))
    return spark.range(n).select(F.col("id").alias("seq"), at(850.0, 15.0, 1).alias("rpm"), at(2.5, 0.03, 2).alias("maf_gs"), F.lit(1.0).alias("tps"), at(short, 0.3, 3).alias("af_correction"), F.lit(trim_pct - short).alias("af_learning"), F.lit(8.0).alias("fuel_system_status"))


def convergence(starts: DataFrame, iterations: int = 8) -> DataFrame:
    """(seed, iteration, trim_pct, step): closed loops from starts(seed, flow_ratio, latency_ratio, maf_ratio), believed over true.

    Each loop measures the idle trim and moves the airflow scaling by a controller's bounded step; loops run side by side.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = len(b)
            flow, lat, maf, total = 500.0 * b["flow_ratio"].to_numpy(float), b["latency_ratio"].to_numpy(float), b["maf_ratio"].to_numpy(float), np.zeros(n)
            for i in range(iterations):
                t = trim(flow, lat, maf, np.full(n, 500.0), np.ones(n), np.ones(n), 0.0, 1.0, 14.0)
                step, total = pi_step(t, total)
                yield pd.DataFrame({"seed": b["seed"].to_numpy(), "iteration": i, "trim_pct": 100 * t, "step": step})
                maf = maf * (1 + step)

    return starts.mapInPandas(run, "seed bigint, iteration int, trim_pct double, step double")
