import math
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from tunemill.operators.faults import CHANNELS, FaultCfg, Faults, spikes

LIMITS = {"junction_c": (5.0, 120.0), "power_w": (1.0, 600.0), "fan1_rpm": (0.0, 6000.0)}
SCHEMA = "sample_id bigint, rig string, gpu int, ts timestamp, junction_c double, power_w double, fan1_rpm double, bucket string, channel int"


def history(seed=1, sources=3, n=900):
    rng, rows, sid = random.Random(seed), [], 0
    for s in range(sources):
        at, level = datetime(2025, 1, 6), 50.0
        for i in range(n):
            at += timedelta(seconds=rng.choice([5, 5, 6, 0 if i % 97 == 0 else 5]) + (7200 if i % 211 == 0 else 0))
            level += 40 if i in (300, 600) else -30 if i == 450 else 0
            x = [round(level + rng.gauss(0, 1), 1), round(2 * level + rng.gauss(0, 2), 2), float(round(900 + rng.gauss(0, 20), -1))]
            if s == 2 and i > 500:
                x[2] = 0.0
            if rng.random() < 0.01:
                x[rng.randrange(3)] = rng.choice([None, float("nan"), 9999.0, -40.0])
            if rng.random() < 0.01:
                k = rng.randrange(3)
                x[k] = x[k] + (400 if k == 2 else 60) if x[k] else x[k]
            if 200 <= i < 245:
                x[0] = 51.3
            if 700 <= i < 729:
                x[1] = 77.7
            rows.append((sid, f"rig{s % 2}", s, at, *x, "clash", 1))
            sid += 1
    rng.shuffle(rows)
    return rows + rows[:40]


def brute(rows, cfg=FaultCfg()):
    out = set()
    d = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).drop_duplicates("sample_id").sort_values(["rig", "gpu", "ts", "sample_id"])
    for _, g in d.groupby(["rig", "gpu"]):
        for ch in CHANNELS:
            lo, hi = LIMITS[ch]
            m = g[ch].notna()
            v, ids = g.loc[m, ch].tolist(), g.loc[m, "sample_id"].tolist()
            label = [""] * len(v)
            ok = [i for i, x in enumerate(v) if lo <= x <= hi and not (ch == "fan1_rpm" and x == 0)]
            y = np.array([v[i] for i in ok])
            mid = pd.Series(y).rolling(9, center=True, min_periods=1).median().to_numpy()
            r = np.abs(y - mid)
            limit = 10 * math.sqrt(np.mean(np.minimum(r, np.quantile(r, 0.97)) ** 2))
            for i in range(1, len(y)):
                for w in (1, 2, 3):
                    if i + w < len(y):
                        b, a, seg = np.median(y[max(0, i - 5) : i]), np.median(y[i + w : i + w + 5]), y[i : i + w]
                        if max((seg - max(a, b)).min(), (min(a, b) - seg).min()) > limit and abs(y[i - 1] - b) <= limit and abs(y[i + w] - a) <= limit:
                            for j in range(i, i + w):
                                label[ok[j]] = "spike"
            i = 0
            while i < len(v):
                j = i
                while j < len(v) and v[j] == v[i]:
                    j += 1
                if j - i >= 30 and not (ch == "fan1_rpm" and v[i] == 0):
                    label[i:j] = ["stuck"] * (j - i)
                i = j
            out |= {(ids[i], ch, "impossible" if not lo <= v[i] <= hi else label[i]) for i in range(len(v)) if label[i] or not lo <= v[i] <= hi}
    return out


@pytest.fixture(scope="module")
def limits(spark):
    return spark.createDataFrame([(c, "u", *x) for c, x in LIMITS.items()] + [(None, "u", 0.0, 1.0), ("vram_c", "C", 0.0, 90.0)], "channel string, unit string, lo double, hi double")


@pytest.mark.parametrize("bucket_rows", [32_768, 60])
def test_matches_brute_force_at_any_bucket_size(spark, limits, bucket_rows):
    rows = history()
    got = [tuple(r) for r in Faults(spark.createDataFrame(rows, SCHEMA), limits, FaultCfg(bucket_rows=bucket_rows)).labels().select("sample_id", "channel", "defect").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows) and {k for *_, k in got} == {"impossible", "stuck", "spike"}


def test_edges(spark, limits):
    d = spark.createDataFrame(history(2, 1, 40), SCHEMA)
    assert Faults(d.where("false"), limits).labels().count() == 0
    assert Faults(d.where("false"), limits).cutoffs().count() == 0
    assert Faults(d.limit(1), limits).labels().where("defect <> 'impossible'").count() == 0
    nothing = Faults(d, limits.where("false")).labels()
    assert nothing.where("defect = 'impossible'").count() == 0
    lost = spark.createDataFrame([(1, None, 0, datetime(2025, 1, 1), 999.0, 1.0, 1.0, "", 1), (2, "r", 0, None, 999.0, 1.0, 1.0, "", 1), (3, "r", 0, datetime(2025, 1, 1), 999.0, None, None, "", 1)], SCHEMA)
    assert [tuple(r) for r in Faults(lost, limits).labels().collect()] == [(3, "junction_c", "impossible")]


def test_tail_cutoff_is_near_the_risk(spark, limits):
    rng = random.Random(3)
    rows = [(i, "r", 0, datetime(2025, 1, 6) + timedelta(seconds=5 * i), 60 + rng.gauss(0, 1), 100 + rng.gauss(0, 3), None, "", 1) for i in range(6000)]
    got = {r.channel: r for r in Faults(spark.createDataFrame(rows, SCHEMA), limits).cutoffs().collect()}
    assert set(got) == {"junction_c", "power_w"}
    assert 0.8 < got["junction_c"].scatter < 1.1 and 3.3 < got["junction_c"].tail_cutoff < 6.5 and 2.4 < got["power_w"].scatter < 3.3


def daily():
    """Three days with a swing of 30 over the day, scatter 1, and readings 14 off now and then."""
    rng, rows = random.Random(9), []
    for i in range(8000):
        at = datetime(2025, 1, 6) + timedelta(seconds=30 * i)
        x = 60 + 15 * math.sin(2 * math.pi * i / 2880) + rng.gauss(0, 1) + (14 if i % 977 == 500 else 0)
        rows.append((i, "r", 0, at, x, None, None, "", 1))
    return rows


def test_the_cutoff_of_the_tail_decides(spark, limits):
    d = spark.createDataFrame(daily(), SCHEMA)
    at = lambda **cfg: sorted(r.sample_id for r in Faults(d, limits, FaultCfg(**cfg)).labels().collect())
    usual = at()
    assert usual == [i for i in range(8000) if i % 977 == 500] and at(risk=1e-3) == usual
    assert at(risk=1e-300, shapes=(0.2, 0.2)) == []


def test_scatter_and_cutoff_leave_the_season_out_and_do_not_depend_on_buckets(spark, limits):
    d = spark.createDataFrame(daily(), SCHEMA)
    one, many = (Faults(d, limits, FaultCfg(bucket_rows=n)).cutoffs().first() for n in (32_768, 25))
    assert one.readings == many.readings == 8000
    assert one.scatter == pytest.approx(many.scatter, rel=1e-9) and one.tail_cutoff == pytest.approx(many.tail_cutoff, rel=1e-9)
    assert 0.8 < one.scatter < 1.1
    season = Faults(d, limits).sources.first()["junction_c"]
    assert max(season) - min(season) > 25


def test_a_spike_may_change_sides():
    y = np.array([50.0, 50.1] * 10 + [90.0, 10.0] + [50.0, 50.1] * 10)
    assert np.flatnonzero(spikes(y, 5.0, cutoff=5.0)).tolist() == [20, 21]
