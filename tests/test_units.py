import itertools
import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from tunemill.functions.quantities import first_unit, number, read
from tunemill.operators import units
from tunemill.plans import problems
from tunemill.plans import problems


@pytest.mark.parametrize(("text", "value"), [
    ("10,240 us", (10240, 10240, "us")), ("31 000", (31000, 31000, None)), ("1,07...1.61 L/min", (1.07, 1.61, "L/min")), ("55 - 69,4 rev/s", (55, 69.4, "rev/s")),
    ("ca. 3.8 pounds per square inch", (3.8, 3.8, "psi")), ("On the ZB25 it is 0,0129seconds", (0.0129, 0.0129, "s")), ("14.4 [REF 4628]", (14.4, 14.4, None)),
    ("68.6 kW (69000 watts)", (68.6, 68.6, "kW")), ("17 200 to 2.15e4", (17200, 21500, None)), (".347 lb/in2", (0.347, 0.347, "psi")), ("-40 to 10 C", (-40, 10, "C")),
    ("4,49 to 7.4krpm", (4.49, 7.4, "krpm")), ("QX20: 25 N·m", (25, 25, "Nm")), ("970 mA to 1.39 A", (0.97, 1.39, "A")), ("7 400 mV", (7400, 7400, "mV")), ("9 to 5 V", (5, 9, "V")), ("107-170", (107, 170, None)),
])
def test_reads(text, value):
    q = read(text)
    assert (pytest.approx(q.lo), pytest.approx(q.hi), q.unit) == value


def test_reads_nothing():
    assert all(read(t) is None for t in (None, "", "n/a", "see table", "[REF 3]", "ZB25", "(5 V)", ", "))
    assert number("1 234,567") == 1234567 and first_unit("L/min (L/h)") == "L/min" and first_unit("mi/h.") == "mph" and first_unit(None) is None
    assert read("x" * 200_000 + " 5 V").unit == "V"


ROWS = [
    (1, "1020 L/h", "17", "L/min", 1.0, True), (2, "17 L/min", "17", "L/min", 1.0, False), (3, "232 mV", "0.232", "volts", 1.0, True), (4, "145F", "62.8", "deg C", 2.0, True),
    (5, "92 000 HP", "68.6 kW (69000 watts)", "kW", 1.0, False), (6, "1600 hPa", "1600 mbar", "mbar", 2.0, False), (7, "64 to 97 l/hr", "1.07...1.61 L/min", None, 2.0, True),
    (8, "64 l/hr", "1.07...1.61 L/min", None, 2.0, False), (9, None, "5", "V", 1.0, False), (10, "5000", "5", "V", 1.0, False), (11, "5 A", "5", "V", 1.0, False), (12, "5000 mV", "5", "V", None, False), (13, "5000 mV", "5", None, 1.0, False), (14, "", None, None, 1.0, False),
]


NAMES = "pressure kPa,voltage V,temperature C,volume_flow cc/min,power kW,current A,rotation rpm".split(",")
ANSWERS = "row_id bigint, probe_id string, created_at timestamp, answer struct<value string, must_retrieve boolean>, expected_value string, unit string, tolerance_pct double, agrees string"


def answers(spark, rows):
    at = datetime(2025, 1, 1)
    return spark.createDataFrame([(i, p, at + timedelta(minutes=i), (v, True), e, u, t, "clash") for i, p, v, e, u, t in rows], ANSWERS)


@pytest.mark.parametrize("hot_rows", [100_000, 3])
def test_found(spark, hot_rows):
    d = answers(spark, [(i, None if i == 4 else "p" if i % 2 else f"q{i}", v, e, u, t) for i, v, e, u, t, _ in ROWS])
    t = spark.createDataFrame([tuple(n.split()) for n in NAMES] + [(None, "V"), ("voltage", "V"), ("odd", "odd")], "quantity string, common_unit string")
    twice = d.unionByName(d.where("row_id = 1"))
    m = units.measurements(twice, t)
    marks = lambda x, target=t: units.unit_marks(x, target, hot_rows=hot_rows)
    assert sorted(r.row_id for r in units.agreeing(marks(twice)).collect()) == [1, 1, 3, 4, 7]
    one = m.where("row_id = 3").first()
    assert (one.quantity, one.common_unit, one.value_lo) == ("voltage", "V", pytest.approx(0.232))
    assert m.count() == len(ROWS) + 1 and units.measurements(d.where("false"), t).count() == 0
    assert units.agreeing(marks(d.where("false"))).count() == 0 and units.agreeing(marks(d, t.where("false"))).count() == 0


def histories(seed=3, n=400):
    rng, rows = random.Random(seed), []
    for i in range(n):
        p = "hot" if i % 2 else f"p{rng.randrange(12)}"
        base, unit, others = (300.0, "kPa", [("psi", 1 / 6.894757293168), ("bar", 0.01)]) if p == "hot" or p < "p4" else (40.0, "C", [("F", None)])
        v = base * (1 + rng.uniform(-0.008, 0.008))
        name, f = rng.choice(others) if (i // 40) % 2 else (unit, 1.0)
        v = v * 9 / 5 + 32 if f is None else v * f
        v *= rng.choice([1, 1, 1, 1.5])
        rows.append((i, p, f"{v:.4g} {name}", f"{base:g}", unit, rng.choice([1.0, 2.0])))
    return rows + [(n, "hot", "0 mbar", "0", "kPa", 1.0), (n + 1, "hot", "32 F", "0", "C", 1.0), (n + 2, "p9", "-40 F", "-40", "C", 1.0)]


def test_marks_do_not_depend_on_how_histories_are_cut(spark):
    d = answers(spark, histories())
    t = spark.createDataFrame([tuple(n.split()) for n in NAMES], "quantity string, common_unit string")
    runs = [sorted((r.row_id, r.no, round(r.level, 9), tuple(r.marks)) for r in units.unit_marks(d, t, hot_rows=n).collect()) for n in (100_000, 20)]
    assert runs[0] == runs[1] and len(runs[0]) == 403
    plain = sorted(r.row_id for r in units.measurements(d, t).where("agrees and unit <> expected_unit").collect())
    assert sorted(r.row_id for r in units.agreeing(units.unit_marks(d, t)).collect()) == plain and len(plain) > 100


def test_the_search_decides_what_is_found(spark, monkeypatch):
    d = answers(spark, histories())
    t = spark.createDataFrame([tuple(n.split()) for n in NAMES], "quantity string, common_unit string")
    monkeypatch.setattr(units, "known_levels", lambda unit, expected: [])
    assert sorted(r.row_id for r in units.agreeing(units.unit_marks(d, t)).collect()) == [400, 401]  # zeros have no level


def test_jumps_over_the_bound_are_cuts_of_any_optimum():
    rng = np.random.default_rng(6)
    for _ in range(200):
        x = rng.normal(0, 0.05, 12).cumsum()
        cuts = set(units.changepoints(x, units.PENALTY))
        assert {i + 1 for i in np.flatnonzero(np.abs(np.diff(x)) > units.certain_jump(units.PENALTY))} <= cuts


def test_changepoints_are_exact():
    rng = random.Random(1)
    for _ in range(25):
        x = np.array([rng.choice([0, 3, 3, 7]) + rng.gauss(0, 0.2) for _ in range(9)])

        def cost(cuts):
            ends = [*cuts, len(x)]
            return sum(((x[a:b] - x[a:b].mean()) ** 2).sum() + 0.5 for a, b in zip([0, *cuts], ends)) - 0.5

        best = min((cost(c), c) for k in range(9) for c in itertools.combinations(range(1, 9), k))
        mine = units.changepoints(x, 0.5)
        assert mine[0] == 0 and cost(tuple(mine[1:])) == pytest.approx(best[0])
    assert units.changepoints(np.empty(0), 1.0) == []


@pytest.mark.parametrize("block_rows", [4096, 150])
def test_shifts(spark, block_rows):
    rng, rows = random.Random(2), []
    for s in ("a", "b"):
        for i in range(300):
            v = 90 * (1 + rng.gauss(0, 0.01)) / (1.609344 if s == "a" and 100 <= i < 140 else 1)
            rows.append((s, datetime(2025, 1, 1) + timedelta(minutes=i), v, "speed", 1))
    rows += [(None, datetime(2025, 1, 1), 1.0, "speed", 1), ("a", None, 1.0, "speed", 1), ("a", datetime(2025, 1, 1), None, "speed", 1), ("a", datetime(2025, 1, 1), -1.0, "speed", 1)]
    d = spark.createDataFrame(rows, "src string, at timestamp, v double, q string, block int")
    out = units.unit_shifts(d, ["src"], "at", "v", "q", penalty=0.05, block_rows=block_rows).collect()
    marked = [r for r in out if r.change]
    assert {(r.src, r.change) for r in marked} == {("a", "mph>km/h")} or {(r.src, r.factor > 0.6) for r in marked} == {("a", True)}
    assert sum(r.n for r in marked) == 40 and sum(r.n for r in out) == 600
    assert units.unit_shifts(d.where("false"), ["src"], "at", "v", "q").count() == 0


def test_search_is_exact_over_long_series():
    rng = np.random.default_rng(4)
    level = np.repeat(rng.choice([0, 0, 0.05, 0.7], 30), rng.integers(1, 30, 30))
    for x in (level + rng.normal(0, 0.03, len(level)), rng.normal(0, 0.1, 300), np.zeros(50), np.linspace(0, 2, 200)):
        s, q = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
        best = np.concatenate([[-0.02], np.empty(len(x))])
        for t in range(1, len(x) + 1):
            a = np.arange(t)
            best[t] = (best[:t] + q[t] - q[a] - (s[t] - s[a]) ** 2 / (t - a)).min() + 0.02
        ends = [*units.changepoints(x, 0.02), len(x)]
        assert sum(((x[a:b] - x[a:b].mean()) ** 2).sum() + 0.02 for a, b in zip(ends, ends[1:])) - 0.02 == pytest.approx(best[-1], abs=1e-9)


@pytest.mark.parametrize("block_rows", [4096, 50])
def test_a_change_longer_than_a_block_is_found(spark, block_rows):
    rng = random.Random(5)
    speed = [90 * (1 + rng.gauss(0, 0.01)) / (1.609344 if i >= 360 else 1) for i in range(600)]
    dense = [("dense", datetime(2025, 1, 1) + timedelta(seconds=i), 50.0, "speed") for i in range(500)]
    rows = [("a", datetime(2025, 1, 1) + timedelta(minutes=i), v, "speed" if i else None) for i, v in enumerate(speed)]
    d = spark.createDataFrame(rows + dense, "src string, at timestamp, v double, q string")
    out = units.unit_shifts(d, ["src"], "at", "v", "q", penalty=0.05, block_rows=block_rows).where("src = 'a'").orderBy("segment").collect()
    assert [(r.n, r.change) for r in out] == [(360, None), (240, "km/h>mph")]
    assert out[1].first == datetime(2025, 1, 1, 6) and out[1].last == datetime(2025, 1, 1, 9, 59)


def test_a_stated_change_of_unit_shows_in_the_figures_as_written(spark, tmp_path):
    texts = [f"{300 + i % 3} kPa" for i in range(12)] + [f"{43.6 + i % 2 / 10} psi" for i in range(6)] + ["301", "2.0 kPa", None, "n/a"]
    rows = [(i, "p", datetime(2025, 1, 1) + timedelta(hours=i), (v, False), "300", "kPa", 1.0) for i, v in enumerate(texts)]
    schema = "row_id bigint, probe_id string, created_at timestamp_ntz, answer struct<value string, must_retrieve boolean>, expected_value string, unit string, tolerance_pct double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/e2_answers.parquet")
    spark.createDataFrame([("pressure", "kPa")], "quantity string, common_unit string").write.parquet(f"{tmp_path}/unit_target.parquet")
    out = problems.p7_shifts(spark, str(tmp_path)).orderBy("segment").collect()
    assert [(r.n, r.change, r.stated, r.stated_change, r.confirmed) for r in out] == [
        (12, None, "kPa", None, True), (6, "kPa>psi", "psi", "kPa>psi", True), (1, None, "kPa", None, True), (1, None, "kPa", None, True),
    ]
    assert out[3].factor < 0.01


def test_found_has_figures_at_the_lower_end_of_their_tolerance(spark, tmp_path):
    rows = [(1, "a", "14.2152 psi", "100", "kPa", 2.0), (2, "b", "14.79 psi", "100", "kPa", 2.0), (3, "c", "14.2 psi", "100", "kPa", 2.0), (4, "d", "98.01 kPa", "100", "kPa", 2.0)]
    answers(spark, rows).write.parquet(f"{tmp_path}/e2_answers.parquet")
    spark.createDataFrame([tuple(n.split()) for n in NAMES], "quantity string, common_unit string").write.parquet(f"{tmp_path}/unit_target.parquet")
    found = problems.p7_found(spark, str(tmp_path))
    assert sorted(r.row_id for r in found.collect()) == [1, 2]
    assert "MapInPandas" not in found._jdf.queryExecution().toString()
