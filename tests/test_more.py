import random

import pytest
from pyspark.sql import functions as F

from tunemill import session
from tunemill.functions import text as T
from tunemill.operators import calibration as C
from tunemill.operators import corpus
from tunemill.operators import definitions as D
from tunemill.operators import evaluation as E
from tunemill.operators import images as I
from tunemill.operators import simulation as S
from tunemill.operators import telemetry
from tunemill.sources import files


def test_definitions_merge_the_nearest_and_survive_cycles(spark):
    rows = [("leaf", ["mid", "gone"], "t", None, 5), ("mid", ["base"], "t", "m", 6), ("base", ["leaf"], "t", "b", 7), ("base", ["leaf"], "u", "x", None), ("lone", [], None, None, None), ("none", None, "t", None, None)]
    d = spark.createDataFrame(rows, "id string, inc array<string>, name string, unit string, size int")
    got = {(r.leaf, r.name): (r.unit, r.size) for r in D.merged(d, "id", "inc", "name", ["unit", "size"]).collect()}
    assert got["leaf", "t"] == ("m", 5) and got["leaf", "u"] == ("x", None) and got["mid", "t"] == ("m", 6) and got["base", "t"] == ("b", 7) and got["none", "t"] == (None, None) and ("lone", None) not in got
    assert D.chains(d.where("false"), "id", "inc").count() == 0
    names = spark.createDataFrame([("a",), ("A2",), ("x",), (None,)], "n string").select(D.semantic_id(F.col("n"), {"one": "a", "two": "b"}, {"two": ["A2", "a"]}), D.platform_name(F.lit("two"), {"one": "a"}))
    assert [tuple(r) for r in names.collect()] == [("one", None), ("two", None), (None, None), (None, None)]


def test_mix_and_fill(spark):
    pairs = spark.createDataFrame([(i, "x" * i) for i in range(1, 8)] + [(9, None)], "id int, diagnosis string")
    verdicts = spark.createDataFrame([(1, "subaru", "deep", "maf"), (2, "subaru", "deep", "other"), (3, "modern_general", "deep", "maf"), (4, "subaru", "adequate", None), (5, "other", "deep", "maf"), (6, "subaru", "shallow", "maf"), (7, None, "deep", "maf"), (9, "subaru", "deep", "maf")], "id int, relevance string, depth string, topic string")
    mixed = E.pair_mix(pairs, verdicts, spark.createDataFrame([(2,), (2,), (None,)], "id int"), "id")
    assert sorted(r.id for r in mixed.collect()) == [1, 3, 4, 9]
    assert [r.id for r in E.filled(mixed, 3, "id").collect()] == [1, 9, 4] and E.filled(mixed, 0, "id").count() == 0


def test_ids_from_model_output(spark):
    rows = spark.createDataFrame([(7, '[{"a": 1}, {"a": 2}]'), (8, "broken"), (9, None), (10, "[]")], "doc int, out string")
    assert sorted((r.pid, r.a) for r in E.numbered(rows, "syn", "doc", F.col("out"), "array<struct<a:int>>", "pid").collect()) == [("syn-7-0", 1), ("syn-7-1", 2)]


def test_quotes_values_numbers(spark):
    rows = [("a  b­", "x A a b c", "1,5 and 20", "15 and 20"), ("z", "a", "3", "4"), (None, None, None, None), ("", "x", "n/a", "x")]
    d = spark.createDataFrame(rows, "q string, s string, v string, w string")
    assert [tuple(r) for r in d.select(T.quoted_in(F.col("q"), F.col("s")), T.values_in(F.col("v"), F.col("w"))).collect()] == [(True, True), (False, False), (True, True), (True, True)]
    n = spark.createDataFrame([("about -3.5 V",), ("none",), (None,), ("7",)], "t string").select(T.tolerant_number(F.col("t")))
    assert [r[0] for r in n.collect()] == [-3.5, None, None, 7.0]


def test_ranks_over_many_values(spark):
    rng = random.Random(2)
    values = [rng.choice([None, *range(400)]) for _ in range(900)]
    d = spark.createDataFrame([(v,) for v in values], "v int")
    kept = sorted(v for v in values if v is not None)
    got = {r.v: r.r for r in E.average_ranks(d.where("v is not null"), "v", "r").collect()}
    assert got == {v: kept.index(v) + (kept.count(v) + 1) / 2 for v in set(kept)}


def test_split_keeps_every_row(spark):
    rows = [(i, None if i % 7 == 0 else i % 3, "x") for i in range(500)]
    d = spark.createDataFrame(rows, "id int, s int, split string").drop("split")
    out = corpus.stratified_split(d, ["s"], "id", 0.1).collect()
    assert len(out) == 500 == len({r.id for r in out})
    for s in (None, 0, 1, 2):
        own = [r for r in out if r.s == s]
        assert sum(r.split == "val" for r in own) == round(len(own) * 0.1)


def test_labels_and_samples(spark):
    row = "doc_id int, label_set string, rater string, score int"
    stored = spark.createDataFrame([(1, "a", "x", 1), (1, "a", "y", 2), (2, "a", "x", 3)], row)
    out = corpus.labelled(stored, spark.createDataFrame([(1, "a", "x", 5), (3, "b", None, 4)], row), [F.desc("score")])
    assert sorted(((r.doc_id, r.rater, r.score) for r in out.collect()), key=str) == [(1, "x", 5), (1, "y", 2), (2, "x", 3), (3, None, 4)]
    assert [r.doc_id for r in corpus.labels_of(out, "a", "x").collect()] == [1, 2] and corpus.labels_of(out, "none").count() == 0
    ids = [r.id for r in corpus.sampled(spark.range(100), "id", 10).collect()]
    assert len(set(ids)) == 10 and ids == sorted(ids) == [r.id for r in corpus.sampled(spark.range(100).repartition(7), "id", 10).collect()]


def test_observations(spark):
    rows = [("a", 1, 10.0, 900.0, 14.0, 5.0), ("a", 2, 20.0, 1500.0, 14.5, -5.0), ("a", 3, 30.0, 2500.0, 12.0, 0.0), ("b", 1, 0.0, 900.0, 14.0, 1.0), ("c", 1, None, 900.0, 14.0, 1.0)]
    d = spark.createDataFrame(rows, "log string, hold int, maf double, rpm double, volts double, trim double")
    seen = telemetry.observations(d, ["log"], "hold", ([1000.0, 2000.0], [10.0, 30.0]))
    assert [(r.hold, r.air_scale, r.nominal, r.trim_fraction) for r in seen.orderBy("hold").collect()] == [(1, 1.0, 10.0, 0.05), (2, 2.0, 20.0, -0.05), (3, 3.0, None, 0.0)]
    one = telemetry.airflow_ratio(seen.withColumn("ok", F.lit(True)), ["log"], "ok").first()
    assert (one.ratio, one.validated) == (1.0, True)


def test_gates_of_diagnosis_and_boost(spark):
    base = dict(kind="fuel", table_id="maf", cur=10.0, new=11.0, knock_active=False, converged=True, steady=True, diagnosed=True, identifiable=True, knob="maf", max_trim=0.02, wideband_tracking=True, boost_verified=True)
    cases = [({}, None), ({"identifiable": False}, "diagnosis: not identifiable"), ({"knob": None}, "diagnosis: no table"), ({"knob": "flow"}, "diagnosis: another table"), ({"knob": "flow", "new": 10.0}, None), ({"knob": "flow", "diagnosed": False}, None), ({"kind": "boost", "max_trim": 0.06}, "boost"), ({"kind": "boost", "wideband_tracking": False}, "boost"), ({"kind": "boost"}, None)]
    schema = "p int, kind string, table_id string, cur double, new double, knock_active boolean, converged boolean, steady boolean, diagnosed boolean, identifiable boolean, knob string, max_trim double, wideband_tracking boolean, boost_verified boolean"
    d = spark.createDataFrame([(i, *(base | c).values()) for i, (c, _) in enumerate(cases)], schema)
    assert {r.p: r.refused for r in C.gates(d, "p").collect()} == {i: want for i, (_, want) in enumerate(cases)}


def test_noise_does_not_depend_on_partitions(spark):
    a = S.synthetic_log(spark, 200, 4.0, seed=3).orderBy("seq").collect()
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
    try:
        b = S.synthetic_log(spark, 200, 4.0, seed=3).orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert a == b and abs(sum(r.rpm for r in a) / 200 - 850) < 5


def test_broadcasts_are_checked_by_bytes(spark):
    d = spark.range(50).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    hinted = lambda x: "ResolvedHint" in x._jdf.queryExecution().analyzed().toString()
    assert hinted(session.small(d)) and not hinted(session.small(d, size=10_000)) and not hinted(session.small(d, rows=10)) and hinted(session.small(d.where("false")))


@pytest.mark.parametrize("extrapolate", [False, True])
def test_maf_correction_edges(spark, extrapolate):
    schema = "k int, xi int, cur double, trim double, count int, base double"
    rows = [(1, i, 10.0, t, 30, b) for i, t, b in [(0, None, 10.0), (1, 10.0, 9.0), (2, None, 9.0), (3, 1.0, 9.0), (4, None, 9.5), (5, None, 0.0)]] + [(2, 0, 5.0, None, 0, None)]
    out = {(r.k, r.xi): (r.kind, round(r.new, 4)) for r in C.maf_correction(spark.createDataFrame(rows, schema), ["k"], extrapolate=extrapolate).collect()}
    want = {(1, 1): ("measured", 10.7), (1, 2): ("measured", 10.35)}
    ratio = (10 / 9 * 1.1 + 10 / 9 * 1.01) / 2
    assert out == want | ({(1, 4): ("extrapolated", round(9.5 * ratio, 4))} if extrapolate else {})


def test_cells_and_axes(spark):
    cells = spark.createDataFrame([(1, 0, 5.0), (1, 1, 6.0), (2, 0, None)], "t int, c int, value double")
    edits = spark.createDataFrame([(1, 1, 9.0), (3, 0, 1.0)], "t int, c int, new double")
    assert sorted(((r.t, r.c, r.value) for r in C.edited(cells, edits, ["t", "c"]).collect()), key=str) == [(1, 0, 5.0), (1, 1, 9.0), (2, 0, None)]
    assert spark.range(1).select(I.cell_address(F.lit(1000), F.lit(2), F.lit(3), F.lit(10), "uint16")).first()[0] == 1000 + 23 * 2
    steps = spark.range(1).select(I.step_size("x*2", "x/2", F.lit(10.0)), I.step_size("x", "x", F.lit(1.0))).first()
    assert tuple(steps) == (0.5, 1.0)
    rows = [([1.0, 2.0, 3.0],), ([3.0, 2.0, 1.0],), ([1.0, 1.0],), ([1.0, 99.0],), ([1.0, float("nan")],), ([5.0],), ([],), (None,), ([1.0, None],)]
    d = spark.createDataFrame(rows, "v array<double>").select(I.plausible(F.col("v"), F.lit(0.0), F.lit(10.0)).alias("ok"))
    assert [r.ok for r in d.collect()] == [True, True, False, False, False, True, True, False, False]


def test_sources_are_fetched_by_name(spark):
    files.register("counted", lambda session, path: session.range(int(path)))
    try:
        assert [(r.id, r.source) for r in files.fetch(spark, "counted", "2").collect()] == [(0, "counted"), (1, "counted")]
    finally:
        del files.REGISTRY["counted"]
