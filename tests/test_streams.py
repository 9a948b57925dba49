from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tunemill.streaming import streams as S


def rows(spark, path, data, schema, mode="append"):
    spark.createDataFrame(data, schema).coalesce(1).write.mode(mode).parquet(path)


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_csv_abort_and_resume(spark, tmp_path):
    t0, path = datetime(2025, 1, 1), str(tmp_path / "in")
    schema = "ts timestamp, gpu int, junction_c double, core_c double"
    rows(spark, path, [(t0, 0, 50.0, 40.0), (t0, 1, 109.0, None)], schema)
    stream = S.telemetry_stream(spark, path, schema)
    S.append_csv(stream, str(tmp_path / "csv"), str(tmp_path / "c1")).awaitTermination()
    hits = []
    S.abort_on(stream, {"junction_c": 108.0, "core_c": 90.0}, str(tmp_path / "c2"), lambda df, n: hits.extend(df.collect())).awaitTermination()
    assert [(r.gpu, r.over) for r in hits] == [(1, ["junction_c"])]
    rows(spark, path, [(t0 + timedelta(seconds=5), 0, 51.0, 41.0)], schema)
    S.append_csv(stream, str(tmp_path / "csv"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 3
    work = lambda b: b.withColumn("error", F.when(F.col("gpu") == 1, "bad"))
    for _ in range(2):
        S.resumable(stream, work, str(tmp_path / "ok"), str(tmp_path / "no"), str(tmp_path / "c3")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 2 and spark.read.parquet(str(tmp_path / "no")).count() == 1


def test_windows_match_batch(spark, tmp_path):
    t0, path = datetime(2025, 1, 1), str(tmp_path / "in")
    data = [(t0 + timedelta(seconds=20 * i), i % 2, float(i)) for i in range(60)]
    rows(spark, path, data, "ts timestamp, k int, v double")
    stream = S.telemetry_stream(spark, path, "ts timestamp, k int, v double")
    aggs = [F.count("*").alias("n"), F.sum("v").alias("total")]
    batch = spark.read.parquet(path)
    want = sorted(map(tuple, S.windowed(batch, "ts", ["k"], "5 minutes", None, "1 hour", aggs).collect()))
    assert sorted(map(tuple, run(S.windowed(stream, "ts", ["k"], "5 minutes", None, "1 hour", aggs), "w1", "complete").collect())) == want and len(want) == 8
    slid = S.windowed(batch, "ts", ["k"], "5 minutes", "1 minute", "1 hour", aggs)
    assert sorted(map(tuple, run(S.windowed(stream, "ts", ["k"], "5 minutes", "1 minute", "1 hour", aggs), "w2", "complete").collect())) == sorted(map(tuple, slid.collect()))
    assert run(S.sessions(stream, "ts", ["k"], "1 minute", "1 hour", aggs), "w3", "complete").count() == 2


def test_states(spark, tmp_path):
    path = str(tmp_path / "v")
    rows(spark, path, [("a", v, i) for i, v in enumerate("xxxyxyx")] + [("b", "z", 0)], "k string, v string, i int")
    got = run(S.agreement_state(S.telemetry_stream(spark, path, "k string, v string, i int"), "k", "v", "i"), "s1").where("key = 'a'").collect()
    assert [r.decision for r in got] == ["wait", "wait", "edit", "wait", "wait", "wait", "escalate"]
    path = str(tmp_path / "e")
    rows(spark, path, [("t", e, i) for i, e in enumerate([0.01, 0.02, 1.0, 0.01])], "k string, e double, i int")
    got = [r.step for r in run(S.integrator_state(S.telemetry_stream(spark, path, "k string, e double, i int"), "k", "e", "i"), "s2").collect()]
    assert abs(got[0] - 0.7 * (0.5 * 0.01 + 0.05 * 0.01)) < 1e-12 and got[2] == 0.03 and abs(got[3] - 0.7 * (0.005 + 0.05 * 0.04)) < 1e-12
    path = str(tmp_path / "m")
    rows(spark, path, [("d", s, i) for i, s in enumerate([True, False, False, False, True, False])], "k string, s boolean, i int")
    got = run(S.miss_state(S.telemetry_stream(spark, path, "k string, s boolean, i int"), "k", "s", "i"), "s3").collect()
    assert [(r.misses, r.gone) for r in got] == [(0, False), (1, False), (2, False), (3, True), (0, False), (1, False)]
