import random
import re
from datetime import datetime, timedelta
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunemill.operators import calibration as C
from tunemill.operators import images as I
from tunemill.operators import judging as J
from tunemill.operators import ordered as O
from tunemill.operators import retrieval as R
from tunemill.operators import sets
from tunemill.operators import simulation as S
from tunemill.plans import core


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(3)
    base = [[rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(80)] for _ in range(6)]
    rows = []
    for i in range(60):
        w = list(base[i % 6])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 9])):
            w[rng.randrange(len(w))] = "new" + str(rng.randint(0, 999))
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, ""), (102, "one two"), (103, "ONE  two")]
    shingle = lambda t: {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(max(1, len(w) - 4))}
    have = {i: shingle(t) for i, t in rows if t}
    want = {frozenset((a, b)) for a in have for b in have if a < b and have[a] != have[b] and len(have[a] & have[b]) / len(have[a] | have[b]) >= 0.8}
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    five = sets.shingles(F.col("text"))
    member, reps = sets.classes(d, "doc_id", five)
    rep = {r.doc_id: r.rep for r in member.collect()}
    got = {frozenset((r.a, r.b)) for r in sets.links(reps, Fraction(4, 5)).collect()}
    assert got == {frozenset(rep[x] for x in p) for p in want} and len(got) > 3
    parent = {i: i for i in have}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in have:
        for b in have:
            if a != b and (have[a] == have[b] or frozenset((a, b)) in want):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    out = {r.doc_id: r["class"] for r in sets.near_duplicates(d, "doc_id", five, Fraction(4, 5)).collect()}
    assert out == {i: find(i) for i in have}


@pytest.mark.parametrize("group", [1_000, 3])
def test_word_set_links_match_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(sets, "GROUP", group)
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(60)]
    rows = [(i, " ".join(rng.sample(vocabulary[: rng.choice([12, 20, 60])], rng.randint(1, 12))).title()) for i in range(160)]
    d = spark.createDataFrame(rows + [(500, None), (501, "a b 12")], "doc_id bigint, text string")
    have: dict[frozenset, int] = {}
    for i, t in rows:
        if s := frozenset(re.findall("[a-z]{3,}", t.lower())):
            have.setdefault(s, i)
    for t, strict in ((Fraction(3, 5), True), (Fraction(3, 5), False), (Fraction(1, 2), True)):
        want = {(i, j) for a, i in have.items() for b, j in have.items() if i < j and (Fraction(len(a & b), len(a | b)) > t or (not strict and Fraction(len(a & b), len(a | b)) == t))}
        _, reps = sets.classes(d, "doc_id", sets.words(F.col("text")))
        got = [(r.a, r.b) for r in sets.links(reps, t, strict).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 10


def test_exemplars_are_deepest_then_longest(spark):
    member = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)], "doc_id bigint, class bigint")
    rows = spark.createDataFrame([(1, 3, "aa"), (2, 3, "aaa"), (3, None, "aaaaaa"), (4, None, None), (5, None, None)], "doc_id bigint, score int, text string")
    out = sets.exemplars(member, rows, "doc_id", F.col("score"), F.length("text")).collect()
    assert sorted((r["class"], r.exemplar, r.members) for r in out) == [(1, 2, 3), (4, 4, 2)]


def test_components_of_a_long_chain(spark):
    n = 300
    nodes, edges = spark.range(n).select(F.col("id").alias("rep")), spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["class"] for r in sets.components(nodes, edges).collect()} == {0}


def test_classes_have_a_row_for_each_document(spark, tmp_path):
    rows = [(1, "one two three"), (2, "ONE two  three"), (3, None), (4, ""), (5, " .. !\n"), (6, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = core.QUERIES["set01_classes"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r["class"], r.links) for r in out) == [(1, 1, 0), (2, 1, 0), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 6, 0)]


def test_ordered_matches_a_plain_window(spark):
    rng, t0 = random.Random(1), datetime(2025, 1, 1)
    rows = [(rng.choice(["a", "b", None]), t0 + timedelta(hours=rng.randint(0, 90)), i, rng.choice([None, 1, 2])) for i in range(300)]
    d = spark.createDataFrame(rows, "k string, ts timestamp, i int, v int")
    keys, order, bucket = ["k"], ["ts", "i"], O.day(F.col("ts"))
    near = {r.i: (r.prev_v, r.next_v, r.is_first) for r in O.with_neighbours(d, keys, order, bucket, ["v"]).collect()}
    total = {r.i: r.s for r in O.running_total(d, keys, order, bucket, F.col("v"), "s").collect()}
    carried = {r.i: (r.last_v, r.first_v) for r in O.carried(d, keys, order, bucket, "v").collect()}
    runs = sorted((r.n for r in O.runs(d, keys, order, bucket, "v").collect()), reverse=True)
    want_runs = []
    for k in ("a", "b", None):
        h = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        v = [r[3] for r in h]
        for j, r in enumerate(h):
            assert near[r[2]] == (v[j - 1] if j else None, v[j + 1] if j + 1 < len(v) else None, j == 0)
            assert total[r[2]] == sum(x or 0 for x in v[: j + 1])
            assert carried[r[2]] == (next((x for x in v[j::-1] if x is not None), None), next((x for x in v[j:] if x is not None), None))
            if j == 0 or v[j] != v[j - 1]:
                want_runs.append(0)
            want_runs[-1] += 1
    assert runs == sorted(want_runs, reverse=True)


def test_windows_and_spans():
    text = "Alpha " * 200 + "the knock sensor reads 1234567.89 volts and knock again " + "omega " * 200
    for most in (60, 120, 400):
        w = R.window(text, ["knock", "sensor"], most)
        assert len(w) <= most and "knock" in w and (not any(c.isdigit() for c in w) or "1234567.89" in w)
    assert R.window(" short ", [], 50) == "short" and R.window(None, ["x"], 50) == "" and len(R.window("x" * 900, ["x"], 50)) <= 50
    units = R._units("ab x ab abc cd", 50)
    assert R.evidence_span("ab x ab abc cd", ["abc", "xyz"], units, 8) == (3, 3) and R.evidence_span("none", ["absent"], R._units("none", 9), 10) is None


def test_windows_cut_no_token_at_any_width():
    rng = random.Random(4)
    parts = ["the limiter is 30 000 rpm", "a swing of 11.8 % was seen", "filler about practice", "from 40-psi to 50-psi", "injector pressure, effective size", "x" * 30, "1 234 567", "end."]
    text = " ".join(rng.choices(parts, k=120))
    whole = [text[a:b] for a, b in R._units(text, 10_000)]
    for most in range(80, 700):
        w = R.window(text, ["injector", "pressure", "limiter"], most)
        own = w.removeprefix("… ").removesuffix(" …")
        cut = [own[a:b] for a, b in R._units(own, 10_000)]
        assert len(w) <= most and own in text and "pressure" in w
        assert any(whole[i : i + len(cut)] == cut for i in range(len(whole))), most
    far = "decoy limiter " + "word " * 300 + "limiter injector pressure " + "word " * 300
    assert "injector pressure" in R.window(far, ["injector", "pressure", "limiter"], 120)
    assert R.window("head " + "word " * 300, ["zzzz"], 60).startswith("head ")


def test_images(spark):
    x = F.lit(3.0)
    assert spark.range(1).select(I.scaled("14.7/(1+x*.5)", x), I.scaled("-x*2+1e1", x)).first()[:] == pytest.approx((5.88, 4.0))
    for bad in ("__import__('os')", "x;1", "x**2", "(x", "y"):
        with pytest.raises((ValueError, IndexError)):
            I.scaled(bad, x)
    data = bytearray(524_288)
    data[100:108] = (7).to_bytes(4, "big") + (5).to_bytes(4, "big")
    data[0x7FB80 : 0x7FB80 + 24] = b"".join(v.to_bytes(4, "big") for v in (100, 107, 1)) + b"\xff" * 12
    r = I.repaired(spark.createDataFrame([("p", data)], "path string, content binary")).first()
    assert (r.records, r.broken) == (1, 1) and I.checksum_records(bytes(r.content))[0][3] == (I.CHECKSUM - 12) % 2**32
    ranges = I.byte_ranges(bytes(data), bytes(r.content))
    assert all(0x7FB88 <= s and e <= 0x7FB8C for s, e in ranges) and I.audit(bytes(r.content), bytes(data), [(0x7FB88, 0x7FB8C)])["go"]
    with pytest.raises(ValueError):
        I.patched(b"0123", [(1, b"xx")], [(0, 2)])
    assert I.byte_ranges(b"abc", b"abd1") == [(2, 4)]
    f = spark.createDataFrame([(bytearray(np.array([1.5, -2.0], ">f4").tobytes()),)], "c binary").select(I.floats()(F.col("c"), F.lit(0), F.lit(2))).first()[0]
    assert list(f) == [1.5, -2.0]
    low = spark.range(1).select(I.encoded(F.lit(10.9), "x*2", "x/2", "uint8", True).alias("e"), I.encoded(F.lit(500.0), "x", "x", "uint8").alias("o")).first()
    assert low.e.raw == 21 and low.o.raw is None


def test_clamps_and_proposals(spark):
    rows = [("p", "fuel", 1, 100.0, 100.0, 100.0, 120.0, 5, 0.1), ("p", "fuel", 2, 0.0, 0.0, 0.0, 9.0, 5, 0.1), ("p", "sensor", 3, 10.0, 10.0, 10.0, 99.0, 30, 0.0), ("p", "timing", 4, 20.0, 20.0, 20.0, 25.0, 3, 0.0)]
    d = spark.createDataFrame(rows, "proposal string, kind string, col int, cur double, base double, stock double, new double, count int, load double").withColumn("ceiling", F.lit(22.0)).withColumn("afr_floor", F.lit(11.5))
    got = {r.col: r for r in C.clamped(d).collect()}
    assert got[1].new == pytest.approx(103.0) and got[2].new == 0.0 and got[3].new == pytest.approx(14.0) and got[4].new == 20.0
    assert [a.clamp for a in got[4].audit] == ["ceiling", "timing"] and C.clamped(d.where("false")).count() == 0
    gated = C.clamped(d.withColumn("knock_active", F.lit(True)).withColumn("converged", F.lit(True)).withColumn("steady", F.lit(True)), "proposal").collect()
    assert {r.refused for r in gated} == {"knock"} and all(r.new == r.cur for r in gated)
    curve = spark.createDataFrame([("c", i, float(v), float(n)) for i, (v, n) in enumerate([(1, 1.5), (2, 1.2), (3, 9), (4, 4)])], "k string, col int, cur double, new double")
    out = [r.new for r in C.monotone(curve, ["k"]).orderBy("col").collect()]
    assert out == sorted(out) and len(set(out)) == 4 and out[0] == 1.5 and out[2] < 4


def test_estimator_finds_the_fault(spark):
    w = S.worlds(spark, 6)
    got = S.estimates(w, "world").join(w.select("world", "truth", F.col("size").alias("true_size")), "world").collect()
    assert all(r.fault == r.truth for r in got if r.reason is None) and sum(r.reason is None for r in got) >= 0.9 * len(got)
    ranked = S.hypotheses(w, "world").collect()
    first = {r.world: r for r in ranked if r["rank"] == 1}
    assert len(ranked) == len(S.KNOB) * len(first) and all(r.squares >= first[r.world].squares for r in ranked)
    assert all(first[r.world].fault == r.fault for r in got if r.reason is None)
    few = S.estimates(w.withColumn("t1", F.lit(None).cast("double")).withColumn("t2", F.lit(None).cast("double")), "world")
    assert {r.reason for r in few.collect()} == {"few points"}
    assert {r.reason for r in S.estimates(w.where("truth = 'maf_low'").withColumn("validated", F.lit(False)), "world").collect()} == {"baseline"}
    last = S.convergence(spark.createDataFrame([(1, 0.9, 1.0, 1.0)], "seed bigint, flow_ratio double, latency_ratio double, maf_ratio double"), 30).orderBy("iteration").collect()
    assert abs(last[-1].trim_pct) < abs(last[0].trim_pct) and all(abs(r.step) <= 0.03 + 1e-12 for r in last)


def test_judging(spark):
    text = "intro\n\n" + "\n\n".join("p%d " % i + "x" * 60 for i in range(10))
    parts = J.packed(text, 150, 10)
    assert len(parts) > 3 and all(len(p) <= 150 + 12 for p in parts) and J.packed("short", 150) == ["short"]
    rng = random.Random(6)
    for _ in range(60):
        t = "".join(rng.choices(["word ", "\n\n", "\n", "\n--- post ---\n", "\n## head\n", "long" * 30, " \n \n"], k=80))
        most = rng.choice([60, 150, 400])
        assert all(len(x) <= most and x.strip() for x in J.segments(t, most))
        assert sum(len(x) for x in J.segments(t, most)) <= len(t) and "".join("".join(J.segments(t, most)).split()).replace("-", "") in "".join(t.split()).replace("---post---", "").replace("-", "")
        assert all(len(x) <= most + 12 for x in J.packed(t, most, 10))
    assert J.packed("a" * 50 + "\n\n" + "b" * 50, 60, 0) == ["a" * 50, "b" * 50] and J.packed("a" * 50 + "\n\n" + "b" * 50, 60, 5)[1] == "aaaaa\n\n" + "b" * 50
    assert J.verdict('```json\n{"score": 4, "rationale": "ok"}\n```') == (4, "ok", None) and J.verdict('{"score": true, "rationale": "x"}')[0] == 1
    assert [J.verdict(x)[2] for x in (None, "{", "[]", '{"score": 9, "rationale": "x"}', '{"score": 3, "rationale": " "}', '{"score": 3, "rationale": "x", "pairs": [{}]}')] == ["empty", "no json", "no object", "score", "rationale", "pairs"]
    d = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")
    c = J.chunks(d, 150, 10)
    done = J.judged(c, lambda t: '{"score": 3, "rationale": "r"}' if "p1" in t else "bad")
    assert {r.error for r in done.collect()} == {None, "no json"} and J.remaining(c, done.where("error is null")).count() == done.where("error is not null").count()
    case = lambda v, e, u="", **k: J.answer_class(v, k.get("d"), e, u, 1.0, k.get("f"))
    assert case("450 mV", "0.45 V") == "exact" and case("5", "6", "V") == "dangerous_miss" and case(None, "6", f="length") == "truncated" and case("x", "6") == "unparseable"
    assert case("212 F", "100 C") == "unit_mismatch" and case("5 to 8 V", "5 to 7 V") == "range_mismatch" and case("", "6") == "no_answer" and case("6", "6", d=True) == "honest_decline" and case("250 300", "250") == "ambiguous_parse"


def test_stored_classes_are_compared_with_new_ones(spark, tmp_path):
    rows = [(1, ("450 mV", False), "0.45 V", "V", 1.0, "dangerous_miss", [7]), (2, ("5", False), "5", "V", 1.0, "exact", [7]), (3, (None, False), "5", "V", 1.0, None, None), (4, ("1 234", False), "1234", "rpm", 1.0, "exact", [8])]
    schema = "row_id bigint, answer struct<value string, must_retrieve boolean>, expected_value string, unit string, tolerance_pct double, answer_class string, retrieved_doc_ids array<bigint>"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/e2_answers.parquet")
    spark.createDataFrame([(7, "reads 450 mV"), (8, "at 1234 rpm")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.row_id: r[1:] for r in core.QUERIES["evl04_reclassified"](spark, str(tmp_path)).collect()}
    assert got[1] == ("dangerous_miss", "exact", "dangerous_miss", "cited", True)
    assert got[2] == ("exact", "exact", "exact", "blocked", False)
    assert got[3] == (None, "no_answer", "honest_decline", "declined", True)
    assert got[4][2:4] == ("exact", "cited") and len(got) == 4
    assert J.first_class("1,234 rpm", False, "1\u00a0234") == "exact" and J.first_class("n/a", False, "5") == "unparseable" and J.first_class("6", True, "5") == "honest_decline"
