import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_retrieval import written
from tunemill.operators import sets


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("first, own, shared", [(3, 12, 4), (1, 1, 1)])
@pytest.mark.parametrize("words", [25, 2_000])  # nearly all pairs share their rarest words; nearly none do
def test_links_of_two_blocks_match_brute_force(monkeypatch, same, first, own, shared, words):
    for name, value in (("FIRST", first), ("OWN", own), ("SHARED", shared)):
        monkeypatch.setattr(sets, name, value)
    rng = random.Random(11)
    made = [set(rng.sample(range(words), rng.randint(1, 20))) for _ in range(120)]
    made += [(s | {rng.randrange(words)}) - {rng.choice(sorted(s))} or {0} for s in made]
    made = sorted({frozenset(s) for s in made}, key=lambda s: (len(s), sorted(s)))
    blocks = [made, made] if same else [made[: len(made) // 2], made[len(made) // 2 :]]

    def packed(block):
        known, items = np.unique([x * 7919 for s in block for x in sorted(s)], return_inverse=True)
        return np.array([len(s) for s in block], np.int32), known, items.astype(np.uint16)

    for t, strict in ((Fraction(3, 5), True), (Fraction(3, 5), False), (Fraction(4, 5), False)):
        got = {(int(i), j): (int(s), int(n)) for j, at, shares, both in sets._found(*map(packed, blocks), same, t.numerator, t.denominator, strict) for i, s, n in zip(at, shares, both)}
        want = {}
        for j, b in enumerate(blocks[1]):
            for i, a in enumerate(blocks[0][:j] if same else blocks[0]):
                like = Fraction(len(a & b), len(a | b))
                if like > t or (like == t and not strict):
                    want[i, j] = len(a & b), len(a) + len(b)
        assert got == want and (len(want) > 2 or not same)


@pytest.mark.parametrize("least", [2_048, 100])
def test_links_that_all_sets_have_are_not_shuffled(spark, monkeypatch, least):
    monkeypatch.setattr(sets, "LEAST", least)
    n, common = 500, " ".join("common" + c for c in "abcdefghijklmnopqrst")
    own = F.translate(F.format_string("%03d", "id"), "0123456789", "abcdefghij")
    rows = spark.range(n).select((F.col("id") + 5).alias("doc_id"), F.concat(F.lit(common + " own"), own).alias("text"))
    items, before = sets.words(F.col("text")), written(spark)
    assert sets.links(sets.classes(rows, "doc_id", items)[1], Fraction(3, 5), strict=True).count() == n * (n - 1) // 2
    out = sets.near_duplicates(rows, "doc_id", items, Fraction(3, 5), strict=True).collect()
    assert len(out) == n and {(r["class"], r.links) for r in out} == {(5, n - 1)}
    assert written(spark) - before < n * (n - 1) / 4


def test_classes_of_a_chain_keep_estimates_short(spark):
    n = 3_000
    nodes, edges = spark.range(n).select(F.col("id").alias("rep")), spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    out = sets.components(nodes, edges)
    assert {r["class"] for r in out.collect()} == {0}
    assert out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 63


def test_items_are_found_once_for_each_row(spark):
    seen = spark.sparkContext.accumulator(0)

    def split(text):
        seen.add(1)
        return None if text is None else [hash(w) for w in sorted(set(text.split()))]

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c d", "b a d c", "a b c d e", "x", "", None])], "doc_id bigint, text string")
    out = sets.near_duplicates(rows, "doc_id", F.udf(split, "array<bigint>")("text"), Fraction(3, 5), without=True).collect()
    assert sorted((r.doc_id, r["class"], r.links) for r in out) == [(0, 0, 1), (1, 0, 1), (2, 0, 1), (3, 3, 0), (4, 4, 0), (5, 5, 0)]
    assert seen.value == 6
