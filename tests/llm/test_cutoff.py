import random

import pytest

from tunemill.llm import cutoff


def brute(rows, targets):
    out = set()
    for s, t, f in set(targets):
        scores = sorted({x for a, b, x in rows if (a, b) == (s, t) and x is not None and 1 <= x <= 5})
        every = [x for a, b, x in rows if (a, b) == (s, t) and x is not None and 1 <= x <= 5]
        if scores:
            c = max(c for c in range(1, 6) if sum(x >= c for x in every) / len(every) >= f)
            out.add((s, t, c, sum(x >= c for x in every)))
    return out


def test_documents(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice(["r", "c"]), rng.choice([None, 0, 1, 2, 3, 4, 5, 9])) for _ in range(700)]
    targets = [("a", "r", 0.3), ("a", "c", 1.0), ("b", "r", 0.0), ("b", "c", 0.803), ("zz", "r", 0.5), ("a", "r", 0.3)]
    d = spark.createDataFrame([(s.upper() + " ", t, x, 0.9, "n") for s, t, x in rows], "source string, tier string, judge_score int, target_frac double, scored string")
    k = spark.createDataFrame(targets + [(None, "r", 0.2), ("a", None, 0.2), ("b", "r", None)], "source string, tier string, target_frac double")
    assert {tuple(r) for r in cutoff.document_cutoffs(d, k).collect()} == brute(rows, targets)
    assert cutoff.document_cutoffs(d.where("false"), k).count() == 0
    assert cutoff.document_cutoffs(d, k.where("false")).count() == 0


@pytest.mark.parametrize("sorted_at_most", [100_000, 40])
def test_real_scores_and_ties(spark, sorted_at_most):
    rng = random.Random(3)
    rows = [("hot", rng.choice([rng.gauss(0, 1), 0.25])) for _ in range(6000)] + [("cold", float(i % 3)) for i in range(10)] + [("hot", float("nan")), ("hot", None), (None, 1.0)]
    targets = [("hot", 0.3), ("hot", 0.9), ("cold", 0.5), ("hot", 1.5)]
    got = cutoff.cutoffs(spark.createDataFrame(rows, "g string, score double"), spark.createDataFrame(targets, "g string, target_frac double"), ["g"], accuracy=200, sorted_at_most=sorted_at_most).collect()
    for r in got:
        every = sorted((x for g, x in rows if g == r.g and x is not None and x == x), reverse=True)
        best = next(i + 1 for i in range(len(every)) if (i + 1) / len(every) >= r.target_frac)
        assert r.cutoff == every[best - 1] and r.kept == sum(x >= r.cutoff for x in every) and r.scored == len(every)
    assert len(got) == 3
