import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tunemill.operators import runs, sets
from tunemill.plans import core


def _texts(rng: random.Random, texts: int, words: int) -> list[str]:
    made = [" ".join(f"w{rng.randrange(words)}" for _ in range(rng.randint(1, 160))) for _ in range(texts)]
    for t in made[: texts // 2]:  # some words put elsewhere, once or often
        for _ in range(rng.randint(1, 3)):
            w = t.split()
            for _ in range(rng.choice([1, 1, 2, 5])):
                w[rng.randrange(len(w))] = f"w{rng.randrange(words)}"
            made.append(" ".join(w[rng.choice([0, 0, 1, 9]) :]) or "one")
    return made + [made[3], made[3].upper(), "", "two words", "TWO words", "three more words"]


def _classed(rows: list, t: Fraction, strict: bool) -> dict[int, tuple[int, int]]:
    """By brute force."""
    have = {}
    for i, text in rows:
        w = re.findall(r"[^\W_]+", (text or "").lower())
        have[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    rep, parent, links = {}, {i: i for i in have}, dict.fromkeys(have, 0)
    for i, s in sorted(have.items()):
        if s:
            rep.setdefault(s, i)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, a in rep.items():
        for y, b in rep.items():
            shared, all_ = len(x & y), len(x | y)
            if a < b and (shared > t * all_ if strict else shared >= t * all_):
                links[a], links[b] = links[a] + 1, links[b] + 1
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (find(rep[s]), links[rep[s]]) if s else (i, 0) for i, s in have.items()}


# small: all runs in few buckets, texts in many rows, bitmaps in several groups
@pytest.mark.parametrize("t, strict, small", [(Fraction(4, 5), False, False), (Fraction(4, 5), False, True), (Fraction(3, 5), True, True), (Fraction(3, 10), False, False)])
def test_classes_of_runs_match_brute_force(spark, monkeypatch, t, strict, small):
    if small:
        for name, value in (("BUCKETS", 64), ("TEXTS", 7), ("DEALT", 500), ("PAIRS", 50), ("BITMAPS", 2_000)):
            monkeypatch.setattr(runs, name, value)
    rng = random.Random(7)
    rows = list(enumerate(_texts(rng, 90, 3_000) + _texts(rng, 30, 4))) + [(5_000, None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r["class"], r.links) for r in runs.near_duplicates(d, "doc_id", F.col("text"), t, strict=strict, without=True).collect()}
    want = _classed(rows, t, strict)
    assert got == want and sum(n > 0 for _, n in want.values()) > 20
    if strict:
        assert {r.doc_id for r in runs.near_duplicates(d, "doc_id", F.col("text"), t, strict=strict).collect()} == {i for i, text in rows if text}


def test_runs_of_texts_without_links_are_not_written(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    stock = [" ".join(f"w{rng.randrange(500)}" for _ in range(12)) for _ in range(60)]  # sentences that many texts have
    texts = [" ".join(rng.choice(stock) if rng.random() < 0.7 else " ".join(f"w{rng.randrange(500)}" for _ in range(12)) for _ in range(30)) for _ in range(400)]
    texts += [t.replace(t.split()[7], "other", 1) for t in texts[:5]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    compared, whole = [], sets.forest
    monkeypatch.setattr(sets, "forest", lambda reps, *more: compared.append(reps.count()) or whole(reps, *more))
    out = core.QUERIES["set01_shingles"](spark, str(tmp_path)).collect()
    assert len(out) == 405 and {r.doc_id for r in out if r.links} == {*range(5), *range(400, 405)}
    assert compared == [10]
