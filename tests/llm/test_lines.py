import random

import pytest

from tunemill.llm import lines
from tunemill.llm.lines import LineCfg

SCHEMA = "doc_id bigint, text string, source string, key string, _src int, n_docs string"
NOTICE = "Put your mail address in the box and read on"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", 7, "x") for i, (t, s) in enumerate(rows)], SCHEMA)


def brute(rows, cfg):
    key = lambda x: k.lower() if len(k := "".join(c for c in x if c.isalpha())) >= cfg.min_letters else None
    of, seen = {}, {}
    for i, (t, s) in enumerate(rows):
        if s is None:
            continue
        s = s.strip().lower()
        of[s] = of.get(s, 0) + 1
        for k in {key(x) for x in (t or "").split("\n")} - {None}:
            seen.setdefault((s, k), set()).add(i)
    sure = {k for k, ids in seen.items() if len(ids) >= cfg.min_docs and len(ids) / of[k[0]] >= cfg.min_share}
    return {(i, n + 1) for i, (t, s) in enumerate(rows) if s is not None for n, x in enumerate((t or "").split("\n")) if (s.strip().lower(), key(x)) in sure}


@pytest.mark.parametrize("broadcast_rows", [50_000, 0])
def test_matches_brute_force(spark, broadcast_rows):
    rng = random.Random(5)
    pool = [f"{'abcdefgh'[i % 8] * 26} line {'xyz'[i % 3]}" for i in range(24)]
    rows = [("\n".join(rng.choice(pool if rng.random() < 0.5 else [f"own words {''.join(rng.choices('klmnop', k=30))}", "short", ""]) for _ in range(rng.randint(0, 9))), rng.choice(["A", " a ", "b", "B", "c", None])) for _ in range(400)]
    rows += [(None, "a"), ("", "b"), (None, None)] + rows[:5]
    cfg = LineCfg(capacity=4, broadcast_rows=broadcast_rows)
    table = docs(spark, rows).repartition(5)
    got = lines.repeated_positions(table, lines.repeated_lines(table, cfg), cfg)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, cfg))


def test_removes_and_leaves_the_rest(spark):
    rows = [(f"first {i}\r\n\n* {NOTICE.upper()} *\nlast  ", "Site ") for i in range(6)] + [(NOTICE, None), (None, "site"), ("", "site"), ("x" * 50_000, "site")]
    table = docs(spark, rows)
    out = {r.doc_id: r for r in lines.without_repeated(table, lines.repeated_lines(table)).collect()}
    assert len(out) == len(rows)
    assert out[2].text == "first 2\r\n\nlast  " and out[2].n_removed == 1
    assert out[6].text == NOTICE and out[7].text is None and out[8].text == "" and out[9].text == "x" * 50_000
    assert out[0].key == "clash" and out[0]._src == 7


def test_empty_table(spark):
    table = docs(spark, [("a", "b")]).where("doc_id < 0")
    found = lines.repeated_lines(table)
    assert found.count() == 0 and lines.repeated_positions(table, found).count() == 0 and lines.without_repeated(table, found).count() == 0


def test_summary_never_loses_a_frequent_line():
    import numpy as np

    rng = np.random.default_rng(1)
    s = lines.Summary(8, 0.05)
    for _ in range(50):
        keys = np.concatenate([rng.integers(10**6, 10**9, 400), np.repeat(np.arange(3), 5)])
        s.add(keys, 40)
    assert {0, 1, 2} <= set(s.keys.tolist()) and s.error <= 0.5 * 0.05 * s.docs
    assert all(250 - s.error <= s.counts[s.keys == k][0] <= 250 for k in range(3))
