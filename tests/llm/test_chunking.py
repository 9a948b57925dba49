import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tunemill.llm import chunking


def check(text, most, overlap):
    ends, kinds, longest = chunking.best_cuts(text, most, overlap)
    assert ends[-1] == len(text) and ends == sorted(set(ends))
    begin = 0
    for k, end in enumerate(ends):
        start = begin - overlap if k else 0
        assert start >= 0 and end - start <= most
        begin = end
    assert "".join(text[a:b] for a, b in zip([0, *ends], ends)) == text
    return ends, kinds, longest


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word ", "\n", "\n\n", "# Head\n", "--- post 1 ---\n", "Sentence. ", "x" * 30, "日本。", "\r\n \t\r\n"]), min_size=30, max_size=120), st.integers(20, 200), st.integers(0, 19))
def test_pieces_keep_their_limits(parts, most, overlap):
    text = "".join(parts)
    if len(text) > most:
        check(text, most, overlap)


def test_best_of_all_choices():
    rng = random.Random(4)
    for _ in range(30):
        text = "".join(rng.choice(["aaa", "bb ", "\n\n", "c. ", "# d\n"]) for _ in range(24))
        most, overlap = 30, rng.choice([0, 4])
        where, kinds, _ = chunking.positions(text, most - overlap)
        share = len(text) / max(1, -(-(len(text) - overlap) // (most - overlap)))
        penalty = list(chunking.PENALTY.values())

        def cost(ends):
            total, at = 0.0, 0
            for n, e in enumerate(ends):
                if e - at > most - (overlap if n else 0) or (n == 0 and e < overlap and len(ends) > 1):
                    return float("inf")
                total += ((e - at - share) / share) ** 2 + (penalty[kinds[list(where).index(e)]] if e < len(text) else 0)
                at = e
            return total

        inner = [int(p) for p in where[1:-1]]
        best = min(cost([*c, len(text)]) for k in range(6) for c in itertools.combinations(inner, k))
        mine = cost(chunking.best_cuts(text, most, overlap)[0])
        assert mine <= best + 1e-9


def test_table(spark):
    long = "para one is here.\n\n" * 8
    rows = [(1, "k", long), (2, "k", "y" * 120), (3, "k", "short"), (4, "other", long), (5, None, long), (6, "k", None), (7, "k", ""), (8, "none", long), (9, "k", "z" * 200_000), (1, "k", long)]
    d = spark.createDataFrame([(*r, "cut?", 3) for r in rows], "doc_id bigint, kind string, text string, cut string, max_chars int")
    cfg = spark.createDataFrame([("k", 60, 10), ("k", 90, 20), ("none", None, 5), (None, 10, 1), ("other", 50, None)], "kind string, max_chars int, overlap_chars int")
    out = chunking.pieces(d, cfg).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {1, 2, 4, 9} and {r.cut for r in by[1]} == {"natural"} and {r.cut for r in by[2] + by[9]} == {"forced"}
    assert all(len(r.text) <= 60 for r in by[2]) and by[2][0].text[-10:] == sorted(by[2], key=lambda r: r.piece_no)[1].text[:10]
    assert all(r.n_pieces * 2 == len(by[1]) for r in by[1])
    assert chunking.pieces(d.where("false"), cfg).count() == 0 and chunking.pieces(d, cfg.where("false")).count() == 0
