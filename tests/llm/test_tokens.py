import os
import random

import numpy as np
import pytest

from tunemill.llm import budget, encode, mix, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file")
PARTS = ["a", "b", "s", "'s", "'", "'ll", " ", "  ", "\n", "\t", "1", "23", "。", "日本", "語", "é", "—", "!!", "..", "#", "the", "🚗", " ", "\r\n", "​"]


#: A sentence of words in each script, and one of words that end in accented letters.
SCRIPTS = {
    "Cyrillic": "Датчик детонации исправен, но смесь бедная; проверьте давление топлива. ",
    "Arabic": "مستشعر الطرق يعمل، لكن الخليط فقير؛ افحص ضغط الوقود. ",
    "Thai": "เซ็นเซอร์น็อคทำงานปกติแต่ส่วนผสมบางเกินไปกรุณาตรวจสอบแรงดันน้ำมันเชื้อเพลิง",
    "Hangul": "노크 센서는 정상이지만 혼합기가 희박합니다. 연료 압력을 확인하십시오. ",
    "Devanagari": "नॉक सेंसर ठीक है, लेकिन मिश्रण पतला है; ईंधन दबाव जाँचें। ",
    "Greek": "Ο αισθητήρας κρούσης λειτουργεί, αλλά το μείγμα είναι φτωχό. ",
    "Hebrew": "חיישן הנקישות תקין, אבל התערובת דלה; בדוק את לחץ הדלק. ",
    "accented": "café là-bas où é à ü ö é, naïveté ça déjà été allé. ",
}


def texts(seed=1, n=120):
    rng = random.Random(seed)
    out = ["".join(rng.choices(PARTS, k=rng.randint(1, 300))) for _ in range(n)]
    for _ in range(n // 6):
        out += ["".join(rng.choices("abcdest", k=rng.randint(200, 3000))), "".join(rng.choices("日本語車点火", k=rng.randint(200, 2000))), " " * rng.randint(100, 2000) + "x", rng.choice(["a", "12", "!"]) * rng.randint(200, 2000)]
    out += ["".join(rng.choices([*"".join(SCRIPTS.values()), " ", "'"], k=rng.randint(50, 900))) for _ in range(n // 6)]
    return out + [v * 12 for v in SCRIPTS.values()] + ["<|endoftext|>", "x" * 70_000, " " * 50_000, " \n" * 9_000 + "y", "word " * 20_000]


def plain(text):
    """One text as a whole, through the other library."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t.encode(text, add_special_tokens=False).ids


def test_encode_text_agrees_with_the_other_library():
    enc = tokens.encoder()
    for t in texts(4, 60):
        assert tokens.encode_text(enc, t) == plain(t)


def test_proven_cuts_keep_the_tokens():
    enc = tokens.encoder()
    for t in texts(2):
        for size in (16, 200, 4096):
            ends = tokens.proven_cuts(t, size)
            assert ends[-1] == len(t) and ends == sorted(set(ends))
            assert [i for a, b in zip([0, *ends], ends) for i in tokens.encode_text(enc, t[a:b])] == tokens.encode_text(enc, t)


def test_tree_is_exact():
    enc = tokens.encoder()
    for t in texts(3):
        for size in (97, 1000):
            nodes = [encode.Node(t[i : i + size], np.array(tokens.encode_text(enc, t[i : i + size]), np.int32)) for i in range(0, len(t), size)]
            assert encode.tree(enc, nodes).tolist() == tokens.encode_text(enc, t)


@pytest.mark.parametrize("script", SCRIPTS)
def test_every_script_is_cut_and_joined(script, monkeypatch):
    enc, text = tokens.encoder(), SCRIPTS[script] * 600
    ends = tokens.proven_cuts(text, 1024)
    assert len(ends) > len(text) // 2048
    assert [i for a, b in zip([0, *ends], ends) for i in tokens.encode_text(enc, text[a:b])] == tokens.encode_text(enc, text)
    size, again = 4096, 0
    leaves = [text[i : i + size] for i in range(0, len(text), size)]
    out: list[int] = []
    tail = ""
    for k, leaf in enumerate(leaves):
        ids = np.array(tokens.encode_text(enc, leaf), np.int32)
        i, j, head, left = encode.edges(enc, leaf, ids, k == 0, k == len(leaves) - 1)
        again += len(tail) + len(head or "")
        out += (tokens.encode_text(enc, tail + head) if head else []) + ids[i:j].tolist()
        tail = left or ""
    assert out == tokens.encode_text(enc, text) and again < 0.1 * len(text)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "EN-gb", "d", e, "clash") for i, (t, s, e) in enumerate(rows)], "doc_id bigint, text string, source string, lang string, domain string, token_est int, ids string")


def test_ids_and_round_trip(spark):
    rows = [(t, "s", 1) for t in texts(6, 30)] + [(None, "s", 1), ("", "s", 1)]
    d = frame(spark, rows)
    d = d.unionByName(d.where("doc_id % 7 = 0"))
    coded = encode.encode(d, leaf_chars=500, long_chars=900)
    enc = tokens.encoder()
    got = coded.collect()
    assert len(got) == d.count()
    for r in got:
        assert list(r.ids) == (tokens.encode_text(enc, rows[r.doc_id][0]) if rows[r.doc_id][0] else [])
    back = {r.doc_id: r.text for r in encode.decode(coded).collect()}
    assert all(back[i] == (t or "") for i, (t, _, _) in enumerate(rows))
    assert encode.encode(d.where("false")).count() == 0


def test_counts_and_unreliable_estimates(spark):
    enc = tokens.encoder()
    rows = [("word " * 60, "A ", None), ("word " * 60, "a", 0), ("word " * 60, "a", 60), ("word " * 60, None, 500), ("word " * 60, "a", 15), ("short", "a", 99), (None, "a", None), ("", "b", 4), ("word, " * 9_000, "b", 18_000)]
    d = frame(spark, rows + rows[-1:])
    got = budget.document_tokens(d, piece_chars=800).collect()
    assert len(got) == 10
    for r in got:
        assert r.n_tokens == len(tokens.encode_text(enc, rows[min(r.doc_id, 8)][0] or ""))
    assert sorted(r.doc_id for r in got if r.unreliable) == [0, 1, 3, 4]
    slices = {(r.level, r.source): r for r in budget.budget(budget.document_tokens(d)).collect()}
    assert slices[0, None].docs == 10 and slices[1, "a"].docs == 6 and slices[1, None].docs == 1 and slices[0, None].tokens == sum(r.n_tokens for r in got)
    assert budget.document_tokens(d.where("false")).count() == 0


def test_mix(spark):
    rng = random.Random(8)
    rows = [("tok " * rng.randint(0, 40) or None, rng.choice(["a", "A", "b", None]), 1) for _ in range(200)] + [("tok " * 20, "c", 1)]
    d = frame(spark, rows)
    t = spark.createDataFrame([(1, "a", 0.2, 3), (1, "b", 0.3, 2), (1, "C ", 0.5, 2), (2, "a", 1.0, 1), (2, "gone", 0.1, 3), (3, "b", None, None), (None, "a", 1.0, 1), (1, "a", 0.2, 3)], "mix_id int, source string, weight double, max_repeats int")
    tok = mix.mixed_tokens(d, t)
    plan = mix.plan(tok, t)
    by = {(r.mix_id, r.source): r for r in plan.collect()}
    have = {s: sum(r.n_tokens for r in tok.collect() if r.source == s) for s in "abc"}
    assert by[1, "a"].t == have["a"] and by[1, "a"].total == sum(have.values()) and by[1, "c"].due > by[1, "c"].most and by[2, "gone"].most == 0
    for start in (None, {"a": 1.6, "b": 0.4}):
        drawn = mix.positions(tok, plan, start, buckets=8).collect()
        assert drawn == sorted(drawn, key=lambda r: (r.mix_id, r.position)) and all(0 <= r.position <= 1 for r in drawn)
        for (m, s), p in by.items():
            own = [r for r in drawn if (r.mix_id, r.source) == (m, s)]
            sizes = [r.n_tokens for r in own]
            assert max([0, *(r.repeat_no for r in own)]) <= p.max_repeats and len({(r.doc_id, r.repeat_no) for r in own}) == len(own)
            if p.due > p.most:
                assert sum(sizes) == p.most
            else:
                assert not own or p.due <= sum(sizes) < p.due + max(sizes)
        short = mix.shortfall(mix.seats(tok, plan, start, buckets=8), plan, start).collect()
        assert sorted((r.mix_id, r.source) for r in short) == sorted(k for k, p in by.items() if p.due > p.most) and {(1, "c"), (2, "gone")} <= {(r.mix_id, r.source) for r in short}
        assert all(r.runs_dry < 1 and (r.last is None or r.last <= r.runs_dry) for r in short)
    # A draw that loses copies is short: the rows come from the seats, not from the formula.
    half = mix.seats(tok, plan).where("mix_id <> 1 or source <> 'b' or doc_id % 2 = 0")
    assert (1, "b") in {(r.mix_id, r.source) for r in mix.shortfall(half, plan).collect()}
    shares = mix.shares(mix.seats(tok, plan), plan).collect()
    assert abs(sum(r.share for r in shares if r.mix_id == 1) - 1) < 1e-4 and len(shares) == len(by)
    assert mix.plan(mix.mixed_tokens(d.where("false"), t), t).where("t > 0").count() == 0
    assert mix.plan(mix.mixed_tokens(d, t.where("false")), t.where("false")).count() == 0
