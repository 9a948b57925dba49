from tunemill.llm import spam

PROSE = "The wideband held 12.27 with the heater on although the ECU was commanding 12.77 for most of the run.\nBefore you check the ground points, make sure that the sensor reads 6.53 V with the key on.\n"
WORDS = ["boost gauge", "turbo kit", "free shipping", "buy now", "fuel pump", "remap"]
PAGES = {
    "list": ", ".join(WORDS * 8),
    "run": "boost gauge turbo kit boost gauge boost gauge turbo kit " * 10,
    "links": "\n".join(f"- {w} https://shop{i}.example/item/{i}" for i, w in enumerate(WORDS * 3)),
    "marked": "\n".join(f"[{w}](https://a.example/{i})" for i, w in enumerate(WORDS * 3)),
    "tags": "\n".join(" ".join("#" + w.replace(" ", "") for w in WORDS) for _ in range(6)),
    "offers": "\n".join(f"{w} SKU{i}8 | turbo kit | {i}9.99 EUR" for i, w in enumerate(WORDS * 3)),
    "towns": "\n".join(f"remap {t}, remap in {t} turbo kit buy now!" for t in ("dunmere", "fallow", "ilsford") * 4),
    "ja": ", ".join(["送料無料", "過給機", "中古品", "格安"] * 12),
}
PLAIN = {
    "prose": PROSE * 4,
    "values": "| rpm | load | afr |\n" + "\n".join(f"{i}07 | {i}.3 | 12.{i}" for i in range(30)),
    "definitions": "\n".join(f"Odd injector table 0x6D8{i}F uint8" for i in range(20)),
    "listing": "\n".join(f"zBins = t6{i}, xBins = rpm4, yBins = load2 ; Noisy sensor at hot idle" for i in range(20)),
    "contents": "\n".join(f"2.{i} Boost valve, knock under load .......... {i}" for i in range(20)),
    "dump": "\n".join("C9F5607C613695C0C072AC81DEDFFAEF9518C020" for _ in range(10)),
    "reply": "+1 same here",
    "half": PROSE * 6 + ", ".join(WORDS * 5),
    "ja prose": "同じ症状の方がいれば、全開加速中に取った記録を見せていただけると助かります。\n" * 8,
}


def test_pages(spark):
    rows = [(i, t, "EN" if "ja" not in k else "ja-JP", "clash") for i, (k, t) in enumerate({**PAGES, **PLAIN}.items())]
    rows += [(900 + i, PROSE * 3, "en", "x") for i in range(40)] + [(950 + i, PLAIN["ja prose"], "ja", "x") for i in range(20)] + [(990, None, None, "x"), (991, "", "en", "x"), (992, "word " * 60_000, None, "x"), (0, PAGES["list"], "en", "again")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, spam_share string")
    got = sorted(r.doc_id for r in spam.stuffed(d).collect())
    assert got == sorted([0, *range(len(PAGES)), 992])
    assert spam.stuffed(d.where("false")).count() == 0


def test_every_measure_decides():
    usual = [0.16, 0.5, 0.5, 0.12, 0.5, 0.4]
    share = lambda text, limits=usual: spam.spam_share(spam.measures(text)[1], len(text) + 1, limits)
    without = lambda k: [(-1.0 if j == 0 else 9.0) if j == k else x for j, x in enumerate(usual)]
    assert all(share(t) > 0.5 for k, t in PAGES.items() if k != "ja") and all(share(t) <= 0.5 for k, t in PLAIN.items() if k != "ja prose")
    for k, lost in ((0, ("list", "run", "offers", "towns")), (1, ("marked",)), (4, ("list", "run"))):
        assert all(share(PAGES[name], without(k)) <= 0.5 for name in lost), k
    assert share(PAGES["run"], without(3)) > 0.5 >= share(PAGES["run"], [*usual[:3], 9.0, 0.5, 9.0])  # only its word pairs tell
    short = "boost gauge, turbo kit, boost gauge\nturbo kit, remap shop, remap shop"
    assert share(short) > 0.5  # twice is often on a page of few words
    assert list(spam._recurring([["turbo", "kit", "turbo", "kit"], ["other"]])) == [(1.0, 2 / 3), (0.0, 0.0)]


def test_a_threshold_lies_between_two_groups():
    import numpy as np

    n = np.zeros(51)
    n[[2, 3, 40, 44]] = [5, 9, 7, 4]
    assert 0.06 < spam.valley(n) <= 0.8 and spam.valley(np.zeros(51)) == 1.0
    assert spam.limit(0, n) == 0.5 * 3.5 / 50 and spam.limit(3, n) == 0.88
