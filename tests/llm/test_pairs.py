import pytest

from tunemill.llm import pairs

EN = "Here is what the logged samples show about this engine and its tables.\n\n1 | 2 | 3\n\nWhat is wrong with the calibration, and how sure are you?"
DE = "Der Motor läuft mit einer Kalibrierung für einen anderen Hubraum.\n\nWas stimmt mit dieser Kalibrierung nicht, und wie begründest du das?"
GOOD = "The injector is too small for this engine, and the trims show it on all of the samples. I am not able to see boost data here, so this covers vacuum only."

CASES = [
    ("empty", None, EN), ("empty", " \n", EN), ("empty", "...", EN), ("empty", '{"fault": null}', EN), ("empty", "```json\n{}\n```", EN), ("empty", "​", EN),
    ("copy", EN, EN), ("copy", EN.upper(), EN), ("copy", "User: " + EN, EN), ("copy", "What is wrong with the  calibration, and how sure are you?", EN), ("copy", '"' + EN + '"', EN),
    ("copy", "What is wrong with the calibration, and how sure are you?", EN + " Please answer in French."),
    ("refusal", "I'm sorry, but I can't help with this. I hope you understand.", EN), ("refusal", "Leider kann ich dazu nichts sagen. Bitte frage einen Fachbetrieb.", DE),
    ("refusal", "Il ne m'est pas permis de donner un diagnostic.", EN), ("refusal", "Lo siento, pero no puedo ayudar con esa petición.", EN),
    ("truncated", '{"fault": "maf_', EN), ("truncated", "The injector is too small for this engine, and the trims show it on", EN), ("truncated", "```json\n{\"a\": 1", EN),
    ("language", "Der Klopfsensor ist nicht in Ordnung, und die Werte sind auch bei Volllast zu hoch.", EN), ("language", GOOD, DE),
    (None, GOOD, EN), (None, '{"fault": "maf_low"}', EN), (None, '```json\n{"fault": "maf_low"}\n```', DE), (None, "maf_low", EN), (None, "maf_low", None),
    (None, "Der Klopfsensor ist nicht in Ordnung, und die Werte sind auch bei Volllast zu hoch.", EN + " Please answer in German."),
    (None, GOOD + "\nConfidence: 85%", EN), (None, "> What is wrong with the calibration, and how sure are you?\n\n" + GOOD, EN), (None, GOOD, None),
    (None, "Sorry for the long answer. " + GOOD, EN), (None, GOOD + " " + GOOD * 400, EN),
]


def test_cases(spark):
    rows = [(i, c, p, "maf_low", "stop", "clash") for i, (_, c, p) in enumerate(CASES)]
    d = spark.createDataFrame(rows, "row_id bigint, content string, prompt string, answer string, finish_reason string, defect string")
    got = {r.row_id: r.defect for r in pairs.defects(d.unionByName(d.where("row_id < 3"))).collect()}
    assert {i: got.get(i) for i in range(len(CASES))} == {i: k for i, (k, _, _) in enumerate(CASES)}
    assert pairs.defects(d.where("false")).count() == 0
    assert sum(r.row_id == 0 for r in pairs.defects(d.unionByName(d.where("row_id < 3"))).collect()) == 2


@pytest.mark.parametrize(("want", "content", "prompt"), [
    (True, "Why is it lean?", "Why is it lean?\nAnswer as JSON."), (True, "Name the cause.", "1 | 2\n\nName the cause.\nAnswer as JSON."), (True, "why?", "Why?"), (True, "maf_low", "maf_low"),
    (True, "Why is it lean?", "1 | 2\n\nWhy is it lean?\n\nAnswer as JSON."), (True, "S15 is what I mean.", "".join(f"S{i} is what I mean. " for i in range(16))),
    (True, "".join(f"s{i} is what I mean. " for i in range(14)), "".join(f"S{i} is what I mean. " for i in range(20))),
    (True, "Sure, here is once more the question which you asked me to look at in these logs: Why is it lean?", "Why is it lean?"), (True, "Thanks for sharing all of your logs with me today. Why is it lean?", "Why is it lean?"),
    (False, "maf_low", "Pick one:\nmaf_low\nmaf_high"), (False, "I wonder why?", "Rows\n\nWhy?"), (False, GOOD + " Why is it lean?", "Why is it lean?"), (False, "1 | 2 | 3", EN), (False, "", "Why?"),
])
def test_copies_by_position(want, content, prompt):
    assert pairs.is_copy(content, prompt) is want


def test_the_compression_decides_copies(spark, monkeypatch):
    rows = [(i, c, p, "maf_low") for i, (_, c, p) in enumerate(CASES)]
    d = spark.createDataFrame(rows, "row_id bigint, content string, prompt string, answer string")
    copies = {i for i, (k, _, _) in enumerate(CASES) if k == "copy"}
    assert all(pairs.unexplained(CASES[i][1], CASES[i][2]) <= 0.1 for i in copies) and pairs.unexplained(GOOD, EN) > 0.6
    assert pairs.unexplained("no", EN) == 0 and pairs.unexplained("", EN) == 0 and pairs.unexplained(GOOD, "") == 1
    found = {r.row_id for r in pairs.defects(d).where("defect = 'copy'").collect()}
    assert found == copies and 0 < pairs.copy_share(spark.createDataFrame([(0.0,), (0.02,), (0.9,), (1.0,), (None,)], "unexplained double")) <= pairs.COPIED
    monkeypatch.setattr(pairs, "copy_share", lambda judged: -1.0)
    assert pairs.defects(d).where("defect = 'copy'").count() == 0


def test_contexts_are_counted_alike_beyond_the_limit(spark):
    texts = [GOOD + " Confidence: 85%", GOOD + " Confidence: 90%", "The injector is too small for", "It is too small for", "We saw 12.", "AFR 14.7"] * 2
    d = spark.createDataFrame([(i, t, EN, None) for i, t in enumerate(texts)], "row_id bigint, content string, prompt string, answer string")
    assert sorted(pairs.defects(d).collect()) == sorted(pairs.defects(d, asked_at_once=0).collect())


def test_an_option_that_is_the_answer_is_no_copy():
    assert not pairs.is_copy("The injector is too small.", "Pick one.\nThe injector is too small.\nThe pump is worn.", "The injector is too small.")


@pytest.mark.parametrize(("want", "text"), [
    (True, "I'm sorry, but I can't help with this. " * 10), (True, "I can't comment on these 300 samples."), (True, "Leider kann ich zu den 12 Tabellen nichts sagen."),
    (False, "The trims cannot come from the sensor, they fall from 33.6 to 12.1 at 666 rpm."), (False, GOOD),
])
def test_refusals_of_any_length(want, text):
    assert pairs.is_refusal(text) is want


@pytest.mark.parametrize("text", ["", "a", GOOD, "x" * 100_000, "1. 2. 3."])
def test_any_text(text):
    for p in (None, "", EN):
        pairs.judge(text, p, None)
