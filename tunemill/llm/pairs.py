"""Prompt and response pairs whose response is of no use, with the kind of defect.

One defect per row, the first that holds:

* `empty`: null, or without a letter or digit, or JSON (fenced or not) without any value.
* `copy`: its last part compresses to next to nothing with the prompt as the dictionary of zstandard. The measure is the
  share of the part that the prompt leaves unexplained: 0 costs what the part costs with itself as dictionary, 1 what it
  costs alone. The share under which a response copies is where the shares of all responses fall into two groups, at most
  COPIED. A check by position follows: the response is the prompt, or a stretch of whole lines or sentences of it with its
  question, apart from case, white space, quotes and a prefix: a few words, courtesies, or a clause that a colon ends.
* `refusal`: some sentence declines by the dictionary of its language, and no other says anything but courtesies.
* `truncated`: broken JSON or an open fence; or the text ends without an end of a sentence and a model of terminal
  contexts finds that what it ends with is not what ends a line. The model counts, over all responses, how often the last
  three tokens end a line and how often a line goes on after them; contexts too rare to tell fall back on the line's shape.
* `language`: by dictionaries of function words and by script it is in a language that is neither the prompt's nor one
  that the prompt asks for. JSON and fenced parts have no language.

finish_reason and answer are not used but for bare answers, which are complete: a response that is the answer or one of the
words of the prompt is no broken sentence. A null prompt can't be copied and has no language. Rows are judged one by one:
repeated rows come out repeated.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunemill.llm.histograms import valley
from tunemill.session import settle, small

#: Common function words by language.
FUNCTION_WORDS = {
    "en": "the a an of to and in is are was be this that with it for on by at from which you what how these not as but or when your have has if so only than then its into their they we i can should".split(),
    "de": "der die das und ist ein eine einen einem einer im in zu mit den dem des nicht auf für von bei sich aber wird auch oder als nach wie was welcher aus ich man dass sind vom zum zur".split(),
    "fr": "le la les des du de un une et est dans pour que qui ce se pas plus sur avec au aux ne en il nous ou après quelle ces ont cette sont par je vous mais".split(),
    "es": "el la los las de del un una y es en que con por para no se al lo su más como pero qué estos uno son cuando hay este esta sin ya muy".split(),
    "it": "il lo la gli le di del della un una e è in che con per non si al come ma sono più questo questa dal nella anche ho".split(),
    "pt": "o a os as de do da dos das um uma e é em que com por para não se ao como mas são mais este esta na no nos já muito".split(),
    "nl": "de het een en is in van op te met voor niet dat die zijn aan bij ook maar als wordt dan uit er naar om".split(),
}
#: How a prompt names a language it asks for.
LANGUAGE_NAMES = {
    "en": "english|englisch|anglais|inglés|ingles|inglese|engels",
    "de": "german|deutsch|allemand|alemán|aleman|tedesco|duits",
    "fr": "french|französisch|francais|français|francés|frances|francese|frans",
    "es": "spanish|spanisch|espagnol|español|espanol|spagnolo|spaans",
    "it": "italian|italienisch|italien|italiano|italiaans",
    "pt": "portuguese|portugiesisch|portugais|portugués|português|portoghese|portugees",
    "nl": "dutch|niederländisch|néerlandais|neerlandés|olandese|nederlands",
}
#: How a sentence declines, by language.
REFUSALS = {
    "en": r"\b(?:can['’]?t|cannot|can not|could not|unable to|not able to|won['’]t|will not|may not|must not|must decline|have to (?:pass|decline|refuse)|do not (?:give|provide|offer|answer)|don['’]t (?:give|provide|offer|answer)|not (?:be )?appropriate|not (?:allowed|permitted|comfortable|willing)|against my|outside (?:of )?(?:what|my)|nothing i can|no (?:answer|diagnosis|advice|comment) (?:will|can)|i (?:refuse|decline)|prefer not|rather not)\b",
    "de": r"\b(?:nicht (?:helfen|beantworten|beraten|möglich|erlaubt|gestattet|dazu äußern)|(?:kann|darf|werde|möchte) ich (?:[\w ]+ )?(?:nicht|nichts|keine[nrms]?)|ich (?:kann|darf|werde|möchte) (?:[\w ]+ )?(?:nicht|nichts|keine[nrms]?)|ablehnen|lehne ich|ich lehne|gebe ich keine|ich gebe keine|darf ich keine)\b",
    "fr": r"(?:\bne (?:peux|puis|suis|souhaite|saurais|donne)\b[^.!?]*\b(?:pas|aucun|rien)\b|\bne puis\b|\brefuse\b|(?:n['’]|ne m['’]|ne nous )est pas (?:permis|possible|autorisé)|\bdécline\b|\bpas autorisée?\b|m['’]est (?:interdit|impossible))",
    "es": r"\b(?:no (?:puedo|estoy autorizad[oa]|doy|me es posible|me está permitido|debo|voy a|quiero)|me niego|rechazo|declino|prefiero no)\b",
    "it": r"\b(?:non (?:posso|sono in grado|mi è)|rifiuto)\b",
    "pt": r"\b(?:não (?:posso|estou autorizad[oa]|consigo)|recuso)\b",
    "nl": r"\b(?:kan ik (?:\w+ )*niet|ik kan (?:\w+ )*niet|mag ik niet|weiger)\b",
}
_REFUSAL = re.compile("|".join(f"(?:{p})" for p in REFUSALS.values()), re.I)
#: Courtesies that say nothing about the matter.
_COURTESY = re.compile(
    r"(?i)\b(?:hello|hi|thanks?|sorry|apolog\w+|hope|regards|please (?:see|consult|ask|contact|visit|talk|speak)|is there|anything else|another topic|something else|feel free|understand"
    r"|hallo|danke|leider|bitte|tut mir leid|verständnis|werkstatt|fachbetrieb|bonjour|merci|désolée?|veuillez|adressez|voyez|consultez|garage|compréhension"
    r"|hola|gracias|lo siento|consulta|consulte|acud[ea]|taller|comprensión|profesional|professionn?el|mechanic|technician|ciao|grazie|olá|obrigad[oa])\b"
)
#: Words and verb forms of the first person, and nouns that decline without it.
_PERSON = re.compile(r"(?i)\b(?:i|we|me|my|us|ich|wir|mir|uns|je|j|m|nous|puedo|estoy|doy|debo|voy|quiero|niego|rechazo|declino|prefiero|posso|sono|rifiuto|estou|consigo|recuso|ik|weiger|no (?:answer|diagnosis|advice|comment))\b")
_WORD = re.compile(r"[^\W\d_]+")
_FENCE = re.compile(r"```[^\n`]*\n?(.*?)(?:```|\Z)", re.S)
_TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[^\w\s]|_")
_SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)\]*_]*$")
_LABELLED = re.compile(r"^[\W_]*[^\W\d_][^:\n]{0,30}\s?:\s*\S[^\n]{0,20}$")
_LANGUAGES = {w: tuple(k for k, v in FUNCTION_WORDS.items() if w in v) for words in FUNCTION_WORDS.values() for w in words}
_SCRIPTS = {"ja": "ぁ-ヿ", "zh": "一-鿿", "ko": "가-힣", "ru": "Ѐ-ӿ", "el": "Ͱ-Ͽ", "ar": "؀-ۿ"}
_SCRIPTED = re.compile(f"[{''.join(_SCRIPTS.values())}]")
_IN_SCRIPT = {k: re.compile(f"[{v}]") for k, v in _SCRIPTS.items()}
_ASKED = {k: re.compile(rf"(?i)\b(?:in|auf|en|au|op|em)\s+(?:{v})\b") for k, v in LANGUAGE_NAMES.items()}


def _no_value(x) -> bool:
    if isinstance(x, dict):
        return all(map(_no_value, x.values()))
    if isinstance(x, list):
        return all(map(_no_value, x))
    return x is None or (isinstance(x, str) and not re.search(r"[^\W_]", x))


def json_state(text: str) -> str:
    """`none` if the text is no JSON object or list, else `empty`, `whole` or `broken`."""
    body = text.strip()
    if body.startswith("```"):
        m = _FENCE.match(body)
        inner = m.group(1).strip()
        if not inner:
            return "empty"
        if m.end() < len(body) or inner[0] not in "{[":
            return "none"
        if not body.endswith("```") or len(body) < 6:
            return "broken"
        body = inner
    if not body or body[0] not in "{[":
        return "none"
    try:
        return "empty" if _no_value(json.loads(body)) else "whole"
    except ValueError:
        return "broken"


def _flat(text: str) -> str:
    return " ".join(text.lower().split())


_QUOTES = "\"'“”«»„`*_> "
#: The greatest share that the prompt may leave unexplained of a copy, the bins of its counts, and the level of compression.
COPIED, BINS, LEVEL = 0.5, 50, 3


def _cost(part: bytes, dictionary: bytes) -> int:
    known = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(dictionary) >= 8 else None
    return len(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False).compress(part))


def unexplained(content: str, prompt: str) -> float:
    """The share of the last part of content that costs bytes although the prompt is known: 0 for a copy, about 1 without relation.

    A part begins after the end of a sentence, a colon or a line feed. Parts too short for a match cost the same with any
    dictionary; their share is 0, which leaves them to the check by position.
    """
    part = next((x for y in reversed(re.split(r"(?<=[.!?:。！？：])\s+|\n+", content)) if (x := _flat(y).strip(_QUOTES))), "").encode()
    alone, least = _cost(part, b""), _cost(part, part)
    if alone <= least:
        return 0.0
    return min(1.0, max(0.0, (_cost(part, _flat(prompt).encode()) - least) / (alone - least)))


def is_copy(content: str, prompt: str, answer: str | None = None) -> bool:
    """Is content the prompt, or a stretch of its sentences with its question, but for case, white space, quotes and a prefix?

    Stretches are met by position: from each end of a sentence where content could end, back over the sentences before it
    as long as they agree. With the question means: the whole prompt, or with a sentence that ends in a question mark, or
    with one of the last paragraph that isn't a bare short option or the row's answer.
    """
    core = _flat(content).strip(_QUOTES)
    if not core or re.search(r"\w*[^\w\s]*$", core.rsplit(None, 1)[-1]).group() not in _flat(prompt):
        return False  # a copy ends in a word of the prompt
    text = prompt.replace("\r\n", "\n").rstrip()
    final = max((m.end() for m in re.finditer(r"\n\s*\n", text)), default=0)
    parts = [(q, asks) for x, asks in ((text[:final], False), (text[final:], True)) for y in re.split(r"(?<=[.!?])\s+|\n+", x) if (q := _flat(y))]
    own = answer is not None and core.rstrip(".") == _flat(answer).rstrip(".")
    for end in range(len(parts), 0, -1):
        whole, asked = "", False
        for i in range(end - 1, -1, -1):
            q, asks = parts[i]
            whole = f"{q} {whole}" if whole else q.rstrip("\"' ")
            bare = whole.lstrip(_QUOTES)
            if not bare or not core.endswith(bare):
                break
            bounded = q.endswith(("?", "？")) or (len(q) >= 16 or (len(q.split()) > 1 and q.endswith((".", "!"))))
            asked = asked or q.rstrip(_QUOTES).endswith(("?", "？")) or (asks and bounded and not own)
            if (asked or (i == 0 and end == len(parts))) and _lead_in(core[: len(core) - len(bare)], len(bare)):
                return True
    return False


def _lead_in(before: str, size: int) -> bool:
    """Is before only a prefix of what follows: a few words or none, courtesies, or a clause that a colon ends?"""
    if before and before[-1].isalnum():
        return False
    prefix = before.strip()
    if len(prefix.split()) <= 4 and len(prefix) <= 40:
        return size >= 16 or not prefix[-1:].isalnum()
    if prefix.rstrip(_QUOTES).endswith((":", "：")) and not re.search(r"[.!?。！？]\s", prefix):
        return True
    return all(_COURTESY.search(x) for x in sentences(prefix))


_NOTE = re.compile(r"^[\W_]*(?:note|hinweis|nota|remarque)\W+", re.I)


def sentences(text: str) -> Iterator[str]:
    for p in re.split(r"(?<=[.!?。！？])\s+|\n+", text):
        if re.search(r"[^\W\d_]", s := _NOTE.sub("", p.strip())):
            yield s


def is_refusal(text: str) -> bool:
    """Does some sentence decline, and does each other decline too, or say courtesies or a few words only?

    A sentence with figures declines only in the first person: `the trims can't come from 83 kPa` is a finding.
    """
    found = False
    for s in sentences(text):
        if _REFUSAL.search(s) and (not re.search(r"\d", re.sub(r"\b[0-9]+ rows?\b", "", s)) or _PERSON.search(s)):
            found = True
        elif len(_WORD.findall(s)) > 4 and not _COURTESY.search(s):
            return False
    return found


def language_of(text: str) -> tuple[str | None, Counter]:
    """The language by function words or script, null if too little speaks for one; and the counts."""
    text = _FENCE.sub(" ", text)
    counts = Counter(dict.fromkeys(FUNCTION_WORDS, 0))
    for w in _WORD.findall(text.lower()):
        for k in _LANGUAGES.get(w, ()):
            counts[k] += 1
    if not text.isascii() and _SCRIPTED.search(text):
        letters = sum(map(str.isalpha, text))
        for name, script in _IN_SCRIPT.items():
            n = len(script.findall(text))
            if n >= 8 and n > 0.3 * letters:
                return name, counts
    (best, n), (_, second) = counts.most_common(2)
    return (best if n >= 2 and n >= 1.25 * second + 1 else None), counts


def wrong_language(content: str, prompt: str) -> bool:
    if json_state(content) != "none":
        return False
    ours, counts = language_of(content)
    if ours is None:
        return False
    theirs, _ = language_of(prompt)
    if theirs is None or ours == theirs or counts[theirs] * 2 > counts[ours] > 0:
        return False
    return not (ours in _ASKED and _ASKED[ours].search(prompt))


_FIGURES = re.compile(r"\d+(?:[.,]\d+)*")


def _tokens(line: str) -> list[str]:
    return _TOKEN.findall(_FIGURES.sub("0", line.lower()))


def context(line: str) -> str:
    """The last three tokens of a line, numbers as 0; after a final full stop (of a number) marked as such."""
    line = line.rstrip()
    return (". " if line.endswith(".") else "") + " ".join(_tokens(line.rstrip("."))[-3:])


class Asked:
    """Contexts to be counted, with the tokens that they end in."""

    def __init__(self, keys: frozenset[str]):
        self.keys, self.last = keys, frozenset(k.rsplit(" ", 1)[-1] for k in keys)


def contexts(text: str, count: Counter, asked: Asked | None = None) -> None:
    """Add how often lines end, or go on, after each context (of asked, if given); and sentences after each that ends in a number."""
    keys, last = (asked.keys, asked.last) if asked else (None, None)
    for line in text.split("\n"):
        tokens = _tokens(line)
        at = None
        for i in range(len(tokens)) if last is None else [i for i, t in enumerate(tokens) if t in last]:
            key = " ".join(tokens[max(0, i - 2) : i + 1])
            if keys is None or key in keys:
                count[key, i == len(tokens) - 1] += 1
            if tokens[i] == "0" and (keys is None or ". " + key in keys):
                at = at or [m.end() for m in _TOKEN.finditer(line.lower())]
                after = line.lower()[at[i] : at[i] + 2]
                count[". " + key, after == "." or (after[:1] == "." and after[1:].isspace())] += 1


def judge(content: str | None, prompt: str | None, answer: str | None) -> tuple[str | None, str | None, bool, float | None, bool]:
    """(defect, context, labelled, unexplained share, copied by position) of a response.

    The defect is that of a response that is no copy. If a context is given, it is still to be looked up, and the defect is
    that of a complete text; labelled says that the line's shape speaks for one.
    """
    state = "empty" if content is None or not re.search(r"[^\W_]", re.sub(r"```\w*", "", content)) else json_state(content)
    if state == "empty":
        return "empty", None, False, None, False
    if state == "whole":
        return None, None, False, None, False
    share = unexplained(content, prompt) if prompt else None
    positioned = share is not None and share <= COPIED and is_copy(content, prompt, answer)
    return *_other(content, prompt, answer, state), share, positioned


def _other(content: str, prompt: str | None, answer: str | None, state: str) -> tuple[str | None, str | None, bool]:
    if state == "broken":
        return "truncated", None, False
    if is_refusal(content):
        return "refusal", None, False
    text = content.rstrip()
    other = bool(prompt) and wrong_language(content, prompt)
    bare = text.strip("\"'`*. ").lower()
    if (answer and bare == answer.strip().lower()) or (len(bare.split()) <= 1 and prompt and bare in prompt.lower()):
        return ("language" if other else None), None, False
    if text.count("```") % 2:
        return "truncated", None, False
    last = text.rsplit("\n", 1)[-1].strip()
    ends = text.endswith("```") or (_SENTENCE_END.search(text) and not re.search(r"\d\.$", text))
    if ends:
        return ("language" if other else None), None, False
    if re.fullmatch(r"\W*\d+[.)]", last):
        return "truncated", None, False
    return ("language" if other else None), context(last), bool(_LABELLED.match(last))


_JUDGED = [("row_id", pa.int64()), ("defect", pa.string()), ("context", pa.string()), ("labelled", pa.bool_()), ("unexplained", pa.float64()), ("positioned", pa.bool_())]


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, *judge(c, p, a)) for i, c, p, a in zip(*(batch.column(n).to_pylist() for n in ("row_id", "content", "prompt", "answer")))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(_JUDGED)], names=[n for n, _ in _JUDGED])


def _counted(known: frozenset[str] | None):
    asked = None if known is None else Asked(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: Counter = Counter()
            for c in batch.column("content").to_pylist():
                if c and json_state(c) == "none":
                    contexts(_FENCE.sub("\n", c), count, asked)
            keys = list(count)
            for at in range(0, len(keys), 50_000):
                some = keys[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.string()), pa.array([count[k] if k[1] else 0 for k in some], pa.int64()), pa.array([0 if k[1] else count[k] for k in some], pa.int64())], names=["context", "ends", "goes_on"])

    return run


def copy_share(judged: DataFrame) -> float:
    """The greatest unexplained share of a copy, from the counts of all responses by share: at most 51 rows come here."""
    rows = judged.where(F.col("unexplained").isNotNull()).groupBy(F.floor(F.col("unexplained") * BINS).cast("int").alias("bin")).count().collect()
    n = np.zeros(BINS + 1)
    for r in rows:
        n[r["bin"]] = r["count"]
    return min(COPIED, valley(n))


def defects(pairs: DataFrame, min_seen: int = 3, asked_at_once: int = 20_000) -> DataFrame:
    """(row_id, defect) of the rows of pairs(row_id, prompt, content, answer) that have one. Runs a job: the reading is settled.

    Where at most asked_at_once different contexts are to be looked up, they go to the workers, which then count no others;
    beyond, all are counted and joined. Both give the same counts.
    """
    judged = settle(pairs.select("row_id", "content", "prompt", "answer").mapInArrow(_judged, "row_id bigint, defect string, context string, labelled boolean, unexplained double, positioned boolean"))
    asked = settle(judged.where(F.col("context").isNotNull()).select("context").distinct())
    few = asked.limit(asked_at_once + 1).collect() if asked_at_once else []
    known = frozenset(r.context for r in few) if 0 < len(few) <= asked_at_once else None
    seen = pairs.select("content").mapInArrow(_counted(known), "context string, ends bigint, goes_on bigint").join(small(asked), "context", "left_semi")
    model = settle(seen.groupBy("context").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on")))
    rows = judged.join(small(model), "context", "left").na.fill(0, ["ends", "goes_on"])
    enough = F.col("ends") + F.col("goes_on") >= min_seen
    complete = F.when(enough & (F.col("goes_on") > 0), F.col("ends") > 3 * F.col("goes_on")).otherwise(F.col("labelled") | (enough & (F.col("ends") >= min_seen) & F.col("context").rlike(r"0$")))
    copied = F.coalesce((F.col("unexplained") <= copy_share(judged)) & F.col("positioned"), F.lit(False))
    other = F.when(F.col("context").isNotNull() & ~complete, "truncated").otherwise(F.col("defect"))
    return rows.withColumn("defect", F.when(copied, "copy").otherwise(other)).where(F.col("defect").isNotNull()).select("row_id", "defect")
