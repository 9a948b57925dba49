"""Pages made for search engines: keyword runs, link lists, tags and product offers instead of sentences.

One pass over the texts reads each line once. It counts what the corpus' sentences look like, by language, as histograms
that merge by addition, and keeps for each page the measures of the lines that may be no sentences:

* function words: their share of the line's words (in scripts without blanks the share of hiragana);
* links and tags: the shares of the line's characters in addresses and link texts, and of its tokens that are tags;
* separators: commas, bars, arrows and the like for each word;
* top words and word pairs: the shares of the line's words, and of its pairs of neighbouring words, that recur over the
  page's lines of this kind: three times, or twice on a page of under SHORT such words;
* duplicates: how often the line itself is there.

Thresholds are made for each language from merged counts. From its sentences come those of function words (half of their
median), of links and tags (midway between what all but 1 % of the sentences have and a whole line) and of separators
(what all but 1 % of the sentences have). From its lines that may be none come those of top words and word pairs: where the
variance between the lines under and over it is greatest. A line is made for search engines when

* it is mostly links, or mostly tags; or
* it has too few function words, is no data (values, definitions, assignments, addresses, dotted leaders), and either
  stands there three times, or has (itself, or all such lines of the page together) a share of top words over the
  threshold and too many separators or recurring pairs.

A page is found when more than half of its characters are in such lines. Languages with too few sentences take the
thresholds of all languages together. Null and empty texts are never found. Repeated rows come out repeated.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunemill.llm.budget import language
from tunemill.llm.histograms import valley
from tunemill.llm.pairs import FUNCTION_WORDS
from tunemill.session import settle, small

_FUNCTION = frozenset(w for words in FUNCTION_WORDS.values() for w in words) - {"no", "me", "can"}
_LINK = re.compile(r"\[[^\]\n]*\]\([^)\n]*\)|(?:https?://|www\.)[^\s)\]>\"']+", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_HIRAGANA = re.compile(r"[぀-ゟ]")
#: What makes a line data, each with a text without which it needs no search.
_DATA = tuple((mark, re.compile(p, re.I)) for mark, p in (("=", r"\w\s*=\s*\w"), (":", r"^\s*\w+:\s*\S+\s*$"), ("....", r"\.{4,}\s*\d+\s*$"), ("0x", r"\b0x[0-9a-f]+"), ("", r"\b[0-9a-f]{16,}\b")))
_DIGITS = re.compile(r"\S*\d\S*")
_ENDS = frozenset(".!?。！？")
_SEPARATORS, _SPACED = ",»|•·;、/", re.compile(r"\s[->–]\s|\s#")
#: Measures of a line with a threshold each, in the order of the columns.
MEASURES = ("function_words", "links", "tags", "separators", "top_words", "word_pairs")
BINS, SHORT, MIDWAY = 50, 60, 0.5
#: The share of function words under which a line is kept for the decision, over any threshold of that measure.
_LOOSE = 0.34


def words_of(line: str) -> tuple[list[str], float, int]:
    """Words of a line, its share of function words (or hiragana), and its number of words (or letters)."""
    cjk = 0 if line.isascii() else len(_CJK.findall(line))
    if cjk and cjk * 2 > sum(map(str.isalpha, line)):
        found = [w for w in re.split(r"[\s,、・/|»#。！？]+", line.lower()) if w and not any(map(str.isdigit, w))]
        return found, len(_HIRAGANA.findall(line)) / cjk, cjk
    found = _WORD.findall(line.lower())
    return found, (sum(map(_FUNCTION.__contains__, found)) / len(found) if found else 0.0), len(found)


def _recurring(lines: list[list[str]]) -> Iterator[tuple[float, float]]:
    """For each line the shares of its words and of its neighbouring pairs that recur over all of the lines."""
    single = Counter(w for line in lines for w in line)
    pairs = Counter(p for line in lines for p in zip(line, line[1:]))
    often = 3 if sum(single.values()) >= SHORT else 2
    for line in lines:
        both = list(zip(line, line[1:]))
        yield (sum(single[w] >= often for w in line) / len(line) if line else 0.0), (sum(pairs[p] >= often for p in both) / len(both) if both else 0.0)


def measures(text: str) -> tuple[list[tuple], list[tuple]]:
    """Of a page: the first four measures of each sentence, and (characters, copies, listed, measures) of each line that may be none."""
    sentences, doubtful = [], []
    for line in text.split("\n"):
        body, linked, size = line, 0.0, len(line.strip())
        if not size:
            continue
        if "://" in line or "](" in line or "www." in line.lower():
            body = _LINK.sub(" ", line)
            linked = min(1.0, (len(line) - len(body)) / size)
        words, function, n = words_of(body)
        tags = 0.0
        if "#" in body:
            tokens = body.split()
            tags = sum(t[0] == "#" and len(t) > 2 and t[1] != "#" for t in tokens) / max(len(tokens), 1)
        if len(line) >= 40 and function > 0 and line.rstrip()[-1] in _ENDS:
            sentences.append((function, linked, tags, _separators(body) / max(n, 1)))
        if function <= _LOOSE or linked > 0.2 or tags > 0.2:
            doubtful.append((words, function, linked, tags, body, line))
    copies = Counter(d[5].strip() for d in doubtful)
    listed = [not _is_data(d[4], d[0]) for d in doubtful]
    shares = iter(_recurring([d[0] for d, x in zip(doubtful, listed) if x]))
    out = []
    for (words, function, linked, tags, body, line), x in zip(doubtful, listed):
        separators = _separators(body) / max(len(words), 1)
        out.append((len(line) + 1, copies[line.strip()], x, function, linked, tags, separators, *(next(shares) if x else (0.0, 0.0))))
    return sentences, out


def _is_data(body: str, words: list[str]) -> bool:
    if len(words) < 2 or len(_DIGITS.findall(body)) >= 0.4 * len(body.split()):
        return True
    low = body.lower()
    return any(mark in low and pattern.search(low) for mark, pattern in _DATA)


def _separators(body: str) -> int:
    return sum(map(body.count, _SEPARATORS)) + (len(_SPACED.findall(body)) if any(map(body.__contains__, "->–#")) else 0)


_PAGE = [("doc_id", pa.int64()), ("lang", pa.string()), ("n_chars", pa.int64()), ("lines", pa.list_(pa.list_(pa.float64()))), ("measure", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())]
_SCHEMA = "doc_id bigint, lang string, n_chars bigint, lines array<array<double>>, measure int, bin int, n bigint"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each page with doubtful lines that could make half of it, and rows (lang, measure, bin, n) of the histograms."""
    for batch in batches:
        count: Counter = Counter()
        pages = []
        for i, lang, text in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "lang", "text"))):
            if not text:
                continue
            sentences, doubtful = measures(text)
            for row in sentences:
                for m, v in enumerate(row):
                    count[lang, m, min(int(v * BINS), BINS)] += 1
            for *_, top, pairs in (d for d in doubtful if d[2]):
                count[lang, 4, int(top * BINS)] += 1
                count[lang, 5, int(pairs * BINS)] += 1
            if 2 * sum(d[0] for d in doubtful) > len(text) + 1:
                pages.append((i, lang, len(text) + 1, doubtful, None, None, None))
        rows = pages + [(None, lang, None, None, m, b, n) for (lang, m, b), n in count.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(_PAGE)], names=[n for n, _ in _PAGE])


def limit(measure: int, n: np.ndarray) -> float:
    """The threshold of a measure from its counts n by bin."""
    if not n.any():
        return 1.0
    share = np.cumsum(n) / n.sum()
    if measure == 0:
        return 0.5 * (np.searchsorted(share, 0.5) + 0.5) / BINS
    if measure <= 3:
        usual = np.searchsorted(share, 0.99) / BINS
        return max(usual, 1 / BINS) if measure == 3 else usual + MIDWAY * (1 - usual)
    return valley(n)


def thresholds(read: DataFrame, least: int = 50) -> DataFrame:
    """(lang, limits array<double>) of each language with enough sentences, and under a null all languages together.

    Made where the counts are: a row of at most 51 counts for each language and measure.
    """
    counts = read.where(F.col("n").isNotNull()).groupBy("lang", "measure", "bin").agg(F.sum("n").alias("n"))
    every = counts.groupBy("measure", "bin").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "measure", "bin", "n")
    both = counts.where(F.col("lang").isNotNull()).unionByName(every)
    per = both.groupBy("lang").agg(F.collect_list(F.struct("measure", "bin", "n")).alias("counts"), F.sum(F.when(F.col("measure") == 0, F.col("n"))).alias("lines"))

    @F.udf("array<double>")
    def limits(rows):
        n = np.zeros((len(MEASURES), BINS + 1))
        for r in rows:
            n[r["measure"], r["bin"]] += r["n"]
        return [float(limit(m, n[m])) for m in range(len(MEASURES))]

    return per.where(F.col("lang").isNull() | (F.col("lines") >= least)).select("lang", limits("counts").alias("limits"))


def spam_share(lines, n_chars: int, limits) -> float:
    """The share of a page's characters in lines over the limits."""
    function, links, tags, separators, top, pairs = limits
    wordy = [(line[0], line[7]) for line in lines if line[2] and line[3] < function]
    together = sum(c * w for c, w in wordy) / sum(c for c, _ in wordy) if wordy else 0.0
    total = 0.0
    for chars, copies, listed, f, a, t, s, w, p in lines:
        if a >= links or t >= tags or (listed and f < function and (copies >= 3 or (max(w, together) >= top and (s > separators or p >= pairs)))):
            total += chars
    return total / n_chars


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("lines", "n_chars", "limits")]
        shares = [spam_share(*row) for row in zip(*columns)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shares, pa.float64())], names=["doc_id", "spam_share"])


def stuffed(documents: DataFrame, share_of_text: float = 0.5) -> DataFrame:
    """(doc_id, spam_share) of the pages of documents(doc_id, text, lang) over share_of_text.

    The reading of the texts is settled once, so this runs a job; the result itself is lazy.
    """
    read = settle(documents.select("doc_id", language().alias("lang"), "text").mapInArrow(_read, _SCHEMA))
    known = settle(thresholds(read))
    everywhere = known.where(F.col("lang").isNull()).select(F.col("limits").alias("_all"))
    pages = read.where(F.col("lines").isNotNull()).join(small(known.where(F.col("lang").isNotNull())), "lang", "left").join(F.broadcast(everywhere))
    ready = pages.select("doc_id", "n_chars", "lines", F.coalesce("limits", "_all").alias("limits"))
    return ready.mapInArrow(_judged, "doc_id bigint, spam_share double").where(F.col("spam_share") > share_of_text)
