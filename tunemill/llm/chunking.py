"""Cutting oversized texts into overlapping pieces by dynamic programming over boundary positions.

The positions where a text may be cut, each with a penalty: headings and lines of hyphens (none), blank lines, and, only
within stretches too long for a piece, ends of lines and sentences, then blanks, then any character. The cuts chosen
minimise the penalties and the squared deviation of the pieces' new text from an even share, with every piece at most
max_chars long and repeating exactly overlap_chars of its predecessor.

A text is `forced` when some stretch between two neighbouring natural boundaries (or an end of the text) is itself longer
than max_chars, else `natural`. Texts within their limit, null texts, and kinds that are null, without a row in the
configuration or without a positive max_chars come out with no row. A null or negative overlap is 0, and an overlap is at
most max_chars - 1. Of several rows for a kind the smallest limits hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunemill.session import settle, small

_SEPARATOR = re.compile(r"^(?:[^\S\n]*|[^\S\n]*-{3}(?:-*|[^\n]*-{3})[^\S\n]*)$", re.M)
_HEADING = re.compile(r"^#{1,4}[ \t]", re.M)
_SENTENCE = re.compile(r"\n|[.!?…][\"'”)\]]*\s+|[。！？]")
_BLANK = re.compile(r"\s+")
#: Penalties of cuts, in units of the squared relative deviation from an even share.
PENALTY = {"section": 0.0, "blank line": 0.25, "sentence": 1.0, "word": 2.0, "hard": 4.0}
KINDS = list(PENALTY)


def natural(text: str) -> tuple[dict[int, int], int]:
    """Natural cut positions with their kind, and the length of the longest stretch between natural boundaries."""
    marks = [(m.start(), m.end(), bool(m.group().strip())) for m in _SEPARATOR.finditer(text)]
    heads = [m.start() for m in _HEADING.finditer(text)]
    cuts, edges = {}, []
    for start, end, hyphens in marks:
        edges.append((start, min(end + 1, len(text))))
        if hyphens:
            cuts[start] = 0
        else:
            cuts.setdefault(min(end + 1, len(text)), 1)
    for start in heads:
        edges.append((start, start))
        cuts[start] = 0
    longest, at = 0, 0
    for start, end in sorted(edges):
        longest = max(longest, start - 1 - at)  # without the line feed before the boundary
        at = max(at, end)
    return cuts, max(longest, len(text) - at)


def positions(text: str, step: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Cut positions no two of which are further apart than step, their kinds, and the longest natural stretch."""
    cuts, longest = natural(text)
    cuts = {p: k for p, k in cuts.items() if 0 < p < len(text)}
    for kind, pattern in ((2, _SENTENCE), (3, _BLANK), (4, None)):
        ends = sorted(cuts) + [len(text)]
        at, wide = 0, []
        for end in ends:
            if end - at > step:
                wide.append((at, end))
            at = end
        if not wide:
            break
        for a, b in wide:
            more = (m.end() for m in pattern.finditer(text, a, b)) if pattern else range(a + max(1, step // 4), b, max(1, step // 4))
            for p in more:
                if a < p < b:
                    cuts.setdefault(p, kind)
    where = np.array([0, *sorted(cuts), len(text)])
    return where, np.array([0, *(cuts[p] for p in where[1:-1].tolist()), 0]), longest


def best_cuts(text: str, max_chars: int, overlap: int) -> tuple[list[int], list[int], int]:
    """Ends of the pieces, the kind of each cut, and the longest natural stretch."""
    step = max_chars - overlap
    where, kinds, longest = positions(text, step)
    penalty = np.array(list(PENALTY.values()))[kinds]
    penalty[-1] = 0.0
    pieces = max(1, -(-(len(text) - overlap) // step))
    share = len(text) / pieces
    cost, back = np.full(len(where), np.inf), np.zeros(len(where), np.int64)
    cost[0] = 0.0
    first = np.searchsorted(where, where - step, side="left")
    for j in range(1, len(where)):
        i = max(1, int(first[j]))
        prior = cost[i:j] + ((where[j] - where[i:j] - share) / share) ** 2
        best = int(np.argmin(prior)) if len(prior) else -1
        value, origin = (prior[best], i + best) if best >= 0 else (np.inf, 0)
        if where[j] <= max_chars and (where[j] >= overlap or j == len(where) - 1):
            whole = ((where[j] - share) / share) ** 2
            if whole <= value:
                value, origin = whole, 0
        cost[j], back[j] = value + penalty[j], origin
    ends, j = [], len(where) - 1
    while j:
        ends.append(j)
        j = int(back[j])
    ends.reverse()
    return where[ends].tolist(), kinds[ends].tolist(), longest


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                doc, text, most, overlap = (batch.column(n)[i].as_py() for n in ("doc_id", "text", "max_chars", "overlap_chars"))
                ends, kinds, longest = best_cuts(text, most, overlap)
                cut = "forced" if longest > most else "natural"
                at = 0
                for no, (end, kind) in enumerate(zip(ends, kinds)):
                    begin = at - overlap if no else 0
                    rows.append((doc, no + 1, len(ends), begin, end, KINDS[kind] if end < len(text) else "end", cut, text[begin:end] if with_text else None))
                    at = end
                if len(rows) >= 2_000 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)
                    rows = []

    return run


_NAMES = ["doc_id", "piece_no", "n_pieces", "start", "stop", "boundary", "cut", "text"]
_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
_SCHEMA = "doc_id bigint, piece_no int, n_pieces int, start int, stop int, boundary string, cut string, text string"


def pieces(documents: DataFrame, chunking_cfg: DataFrame, with_text: bool = True) -> DataFrame:
    """The pieces of every document longer than max_chars of its kind: text[start:stop], numbered from 1; boundary is
    what the piece ends at. Without with_text, text is null."""
    limits = chunking_cfg.where(F.col("kind").isNotNull() & (F.col("max_chars") > 0)).groupBy("kind").agg(F.min("max_chars").alias("max_chars"), F.min(F.greatest(F.coalesce("overlap_chars", F.lit(0)), F.lit(0))).alias("overlap_chars"))
    limits = small(settle(limits.withColumn("overlap_chars", F.least("overlap_chars", F.col("max_chars") - 1))))
    long = documents.select("doc_id", "kind", "text").join(limits, "kind").where(F.length("text") > F.col("max_chars"))
    return long.select("doc_id", "text", "max_chars", "overlap_chars").mapInArrow(_cut(with_text), _SCHEMA)
