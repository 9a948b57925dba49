"""The public byte-level BPE of 50,257 ids, exact token counts, and where a text may be cut without changing its tokens.

The vocabulary file is a parameter (VOCABULARY is only its default place); it is read once in each Python worker.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published split pattern of this tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a text that one task counts as one piece.
PIECE_CHARS = 16_384

_encoders: dict = {}


def encoder(path: str = VOCABULARY):
    """tiktoken's encoder over the vocabulary file; special strings are ordinary text."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        _encoders[path] = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


#: White space by the split pattern's meaning. Its runs over RUN_CHARS would exhaust the pattern engine's stack.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUN_CHARS = 4_096
_RUN = re.compile(f"[{_SPACE}]{{{RUN_CHARS},}}")


def encode_text(enc, text: str) -> list[int]:
    """Ids of a text of any kind. A long run of white space is one match of the pattern, all but its last character if a
    non-space follows; what precedes it encodes on its own, and so does the rest."""
    if len(text) < RUN_CHARS:
        return enc.encode_ordinary(text)
    ids, at = [], 0
    for m in _RUN.finditer(text):
        ids += enc.encode_ordinary(text[at : m.start()])
        at = m.end() - (m.end() < len(text))
        ids += enc._encode_single_piece(text[m.start() : at].encode())
    return ids + enc.encode_ordinary(text[at:])


#: A place between two characters where the split pattern always ends a match and the next begins, whatever else the text
#: holds, in any script: no match contains a non-space before a space character, nor a letter or digit before what is
#: neither (marks that combine among them) and no apostrophe, and the only lookahead of the pattern looks at what follows
#: white space. So both sides encode independently. Blocks that Unicode versions since 15 have put letters into are left
#: out, so that the pattern's engine and this one need not know the same version.
_LATE = "\u1c80-\u1cff\ua700-\ua7ff\U00010000-\U0010ffff"
_PROVEN = re.compile(rf"(?<=\S)(?=[ \n\t\r])|(?<=[^\W_{_LATE}])(?=[^\w\s'{_LATE}])")


def proven_cuts(text: str, size: int) -> list[int]:
    """Ends of pieces of text of about `size` characters, each at a proven boundary; the last is len(text).

    A stretch without such a boundary is never cut: its piece is then as long as it must be.
    """
    ends, at = [], 0
    while len(text) - at > size:
        end, window = None, min(256, size - 1)
        while end is None and window:
            for m in _PROVEN.finditer(text, at + size - window, at + size):
                end = m.start()
            window = min(window * 8, size - 1) if window < size - 1 else 0
        if end is None:
            m = _PROVEN.search(text, at + size)
            end = m.start() if m else len(text)
        ends.append(end)
        at = end
    if at < len(text) or not ends:
        ends.append(len(text))
    return ends


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            kept = [n for n in batch.schema.names if n != "_text"]
            counts = np.fromiter((len(encode_text(enc, t)) if t else 0 for t in map(pa.StringScalar.as_py, batch.column("_text"))), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(counts)], names=[*kept, "n_tokens"])

    return run


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [n for n in batch.schema.names if n != "_text"]
            for i in range(batch.num_rows):
                text = batch.column("_text")[i].as_py()
                ends = proven_cuts(text, size)
                for at in range(0, len(ends), 256):
                    some = ends[at : at + 256]
                    starts = [ends[at - 1] if at else 0, *some[:-1]]
                    rows = pa.array([i] * len(some))
                    yield pa.RecordBatch.from_arrays([*(batch.column(n).take(rows) for n in kept), pa.array(range(at, at + len(some)), pa.int32()), pa.array([text[a:b] for a, b in zip(starts, some)])], names=[*kept, "_piece", "_text"])

    return run


def count_tokens(docs: DataFrame, keep: list[str], path: str = VOCABULARY, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """keep..., n_tokens bigint: the exact number of tokens of `text` of each row of docs; null and empty texts have 0.

    Texts over piece_chars are cut at proven boundaries, their pieces spread over all workers, and the counts of the
    pieces summed for each text. Rows that are equal in `keep` and text come out as often as they come in.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    rows = docs.select(*keep, F.col("text").alias("_text"))
    long = F.coalesce(F.length("_text"), F.lit(0)) > piece_chars
    counted = rows.where(~long).mapInArrow(_count(path), f"{schema}, n_tokens bigint")
    pieces = rows.where(long).withColumn("_of", F.xxhash64("_text")).mapInArrow(_cut(piece_chars), f"{schema}, _of bigint, _piece int, _text string")
    spread = pieces.repartition(F.col("_of"), F.col("_piece"))
    summed = spread.mapInArrow(_count(path), f"{schema}, _of bigint, _piece int, n_tokens bigint").groupBy(*keep, "_of").agg(F.sum("n_tokens").alias("_sum"), F.count_if(F.col("_piece") == 0).alias("_rows"))
    totals = summed.select(*keep, (F.col("_sum") / F.col("_rows")).cast("bigint").alias("n_tokens"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_rows"))).alias("_copy")).drop("_copy")
    return counted.unionByName(totals)
