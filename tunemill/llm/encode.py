"""Token ids of every document; long texts are encoded in parallel and put together exactly.

A text over long_chars is cut into leaves at any place; leaves of all texts are spread over the workers and encoded on
their own. What a cut may have changed lies near it: a window of both sides around each join, grown from WINDOW_CHARS until
it begins and ends at a proven boundary of the split pattern, is encoded anew. Both sides agree with it if their own tokens
begin and end at these boundaries; then the text is the left side up to the window, the window, and the right side from
there on, and as windows of a leaf don't meet, every join of the tree can be made at once, each keyed by its text and place,
from its window alone. What comes together for a text is its ids.

A leaf without such boundaries (a run of letters over thousands of characters, say) leaves its text open. Open texts are
joined pairwise as a tree: inside a run of letters or digits the window must share a whole token with either side. A token
sequence is the BPE encoding of its bytes exactly if each two neighbouring tokens are that of theirs, so sequences that
share a token can be spliced at it. A window that never agrees grows to the whole of both sides, the plain encoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunemill.llm.tokens import _PROVEN, VOCABULARY, encode_text, encoder
from tunemill.session import settle

LEAF_CHARS = 8_192
LONG_CHARS = 16_384
WINDOW_CHARS = 64


def _same(text: str) -> bool:
    """Is text of letters only, or of decimal digits only?"""
    return text.isalpha() or text.isdecimal()


def _starts(enc, ids: np.ndarray) -> np.ndarray:
    """Byte offsets at which the tokens of ids begin, and the end."""
    sizes = np.fromiter((len(b) for b in enc.decode_tokens_bytes(ids.tolist())), np.int64, len(ids))
    return np.concatenate([[0], np.cumsum(sizes)])


class Node:
    """A stretch of text with its ids. The byte offsets of the tokens are computed where joins need them."""

    __slots__ = ("text", "ids", "_at")

    def __init__(self, text: str, ids: np.ndarray):
        self.text, self.ids, self._at = text, ids, None

    def at(self, enc) -> np.ndarray:
        if self._at is None:
            self._at = _starts(enc, self.ids)
        return self._at


def join(enc, left: Node, right: Node) -> Node:
    """The exact node of both texts together."""
    text = left.text + right.text
    reach = WINDOW_CHARS
    while reach < max(len(left.text), len(right.text)):
        lo, hi = max(0, len(left.text) - reach), min(len(right.text), reach)
        a = next((m.start() for m in _PROVEN.finditer(left.text, lo) if m.start() > 0), None)
        if a is None and lo == 0:
            a = 0
        b = None
        for m in _PROVEN.finditer(right.text, 1, hi):
            b = m.start()
        if b is None and hi == len(right.text):
            b = hi
        window_ids = None
        if a is not None and b is not None:
            window_ids = np.asarray(encode_text(enc, left.text[a:] + right.text[:b]), np.int32)
            la, rb = len(left.text[:a].encode()), len(right.text[:b].encode())
            i, j = np.searchsorted(left.at(enc), la), np.searchsorted(right.at(enc), rb)
            if left.at(enc)[i] == la and right.at(enc)[j] == rb:
                return Node(text, np.concatenate([left.ids[:i], window_ids, right.ids[j:]]))
        elif _same(left.text[lo:] + right.text[:hi]):
            spliced = _splice(enc, left, right, lo, hi)
            if spliced is not None:
                return Node(text, spliced)
        reach *= 2
    return Node(text, np.asarray(encode_text(enc, text), np.int32))


def _splice(enc, left: Node, right: Node, lo: int, hi: int) -> np.ndarray | None:
    """ids of both, if a window within one run of letters or digits shares a whole token with either side."""
    la, rb = len(left.text[:lo].encode()), len(right.text[:hi].encode())
    lat, rat = left.at(enc), right.at(enc)
    i = int(np.searchsorted(lat, la))
    j = int(np.searchsorted(rat, rb, side="right")) - 1
    if i >= len(left.ids) - 1 or j < 2:
        return None
    head = enc.decode_bytes(left.ids[i:].tolist())
    tail = enc.decode_bytes(right.ids[:j].tolist())
    try:
        window = (head + tail).decode()
    except UnicodeDecodeError:
        return None
    ids = np.asarray(encode_text(enc, window), np.int32)
    at = _starts(enc, ids)
    spans = {(int(s), int(e)): k for k, (s, e) in enumerate(zip(at[:-1], at[1:]))}
    base, shift = int(lat[i]), len(head)
    first = next(((k, spans[s]) for k in range(i, len(left.ids)) if (s := (int(lat[k]) - base, int(lat[k + 1]) - base)) in spans), None)
    last = next(((k, spans[s]) for k in range(j - 1, -1, -1) if (s := (int(rat[k]) + shift, int(rat[k + 1]) + shift)) in spans), None)
    if first is None or last is None or first[1] >= last[1]:
        return None
    return np.concatenate([left.ids[: first[0]], ids[first[1] : last[1] + 1], right.ids[last[0] + 1 :]])


def tree(enc, nodes: list[Node]) -> np.ndarray:
    """ids of the texts of nodes, in a row, as one text."""
    while len(nodes) > 1:
        nodes = [join(enc, nodes[k], nodes[k + 1]) if k + 1 < len(nodes) else nodes[k] for k in range(0, len(nodes), 2)]
    return nodes[0].ids if nodes else np.empty(0, np.int32)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32, copy=False), pa.int32()))


def _encode(path: str, step: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                names = [n for n in batch.schema.names if n != "_text"]
                ids = [np.array(encode_text(enc, t), np.int32) if t else np.empty(0, np.int32) for t in batch.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), _lists(ids)], names=[*names, "ids"])

    return run


def head_end(text: str, reach: int = WINDOW_CHARS) -> int | None:
    """The first proven boundary of text at least reach characters from its start."""
    m = _PROVEN.search(text, max(1, reach))
    return m.start() if m else None


def tail_start(text: str, reach: int = WINDOW_CHARS) -> int | None:
    """The last proven boundary of text at least reach characters from its end, looked for in growing windows."""
    stop = len(text) - reach
    while stop > 0 and reach < len(text):
        reach *= 2
        low, found = max(1, len(text) - reach), None
        for m in _PROVEN.finditer(text, low, stop + 1):
            if m.start() <= stop:
                found = m.start()
        if found is not None or low == 1:
            return found
    return None


def edges(enc, text: str, ids: np.ndarray, first: bool, last: bool) -> tuple[int, int, str | None, str | None] | None:
    """(tokens before, tokens up to, head, tail): the tokens of a leaf that stay, and the text beside them on either side.

    None if a window has no boundary to begin or end at, if the tokens don't end there, or if both windows would meet.
    """
    b = 0 if first else head_end(text)
    a = len(text) if last else tail_start(text)
    if b is None and last:
        b = len(text)
    if a is None and first:
        a = 0
    if a is None or b is None or b > a:
        return None
    at = _starts(enc, ids)
    low, high = len(text[:b].encode()), len(text[:a].encode())
    i, j = int(np.searchsorted(at, low)), int(np.searchsorted(at, high))
    if at[i] != low or at[j] != high:
        return None
    return i, j, None if first else text[:b], None if last else text[a:]


def _leaves(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, row, text in zip(batch.column("doc_id"), batch.column("_row"), batch.column("_text")):
                text = text.as_py()
                for at in range(0, len(text), size * 64):
                    parts = [text[k : k + size] for k in range(at, min(at + size * 64, len(text)), size)]
                    n = len(parts)
                    ends = [k + size >= len(text) for k in range(at, at + n * size, size)]
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * n, pa.int64()), pa.array([row.as_py()] * n, pa.int64()), pa.array(range(at // size, at // size + n), pa.int32()), pa.array(ends), pa.array(parts)], names=["doc_id", "_row", "_no", "_last", "_text"])

    return run


#: Rows of a leaf: its ids and the part of them that stays (_from is -1 in an open text); rows of a window: one of its sides.
_CODED = [("doc_id", pa.int64()), ("_row", pa.int64()), ("_no", pa.int32()), ("_side", pa.int32()), ("_edge", pa.string()), ("_from", pa.int32()), ("_to", pa.int32())]


def _encode_leaves(path: str, step: int = 64):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                rows, ids = [], []
                for doc, row, no, last, text in zip(*(c.to_pylist() for c in whole.slice(at, step).columns)):
                    own = np.array(encode_text(enc, text), np.int32)
                    found = edges(enc, text, own, no == 0, last)
                    i, j, head, tail = found or (-1, -1, None, None)
                    rows.append((doc, row, no, 0, None, i, j))
                    ids.append(own)
                    for place, side, edge in ((no - 1, 2, head), (no, 1, tail)):
                        if edge is not None:
                            rows.append((doc, row, place, side, edge, 0, 0))
                            ids.append(own[:0])
                yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(_CODED)), _lists(ids)], names=[*(n for n, _ in _CODED), "ids"])

    return run


def _together(path: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        made = rows[rows["_side"] == 1]
        windows = dict(zip(made["_no"], made["ids"]))
        leaves = rows[rows["_side"] == 0].sort_values("_no", kind="stable")
        out = []
        for _, part in leaves.groupby(leaves.groupby("_no").cumcount()):  # equal rows of a table come as several series of the same leaves
            if (part["_from"] < 0).any():
                enc = encoder(path)
                ids = tree(enc, [Node(enc.decode_bytes(list(i)).decode(), np.asarray(i, np.int32)) for i in part["ids"]])
            else:
                pieces = []
                for no, own, i, j in zip(part["_no"], part["ids"], part["_from"], part["_to"]):
                    pieces += [own[i:j], windows.get(no, own[:0])]
                ids = np.concatenate(pieces)
            out.append((part["doc_id"].iloc[0], ids))
        return pd.DataFrame({"doc_id": pd.array([d for d, _ in out], "Int64"), "ids": [i for _, i in out]})

    return run


def encode(documents: DataFrame, path: str = VOCABULARY, leaf_chars: int = LEAF_CHARS, long_chars: int = LONG_CHARS) -> DataFrame:
    """(doc_id, ids array<int>) of every row; null and empty texts have an empty list. Other columns are ignored.

    Runs a job: the encoded leaves are settled, as joins and texts both need them.
    """
    rows = documents.select("doc_id", F.col("text").alias("_text"))
    long = F.coalesce(F.length("_text"), F.lit(0)) > long_chars
    short = rows.where(~long).mapInArrow(_encode(path), "doc_id bigint, ids array<int>")
    leaves = rows.where(long).withColumn("_row", F.xxhash64("_text")).mapInArrow(_leaves(leaf_chars), "doc_id bigint, _row bigint, _no int, _last boolean, _text string")
    spread = leaves.repartition(F.col("doc_id"), F.col("_no"))
    coded = settle(spread.mapInArrow(_encode_leaves(path), "doc_id bigint, _row bigint, _no int, _side int, _edge string, _from int, _to int, ids array<int>"))
    sides = [F.max(F.when(F.col("_side") == k, F.col("_edge"))).alias(f"_{k}") for k in (1, 2)]
    joins = coded.where("_side > 0").groupBy("doc_id", "_row", "_no").agg(*sides).where("_1 is not null and _2 is not null")
    windows = joins.select("doc_id", "_row", "_no", F.concat("_1", "_2").alias("_text")).mapInArrow(_encode(path), "doc_id bigint, _row bigint, _no int, ids array<int>")
    parts = coded.where("_side = 0").select("doc_id", "_row", "_no", "_side", "_from", "_to", "ids")
    parts = parts.unionByName(windows.select("doc_id", "_row", "_no", F.lit(1).alias("_side"), F.lit(0).alias("_from"), F.lit(0).alias("_to"), "ids"))
    whole = parts.groupBy("doc_id", "_row").applyInPandas(_together(path), "doc_id bigint, ids array<int>")
    return short.unionByName(whole)


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): the inverse, but for null texts, which come back empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([enc.decode_bytes(x or []).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
