"""Lexical and dense ranking, fusion, caps and evidence windows, batched over a set of queries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tunemill.functions.text import terms
from tunemill.session import settle, small

#: Our own BM25 parameters, the fusion constant, candidates per ranking.
K1, B, RRF_K, CANDIDATES = 1.2, 0.75, 60, 20
#: Fixed value: minimal length of a term that a window looks for.
MIN_TERM = 3
#: What a window never cuts: runs without blanks, digits that blanks group, and a number with its percent sign.
_UNIT = re.compile(r"\S+(?:(?<=\d)\s+(?=\d)\S+|(?<=\d)\s+%\S*)*")


def top_terms(rows: DataFrame, key: str, text: Column, most: int = 12) -> DataFrame:
    """(key, term, n, rank): each row's terms by frequency, longer first, then first seen."""
    every = rows.select(key, F.posexplode(terms(text)).alias("pos", "term"))
    counted = every.groupBy(key, "term").agg(F.count("*").alias("n"), F.min("pos").alias("_first"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), F.desc(F.length("term")), "_first")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("_first")


#: Entries (term, document) of one block of documents at most, sets of terms of one block of queries.
ENTRIES, SETS = 1 << 22, 1 << 16


def postings(docs: DataFrame, key: str, text: Column, ids: DataFrame) -> DataFrame:
    """(key, _p): the inverted index by document, _p of (_id, tf, size) for each of its terms in ids(term, _id).

    size is the document's number of terms. What stands in no id is one entry without id, so that no document is missing.
    """
    each = docs.select(key, terms(text).alias("_t")).select(key, F.size("_t").alias("size"), F.explode("_t").alias("term"))
    counted = each.join(ids, "term", "left").groupBy(key, "size", "_id").agg(F.count("*").cast("int").alias("tf"))
    return counted.groupBy(key).agg(F.collect_list(F.struct("_id", "tf", "size")).alias("_p"))


def bm25(queries: DataFrame, docs: DataFrame, q: str, key: str, text: Column, k: int = CANDIDATES) -> DataFrame:
    """(q, key, score, rank) of the k best documents of each query(q, term); equal scores by key.

    Only the postings of terms that some query has are built, once; documents without terms count nowhere. Queries of the
    same terms are one. Blocks of them meet blocks of documents, and k rows per set of terms and block are shuffled.
    """
    asked = settle(queries.select(q, "term").distinct())
    ids = settle(asked.select("term").distinct().withColumn("_id", F.monotonically_increasing_id()))
    index = settle(postings(docs, key, text, small(ids)))
    n, mean = index.select(F.explode(F.array_distinct("_p.size")).alias("_s")).agg(F.count("*"), F.coalesce(F.avg("_s"), F.lit(1.0))).first()
    entries = index.agg(F.coalesce(F.sum(F.size("_p")), F.lit(0))).first()[0]
    df = index.select(F.explode("_p._id").alias("_id")).where("_id is not null").groupBy("_id").agg(F.count("*").alias("_df"))
    idf = F.log(1 + (F.lit(n) - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    weighed = asked.join(ids, "term").join(df.select("_id", idf.alias("_idf")), "_id")
    member = settle(weighed.groupBy(q).agg(F.array_sort(F.collect_list(F.struct("_id", "_idf"))).alias("_set")))
    sets = settle(member.groupBy("_set").agg(F.min(q).alias("_sid")))
    qb, vb = max(1, -(-sets.count() // SETS)), max(1, min(16, -(-entries // (ENTRIES // 64))), -(-entries // ENTRIES))
    left = sets.select("_sid", F.col("_set._id").alias("_ids"), F.col("_set._idf").alias("_idf"), F.pmod(F.xxhash64("_sid"), F.lit(qb)).alias("_qb")).withColumn("_vb", F.explode(F.sequence(F.lit(0), F.lit(vb - 1))))
    found = index.withColumn("_p", F.filter("_p", lambda x: x["_id"].isNotNull())).where(F.size("_p") > 0)
    right = found.select(F.col(key).alias("_k"), F.col("_p._id").alias("_ids"), F.col("_p.tf").alias("_tf"), F.col("_p.size").alias("_size"), F.pmod(F.xxhash64(key), F.lit(vb)).alias("_vb")).withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    got = left.groupBy("_qb", "_vb").cogroup(right.groupBy("_qb", "_vb")).applyInArrow(_best(k, mean), f"_sid {kind(sets, '_sid')}, _k {kind(docs, key)}, score double")
    best = ranked(got.withColumnRenamed("_k", key), "_sid", key, k)
    return member.join(sets, "_set").select(q, "_sid").join(best, "_sid").select(q, key, "score", "rank")


def _best(k: int, mean: float):
    """For a block of sets of terms and one of documents: the k best (set, document, score) of each set, by score, then document.

    Scores are sums of rows of a dense table, a row for each term and a column for each document of a chunk. The sets go in
    the order of their terms, common ones first, so that what a set begins with as the one before it isn't added up again.
    """

    def flat(col: pa.ChunkedArray) -> np.ndarray:
        return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in col.chunks])

    def starts(col: pa.ChunkedArray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in col.chunks]))]).astype(np.int64)

    def run(sets: pa.Table, docs: pa.Table) -> pa.Table:
        names = ["_sid", "_k", "score"]
        if not sets.num_rows or not docs.num_rows:
            return pa.table([sets["_sid"].slice(0, 0), docs["_k"].slice(0, 0), pa.array([], pa.float64())], names=names)
        known, at = np.unique(flat(sets["_ids"]), return_inverse=True)
        place = np.empty(len(known), np.int64)  # of each term: how many are in more sets
        place[np.argsort(-np.bincount(at), kind="stable")] = np.arange(len(known))
        idf, cuts = np.empty(len(known)), starts(sets["_ids"])
        idf[place[at]] = flat(sets["_idf"])
        paths = sorted((sorted(place[at[a:b]].tolist()), i) for i, (a, b) in enumerate(zip(cuts, cuts[1:])))
        steps, before = [], []
        for path, i in paths:
            same = next((d for d, (x, y) in enumerate(zip(before, path)) if x != y), min(len(before), len(path)))
            steps.append((i, same, path[same:]))
            before = path
        ids, tf, size, cuts = flat(docs["_ids"]), flat(docs["_tf"]), flat(docs["_size"]), starts(docs["_ids"])
        near = np.minimum(np.searchsorted(known, ids), len(known) - 1)
        row, col, ours = place[near], np.repeat(np.arange(docs.num_rows), np.diff(cuts)), known[near] == ids
        weight = idf[row] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean)))
        keys = docs["_k"].combine_chunks()
        order = np.empty(docs.num_rows, np.int64)
        order[pc.array_sort_indices(keys, null_placement="at_start").to_numpy()] = np.arange(docs.num_rows)
        held: list = [(np.empty(0, np.int64), np.empty(0))] * sets.num_rows
        bounds = [5e-324] * sets.num_rows  # what the score of a document reaches that may be among the best: any hit, at first
        width = min(4_096, max(64, (1 << 22) // len(known)))
        for first in range(0, docs.num_rows, width):
            part = slice(cuts[first], cuts[min(first + width, docs.num_rows)])
            mine = ours[part]
            rows, cols, values = row[part][mine], col[part][mine] - first, weight[part][mine]
            here, no = np.unique(rows, return_inverse=True)
            dense = np.bincount((no + 1) * width + cols, values, (len(here) + 1) * width).reshape(-1, width)
            table = {r: dense[x + 1] for x, r in enumerate(here.tolist())}
            sums = list(np.zeros((max(len(p) for p, _ in paths) + 1, width)))
            for i, depth, rest in steps:
                for r in rest:
                    if r in table:
                        np.add(sums[depth], table[r], out=sums[depth + 1])
                    else:
                        sums[depth + 1][:] = sums[depth]
                    depth += 1
                s = sums[depth]
                hit = np.flatnonzero(s >= bounds[i])
                if not len(hit):
                    continue
                v = s[hit]
                if len(hit) > k:  # scores that are equal once rounded stay
                    likely = v >= np.partition(v, -k)[-k] - 2e-6
                    hit, v = hit[likely], v[likely]
                hit, v = np.concatenate([held[i][0], hit + first]), np.concatenate([held[i][1], np.round(v, 6)])
                top = np.lexsort((order[hit], -v))[:k]
                held[i] = hit[top], v[top]
                if len(top) == k:
                    bounds[i] = max(5e-324, held[i][1][-1] - 1e-6)
        which = np.repeat(np.arange(sets.num_rows), [len(h) for h, _ in held])
        return pa.table([sets["_sid"].take(pa.array(which)), keys.take(pa.array(np.concatenate([h for h, _ in held]))), pa.array(np.concatenate([v for _, v in held]))], names=names)

    return run


def ranked(scores: DataFrame, q: str, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(q).orderBy(F.desc("score"), key)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def normalised(v: Column) -> Column:
    """A vector of length 1; null for null, empty or zero vectors."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def cosine(queries: DataFrame, vectors: DataFrame, q: str, key: str, vec: str, k: int, block: int = 4_096) -> DataFrame:
    """(q, key, score, rank): exact nearest vectors by cosine, block by block.

    Vectors are spread over blocks of rows and meet every block of queries once; a task holds one block of each and keeps
    the k best, so that only k rows per query and block of rows are shuffled. Vectors that are null, zero or of another
    length than the query's have no score.
    """
    n_q, n_v = queries.count(), vectors.count()
    qb, vb = max(1, -(-n_q // block)), max(1, -(-n_v // (16 * block)))
    left = queries.select(F.col(q).alias("_q"), F.col(vec).cast("array<double>").alias("_v"), F.pmod(F.xxhash64(q), F.lit(qb)).alias("_qb")).where("_v is not null").withColumn("_vb", F.explode(F.sequence(F.lit(0), F.lit(vb - 1))))
    right = vectors.select(F.col(key).alias("_k"), F.col(vec).cast("array<double>").alias("_v"), F.pmod(F.xxhash64(key), F.lit(vb)).alias("_vb")).where("_v is not null").withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size in {len(v) for v in a["_v"]} & {len(v) for v in b["_v"]} - {0}:
            x, y = a[a["_v"].map(len) == size], b[b["_v"].map(len) == size]
            mx, my = np.stack(x["_v"]), np.stack(y["_v"])
            nx, ny = np.linalg.norm(mx, axis=1), np.linalg.norm(my, axis=1)
            x, mx, y, my = x[nx > 0], mx[nx > 0] / nx[nx > 0, None], y[ny > 0], my[ny > 0] / ny[ny > 0, None]
            if not len(x) or not len(y):
                continue
            score = np.round(mx @ my.T, 6)
            ids = y["_k"].to_numpy()
            for i, qid in enumerate(x["_q"]):
                order = np.lexsort((ids, -score[i]))[:k]
                out.append(pd.DataFrame({"_q": qid, "_k": ids[order], "score": score[i][order]}))
        return pd.concat(out) if out else pd.DataFrame({"_q": [], "_k": [], "score": []})

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    got = left.groupBy("_qb", "_vb").cogroup(right.groupBy("_qb", "_vb")).applyInPandas(best, f"_q {kind(queries, q)}, _k {kind(vectors, key)}, score double")
    return ranked(got.select(F.col("_q").alias(q), F.col("_k").alias(key), "score"), q, key, k)


def fused(rankings: list[DataFrame], q: str, key: str, k: int = RRF_K) -> DataFrame:
    """(q, key, score, rank) by reciprocal ranks; of equals the one that an earlier ranking has, at the better place."""
    every = None
    for no, r in enumerate(rankings):
        part = r.select(q, key, "rank", F.lit(no).alias("_no"))
        every = part if every is None else every.unionByName(part)
    scores = every.groupBy(q, key).agg(F.round(F.sum(F.lit(1.0) / (k + F.col("rank"))), 9).alias("score"), F.min(F.struct("_no", "rank")).alias("_seen"))
    w = Window.partitionBy(q).orderBy(F.desc("score"), "_seen", key)
    return scores.withColumn("rank", F.row_number().over(w)).drop("_seen")


def capped(ranking: DataFrame, parents: DataFrame, q: str, key: str, per_parent: int, k: int) -> DataFrame:
    """The first k of each query with at most per_parent documents of one parent, and those left out before the k-th.

    (q, key, rank, parent, kept, place): place is the rank among the kept, null for those left out.
    """
    rows = ranking.join(parents.select(key, "parent"), key, "left").withColumn("parent", F.coalesce("parent", F.col(key).cast("string")))
    own = Window.partitionBy(q, "parent").orderBy("rank")
    rows = rows.withColumn("_ok", F.row_number().over(own) <= per_parent)
    done = Window.partitionBy(q).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(q).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_n", F.sum(F.col("_ok").cast("int")).over(done)).withColumn("_b", F.coalesce(F.sum(F.col("_ok").cast("int")).over(before), F.lit(0)))
    return rows.where(F.col("_b") < k).select(q, key, "rank", "parent", F.col("_ok").alias("kept"), F.when(F.col("_ok"), F.col("_n")).alias("place"))


def _units(text: str, room: int) -> np.ndarray:
    """(start, stop) of what stays whole; a unit longer than room is cut at every room characters, as nothing else is left."""
    spans = []
    for m in _UNIT.finditer(text):
        spans += [(at, min(at + room, m.end())) for at in range(m.start(), m.end(), room)]
    return np.array(spans, np.int64).reshape(-1, 2)


def evidence_span(text: str, words: list[str], units: np.ndarray, room: int) -> tuple[int, int] | None:
    """(first, last) unit of the stretch within room that has most different terms, then most hits; the earliest of equals.

    Of every term the number of its hits up to each unit is known, so any stretch is counted by two look-ups. None without
    a hit. A stretch begins and ends with a hit.
    """
    low = text.lower()
    terms_ = list(dict.fromkeys(w.lower() for w in words if len(w) >= MIN_TERM))
    if len(low) != len(text) or not len(units):
        low = text
    hits = np.zeros((len(terms_), len(units) + 1), np.int64)
    for k, t in enumerate(terms_):
        at = [m.start() for m in re.finditer(re.escape(t), low)]
        np.add.at(hits[k], np.searchsorted(units[:, 0], at, side="right"), 1)
    until = hits.cumsum(axis=1)
    firsts = np.flatnonzero(hits[:, 1:].any(axis=0))
    if not len(firsts):
        return None
    lasts = np.searchsorted(units[:, 1], units[firsts, 0] + room, side="right") - 1
    lasts = firsts[np.searchsorted(firsts, lasts, side="right") - 1]  # back to the last unit with a hit
    inside = until[:, lasts + 1] - until[:, firsts]
    best = int(np.lexsort((firsts, -inside.sum(axis=0), -(inside > 0).sum(axis=0)))[0])
    return int(firsts[best]), int(lasts[best])


def window(text: str | None, words: list[str], most: int, lead: float = 0.25) -> str:
    """At most `most` characters of text around its evidence, ellipses included, cut between units only.

    What room the evidence leaves goes before it by the share `lead`, then after it, then before it again. Without a hit it
    is the beginning. A text within `most` stays as it is; null and blank texts give an empty one.
    """
    text = (text or "").strip()
    if len(text) <= most:
        return text
    room = max(1, most - 4)
    units = _units(text, room)
    first, last = evidence_span(text, words, units, room) or (0, 0)

    def leftmost(reach: float) -> int:
        return int(np.searchsorted(units[:, 0], units[last, 1] - reach, side="left"))

    spare = room - (units[last, 1] - units[first, 0])
    first = min(first, leftmost(room - spare * (1 - lead)))
    last = int(np.searchsorted(units[:, 1], units[first, 0] + room, side="right")) - 1
    first = min(first, leftmost(room))
    start, stop = units[first, 0], units[last, 1]
    return ("… " if start else "") + text[start:stop] + (" …" if stop < len(text) else "")


def windows(rows: DataFrame, text: str, words: str, most: int) -> DataFrame:
    """rows with snippet, the evidence window of text for the array of words; null text gives null."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def cut(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for t, w in parts:
            yield pd.Series([None if a is None else window(a, [] if b is None else list(b), most) for a, b in zip(t, w)], dtype=object)

    return rows.withColumn("snippet", cut(F.col(text), F.col(words)))
