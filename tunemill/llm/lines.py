"""Lines that a site repeats over its documents: find them and take them out.

1. Every partition keeps a Misra-Gries summary of the line keys of each source. Its capacity follows the data: counts are
   lowered only while the sum of all lowerings stays within half of min_share of the documents seen, so that summaries
   merge by plain addition and never lose a line that reaches min_share. The merge is a distributed sum.
2. Candidates (at least half of min_share by summary) are counted exactly, as strings, in a second pass.
3. Confirmed lines go back to the documents as one set per source. At most mean lines per document / min_share lines of
   a source can reach min_share; the sets are broadcast if their counted rows allow it and joined by shuffle otherwise.

A line ends at a line feed; its key is its letters (Unicode L), lower-cased; keys of fewer than min_letters letters don't
count. Rows with a null source belong to no source: nothing of them is found or removed. Null texts count as documents of
their source and stay null; an exact copy of a row is another document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunemill.session import BROADCAST_ROWS, fits, settle, source_name


@dataclass(frozen=True)
class LineCfg:
    min_letters: int = 24
    min_docs: int = 5
    min_share: float = 0.05
    #: First capacity of a summary; it grows where the error bound asks for it.
    capacity: int = 2_000
    #: Keys that a partition's summaries hold together before they are passed on and begun anew, which adds to no error.
    held_keys: int = 1_000_000
    broadcast_rows: int = BROADCAST_ROWS


def line_keys(text: Column, min_letters: int) -> Column:
    """Array with the key of each line, null where the line doesn't count."""
    letters = F.split(F.regexp_replace(text, r"[^\p{L}\n]+", ""), "\n", -1)
    return F.transform(letters, lambda x: F.when(F.length(x) >= min_letters, F.lower(x)))


class Summary:
    """Misra-Gries counters of one source: sorted keys, counts, the error so far and the documents seen."""

    def __init__(self, capacity: int, share: float):
        self.keys, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.error, self.docs, self.capacity, self.share = 0, 0, capacity, share

    def add(self, keys: np.ndarray, docs: int) -> None:
        self.docs += docs
        every = np.concatenate([self.keys, keys])
        weight = np.concatenate([self.counts, np.ones(len(keys), np.int64)])
        self.keys, at = np.unique(every, return_inverse=True)
        self.counts = np.bincount(at, weights=weight, minlength=len(self.keys)).astype(np.int64)
        while len(self.keys) > self.capacity:
            lower = int(np.partition(self.counts, -self.capacity)[-self.capacity])
            if self.error + lower > 0.5 * self.share * self.docs:
                self.capacity *= 2
                continue
            self.error += lower
            left = self.counts > lower
            self.keys, self.counts = self.keys[left], self.counts[left] - lower


def _summaries(cfg: LineCfg):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, Summary] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for name, s in kept.items():
                for at in range(0, len(s.keys), 20_000):
                    part = slice(at, at + 20_000)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(s.keys[part]), pa.string()), pa.array(s.keys[part]), pa.array(s.counts[part])], names=["_src", "_hash", "_n"])
            kept.clear()

        for batch in batches:
            source = batch.column("_src").dictionary_encode()
            names, code = source.dictionary.to_pylist(), source.indices.to_numpy(zero_copy_only=False)
            lists = batch.column("_hashes")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            size = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(code, size)
            order = np.argsort(owner, kind="stable")
            bounds = np.searchsorted(owner[order], np.arange(len(names) + 1))
            docs = np.bincount(code, minlength=len(names))
            for i, name in enumerate(names):
                kept.setdefault(name, Summary(cfg.capacity, cfg.min_share)).add(flat[order[bounds[i] : bounds[i + 1]]], int(docs[i]))
            if sum(len(s.keys) for s in kept.values()) > cfg.held_keys:
                yield from passed_on()
        yield from passed_on()

    return run


def _sets(pairs: DataFrame, value: str, broadcast: bool) -> DataFrame:
    sets = pairs.groupBy("_src").agg(F.collect_list(value).alias("_set"))
    return F.broadcast(sets) if broadcast else sets


def _let(value: Column, then) -> Column:
    """then(value), with value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _matches(docs: DataFrame, pairs: DataFrame, value: str, cfg: LineCfg) -> DataFrame:
    """docs (with _src) and _hits: the lines of a document, as (no, key), whose key or hash is in pairs(_src, value)."""
    keyed = docs.where(F.col("text").isNotNull() & F.col("_src").isNotNull()).withColumn("_keys", line_keys(F.col("text"), cfg.min_letters))
    probe = (lambda k: F.xxhash64(k)) if value == "_hash" else (lambda k: k)
    lines = F.transform("_keys", lambda k, i: F.struct((i + 1).cast("int").alias("no"), k.alias("key")))
    if fits(pairs, cfg.broadcast_rows):
        met = F.array_intersect(F.transform("_keys", probe), "_set")  # by hashing; few are left to look through line by line
        hits = _let(met, lambda some: F.when(F.size(some) > 0, F.filter(lines, lambda x: x["key"].isNotNull() & F.array_contains(some, probe(x["key"])))))
        joined = keyed.join(_sets(pairs, value, True), "_src").withColumn("_hits", hits)
        return joined.where(F.size("_hits") > 0).drop("_set", "_keys")
    rows = keyed.select("_src", "doc_id", F.explode(lines).alias("_hit")).where(F.col("_hit.key").isNotNull())
    rows = rows.withColumn(value, probe(F.col("_hit.key")))
    return rows.join(pairs.select("_src", value), ["_src", value]).select("_src", "doc_id", F.array("_hit").alias("_hits"))


def repeated_lines(docs: DataFrame, cfg: LineCfg = LineCfg()) -> DataFrame:
    """(source, key, n_docs, of_docs): the excessively repeated lines of each source, settled.

    docs needs text and source; other columns are ignored, whatever their names.
    """
    base = docs.select(F.monotonically_increasing_id().alias("doc_id"), "text", source_name("source").alias("_src"))
    of_source = settle(base.where(F.col("_src").isNotNull()).groupBy("_src").agg(F.count("*").alias("_of")))
    keys = F.filter(line_keys(F.col("text"), cfg.min_letters), lambda k: k.isNotNull())
    hashed = base.where(F.col("_src").isNotNull()).select("_src", F.coalesce(F.array_distinct(F.transform(keys, lambda k: F.xxhash64(k))), F.array().cast("array<bigint>")).alias("_hashes"))
    summed = hashed.mapInArrow(_summaries(cfg), "_src string, _hash bigint, _n bigint").groupBy("_src", "_hash").agg(F.sum("_n").alias("_n"))
    of = F.broadcast(of_source) if fits(of_source, cfg.broadcast_rows) else of_source
    candidates = settle(summed.join(of, "_src").where((F.col("_n") >= 0.5 * cfg.min_share * F.col("_of")) & (F.col("_of") >= cfg.min_docs)).select("_src", "_hash"))
    hits = _matches(base, candidates, "_hash", cfg)
    per_doc = hits.select("_src", "doc_id", F.explode(F.array_distinct(F.transform("_hits", lambda x: x["key"]))).alias("key"))
    counted = per_doc.groupBy("_src", "key").agg(F.countDistinct("doc_id").alias("n_docs")) if "text" not in hits.columns else per_doc.groupBy("_src", "key").agg(F.count("*").alias("n_docs"))
    sure = counted.join(of, "_src").where((F.col("n_docs") >= cfg.min_docs) & (F.col("n_docs") / F.col("_of") >= cfg.min_share))
    return settle(sure.select(F.col("_src").alias("source"), "key", "n_docs", F.col("_of").alias("of_docs")))


def repeated_positions(docs: DataFrame, lines: DataFrame, cfg: LineCfg = LineCfg()) -> DataFrame:
    """(doc_id, line_no) of each line of docs that is in lines, counted from 1."""
    base = docs.select("doc_id", "text", source_name("source").alias("_src"))
    pairs = lines.select(F.col("source").alias("_src"), "key")
    return _matches(base, pairs, "key", cfg).select("doc_id", F.explode("_hits").alias("_hit")).select("doc_id", F.col("_hit.no").alias("line_no"))


def without_repeated(docs: DataFrame, lines: DataFrame, cfg: LineCfg = LineCfg()) -> DataFrame:
    """docs with its text less the lines in `lines`, the rest unchanged, and n_removed (a column of that name is replaced). All other columns stay.

    The set of a source has at most 1 / min_share times its mean lines per document, so one row carries it.
    """
    sets = lines.groupBy(F.col("source").alias("_tm_src")).agg(F.collect_list("key").alias("_tm_set"))
    joined = docs.withColumn("_tm_src", source_name("source")).join(F.broadcast(sets) if fits(lines, cfg.broadcast_rows) else sets, "_tm_src", "left")
    keys = line_keys(F.col("text"), cfg.min_letters)
    pieces = F.arrays_zip(F.split("text", "\n", -1).alias("line"), keys.alias("key"))
    left = _let(F.array_intersect(keys, "_tm_set"), lambda some: F.filter(pieces, lambda x: x["key"].isNull() | ~F.array_contains(some, x["key"])))
    gone = F.size(F.split("text", "\n", -1)) - F.size(left)
    changed = F.col("_tm_set").isNotNull() & F.col("text").isNotNull()
    joined = joined.withColumn("n_removed", F.when(changed, gone).otherwise(0))
    joined = joined.withColumn("text", F.when(changed & (F.col("n_removed") > 0), F.array_join(F.transform(left, lambda x: x["line"]), "\n")).otherwise(F.col("text")))
    return joined.drop("_tm_src", "_tm_set")
