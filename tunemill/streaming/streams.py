"""Structured Streaming forms of the polling, abort, incremental and stateful behaviours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tunemill.operators.calibration import pi_step


def telemetry_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 8) -> DataFrame:
    """New Parquet files of a folder as a stream; naive times become timestamps."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in rows.schema if f.dataType.typeName() == "timestamp_ntz"})


def over_limit(rows: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Rows in which any device is at or over a limit, with the channels that are."""
    hits = F.array_compact(F.array(*(F.when(F.col(c) >= x, c) for c, x in limits.items())))
    return rows.withColumn("over", hits).where(F.size("over") > 0)


def append_csv(rows: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to CSV files, each with its header; all that is there now if once, else as it comes."""
    w = rows.writeStream.format("csv").option("path", path).option("checkpointLocation", checkpoint).option("header", "true").outputMode("append")
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="5 seconds")).start()


def abort_on(rows: DataFrame, limits: dict[str, float], checkpoint: str, act: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Call act with each batch's rows over a limit, if there are any."""
    def each(batch: DataFrame, no: int) -> None:
        hot = over_limit(batch, limits)
        if hot.limit(1).count():
            act(hot, no)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(rows: DataFrame, ts: str, keys: list[str], length: str, slide: str | None, late: str, aggs: list) -> DataFrame:
    """Aggregates over tumbling or sliding windows; rows later than `late` are left out."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return rows.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *[c for c in _names(aggs)])


def sessions(rows: DataFrame, ts: str, keys: list[str], gap: str, late: str, aggs: list) -> DataFrame:
    w = F.session_window(ts, gap)
    return rows.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *[c for c in _names(aggs)])


def _names(aggs: list) -> list[str]:
    return [a._jc.toString().rsplit(" AS ", 1)[-1].strip("`") for a in aggs]


def agreement_state(rows: DataFrame, key: str, vote: str, order: str, need: int = 3, patience: int = 4) -> DataFrame:
    """(key, vote, streak, decision) for each incoming vote: `edit` from the need-th equal vote in a row, `escalate` after
    `patience` votes without an edit, else `wait`. The streak lives in the state of its key."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, streak, idle = state.get if state.exists else (None, 0, 0)
        for b in batches:
            out = []
            for v in b.sort_values(order)[vote]:
                streak = streak + 1 if v == last else 1
                last = v
                decision = "edit" if streak >= need else "wait"
                idle = 0 if decision == "edit" else idle + 1
                if idle >= patience:
                    decision = "escalate"
                out.append((k[0], v, streak, decision))
            yield pd.DataFrame(out, columns=["key", "vote", "streak", "decision"])
        state.update((last, streak, idle))

    return rows.select(key, vote, order).groupBy(key).applyInPandasWithState(step, "key string, vote string, streak int, decision string", "last string, streak int, idle int", "append", GroupStateTimeout.NoTimeout)


def integrator_state(rows: DataFrame, key: str, error: str, order: str, kp: float = 0.5, ki: float = 0.05, damping: float = 0.7, limit: float = 0.03) -> DataFrame:
    """(key, error, step): a controller's step for each error, its integral kept per key and frozen while the step saturates."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (total,) = state.get if state.exists else (0.0,)
        for b in batches:
            out = []
            for e in b.sort_values(order)[error]:
                step, total = map(float, pi_step(float(e), total, kp, ki, damping, limit))
                out.append((k[0], float(e), step))
            yield pd.DataFrame(out, columns=["key", "error", "step"])
        state.update((total,))

    return rows.select(key, error, order).groupBy(key).applyInPandasWithState(run, "key string, error double, step double", "total double", "append", GroupStateTimeout.NoTimeout)


def miss_state(passes: DataFrame, key: str, seen: str, order: str, gone_after: int = 3) -> DataFrame:
    """(key, misses, gone) for each pass over a document; seeing it again starts over."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (misses,) = state.get if state.exists else (0,)
        for b in batches:
            out = []
            for s in b.sort_values(order)[seen]:
                misses = 0 if s else misses + 1
                out.append((k[0], misses, misses >= gone_after))
            yield pd.DataFrame(out, columns=["key", "misses", "gone"])
        state.update((misses,))

    return passes.select(key, seen, order).groupBy(key).applyInPandasWithState(run, "key string, misses int, gone boolean", "misses int", "append", GroupStateTimeout.NoTimeout)


def resumable(rows: DataFrame, work: Callable[[DataFrame], DataFrame], done: str, failed: str, checkpoint: str) -> StreamingQuery:
    """Work through what is there and not yet done; results with an error go to a table of their own. A restart goes on
    where the checkpoint is."""
    def each(batch: DataFrame, no: int) -> None:
        out = work(batch).persist()
        out.where("error is null").write.mode("append").parquet(done)
        out.where("error is not null").write.mode("append").parquet(failed)
        out.unpersist()

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
