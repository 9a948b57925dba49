"""Drawing documents so that every source has its weight of the tokens of a mix, in a training order.

A mix's size is T, the tokens of all documents of its sources. Source s is due W_s(x) = T * integral of its weight
schedule from 0 to x by position x in [0, 1]. Its documents, in hash order, repeated up to max_repeats times, demand
tokens one after another; a copy stands at the position where W_s reaches the middle of its tokens, found by inverting
W_s, and is drawn if it begins before W_s(1). Range-sorting by (mix, position) gives the order of training.

Schedules are linear: weight * (start + 2 * (1 - start) * x), so `start` 1 is constant and every start from 0 to 2 has the
mean `weight`. Prefix sums of a source are made in two levels over hash buckets, so that no task holds a whole source.

Documents with a null source and null texts are drawn by no mix. A source without tokens reaches nothing. Weights that are
null or not positive draw nothing; a null max_repeats is none. Rows of a mix repeated for a source count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tunemill.llm.tokens import VOCABULARY, count_tokens
from tunemill.session import settle, small, source_name

#: Rows of a source that one window of the prefix sums holds, about; the number of hash buckets follows from it.
BUCKET_ROWS = 50_000
#: Sources that can have a schedule of their own; it is a literal of the plan. The rest are constant, which changes no share.
MOST_SCHEDULES = 1_000


def targets(mix_target: DataFrame) -> DataFrame:
    rows = mix_target.select("mix_id", source_name("source").alias("source"), F.col("weight").cast("double").alias("weight"), F.coalesce("max_repeats", F.lit(0)).cast("bigint").alias("max_repeats"))
    return rows.where(F.col("mix_id").isNotNull() & F.col("source").isNotNull()).groupBy("mix_id", "source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))


def mixed_tokens(documents: DataFrame, mix_target: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents of any source of a mix, settled. Null texts are left out."""
    wanted = small(settle(targets(mix_target).select("source").distinct()))
    rows = documents.select("doc_id", source_name("source").alias("source"), "text").where(F.col("text").isNotNull())
    return settle(count_tokens(rows.join(wanted, "source", "left_semi"), ["doc_id", "source"], path))


def plan(tokens: DataFrame, mix_target: DataFrame) -> DataFrame:
    """A row for each mix and source: its tokens t, the mix's T, what is due and the most that its repeats hold."""
    by_source = settle(tokens.groupBy("source").agg(F.sum("n_tokens").alias("t")))
    rows = targets(mix_target).join(small(by_source), "source", "left").withColumn("t", F.coalesce("t", F.lit(0).cast("bigint")))
    rows = rows.withColumn("total", F.sum("t").over(Window.partitionBy("mix_id")))
    due = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)) * F.col("total")
    rows = rows.withColumn("due", due).withColumn("most", F.col("max_repeats") * F.col("t"))
    return settle(rows)


def seats(tokens: DataFrame, planned: DataFrame, start: dict[str, float] | None = None, buckets: int | None = None) -> DataFrame:
    """(mix_id, source, doc_id, repeat_no, n_tokens, position): every copy that a mix draws, at its position.

    start gives the schedules by source name, from 0 to 2; a source that it doesn't name is constant. A copy is drawn if it
    begins before W_s(1), whatever the schedule, so schedules move copies and change no share.
    """
    if buckets is None:
        buckets = max(64, -(-tokens.count() // BUCKET_ROWS))
    seated = tokens.where(F.col("n_tokens") > 0).withColumn("_h", F.xxhash64(F.lit(7), "doc_id")).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    sums = settle(seated.groupBy("source", "_b").agg(F.sum("n_tokens").alias("_n")))
    before = F.sum("_n").over(Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    first = sums.select("source", "_b", F.coalesce(before, F.lit(0)).alias("_first"))
    inside = F.sum("n_tokens").over(Window.partitionBy("source", "_b").orderBy("_h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    line = seated.withColumn("_in", inside).join(small(first), ["source", "_b"]).withColumn("_from", F.col("_first") + F.col("_in") - F.col("n_tokens"))
    draw = line.join(small(planned.where(F.col("due") > 0).select("mix_id", "source", "t", "due", "max_repeats")), "source")
    rounds = F.least(F.col("max_repeats"), F.ceil((F.col("due") - F.col("_from")) / F.col("t")).cast("bigint"))
    draw = draw.where(rounds >= 1).withColumn("repeat_no", F.explode(F.sequence(F.lit(1).cast("bigint"), rounds)))
    mid = F.col("_from") + (F.col("repeat_no") - 1) * F.col("t") + F.col("n_tokens") / 2
    x = reached_at(F.least(F.lit(1.0), mid / F.col("due")), ramp(start))
    return draw.withColumn("position", x).select("mix_id", "source", "doc_id", F.col("repeat_no").cast("int").alias("repeat_no"), "n_tokens", "position")


def ramp(start: dict[str, float] | None) -> Column:
    """The start of a source's schedule relative to its weight; 1 where none is named."""
    named = [F.lit(x) for k, v in (start or {}).items() for x in (k, float(v))]
    return F.coalesce(F.try_element_at(F.create_map(*named), F.col("source")), F.lit(1.0)) if named else F.lit(1.0)


def demand(x: Column, a: Column) -> Column:
    """The share of its due that a source with start a is to have given by position x: the integral of its schedule."""
    return a * x + (1 - a) * x * x


def reached_at(share: Column, a: Column) -> Column:
    """The position at which that share is due: the inverse of demand."""
    root = F.sqrt(F.greatest(F.lit(0.0), a * a + 4 * (1 - a) * share))
    return F.when(F.abs(1 - a) < 1e-9, share).otherwise((root - a) / (2 * (1 - a)))


def positions(tokens: DataFrame, planned: DataFrame, start: dict[str, float] | None = None, buckets: int | None = None) -> DataFrame:
    """The seats in the order of training: sorted by mix and position, spread by range."""
    return seats(tokens, planned, start, buckets).repartitionByRange("mix_id", "position").sortWithinPartitions("mix_id", "position", "source", "doc_id", "repeat_no")


def shortfall(drawn: DataFrame, planned: DataFrame, start: dict[str, float] | None = None) -> DataFrame:
    """(mix_id, source, tokens, due, last, runs_dry) of the sources whose drawn copies don't reach what is due by position 1.

    last is the position of the last copy, runs_dry that at which the schedule asks for more than all of them hold.
    """
    got = drawn.groupBy("mix_id", "source").agg(F.sum("n_tokens").alias("tokens"), F.max("position").alias("last"))
    rows = planned.join(small(settle(got)), ["mix_id", "source"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0).cast("bigint")))
    dry = reached_at(F.when(F.col("due") > 0, F.least(F.lit(1.0), F.col("tokens") / F.col("due"))).otherwise(1.0), ramp(start))
    return rows.where(F.col("tokens") < F.col("due")).select("mix_id", "source", "tokens", "due", "last", dry.alias("runs_dry"))


def shares(drawn: DataFrame, planned: DataFrame) -> DataFrame:
    """What the mix really holds: tokens, documents and most repeats of each source, and its share of the mix."""
    got = drawn.groupBy("mix_id", "source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"), F.max("repeat_no").alias("repeats"))
    rows = planned.join(got, ["mix_id", "source"], "left").fillna(0, ["tokens", "rows", "repeats"])
    whole = F.sum("tokens").over(Window.partitionBy("mix_id"))
    return rows.select("mix_id", "source", "weight", "max_repeats", "t", "tokens", "rows", "repeats", F.when(whole > 0, F.round(F.col("tokens") / whole, 6)).otherwise(0.0).alias("share"), (F.col("tokens") < F.col("due")).alias("short"))
