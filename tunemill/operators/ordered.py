"""Neighbours, running totals and carried values along ordered histories, without holding a history in one task.

A history (the rows of one key) is split by a bucket that follows its order, a day of its time for instance. Windows run
within (key, bucket); what crosses a border comes from a table with one row per key and bucket, which is small enough for
a window per key. Every order must be total within a key: give a tie-breaking column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tunemill.session import settle, small

B = "_tm_bucket"


def day(ts: Column) -> Column:
    return F.unix_date(F.to_date(ts))


def paced(df: DataFrame, keys: list[str], ts: str, name: str, rows: int = 100_000) -> DataFrame:
    """df with a bucket number of its time (a number or timestamp) by key, wide enough for about `rows` rows on average.

    Only keys of more rows are split at all; there are at most (all rows / rows) of them, whose bounds are broadcast if that
    is few. Rows without a time are in the first bucket of their key.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp")) if df.schema[ts].dataType.typeName().startswith("timestamp") else F.col(ts).cast("double")
    known = [F.col(k).alias(f"_p{i}") for i, k in enumerate(keys)]
    hot = settle(df.select(*known, at.alias("_at")).groupBy(*[f"_p{i}" for i in range(len(keys))]).agg(F.count("*").alias("_pn"), F.min("_at").alias("_lo"), F.max("_at").alias("_hi")).where(F.col("_pn") > rows))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_p{i}"))
    part = F.ceil(F.col("_pn") / rows)
    no = F.least(part - 1, F.floor((at - F.col("_lo")) * part / F.greatest(F.lit(1.0), F.col("_hi") - F.col("_lo"))))
    return df.join(small(hot), same, "left").withColumn(name, F.coalesce(no, F.lit(0)).cast("bigint")).drop("_pn", "_lo", "_hi", *[f"_p{i}" for i in range(len(keys))])


def _inside(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys, B).orderBy(*order)


def _along(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(B)


def _joined(rows: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    cond = rows[B].eqNullSafe(edges[B])
    for k in keys:
        cond = cond & rows[k].eqNullSafe(edges[k])
    return rows.join(edges, cond, "left").select(rows["*"], *[edges[c] for c in edges.columns if c not in (*keys, B)])


def with_neighbours(df: DataFrame, keys: list[str], order: list[str], bucket: Column, values: list[str]) -> DataFrame:
    """df with prev_x and next_x for each x of values, and is_first and is_last of its history."""
    rows = df.withColumn(B, bucket)
    w = _inside(keys, order)
    packed = F.struct(*values)
    place = F.struct(*order)
    edges = rows.groupBy(*keys, B).agg(F.min_by(packed, place).alias("_f"), F.max_by(packed, place).alias("_l"))
    edges = edges.select(*keys, B, F.lag("_l").over(_along(keys)).alias("_tm_p"), F.lead("_f").over(_along(keys)).alias("_tm_n"))
    inner = rows.withColumn("_tm_lag", F.lag(packed).over(w)).withColumn("_tm_lead", F.lead(packed).over(w))
    both = _joined(inner, edges, keys)
    prev, after = F.coalesce("_tm_lag", "_tm_p"), F.coalesce("_tm_lead", "_tm_n")
    both = both.withColumn("is_first", prev.isNull()).withColumn("is_last", after.isNull())
    for v in values:
        both = both.withColumn(f"prev_{v}", prev[v]).withColumn(f"next_{v}", after[v])
    return both.drop(B, "_tm_lag", "_tm_lead", "_tm_p", "_tm_n")


def running_total(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: Column, name: str) -> DataFrame:
    """df with the sum of value up to and including each row; nulls add nothing."""
    rows = df.withColumn(B, bucket).withColumn("_tm_v", F.coalesce(value, F.lit(0)))
    sums = rows.groupBy(*keys, B).agg(F.sum("_tm_v").alias("_s"))
    sums = sums.select(*keys, B, F.coalesce(F.sum("_s").over(_along(keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_tm_before"))
    inner = rows.withColumn("_tm_in", F.sum("_tm_v").over(_inside(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return _joined(inner, sums, keys).withColumn(name, F.col("_tm_in") + F.col("_tm_before")).drop(B, "_tm_v", "_tm_in", "_tm_before")


def carried(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str) -> DataFrame:
    """df with last_x, the last non-null x up to each row, and first_x, the first from it on."""
    rows = df.withColumn(B, bucket)
    place = F.struct(*order)
    there = F.when(F.col(value).isNotNull(), place)
    edges = rows.groupBy(*keys, B).agg(F.max_by(value, there).alias("_l"), F.min_by(value, there).alias("_f"))
    before = F.last("_l", ignorenulls=True).over(_along(keys).rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_f", ignorenulls=True).over(_along(keys).rowsBetween(1, Window.unboundedFollowing))
    edges = edges.select(*keys, B, before.alias("_tm_p"), after.alias("_tm_n"))
    w = _inside(keys, order)
    inner = rows.withColumn("_tm_lag", F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_tm_lead", F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    both = _joined(inner, edges, keys)
    return both.withColumn(f"last_{value}", F.coalesce("_tm_lag", "_tm_p")).withColumn(f"first_{value}", F.coalesce("_tm_lead", "_tm_n")).drop(B, "_tm_lag", "_tm_lead", "_tm_p", "_tm_n")


def runs(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str) -> DataFrame:
    """Stretches of equal value, nulls equal to each other: (keys..., value, run, n, start, stop as structs of order)."""
    near = with_neighbours(df, keys, order, bucket, [value])
    change = F.when(F.col("is_first") | ~F.col(value).eqNullSafe(F.col(f"prev_{value}")), 1).otherwise(0)
    numbered = running_total(near.select(*keys, *order, value, change.alias("_tm_c"), bucket.alias("_tm_b")), keys, order, F.col("_tm_b"), F.col("_tm_c"), "run")
    return numbered.groupBy(*keys, "run", value).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("start"), F.max(F.struct(*order)).alias("stop"))
