"""The score cutoff of each group that keeps a target fraction of it, exact at any size.

Quantile sketches with a guaranteed rank error (Greenwald-Khanna, mergeable, built map-side) bracket the cutoff of every
group. Records above the bracket are counted, and only the distinct scores inside it are sorted. While a bracket holds
more distinct scores than one task should sort, its records are sketched again, which narrows it by the sketch's
accuracy. Ties never split: a cutoff keeps all records of its score.

The cutoff is the highest score c for which (records scoring c or more) / (records scored) >= target. Null and NaN scores
are not scored. A target of at most 0 keeps the best score's records; a target above 1 can't be met and gives no row, as
does a null one. Groups without a scored record give no row. Targets repeated for a group give one row for each distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunemill.session import settle, small, source_name

ACCURACY = 2_000
SORTED_AT_MOST = 100_000


def cutoffs(scored: DataFrame, targets: DataFrame, keys: list[str], accuracy: int = ACCURACY, sorted_at_most: int = SORTED_AT_MOST) -> DataFrame:
    """(keys..., target_frac, cutoff double, kept, scored) for scored(keys..., score) and targets(keys..., target_frac).

    A null key is no group. scored and targets may have further columns; they are ignored.
    """
    some = F.lit(True)
    for k in keys:
        some = some & F.col(k).isNotNull()
    goals = targets.select(*keys, F.col("target_frac").cast("double")).where(some & F.col("target_frac").between(float("-inf"), 1.0)).distinct()
    goals = small(goals)
    rows = scored.select(*keys, F.col("score").cast("double").alias("score")).where(some & F.col("score").isNotNull() & ~F.isnan("score"))
    joined = rows.join(goals, keys)
    group = [*keys, "target_frac"]
    # The smallest number k with k / n >= target, by the same division that states the condition.
    n, t = F.col("scored"), F.col("target_frac")
    guess = F.greatest(F.lit(1), F.ceil(t * n))
    need: Column = F.when((guess > 1) & ((guess - 1) / n >= t), guess - 1).when(guess / n < t, guess + 1).otherwise(guess)

    def bracket(part: DataFrame, known: DataFrame | None) -> DataFrame:
        """lo and hi around the cutoff: the quantiles two rank errors to either side of it."""
        marks = F.percentile_approx("score", F.array([F.lit(i / accuracy) for i in range(0, accuracy + 1, max(1, accuracy // 500))]), F.lit(accuracy))
        found = part.groupBy(*group).agg(F.count("*").alias("_in"), marks.alias("_marks"), F.min("score").alias("_min"), F.max("score").alias("_max"))
        if known is None:
            found = found.withColumn("scored", F.col("_in")).withColumn("need", need).withColumn("above", F.lit(0).cast("bigint"))
        else:
            found = found.join(known.select(*group, "scored", "need", "above"), group)
        rank = 1 - (F.col("need") - F.col("above")) / F.col("_in")
        step = max(1, accuracy // 500) / accuracy
        at = lambda p: F.element_at("_marks", (F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)) / step).cast("int") + 1)
        slack = 2.0 / accuracy + 2 * step
        return found.select(*group, "scored", "need", F.when(rank - slack <= 0, F.col("_min")).otherwise(at(rank - slack)).alias("lo"), F.when(rank + slack >= 1, F.col("_max")).otherwise(at(rank + slack)).alias("hi"))

    def counted(marks: DataFrame) -> DataFrame:
        """above: records over hi; _distinct: an estimate of the scores to sort."""
        near = joined.join(small(marks), group)
        inside = (F.col("score") >= F.col("lo")) & (F.col("score") <= F.col("hi"))
        return settle(near.groupBy(*group, "scored", "need", "lo", "hi").agg(F.count_if(F.col("score") > F.col("hi")).alias("above"), F.count_if(inside).alias("inside"), F.approx_count_distinct(F.when(inside, F.col("score"))).alias("_distinct")))

    state = counted(settle(bracket(joined, None)))
    for _ in range(4):
        if not state.where(F.col("_distinct") > sorted_at_most).limit(1).count():
            break
        part = joined.join(small(state.select(*group, "lo", "hi")), group).where((F.col("score") >= F.col("lo")) & (F.col("score") <= F.col("hi")))
        state = counted(settle(bracket(part, state)))
    near = joined.join(small(state.select(*group, "scored", "need", "lo", "hi", "above")), group).where((F.col("score") >= F.col("lo")) & (F.col("score") <= F.col("hi")))
    by_score = near.groupBy(*group, "scored", "need", "above", "score").agg(F.count("*").alias("_n"))
    from pyspark.sql.window import Window

    down = Window.partitionBy(*group).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    run = by_score.withColumn("kept", F.col("above") + F.sum("_n").over(down)).where(F.col("kept") >= F.col("need"))
    best = run.groupBy(*group).agg(F.max_by(F.struct("score", "kept", "scored"), "score").alias("_best"))
    return best.select(*group, F.col("_best.score").alias("cutoff"), F.col("_best.kept").alias("kept"), F.col("_best.scored").alias("scored"))


def document_cutoffs(documents: DataFrame, keep_target: DataFrame) -> DataFrame:
    """(source, tier, cutoff, kept): the integer cutoff from 1 to 5 of each source name and tier; other scores don't count."""
    scored = documents.select(source_name("source").alias("source"), "tier", F.col("judge_score").alias("score")).where(F.col("judge_score").between(1, 5))
    targets = keep_target.select(source_name("source").alias("source"), "tier", "target_frac")
    # Scores are whole numbers, so the highest cutoff of 1...5 is the score of the last record needed; a target of at most 0 keeps none at 5.
    found = cutoffs(scored, targets, ["source", "tier"])
    none = F.col("target_frac") <= 0
    return found.select("source", "tier", F.when(none, 5).otherwise(F.col("cutoff").cast("int")).alias("cutoff"), F.when(none & (F.col("cutoff") < 5), 0).otherwise(F.col("kept")).alias("kept"))
