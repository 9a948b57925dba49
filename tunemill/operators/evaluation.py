"""Comparing raters, runs and answers; grading values against evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tunemill.functions.text import healed, numbers
from tunemill.session import settle

KEEP = 4
#: Classes in which an answer committed to a value.
ANSWERED = ("exact", "dangerous_miss", "unit_mismatch", "range_mismatch", "ambiguous_parse", "unparseable")


def average_ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """rows with the mean rank of equal values, from counts of distinct values: no sort of the rows.

    The distinct values are sorted by range; each range counts on its own, from the sums of the ranges before it.
    """
    counts = settle(rows.groupBy(value).agg(F.count("*").alias("_n")).repartitionByRange(value).withColumn("_part", F.spark_partition_id()))
    sums = counts.groupBy("_part").agg(F.sum("_n").alias("_sum"))
    earlier = F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sums.select("_part", earlier.alias("_earlier"))  # a row for each range
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.withColumn("_inside", inside).join(F.broadcast(before), "_part").select(value, (F.col("_earlier") + F.col("_inside") + (F.col("_n") + 1) / 2).alias(name))
    return rows.join(ranks, value)


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row (spearman): the correlation of average ranks, 0 without variance."""
    ranked = average_ranks(average_ranks(rows, a, "_ra"), b, "_rb")
    return ranked.agg(F.coalesce(F.nanvl(F.corr("_ra", "_rb"), F.lit(0.0)), F.lit(0.0)).alias("spearman"))


def agreement(rows: DataFrame, truth: str, judged: str, keep: int = KEEP) -> DataFrame:
    """One row of agreement metrics of two scores from 1 to 5."""
    t, j = F.col(truth), F.col(judged)
    pct = lambda c: 100.0 * F.count_if(c) / F.count("*")
    return rows.agg(
        F.count("*").alias("n"),
        pct(t == j).alias("exact_pct"),
        pct(F.abs(t - j) <= 1).alias("within1_pct"),
        pct((t >= keep) == (j >= keep)).alias("keep_agree_pct"),
        F.count_if((t <= 2) & (j >= keep)).alias("dangerous"),
    )


def confusion(rows: DataFrame, truth: str, judged: str) -> DataFrame:
    """truth 1 to 5 against judged 1 to 5, empty cells included."""
    cells = rows.groupBy(F.col(truth).alias("truth")).agg(*(F.count_if(F.col(judged) == k).alias(f"j{k}") for k in range(1, 6)))
    every = rows.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("truth"))
    return every.join(cells, "truth", "left").na.fill(0)


def value_scores(rows: DataFrame, keys: list[str], n_expected: int | None = None) -> DataFrame:
    """Per key: class counts, rates, precision, coverage, the hard gate and token medians."""
    cls = F.col("answer_class")
    n, answered = F.count("*"), F.count_if(cls.isin(*ANSWERED))
    gate = F.when(F.col("dangerous") > 0, "FAIL").otherwise("pass")
    if n_expected is not None:
        gate = F.when(F.col("n") != n_expected, "INCOMPLETE").otherwise(gate)
    return (
        rows.groupBy(*keys)
        .agg(
            n.alias("n"),
            F.count_if(cls == "exact").alias("exact"),
            F.count_if(cls == "dangerous_miss").alias("dangerous"),
            F.count_if(cls == "honest_decline").alias("declined"),
            answered.alias("answered"),
            F.round(F.count_if(cls == "exact") / n, 6).alias("match_rate"),
            F.round(F.coalesce(F.try_divide(F.count_if(cls == "exact"), answered), F.lit(0.0)), 6).alias("precision"),
            F.round(answered / n, 6).alias("coverage"),
        )
        .withColumn("hard_gate", gate)
    )


def upper_medians(rows: DataFrame, keys: list[str], col: str) -> DataFrame:
    """(keys..., upper_median): the higher of the two middle values, from counts of distinct values."""
    counts = rows.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count("*").alias("_n"))
    run = Window.partitionBy(*keys).orderBy(col).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*keys)
    ranked = counts.withColumn("_to", F.sum("_n").over(run)).withColumn("_all", F.sum("_n").over(all_))
    return ranked.where(F.col("_to") > F.floor(F.col("_all") / 2)).groupBy(*keys).agg(F.min(col).alias("upper_median"))


def throughput(tokens: str, seconds: str) -> Column:
    ok = F.col(tokens).isNotNull() & (F.col(seconds) > 0)
    return F.round(F.try_divide(F.sum(F.when(ok, F.col(tokens))), F.sum(F.when(ok, F.col(seconds)))), 1)


def majority(rows: DataFrame, keys: list[str], vote: str, order: str) -> DataFrame:
    """The most frequent vote of each key; of equals the one seen first."""
    votes = rows.where(F.col(vote).isNotNull()).groupBy(*keys, vote).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return votes.groupBy(*keys).agg(F.max_by(F.struct(vote, "_n"), F.struct("_n", -F.col("_first"))).alias("_x")).select(*keys, F.col(f"_x.{vote}").alias("majority"), F.col("_x._n").alias("votes"))


def determinism(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """One row: how many keys either run has, and on how many both gave the same, non-blank value."""
    left, right = a.select(key, F.col(value).alias("_a")), b.select(key, F.col(value).alias("_b"))
    both = left.join(right, key, "full_outer")
    same = (F.col("_a") == F.col("_b")) & (F.trim("_a") != "")
    return both.agg(F.count("*").alias("n"), F.count_if(same).alias("same"))


def evidence_numbers(text: Column) -> Column:
    """The numbers of a text as it is and with torn digits joined; null for a null or blank text."""
    both = F.concat(numbers(text), F.when(healed(text) != text, numbers(healed(text))).otherwise(F.array().cast("array<double>")))
    return F.when(F.trim(text) != "", F.array_distinct(both))


def guard(value: Column, evidence: Column, tolerance: float = 0.01) -> Column:
    """Verdict of a stated value against arrays of texts: declined, no_numbers, no_evidence, cited or blocked.

    Value and evidence are read as they are and with torn digits joined; the reading with the fewest unmatched counts.
    """
    texts = F.filter(F.coalesce(evidence, F.array().cast("array<string>")), lambda t: F.trim(F.coalesce(t, F.lit(""))) != "")
    return guarded(value, F.flatten(F.transform(texts, evidence_numbers)), F.size(texts) > 0, tolerance)


def guarded(value: Column, pool: Column, supported: Column, tolerance: float = 0.01) -> Column:
    """The same from the numbers of the evidence, read once for each document; supported: is there any evidence?"""
    blank = F.coalesce(value, F.lit("")) == ""

    def unmatched(reading: Column) -> Column:
        return F.size(F.filter(reading, lambda x: ~F.exists(pool, lambda p: F.abs(x - p) <= F.greatest(F.abs(x) * tolerance, F.lit(1e-9)))))

    raw, joined = numbers(value), numbers(healed(value))
    fewest = F.least(unmatched(raw), unmatched(joined))
    return F.when(blank, "declined").when(F.size(raw) == 0, "no_numbers").when(~F.coalesce(supported, F.lit(False)), "no_evidence").when(fewest > 0, "blocked").otherwise("cited")


def guard_counts(rows: DataFrame, verdict: str, harmful: Column, right: Column) -> DataFrame:
    """One row (harmful, caught, right, false_blocks): what the guard blocked of harmful and of right answers."""
    blocked = F.col(verdict) == "blocked"
    return rows.agg(F.count_if(harmful).alias("harmful"), F.count_if(harmful & blocked).alias("caught"), F.count_if(right).alias("right"), F.count_if(right & blocked).alias("false_blocks"))


#: Relevances that a mix of pairs takes, ranks of depth, and topics that it lacks.
MIXED = ("subaru", "modern_general")
DEPTHS = {"deep": 2, "adequate": 1, "shallow": 0}
LACKING = ("maf", "idle", "ve_load", "injectors")


def pair_mix(pairs: DataFrame, verdicts: DataFrame, flagged: DataFrame, key: str) -> DataFrame:
    """Pairs that are not flagged, of a relevance that counts, and not shallow; with the verdicts' columns."""
    fit = verdicts.where(F.col("relevance").isin(*MIXED) & (F.col("depth") != "shallow"))
    return pairs.join(flagged.select(key).distinct(), key, "left_anti").join(fit, key)


def filled(mixed: DataFrame, room: int, sequence: str) -> DataFrame:
    """The first `room` of a mix: own platform, lacking topics, depth and length of the diagnosis first; equals in sequence."""
    depth = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in DEPTHS.items() for x in kv]), F.col("depth")), F.lit(-1))
    best = [F.desc(F.col("relevance") == "subaru"), F.desc_nulls_last(F.col("topic").isin(*LACKING)), F.desc(depth), F.desc_nulls_last(F.length("diagnosis")), F.asc(sequence)]
    return mixed.orderBy(*best).limit(room)


def numbered(rows: DataFrame, prefix: str, key: str, content: Column, schema: str, name: str) -> DataFrame:
    """An item for each entry of the array that content (JSON of a model) holds, with the id prefix-key-place, places from 0.

    Content that is null or no such JSON has no items.
    """
    items = F.from_json(content, schema)
    return rows.select(key, F.posexplode(items).alias("_k", "item")).select(F.concat_ws("-", F.lit(prefix), F.col(key).cast("string"), F.col("_k").cast("string")).alias(name), key, "item.*")


def diversity(rows: DataFrame, ids: str) -> DataFrame:
    """One row: queries, distinct documents, distinct ordered lists, and the most frequent list with its count."""
    r = rows.where(F.col(ids).isNotNull())
    lists = r.groupBy(ids).agg(F.count("*").alias("n"))
    top = lists.agg(F.max_by(F.struct("n", F.array_join(ids, ",").alias("ids")), F.struct("n", F.col(ids))).alias("t"), F.count("*").alias("lists"), F.sum("n").alias("queries"))
    docs = r.select(F.explode(F.array_distinct(ids)).alias("d")).agg(F.countDistinct("d").alias("docs"))
    return top.crossJoin(docs).select("queries", "docs", "lists", F.col("t.n").alias("top_n"), F.col("t.ids").alias("top_ids"))


def coverage(rows: DataFrame, ids: str, top: int) -> DataFrame:
    """The documents that most queries retrieved, with their share of queries."""
    n = rows.where(F.col(ids).isNotNull()).agg(F.count("*").alias("_q"))
    each = rows.select(F.explode(F.array_distinct(ids)).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("queries"))
    best = each.orderBy(F.desc("queries"), "doc_id").limit(top)
    return best.crossJoin(F.broadcast(n)).select("doc_id", "queries", F.round(100.0 * F.col("queries") / F.col("_q"), 4).alias("pct"))


def ledger_state(events: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """The latest state of each unit of an append-only event log."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias(state))
