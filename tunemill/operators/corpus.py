"""Ingest, gating and bookkeeping of documents as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tunemill.functions.text import TUNING_TERMS, has_word, stripped
from tunemill.session import source_name

#: Kinds whose documents are tables by nature.
TABLE_KINDS = ("ecu_definition", "logger_param", "datalog")
KEEP_SCORE = 4
SCATTER = 2_654_435_761


def gate(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """docs with gate_status and gate_flags as the quality gate sets them; null texts count as empty."""
    text = F.coalesce("text", F.lit(""))
    status = F.when(F.length(stripped(text)) < min_chars, "rejected:too_short").when(~text.rlike("[A-Za-z]"), "rejected:no_alpha").otherwise("kept")
    flags = F.array_compact(
        F.array(
            F.when(text.rlike("[0-9]"), "has_numbers"),
            F.when(text.contains("\t") | text.rlike(r"\|[^\n]*\|") | F.coalesce(F.col("kind").isin(*TABLE_KINDS), F.lit(False)), "has_table"),
            F.when(has_word(text, TUNING_TERMS) | has_word(F.coalesce("title", F.lit("")), TUNING_TERMS), "tuning_signal"),
            F.when(F.col("domain") == "subaru", "subaru"),
        )
    )
    return docs.withColumn("gate_status", status).withColumn("gate_flags", F.when(status == "kept", flags).otherwise(F.array().cast("array<string>")))


def content_hash(docs: DataFrame) -> DataFrame:
    """Identity of a document's content: source, id in its source and text."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return docs.withColumn("content_sha1", F.sha1(F.concat(empty("source"), F.char(F.lit(0)), empty("source_id"), F.char(F.lit(0)), empty("text"))))


def judge_queue(docs: DataFrame, limit: int, sources: list[str] | None = None) -> DataFrame:
    """Kept documents waiting for judgment, oldest first; those that are gone stay in the queue."""
    rows = docs.where((F.col("gate_status") == "kept") & (F.col("judgment_status") == "pending"))
    rows = rows.where(source_name("source").isin(*sources)) if sources else rows
    return rows.orderBy("doc_id").limit(limit)


def reference_kept(docs: DataFrame) -> DataFrame:
    return docs.where((F.col("tier") == "reference") & (F.col("gate_status") == "kept") & F.col("gone_at").isNull())


def community_kept(docs: DataFrame, min_score: int = KEEP_SCORE) -> DataFrame:
    """Gone documents included; unscored ones not."""
    return docs.where((F.col("tier") == "community") & (F.col("gate_status") == "kept") & (F.col("judge_score") >= min_score))


def title_ok(title: Column, keywords: list[str], reject: list[str]) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    hit = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)) if words else F.lit(False)
    return ~hit(reject) & (hit(keywords) if keywords else F.lit(True))


def policy(source: Column, tier: Column, by_source: dict[str, str]) -> Column:
    """How a document is judged: community in full, else by its source, the default, or lightly."""
    known = F.create_map(*[F.lit(x) for kv in by_source.items() for x in kv]) if by_source else F.create_map().cast("map<string,string>")
    return F.when(tier == "community", "full").otherwise(F.coalesce(F.try_element_at(known, source), F.lit(by_source.get("default")), F.lit("light_judge")))


def scattered(docs: DataFrame, limit: int) -> DataFrame:
    """A deterministic sample: ids in the order of a multiplicative hash."""
    return docs.withColumn("scatter", F.pmod(F.col("doc_id") * F.lit(SCATTER), F.lit(4_294_967_296))).orderBy("scatter", "doc_id").limit(limit)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by the given descending order."""
    return rows.withColumn("_tm_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_tm_n = 1").drop("_tm_n")


def judged_chunks(judgment: DataFrame) -> DataFrame:
    """The judgment that holds for each document, chunk and rubric: the last one stored."""
    return latest(judgment.where(F.col("doc_id").isNotNull()), ["doc_id", "chunk_index", "rubric_version"], [F.desc_nulls_last("stored_at"), F.desc_nulls_last("created_at"), F.desc_nulls_last("score"), F.desc_nulls_last("judge_model")])


def doc_scores(chunks: DataFrame, weights: DataFrame) -> DataFrame:
    """Per document: the least, the mean and the length-weighted mean of its chunk scores, means to even."""
    rows = chunks.where(F.col("score").between(1, 5)).join(weights.select("doc_id", "n_chars"), "doc_id")
    n = F.greatest(F.lit(1), F.coalesce("n_chars", F.lit(0)))
    return rows.groupBy("doc_id").agg(F.min("score").alias("min_score"), F.bround(F.avg("score")).cast("int").alias("mean_score"), F.bround(F.sum(F.col("score") * n) / F.sum(n)).cast("int").alias("weighted_score"), F.count("*").alias("chunks"))


def upsert(stored: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """stored after incoming documents came by, keyed by (source, source_id), with what happened to each.

    first_seen stays; a document that is seen again is no longer gone; its judgment is reset only if its content changed.
    Of several incoming rows of a key the one with the least content hash counts.
    """
    key = ["source", "source_id"]
    new = latest(incoming, key, [F.asc("content_hash")]).select(*key, *(F.col(c).alias(f"_new_{c}") for c in ("content_hash", "doc_id")))
    both = stored.join(new, key, "full_outer")
    seen, known = F.col("_new_content_hash").isNotNull(), F.col("doc_id").isNotNull()
    changed = seen & known & (F.col("content_hash") != F.col("_new_content_hash"))
    return both.select(
        *key,
        F.coalesce("doc_id", "_new_doc_id").alias("doc_id"),
        F.coalesce("_new_content_hash", "content_hash").alias("content_hash"),
        F.coalesce("first_seen", now).alias("first_seen"),
        F.when(seen, now).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(seen, 0).otherwise(F.col("miss_streak")).alias("miss_streak"),
        F.when(~seen, F.col("gone_at")).alias("gone_at"),
        F.when(~known | changed, "pending").otherwise(F.col("judgment_status")).alias("judgment_status"),
        F.when(known & ~changed, F.col("judge_score")).alias("judge_score"),
        F.when(~known, "new").when(changed, "changed").when(seen, "same").otherwise("unseen").alias("outcome"),
    )


def sweep_gone(stored: DataFrame, seen: DataFrame, now: Column, gone_after: int = 3) -> DataFrame:
    """Rows of the sources in `seen` that weren't seen miss once more and are gone from the gone_after-th time."""
    sources = seen.select("source").distinct().withColumn("_polled", F.lit(True))
    marks = seen.select("source", "source_id").distinct().withColumn("_seen", F.lit(True))
    rows = stored.join(marks, ["source", "source_id"], "left").join(sources, "source", "left")
    missed = F.col("_polled").isNotNull() & F.col("_seen").isNull() & F.col("gone_at").isNull()
    streak = F.coalesce("miss_streak", F.lit(0)) + 1
    return (
        rows.withColumn("newly_gone", missed & (streak >= gone_after))
        .withColumn("gone_at", F.when(F.col("newly_gone"), now).otherwise(F.col("gone_at")))
        .withColumn("miss_streak", F.when(missed, streak).otherwise(F.col("miss_streak")))
        .drop("_seen", "_polled")
    )


def stratified_split(rows: DataFrame, strata: list[str], key: str, fraction: float, seed: int = 0) -> DataFrame:
    """rows with split `val` or `train`: of each stratum the fraction, to even, that is first in hash order. Nothing is lost.

    Places are counted within ranges of the hash and added up, so that no task holds a stratum.
    """
    from tunemill.operators import ordered as O

    hashed = rows.withColumn("_tm_h", F.xxhash64(F.lit(seed), F.col(key)))
    placed = O.running_total(hashed, strata, ["_tm_h", key], F.shiftright("_tm_h", 52), F.lit(1), "_tm_place")
    sizes = rows.groupBy(*[F.col(c).alias(f"_tm_s{i}") for i, c in enumerate(strata)]).agg(F.count("*").alias("_tm_n"))
    same = F.lit(True)
    for i, c in enumerate(strata):
        same = same & F.col(c).eqNullSafe(F.col(f"_tm_s{i}"))
    out = placed.join(sizes, same).withColumn("split", F.when(F.col("_tm_place") <= F.bround(F.col("_tm_n") * fraction), "val").otherwise("train"))
    return out.drop("_tm_h", "_tm_place", "_tm_n", *[f"_tm_s{i}" for i in range(len(strata))])


def labelled(stored: DataFrame, incoming: DataFrame, order: list[Column]) -> DataFrame:
    """Labels after incoming ones: one of each (doc_id, label_set, rater), the incoming one if there is any."""
    both = stored.withColumn("_tm_in", F.lit(0)).unionByName(incoming.withColumn("_tm_in", F.lit(1)))
    return latest(both, ["doc_id", "label_set", "rater"], [F.desc("_tm_in"), *order]).drop("_tm_in")


def labels_of(labels: DataFrame, label_set: str, rater: str | None = None) -> DataFrame:
    """The labels of a set, of one rater if named, by document."""
    own = labels.where(F.col("label_set") == label_set)
    return (own if rater is None else own.where(F.col("rater") == rater)).orderBy("doc_id", "rater")


def sampled(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n different rows drawn by hash order under a seed, sorted by key: the same rows however the table is split."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n).orderBy(key)
