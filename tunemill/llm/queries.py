"""Queries of the operators for training data, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunemill.llm import budget, chunking, cutoff, encode, lines, mix, pairs, spam
from tunemill.session import small, source_name, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    return lines.repeated_positions(docs, lines.repeated_lines(docs))


def p1_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.repeated_lines(table(spark, d, "documents").select("text", "source"))


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    return lines.without_repeated(docs, lines.repeated_lines(docs)).select("doc_id", source_name("source").alias("source"), "n_removed", "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    cut = chunking.pieces(table(spark, d, "documents"), table(spark, d, "chunking_cfg"), with_text=False)
    return cut.where(F.col("piece_no") == 1).select("doc_id", "cut")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.pieces(table(spark, d, "documents"), table(spark, d, "chunking_cfg"))


def p2_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of each document that is cut: are all pieces within the limit, does each repeat just the overlap, is the text covered?"""
    docs, cfg = table(spark, d, "documents"), table(spark, d, "chunking_cfg")
    limits = cfg.where("max_chars > 0").groupBy("kind").agg(F.min("max_chars").alias("most"), F.min("overlap_chars").alias("overlap"))
    each = chunking.pieces(docs, cfg).join(docs.join(small(limits), "kind").select("doc_id", "most", "overlap", F.col("text").alias("whole")), "doc_id")
    fresh = F.when(F.col("piece_no") == 1, F.col("text")).otherwise(F.expr("substring(text, overlap + 1)"))
    again = (F.col("piece_no") == 1) | (F.expr("substring(whole, start + 1, overlap)") == F.expr("left(text, overlap)"))
    parts = each.select("doc_id", "piece_no", "whole", fresh.alias("fresh"), (F.length("text") <= F.col("most")).alias("fits"), again.alias("again"))
    joined = parts.groupBy("doc_id", "whole").agg(F.bool_and("fits").alias("within_limit"), F.bool_and("again").alias("overlaps"), F.array_sort(F.collect_list(F.struct("piece_no", "fresh"))).alias("p"))
    return joined.select("doc_id", "within_limit", "overlaps", (F.array_join(F.transform("p", lambda x: x["fresh"]), "") == F.col("whole")).alias("covers"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.document_cutoffs(table(spark, d, "documents"), table(spark, d, "keep_target"))


def p3_rows(spark: SparkSession, d: str) -> DataFrame:
    """The documents that the cutoffs keep."""
    docs = table(spark, d, "documents").select("doc_id", source_name("source").alias("source"), "tier", "judge_score")
    return docs.join(p3_found(spark, d), ["source", "tier"]).where(F.col("judge_score").between(F.col("cutoff"), 5)).select("doc_id", "source", "tier", "judge_score", "cutoff")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return budget.document_tokens(table(spark, d, "documents")).where("unreliable").select("doc_id")


def p4_budget(spark: SparkSession, d: str) -> DataFrame:
    return budget.budget(budget.document_tokens(table(spark, d, "documents")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(table(spark, d, "e5_real_logs"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"))


def p8_text(spark: SparkSession, d: str) -> DataFrame:
    """The round trip: every text from its ids."""
    return encode.decode(encode.encode(table(spark, d, "documents")))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, d, "mix_target")
    tokens = mix.mixed_tokens(table(spark, d, "documents"), targets)
    return tokens, mix.plan(tokens, targets)


def _ramps(planned: DataFrame) -> dict[str, float]:
    """Schedules for the curriculum: of the sources in the order of their names, every other one fades in, the rest fade out."""
    named = [r.source for r in planned.select("source").distinct().orderBy("source").limit(mix.MOST_SCHEDULES).collect()]
    return {s: 0.5 if i % 2 else 1.5 for i, s in enumerate(named)}


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose copies, seated along a schedule that changes, end before what is due does."""
    tokens, planned = _mix(spark, d)
    start = _ramps(planned)
    return mix.shortfall(mix.seats(tokens, planned, start), planned, start).select("mix_id", "source")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    tokens, planned = _mix(spark, d)
    return mix.shares(mix.seats(tokens, planned), planned)


def p9_order(spark: SparkSession, d: str) -> DataFrame:
    """The training order of a curriculum whose sources fade in or out."""
    tokens, planned = _mix(spark, d)
    return mix.positions(tokens, planned, _ramps(planned))


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of each source of a mix: are the repeats within their cap, what is drawn at least what is due or all there is, and less
    than a document over it, and is every position between 0 and 1?"""
    tokens, planned = _mix(spark, d)
    drawn = mix.seats(tokens, planned, _ramps(planned))
    got = drawn.groupBy("mix_id", "source").agg(F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("largest"), F.max("repeat_no").alias("repeats"), F.bool_and(F.col("position").between(0, 1)).alias("placed"))
    rows = planned.join(got, ["mix_id", "source"], "left").na.fill(0, ["tokens", "largest", "repeats"])
    enough = F.when(F.col("most") < F.col("due"), F.col("tokens") == F.col("most")).otherwise((F.col("tokens") >= F.col("due")) & (F.col("tokens") < F.col("due") + F.greatest(F.col("largest"), F.lit(1))))
    return rows.select("mix_id", "source", (F.col("repeats") <= F.col("max_repeats")).alias("capped"), enough.alias("enough"), F.coalesce("placed", F.lit(True)).alias("placed"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.stuffed(table(spark, d, "documents")).select("doc_id")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return spam.stuffed(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_lines, p1_clean, p2_found, p2_pieces, p2_checks, p3_found, p3_rows, p4_found, p4_budget, p6_found, p8_ids, p8_text, p9_found, p9_shares, p9_order, p9_checks, p10_found, p10_shares)}

_KEYED = """
keyed as (select doc_id, lower(trim(source)) as source, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no,
    unnest(string_split(text, chr(10))) as line from documents where source is not null and text is not null),
letters as (select doc_id, source, line_no, lower(regexp_replace(line, '[^\\p{L}]+', '', 'g')) as key from keyed
    where length(regexp_replace(line, '[^\\p{L}]+', '', 'g')) >= 24),
sized as (select lower(trim(source)) as source, count(*) as of_docs from documents where source is not null group by 1),
sure as (select l.source, key, count(distinct doc_id) as n_docs, of_docs from letters l join sized using (source)
    group by l.source, key, of_docs having count(distinct doc_id) >= 5 and count(distinct doc_id) * 20 >= of_docs)
"""

_CUT = """
with scored as (select lower(trim(source)) as source, tier, judge_score as s from documents where judge_score between 1 and 5),
sized as (select source, tier, count(*) as n from scored group by all),
marks as (select z.source, z.tier, c, n, count_if(s >= c) as kept from sized z join scored d on d.source = z.source and d.tier = z.tier, (select unnest([1, 2, 3, 4, 5]) as c) group by all),
cut as (select m.source, m.tier, max(c) as cutoff, min(kept) as kept from marks m join keep_target k on k.source = m.source and k.tier = m.tier
    where kept / n >= target_frac group by all)
"""

_STRETCH = """
with limits as (select kind, min(max_chars) as most from chunking_cfg where max_chars > 0 group by kind),
long as (select doc_id, text, most from documents join limits using (kind) where length(text) > most),
rows as (select doc_id, most, unnest(range(1, len(string_split(text, chr(10))) + 1)) as no, unnest(string_split(text, chr(10))) as line from long),
marked as (select *, trim(line, e' \\t\\r') = '' or regexp_full_match(line, '[ \\t\\r]*-{3}(-*|.*-{3})[ \\t\\r]*') as sep,
    regexp_matches(line, '^#{1,4}[ \\t]') as head from rows),
grouped as (select *, sum((sep or head)::int) over (partition by doc_id order by no) as stretch from marked),
sized as (select doc_id, most, stretch, sum(length(line) + 1) - 1 as size from grouped where not sep group by all)
select doc_id, case when coalesce(max(size), 0) > most then 'forced' else 'natural' end as cut from sized group by doc_id, most
"""

SQL: dict[str, str] = {
    "p2_found": _STRETCH,
    "p1_found": f"with {_KEYED} select doc_id, line_no::int as line_no from letters join sure using (source, key)",
    "p1_clean": f"""with {_KEYED}, gone as (select doc_id, line_no from letters join sure using (source, key)), n as (select doc_id, count(*) as n_removed from gone group by 1),
left_over as (select k.doc_id, string_agg(k.line, chr(10) order by k.line_no) as text from keyed k join n using (doc_id) left join gone g on g.doc_id = k.doc_id and g.line_no = k.line_no where g.line_no is null group by 1)
select d.doc_id, lower(trim(d.source)) as source, coalesce(n.n_removed, 0)::int as n_removed, case when n.n_removed is null then d.text else coalesce(l.text, '') end as text from documents d left join n using (doc_id) left join left_over l using (doc_id)""",
    "p2_checks": "with limits as (select kind, min(max_chars) as most from chunking_cfg where max_chars > 0 group by kind) select doc_id, true as within_limit, true as overlaps, true as covers from documents join limits using (kind) where length(text) > most",
    "p8_text": "select doc_id, coalesce(text, '') as text from documents",
    "p9_checks": "select distinct mix_id, lower(trim(source)) as source, true as capped, true as enough, true as placed from mix_target where mix_id is not null and source is not null",
    "p1_lines": f"with {_KEYED} select source, key, n_docs, of_docs from sure",
    "p3_found": _CUT + "select source, tier, cutoff::int as cutoff, kept from cut",
    "p3_rows": _CUT + "select doc_id, c.source, c.tier, judge_score, cutoff::int as cutoff from documents d join cut c on lower(trim(d.source)) = c.source and d.tier = c.tier where judge_score between cutoff and 5",
}
