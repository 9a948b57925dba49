"""Queries over documents, judgments and poll runs: ingest, gates, joins, reports, state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tunemill.functions import text as T
from tunemill.operators import corpus as C
from tunemill.operators import definitions as D
from tunemill.plans.registry import Registry
from tunemill.session import scratch, source_name, table
from tunemill.sources import sinks

query = Registry()
SRC = "lower(regexp_replace(source, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'))"
_STRIP = "regexp_replace(coalesce(text, ''), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')"
_EDGE = "[^\\p{L}\\p{N}_]"
_TERMS = f"(?i)(^|{_EDGE})({'|'.join(T.TUNING_TERMS)})($|{_EDGE})"
_GATED = f"""gated as (select *, case when length({_STRIP}) < 40 then 'rejected:too_short' when not regexp_matches(coalesce(text, ''), '[A-Za-z]') then 'rejected:no_alpha' else 'kept' end as gate,
  list_filter([case when regexp_matches(coalesce(text, ''), '[0-9]') then 'has_numbers' end,
    case when contains(coalesce(text, ''), chr(9)) or regexp_matches(coalesce(text, ''), '\\|[^\\n]*\\|') or coalesce(kind in ('ecu_definition', 'logger_param', 'datalog'), false) then 'has_table' end,
    case when regexp_matches(coalesce(text, ''), '{_TERMS}') or regexp_matches(coalesce(title, ''), '{_TERMS}') then 'tuning_signal' end,
    case when domain = 'subaru' then 'subaru' end], lambda x: x is not null) as flags from documents)"""


@query(f"with {_GATED} select {SRC} as source, gate, count(*) as docs, sum(greatest(1, length(coalesce(text, '')) // 4))::bigint as token_est from gated group by 1, 2")
def gate_counts(spark: SparkSession, d: str) -> DataFrame:
    """FLT-01, SCL-18, AGG-10: documents and estimated tokens by source and gate outcome."""
    docs = C.gate(table(spark, d, "documents"))
    return docs.groupBy(source_name("source").alias("source"), F.col("gate_status").alias("gate")).agg(F.count("*").alias("docs"), F.sum(T.token_estimate(F.col("text"))).alias("token_est"))


@query(f"with {_GATED} select doc_id, gate as gate_status, case when gate = 'kept' then array_to_string(flags, ',') else '' end as flags from gated")
def flt01_gate_flags(spark, d):
    return C.gate(table(spark, d, "documents")).select("doc_id", "gate_status", F.array_join("gate_flags", ",").alias("flags"))


@query("select doc_id, sha1(concat(coalesce(source, ''), chr(0), coalesce(source_id, ''), chr(0), coalesce(text, ''))) as content_sha1 from documents")
def set02_content_hash(spark, d):
    return C.content_hash(table(spark, d, "documents")).select("doc_id", "content_sha1")


@query("select doc_id, source from documents where gate_status = 'kept' and judgment_status = 'pending' order by doc_id limit 25")
def flt06_judge_queue(spark, d):
    return C.judge_queue(table(spark, d, "documents"), 25).select("doc_id", "source")


@query("select (tier = 'reference') as is_reference, count(*) as docs from documents where (tier = 'reference' and gate_status = 'kept' and gone_at is null) or (tier = 'community' and gate_status = 'kept' and judge_score >= 4) group by 1")
def flt07_08_populations(spark, d):
    docs = table(spark, d, "documents")
    both = C.reference_kept(docs).select(F.lit(True).alias("is_reference")).unionByName(C.community_kept(docs).select(F.lit(False).alias("is_reference")))
    return both.groupBy("is_reference").agg(F.count("*").alias("docs"))


@query("select doc_id from documents where tier = 'reference' and gate_status = 'kept' and gone_at is null and regexp_matches(text, '[0-9]') and length(text) >= 800 and (text ilike '%knock%' or text ilike '%fuel%')")
def flt09_digit_topic(spark, d):
    docs = C.reference_kept(table(spark, d, "documents"))
    topic = F.lower("text").like("%knock%") | F.lower("text").like("%fuel%")
    return docs.where(F.col("text").rlike("[0-9]") & (F.length("text") >= 800) & topic).select("doc_id")


@query("select doc_id, not (contains(lower(coalesce(title, '')), 'partial')) and (contains(lower(coalesce(title, '')), 'pump') or contains(lower(coalesce(title, '')), 'sensor') or contains(lower(coalesce(title, '')), 'valve')) as ok from documents")
def flt05_titles(spark, d):
    return table(spark, d, "documents").select("doc_id", C.title_ok(F.col("title"), ["pump", "sensor", "valve"], ["partial"]).alias("ok"))


@query(f"select doc_id, case when tier = 'community' then 'full' when {SRC} = 'rom_defs' then 'auto_pass' when {SRC} = 'local_pdf' then 'light_judge' else 'sampled' end as policy from documents")
def flt15_policy(spark, d):
    rule = C.policy(source_name("source"), F.col("tier"), {"rom_defs": "auto_pass", "local_pdf": "light_judge", "default": "sampled"})
    return table(spark, d, "documents").select("doc_id", rule.alias("policy"))


@query("select distinct model as tag, model like 'q%' and not contains(model, 'mini') as excluded from e5_real_logs where model is not null")
def flt16_excluded_tags(spark, d):
    tag = F.col("tag")
    return table(spark, d, "e5_real_logs").select(F.col("model").alias("tag")).where(tag.isNotNull()).distinct().withColumn("excluded", F.startswith(tag, F.lit("q")) & ~F.contains(tag, F.lit("mini")))


_LATEST = """latest as (select * from (select *, row_number() over (partition by doc_id, chunk_index, rubric_version order by stored_at desc nulls last, created_at desc nulls last, score desc nulls last, judge_model desc nulls last) as n
  from judgment where doc_id is not null) where n = 1)"""


@query(f"with {_LATEST} select doc_id, chunk_index, rubric_version, score from latest")
def dml03_latest_judgments(spark, d):
    return C.judged_chunks(table(spark, d, "judgment")).select("doc_id", "chunk_index", "rubric_version", "score")


@query(f"with {_LATEST} select l.doc_id, chunk_index, l.rubric_version, score, {SRC.replace('source', 'd.source', 1)} as source, tier from latest l join documents d using (doc_id) where score >= 4 and length(pairs_json) > 2")
def join01_judged_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", source_name("source").alias("source"), "tier")
    rows = C.judged_chunks(table(spark, d, "judgment")).where((F.col("score") >= C.KEEP_SCORE) & (F.length("pairs_json") > 2))
    return rows.join(docs, "doc_id").select("doc_id", "chunk_index", "rubric_version", "score", "source", "tier")


@query(f"with {_LATEST} select distinct doc_id, (doc_id * 2654435761) % 4294967296 as scatter from latest l join documents d using (doc_id) where tier = 'reference' and score >= 4 and n_chunks = 1 and regexp_matches(text, '[0-9]') order by scatter, doc_id limit 40")
def join02_probe_candidates(spark, d):
    docs = table(spark, d, "documents").where((F.col("tier") == "reference") & F.col("text").rlike("[0-9]")).select("doc_id")
    rows = C.judged_chunks(table(spark, d, "judgment")).where((F.col("score") >= C.KEEP_SCORE) & (F.col("n_chunks") == 1))
    return C.scattered(rows.select("doc_id").join(docs, "doc_id").distinct(), 40)


@query(f"with {_LATEST} select doc_id, max(score) as best from latest join documents using (doc_id) where tier = 'community' group by doc_id")
def join03_best_score(spark, d):
    docs = table(spark, d, "documents").where(F.col("tier") == "community").select("doc_id")
    return C.judged_chunks(table(spark, d, "judgment")).join(docs, "doc_id").groupBy("doc_id").agg(F.max("score").alias("best"))


@query("select doc_id from documents where gate_status = 'kept' and doc_id not in (select doc_id from judgment where doc_id is not null)")
def join14_unjudged(spark, d):
    known = table(spark, d, "judgment").select("doc_id").distinct()
    return table(spark, d, "documents").where(F.col("gate_status") == "kept").join(known, "doc_id", "left_anti").select("doc_id")


@query("select row_id, id as doc_id, coalesce(tier, 'reference') as tier, split_part(source_id, '#', 1) as parent, (d.doc_id is null) as missing from (select row_id, unnest(retrieved_doc_ids) as id from e2_answers) a left join documents d on d.doc_id = a.id")
def join12_13_provenance(spark, d):
    asked = table(spark, d, "e2_answers").select("row_id", F.explode("retrieved_doc_ids").alias("doc_id"))
    docs = table(spark, d, "documents").select("doc_id", "tier", T.parent_key(F.col("source_id")).alias("parent"), F.lit(False).alias("missing"))
    return asked.join(docs, "doc_id", "left").select("row_id", "doc_id", F.coalesce("tier", F.lit("reference")).alias("tier"), "parent", F.coalesce("missing", F.lit(True)).alias("missing"))


@query(f"select {SRC} as source, tier, kind, count(*) as docs, count_if(gate_status = 'kept') as kept, count_if(judgment_status = 'pending') as pending from documents where gone_at is null group by 1, 2, 3")
def agg10_counts(spark, d):
    docs = table(spark, d, "documents").where(F.col("gone_at").isNull())
    return docs.groupBy(source_name("source").alias("source"), "tier", "kind").agg(F.count("*").alias("docs"), F.count_if(F.col("gate_status") == "kept").alias("kept"), F.count_if(F.col("judgment_status") == "pending").alias("pending"))


@query("select tier, judgment_status, judge_score, count(*) as docs, (grouping(tier) * 4 + grouping(judgment_status) * 2 + grouping(judge_score))::int as level from documents group by grouping sets ((judgment_status), (tier, judgment_status), (judge_score))")
def agg11_status(spark, d):
    table(spark, d, "documents").createOrReplaceTempView("_tm_documents")
    return spark.sql("select tier, judgment_status, judge_score, count(*) as docs, cast(grouping(tier) * 4 + grouping(judgment_status) * 2 + grouping(judge_score) as int) as level from _tm_documents group by grouping sets ((judgment_status), (tier, judgment_status), (judge_score))")


@query(f"select {SRC} as source, judged_at >= timestamp '2025-06-01' as fresh, count_if(judge_score = 1) as s1, count_if(judge_score = 2) as s2, count_if(judge_score = 3) as s3, count_if(judge_score = 4) as s4, count_if(judge_score = 5) as s5, round(100.0 * count_if(judge_score >= 4) / count(*), 4) as pct_kept from documents where judge_score between 1 and 5 and judged_at is not null group by 1, 2")
def agg12_yield(spark, d):
    rows = table(spark, d, "documents").where(F.col("judge_score").between(1, 5) & F.col("judged_at").isNotNull())
    scores = [F.count_if(F.col("judge_score") == s).alias(f"s{s}") for s in range(1, 6)]
    fresh = (F.col("judged_at").cast("timestamp_ntz") >= F.lit("2025-06-01").cast("timestamp_ntz")).alias("fresh")
    return rows.groupBy(source_name("source").alias("source"), fresh).agg(*scores, F.round(100.0 * F.count_if(F.col("judge_score") >= C.KEEP_SCORE) / F.count("*"), 4).alias("pct_kept"))


_RUNS = "runs as (select distinct * from poll_run)"


@query(f"with {_RUNS} select {SRC} as source, count(*) as runs, count_if(ok = 1) as good, sum(fetched)::bigint as fetched, sum(kept)::bigint as kept, sum(new_count)::bigint as new_docs, count_if(finished_at is null) as unfinished from runs group by 1")
def agg31_poll_totals(spark, d):
    runs = table(spark, d, "poll_run").distinct()
    return runs.groupBy(source_name("source").alias("source")).agg(F.count("*").alias("runs"), F.count_if(F.col("ok") == 1).alias("good"), F.sum("fetched").alias("fetched"), F.sum("kept").alias("kept"), F.sum("new_count").alias("new_docs"), F.count_if(F.col("finished_at").isNull()).alias("unfinished"))


@query(f"with {_RUNS} select {SRC} as source, id, ok, error from (select *, row_number() over (partition by {SRC} order by started_at desc nulls last, id desc) as n from runs) where n = 1")
def dml07_last_run(spark, d):
    runs = table(spark, d, "poll_run").distinct().withColumn("source", source_name("source"))
    return C.latest(runs, ["source"], [F.desc_nulls_last("started_at"), F.desc("id")]).select("source", "id", "ok", "error")


@query("select count(*) as docs from documents where gone_at is null")
def agg32_total(spark, d):
    return table(spark, d, "documents").where(F.col("gone_at").isNull()).agg(F.count("*").alias("docs"))


@query("select doc_id, title from documents order by doc_id desc limit 10")
def win12_recent_titles(spark, d):
    return table(spark, d, "documents").orderBy(F.desc("doc_id")).limit(10).select("doc_id", "title")


@query("select doc_id, (doc_id * 2654435761) % 4294967296 as scatter from documents order by scatter, doc_id limit 50")
def top04_scatter_sample(spark, d):
    return C.scattered(table(spark, d, "documents").select("doc_id"), 50)


@query(f"""with {_LATEST}, weighed as (select l.doc_id, l.score, greatest(1, coalesce(d.n_chars, 0)) as w from latest l join documents d using (doc_id) where l.score between 1 and 5)
select doc_id, min(score) as min_score, round_even(avg(score), 0)::int as mean_score, round_even(sum(score * w) / sum(w), 0)::int as weighted_score, count(*) as chunks from weighed group by doc_id""")
def agg14_doc_scores(spark, d):
    return C.doc_scores(C.judged_chunks(table(spark, d, "judgment")), table(spark, d, "documents"))


_STORED = f"""stored as (select {SRC} as source, source_id, min(doc_id) as doc_id, min(content_hash) as content_hash from documents where source is not null and source_id is not null and doc_id % 3 <> 0 group by 1, 2),
incoming as (select {SRC} as source, source_id, min(case when doc_id % 5 = 0 then reverse(content_hash) else content_hash end) as new_hash from documents where source is not null and source_id is not null and content_hash is not null and doc_id % 4 <> 0 group by 1, 2)"""


@query(f"with {_STORED} select coalesce(s.source, i.source) as source, case when s.doc_id is null then 'new' when new_hash is not null and content_hash <> new_hash then 'changed' when new_hash is not null then 'same' else 'unseen' end as outcome, count(*) as docs from stored s full join incoming i on s.source = i.source and s.source_id = i.source_id group by 1, 2")
def dml01_upsert(spark, d):
    """Two thirds of the documents are stored; three quarters come by again, a fifth of them changed."""
    docs = table(spark, d, "documents").withColumn("source", source_name("source")).where(F.col("source").isNotNull() & F.col("source_id").isNotNull())
    keep = ["source", "source_id", "doc_id", "content_hash", "first_seen", "last_seen", "miss_streak", "gone_at", "judgment_status", "judge_score"]
    stored = docs.where("doc_id % 3 <> 0").groupBy("source", "source_id").agg(*(F.min(c).alias(c) for c in keep[2:]))
    coming = docs.where("doc_id % 4 <> 0 and content_hash is not null").withColumn("content_hash", F.when(F.col("doc_id") % 5 == 0, F.reverse("content_hash")).otherwise(F.col("content_hash")))
    return C.upsert(stored, coming.select(*keep[:4]), F.lit("2026-01-01").cast("timestamp")).groupBy("source", "outcome").agg(F.count("*").alias("docs"))


@query(f"""with seen as (select distinct {SRC} as source, source_id from documents where doc_id % 2 = 0 and source is not null and source_id is not null),
swept as (select doc_id, {SRC} as s, source_id, gone_at, coalesce(miss_streak, 0) + 1 as streak, miss_streak from documents where source is not null and source_id is not null),
marked as (select w.*, gone_at is null and (s, source_id) not in (select (source, source_id) from seen) and s in (select source from seen) as missed from swept w)
select s as source, count_if(missed and streak >= 3) as newly_gone, sum(case when missed then streak else coalesce(miss_streak, 0) end)::bigint as streaks from marked group by 1""")
def dml02_sweep(spark, d):
    docs = table(spark, d, "documents").withColumn("source", source_name("source")).where(F.col("source").isNotNull() & F.col("source_id").isNotNull())
    swept = C.sweep_gone(docs, docs.where("doc_id % 2 = 0").select("source", "source_id"), F.lit("2026-01-01").cast("timestamp"))
    return swept.groupBy("source").agg(F.count_if("newly_gone").alias("newly_gone"), F.sum(F.coalesce("miss_streak", F.lit(0))).alias("streaks"))


@query("select doc_id, case when judgment_status = 'failed' then 'pending' else judgment_status end as judgment_status, case when judgment_status = 'failed' then null else judge_score end as judge_score from documents")
def dml04_reset_failed(spark, d):
    failed = F.coalesce(F.col("judgment_status") == "failed", F.lit(False))
    return table(spark, d, "documents").select("doc_id", F.when(failed, "pending").otherwise(F.col("judgment_status")).alias("judgment_status"), F.when(~failed, F.col("judge_score")).alias("judge_score"))


@query("select judge_model as key, max(rubric_version) as value from judgment where judge_model is not null and stored_at = (select max(stored_at) from judgment j where j.judge_model = judgment.judge_model) group by judge_model")
def dml06_latest_value(spark, d):
    """The last value written under each key."""
    rows = table(spark, d, "judgment").where(F.col("judge_model").isNotNull() & F.col("stored_at").isNotNull())
    best = rows.groupBy("judge_model").agg(F.max(F.struct("stored_at", "rubric_version")).alias("x"))
    return best.select(F.col("judge_model").alias("key"), F.col("x.rubric_version").alias("value"))


@query("with s as (select count(*) as n from embeddings where vec_id is not null) select 'same' as against, n as stamped, true as fresh from s union all select 'fewer', n, n = (select count(*) from embeddings where vec_id % 2 = 0) from s")
def dml12_freshness(spark, d):
    """DML-12: an index written with its stamp, against the table it was made from and against one that has lost rows."""
    path, rows = scratch(spark, "index"), table(spark, d, "embeddings")
    sinks.vector_index(rows, "vec_id", "embedding", path)
    parts = []
    for name, now in (("same", rows), ("fewer", rows.where("vec_id % 2 = 0"))):
        index, fresh = sinks.load_index(spark, path, now)
        parts.append(index.agg(F.count("*").alias("stamped")).select(F.lit(name).alias("against"), "stamped", F.lit(fresh).alias("fresh")))
    return parts[0].unionByName(parts[1])


_LABELS = "labels as (select distinct doc_id, rubric_version as label_set, judge_model as rater, score, created_at, stored_at from judgment where doc_id is not null)"


@query(f"with {_LABELS}, marked as (select *, (stored_at >= timestamp '2025-06-01')::int as late from labels), r as (select *, row_number() over (partition by doc_id, label_set, rater order by late desc, stored_at desc nulls last, created_at desc nulls last, score desc nulls last) as k from (select doc_id, label_set, rater, score, created_at, stored_at, coalesce(late, 0) as late from marked)) select doc_id, label_set, rater, score from r where k = 1")
def dml05_labels(spark, d):
    """DML-05: labels that came later replace those of the same document, set and rater."""
    rows = table(spark, d, "judgment").where("doc_id is not null").select("doc_id", F.col("rubric_version").alias("label_set"), F.col("judge_model").alias("rater"), "score", "created_at", "stored_at").distinct()
    late = F.coalesce(F.col("stored_at") >= F.lit("2025-06-01").cast("timestamp_ntz"), F.lit(False))
    out = C.labelled(rows.where(~late), rows.where(late), [F.desc_nulls_last("stored_at"), F.desc_nulls_last("created_at"), F.desc_nulls_last("score")])
    return out.select("doc_id", "label_set", "rater", "score")


@query()
def top08_sample(spark, d):
    """TOP-08: fifty steady readings drawn by hash, in the order of their ids."""
    return C.sampled(table(spark, d, "memtest_soak").where("util_pct >= 90").select("sample_id", "junction_c").distinct(), "sample_id", 50)


_PLATFORM = {"theory": "Theory", "forum_thread": "Forum Thread", "ecu_definition": "Definition"}


@query("select doc_id, case kind when 'theory' then 'Theory' when 'forum_thread' then 'Forum Thread' when 'ecu_definition' then 'Definition' end as named, case when kind in ('theory', 'ecu_definition', 'forum_thread') then kind end as meaning from documents")
def scl45_names(spark, d):
    """SCL-45: a platform's names and back, with a variant."""
    named = D.platform_name(F.col("kind"), _PLATFORM)
    return table(spark, d, "documents").select("doc_id", named.alias("named"), D.semantic_id(F.when(F.col("kind") == "theory", "THEORY").otherwise(named), _PLATFORM, {"theory": ["THEORY"]}).alias("meaning"))


@query("select tier, kind, count(*) as docs, round_even(count(*) * 0.1, 0)::bigint as val from documents group by 1, 2")
def top07_split_sizes(spark, d):
    rows = C.stratified_split(table(spark, d, "documents"), ["tier", "kind"], "doc_id", 0.1)
    return rows.groupBy("tier", "kind").agg(F.count("*").alias("docs"), F.count_if(F.col("split") == "val").alias("val"))


@query()
def top05_06_frozen_sample(spark, d):
    """All community documents with a high score and eight reference anchors by hash; the blind half by another hash."""
    docs = table(spark, d, "documents")
    anchors = C.reference_kept(docs).orderBy(F.xxhash64(F.lit(0), "doc_id"), "doc_id").limit(8)
    frozen = C.community_kept(docs).select("doc_id", "tier").unionByName(anchors.select("doc_id", "tier"))

    ranked = frozen.withColumn("bucket", F.pmod(F.xxhash64(F.lit(42), "doc_id"), F.lit(2)))

    return ranked.select("doc_id", "tier", (F.col("bucket") == 0).alias("blind"))


@query("select doc_id, split_part(source_id, '#', 1) as parent, regexp_replace(coalesce(title, ''), '[^A-Za-z0-9._-]+', '_', 'g') as file_name, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1)) as host from documents")
def scl_names(spark, d):
    """SCL-15, SCL-17, SCL-22: parent key, file name and host."""
    return table(spark, d, "documents").select("doc_id", T.parent_key(F.col("source_id")).alias("parent"), T.file_name(F.coalesce("title", F.lit(""))).alias("file_name"), T.url_host(F.col("url")).alias("host"))


@query("select doc_id, json_valid(meta_json) and meta_json is not null as good from documents where meta_json is not null")
def scl36_tolerant_json(spark, d):
    rows = table(spark, d, "documents").where(F.col("meta_json").isNotNull())
    return rows.select("doc_id", F.try_parse_json("meta_json").isNotNull().alias("good"))


@query("select substring(content_hash, 1, 5) as family, count(*) as docs from documents group by 1")
def set06_families(spark, d):
    """Hash prefixes by family: SET-06 grouping on the first five characters."""
    return table(spark, d, "documents").groupBy(F.substring("content_hash", 1, 5).alias("family")).agg(F.count("*").alias("docs"))
