"""Queries that compare raters and runs and grade answers (e2_answers, e5_real_logs, judgment, documents)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunemill.functions import text as T
from tunemill.functions.text import healed, numbers
from tunemill.operators import corpus as C
from tunemill.operators import evaluation as E
from tunemill.plans.corpus import _LATEST
from tunemill.plans.registry import Registry
from tunemill.session import scratch, table
from tunemill.sources import files

query = Registry()

_RATED = f"{_LATEST}, rated as (select d.doc_id, d.judge_score as truth, max(l.score) as judged from documents d join latest l on l.doc_id = d.doc_id where d.judge_score between 1 and 5 and l.score between 1 and 5 group by 1, 2)"


def rated(spark: SparkSession, d: str) -> DataFrame:
    """Documents scored by both: the stored score as truth, the best of their latest judgments as judged."""
    docs = table(spark, d, "documents").where(F.col("judge_score").between(1, 5)).select("doc_id", F.col("judge_score").alias("truth"))
    judged = C.judged_chunks(table(spark, d, "judgment")).where(F.col("score").between(1, 5))
    return docs.join(judged, "doc_id").groupBy("doc_id", "truth").agg(F.max("score").alias("judged"))


@query(f"with {_RATED} select count(*) as n, round(100.0 * count_if(truth = judged) / count(*), 6) as exact_pct, round(100.0 * count_if(abs(truth - judged) <= 1) / count(*), 6) as within1_pct, round(100.0 * count_if((truth >= 4) = (judged >= 4)) / count(*), 6) as keep_agree_pct, count_if(truth <= 2 and judged >= 4) as dangerous from rated")
def agg15_join04_agreement(spark, d):
    return E.agreement(rated(spark, d), "truth", "judged").withColumns({c: F.round(c, 6) for c in ("exact_pct", "within1_pct", "keep_agree_pct")})


@query(f"with {_RATED} select t.truth::int as truth, count_if(judged = 1) as j1, count_if(judged = 2) as j2, count_if(judged = 3) as j3, count_if(judged = 4) as j4, count_if(judged = 5) as j5 from (select unnest(range(1, 6)) as truth) t left join rated r on r.truth = t.truth group by 1")
def agg15_confusion(spark, d):
    return E.confusion(rated(spark, d), "truth", "judged")


@query(f"with {_RATED}, ranks as (select rank() over (order by truth) + (count(*) over (partition by truth) - 1) / 2.0 as a, rank() over (order by judged) + (count(*) over (partition by judged) - 1) / 2.0 as b from rated) select round(coalesce(corr(a, b), 0), 6) as spearman from ranks")
def agg16_win05_spearman(spark, d):
    return E.spearman(rated(spark, d), "truth", "judged").withColumn("spearman", F.round("spearman", 6))


@query(f"with {_RATED}, m as (select 100.0 * count_if((truth >= 4) = (judged >= 4)) / count(*) as keep, 100.0 * count_if(abs(truth - judged) <= 1) / count(*) as w1, count_if(truth <= 2 and judged >= 4) as dangerous from rated) select 'keep_agree' as bar, keep >= 90 as ok from m union all select 'within1', w1 >= 95 from m union all select 'dangerous', dangerous = 0 from m")
def agg27_bars(spark, d):
    a = E.agreement(rated(spark, d), "truth", "judged")
    bars = F.array(F.struct(F.lit("keep_agree").alias("bar"), (F.col("keep_agree_pct") >= 90).alias("ok")), F.struct(F.lit("within1").alias("bar"), (F.col("within1_pct") >= 95).alias("ok")), F.struct(F.lit("dangerous").alias("bar"), (F.col("dangerous") == 0).alias("ok")))
    return a.select(F.explode(bars).alias("b")).select("b.*")


_FAULT = "forced as (select row_id, model, answer, nullif(regexp_extract(content, '\"fault\":\\s*\"([a-z0-9_]+)\"', 1), '') as said, regexp_extract(prompt, ':\\s*([a-z0-9_]+(?:, [a-z0-9_]+)+)', 1) as options from e5_real_logs where arm = 'forced_choice')"


def forced(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "e5_real_logs").where(F.col("arm") == "forced_choice")
    said = F.nullif(F.regexp_extract("content", r'"fault":\s*"([a-z0-9_]+)"', 1), F.lit(""))
    return rows.select("row_id", "model", "answer", said.alias("said"), F.regexp_extract("prompt", r":\s*([a-z0-9_]+(?:, [a-z0-9_]+)+)", 1).alias("options"))


@query(f"with {_FAULT} select answer, grouping(answer)::int as total, count(*) as n, round(avg((coalesce(said, '') = answer)::int), 6) as top1, round(avg(list_contains(string_split(options, ', '), coalesce(said, ''))::int), 6) as acceptable from forced where answer is not null group by rollup (answer)")
def agg17_e1_score(spark, d):
    rows = forced(spark, d).where(F.col("answer").isNotNull())
    said = F.coalesce("said", F.lit(""))
    return rows.rollup("answer").agg(F.grouping("answer").cast("int").alias("total"), F.count("*").alias("n"), F.round(F.avg((said == F.col("answer")).cast("int")), 6).alias("top1"), F.round(F.avg(F.array_contains(F.split("options", ", "), said).cast("int")), 6).alias("acceptable"))


_SIG = "case when {} like '%_lean' or {} in ('maf_low', 'vacuum_leak', 'fuel_pressure_low') then 'lean' when {} like '%_rich' or {} = 'maf_high' then 'rich' else 'none' end"


@query(f"with {_FAULT} select model, count_if(({_SIG.replace('{}', 'answer')}) <> ({_SIG.replace('{}', 'said')}) and ({_SIG.replace('{}', 'answer')}) <> 'none' and ({_SIG.replace('{}', 'said')}) <> 'none') as flips, count_if(answer = 'healthy' and ({_SIG.replace('{}', 'said')}) <> 'none') as healthy_flips from forced where said is not null and answer is not null group by 1")
def agg24_directional_flips(spark, d):
    """flips as the reference counts them; healthy_flips is the clause it documents and never reaches."""
    def sig(c):
        x = F.col(c)
        return F.when(x.endswith("_lean") | x.isin("maf_low", "vacuum_leak", "fuel_pressure_low"), "lean").when(x.endswith("_rich") | (x == "maf_high"), "rich").otherwise("none")

    rows = forced(spark, d).where(F.col("said").isNotNull() & F.col("answer").isNotNull()).withColumn("a", sig("answer")).withColumn("s", sig("said"))
    return rows.groupBy("model").agg(F.count_if((F.col("a") != F.col("s")) & (F.col("a") != "none") & (F.col("s") != "none")).alias("flips"), F.count_if((F.col("answer") == "healthy") & (F.col("s") != "none")).alias("healthy_flips"))


@query("""select arm, count(*) as n, count_if(answer_class = 'exact') as exact, count_if(answer_class = 'dangerous_miss') as dangerous, count_if(answer_class = 'honest_decline') as declined,
count_if(answer_class in ('exact', 'dangerous_miss', 'unit_mismatch', 'range_mismatch', 'ambiguous_parse', 'unparseable')) as answered, round(count_if(answer_class = 'exact') / count(*), 6) as match_rate,
round(coalesce(count_if(answer_class = 'exact') / nullif(count_if(answer_class in ('exact', 'dangerous_miss', 'unit_mismatch', 'range_mismatch', 'ambiguous_parse', 'unparseable')), 0), 0), 6) as precision,
round(count_if(answer_class in ('exact', 'dangerous_miss', 'unit_mismatch', 'range_mismatch', 'ambiguous_parse', 'unparseable')) / count(*), 6) as coverage,
case when count(*) <> (select count(*) // 4 from e2_answers) then 'INCOMPLETE' when count_if(answer_class = 'dangerous_miss') > 0 then 'FAIL' else 'pass' end as hard_gate from e2_answers group by 1""")
def agg18_value_score(spark, d):
    rows = table(spark, d, "e2_answers")
    return E.value_scores(rows, ["arm"], rows.count() // 4)  # four arms of one size make the population


@query("select coalesce(finish_reason, 'None') as finish_reason, count(*) as n from e5_real_logs group by 1")
def agg18_finish_census(spark, d):
    return table(spark, d, "e5_real_logs").groupBy(F.coalesce("finish_reason", F.lit("None")).alias("finish_reason")).agg(F.count("*").alias("n"))


@query("select model, count(*) as episodes, round(avg((answer is not null)::int), 6) as asked, median(completion_tokens) as median_tokens, round(median(latency_s), 6) as median_s from e5_real_logs group by 1")
def agg19_battery(spark, d):
    return table(spark, d, "e5_real_logs").groupBy("model").agg(F.count("*").alias("episodes"), F.round(F.avg(F.col("answer").isNotNull().cast("int")), 6).alias("asked"), F.median("completion_tokens").alias("median_tokens"), F.round(F.median(F.nanvl("latency_s", F.lit(None).cast("double"))), 6).alias("median_s"))


@query("with v as (select probe_id, answer_class, count(*) as n, min(row_id) as f from e2_answers where answer_class is not null group by 1, 2) select probe_id, max_by(answer_class, n * 1000000000 - f) as majority, max(n) as votes from v group by 1")
def agg20_majority(spark, d):
    return E.majority(table(spark, d, "e2_answers"), ["probe_id"], "answer_class", "row_id")


@query("select model, arm, list_sort(list(completion_tokens) filter (completion_tokens is not null))[count(completion_tokens) // 2 + 1] as upper_median, median(completion_tokens) as median_tokens, round(sum(case when completion_tokens is not null and latency_s > 0 then completion_tokens end) / sum(case when completion_tokens is not null and latency_s > 0 then latency_s end), 1) as decode_ts from e2_answers group by 1, 2")
def agg21_22_tokens(spark, d):
    rows = table(spark, d, "e2_answers")
    upper = E.upper_medians(rows, ["model", "arm"], "completion_tokens").withColumnRenamed("model", "m").withColumnRenamed("arm", "a")
    rest = rows.groupBy("model", "arm").agg(F.median("completion_tokens").alias("median_tokens"), E.throughput("completion_tokens", "latency_s").alias("decode_ts"))
    return rest.join(upper, rest.model.eqNullSafe(upper.m) & rest.arm.eqNullSafe(upper.a), "left").drop("m", "a")


_LISTS = "lists as (select retrieved_doc_ids as ids, count(*) as n from e2_answers where retrieved_doc_ids is not null group by 1)"


@query(f"with {_LISTS} select (select count(*) from e2_answers where retrieved_doc_ids is not null) as queries, (select count(distinct x) from (select unnest(retrieved_doc_ids) as x from e2_answers)) as docs, (select count(*) from lists) as lists, n as top_n, array_to_string(ids, ',') as top_ids from lists order by n desc, ids desc limit 1")
def agg23_diversity(spark, d):
    return E.diversity(table(spark, d, "e2_answers"), "retrieved_doc_ids")


@query("with x as (select unnest(list_distinct(retrieved_doc_ids)) as doc_id from e2_answers where retrieved_doc_ids is not null) select doc_id, count(*) as queries, round(100.0 * count(*) / (select count(*) from e2_answers where retrieved_doc_ids is not null), 4) as pct from x where doc_id is not null group by 1 order by 2 desc, 1 limit 10")
def agg23_coverage(spark, d):
    return E.coverage(table(spark, d, "e2_answers"), "retrieved_doc_ids", 10)


@query("with one as (select probe_id, arm, run_no, min(answer_class) as c from e2_answers group by 1, 2, 3) select a.c as old, b.c as new, count(*) as n from one a join one b on a.probe_id = b.probe_id and a.arm = b.arm where a.run_no = 1 and b.run_no = 2 group by 1, 2")
def agg25_transitions(spark, d):
    one = table(spark, d, "e2_answers").groupBy("probe_id", "arm", "run_no").agg(F.min("answer_class").alias("c"))
    a, b = one.where("run_no = 1").select("probe_id", "arm", F.col("c").alias("old")), one.where("run_no = 2").select("probe_id", "arm", F.col("c").alias("new"))
    return a.join(b, ["probe_id", "arm"]).groupBy("old", "new").agg(F.count("*").alias("n"))


@query("with one as (select concat(probe_id, arm) as k, run_no, min(answer.value) as v from e2_answers group by 1, 2) select count(*) as n, count_if(a.v = b.v and trim(a.v) <> '') as same from (select * from one where run_no = 1) a full join (select * from one where run_no = 2) b on a.k = b.k")
def join06_determinism(spark, d):
    one = table(spark, d, "e2_answers").groupBy(F.concat("probe_id", "arm").alias("k"), "run_no").agg(F.min("answer.value").alias("v"))
    return E.determinism(one.where("run_no = 1"), one.where("run_no = 2"), "k", "v")


@query("select judge_model, count(*) as chunks, count(distinct doc_id) as docs, count_if(score is null) as unscored, count_if(score = 1) as s1, count_if(score = 2) as s2, count_if(score = 3) as s3, count_if(score = 4) as s4, count_if(score = 5) as s5, sum(prompt_tokens)::bigint as prompt_tokens from judgment group by 1")
def agg26_run_stats(spark, d):
    j = table(spark, d, "judgment")
    return j.groupBy("judge_model").agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("docs"), F.count_if(F.col("score").isNull()).alias("unscored"), *(F.count_if(F.col("score") == s).alias(f"s{s}") for s in range(1, 6)), F.sum("prompt_tokens").alias("prompt_tokens"))


PAIR = "array<struct<symptoms:string,diagnosis:string,change:string,outcome:string>>"


def harvested(spark: SparkSession, d: str) -> DataFrame:
    """FLT-11, FLT-12, SNK-03: pairs of the latest judgments whose four fields all say something."""
    rows = C.judged_chunks(table(spark, d, "judgment")).where(F.col("score") >= C.KEEP_SCORE)
    p = rows.select("doc_id", "chunk_index", "rubric_version", "relevance", F.posexplode(F.from_json("pairs_json", PAIR)).alias("pair_no", "p"))
    full = F.forall(F.array("p.symptoms", "p.diagnosis", "p.change", "p.outcome"), lambda x: F.length(F.trim(F.coalesce(x, F.lit("")))) > 0)
    return p.where(full).select("doc_id", "chunk_index", "rubric_version", "relevance", "pair_no", "p.*")


_PAIRS = f"""{_LATEST}, each as (select doc_id, chunk_index, rubric_version, relevance, unnest(range(json_array_length(pairs_json)::bigint)) as pair_no, pairs_json from latest where score >= 4 and pairs_json is not null and json_valid(pairs_json)),
pairs as (select doc_id, chunk_index, rubric_version, relevance, pair_no::int as pair_no, json_extract_string(pairs_json, '$[' || pair_no || '].symptoms') as symptoms, json_extract_string(pairs_json, '$[' || pair_no || '].diagnosis') as diagnosis, json_extract_string(pairs_json, '$[' || pair_no || '].change') as change, json_extract_string(pairs_json, '$[' || pair_no || '].outcome') as outcome from each),
whole as (select * from pairs where length(trim(coalesce(symptoms, ''))) > 0 and length(trim(coalesce(diagnosis, ''))) > 0 and length(trim(coalesce(change, ''))) > 0 and length(trim(coalesce(outcome, ''))) > 0)"""


@query(f"with {_PAIRS} select * from whole")
def flt11_12_pairs(spark, d):
    return harvested(spark, d)


@query(f"with {_PAIRS} select relevance, count(*) as n, round(100.0 * count(*) / (select count(*) from whole), 4) as pct from whole group by 1")
def agg30_composition(spark, d):
    rows = harvested(spark, d)
    n = rows.agg(F.count("*").alias("_n"))
    return rows.groupBy("relevance").agg(F.count("*").alias("n")).crossJoin(F.broadcast(n)).select("relevance", "n", F.round(100.0 * F.col("n") / F.col("_n"), 4).alias("pct"))


@query(f"with {_PAIRS} select doc_id, pair_no, rubric_version, chunk_index, symptoms from whole order by (relevance like 'subaru%') desc nulls last, length(diagnosis) desc, doc_id, rubric_version, chunk_index, pair_no limit 20")
def top09_priority_fill(spark, d):
    rows = harvested(spark, d).withColumn("own", F.col("relevance").startswith("subaru"))
    best = rows.orderBy(F.desc_nulls_last("own"), F.desc(F.length("diagnosis")), "doc_id", "rubric_version", "chunk_index", "pair_no").limit(20)
    return best.select("doc_id", "pair_no", "rubric_version", "chunk_index", "symptoms")


@query(f"with {_PAIRS} select doc_id, pair_no, coalesce(b.relevance, a.relevance) as relevance from whole a left join (select doc_id as d2, max(relevance) as relevance from latest where rubric_version = 'r1' group by 1) b on b.d2 = a.doc_id")
def join07_overrides(spark, d):
    """Classification of pairs, where the other rubric's verdict overrides."""
    other = C.judged_chunks(table(spark, d, "judgment")).where("rubric_version = 'r1'").groupBy("doc_id").agg(F.max("relevance").alias("over"))
    return harvested(spark, d).join(other, "doc_id", "left").select("doc_id", "pair_no", F.coalesce("over", "relevance").alias("relevance"))


@query(f"with {_PAIRS} select doc_id, pair_no, 'Likely cause: ' || diagnosis || chr(10) || 'Change: ' || change || chr(10) || 'Outcome: ' || outcome as answer, rubric_version, chunk_index from whole")
def scl20_chat(spark, d):
    text = F.concat_ws("\n", F.concat(F.lit("Likely cause: "), "diagnosis"), F.concat(F.lit("Change: "), "change"), F.concat(F.lit("Outcome: "), "outcome"))
    return harvested(spark, d).select("doc_id", "pair_no", text.alias("answer"), "rubric_version", "chunk_index")


@query()
def scl07_evl07_guard(spark, d):
    """The evidence guard over every answer and the texts retrieved for it. Java lookbehinds: no SQL."""
    answers = table(spark, d, "e2_answers").select("row_id", F.col("answer.value").alias("value"), "retrieved_doc_ids", "answer_class")
    docs = table(spark, d, "documents").select("doc_id", "text")
    read = docs.select("doc_id", E.evidence_numbers(F.col("text")).alias("found")).where(F.col("found").isNotNull())
    pools = answers.select("row_id", F.explode(F.array_distinct("retrieved_doc_ids")).alias("doc_id")).join(read, "doc_id")
    evidence = pools.groupBy("row_id").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("pool"))
    one = answers.join(evidence, "row_id", "left")
    return one.select("row_id", "answer_class", E.guarded(F.col("value"), F.col("pool"), F.col("pool").isNotNull()).alias("verdict"))


@query()
def evl07_counts(spark, d):
    """What the guard catches of harmful answers, and what it blocks of right ones."""
    return E.guard_counts(scl07_evl07_guard(spark, d), "verdict", F.col("answer_class") == "dangerous_miss", F.col("answer_class") == "exact")


_MIX = """verdicts as (select doc_id, title as diagnosis, case domain when 'subaru' then 'subaru' else case when kind is null then 'other' else 'modern_general' end end as relevance, case when judge_score >= 4 then 'deep' when judge_score = 3 then 'adequate' else 'shallow' end as depth,
 case when contains(lower(coalesce(title, '')), 'idle') then 'idle' else coalesce(kind, 'none') end as topic from documents),
 mixed as (select v.* from verdicts v where doc_id not in (select doc_id from judgment where doc_id is not null and score = 1) and relevance in ('subaru', 'modern_general') and depth <> 'shallow')"""


def mixed(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pairs, their judgments as flags."""
    docs = table(spark, d, "documents")
    depth = F.when(F.col("judge_score") >= 4, "deep").when(F.col("judge_score") == 3, "adequate").otherwise("shallow")
    relevance = F.when(F.col("domain") == "subaru", "subaru").when(F.col("kind").isNull(), "other").otherwise("modern_general")
    topic = F.when(F.lower(F.coalesce("title", F.lit(""))).contains("idle"), "idle").otherwise(F.coalesce("kind", F.lit("none")))
    verdicts = docs.select("doc_id", relevance.alias("relevance"), depth.alias("depth"), topic.alias("topic"))
    flagged = table(spark, d, "judgment").where("doc_id is not null and score = 1").select("doc_id")
    return E.pair_mix(docs.select("doc_id", F.col("title").alias("diagnosis")), verdicts, flagged, "doc_id")


@query(f"with {_MIX} select doc_id, diagnosis, relevance, depth, topic from mixed")
def flt10_mix(spark, d):
    """FLT-10: pairs that a mix may take."""
    return mixed(spark, d).select("doc_id", "diagnosis", "relevance", "depth", "topic")


@query(f"with {_MIX} select doc_id from mixed order by relevance = 'subaru' desc, topic in ('maf', 'idle', 've_load', 'injectors') desc, case depth when 'deep' then 2 else 1 end desc, length(diagnosis) desc nulls last, doc_id limit 40")
def top09_filled(spark, d):
    """TOP-09: the first forty by platform, lacking topic, depth and length."""
    return E.filled(mixed(spark, d), 40, "doc_id").select("doc_id")


@query("select 'syn-' || doc_id || '-' || k as pair_id, doc_id, json_extract_string(pairs_json, '$[' || k || '].symptoms') as symptoms from (select doc_id, pairs_json, unnest(range(json_array_length(pairs_json)::bigint)) as k from judgment where doc_id is not null and pairs_json is not null and json_valid(pairs_json))")
def evl06_ids(spark, d):
    """EVL-06: items of a model's output with their ids."""
    rows = table(spark, d, "judgment").where(F.col("doc_id").isNotNull())
    return E.numbered(rows, "syn", "doc_id", F.col("pairs_json"), "array<struct<symptoms:string,diagnosis:string,change:string,outcome:string>>", "pair_id").select("pair_id", "doc_id", "symptoms")


_PLAIN = "trim(regexp_replace(replace(coalesce({}, ''), chr(173), ''), '[\s\p{{Z}}]+', ' ', 'g'))"


@query(f"""with s as (select row_id, expected_value, title, {_PLAIN.format('text')} as source, {_PLAIN.format('title')} as quote from e2_answers join documents on doc_id = retrieved_doc_ids[1])
select row_id, contains(source, quote) as quoted, coalesce(list_bool_and(list_transform(regexp_extract_all(coalesce(expected_value, ''), '-?\d[\d.,]*'), lambda v: contains(source, v) or contains(replace(source, ',', ''), replace(v, ',', '')))), true) as stated from s""")
def scl21_checks(spark, d):
    """SCL-21: does the title, as a quote, and does the expected value stand in the first document retrieved?"""
    rows = table(spark, d, "e2_answers").select("row_id", "expected_value", F.try_element_at("retrieved_doc_ids", F.lit(1)).alias("doc_id"))
    both = rows.join(table(spark, d, "documents").select("doc_id", "text", "title"), "doc_id")
    return both.select("row_id", T.quoted_in(F.col("title"), F.col("text")).alias("quoted"), T.values_in(F.col("expected_value"), F.col("text")).alias("stated"))


@query("select row_id, try_cast(nullif(regexp_extract(expected_value, '-?\d+(?:\.\d+)?'), '') as double) as number from e2_answers")
def scl38_number(spark, d):
    """SCL-38: the first plain number of a text."""
    return table(spark, d, "e2_answers").select("row_id", T.tolerant_number(F.col("expected_value")).alias("number"))


@query()
def scl04_06_numbers(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.size(numbers(t)).alias("numbers"), F.round(F.aggregate(numbers(t), F.lit(0.0), lambda a, x: a + F.abs(x)), 3).alias("total"), (healed(t) != t).alias("torn"))


_EVENTS = "ev as (select user_id as unit, ts, event_id, event_type as state, value from events)"


@query(f"with {_EVENTS} select unit, max_by(state, row(ts, event_id)) as state from ev group by 1")
def dml10_unit_state(spark, d):
    """Work units as an append-only log; the state is that of the last event."""
    ev = table(spark, d, "events").select(F.col("user_id").alias("unit"), "ts", "event_id", F.col("event_type").alias("state"))
    return E.ledger_state(ev, "unit", ["ts", "event_id"], "state")


@query(f"with {_EVENTS}, s as (select unit, max_by(state, row(ts, event_id)) as state from ev group by 1) select state, count(*) as units, min(unit) as next_unit from s group by 1")
def agg13_top10_claims(spark, d):
    """Units by state, and the one to claim next: the least."""
    return dml10_unit_state(spark, d).groupBy("state").agg(F.count("*").alias("units"), F.min("unit").alias("next_unit"))


@query("""select model, arm, case when count(*) < 30 then 'rows' when count_if(content is not null and trim(content) <> '') < 0.8 * count(*) then 'unanswered' when list_sort(list(coalesce(completion_tokens, 0)))[count(*) // 2 + 1] < 6 then 'short'
when count_if(finish_reason = 'length') > 0.2 * count(*) then 'truncated' else 'ok' end as verdict from e5_real_logs group by 1, 2""")
def dml11_validate(spark, d):
    """The first check that fails: rows, answered share, upper-median tokens, truncated share."""
    n = F.count("*")
    few = F.count_if(F.coalesce("completion_tokens", F.lit(0)) < 6)  # the upper median is under 6 if more than half are
    answered = F.count_if(F.col("content").isNotNull() & (F.trim("content") != ""))
    verdict = F.when(n < 30, "rows").when(answered < 0.8 * n, "unanswered").when(few > F.floor(n / 2), "short").when(F.count_if(F.col("finish_reason") == "length") > 0.2 * n, "truncated").otherwise("ok")
    return table(spark, d, "e5_real_logs").groupBy("model", "arm").agg(verdict.alias("verdict"))


@query("with f as (select arm, arm || '-' || run_no as file, row_id from e2_answers where arm is not null and run_no is not null), l as (select arm, max(file) as file from f group by 1) select arm as tag, file, count(*) as n from f join l using (arm, file) group by all")
def src19_newest_file(spark, d):
    """SRC-19: results written as a file for each run, and the rows of the newest file of each tag."""
    path = scratch(spark, "results")
    rows = table(spark, d, "e2_answers").where("arm is not null and run_no is not null").select("row_id", F.concat_ws("-", "arm", F.col("run_no").cast("string")).alias("file"))
    rows.write.partitionBy("file").json(path)
    newest = files.newest_per_tag(spark, path, "row_id bigint", r"^file=(.+)-\d+$")
    return newest.groupBy("tag", F.regexp_replace("_file", "^file=", "").alias("file")).agg(F.count("*").alias("n"))


@query("select count(*) as answers, count(p.probe_id) as known from e2_answers a left join (select distinct probe_id from e2_answers where run_no = 1) p on p.probe_id = a.probe_id")
def join05_referential(spark, d):
    """Answers define the population; how many have their case."""
    a = table(spark, d, "e2_answers")
    cases = a.where("run_no = 1").select(F.col("probe_id").alias("case")).distinct()
    return a.join(cases, F.col("probe_id") == F.col("case"), "left").agg(F.count("*").alias("answers"), F.count("case").alias("known"))
