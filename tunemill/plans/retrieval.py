"""Queries of ranking, fusion, evidence windows and near duplicates. The query set is every document or vector whose id is
divisible by 20."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunemill.functions.text import STOP_WORDS, parent_key
from tunemill.operators import retrieval as R
from tunemill.operators import runs, sets
from tunemill.plans.registry import Registry
from tunemill.session import table

query = Registry()
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_T = lambda col: f"list_filter(list_transform(regexp_extract_all({col}, '[A-Za-z][A-Za-z0-9_/.\\-]{{2,}}'), lambda w: lower(w)), lambda w: w not in ({_STOP}))"
_TERMS = lambda col, where: f"""raw_q as (select doc_id, {_T(col)} as t from documents where {where}), each_q as (select doc_id, unnest(range(len(t))) as pos, unnest(t) as term from raw_q),
cnt_q as (select doc_id, term, count(*) as n, min(pos) as f from each_q group by 1, 2), top_q as (select doc_id, term, n, row_number() over (partition by doc_id order by n desc, length(term) desc, f) as rank from cnt_q qualify rank <= 12)"""  # noqa: E731


@query(f"with {_TERMS('text', 'text is not null')} select doc_id, term, n, rank::int as rank from top_q")
def top01_query_terms(spark, d):
    return R.top_terms(table(spark, d, "documents"), "doc_id", F.col("text"))


_INDEX = f"""idx_raw as (select doc_id, {_T('text')} as t from documents where text is not null), idx as (select term, doc_id, size, count(*) as tf from (select doc_id, len(t) as size, unnest(t) as term from idx_raw) group by 1, 2, 3),
stat as (select count(*) as nn, avg(size) as av from (select distinct doc_id, size from idx)), df as (select term, count(*) as df from idx group by 1)"""
_BM25 = f"""{_TERMS('title', 'doc_id % 20 = 0 and title is not null')}, {_INDEX}, sc as (select q.doc_id as q, i.doc_id, round(sum(ln(1 + (nn - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / av))), 6) as score
 from (select distinct doc_id, term from top_q) q join df using (term) join idx i using (term) cross join stat group by 1, 2), bm as (select *, row_number() over (partition by q order by score desc, doc_id) as rank from sc qualify rank <= 20)"""


def bm25(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    asked = docs.where("doc_id % 20 = 0")
    terms = R.top_terms(asked, "doc_id", F.col("title")).withColumnRenamed("doc_id", "q")
    return R.bm25(terms, docs, "q", "doc_id", F.col("text"))


@query(f"with {_BM25} select q, doc_id, score, rank::int as rank from bm")
def ret01_top02_bm25(spark, d):
    return bm25(spark, d)


_DENSE = """a as (select q.vec_id as q, v.vec_id, round(list_dot_product(q.embedding::double[], v.embedding::double[]) / (sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) * sqrt(list_dot_product(v.embedding::double[], v.embedding::double[]))), 6) as score
 from (select * from embeddings where vec_id % 20 = 0) q, embeddings v), dn as (select *, row_number() over (partition by q order by score desc, vec_id) as rank from a qualify rank <= 20)"""


def dense(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return R.cosine(v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "q"), v, "q", "vec_id", "embedding", 20)


@query(f"with {_DENSE} select q, vec_id, score, rank::int as rank from dn")
def top03_dense(spark, d):
    return dense(spark, d)


@query("select vec_id, round(embedding[1]::double / sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as first, round(list_sum(list_transform(embedding::double[], lambda x: abs(x))) / sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as l1 from embeddings where list_dot_product(embedding::double[], embedding::double[]) > 0")
def ret02_normalised(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", R.normalised(F.col("embedding")).alias("v")).where("v is not null")
    return v.select("vec_id", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("l1"))


_HYBRID = f"""{_BM25}, {_DENSE}, every as (select q, doc_id as id, rank, 0 as no from bm union all select q, vec_id, rank, 1 from dn), fu as (select q, id, round(sum(1.0::double / (60 + rank)), 9) as score, min(row(no, rank)) as seen from every group by 1, 2),
hy as (select q, id, score, row_number() over (partition by q order by score desc, seen, id) as rank from fu)"""


def hybrid(spark: SparkSession, d: str) -> DataFrame:
    return R.fused([bm25(spark, d).withColumnRenamed("doc_id", "id"), dense(spark, d).withColumnRenamed("vec_id", "id")], "q", "id")


@query(f"with {_HYBRID} select q, id, score, rank::int as rank from hy")
def ret03_fusion(spark, d):
    return hybrid(spark, d)


@query(f"""with {_HYBRID}, p as (select h.q, h.id, h.rank, coalesce(lower(trim(source)), h.id::varchar) as parent from hy h left join documents on doc_id = h.id), o as (select *, row_number() over (partition by q, parent order by rank) <= 2 as ok from p),
c as (select *, sum(ok::int) over (partition by q order by rank rows unbounded preceding) as n, coalesce(sum(ok::int) over (partition by q order by rank rows between unbounded preceding and 1 preceding), 0) as b from o)
select q, id, rank::int as rank, parent, ok as kept, case when ok then n end::bigint as place from c where b < 6""")
def win10_ret04_capped(spark, d):
    """Hybrid retrieval with at most two documents of a source, six kept, those left out recorded."""
    parents = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lower(F.trim("source")).alias("parent"))
    return R.capped(hybrid(spark, d), parents, "q", "id", 2, 6)


@query(f"with {_BM25}, t as (select b.*, tier from bm b join documents using (doc_id) where tier is not null) select q, doc_id, tier, row_number() over (partition by q order by (tier = 'community'), rank)::int as place from t")
def ret05_tiers(spark, d):
    """Reference hits first, community hits after them, each in its own order."""
    from pyspark.sql.window import Window

    t = bm25(spark, d).join(table(spark, d, "documents").select("doc_id", "tier"), "doc_id").where(F.col("tier").isNotNull())
    return t.select("q", "doc_id", "tier", F.row_number().over(Window.partitionBy("q").orderBy(F.col("tier") == "community", "rank")).alias("place"))


@query(f"with {_BM25} select q, doc_id, rank::int as rank from (select b.q, b.doc_id, row_number() over (partition by b.q order by b.rank) as rank from bm b join documents d on d.doc_id = b.doc_id and d.tier = 'reference' join documents s on s.doc_id = b.q and s.tier = 'community') where rank <= 3")
def ret06_grounding(spark, d):
    """Up to three reference documents for each community document asked."""
    from pyspark.sql.window import Window

    docs = table(spark, d, "documents")
    hits = bm25(spark, d).join(docs.where("tier = 'reference'").select("doc_id"), "doc_id").join(docs.where("tier = 'community'").select(F.col("doc_id").alias("q")), "q")
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("rank"))).where("rank <= 3").select("q", "doc_id", "rank")


@query()
def scl11_win08_windows(spark, d):
    """The evidence window of every document for its own title's terms, 1,200 characters at most."""
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    words = R.top_terms(docs, "doc_id", F.col("title")).groupBy("doc_id").agg(F.collect_list("term").alias("words"))
    return R.windows(docs.select("doc_id", "text").join(words, "doc_id", "left"), "text", "words", 1_200).select("doc_id", "snippet")


@query("select doc_id, split_part(source_id, '#', 1) as parent, row_number() over (partition by split_part(source_id, '#', 1) order by doc_id)::int as part from documents where source_id is not null")
def scl17_parts(spark, d):
    from pyspark.sql.window import Window

    p = parent_key(F.col("source_id"))
    return table(spark, d, "documents").where(F.col("source_id").isNotNull()).select("doc_id", p.alias("parent"), F.row_number().over(Window.partitionBy(p).orderBy("doc_id")).alias("part"))


@query("select doc_id, true as within, true as whole, length(trim(coalesce(text, ''), e' \\t\\n\\r')) > 1200 as cut from documents where text is not null")
def scl11_checks(spark, d):
    """SCL-11: is each window of at most 1200 characters a stretch of its text that begins and ends between words?"""
    rows = scl11_win08_windows(spark, d).join(table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", "text"), "doc_id")
    own = F.regexp_replace(F.regexp_replace("snippet", "^… ", ""), " …$", "")
    at = F.position(own, F.col("text"))  # a window of a text may stand there more than once; one whole occurrence is enough
    padded = F.concat(F.lit(" "), F.regexp_replace("text", r"[\s\p{Z}]", " "), F.lit(" "))
    between = (at > 0) & (F.contains(padded, F.concat(F.lit(" "), F.regexp_replace(own, r"[\s\p{Z}]", " "), F.lit(" "))) | (own == ""))
    return rows.select("doc_id", (F.length("snippet") <= 1_200).alias("within"), between.alias("whole"), (F.length(F.btrim("text", F.lit(" \t\n\r"))) > 1_200).alias("cut"))


_SETS = """sets as (select doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))) as s from documents where text is not null),
  reps as (select min(doc_id) as rep, s, len(s) as n from sets where len(s) > 0 group by s), each as (select rep, n, unnest(s) as w from reps),
  shared as (select a.rep as a, b.rep as b, a.n + b.n as n, count(*) as o from each a join each b on a.w = b.w and a.rep < b.rep group by all),
  links as (select a, b, o / (n - o) as similarity from shared where 8 * o > 3 * n)"""
_CLASSED = f"""with recursive {_SETS}, ways as (select a, b from links union all select b, a from links),
  reach as (select rep, rep as c from reps union select b, c from reach join ways on a = rep), named as (select rep, min(c) as class from reach group by rep),
  degree as (select a as rep, count(*) as links from ways group by a),
  classed as (select doc_id, class, coalesce(links, 0) as links from sets join reps using (s) join named using (rep) left join degree using (rep)
    union all select doc_id, doc_id, 0 from documents where doc_id not in (select doc_id from sets where len(s) > 0))"""
ALIKE = Fraction(3, 5)


@query(f"with {_SETS} select a, b, round(similarity, 6) as similarity from links")
def set01_links(spark, d):
    """Links of over 0.6 between different word sets."""
    _, reps = sets.classes(table(spark, d, "documents"), "doc_id", sets.words(F.col("text")))
    return sets.links(reps, ALIKE, strict=True).withColumn("similarity", F.round("similarity", 6))


def _classed(spark: SparkSession, d: str) -> DataFrame:
    return sets.near_duplicates(table(spark, d, "documents"), "doc_id", sets.words(F.col("text")), ALIKE, strict=True, without=True)


@query(f"{_CLASSED} select doc_id, class, links from classed")
def set01_classes(spark, d):
    """One row for each document; those without a word are classes of their own."""
    return _classed(spark, d)


@query(f"{_CLASSED} select class, arg_max(doc_id, [coalesce(judge_score, -1), coalesce(length(text), -1), -doc_id]) as exemplar, count(*) as members from classed join documents using (doc_id) group by class")
def set01_exemplars(spark, d):
    """The document that stands for each class: by score, then length."""
    return sets.exemplars(_classed(spark, d), table(spark, d, "documents"), "doc_id", F.col("judge_score"), F.length("text"))


@query()
def set01_shingles(spark, d):
    """Classes of 0.8 or more over five-word shingles."""
    return runs.near_duplicates(table(spark, d, "documents"), "doc_id", F.col("text"), Fraction(4, 5), without=True)


@query("select min(doc_id) as doc_id, url from documents where url is not null group by url")
def set03_links(spark, d):
    """Links kept once, the first."""
    rows = table(spark, d, "documents").where(F.col("url").isNotNull()).select("doc_id", "url")
    return sets.first_seen(rows, "url", [F.asc("doc_id")])


@query("select 'both' as side, count(*) as n from (select doc_id from documents where judge_score is not null intersect select doc_id from judgment) union all select 'only', count(*) from (select doc_id from judgment where doc_id is not null except select doc_id from documents where judge_score is not null)")
def set05_labels(spark, d):
    a = table(spark, d, "documents").where(F.col("judge_score").isNotNull()).select("doc_id")
    b = table(spark, d, "judgment").select("doc_id")
    both = a.intersect(b).agg(F.count("*").alias("n")).select(F.lit("both").alias("side"), "n")
    return both.unionByName(b.where(F.col("doc_id").isNotNull()).distinct().join(a, "doc_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("only").alias("side"), "n"))


@query("select 'organic' as origin, count(*) as n from judgment where pairs_json is not null union all select 'synthetic', count(*) from e2_answers")
def set04_union(spark, d):
    a = table(spark, d, "judgment").where(F.col("pairs_json").isNotNull()).select(F.lit("organic").alias("origin"))
    return a.unionByName(table(spark, d, "e2_answers").select(F.lit("synthetic").alias("origin"))).groupBy("origin").agg(F.count("*").alias("n"))
