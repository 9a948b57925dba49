import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tunemill.operators import retrieval as R
from tunemill.plans import core


def brute(queries, docs, k):
    """(q, doc_id, score, rank) of plain BM25."""
    bags = {i: Counter(t.split()) for i, t in docs if t}
    size = {i: sum(b.values()) for i, b in bags.items()}
    mean, df = sum(size.values()) / len(size), Counter(t for b in bags.values() for t in b)
    out = []
    for q, asked in queries.items():
        of = lambda b, n: [math.log(1 + (len(bags) - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * (R.K1 + 1) / (b[t] + R.K1 * (1 - R.B + R.B * n / mean)) for t in asked if t in b]
        scores = {i: sum(s) for i, b in bags.items() if (s := of(b, size[i]))}
        out += [(q, i, round(s, 6), r + 1) for r, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k])]
    return out


@pytest.mark.parametrize("entries, sets", [(1 << 22, 1 << 16), (64, 3)])
def test_bm25_matches_brute_force(spark, monkeypatch, entries, sets):
    monkeypatch.setattr(R, "ENTRIES", entries)
    monkeypatch.setattr(R, "SETS", sets)
    rng = random.Random(7)
    words = ["w" + "".join(rng.choices("abcdef", k=4)) for _ in range(40)]
    docs = [(i, " ".join(rng.choices(words[: rng.choice([3, 10, 40])], k=rng.randint(1, 15)))) for i in range(200)]
    docs += [(i + 200, t) for i, t in docs[:50]] + [(900, None), (901, ""), (902, "zz zz")]  # ties, and texts without terms
    queries = {q: set(rng.sample(words + ["nowhere"], rng.randint(1, 6))) for q in range(30)}
    queries |= {q + 30: t for q, t in queries.items()} | {99: {"nowhere"}}
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    asked = spark.createDataFrame([(q, t) for q, terms in queries.items() for t in terms], "q bigint, term string")
    got = R.bm25(asked, d, "q", "doc_id", F.col("text"), 5)
    assert got.columns == ["q", "doc_id", "score", "rank"]
    want = {(q, r): (i, s) for q, i, s, r in brute(queries, [x for x in docs if x[0] != 902], 5)}
    have = {(r.q, r["rank"]): (r.doc_id, r.score) for r in got.collect()}
    assert have.keys() == want.keys() and all(have[x][0] == want[x][0] and abs(have[x][1] - want[x][1]) < 2e-6 for x in want)


def written(spark):
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(s.shuffleWriteRecords() for s in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())))


def test_bm25_does_not_shuffle_a_row_for_each_query_and_document(spark):
    d = spark.range(2_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("common other term xx"), "id").alias("text"))
    asked = spark.range(400).select(F.col("id").alias("q"), F.explode(F.array(F.lit("common"), F.lit("other"), F.concat(F.lit("xx"), F.col("id")))).alias("term"))
    before = written(spark)
    rows = R.bm25(asked, d, "q", "doc_id", F.col("text"), 3).collect()
    assert len(rows) == 1_200 and all(r.doc_id == r.q for r in rows if r["rank"] == 1)
    assert written(spark) - before < 400 * 2_000 / 10


@pytest.mark.parametrize("name, rows", [("ret06_grounding", 150), ("ret03_fusion", 2_000), ("ret05_tiers", 2_000), ("win10_ret04_capped", 2_000)])
def test_queries_do_not_shuffle_a_row_for_each_query_and_document(spark, tmp_path, name, rows):
    tier = F.when(F.col("id") % 40 == 0, "community").otherwise("reference")
    d = spark.range(4_000).select(F.col("id").alias("doc_id"), F.lit("common other").alias("title"), F.lit("common other term").alias("text"), tier.alias("tier"), F.lit("one").alias("source"))
    d.where("doc_id < 2000").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(20).select(F.col("id").alias("vec_id"), F.array(F.col("id") + 1.0, F.lit(1.0)).alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    before = written(spark)
    assert core.QUERIES[name](spark, str(tmp_path)).count() == rows
    assert written(spark) - before < 100 * 2_000 / 4
