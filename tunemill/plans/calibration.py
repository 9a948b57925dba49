"""Queries over cells and images (lineitem as edits of calibration cells, part and supplier as definitions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tunemill.operators import calibration as C
from tunemill.operators import definitions as D
from tunemill.operators import images as I
from tunemill.operators import judging as J
from tunemill.operators import simulation as S
from tunemill.plans import evaluation
from tunemill.plans.registry import Registry
from tunemill.session import table

query = Registry()

_EDITS = """edits as (select l_orderkey as proposal, l_linenumber::int as col, case l_returnflag when 'A' then 'fuel' when 'R' then 'timing' else 'sensor' end as kind, l_quantity::double as cur, l_quantity * 1.02::double as base, l_quantity * 0.98::double as stock,
 l_quantity::double * (1 + (l_discount::double - 0.05) * 4) as new, (l_suppkey % 40)::int as count, l_tax::double * 12 as load, 30.0::double as ceiling, 40.0::double as afr_floor, (l_partkey % 7 = 0) as knock_active, (l_orderkey % 5 <> 0) as converged, (l_orderkey % 11 <> 0) as steady from lineitem)"""


def edits(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem")
    q, kind = F.col("l_quantity").cast("double"), F.when(F.col("l_returnflag") == "A", "fuel").when(F.col("l_returnflag") == "R", "timing").otherwise("sensor")
    return r.select(F.col("l_orderkey").alias("proposal"), F.col("l_linenumber").cast("int").alias("col"), kind.alias("kind"), q.alias("cur"), (q * 1.02).alias("base"), (q * 0.98).alias("stock"), (q * (1 + (F.col("l_discount").cast("double") - 0.05) * 4)).alias("new"), (F.col("l_suppkey") % 40).cast("int").alias("count"), (F.col("l_tax").cast("double") * 12).alias("load"), F.lit(30.0).alias("ceiling"), F.lit(40.0).alias("afr_floor"), (F.col("l_partkey") % 7 == 0).alias("knock_active"), (F.col("l_orderkey") % 5 != 0).alias("converged"), (F.col("l_orderkey") % 11 != 0).alias("steady"))


_CHAIN = f"""{_EDITS}, c1 as (select *, case when kind = 'timing' then least(new, ceiling) else new end as n1 from edits),
c2 as (select *, case when kind = 'timing' then greatest(least(n1, cur), base - 30, 0.0) end as v from c1),
c3 as (select *, case when kind = 'timing' then case when abs(v - cur) > 6 and count = 0 and v >= least(ceiling, cur) then v else greatest(v, cur - 6) end else n1 end as n2 from c2),
c4 as (select *, case when kind = 'fuel' then case when abs(cur) < 1e-9 then cur else cur + sign(n2 - cur) * least(abs(n2 - cur), 0.03 * abs(cur)) end else n2 end as n3 from c3),
c5 as (select *, case when kind = 'fuel' then least(greatest(stock * (1 - 0.1), stock * (1 + 0.1)), greatest(least(stock * (1 - 0.1), stock * (1 + 0.1)), n3)) else n3 end as n4 from c4),
c6 as (select *, case when kind = 'sensor' then case when count < 20 then cur else least(least(cur * (1 + 0.4), base * (1 + 0.4)), greatest(greatest(cur * (1 - 0.4), base * (1 - 0.4)), n4)) end else n4 end as n5 from c5),
c7 as (select *, case when kind = 'fuel' and load >= 0.6 and n5 > afr_floor then afr_floor else n5 end as n6 from c6),
gate as (select proposal, case when bool_or(knock_active) and not bool_and(new <= cur + 1e-9) then 'knock' when bool_or(kind in ('timing', 'boost')) and not bool_and(converged) then 'fuel first' when not bool_and(steady) then 'transient' end as refused from edits group by 1)"""


@query(f"with {_CHAIN} select proposal, col, kind, round(case when refused is not null then cur else n6 end, 6) as new, refused from c7 join gate using (proposal)")
def clp_chain(spark, d):
    """CLP-00 to CLP-11: gates and modifiers in their order."""
    return C.clamped(edits(spark, d), "proposal").select("proposal", "col", "kind", F.round("new", 6).alias("new"), "refused")


@query(f"with {_CHAIN}, a as (select 'ceiling' as clamp, new as x, n1 as y from c7 union all select 'timing', n1, n2 from c7 union all select 'rate', n2, n3 from c7 union all select 'envelope', n3, n4 from c7 union all select 'sensor', n4, n5 from c7 union all select 'floor', n5, n6 from c7) select clamp, count(*) as cells from a where abs(x - y) > 1e-9 group by 1")
def clp12_audit(spark, d):
    each = C.clamped(edits(spark, d)).select(F.explode("audit").alias("a")).select("a.*")
    return each.where(F.abs(F.col("asked") - F.col("given")) > 1e-9).groupBy("clamp").agg(F.count("*").alias("cells"))


@query()
def clp13_report(spark, d):
    return C.report(C.clamped(edits(spark, d)), "proposal")


@query()
def win11_monotone(spark, d):
    """Sensor curves of an order made rising."""
    e = edits(spark, d).where("kind = 'sensor'").groupBy("proposal", "col").agg(F.max("cur").alias("cur"), F.max("new").alias("new"))
    return C.monotone(e, ["proposal"])


@query("with c as (select l_orderkey as id, l_linenumber as col, max(l_discount) as disc from lineitem group by 1, 2) select id, col, 'changed' as kind from c where col % 3 = 0 and disc > 0 union all select id, col, 'removed' from c where col = 5")
def join15_cell_diff(spark, d):
    """Cells of two versions of a table."""
    a = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("col")).agg(F.max(F.col("l_quantity").cast("double")).alias("v"), F.max("l_discount").alias("l_discount"))
    b = a.where("col <> 5").withColumn("v", F.when(F.col("col") % 3 == 0, F.col("v") * (1 + F.col("l_discount").cast("double"))).otherwise(F.col("v")))
    return I.cell_diff(a, b, ["id", "col"], "v").select("id", "col", "kind")


@query("with v as (select l_partkey % 50 as param, (l_suppkey % 3)::int as addr, count(*) as n from lineitem group by 1, 2), r as (select *, row_number() over (partition by param order by n desc, addr) as k, sum(n) over (partition by param) as total, count(*) over (partition by param) as kinds from v) select param, addr, n as votes, total::bigint as of, case when kinds = 1 then 'high' when n * 2 > total then 'medium' else 'NEEDS-VALIDATION' end as confidence from r where k = 1")
def join16_voted(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("param"), (F.col("l_suppkey") % 3).cast("int").alias("addr"))
    return I.voted(rows, "param", "addr")


_MERGE = """with recursive chain as (select s_suppkey as leaf, s_suppkey as node, 0 as depth from supplier where s_suppkey > 0
union all select leaf, node // 2, depth + 1 from chain where node > 1)
select 'def' || leaf as leaf, 't' || (s_suppkey % 4) as name, min_by(s_nationkey, row(depth, s_suppkey)) filter (s_suppkey % 3 <> 0)::int as nation, round(min_by(s_acctbal, row(depth, s_suppkey)) filter (s_suppkey % 5 <> 0), 2) as balance from chain join supplier on s_suppkey = node group by all"""


@query(_MERGE)
def join17_chain_merge(spark, d):
    """JOIN-17: tables of definitions with include lists; each attribute is the nearest that a definition on the way gives."""
    key = F.col("s_suppkey").cast("bigint")
    parent = F.floor(key / 2)
    name = lambda k: F.concat(F.lit("def"), k.cast("string"))
    defs = table(spark, d, "supplier").where("s_suppkey > 0").select(name(key).alias("xmlid"), F.when(key > 1, F.array(name(parent))).otherwise(F.array().cast("array<string>")).alias("include"), F.concat(F.lit("t"), (key % 4).cast("string")).alias("name"), F.when(key % 3 != 0, F.col("s_nationkey")).cast("int").alias("nation"), F.when(key % 5 != 0, F.col("s_acctbal").cast("double")).alias("balance"))
    return D.merged(defs, "xmlid", "include", "name", ["nation", "balance"]).withColumn("balance", F.round("balance", 2))


@query("with r as (select l_partkey as part, (l_quantity::int % 4)::int as v, l_suppkey as src from lineitem), g as (select part, v, count(*) as n from r group by 1, 2), x as (select part, count(*) as k, count_if(v = 3) as p, max(v) as v from g group by 1) select part, case when k = 1 or p = 1 then v end as v, case when k = 1 then 'agree' when p = 1 then 'one plausible' else 'ambiguous' end as verdict from x")
def join18_reconciled(spark, d):
    """Reads of a part by several suppliers; a read of 3 is the plausible one."""
    r = table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), (F.col("l_quantity").cast("int") % 4).alias("v"), F.col("l_suppkey").alias("src")).withColumn("ok", F.col("v") == 3)
    return I.reconciled(r, "part", "src", "v", "ok").select("part", "v", "verdict")


_SIM = "w as (select l_orderkey, l_linenumber, 480 + l_quantity::double as fb, 0.9 + l_discount::double as lb, 0.95 + l_tax::double as mb, l_discount::double / 10 as leak, case l_linenumber % 2 when 0 then 2.0 else 1.0 end as air, case l_linenumber % 3 when 0 then 12.0 else 14.0 end as volts from lineitem)"


@query(f"""with {_SIM}, p as (select *, greatest(0.0, 14.0 - volts) as dv from w), q as (select *, 0.1 * air * mb / 1.0 / 14.7 / (fb * (0.74 / 60000)) + lb + 0.12 * lb / 1.0 * dv as pw from p), r as (select *, greatest(0.0, pw - (1.0 + 0.12 * dv)) * 500.0 * (0.74 / 60000) as delivered from q)
select l_orderkey, l_linenumber, round(case when delivered > 0 then (0.1 * air + leak) / 14.7 / delivered - 1 else 1.0 end, 6) as trim from r""")
def sim01_trim(spark, d):
    r = table(spark, d, "lineitem")
    n, disc, tax = F.col("l_linenumber"), F.col("l_discount").cast("double"), F.col("l_tax").cast("double")
    air, volts = F.when(n % 2 == 0, 2.0).otherwise(1.0), F.when(n % 3 == 0, 12.0).otherwise(14.0)
    t = S.trim_column(480 + F.col("l_quantity").cast("double"), 0.9 + disc, 0.95 + tax, F.lit(500.0), F.lit(1.0), F.lit(1.0), disc / 10, air, volts)
    return r.select("l_orderkey", "l_linenumber", F.round(t, 6).alias("trim"))


@query("""with f as (select l_orderkey, l_linenumber, (l_quantity::double - 25) / 2 as ti, (l_quantity::double - 25) / 2 * (0.5 + l_discount::double * 5) as tf, l_tax::double - 0.04 as md, (l_quantity::double - 25) / 2 + l_tax::double * 30 as tl from lineitem),
v as (select *, case when abs(ti) < 3 then 'healthy' when md < -0.03 then 'maf_low' when md > 0.03 then 'maf_high' when ti > 0 then case when coalesce(tf / nullif(ti, 0), 1) > 0.8 then 'injector_flow_lean' else 'vacuum_leak' end else 'injector_flow_rich' end as v1 from f)
select l_orderkey, l_linenumber, v1, case when v1 = 'vacuum_leak' and tl - ti > 1 then 'injector_latency_lean' else v1 end as v2 from v""")
def sim05_rules(spark, d):
    r = table(spark, d, "lineitem")
    ti = (F.col("l_quantity").cast("double") - 25) / 2
    tf, md, tl = ti * (0.5 + F.col("l_discount").cast("double") * 5), F.col("l_tax").cast("double") - 0.04, ti + F.col("l_tax").cast("double") * 30
    return r.select("l_orderkey", "l_linenumber", S.rules(ti, tf, md).alias("v1"), S.rules(ti, tf, md, tl).alias("v2"))


def worlds(spark: SparkSession, d: str) -> DataFrame:
    """As many worlds of each fault as there are documents in a hundred."""
    return S.worlds(spark, max(1, table(spark, d, "documents").count() // 100))


@query()
def est01_estimates(spark, d):
    """Seeded worlds of every fault and what the estimator makes of them."""
    w = worlds(spark, d)
    return S.estimates(w, "world").join(w.select("world", "truth"), "world")


@query()
def top11_hypotheses(spark, d):
    """TOP-11: the ranked explanations of each world."""
    return S.hypotheses(worlds(spark, d), "world")


@query()
def sim03_convergence(spark, d):
    """A closed loop for each document's id as the seed."""
    seed = F.col("doc_id")
    starts = table(spark, d, "documents").select(seed.alias("seed"), (F.lit(1.0) + (seed % 7 - 3) * 0.03).alias("flow_ratio"), F.lit(1.0).alias("latency_ratio"), (F.lit(1.0) + (seed % 5 - 2) * 0.04).alias("maf_ratio"))
    return S.convergence(starts)


@query("select l_orderkey, l_linenumber, round_even((l_quantity::double - 10) / 0.3515625, 0)::bigint as raw, round(10 + round_even((l_quantity::double - 10) / 0.3515625, 0) * 0.3515625, 6) as back from lineitem where round_even((l_quantity::double - 10) / 0.3515625, 0) between 0 and 255")
def scl42_encode(spark, d):
    """Values as unsigned bytes of 0.3515625 from 10 on, and what they read back as."""
    x = I.encoded(F.col("l_quantity").cast("double"), "(x-10)/0.3515625", "10+x*0.3515625", "uint8")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"))
    return rows.where("x.raw is not null").select("l_orderkey", "l_linenumber", F.col("x.raw").alias("raw"), F.round("x.back", 6).alias("back"))


@query("select o_custkey % 20 as grp, (sum(o_orderkey) % 4294967296)::bigint as total from orders group by 1")
def scl43_word_sums(spark, d):
    """Checksums over the 32-bit words of an image per group: the words are order keys."""
    o = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("grp"), I.big_endian(F.col("o_orderkey").cast("bigint"), "uint32").alias("w"))
    image = o.groupBy("grp").agg(F.unhex(F.array_join(F.transform(F.collect_list("w"), lambda w: F.hex(w)), "")).alias("content"))
    regions = image.select("grp", "content", F.lit(0).alias("start"), (F.length("content") - 1).alias("stop"))
    return I.word_sums(regions, ["grp"], "content", "start", "stop")


@query("select o_orderkey, (o_orderkey % 65536)::bigint as u16, (case when o_orderkey % 65536 >= 32768 then o_orderkey % 65536 - 65536 else o_orderkey % 65536 end)::bigint as i16 from orders")
def scl41_decode(spark, d):
    b = I.big_endian(F.col("o_orderkey") % 65536, "uint16")
    one = lambda s: F.element_at(I.integers(F.col("b"), F.lit(0), F.lit(1), s), 1)
    return table(spark, d, "orders").withColumn("b", b).select("o_orderkey", one("uint16").alias("u16"), one("int16").alias("i16"))


@query()
def scl10_classes(spark, d):
    return J.classified(table(spark, d, "e2_answers"))


@query("with c as (select row_id, answer_class from e2_answers) select answer_class as stored, count(*) as n from c group by 1")
def evl04_stored_classes(spark, d):
    return table(spark, d, "e2_answers").groupBy(F.col("answer_class").alias("stored")).agg(F.count("*").alias("n"))


@query()
def evl04_reclassified(spark, d):
    """EVL-04, EVL-05: every stored class beside what today's classifier, the first one and the guard say of the row."""
    return J.reclassified(table(spark, d, "e2_answers"), evaluation.scl07_evl07_guard(spark, d))


@query()
def win09_scl16_chunks(spark, d):
    return J.chunks(table(spark, d, "documents"), 4_000, 200)


@query("select doc_id, true as numbered, true as within, true as natural from documents where text is not null")
def win09_checks(spark, d):
    """WIN-09: are a document's chunks numbered in full, within the limit and its overlap, and made of its own text?"""
    each = J.chunks(table(spark, d, "documents"), 4_000, 200).join(table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"\s+", "").alias("whole")), "doc_id")
    last = F.regexp_replace(F.element_at(F.split("text", "\n\n"), -1), r"\s+", "")
    return each.groupBy("doc_id").agg(((F.count("*") == F.max("n_chunks")) & (F.countDistinct("chunk_index") == F.max("n_chunks")) & (F.min("chunk_index") == 0)).alias("numbered"), (F.max(F.length("text")) <= 4_202).alias("within"), F.bool_and(F.contains("whole", last)).alias("natural"))


@query(f"with {_EDITS} select distinct proposal, true as rising from edits where kind = 'sensor'")
def win11_checks(spark, d):
    """WIN-11: does each edited cell lie over its left neighbour, or keep its current value?"""
    w = Window.partitionBy("proposal").orderBy("col")
    cells = win11_monotone(spark, d).withColumn("left", F.lag("new").over(w))
    return cells.groupBy("proposal").agg(F.bool_and(F.col("left").isNull() | (F.col("new") > F.col("left")) | (F.col("new") == F.col("cur"))).alias("rising"))


@query()
def evl01_judged(spark, d):
    """The judging loop with a scorer that needs no model: a score by length."""
    def scorer(text: str) -> str:
        return '{"score": %d, "rationale": "length %d"}' % (min(5, 1 + len(text) // 1000), len(text))

    return J.judged(J.chunks(table(spark, d, "documents"), 4_000, 200), scorer)


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def agg_hourly(spark, d):
    """Tumbling windows over events, in batch; streams have windowed() with the same aggregates. An addition."""
    e = table(spark, d, "events")
    start = F.timestamp_micros((F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000) * 3_600_000_000).cast("bigint")).cast("timestamp_ntz")
    return e.groupBy(start.alias("start"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
