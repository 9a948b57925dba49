"""Queries of correction proposals and of the gates and modifiers that need whole tables (lineitem as cells and readings)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunemill.operators import calibration as C
from tunemill.plans.registry import Registry
from tunemill.session import table

query = Registry()

_CELLS = """cells as (select l_orderkey as id, l_linenumber::int as xi, max(l_quantity)::double as cur, max(l_quantity)::double * 0.8 as base, max(l_partkey % 60)::int as count,
  max(l_discount)::double as disc, max(l_tax)::double as tax, max(l_suppkey)::bigint as supp from lineitem group by 1, 2)"""


def cells(spark: SparkSession, d: str) -> DataFrame:
    """One cell for each order and line number."""
    r = table(spark, d, "lineitem")
    q = F.max("l_quantity").cast("double")
    return r.groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("int").alias("xi")).agg(q.alias("cur"), (q * 0.8).alias("base"), F.max(F.col("l_partkey") % 60).cast("int").alias("count"), F.max("l_discount").cast("double").alias("disc"), F.max("l_tax").cast("double").alias("tax"), F.max("l_suppkey").cast("bigint").alias("supp"))


@query(f"""with {_CELLS}, r as (select id, xi, (cur - 25) / 3 as trim_pct, case xi % 3 when 0 then 1.0 when 1 then 0.0 else 0.2 end as w_latency, case xi % 3 when 1 then 1.0 when 0 then 0.0 else 0.3 end as w_flow,
  case xi % 3 when 2 then 0.5 else 0.0 end as w_maf, disc as t_latency, tax as t_flow, 0.0 as t_maf, 1.0 as latency, 500.0 as flow, cur as maf from cells),
k as (select *, case when w_latency >= greatest(w_flow, w_maf) then 'latency' when w_flow >= w_maf then 'flow' else 'maf' end as knob from r),
t as (select *, case knob when 'latency' then t_latency when 'flow' then t_flow else t_maf end as total from k),
s as (select *, 0.7 * (0.5 * (trim_pct / 100) + 0.05 * (total + trim_pct / 100)) as raw from t), c as (select *, least(0.03, greatest(-0.03, raw)) as step from s)
select id, xi, knob, round(step, 8) as step, round(latency * (1 + step * w_latency), 8) as new_latency, round(flow / (1 + step * w_flow), 6) as new_flow, round(maf * (1 + step * w_maf), 6) as new_maf,
  round(case when step = raw then total + trim_pct / 100 else total end, 8) as next_total from c""")
def cal01_idle(spark, d):
    """CAL-01: a bounded proportional-integral step, shared by the knobs' weights; the integral belongs to the main knob."""
    xi = F.col("xi") % 3
    pick = lambda a, b, c: F.when(xi == 0, a).when(xi == 1, b).otherwise(c)
    rows = cells(spark, d).withColumns({"trim_pct": (F.col("cur") - 25) / 3, "w_latency": pick(1.0, 0.0, 0.2), "w_flow": pick(0.0, 1.0, 0.3), "w_maf": pick(0.0, 0.0, 0.5), "t_latency": F.col("disc"), "t_flow": F.col("tax"), "t_maf": F.lit(0.0), "latency": F.lit(1.0), "flow": F.lit(500.0), "maf": F.col("cur")})
    out = C.idle_correction(rows)
    total = F.coalesce(*(F.when(F.col("knob") == k, F.col(f"next_{k}")) for k in C.KNOBS))
    return out.select("id", "xi", "knob", F.round("step", 8).alias("step"), F.round("new_latency", 8).alias("new_latency"), F.round("new_flow", 6).alias("new_flow"), F.round("new_maf", 6).alias("new_maf"), F.round(total, 8).alias("next_total"))


_CURVES = f"""{_CELLS}, r as (select id, xi, cur, base, count, case when supp % 3 > 0 and count >= 20 then (disc - 0.03) * 200 end as trim from cells),
a as (select *, case when trim is not null then case when abs(trim / 100) < 0.02 then 0.0 else trim / 100 end end as anchor from r),
n as (select *, last_value(anchor ignore nulls) over b as v0, last_value(case when anchor is not null then xi end ignore nulls) over b as i0, first_value(anchor ignore nulls) over f as v1,
  first_value(case when anchor is not null then xi end ignore nulls) over f as i1 from a window b as (partition by id order by xi rows between unbounded preceding and current row), f as (partition by id order by xi rows between current row and unbounded following)),
i as (select *, coalesce(case when i1 = i0 then v0 else v0 + (v1 - v0) * (xi - i0) / (i1 - i0) end, 0.0) as filled from n)"""


def curves(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).withColumn("trim", F.when((F.col("supp") % 3 > 0) & (F.col("count") >= 20), (F.col("disc") - 0.03) * 200))


@query(f"with {_CURVES} select id, xi, 'measured' as kind, round(cur * (1 + 0.7 * filled), 6) as new from i where filled <> 0")
def cal02_maf(spark, d):
    """CAL-02: anchors, dead band, interpolation inside the measured span, damping."""
    return C.maf_correction(curves(spark, d), ["id"]).select("id", "xi", "kind", F.round("new", 6).alias("new"))


@query(f"""with {_CURVES}, h as (select *, row_number() over (partition by id order by xi desc) as k from i where trim is not null and abs(base) > 0),
p as (select id, sum(greatest(count, 1) * cur / base * (1 + trim / 100)) / sum(greatest(count, 1)) as ratio from h where k <= 3 group by 1), l as (select id, max(xi) as last from i where anchor is not null group by 1),
e as (select i.*, xi > last and base > 0 and base * coalesce(ratio, 1) > cur as above, base * coalesce(ratio, 1) as up from i left join p using (id) left join l using (id))
select id, xi, case when above then 'extrapolated' else 'measured' end as kind, round(case when above then up else cur * (1 + 0.7 * filled) end, 6) as new from e where coalesce(above, false) or filled <> 0""")
def cal02_plateau(spark, d):
    """CAL-02 with the plateau held above the measured span."""
    return C.maf_correction(curves(spark, d), ["id"], extrapolate=True).select("id", "xi", "kind", F.round("new", 6).alias("new"))


_TIMED = f"""{_CELLS}, t as (select id, xi, cur, base * 1.3 as ceiling, case when xi = 4 then null else -disc * 20 end as knock, (tax - 0.04) * 10 as fine, case when supp % 4 = 0 then tax * 10 else 0.0 end as deficit, count >= 20 as confident from cells),
m as (select *, greatest(0.0, -coalesce(knock, 0)) + greatest(0.0, -coalesce(fine, 0)) as measured from t), e as (select *, case when confident then case when measured < 0.25 then 0.0 else measured end + deficit else 0.0 end as evidence from m)"""


@query(f"with {_TIMED} select id, xi, round(least(cur - evidence, ceiling), 6) as new from e where least(cur - evidence, ceiling) < cur")
def cal03_timing(spark, d):
    """CAL-03: what evidence of knock takes away, never over the ceiling."""
    rows = cells(spark, d).select("id", "xi", "cur", (F.col("base") * 1.3).alias("ceiling"), F.when(F.col("xi") != 4, -F.col("disc") * 20).alias("knock"), ((F.col("tax") - 0.04) * 10).alias("fine"), F.when(F.col("supp") % 4 == 0, F.col("tax") * 10).otherwise(0.0).alias("deficit"), (F.col("count") >= 20).alias("confident"))
    return C.timing_retard(rows).select("id", "xi", F.round("new", 6).alias("new"))


_XS, _YS, _TO_X, _TO_Y = [0.1, 0.5, 1.0, 2.5], [800.0, 2000.0, 4000.0], [0.2, 0.75, 1.9], [1000.0, 5000.0]


@query(f"""with {_CELLS}, map as (select supp % 20 as rom, (xi % 4)::int as xi, (count % 3)::int as yi, max(cur - 25) as value from cells group by all), drive as (select supp % 20 as rom, greatest(0.0, 0.5 - min(disc * 10)) as deficit from cells group by 1),
pick(tx, ty, xi, yi) as (values (0, 0, 0, 0), (0, 1, 0, 2), (1, 0, 1, 0), (1, 1, 1, 2), (2, 0, 3, 0), (2, 1, 3, 2))
select rom, tx as xi, ty as yi, round(deficit * greatest(0.0, value), 6) as degrees from map join pick using (xi, yi) join drive using (rom)""")
def cal04_deficit(spark, d):
    """CAL-04, JOIN-09: the shortfall of the worst multiplier times the advance map, resampled on the target's axes."""
    c = cells(spark, d).withColumn("rom", F.col("supp") % 20)
    advance = c.groupBy("rom", (F.col("xi") % 4).cast("int").alias("xi"), (F.col("count") % 3).cast("int").alias("yi")).agg(F.max(F.col("cur") - 25).alias("value"))
    drive = c.withColumn("iam", F.col("disc") * 10).groupBy("rom").agg(C.iam_deficit("iam", 0.5, F.lit(1.0)).alias("deficit"))
    authority = C.aligned(advance, ["rom"], _XS, _YS, _TO_X, _TO_Y)
    return authority.join(drive, "rom").select("rom", "xi", "yi", F.round(F.col("deficit") * F.greatest(F.lit(0.0), "value"), 6).alias("degrees"))


_PROPOSED = f"""{_CELLS}, p as (select id as proposal, xi as col, case xi when 2 then 'boost' when 3 then 'sensor' when 5 then 'mixture' else 'fuel' end as kind, case when supp % 5 = 0 then 'flow' when supp % 5 = 1 then 'latency' else 'maf' end as table_id, cur,
  case when supp % 7 = 0 then cur else cur * (1 + (disc - 0.05) * 3) end as new, base, base as stock, count, tax * 12 as load, 100.0 as ceiling, 11.5 as afr_floor, case when supp % 2 = 0 then 'LAMBDA' else 'AFR' end as unit,
  false as knock_active, id % 5 <> 0 as converged, id % 11 <> 0 as steady, id % 3 = 0 as diagnosed, id % 4 <> 0 as identifiable, case id % 9 when 0 then null when 3 then 'flow' else 'maf' end as knob,
  disc / 1.5 as max_trim, id % 2 = 0 as wideband_tracking, id % 7 <> 0 as boost_verified, id % 2 = 0 as enabled from cells)"""


def proposed(spark: SparkSession, d: str) -> DataFrame:
    s, i, xi = F.col("supp") % 5, F.col("id"), F.col("xi")
    kind = F.when(xi == 2, "boost").when(xi == 3, "sensor").when(xi == 5, "mixture").otherwise("fuel")
    return cells(spark, d).select(
        i.alias("proposal"), xi.alias("col"), kind.alias("kind"), F.when(s == 0, "flow").when(s == 1, "latency").otherwise("maf").alias("table_id"), "cur", F.when(F.col("supp") % 7 == 0, F.col("cur")).otherwise(F.col("cur") * (1 + (F.col("disc") - 0.05) * 3)).alias("new"),
        "base", F.col("base").alias("stock"), "count", (F.col("tax") * 12).alias("load"), F.lit(100.0).alias("ceiling"), F.lit(11.5).alias("afr_floor"), F.when(F.col("supp") % 2 == 0, "LAMBDA").otherwise("AFR").alias("unit"),
        F.lit(False).alias("knock_active"), (i % 5 != 0).alias("converged"), (i % 11 != 0).alias("steady"), (i % 3 == 0).alias("diagnosed"), (i % 4 != 0).alias("identifiable"), F.when(i % 9 == 0, F.lit(None)).when(i % 9 == 3, "flow").otherwise("maf").alias("knob"),
        (F.col("disc") / 1.5).alias("max_trim"), (i % 2 == 0).alias("wideband_tracking"), (i % 7 != 0).alias("boost_verified"), (i % 2 == 0).alias("enabled"),
    )


@query(f"""with {_PROPOSED}, m as (select proposal, list_distinct(list(table_id) filter (abs(new - cur) > greatest(1e-9 * greatest(abs(new), abs(cur)), 1e-12))) as moved, bool_or(diagnosed) as diagnosed, bool_and(identifiable) as sure, max(knob) as knob,
  bool_or(kind = 'boost') as boost, bool_and(converged) as converged, bool_and(steady) as steady, max(abs(max_trim)) <= 0.05 and bool_and(wideband_tracking) and bool_and(boost_verified) as ready from p group by 1)
select proposal, case when diagnosed and len(moved) > 0 and not sure then 'diagnosis: not identifiable' when diagnosed and len(moved) > 0 and knob is null then 'diagnosis: no table' when diagnosed and len(moved) > 0 and moved <> [knob] then 'diagnosis: another table'
  when boost and not converged then 'fuel first' when not steady then 'transient' when boost and not ready then 'boost' end as refused from m""")
def clp02_05_gates(spark, d):
    """CLP-02 and CLP-05 among the gates: agreement of two diagnoses, and what boost edits wait for."""
    return C.gates(proposed(spark, d), "proposal")


@query(f"""with {_PROPOSED}, k as (select proposal, max(col) filter (count >= 20) as last, max(cur / base) filter (count >= 20 and base > 0) as most from p group by 1),
x as (select p.*, coalesce(enabled and col > last and base > 0 and new / base <= most + 1e-9, false) as free from p join k using (proposal)),
b as (select *, case when kind = 'sensor' then case when count < 20 and not free then cur when abs(cur) >= 1e-9 then least(least(cur * 1.4, case when abs(base) >= 1e-9 then base * 1.4 else 1e308 end), greatest(greatest(cur * 0.6, case when abs(base) >= 1e-9 then base * 0.6 else -1e308 end), new)) else new end end as v from x)
select proposal, col, free as may_extrapolate, round(v, 6) as new from b where kind = 'sensor'""")
def clp10_sensor(spark, d):
    """CLP-10: evidence or leave to extrapolate, displacement from the current value and from the base."""
    p = proposed(spark, d)
    free = C.may_extrapolate(p, p.select("proposal", "col", "cur", "base", "count"), ["proposal"])
    return C.clamped(free.where("kind = 'sensor'")).select("proposal", "col", "may_extrapolate", F.round("new", 6).alias("new"))


@query(f"with {_PROPOSED} select proposal, col, unit, round(case when load >= 0.6 and case unit when 'LAMBDA' then new * 14.7 else new end > afr_floor then case unit when 'LAMBDA' then afr_floor / 14.7 else afr_floor end else new end, 6) as new from p where kind = 'mixture'")
def clp11_floor(spark, d):
    """CLP-11 on tables of ratios and of lambda."""
    return C.clamped(proposed(spark, d).where("kind = 'mixture'")).select("proposal", "col", "unit", F.round("new", 6).alias("new"))
