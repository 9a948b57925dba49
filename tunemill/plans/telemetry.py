"""Queries over logged telemetry (memtest_soak as logs of a rig and gpu, events as logs of a user)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunemill.operators import ordered as O
from tunemill.operators import telemetry as T
from tunemill.plans.registry import Registry
from tunemill.session import table

query = Registry()
KEYS, ORDER = ["log"], ["ts", "sample_id"]
XS, YS = [0.0, 25.0, 50.0, 75.0, 100.0], [500.0, 1000.0, 1500.0, 2000.0, 3000.0]

_LOG = """log as (select concat(rig, '-', gpu) as log, sample_id, min(ts) as ts, min(fan1_rpm) as rpm, min(util_pct)::double as tps, min(power_w) as load,
  min(junction_c) - min(inlet_c) as trim, -(min(vram_c) - 60) as knock, min(cpu_c)::double as iat from memtest_soak group by 1, 2),
grad as (select *, case when lag(sample_id) over w is null and lead(sample_id) over w is null then 0.0 when lag(sample_id) over w is null then lead(rpm) over w - rpm when lead(sample_id) over w is null then rpm - lag(rpm) over w else (lead(rpm) over w - lag(rpm) over w) / 2 end as d_rpm,
  case when lag(sample_id) over w is null and lead(sample_id) over w is null then 0.0 when lag(sample_id) over w is null then lead(tps) over w - tps when lead(sample_id) over w is null then tps - lag(tps) over w else (lead(tps) over w - lag(tps) over w) / 2 end as d_tps
  from log window w as (partition by log order by ts, sample_id))"""


def log(spark: SparkSession, d: str) -> DataFrame:
    """One row per sample: copies are equal, so any of them does."""
    s = T.clean(table(spark, d, "memtest_soak"), ["fan1_rpm", "power_w", "junction_c", "vram_c"])
    name = F.concat_ws("-", "rig", F.col("gpu").cast("string"))
    one = s.groupBy(name.alias("log"), "sample_id").agg(*(F.min(c).alias(c) for c in ("ts", "fan1_rpm", "util_pct", "power_w", "junction_c", "inlet_c", "vram_c", "cpu_c")))
    return one.select("log", "sample_id", "ts", F.col("fan1_rpm").alias("rpm"), F.col("util_pct").cast("double").alias("tps"), F.col("power_w").alias("load"), (F.col("junction_c") - F.col("inlet_c")).alias("trim"), (-(F.col("vram_c") - 60)).alias("knock"), F.col("cpu_c").cast("double").alias("iat"))


def graded(spark: SparkSession, d: str) -> DataFrame:
    return T.with_gradients(log(spark, d), KEYS, ORDER, "ts", ["rpm", "tps"])


@query(f"with {_LOG} select log, sample_id, round(d_rpm, 6) as d_rpm, round(d_tps, 6) as d_tps from grad")
def win01_gradient(spark, d):
    return graded(spark, d).select("log", "sample_id", F.round("d_rpm", 6).alias("d_rpm"), F.round("d_tps", 6).alias("d_tps"))


_STEADY = "coalesce(abs(d_rpm) <= 100, false) and coalesce(abs(d_tps) <= 2, false)"


@query(f"with {_LOG} select log, count(*) as n, count_if({_STEADY}) as steady, count_if({_STEADY} and rpm > 500 and load is not null and trim is not null) as strict from grad group by 1")
def flt02_03_steady(spark, d):
    g = graded(spark, d)
    ok = T.steady(g)
    strict = ok & (F.col("rpm") > 500) & F.col("load").isNotNull() & F.col("trim").isNotNull()
    return g.groupBy("log").agg(F.count("*").alias("n"), F.count_if(ok).alias("steady"), F.count_if(strict).alias("strict"))


@query(f"with {_LOG}, finite as (select * from log where knock >= -20), steps as (select *, knock - lag(knock) over (partition by log order by ts, sample_id) as step from finite) select log, count_if(step <= -1.5) as onsets, round(min(knock), 6) as worst from steps group by 1")
def win02_flt04_onsets(spark, d):
    return T.onsets(log(spark, d), KEYS, ORDER, "ts", "knock").withColumn("worst", F.round("worst", 6))


_NEAR = lambda c, b: f"(list_position(list_transform({b}, lambda v: abs({c} - v)), list_min(list_transform({b}, lambda v: abs({c} - v)))) - 1)"
_GRID = f"""cells as (select log, {_NEAR('tps', XS)} as xi, {_NEAR('rpm', YS)} as yi, trim, load from log where tps is not null and rpm is not null),
got as (select log, yi, xi, count(*) as n, sum(coalesce(trim, 0)) / count(*) as mean_trim, avg(load) as mean_load from cells group by 1, 2, 3),
grid as (select l.log, y.yi, x.xi, coalesce(n, 0) as n, mean_trim, mean_load, coalesce(n, 0) >= 20 as confident from (select distinct log from log) l cross join (select unnest(range(5)) as yi) y cross join (select unnest(range(5)) as xi) x left join got g on g.log = l.log and g.yi = y.yi and g.xi = x.xi)"""


def grid(spark: SparkSession, d: str) -> DataFrame:
    return T.grid_bin(log(spark, d), KEYS, "tps", "rpm", XS, YS, ["trim"], ["load"])


@query(f"with {_LOG}, {_GRID} select log, yi::int as yi, xi::int as xi, n as count, round(mean_trim, 6) as mean_trim, round(mean_load, 6) as mean_load, confident from grid")
def agg01_grid(spark, d):
    """AGG-01, JOIN-08."""
    return grid(spark, d).select("log", "yi", "xi", "count", F.round("mean_trim", 6).alias("mean_trim"), F.round("mean_load", 6).alias("mean_load"), "confident")


_WEIGHTED = "coalesce(sum(mean_trim * n) filter (confident and mean_trim is not null and n > 0) / nullif(sum(n) filter (confident and mean_trim is not null and n > 0), 0), sum(mean_trim * n) filter (mean_trim is not null and n > 0) / nullif(sum(n) filter (mean_trim is not null and n > 0), 0), 0.0)"


@query(f"with {_LOG}, {_GRID} select log, round({_WEIGHTED}, 6) as weighted_trim from grid group by 1")
def agg02_weighted_trim(spark, d):
    return grid(spark, d).groupBy("log").agg(F.round(T.weighted_mean("mean_trim", "count", "confident"), 6).alias("weighted_trim"))


@query(f"""with {_LOG}, {_GRID}, live as (select log, max(abs(mean_trim)) filter (confident) / 100 as worst_trim, {_WEIGHTED} as weighted, count_if(n > 0) > 0 as sampled from grid group by 1),
finite as (select * from log where knock >= -20), steps as (select *, knock - lag(knock) over (partition by log order by ts, sample_id) as step from finite), knocks as (select log, count_if(step <= -1.5) as onsets from steps group by 1)
select l.log, coalesce(onsets, 0) as onsets, coalesce(onsets, 0) > 0 as knock_active, round(coalesce(worst_trim, 0), 6) as worst_trim, coalesce(worst_trim <= 0.05, false) as converged, sampled and abs(weighted) / 100 <= 0.05 as steady from live l left join knocks k on k.log = l.log""")
def agg03_live_signals(spark, d):
    cells = grid(spark, d)
    live = cells.groupBy("log").agg((F.max(F.when(F.col("confident"), F.abs("mean_trim"))) / 100).alias("t"), T.weighted_mean("mean_trim", "count", "confident").alias("w"), (F.count_if(F.col("count") > 0) > 0).alias("s"))
    knocks = T.onsets(log(spark, d), KEYS, ORDER, "ts", "knock")
    both = live.join(knocks, "log", "left").withColumn("onsets", F.coalesce("onsets", F.lit(0)))
    return both.select("log", "onsets", (F.col("onsets") > 0).alias("knock_active"), F.round(F.coalesce("t", F.lit(0.0)), 6).alias("worst_trim"), F.coalesce(F.col("t") <= 0.05, F.lit(False)).alias("converged"), (F.col("s") & (F.abs("w") / 100 <= 0.05)).alias("steady"))


@query(f"with {_LOG} select log, round(avg(rpm), 6) as rpm, round(avg(load), 6) as load, round(avg(trim), 6) as trim, round(corr(trim, load), 6) as corr_load, round(corr(trim, rpm), 6) as corr_rpm from (select log, rpm, load, trim from log) group by 1")
def agg04_09_means_corr(spark, d):
    """AGG-04 channel means, AGG-09 correlations over rows where both are there."""
    return log(spark, d).groupBy("log").agg(*(F.round(F.avg(c), 6).alias(c) for c in ("rpm", "load", "trim")), F.round(F.corr("trim", "load"), 6).alias("corr_load"), F.round(F.corr("trim", "rpm"), 6).alias("corr_rpm"))


_COLLAPSED = f"pooled as (select log, xi, sum(n) as n, sum(n) >= 20 as sure, case when sum(n) >= 20 then sum(mean_trim * n) / nullif(sum(case when mean_trim is not null then n end), 0) end as trim from grid group by 1, 2)"


@query(f"with {_LOG}, {_GRID}, {_COLLAPSED} select log, xi::int as xi, n::bigint as n, round(trim, 6) as trim from pooled")
def agg06_collapsed(spark, d):
    return collapsed(spark, d).select("log", "xi", "n", F.round("trim", 6).alias("trim"))


def collapsed(spark: SparkSession, d: str) -> DataFrame:
    """The grid without its rpm axis, count-weighted; too few samples are missing."""
    w = F.sum(F.col("mean_trim") * F.col("count")) / F.sum(F.when(F.col("mean_trim").isNotNull(), F.col("count")))
    return grid(spark, d).groupBy("log", "xi").agg(F.sum("count").alias("n"), F.when(F.sum("count") >= T.MIN_SAMPLES, w).alias("trim"))


@query(f"with {_LOG}, {_GRID}, {_COLLAPSED}, top as (select *, row_number() over (partition by log order by xi desc) as r from pooled where sure and trim is not null) select l.log, round(coalesce(sum(trim * greatest(n, 1)) / nullif(sum(greatest(n, 1)), 0), 1.0), 6) as plateau from (select distinct log from log) l left join top t on t.log = l.log and r <= 3 group by 1")
def agg07_plateau(spark, d):
    from pyspark.sql.window import Window

    cells = collapsed(spark, d)
    top = cells.where(F.col("trim").isNotNull()).withColumn("r", F.row_number().over(Window.partitionBy("log").orderBy(F.desc("xi")))).where("r <= 3")
    got = top.groupBy("log").agg((F.sum(F.col("trim") * F.greatest("n", F.lit(1))) / F.sum(F.greatest("n", F.lit(1)))).alias("p"))
    return cells.select("log").distinct().join(got, "log", "left").select("log", F.round(F.coalesce("p", F.lit(1.0)), 6).alias("plateau"))


@query(f"""with {_LOG}, {_GRID}, {_COLLAPSED}, marks as (select *, last_value(trim ignore nulls) over b as v0, first_value(trim ignore nulls) over a as v1,
  last_value(case when trim is not null then xi end ignore nulls) over b as i0, first_value(case when trim is not null then xi end ignore nulls) over a as i1 from pooled
  window b as (partition by log order by xi rows between unbounded preceding and current row), a as (partition by log order by xi rows between current row and unbounded following))
select log, xi::int as xi, round(coalesce(case when i1 = i0 then v0 else v0 + (v1 - v0) * (xi - i0) / (i1 - i0) end, 0), 6) as filled from marks""")
def arr01_gap_fill(spark, d):
    return T.interpolated(collapsed(spark, d), ["log"], "xi", "trim").select("log", "xi", F.round("filled", 6).alias("filled"))


@query(f"with {_LOG}, b as (select *, case when load >= 0 and load < 50 then 0 when load >= 50 and load < 150 then 1 when load >= 150 and load < 300 then 2 when load >= 300 and load < 600 then 3 end as bin from log) select log, bin::int as bin, count(*) as n, round(avg(trim), 6) as mean_trim, round(avg(rpm), 6) as mean_rpm from b where bin is not null group by 1, 2 having count(*) >= 40")
def agg08_range_histogram(spark, d):
    h = T.range_histogram(log(spark, d), ["log"], "load", [0.0, 50.0, 150.0, 300.0, 600.0], ["trim", "rpm"])
    return h.withColumns({c: F.round(c, 6) for c in ("mean_trim", "mean_rpm")})


@query(f"with {_LOG}, s as (select log, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) over (partition by log order by ts, sample_id) as step from log) select log, round(1.0 / nullif(median(step), 0), 6) as hz from s group by 1")
def agg28_sample_rate(spark, d):
    return T.sample_hz(log(spark, d), KEYS, ORDER, "ts").withColumn("hz", F.round("hz", 6))


@query("with one as (select distinct rig, gpu, time_bucket(interval 1 minute, ts) as minute, max(junction_c) as hot from memtest_soak where junction_c is not null group by all) select rig, epoch(minute)::bigint as minute, max(hot) as worst, max_by(gpu, hot * 1000 - gpu) as gpu, bool_or(hot > 108) as abort from one group by 1, 2")
def agg29_worst_device(spark, d):
    """Per rig and minute the hottest device; of equals the first. STR-02's threshold as a column."""
    s = T.clean(table(spark, d, "memtest_soak"), ["junction_c"]).where(F.col("junction_c").isNotNull())
    minute = (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000) * 60).alias("minute")
    one = s.groupBy("rig", "gpu", minute).agg(F.max("junction_c").alias("hot"))
    return one.groupBy("rig", "minute").agg(F.max("hot").alias("worst"), F.max_by("gpu", F.struct("hot", -F.col("gpu"))).alias("gpu"), F.bool_or(F.col("hot") > 108).alias("abort"))


_RUNS = "ordered as (select *, row_number() over (partition by user_id order by ts, event_id) as a, row_number() over (partition by user_id, event_type order by ts, event_id) as b from events)"


@query(f"with {_RUNS} select user_id, event_type, count(*) as n, min(event_id) as first_id from ordered group by user_id, event_type, a - b having count(*) >= 3")
def win04_stable_runs(spark, d):
    """Three equal events in a row, the stability gate's condition."""
    r = O.runs(O.paced(table(spark, d, "events"), ["user_id"], "ts", "pace"), ["user_id"], ["ts", "event_id"], F.col("pace"), "event_type")
    return r.where("n >= 3").select("user_id", "event_type", "n", F.col("start.event_id").alias("first_id"))


@query("with o as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events), bad as (select user_id, min(r) as r from o where not coalesce(value > 20, false) group by 1), n as (select user_id, count(*) as c from events group by 1) select n.user_id, coalesce(bad.r - 1, c) as trailing from n left join bad on bad.user_id = n.user_id")
def win03_trailing_run(spark, d):
    return T.trailing_run(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("value") > 20)


@query("""with i as (select l_suppkey as k, l_partkey as lo, l_partkey + l_quantity::int as hi from lineitem), o as (select *, max(hi) over (partition by k order by lo, hi rows between unbounded preceding and 1 preceding) as reach from (select k, lo, hi, count(*) as n from i group by 1, 2, 3)),
s as (select *, sum(case when reach is null or lo > reach then 1 else 0 end) over (partition by k order by lo, hi rows unbounded preceding) as island from o) select k, min(lo) as lo, max(hi) as hi, sum(n)::bigint as n from s group by k, island""")
def win07_merged_intervals(spark, d):
    i = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("a"), (F.col("l_partkey") + F.col("l_quantity").cast("int")).alias("b"))
    return T.merged_intervals(i, ["k"], "a", "b", F.floor(F.col("lo") / 500))


@query("with o as (select user_id, ts, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, value > 50 as hit from events), h as (select *, i - row_number() over (partition by user_id order by i) as g from o where hit) select user_id, min(i) as start, max(i) + 1 as stop from h group by user_id, g")
def win06_hit_ranges(spark, d):
    """Index ranges [start, stop) of neighbouring hits, as of differing bytes."""
    rows = O.running_total(O.paced(table(spark, d, "events"), ["user_id"], "ts", "pace"), ["user_id"], ["ts", "event_id"], F.col("pace"), F.lit(1), "i").withColumn("i", F.col("i") - 1)
    hits = rows.where(F.col("value") > 50)
    numbered = O.running_total(hits, ["user_id"], ["ts", "event_id"], F.col("pace"), F.lit(1), "k")
    return numbered.groupBy("user_id", (F.col("i") - F.col("k")).alias("g")).agg(F.min("i").alias("start"), (F.max("i") + 1).alias("stop")).drop("g")


CEIL_R, CEIL_L = [0.0, 1000.0, 2000.0, 3000.0], [0.0, 100.0, 200.0, 400.0]
CEIL = [[45.0 - 5 * i - 3 * j for j in range(4)] for i in range(4)]
CAPS = {1500.0: 38.0, 2500.0: 30.0}
_ABOVE = lambda c, b: f"(len(list_filter({b}, lambda v: {c} >= v - greatest(abs(v) * 1e-6, 1e-9))))"


@query(f"with {_LOG}, i as (select *, {_ABOVE('rpm', CEIL_R)} as r, {_ABOVE('load', CEIL_L)} as l, {_ABOVE('rpm', [1500.0, 2500.0])} as c from log) select log, sample_id, least([38.0, 30.0][c], case when r > 0 and l > 0 then ({CEIL}[r])[l] else null end, case when (case when c > 0 then c end) is null and (r = 0 or l = 0 or r is null or l is null) then 25.0 end)::double as ceiling from i")
def join10_arr05_ceiling(spark, d):
    """Highest break at or below each axis; the lesser of the rpm cap and the map cell; 25 where neither holds."""
    r, l = T.at_or_above(F.col("rpm"), CEIL_R), T.at_or_above(F.col("load"), CEIL_L)
    c = T.at_or_above(F.col("rpm"), list(CAPS))
    caps = F.array(*map(F.lit, CAPS.values()))
    cell = F.array(*[F.array(*map(F.lit, row)) for row in CEIL])
    cap = F.when(c.isNotNull(), F.element_at(caps, c + 1))
    two = F.when(r.isNotNull() & l.isNotNull(), F.element_at(F.element_at(cell, r + 1), l + 1))
    return log(spark, d).select("log", "sample_id", F.coalesce(F.least(cap, two), F.lit(25.0)).alias("ceiling"))


@query(f"with {_LOG} select log, sample_id, round(case when iat is null then null when iat <= 20 then 1.0 when iat <= 40 then 1.0 + (iat - 20) * (1.1 - 1.0) / 20 when iat <= 60 then 1.1 + (iat - 40) * (1.3 - 1.1) / 20 else 1.3 end, 6) as factor from log")
def arr02_interp(spark, d):
    return log(spark, d).select("log", "sample_id", F.round(T.interp(F.col("iat"), [60.0, 40.0, 20.0], [1.3, 1.1, 1.0]), 6).alias("factor"))


@query("select 'soak' as kind, count(*) as n, count(power_w) as a, 0::bigint as b from memtest_soak union all select 'events', count(*), 0, count(value) from events")
def join11_pooled(spark, d):
    a = table(spark, d, "memtest_soak").select(F.lit("soak").alias("kind"), F.col("power_w").alias("a"))
    b = table(spark, d, "events").select(F.lit("events").alias("kind"), F.col("value").alias("b"))
    return T.pooled([a, b]).groupBy("kind").agg(F.count("*").alias("n"), F.count("a").alias("a"), F.count("b").alias("b"))


@query("select row_id, round(14.7 * tolerance_pct / 10, 6) as afr, round((14.7 * tolerance_pct / 10) / 14.7, 6) as lam, round(tolerance_pct / (1 + tolerance_pct), 6) as flow from e2_answers")
def scl33_34_fuel(spark, d):
    """AFR and lambda; a trim as a fraction turned into a flow correction."""
    lam = F.col("tolerance_pct") / 10
    return table(spark, d, "e2_answers").select("row_id", F.round(14.7 * F.col("tolerance_pct") / 10, 6).alias("afr"), F.round(lam, 6).alias("lam"), F.round(F.col("tolerance_pct") / (1 + F.col("tolerance_pct")), 6).alias("flow"))


_HOLDS = """holds as (select rig, gpu, date_trunc('hour', ts) as hold, avg(power_w) as maf, avg(fan1_rpm) as rpm, avg(vram_c) / 6 as volts, avg(util_pct) - 95 as trim from memtest_soak where ts is not null and rig is not null and gpu is not null group by all),
 obs as (select h.*, maf / first_maf as air_scale, case when abs(volts - first_volts) <= 0.6 then case when rpm <= 1000 then 100.0 when rpm <= 2500 then 100 + (rpm - 1000) / 1500 * 250 when rpm is not null then 350.0 end end as nominal
  from holds h join (select rig, gpu, min_by(maf, hold) as first_maf, min_by(volts, hold) as first_volts from holds group by all) using (rig, gpu) where first_maf > 0)"""


def observed(spark: SparkSession, d: str) -> DataFrame:
    """Hours as holds, power as airflow."""
    soak = table(spark, d, "memtest_soak").dropna(subset=["ts", "rig", "gpu"])
    holds = soak.groupBy("rig", "gpu", F.date_trunc("hour", "ts").alias("hold")).agg(F.avg("power_w").alias("maf"), F.avg("fan1_rpm").alias("rpm"), (F.avg("vram_c") / 6).alias("volts"), (F.avg("util_pct") - 95).alias("trim"))
    return T.observations(holds, ["rig", "gpu"], "hold", ([1000.0, 2500.0], [100.0, 350.0]))


@query(f"with {_HOLDS} select rig, gpu, hold, round(air_scale, 6) as air_scale, round(nominal, 4) as nominal, round(trim / 100, 6) as trim_fraction from obs")
def agg05_observations(spark, d):
    """AGG-05: air scale, charging test and nominal airflow of each hold."""
    return observed(spark, d).select("rig", "gpu", F.col("hold").cast("timestamp_ntz").alias("hold"), F.round("air_scale", 6).alias("air_scale"), F.round("nominal", 4).alias("nominal"), F.round("trim_fraction", 6).alias("trim_fraction"))


@query(f"with {_HOLDS} select rig, gpu, round(avg(case when maf is not null and nominal <> 0 then maf / nominal end), 6) as ratio, coalesce(bool_and(case when maf is not null and nominal <> 0 then volts > 10 end), true) as validated from obs group by all")
def est02_airflow_ratio(spark, d):
    """EST-02: read over nominal airflow, and the vote on the baseline."""
    return T.airflow_ratio(observed(spark, d).withColumn("sound", F.col("volts") > 10), ["rig", "gpu"], "sound").select("rig", "gpu", F.round("ratio", 6).alias("ratio"), "validated")
