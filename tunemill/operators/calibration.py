"""Bounded edits of calibration tables in long form, an audit trail beside them, and the proposals that make them.

An edit is a row (proposal, kind, col, cur, base, stock, new, count, load). Gates look at a whole proposal and refuse it;
modifiers bound single cells, in an order that is part of their meaning: ceiling, timing, rate, envelope, sensor, floor.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bounds of each modifier.
RATE, ENVELOPE, SENSOR, SENSOR_COUNT, FLOOR_AFR, BOOST_LOAD = 0.03, 0.10, 0.40, 20, 11.5, 0.60
TIMING_STEP, TIMING_TOTAL, TIMING_FLOOR, GAP = 6.0, 30.0, 0.0, 1e-5
#: Stoichiometric ratio of gasoline, the trim that boost edits wait for, and tolerances.
STOICH, BOOST_TRIM, ZERO, SAME = 14.7, 0.05, 1e-9, 1e-12

def _n() -> Column:
    return F.col("new")


def _c() -> Column:
    return F.col("cur")


def _let(value: Column, then) -> Column:
    """then(value), with value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


# Each modifier: the kinds it bounds, and the bounded value of n.


def ceiling(n: Column) -> Column:
    return F.least(n, F.col("ceiling"))


def timing(n: Column) -> Column:
    """Only retard; not below base less the total, nor the absolute floor; one step at a time but where nothing was driven
    and the target is at least the lesser of ceiling and current value."""
    v = F.greatest(F.least(n, _c()), F.col("base") - TIMING_TOTAL, F.lit(TIMING_FLOOR))
    free = lambda x: (F.abs(x - _c()) > TIMING_STEP) & (F.col("count") == 0) & (x >= F.least(F.col("ceiling"), _c()))
    return _let(v, lambda x: F.when(free(x), x).otherwise(F.greatest(x, _c() - TIMING_STEP)))


def rate(n: Column) -> Column:
    bounded = lambda d: _c() + F.signum(d) * F.least(F.abs(d), RATE * F.abs(_c()))
    return F.when(F.abs(_c()) < 1e-9, _c()).otherwise(_let(n - _c(), bounded))


def envelope(n: Column) -> Column:
    a, b = F.col("stock") * (1 - ENVELOPE), F.col("stock") * (1 + ENVELOPE)
    return F.least(F.greatest(a, b), F.greatest(F.least(a, b), n))


def sensor(n: Column) -> Column:
    """Without evidence, and without leave to extrapolate, nothing moves; else by at most SENSOR of the current value and of
    the base, where these are there and not 0."""

    def bounded(x: Column, of: Column) -> Column:
        a, b = of * (1 - SENSOR), of * (1 + SENSOR)
        usable = of.isNotNull() & ~F.isnan(of) & (F.abs(of) >= ZERO)
        return F.struct(F.when(usable, F.least(a, b)).otherwise(F.lit(-1e308)).alias("lo"), F.when(usable, F.greatest(a, b)).otherwise(F.lit(1e308)).alias("hi"))

    own, far = bounded(n, _c()), bounded(n, F.col("base"))
    within = F.least(F.least(own["hi"], far["hi"]), F.greatest(F.greatest(own["lo"], far["lo"]), n))
    moves = _c().isNotNull() & ~F.isnan(_c()) & (F.abs(_c()) >= ZERO)
    return F.when((F.col("count") < SENSOR_COUNT) & ~F.col("may_extrapolate"), F.coalesce(F.nanvl(_c(), n), n)).when(moves, within).otherwise(n)


def floor(n: Column) -> Column:
    """At boost no target of a mixture is leaner than the floor, as a ratio or as lambda by the table's unit."""
    unit = F.upper(F.coalesce("unit", F.lit("AFR")))
    least = F.when(unit == "LAMBDA", F.col("afr_floor") / STOICH).when(unit == "AFR", F.col("afr_floor"))
    asked = F.when(unit == "LAMBDA", n * STOICH).when(unit == "AFR", n)
    return F.when((F.col("load") >= BOOST_LOAD) & (asked > F.col("afr_floor")), least).otherwise(n)


def may_extrapolate(edits: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """edits(keys..., col, new, base, enabled) with may_extrapolate: may a cell without evidence move?

    cells(keys..., col, cur, base, count) are the whole tables. A human enabled it; the cell is above every one with evidence;
    and its ratio to the base is no more than the greatest that evidence has shown.
    """
    proven = F.col("count") >= SENSOR_COUNT
    known = cells.groupBy(*keys).agg(F.max(F.when(proven, F.col("col"))).alias("_last"), F.max(F.when(proven & (F.col("base") > 0), F.col("cur") / F.col("base"))).alias("_most"))
    rows = edits.join(known, keys, "left")
    allowed = F.col("enabled") & (F.col("col") > F.col("_last")) & (F.col("base") > 0) & (_n() / F.col("base") <= F.col("_most") + 1e-9)
    return rows.withColumn("may_extrapolate", F.coalesce(allowed, F.lit(False))).drop("_last", "_most")


#: Kinds of edits that a modifier bounds; the floor goes by what the table holds.
KINDS = {ceiling: ["timing"], timing: ["timing"], rate: ["fuel"], envelope: ["fuel"], sensor: ["sensor"], floor: ["fuel", "mixture"]}


def monotone(df: DataFrame, keys: list[str]) -> DataFrame:
    """Edited sensor curves made strictly rising from left to right: a cell that can't lie between its neighbours keeps its
    current value. A curve has few cells, so its fold runs over one array."""
    cells = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("col", "cur", "new"))).alias("_a"))
    gap = lambda v: F.greatest(F.lit(1e-9), F.abs(v) * GAP)
    low = F.lit(-1e308)

    def step(acc: Column, i: Column) -> Column:
        cell = F.element_at("_a", i)
        after = F.when(i < F.size("_a"), F.try_element_at(F.col("_a"), i + 1)["cur"])
        lo = F.when(acc["prev"] > low, acc["prev"] + gap(acc["prev"])).otherwise(low)
        hi = F.coalesce(after - gap(after), F.lit(1e308))
        v = F.when(lo > hi, cell["cur"]).otherwise(F.least(hi, F.greatest(lo, cell["new"])))
        return F.struct(v.alias("prev"), F.concat(acc["out"], F.array(F.struct(cell["col"].alias("col"), v.alias("v")))).alias("out"))

    kind = df.schema["col"].dataType.simpleString()
    start = F.struct(low.alias("prev"), F.array().cast(f"array<struct<col:{kind},v:double>>").alias("out"))
    folded = cells.select(*keys, F.explode(F.aggregate(F.sequence(F.lit(1), F.size("_a")), start, step)["out"]).alias("_x"))
    out = folded.select(*keys, F.col("_x.col").alias("col"), F.col("_x.v").alias("_v"))
    return df.join(out, [*keys, "col"], "left").withColumn("new", F.coalesce("_v", "new")).drop("_v")


MODIFIERS = (ceiling, timing, rate, envelope, sensor, floor)


def _complete(df: DataFrame) -> DataFrame:
    """df with the columns it lacks: no leave to extrapolate, no unit (a ratio then), no second diagnosis, nothing on boost."""
    known = {"may_extrapolate": F.lit(False), "unit": F.lit(None).cast("string"), "table_id": F.col("kind"), "diagnosed": F.lit(False), "identifiable": F.lit(None).cast("boolean"), "knob": F.lit(None).cast("string"), "max_trim": F.lit(None).cast("double"), "wideband_tracking": F.lit(None).cast("boolean"), "boost_verified": F.lit(None).cast("boolean")}
    return df.withColumns({k: v for k, v in known.items() if k not in df.columns})


def gates(df: DataFrame, proposal: str) -> DataFrame:
    """(proposal, refused): the first gate that refuses a proposal, or null.

    knock: knock while not every edit only takes away. diagnosis: a second diagnosis (diagnosed) that can't tell, that names
    no table, or that names another than all that is materially changed; without one the gate is inert. fuel first: timing
    or boost before trims converged. transient: not steady. boost: trims over BOOST_TRIM, or the wideband's tracking or boost
    control not confirmed; where edits don't say, trims that converged and a steady state stand for it.
    """
    rows = _complete(df)
    retard = F.bool_and(_n() <= _c() + 1e-9)
    has = lambda k: F.bool_or(F.col("kind") == k)
    knock, converged, steady = F.bool_or("knock_active"), F.bool_and("converged"), F.bool_and("steady")
    moved = F.collect_set(F.when(F.abs(_n() - _c()) > F.greatest(1e-9 * F.greatest(F.abs(_n()), F.abs(_c())), F.lit(SAME)), F.col("table_id")))
    diagnosed = F.bool_or("diagnosed") & (F.size(moved) > 0)
    knob = F.max("knob")
    doubt = F.when(~F.coalesce(F.bool_and("identifiable"), F.lit(False)), "diagnosis: not identifiable").when(knob.isNull(), "diagnosis: no table").when(~moved.eqNullSafe(F.array(knob)), "diagnosis: another table")
    ready = F.coalesce((F.abs(F.max(F.abs(F.col("max_trim")))) <= BOOST_TRIM) & F.bool_and("wideband_tracking") & F.bool_and("boost_verified"), converged & steady)
    refused = F.when(knock & ~retard, "knock").when(diagnosed & doubt.isNotNull(), doubt).when((has("timing") | has("boost")) & ~converged, "fuel first").when(~steady, "transient").when(has("boost") & ~ready, "boost")
    return rows.groupBy(proposal).agg(refused.alias("refused"))


def _step(m):
    def of(s: Column) -> Column:
        value = F.when(F.col("kind").isin(*KINDS[m]), m(s["v"])).otherwise(s["v"])

        def after(v: Column) -> Column:
            note = F.struct(F.lit(m.__name__).alias("clamp"), s["v"].alias("asked"), v.alias("given"))
            return F.struct(v.alias("v"), F.when(v.eqNullSafe(s["v"]), s["audit"]).otherwise(F.concat(s["audit"], F.array(note))).alias("audit"))

        return _let(value, after)

    return of


def clamped(df: DataFrame, proposal: str | None = None, modifiers=MODIFIERS) -> DataFrame:
    """df with the bounded new values and audit; the edits of refused proposals keep their current values.

    The modifiers are one expression in which every step's value is bound once, so the chain stays linear in size.
    """
    nothing = F.array().cast("array<struct<clamp:string,asked:double,given:double>>")
    state = F.struct(_n().cast("double").alias("v"), nothing.alias("audit"))
    for m in modifiers:
        state = _let(state, _step(m))
    rows = _complete(df).withColumn("_tm_state", state)
    if proposal:
        rows = rows.join(gates(df, proposal), proposal, "left")
        given = F.when(F.col("refused").isNotNull(), _c()).otherwise(F.col("_tm_state.v"))
    else:
        given = F.col("_tm_state.v")
    return rows.withColumn("audit", F.col("_tm_state.audit")).withColumn("new", given).drop("_tm_state")


def pi_step(error, total, kp: float = 0.5, ki: float = 0.05, damping: float = 0.7, limit: float = RATE):
    """(step, total) of numbers or arrays: what `controller` is for columns."""
    raw = damping * (kp * error + ki * (total + error))
    step = np.clip(raw, -limit, limit)
    return step, np.where(step == raw, total + error, total)


def controller(error: Column, total: Column, kp: float = 0.5, ki: float = 0.05, damping: float = 0.7, limit: float = RATE) -> Column:
    """Struct(step, total): one proportional-integral step; the integral stands still while the step saturates."""
    raw = damping * (kp * error + ki * (total + error))
    step = F.least(F.lit(limit), F.greatest(F.lit(-limit), raw))
    return F.struct(step.alias("step"), F.when(step == raw, total + error).otherwise(total).alias("total"))


#: The knobs of an idle correction, in the order that decides equal weights.
KNOBS = ("latency", "flow", "maf")


def idle_correction(rows: DataFrame) -> DataFrame:
    """rows(trim_pct, and for each knob: its value, w_ its weight, t_ its integral) with knob, step, and new_ and next_ of each.

    The knob of the greatest weight owns the step's integral. Its step is shared by weights: flow is divided, the others
    multiplied.
    """
    best = F.greatest(*(F.col(f"w_{k}") for k in KNOBS))
    knob = F.coalesce(*(F.when(F.col(f"w_{k}") == best, F.lit(k)) for k in KNOBS))
    total = F.coalesce(*(F.when(F.col("knob") == k, F.col(f"t_{k}")) for k in KNOBS))
    out = rows.withColumn("knob", knob).withColumn("_s", controller(F.col("trim_pct") / 100, total)).withColumn("step", F.col("_s.step"))
    for k in KNOBS:
        factor = 1 + F.col("step") * F.col(f"w_{k}")
        out = out.withColumn(f"new_{k}", F.col(k) / factor if k == "flow" else F.col(k) * factor)
        out = out.withColumn(f"next_{k}", F.when(F.col("knob") == k, F.col("_s.total")).otherwise(F.col(f"t_{k}")))
    return out.drop("_s")


def maf_correction(cells: DataFrame, keys: list[str], damping: float = 0.7, deadband: float = 0.02, extrapolate: bool = False, plateau: int = 3) -> DataFrame:
    """The edits (keys..., xi, cur, new, kind) of curves cells(keys..., xi, cur, trim as percent or null, count, base).

    Measured cells anchor the correction, small ones as 0; between anchors it is linear, beyond them nothing, and all of it is
    damped. With extrapolate, cells above the last anchor go to the base times the plateau where that is more than they have:
    the mean ratio to the base, weighted by counts, that the last `plateau` anchors would have, undamped. A curve is short.
    """
    from tunemill.operators.telemetry import interpolated

    frac = F.col("trim") / 100
    rows = cells.withColumn("anchor", F.when(frac.isNotNull(), F.when(F.abs(frac) < deadband, 0.0).otherwise(frac)))
    rows = interpolated(rows, keys, "xi", "anchor").withColumn("new", _c() * (1 + damping * F.col("filled")))
    rows = rows.withColumn("kind", F.when(F.col("filled") != 0, "measured"))
    if extrapolate:
        usable = frac.isNotNull() & (F.abs(F.col("base")) > 0)
        top = F.row_number().over(Window.partitionBy(*keys).orderBy(F.when(usable, 0).otherwise(1), F.desc("xi")))
        held = rows.withColumn("_top", top).where(usable & (F.col("_top") <= plateau))
        weight = F.greatest(F.coalesce(F.col("count").cast("double"), F.lit(0.0)), F.lit(1.0))
        ratio = held.groupBy(*keys).agg((F.sum(weight * _c() / F.col("base") * (1 + frac)) / F.sum(weight)).alias("_ratio"))
        last = rows.where("anchor is not null").groupBy(*keys).agg(F.max("xi").alias("_last"))
        rows = rows.join(last, keys, "left").join(ratio, keys, "left")
        held_up = F.col("base") * F.coalesce("_ratio", F.lit(1.0))
        above = (F.col("xi") > F.col("_last")) & (F.col("base") > 0) & (held_up > _c())
        rows = rows.withColumn("new", F.when(above, held_up).otherwise(_n())).withColumn("kind", F.when(above, "extrapolated").otherwise(F.col("kind")))
    return rows.where("kind is not null").select(*keys, "xi", "cur", "new", "kind")


def timing_retard(cells: DataFrame, least: float = 0.25) -> DataFrame:
    """cells(cur, ceiling, knock, fine, deficit, confident) whose evidence of knock lowers the value, with new."""
    take = lambda c: F.greatest(F.lit(0.0), -F.coalesce(F.col(c), F.lit(0.0)))
    measured = take("knock") + take("fine")
    evidence = F.when(F.col("confident"), F.when(measured < least, 0.0).otherwise(measured) + F.coalesce("deficit", F.lit(0.0))).otherwise(0.0)
    return cells.withColumn("new", F.least(_c() - evidence, F.col("ceiling"))).where(_n() < _c())


def iam_deficit(iam: str, reference: float, authority: Column) -> Column:
    """An aggregate: how far the least multiplier is under its reference, in degrees of its authority."""
    return F.coalesce(F.greatest(F.lit(0.0), reference - F.min(iam)), F.lit(0.0)) * authority


def edited(cells: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """A copy of cells(keys..., value) with the values of edits(keys..., new)."""
    return cells.join(edits.select(*keys, "new"), keys, "left").withColumn("value", F.coalesce("new", "value")).drop("new")


def aligned(source: DataFrame, keys: list[str], xs: list[float], ys: list[float], to_x: list[float], to_y: list[float]) -> DataFrame:
    """A grid of source(keys..., xi, yi, value) resampled on other axes by nearest breaks."""
    near = lambda v, axis: min(range(len(axis)), key=lambda i: (abs(axis[i] - v), i))
    targets = [(i, j, near(x, xs), near(y, ys)) for i, x in enumerate(to_x) for j, y in enumerate(to_y)]
    pick = source.sparkSession.createDataFrame(targets, "tx int, ty int, xi int, yi int")
    return source.join(F.broadcast(pick), ["xi", "yi"]).select(*keys, F.col("tx").alias("xi"), F.col("ty").alias("yi"), "value")


def report(clamps: DataFrame, proposal: str) -> DataFrame:
    """(proposal, json): how many cells each clamp touched, as a record."""
    each = clamps.select(proposal, F.explode("audit").alias("a")).groupBy(proposal, F.col("a.clamp").alias("clamp")).agg(F.count("*").alias("cells"), F.round(F.max(F.abs(F.col("a.asked") - F.col("a.given"))), 6).alias("most"))
    return each.groupBy(proposal).agg(F.to_json(F.array_sort(F.collect_list(F.struct("clamp", "cells", "most")))).alias("json"))


