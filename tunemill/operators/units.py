"""Measurements in a common unit, and unit changes within a history of bare numbers.

`unit_marks` finds in which rows a history changes its unit, from bare numbers: an exact penalised changepoint search on
log values gives the levels of each history, and a level that is off by a known factor between two units of the quantity
marks its rows as written in the other unit. `agreeing` takes the rows so marked, reverses the change, and keeps those that
state that unit and agree with what is expected. `measurements` converts every value by the unit that it states.
`unit_shifts` gives the segments themselves and the unit changes between them, of histories that need state no unit.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunemill.functions.quantities import UNITS, Quantity, first_unit, read
from tunemill.operators import ordered as O
from tunemill.session import settle, small

_NAMES = ["row_id", "quantity", "common_unit", "unit", "value_lo", "value_hi", "expected_unit", "expected_lo", "expected_hi", "agrees"]
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]
_SCHEMA = "row_id bigint, quantity string, common_unit string, unit string, value_lo double, value_hi double, expected_unit string, expected_lo double, expected_hi double, agrees boolean"


def _convert(q: Quantity | None, unit: str | None, target: str | None) -> tuple[float | None, float | None]:
    if q is None or unit is None or target is None or UNITS[unit][0] != UNITS[target][0]:
        return None, None
    lo, hi = q.common(unit)
    _, factor, offset, _ = UNITS[target]
    return (lo - offset) / factor, (hi - offset) / factor


def _common(unit_target: DataFrame) -> dict[str, str]:
    """The common unit of each quantity that the library knows: a row for each, thirteen at most."""
    known = unit_target.where(F.col("quantity").isin(*{q for q, *_ in UNITS.values()})).groupBy("quantity").agg(F.min("common_unit").alias("common_unit"))
    return {r.quantity: u for r in known.collect() if (u := first_unit(r.common_unit))}


def judge(answer: str | None, expected: str | None, unit_field: str | None, tolerance: float | None, common: dict[str, str]) -> tuple:
    """One row of measurements, without its id."""
    return _judged(read(answer), read(expected), unit_field, tolerance, common)


def _judged(a: Quantity | None, e: Quantity | None, unit_field: str | None, tolerance: float | None, common: dict[str, str]) -> tuple:
    e_unit = (e.unit if e else None) or first_unit(unit_field)
    a_unit = (a.unit or e_unit) if a else None
    quantity = UNITS[e_unit][0] if e_unit else (UNITS[a_unit][0] if a_unit else None)
    target = common.get(quantity)
    a_lo, a_hi = _convert(a, a_unit, target)
    e_lo, e_hi = _convert(e, e_unit, target)
    agrees = None
    if a_lo is not None and e_lo is not None and tolerance is not None:
        agrees = all(abs(x - y) <= abs(y) * tolerance / 100 * (1 + 1e-9) for x, y in ((a_lo, e_lo), (a_hi, e_hi)))
    return quantity, target, a_unit, a_lo, a_hi, e_unit, e_lo, e_hi, agrees


def measurements(answers: DataFrame, unit_target: DataFrame) -> DataFrame:
    """A row for each row of answers(row_id, answer.value, expected_value, unit, tolerance_pct).

    Values and expectations in the common unit of their quantity, ranges as lo and hi (equal for a figure); null where a
    text has no figure, no unit is known, or the answer's unit is of another quantity. agrees is null unless both sides
    and the tolerance are there. Both ends of a range must agree; a figure is a range without extent. Repeated rows come
    out repeated. Quantities that unit_target doesn't name have no common unit.
    """
    common = _common(unit_target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("row_id", "_answer", "expected_value", "unit", "tolerance_pct")]
            rows = [(i, *judge(a, e, u, t, common)) for i, a, e, u, t in zip(*columns)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)] if rows else [pa.array([], t) for t in _TYPES], names=_NAMES)

    rows = answers.select("row_id", F.col("answer")["value"].alias("_answer"), "expected_value", "unit", F.col("tolerance_pct").cast("double").alias("tolerance_pct"))
    return rows.mapInArrow(run, _SCHEMA)


def figures(answers: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., quantity, unit, figure) of each row whose answer has a figure: the lower end as written, not converted.

    unit is that the answer states, or else the expected one; quantity that of the expected unit, or else of the answer's.
    """
    names = [*keep, "_answer", "expected_value", "unit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for answer, expected, field in zip(*(batch.column(n).to_pylist() for n in names[-3:])):
                a, e = read(answer), read(expected)
                e_unit = (e.unit if e else None) or first_unit(field)
                unit = (a.unit or e_unit) if a else None
                first = e_unit or unit
                rows.append((UNITS[first][0] if first else None, unit, a.lo if a else None))
            made = [pa.array([row[i] for row in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *made], names=[*keep, "quantity", "unit", "figure"])

    rows = answers.select(*keep, F.col("answer")["value"].alias("_answer"), "expected_value", "unit")
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in answers.select(*keep).schema)
    return rows.mapInArrow(run, f"{typed}, quantity string, unit string, figure double").where(F.col("figure").isNotNull())


#: The penalty of a segment of log values. Neighbours over sqrt(8 * penalty) apart are in different segments of every
#: optimal segmentation: of two in one segment, one would be over sqrt(2 * penalty) from its mean, and a segment of its own
#: would cost less. Histories are cut there, and the search over each stretch is that over the whole.
PENALTY = 0.0005


def certain_jump(penalty: float) -> float:
    return math.sqrt(8 * penalty)


@functools.lru_cache(maxsize=10_000)
def known_levels(unit: str, expected: float) -> list[tuple[str, float]]:
    """(unit, log of the factor) of an expected figure written in each other unit of its quantity, signs apart."""
    kind, factor, offset, _ = UNITS[unit]
    out = []
    for u, (q, f, o, _) in UNITS.items():
        if q == kind and u != unit:
            there = ((expected * factor + offset) - o) / f
            if there and expected:
                out.append((u, math.log(abs(there / expected))))
    return out


_BARE = [("row_id", pa.int64()), ("copy", pa.int64()), ("probe_id", pa.string()), ("at", pa.int64()), ("stated", pa.string()), ("expected_unit", pa.string()), ("agrees", pa.bool_()), ("slack", pa.float64()), ("ends", pa.int32()), ("no", pa.int32()), ("side", pa.int32()), ("expected", pa.float64()), ("x", pa.float64())]


def _bare(common: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, copy, probe, at, answer, expected, field, tolerance in zip(*(c.to_pylist() for c in batch.columns)):
                a = read(answer)
                e = read(expected) if a else None
                unit = ((e.unit if e else None) or first_unit(field)) if a else None
                if e is None or unit is None:
                    continue
                agrees = _judged(a, e, field, tolerance, common)[-1]
                pairs = [(a.lo, e.lo)] + ([(a.hi, e.hi)] if a.lo != a.hi or e.lo != e.hi else [])
                for no, (x, y) in enumerate(pairs):
                    side = int(math.copysign(1, x) * math.copysign(1, y)) if x and y else 0
                    rows.append((i, copy, probe, at, a.unit, unit, agrees, math.log1p((tolerance or 0) / 100) + 1e-9, len(pairs), no, side, y, math.log(abs(x / y)) if side else 0.0))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(_BARE)], names=[n for n, _ in _BARE])

    return run


def _levels(penalty: float, keys: list[str]):
    """Rows in the order of (keys, at) with the level of their segment and the units that the level fits.

    A task holds the rows of one stretch, between two certain cuts.
    """
    jump = certain_jump(penalty)

    def fits(r: tuple, level: float) -> list[str]:
        expected, unit, x, slack, side = r
        if not side:
            return sorted(u for u, (q, *_) in UNITS.items() if q == UNITS[unit][0] and u != unit)
        off = slack + abs(x - level)
        return sorted(u for u, known in known_levels(unit, expected) if abs(known - level) <= off)

    def close(held: list[tuple]) -> list[tuple[float, list[str]]]:
        if len(held) == 1:
            return [(held[0][2], fits(held[0], held[0][2]))]
        search, out = Search(penalty), []
        for r in held:
            search.add(r[2])
        for first, n, level, *_ in search.segments():
            out += [(level, fits(r, level)) for r in held[first : first + n]]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, frames = None, [], []
        for batch in batches:
            made: list[tuple[float, list[str]]] = []
            for k, r in zip(zip(*(batch[n].tolist() for n in keys)), zip(*(batch[n].tolist() for n in ("expected", "expected_unit", "x", "slack", "side")))):
                if held and (k != key or abs(r[2] - held[-1][2]) > jump):
                    made += close(held)
                    held = []
                key = k
                held.append(r)
            frames.append(batch)
            if made:  # rows of stretches that have ended; those of the last one wait
                rows = pd.concat(frames)
                yield rows.iloc[: len(made)].assign(level=[m[0] for m in made], marks=[m[1] for m in made])
                frames = [rows.iloc[len(made) :]]
        if held:
            made = close(held)
            yield pd.concat(frames).assign(level=[m[0] for m in made], marks=[m[1] for m in made])

    return run


def unit_marks(answers: DataFrame, unit_target: DataFrame, penalty: float = PENALTY, hot_rows: int = 100_000) -> DataFrame:
    """For each end of each answer: the level of its history there, and the units whose factor that level shows.

    (row_id, copy, no, ends, stated, expected_unit, agrees, x, level, marks). The history of a probe is the log of its
    figures as written, each relative to the figure expected, in the order of created_at and row_id; lower and upper ends,
    and figures of the other sign than expected, are histories of their own. The search sees no unit. A unit is marked if
    its factor is within the row's tolerance and its distance from the level. A zero has no log: it is marked with every
    other unit, and what follows decides. Rows without a figure, without an expected one, or without any unit have no marks
    and don't come out. copy tells repeated rows apart. stated and agrees are passed on for `agreeing`.

    The history of a probe of over hot_rows rows is cut at certain changepoints first, so that its stretches are spread over the workers.
    """
    common = _common(unit_target)
    rows = answers.select("row_id", F.monotonically_increasing_id().alias("copy"), F.col("probe_id").cast("string").alias("probe_id"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"), F.col("answer")["value"].alias("_answer"), "expected_value", "unit", F.col("tolerance_pct").cast("double").alias("tolerance_pct"))
    kinds = {pa.int64(): "bigint", pa.string(): "string", pa.bool_(): "boolean", pa.float64(): "double", pa.int32(): "int"}
    schema = ", ".join(f"{n} {kinds[t]}" for n, t in _BARE)
    bare = rows.mapInArrow(_bare(common), schema)
    keys, order = ["probe_id", "no", "side"], ["at", "row_id", "copy"]
    hot = settle(rows.groupBy(F.col("probe_id").alias("_hot")).count().where(F.col("count") > hot_rows))
    if hot.limit(1).count():
        bare = settle(bare)
        is_hot = bare["probe_id"].eqNullSafe(hot["_hot"])
        cool = bare.join(hot, is_hot, "left_anti").withColumn("stretch", F.lit(0).cast("bigint"))
        paced = O.paced(bare.join(small(hot), is_hot, "left_semi"), keys, "at", "_pace", hot_rows)
        near = O.with_neighbours(paced, keys, order, F.col("_pace"), ["x"])
        jump = F.when(F.col("is_first") | (F.abs(F.col("x") - F.col("prev_x")) > certain_jump(penalty)), 1).otherwise(0)
        warm = O.running_total(near.withColumn("_jump", jump), keys, order, F.col("_pace"), F.col("_jump"), "stretch").select(*bare.columns, "stretch")
        bare = cool.unionByName(warm)
    else:
        bare = bare.withColumn("stretch", F.lit(0).cast("bigint"))
    keys = [*keys, "stretch"]
    # Keys are compared in Python: a null becomes an empty string behind a flag of its own.
    flagged = bare.withColumn("_none", F.col("probe_id").isNull().cast("int")).fillna("", ["probe_id"])
    ordered = flagged.repartition("_none", *keys).sortWithinPartitions("_none", *keys, *order)
    done = ordered.mapInPandas(_levels(penalty, ["_none", *keys]), schema + ", stretch bigint, _none int, level double, marks array<string>")
    return done.select("row_id", "copy", "no", "ends", "stated", "expected_unit", "agrees", "x", "level", "marks")


def agreeing(marked: DataFrame) -> DataFrame:
    """(row_id) of the rows whose history marks them as written in another unit than expected, which state just that unit,
    and whose value, converted back, agrees with the expected one. All ends of a range must be marked so."""
    sure = marked.where(F.col("agrees") & (F.col("stated") != F.col("expected_unit")) & F.array_contains("marks", F.col("stated")))
    return sure.groupBy("row_id", "copy").agg(F.count("*").alias("_n"), F.max("ends").alias("_ends")).where(F.col("_n") == F.col("_ends")).select("row_id")


class Search:
    """Exact penalised changepoint search over values that come one by one, in memory that grows with the segments found.

    The least cost of the values so far as a function of the last level is kept as pieces (lo, hi, start), each with the
    start that is best for levels between lo and hi. A start without a piece can never be optimal again, whatever comes.
    A start is [start before, rows before it, their sum, mark of the row before, mark of its first row, counts, sum of
    squares, cost]; starts that no piece leads back to are freed.
    """

    def __init__(self, penalty: float):
        self.penalty, self.n, self.s, self.q, self.zero = penalty, 0, 0.0, 0.0, 0.0
        self.best: list = [None, 0, 0.0, None, None, {}, 0.0, -penalty]
        self.last, self.counts, self.pieces = self.best, {}, [(-math.inf, math.inf, self.best)]

    def add(self, x: float, mark=None, kind: tuple | None = None) -> None:
        """The next value; marks say where segments start and end, kinds are counted in each."""
        if not self.n:
            self.zero = x  # values are taken from the first one on, which keeps the sums short
        self.last[4] = mark
        x -= self.zero
        self.n, self.s, self.q = self.n + 1, self.s + x, self.q + x * x
        if kind is not None:
            self.counts = self.counts | {kind: self.counts.get(kind, 0) + 1}
        fits, known, least, back = [], {}, math.inf, None
        for lo, hi, start in self.pieces:
            if id(start) not in known:
                k, s = self.n - start[1], self.s - start[2]
                known[id(start)] = start[7] + max(0.0, self.q - start[6] - s * s / k), s / k, k
            cost, mean, k = known[id(start)]
            fits.append((lo, hi, start, cost, mean, k))
            if cost < least or (cost == least and start[1] < back[1]):
                least, back = cost, start
        now = [back, self.n, self.s, mark, None, self.counts, self.q, least + self.penalty]
        limit, pieces = least + self.penalty, []

        def put(lo: float, hi: float, start: list) -> None:
            if lo < hi:
                if pieces and pieces[-1][2] is start:
                    lo = pieces.pop()[0]
                pieces.append((lo, hi, start))

        for lo, hi, start, cost, mean, k in fits:
            r = math.sqrt((limit - cost) / k) if cost <= limit else -1.0
            left, right = max(lo, mean - r), min(hi, mean + r)
            if r < 0 or left >= right:
                put(lo, hi, now)
            else:
                put(lo, left, now)
                put(left, right, start)
                put(right, hi, now)
        self.pieces, self.best, self.last = pieces, now, now

    def segments(self) -> list[tuple]:
        """(first row, rows, mean, mark of the first, mark of the last, counts of kinds) of each segment so far."""
        out, end = [], self.best
        while end[0] is not None:
            start = end[0]
            n = end[1] - start[1]
            kinds = {k: c - start[5].get(k, 0) for k, c in end[5].items() if c > start[5].get(k, 0)}
            out.append((start[1], n, self.zero + (end[2] - start[2]) / n, start[4], end[3], kinds))
            end = start
        return out[::-1]


def changepoints(x: np.ndarray, penalty: float) -> list[int]:
    """Starts of the segments of x that minimise squared deviations from segment means plus a penalty for each segment."""
    search = Search(penalty)
    for v in x.tolist():
        search.add(v)
    return [first for first, *_ in search.segments()]


def factors(quantity: str) -> dict[float, str]:
    """log of each factor between two units of a quantity -> `from>to`; none where scales have different zeros."""
    units = [(u, f, o) for u, (q, f, o, _) in UNITS.items() if q == quantity]
    return {float(np.log(f / g)): f"{u}>{v}" for u, f, o in units for v, g, p in units if u != v and o == p == 0 and f != g}


def reference(levels: np.ndarray, sizes: np.ndarray, tolerance: float) -> int:
    """The segment whose level, give or take the tolerance, most rows of the history have; of equals the largest, then the first."""
    order = np.argsort(levels, kind="stable")
    ranked, rows = levels[order], np.concatenate([[0], np.cumsum(sizes[order])])
    near = np.empty(len(levels), np.int64)
    near[order] = rows[np.searchsorted(ranked, ranked + tolerance, "right")] - rows[np.searchsorted(ranked, ranked - tolerance, "left")]
    return int(np.lexsort((np.arange(len(levels)), -sizes, -near))[0])


def unit_shifts(history: DataFrame, keys: list[str], order: str, value: str, quantity: str, penalty: float = 0.02, tolerance: float = 0.02, block_rows: int = 4_096, unit: str | None = None) -> DataFrame:
    """Segments of each history of positive numbers, and the unit change that a level shift between them shows.

    (keys..., segment, first, last, n, level, factor, change): level is the mean log value; factor that to the level which
    most rows of the history have, its reference; change the units it fits within `tolerance` of the log, else null. A
    history has the quantity that most of its rows name. It is searched whole, by one task, in the order of a timestamp
    and block_rows rows at a time: the search carries its state on, so blocks change no result and no task holds the rows
    of a history, only its segments. With a column `unit`, which the search doesn't see, come stated (the unit that most rows
    of the segment name), stated_change (from the reference's stated unit, null if that is the same) and confirmed: whether
    change and stated_change are both null or by the same factor; null where no unit is named. Values that are null, NaN or not positive, and rows with a null key or order, are left out.
    """
    fits = {q: [(v, n) for v, n in factors(q).items()] for q in {q for q, *_ in UNITS.values()}}
    rows = history.select(*keys, F.col(quantity).alias("_quantity"), F.unix_micros(F.col(order).cast("timestamp")).alias("_at"), F.col(value).cast("double").alias("_v"), (F.col(unit) if unit else F.lit(None)).cast("string").alias("_unit")).where((F.col("_v") > 0) & (F.col("_v") < float("inf"))).dropna(subset=[*keys, "_at"])
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "_at", "_v", "_quantity", "_unit")
    columns = [*keys, "segment", "first", "last", "n", "level", "factor", "change", "stated", "stated_change", "confirmed"]
    most = lambda counts: min(counts, key=lambda k: (-counts[k], k), default=None)

    def stated(kinds: dict) -> str | None:
        return most({u: n for u, n in sums(kinds, 1).items() if u in UNITS})

    def sums(kinds: dict, i: int) -> dict:
        out: dict = {}
        for k, n in kinds.items():
            if k[i] is not None:
                out[k[i]] = out.get(k[i], 0) + n
        return out

    def told(change: str | None, shift: float, was: str | None, now: str | None) -> tuple[str | None, bool | None]:
        if was is None or now is None:
            return None, None
        if was == now:
            return None, change is None
        same = UNITS[was][0] == UNITS[now][0] and UNITS[was][2] == UNITS[now][2] == 0
        return f"{was}>{now}", change is not None and same and abs(shift - math.log(UNITS[was][1] / UNITS[now][1])) <= tolerance

    def found(key: tuple, search: Search) -> list[tuple]:
        parts = search.segments()
        levels, sizes = np.array([p[2] for p in parts]), np.array([p[1] for p in parts])
        base = levels[reference(levels, sizes, tolerance)]
        known, kinds = fits.get(most(sums(search.counts, 0)), []), {}
        for _, _, level, _, _, some in parts:
            if abs(level - base) <= tolerance:
                kinds = {k: kinds.get(k, 0) + some.get(k, 0) for k in kinds | some}
        own, out = stated(kinds), []
        for i, (_, n, level, first, last, some) in enumerate(parts):
            shift = level - base
            near = min(known, key=lambda f: abs(f[0] - shift), default=None)
            change = near[1] if near and abs(shift) > tolerance and abs(near[0] - shift) <= tolerance else None
            now = stated(some)
            out.append((*key, i, first, last, n, level, float(np.exp(shift)), change, now, *told(change, shift, own, now)))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, search, out = None, None, []
        for batch in batches:
            for at in range(0, len(batch), block_rows):
                block = batch.iloc[at : at + block_rows]
                logs = np.log(block["_v"].to_numpy()).tolist()
                for *k, x, mark, q, u in zip(*(block[n] for n in keys), logs, block["_at"].tolist(), block["_quantity"], block["_unit"]):
                    if search is None or k != key:
                        if search:
                            out += found(tuple(key), search)
                        key, search = k, Search(penalty)
                    search.add(x, mark, (q if isinstance(q, str) else None, u if isinstance(u, str) else None))
                if out:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
        if search:
            yield pd.DataFrame(found(tuple(key), search), columns=columns)

    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in history.select(*keys).schema)
    shifts = ordered.mapInPandas(run, f"{typed}, segment int, first bigint, last bigint, n bigint, level double, factor double, change string, stated string, stated_change string, confirmed boolean")
    shifts = shifts if unit else shifts.drop("stated", "stated_change", "confirmed")
    return shifts.withColumn("first", F.timestamp_micros("first")).withColumn("last", F.timestamp_micros("last"))
