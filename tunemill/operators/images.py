"""Binary images and their tables: decode, encode, checksum, diff, definition merge and reconciliation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Storage types as big-endian numpy types, integer ranges, the checksum constant and block places.
STORAGE = {"uint8": ">u1", "int8": ">i1", "uint16": ">u2", "int16": ">i2", "uint32": ">u4", "int32": ">i4", "float": ">f4"}
CHECKSUM = 0x5AA5A55A
BLOCKS = {1_048_576: 0xFFB80, 524_288: 0x7FB80}


def scaled(expression: str, x: Column) -> Column:
    """A scaling expression such as `14.7/(1+x*.0078125)` over a column; anything but x, numbers and + - * / ( ) is refused."""
    if not re.fullmatch(r"[x0-9eE.+\-*/() \t]+", expression) or re.search(r"[eE](?![+\-]?\d)|(?<!\d)[eE](?<!\d\.[eE])", expression.replace("x", "1")):
        raise ValueError(f"not a scaling expression: {expression!r}")
    tokens = re.findall(r"x|(?:\d+\.?\d*|\.\d+)(?:[eE][+\-]?\d+)?|[+\-*/()]", expression)
    at = 0

    def atom() -> Column:
        nonlocal at
        t = tokens[at]
        at += 1
        if t == "(":
            inner = sum_()
            if at >= len(tokens) or tokens[at] != ")":
                raise ValueError(f"unbalanced: {expression!r}")
            at += 1
            return inner
        if t in "+-":
            return atom() if t == "+" else -atom()
        return x.cast("double") if t == "x" else F.lit(float(t))

    def product() -> Column:
        nonlocal at
        left = atom()
        while at < len(tokens) and tokens[at] in "*/":
            op, at = tokens[at], at + 1
            right = atom()
            left = left * right if op == "*" else F.try_divide(left, right)
        return left

    def sum_() -> Column:
        nonlocal at
        left = product()
        while at < len(tokens) and tokens[at] in "+-":
            op, at = tokens[at], at + 1
            right = product()
            left = left + right if op == "+" else left - right
        return left

    out = sum_()
    if at != len(tokens):
        raise ValueError(f"not a scaling expression: {expression!r}")
    return out


def integers(content: Column, address: Column, n: Column, storage: str) -> Column:
    """n big-endian integers at an address as an array; null if they don't fit in the content."""
    width = int(STORAGE[storage][2])
    signed = STORAGE[storage][1] == "i"
    one = lambda i: F.conv(F.hex(F.substring(content, address + i * width + 1, F.lit(width))), 16, 10).cast("bigint")
    fix = lambda v: F.when(v >= 2 ** (8 * width - 1), v - 2 ** (8 * width)).otherwise(v) if signed else v
    fits = (address >= 0) & (n >= 1) & (address + n * width <= F.length(content))
    return F.when(fits, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: fix(one(i))))


def floats():
    """(content, address, n) -> array of big-endian 32-bit floats."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<double>")
    def run(content: pd.Series, address: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if c is None or a < 0 or a + 4 * k > len(c) else np.frombuffer(c, ">f4", int(k), int(a)).astype(float) for c, a, k in zip(content, address, n)])

    return run


def big_endian(value: Column, storage: str) -> Column:
    """The bytes of an integer."""
    width = int(STORAGE[storage][2])
    wrapped = F.when(value < 0, value + 2 ** (8 * width)).otherwise(value).cast("bigint")
    return F.unhex(F.lpad(F.hex(wrapped), 2 * width, "0"))


def encoded(value: Column, to_raw: str, to_value: str, storage: str, no_greater: bool = False) -> Column:
    """Struct(raw, back, error): a value stored as an integer, rounded to even, what it reads back as and how far that is off.

    no_greater never stores more than the value, in the direction in which the decoded value falls. raw is null where the
    integer is out of the storage's range.
    """
    width, signed = int(STORAGE[storage][2]), STORAGE[storage][1] == "i"
    lo, hi = (-(2 ** (8 * width - 1)), 2 ** (8 * width - 1) - 1) if signed else (0, 2 ** (8 * width) - 1)
    raw = F.bround(scaled(to_raw, value))
    if no_greater:
        rising = F.signum(scaled(to_value, raw + 1) - scaled(to_value, raw))
        raw = F.when(scaled(to_value, raw) > value + 1e-12, raw - rising).otherwise(raw)
    kept = F.when(raw.between(lo, hi), raw)
    back = scaled(to_value, kept)
    return F.struct(kept.cast("bigint").alias("raw"), back.alias("back"), F.abs(back - value).alias("error"))


def step_size(to_raw: str, to_value: str, near: Column) -> Column:
    """What one storage step is worth near a value."""
    raw = scaled(to_raw, near)
    return F.abs(scaled(to_value, raw + 1) - scaled(to_value, raw))


def cell_address(base: Column, row: Column, col: Column, n_cols: Column, storage: str) -> Column:
    return base + (row * n_cols + col) * int(STORAGE[storage][2])


def word_sums(regions: DataFrame, keys: list[str], content: str, start: str, stop: str, piece: int = 4_096) -> DataFrame:
    """(keys..., total): the sum of 32-bit big-endian words of [start, stop], both included, modulo 2 ** 32.

    Regions are cut into pieces of words that are summed apart.
    """
    words = ((F.col(stop) - F.col(start) + 1) / 4).cast("bigint")
    parts = regions.withColumn("_p", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((words - 1) / piece))))
    first = F.col(start) + F.col("_p") * piece * 4
    n = F.least(F.lit(piece).cast("bigint"), words - F.col("_p") * piece)
    values = integers(F.col(content), first.cast("int"), n.cast("int"), "uint32")
    return parts.select(*keys, F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: (a + x) % 4_294_967_296).alias("_s")).groupBy(*keys).agg((F.sum("_s") % 4_294_967_296).alias("total"))


def checksum_records(data: bytes) -> list[tuple[int, int, int, int, int]]:
    """(offset, start, stop, stored, total) of the active records of an image; none where the layout is another."""
    base = BLOCKS.get(len(data))
    out = []
    while base is not None and base + 12 <= len(data):
        start, stop, stored = (int(v) for v in np.frombuffer(data, ">u4", 3, base))
        if start == 0xFFFFFFFF:
            break
        if start or stop:
            if not (start < stop < len(data)) or (stop - start + 1) % 4:
                return []
            total = int(np.frombuffer(data, ">u4", (stop - start + 1) // 4, start).sum(dtype=np.uint64) % 2**32)
            out.append((base, start, stop, stored, total))
        base += 12
    return out


def repaired(images: DataFrame) -> DataFrame:
    """(path, content, records, broken): images(path, content) with the stored words that the checksum asks for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                data, records = bytearray(content), checksum_records(bytes(content))
                bad = [r for r in records if (r[3] + r[4]) % 2**32 != CHECKSUM]
                for offset, *_, total in bad:
                    data[offset + 8 : offset + 12] = ((CHECKSUM - total) % 2**32).to_bytes(4, "big")
                rows.append((path, bytes(data), len(records), len(bad)))
            yield pd.DataFrame(rows, columns=["path", "content", "records", "broken"])

    return images.select("path", "content").mapInPandas(run, "path string, content binary, records int, broken int")


def byte_ranges(a: bytes, b: bytes) -> list[tuple[int, int]]:
    """[start, stop) of each run of differing bytes; what one has more is a run at the end."""
    n = min(len(a), len(b))
    differ = np.concatenate([np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n), np.ones(max(len(a), len(b)) - n, bool)])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], differ.astype(np.int8), [0]])))
    return [(int(s), int(e)) for s, e in zip(edge[::2], edge[1::2])]


def patched(image: bytes, writes: list[tuple[int, bytes]], allowed: list[tuple[int, int]]) -> bytes:
    """image with the bytes written; raises if anything outside the allowed ranges would change."""
    out = bytearray(image)
    for at, data in writes:
        if at < 0 or at + len(data) > len(out):
            raise ValueError("a write leaves the image")
        out[at : at + len(data)] = data
    for s, e in byte_ranges(image, bytes(out)):
        if not any(lo <= s and e <= hi for lo, hi in allowed):
            raise ValueError(f"bytes {s} to {e} may not change")
    return bytes(out)


def audit(candidate: bytes, base: bytes, allowed: list[tuple[int, int]]) -> dict[str, bool]:
    """Independent checks of an image before it is used, and whether all hold."""
    ranges = byte_ranges(base, candidate)
    checks = {
        "same_size": len(candidate) == len(base),
        "changed": bool(ranges),
        "only_allowed": all(any(lo <= s and e <= hi for lo, hi in allowed) for s, e in ranges),
        "checksums": all((r[3] + r[4]) % 2**32 == CHECKSUM for r in checksum_records(candidate)),
    }
    return checks | {"go": all(checks.values())}


def cell_diff(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float = 1e-12) -> DataFrame:
    """Cells of which only one side has a value, or whose values differ by more than the tolerance."""
    both = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys, "full_outer")
    return both.withColumn("kind", F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").when(F.abs(F.col("a") - F.col("b")) > tolerance, "changed")).where(F.col("kind").isNotNull())


def plausible(values: Column, lo: Column, hi: Column) -> Column:
    """Finite, strictly rising or falling, and within limits."""
    pairs = F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values)), lambda p, q: q - p)
    up, down = F.forall(pairs, lambda d: d > 0), F.forall(pairs, lambda d: d < 0)
    inside = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (v >= lo - 1e-9) & (v <= hi + 1e-9))
    return F.coalesce(inside, F.lit(False)) & ((F.size(values) < 2) | up | down)


def reconciled(reads: DataFrame, key: str, source: str, values: str, ok: str) -> DataFrame:
    """(key, values, sources, verdict): equal reads are one group; the only group, or the only plausible one, holds."""
    groups = reads.groupBy(key, values).agg(F.array_sort(F.collect_set(source)).alias("sources"), F.bool_or(ok).alias("_ok"))
    g = groups.groupBy(key).agg(F.count("*").alias("_n"), F.count_if("_ok").alias("_p"), F.max_by(F.struct(values, "sources"), F.struct(F.col("_ok").cast("int"), F.size("sources"), F.to_json("sources"))).alias("_x"))
    verdict = F.when(F.col("_n") == 1, "agree").when(F.col("_p") == 1, "one plausible").otherwise("ambiguous")
    return g.select(key, F.when(verdict != "ambiguous", F.col(f"_x.{values}")).alias(values), F.when(verdict != "ambiguous", F.col("_x.sources")).alias("sources"), verdict.alias("verdict"))


def voted(rows: DataFrame, key: str, address: str) -> DataFrame:
    """(key, address, votes, of, confidence): the address most siblings have; of equals the least."""
    votes = rows.where(F.col(address).isNotNull()).groupBy(key, address).agg(F.count("*").alias("n"))
    best = votes.groupBy(key).agg(F.max_by(F.struct(address, "n"), F.struct("n", -F.col(address))).alias("x"), F.sum("n").alias("of"), F.count("*").alias("k"))
    n = F.col("x.n")
    level = F.when(F.col("k") == 1, "high").when(n * 2 > F.col("of"), "medium").otherwise("NEEDS-VALIDATION")
    return best.select(key, F.col(f"x.{address}").alias(address), n.alias("votes"), "of", level.alias("confidence"))
