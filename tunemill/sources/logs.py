"""Datalogs in CSV: headers become channel roles by ordered rules, values become doubles or null."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Headers that are no channel.
IGNORED = (r"sensor\s*voltage", r"heater\s*voltage", r"adjustment\s*voltage", r"motor\s*voltage", r"wastegate")
#: Header patterns and their roles; the first that matches holds.
ROLES = (
    (r"\bcl\s*/\s*ol\b", "fuel_system_status"),
    (r"fine\s*(learn\w*\s*)?knock", "fine_knock_learn"),
    (r"\biam\b", "iam"),
    (r"knock", "knock_retard"),
    (r"fuel\w*\s*target", "target_afr"),
    (r"final\s*fuel\w*\s*base", "final_fueling_base"),
    (r"wideband|uego|\baem\b|\bwb\b|lambda", "wideband_afr"),
    (r"learn\w*\s*airflow\s*range|airflow\s*range", "af_learning_range"),
    (r"a/?f\s*learn", "af_learning"),
    (r"a/?f\s*correction|a/?f\s*corr", "af_correction"),
    (r"engine\s*load|calculated\s*load|g/rev|\bload\b", "load"),
    (r"mass\s*air|\bmaf\b|airflow|g/s", "maf_gs"),
    (r"injector\s*duty|inj\s*duty|\bipw\b|injector\s*pulse", "injector_duty"),
    (r"base\s*timing", "timing_base"),
    (r"ignition\s*total|total\s*timing|timing\s*advance|\btiming\b", "timing_total"),
    (r"intake\s*air\s*temp|\biat\b", "iat"),
    (r"coolant|\bclt\b|\bect\b|water\s*temp", "coolant"),
    (r"throttle|\btps\b|pedal", "tps"),
    (r"\brpm\b|engine\s*speed", "rpm"),
    (r"battery|\bvolt", "battery_v"),
)
#: Which of several headers for a role is meant.
PREFERRED = {"load": r"4-?byte", "knock_retard": r"feedback\s*knock", "iam": r"4-?byte", "tps": r"plate"}


def role(header: str) -> str | None:
    """The channel that a header names, or None."""
    if any(re.search(p, header, re.I) for p in IGNORED):
        return None
    return next((name for p, name in ROLES if re.search(p, header.strip(), re.I)), None)


def role_column(header: Column) -> Column:
    """role() as an expression over a column of headers."""
    out = F.when(header.rlike("(?i)" + "|".join(f"(?:{p})" for p in IGNORED)), F.lit(None).cast("string"))
    for p, name in ROLES:
        out = out.when(header.rlike(f"(?i){p}"), name)
    return out


def preferred(name: str, headers: list[str]) -> str:
    """The header meant for a role: the first that its preference matches, else the first."""
    p = PREFERRED.get(name)
    return next((h for h in headers if p and re.search(p, h, re.I)), headers[0])


def assign(headers: list[str]) -> tuple[dict[str, str], dict[str, list[str]]]:
    """header of each role, and all headers of the roles that several claim."""
    claims: dict[str, list[str]] = {}
    for h in headers:
        if (r := role(h)) is not None:
            claims.setdefault(r, []).append(h)
    return {r: preferred(r, hs) for r, hs in claims.items()}, {r: hs for r, hs in claims.items() if len(hs) > 1}


def is_path(src: str) -> bool:
    return "\n" not in src and len(src) < 4096 and (os.path.exists(src) or "://" in src or "*" in src)


def read_log(spark: SparkSession, src: str) -> tuple[DataFrame, dict[str, list[str]]]:
    """A log by path (also a glob) or as CSV text, and its header collisions.

    One double column for each role, file and line. Blank and short rows keep what they have; what is no number is null.
    """
    if is_path(src):
        raw = spark.read.csv(src, header=True, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
        raw = raw.withColumn("file", F.col("_metadata.file_path"))
    else:
        lines = [x for x in src.splitlines() if x.strip()]
        raw = spark.read.csv(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string").coalesce(1).orderBy("i").select("value").rdd.map(lambda r: r.value), header=True).withColumn("file", F.lit(""))
    roles, collisions = assign([c for c in raw.columns if c != "file"])
    number = lambda h: F.nanvl(F.expr(f"try_cast(trim(`{h.replace('`', '``')}`) as double)"), F.lit(None).cast("double"))
    rows = raw.select("file", *(number(h).alias(r) for r, h in roles.items()))
    return rows.where(F.coalesce(*(F.col(r) for r in roles)).isNotNull()) if roles else rows, collisions
