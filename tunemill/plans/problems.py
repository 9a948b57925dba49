"""Queries of the general data-quality operators: faulty readings (p5) and quantities in different units (p7)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunemill.operators import units
from tunemill.operators.faults import Faults
from tunemill.session import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return Faults(table(spark, d, "memtest_soak"), table(spark, d, "sensor_limit")).labels()


def p5_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    return Faults(table(spark, d, "memtest_soak"), table(spark, d, "sensor_limit")).cutoffs()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows that state another unit than expected and agree when converted.

    What an answer states decides, not its history: for such a row the marks of unit_marks can only confirm the stated unit,
    or miss it where a figure is low within its tolerance. p7_marks shows what the search finds without the stated units.
    """
    return units.measurements(table(spark, d, "e2_answers"), table(spark, d, "unit_target")).where("agrees and unit <> expected_unit").select("row_id")


def p7_marks(spark: SparkSession, d: str) -> DataFrame:
    """What the search finds in bare numbers, beside what the answers state: rows by expected unit, stated unit and marks."""
    marks = units.unit_marks(table(spark, d, "e2_answers"), table(spark, d, "unit_target"))
    told = F.when(F.coalesce("stated", "expected_unit") == F.col("expected_unit"), F.when(F.size("marks") == 0, "same unit, no mark").otherwise("same unit, marked")).when(F.array_contains("marks", F.col("stated")), "other unit, marked so").when(F.size("marks") > 0, "other unit, marked otherwise").otherwise("other unit, no mark")
    return marks.groupBy("expected_unit", told.alias("found"), F.col("agrees").alias("agrees")).agg(F.count("*").alias("rows"))


def p7_values(spark: SparkSession, d: str) -> DataFrame:
    return units.measurements(table(spark, d, "e2_answers"), table(spark, d, "unit_target"))


def p7_shifts(spark: SparkSession, d: str) -> DataFrame:
    """Unit changes in the history of each probe's answers, their figures taken as written and bare, in the order of time.

    Beside each change found stand the units that the answers state, or that are expected of them where they state none.
    """
    rows = units.figures(table(spark, d, "e2_answers"), ["probe_id", "created_at"])
    return units.unit_shifts(rows, ["probe_id"], "created_at", "figure", "quantity", unit="unit")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p5_found, p5_cutoffs, p7_found, p7_marks, p7_values, p7_shifts)}
