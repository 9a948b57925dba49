"""Session helpers shared by every operator: tables, settled intermediates, checked broadcasts."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructField, StructType

#: Rows and bytes a side may have, as counted, to be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 32 << 20


def local_session(cores: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and bench.py."""
    base = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "6g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tunemill")
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_tunemill_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(), "tunemill_package")
    sc.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(here), "tunemill"))
    sc._tunemill_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage, in the folder that spark.checkpoint.dir names.

    Only where that setting is empty and the master is local, as in tests, a folder of our own is used: on a cluster every
    machine would have another.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tunemill-checkpoint-"))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder of the checkpoints."""
    settle(spark.range(0))
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _bytes(field: StructField) -> Column:
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(kind, (ArrayType, MapType, StructType)):
        return F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)) + 8
    return F.lit(8)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Are the rows of df and their bytes, both counted, few enough to be broadcast? Counting runs df: give a settled or scanned one."""
    width = sum((_bytes(f) for f in df.schema), F.lit(0)).cast("bigint")
    n, total = df.limit(rows + 1).select(width.alias("_w")).agg(F.count("*"), F.coalesce(F.sum("_w"), F.lit(0))).first()
    return n <= rows and total <= size


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it fits; else as it is, for a shuffled join."""
    return F.broadcast(df) if fits(df, rows, size) else df


def source_name(col: Column | str = "source") -> Column:
    """Trimmed of white space and lower-cased; null stays null."""
    col = F.col(col) if isinstance(col, str) else col
    return F.lower(F.regexp_replace(col, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
