"""Writers: partitioned tables, audit logs, JSON lines, vector index with its stamp, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def store(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """Replace a Parquet table, only the partitions that df holds if it is partitioned."""
    w = df.write.mode("overwrite")
    if partition:
        w = w.partitionBy(*partition).option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there, jvm.org.apache.hadoop.fs.Path


def replace(df: DataFrame, path: str) -> None:
    """Replace a Parquet table whole, also by rows that were read from it: written beside it first, then renamed.

    A failure before the renames leaves the old table; one between them leaves both under other names.
    """
    fs, there, at = _files(df.sparkSession, path)
    new, old = at(f"{path}._new"), at(f"{path}._old")
    df.write.mode("overwrite").parquet(new.toString())
    fs.delete(old, True)
    if fs.exists(there) and not fs.rename(there, old):
        raise OSError(f"can't move {path} aside")
    if not fs.rename(new, there):
        raise OSError(f"can't move the new {path} into place")
    fs.delete(old, True)


def put(incoming: DataFrame, path: str, keys: list[str], order: list[Column]) -> None:
    """Write incoming rows into a table keyed by `keys`: of each key the incoming row, the first by order, else the stored."""
    from tunemill.operators.corpus import latest

    spark = incoming.sparkSession
    fs, there, _ = _files(spark, path)
    new = latest(incoming, keys, order)
    if fs.exists(there):
        new = new.unionByName(spark.read.parquet(path).join(new.select(*keys), keys, "left_anti"))
    replace(new, path)


def report(text: str, spark: SparkSession, path: str) -> None:
    """Write a report atomically: readers see the old one or the new one, whole."""
    fs, there, at = _files(spark, path)
    beside = at(f"{path}._new")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(there, False)
    if not fs.rename(beside, there):
        raise OSError(f"can't move the new {path} into place")


def resumed(spark: SparkSession, path: str, schema: str, keys: list[str], asked: DataFrame) -> DataFrame:
    """The rows of asked whose keys a report of JSON lines doesn't hold yet; all of them where there is no report."""
    fs, there, _ = _files(spark, path)
    return asked.join(spark.read.schema(schema).json(path).select(*keys).distinct(), keys, "left_anti") if fs.exists(there) else asked


def audit(df: DataFrame, path: str, at: str) -> None:
    """Append rows to a log of JSON lines, a folder for each UTC day, stamped to the second."""
    stamp = F.date_format(F.col(at), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    df.withColumn("stamp", stamp).withColumn("day", F.to_date(F.col(at))).drop(at).write.mode("append").partitionBy("day").json(path)


def json_lines(df: DataFrame, path: str, mode: str = "overwrite", files: int | None = None) -> None:
    (df.coalesce(files) if files else df).write.mode(mode).json(path)


def split_lines(df: DataFrame, path: str, column: str = "split") -> None:
    """A folder of JSON lines for each value of the split column."""
    df.write.mode("overwrite").partitionBy(column).json(path)


def vector_index(rows: DataFrame, key: str, vec: str, path: str) -> None:
    """Vectors of length 1 as floats, and a stamp with their number."""
    from tunemill.operators.retrieval import normalised

    index = rows.select(key, normalised(F.col(vec)).cast("array<float>").alias("vec")).where("vec is not null")
    index.write.mode("overwrite").parquet(f"{path}/vectors")
    spark = rows.sparkSession
    spark.read.parquet(f"{path}/vectors").agg(F.count("*").alias("n_rows")).coalesce(1).write.mode("overwrite").parquet(f"{path}/stamp")


def load_index(spark: SparkSession, path: str, now: DataFrame) -> tuple[DataFrame, bool]:
    """The vectors of an index, and whether its stamp still counts the rows of `now`."""
    stamp = spark.read.parquet(f"{path}/stamp").first()
    return spark.read.parquet(f"{path}/vectors"), bool(stamp) and stamp.n_rows == now.count()


def markdown_table(df: DataFrame, columns: list[str], order: list[Column], most: int = 1_000) -> str:
    """A report's table of at most `most` rows, made where the driver writes the report."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    lines = df.orderBy(*order).limit(most).select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |")).alias("l")).collect()
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + " - |" * len(columns), *(r.l for r in lines)])


def summary(runs: DataFrame) -> dict:
    """What a run's message says: totals and the errors of each source."""
    r = runs.agg(F.sum("new_count").alias("new"), F.sum("fetched").alias("fetched"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.collect_set(F.when(F.col("error").isNotNull(), F.concat_ws(": ", "source", F.substring("error", 1, 80)))).alias("errors")).first()
    return {"new": r["new"] or 0, "fetched": r["fetched"] or 0, "failed": r["failed"], "errors": sorted(r["errors"])[:20]}
