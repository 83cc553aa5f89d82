"""Sinks: whole-table replacement beside the old state, and appended logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def replace(df: DataFrame, path: str, partition: str | None = "group_id") -> None:
    """Writes the new state beside the old and renames; a failed write leaves the old state. Rows are
    spread within a partition, so a hot group is several files."""
    spark = df.sparkSession
    new, old = path.rstrip("/") + ".new", path.rstrip("/") + ".old"
    w = df.write.mode("overwrite")
    if partition and partition in df.columns:
        w = w.partitionBy(partition)
    w.parquet(new)
    jvm, here, fs = _fs(spark, path)
    backup, fresh = jvm.org.apache.hadoop.fs.Path(old), jvm.org.apache.hadoop.fs.Path(new)
    fs.delete(backup, True)
    if fs.exists(here):
        fs.rename(here, backup)
    fs.rename(fresh, here)
    fs.delete(backup, True)


def replace_parts(df: DataFrame, path: str, by: str = "group_id", clear: DataFrame | None = None) -> None:
    """Writes only the partitions that ``df`` holds, in the place of what they held; the rows must not come from
    ``path`` itself. Partitions named by ``clear`` that ``df`` has no rows for are dropped."""
    spark = df.sparkSession
    df.write.mode("overwrite").partitionBy(by).option("partitionOverwriteMode", "dynamic").parquet(path)
    if clear is not None:
        left = clear.join(df.select(by).distinct(), by, "left_anti")
        for r in left.toLocalIterator():
            _, p, fs = _fs(spark, f"{path.rstrip('/')}/{by}={r[0]}")
            fs.delete(p, True)


def claim(spark: SparkSession, folder: str, group_id: str) -> bool:
    """Whether this run may take in a group: true for the one that makes the group's mark, until ``release``."""
    _, p, fs = _fs(spark, f"{folder.rstrip('/')}/{group_id}.running")
    return bool(fs.createNewFile(p))


def release(spark: SparkSession, folder: str, group_id: str) -> None:
    _, p, fs = _fs(spark, f"{folder.rstrip('/')}/{group_id}.running")
    fs.delete(p, False)


def exists(spark: SparkSession, path: str) -> bool:
    _, p, fs = _fs(spark, path)
    return fs.exists(p)


def append_log(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("append").json(path)


def embedding_models(spark: SparkSession, now: int) -> DataFrame:
    """The registry's two rows, for code and for facts."""
    rows = [("code@1.0", "code", "code", 768, "cosine", True, now), ("memory@1.0", "memory", "memory", 768, "cosine", True, now)]
    return spark.createDataFrame(rows, "id string, name string, purpose string, dim int, metric string, active boolean, created_at bigint").where(F.col("active"))
