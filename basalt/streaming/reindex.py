"""Incremental upkeep: edit events in, the latest event per path out, one upsert per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from basalt import schema
from basalt.operators import extract, graph, upsert
from basalt.session import fresh_path, stage
from basalt.sources import tables


def source(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    """A stream of the Parquet files under a path or pattern."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> StreamingQuery:
    """Hands every micro-batch that holds rows to ``step`` until the input is used up."""

    def guarded(batch: DataFrame, n: int) -> None:
        if not batch.isEmpty():
            step(batch, n)

    at = checkpoint or fresh_path(stream.sparkSession, "stream")
    return stream.writeStream.foreachBatch(guarded).option("checkpointLocation", at).trigger(availableNow=True).start()


def latest_by(stream: DataFrame, key: str, order: str, out: str) -> StreamingQuery:
    """Keeps, under ``out``, the row with the greatest ``order`` of each key; replaying a batch changes
    nothing, as it is merged with what is there."""
    spark = stream.sparkSession

    def merge(batch: DataFrame, n: int) -> None:
        now = upsert.latest(batch, [key], order)
        if tables.exists(spark, out):
            now = upsert.latest(now.unionByName(spark.read.schema(batch.schema).parquet(out)), [key], order)
        tables.replace(now, out, partition=None)

    return run(stream, merge)


def reindex(stream: DataFrame, chunks_path: str, now: int, edges_path: str | None = None, order: str = "at") -> StreamingQuery:
    """Re-reads the files of each micro-batch (``group_id, path, content, at``; NULL content is a deleted file): of
    several events of a path the last by ``order`` counts. Their chunks are upserted behind the hash gate with
    every column of the table, symbols and files that are gone become invalid, and the call edges under
    ``edges_path`` are refreshed.

    Both tables are partitioned by ``group_id``; only the groups of the batch are read and written, so a
    batch costs what its projects hold. A batch that is replayed writes the same state again."""
    spark = stream.sparkSession

    def step(batch: DataFrame, n: int) -> None:
        last = stage(batch.groupBy("group_id", "path").agg(F.max_by(F.struct("content"), F.struct(order, F.xxhash64("content"))).alias("x")).select("group_id", "path", "x.content"), "events")
        fresh = extract.extract(last.select("path", "content")).join(last.select("group_id", "path"), "path")
        groups = last.select("group_id").distinct()
        if tables.exists(spark, chunks_path):
            known = spark.read.parquet(chunks_path)
            old = known.join(groups, "group_id", "left_semi")
        else:
            old = spark.createDataFrame([], schema.CHUNKS)
        state = upsert.chunks(old, fresh, now).drop("action")
        alive = fresh.select("id").distinct().withColumn("_alive", F.lit(True))
        touched = last.select("group_id", "path").withColumn("_touched", F.lit(True))
        full = state.join(alive, "id", "left").join(touched, ["group_id", "path"], "left")
        gone = F.col("_touched").isNotNull() & F.col("_alive").isNull() & F.col("valid")
        updated = F.when(gone, F.lit(now)).otherwise(F.col("updated_at")).cast("bigint")
        done = stage(full.withColumn("updated_at", updated).withColumn("valid", F.col("valid") & ~gone).select(*state.columns), "state")
        tables.replace_parts(done, chunks_path)
        if edges_path:
            fresh_edges = stage(graph.call_edges(done), "edges")
            # a group without edges left still gets its (empty) part
            tables.replace_parts(fresh_edges, edges_path, clear=groups)

    return run(stream, step)
