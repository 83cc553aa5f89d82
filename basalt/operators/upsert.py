"""Hash-gated upserts and soft deletes as joins of what is stored with what arrives.

Each function returns the whole new table state (or the changed columns); ``sources.tables.replace``
writes it beside the old one and swaps, as a table is never read and overwritten in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basalt import schema


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key the row with the greatest ``order``; equal ones by the whole row's hash."""
    w = W.partitionBy(*keys).orderBy(F.desc(order), F.xxhash64(*[c for c in df.columns if c not in keys]))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def chunks(existing: DataFrame, incoming: DataFrame, now: int) -> DataFrame:
    """The whole new table: every column of both sides, and ``action``.

    ``unchanged``: the same hash, only made valid; ``updated``: another hash, so every column comes from the
    batch (one it does not bring, such as a vector still to be made, is NULL); ``inserted``: a new id;
    ``kept``: not in this batch. ``created_at`` is kept, ``updated_at`` and ``indexed_at`` are stamped where
    something was written. Repeated ids count once."""
    stamps = ("valid", "created_at", "updated_at", "indexed_at")
    columns = [c for c in dict.fromkeys([*existing.columns, *incoming.columns]) if c not in ("id", "action")]
    e = existing.dropDuplicates(["id"]).select("id", F.lit(True).alias("_old"), *(F.col(c).alias(f"_e_{c}") for c in existing.columns if c not in ("id", "action")))
    i = incoming.dropDuplicates(["id"]).select("id", F.lit(True).alias("_new"), *(F.col(c).alias(f"_i_{c}") for c in incoming.columns if c not in ("id", "action")))
    j = e.join(i, "id", "full_outer")
    action = F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "inserted").when(F.col("_e_content_hash").eqNullSafe(F.col("_i_content_hash")), "unchanged").otherwise("updated")
    touched = action.isin("inserted", "updated")

    def of(c: str) -> Column:
        old, new = F.col(f"_e_{c}") if c in existing.columns else None, F.col(f"_i_{c}") if c in incoming.columns else None
        if new is None:
            return F.when(~touched, old)
        return F.when(touched, new).otherwise(old) if old is not None else new

    def stamp(c: str) -> Column:
        old = F.col(f"_e_{c}") if c in existing.columns else F.lit(None)
        if c == "valid":
            return F.when(F.col("_new").isNull(), old).otherwise(F.lit(True))
        if c == "created_at":
            return F.coalesce(old, F.lit(now)).cast("bigint")
        return F.when(touched, F.lit(now)).otherwise(old).cast("bigint")

    return j.select("id", *((stamp(c) if c in stamps else of(c)).alias(c) for c in dict.fromkeys([*columns, "valid", "created_at", "updated_at"])), action.alias("action"))


def files(existing: DataFrame, incoming: DataFrame, now: int) -> DataFrame:
    """``id, path, ext, created_at, updated_at``: new paths are added, known ones are stamped."""
    e = existing.groupBy("id").agg(F.min("path").alias("old_path"), F.min("ext").alias("old_ext"), F.min("created_at").alias("old_created"), F.max("updated_at").alias("old_updated"))
    i = incoming.select("id", F.col("path").alias("new_path"), F.col("ext").alias("new_ext")).dropDuplicates(["id"])
    j = e.join(i, "id", "full_outer")
    return j.select(
        "id",
        F.coalesce("new_path", "old_path").alias("path"),
        F.coalesce("new_ext", "old_ext").alias("ext"),
        F.coalesce("old_created", F.lit(now)).cast("bigint").alias("created_at"),
        F.when(F.col("new_path").isNotNull(), F.lit(now)).otherwise(F.col("old_updated")).cast("bigint").alias("updated_at"),
    )


def edges(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Idempotent union of edges."""
    return existing.unionByName(incoming).dropDuplicates()


def invalidate_paths(chunks_: DataFrame, present: DataFrame, now: int) -> DataFrame:
    """``id, valid, updated_at``: chunks whose path is no longer present become invalid."""
    p = present.select("path").distinct().withColumn("here", F.lit(True))
    j = chunks_.select("id", "path", "valid", "updated_at").join(p, "path", "left")
    gone = F.col("here").isNull()
    return j.select("id", (F.col("valid") & ~gone).alias("valid"), F.when(gone & F.col("valid"), F.lit(now)).otherwise(F.col("updated_at")).cast("bigint").alias("updated_at"))


def invalidate_symbols(chunks_: DataFrame, surviving: DataFrame, now: int) -> DataFrame:
    """``id, valid, updated_at``: valid chunks of re-read paths that did not survive become invalid."""
    paths = surviving.select("path").distinct().withColumn("read", F.lit(True))
    alive = surviving.select("id").distinct().withColumn("alive", F.lit(True))
    j = chunks_.select("id", "path", "valid", "updated_at").join(paths, "path", "left").join(alive, "id", "left")
    gone = F.col("read").isNotNull() & F.col("alive").isNull()
    return j.select("id", (F.col("valid") & ~gone).alias("valid"), F.when(gone & F.col("valid"), F.lit(now)).otherwise(F.col("updated_at")).cast("bigint").alias("updated_at"))


def projects(existing: DataFrame, seen: DataFrame, now: int) -> DataFrame:
    """Every project of ``seen.group_id`` exists: a missing one is added with the current schema version, a known
    one keeps its time of creation."""
    e = existing.dropDuplicates(["group_id"]).withColumnRenamed("schema_version", "old_version")
    j = e.join(seen.where("group_id is not null").select("group_id").distinct().withColumn("new", F.lit(True)), "group_id", "full_outer")
    return j.select(
        "group_id", F.when(F.col("new"), F.lit(schema.SCHEMA_VERSION)).otherwise(F.col("old_version")).cast("int").alias("schema_version"),
        F.coalesce("created_at", F.lit(now)).cast("bigint").alias("created_at"), "last_full_scan_at", "repo_path",
    )


def stamp_projects(projects_: DataFrame, scans: DataFrame) -> DataFrame:
    """``group_id, created_at, last_full_scan_at, repo_path`` with the times, and the places if given, of
    ``scans (group_id, at[, repo_path])``; of several scans the last counts."""
    place = F.max_by("repo_path", "at") if "repo_path" in scans.columns else F.lit(None).cast("string")
    s = scans.groupBy("group_id").agg(F.max("at").alias("at"), place.alias("place"))
    return projects_.join(s, "group_id", "left").select(
        "group_id", "created_at", F.greatest("last_full_scan_at", "at").alias("last_full_scan_at"), F.coalesce("place", "repo_path").alias("repo_path")
    )


def ingest_stats(actions: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``total, embedded, skipped, errors`` of an upsert's actions, without the rows the batch did not hold;
    errors are the files that could not be read (NULL content)."""
    seen = actions.where("action <> 'kept'")
    out = seen.agg(F.count("*").alias("total"), F.count_if(F.col("action").isin("inserted", "updated")).alias("embedded"), F.count_if(F.col("action") == "unchanged").alias("skipped"))
    errors = F.lit(0).cast("bigint").alias("errors")
    return out.select("*", errors) if files is None else out.crossJoin(F.broadcast(files.agg(F.count_if(F.col("content").isNull()).alias("errors"))))
