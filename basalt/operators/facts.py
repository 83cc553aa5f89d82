"""Adding and changing facts; every function is a pure DataFrame step, times are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt import schema


def with_defaults(incoming: DataFrame, now: int, source: str = "session") -> DataFrame:
    """New facts, every column of the table, with what was left out: type ``fact``, a source, valid from now
    with an open end, made and read now, no empty anchor, not immune, never read."""
    have = set(incoming.columns)

    def col(name: str, kind: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    return incoming.select(
        "id",
        "group_id",
        "content",
        F.coalesce(F.lower(col("type", "string")), F.lit("fact")).alias("type"),
        col("emb", "array<float>").alias("emb"),
        col("emb_model", "string").alias("emb_model"),
        F.coalesce(col("emb_dim", "int"), F.when(col("emb", "array<float>").isNotNull(), F.size(col("emb", "array<float>")))).alias("emb_dim"),
        F.when(col("anchor", "string") != "", col("anchor", "string")).alias("anchor"),
        F.coalesce(col("source", "string"), F.lit(source)).alias("source"),
        F.coalesce(F.when(col("valid_from", "bigint") != 0, col("valid_from", "bigint")), F.lit(now)).cast("bigint").alias("valid_from"),
        col("invalid_at", "bigint").alias("invalid_at"),
        F.coalesce(col("immune", "boolean"), F.lit(False)).alias("immune"),
        F.coalesce(col("created_at", "bigint"), F.lit(now)).cast("bigint").alias("created_at"),
        F.coalesce(col("last_accessed_at", "bigint"), F.lit(now)).cast("bigint").alias("last_accessed_at"),
        F.coalesce(col("access_count", "bigint"), F.lit(0)).cast("bigint").alias("access_count"),
    )


def add(facts: DataFrame, incoming: DataFrame, chunks: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Adding facts with their vectors: (``id, status, existing_id, sim`` of each, the rows to append, the
    anchor edges of these). A fact near a valid one before it is a duplicate and not written; one without a vector is new."""
    from basalt.operators import graph, search

    fresh = with_defaults(incoming, now).dropDuplicates(["id"])
    near = search.near_duplicates(fresh, facts.unionByName(fresh, allowMissingColumns=True), now)
    status = fresh.select("id").join(near, "id", "left").withColumn("status", F.coalesce("status", F.lit("new")))
    rows = fresh.join(status.where("status = 'new'").select("id"), "id", "left_semi")
    return status, rows, graph.anchor_edges(rows, chunks)


def access_bump(table: DataFrame, hits: DataFrame, now: int) -> DataFrame:
    """``id, last_accessed_at`` and, where the table counts, ``access_count``: returned ids are read once more, now."""
    h = hits.select("id").distinct().withColumn("hit", F.lit(True))
    out = ["id", F.when(F.col("hit"), F.lit(now)).otherwise(F.col("last_accessed_at")).cast("bigint").alias("last_accessed_at")]
    if "access_count" in table.columns:
        out.append(F.when(F.col("hit"), F.coalesce("access_count", F.lit(0)) + 1).otherwise(F.col("access_count")).cast("bigint").alias("access_count"))
    return table.join(h, "id", "left").select(*out)


def set_immune(facts: DataFrame, chosen: DataFrame, immune: bool) -> DataFrame:
    """``id, immune``; ids that do not exist change nothing."""
    h = chosen.select("id").distinct().withColumn("hit", F.lit(True))
    return facts.join(h, "id", "left").select("id", F.when(F.col("hit"), F.lit(immune)).otherwise(F.col("immune")).alias("immune"))


def extend(facts: DataFrame, chosen: DataFrame, days: int) -> DataFrame:
    """``id, created_at, invalid_at``, later by so many days; an open end stays open."""
    ms = days * schema.DAY_MS
    h = chosen.select("id").distinct().withColumn("hit", F.lit(True))
    moved = F.coalesce("hit", F.lit(False))
    return facts.join(h, "id", "left").select(
        "id",
        F.when(moved, F.col("created_at") + ms).otherwise(F.col("created_at")).alias("created_at"),
        F.when(moved & F.col("invalid_at").isNotNull(), F.col("invalid_at") + ms).otherwise(F.col("invalid_at")).alias("invalid_at"),
    )


def retained(facts: DataFrame, now: int, days: int = 30, grace: int = 30) -> DataFrame:
    """Facts that a retention run keeps: immune ones, and those created or read within ``days``, or
    created within ``days + grace``. An extension: the documents of the studied service promise it,
    its code does not do it."""
    read = F.coalesce("last_accessed_at", "created_at")
    fresh = (read >= now - days * schema.DAY_MS) | (F.col("created_at") >= now - (days + grace) * schema.DAY_MS)
    return facts.where(F.coalesce("immune", F.lit(False)) | fresh | F.col("created_at").isNull())
