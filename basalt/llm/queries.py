"""The registered queries of the training-data problems, each over its whole tables.

A search's queries are the rows whose id (its first 8 hex digits as a number, or the number itself)
is divisible by 100, against all rows; where a ``pN_found`` result is defined it covers all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.oracle import oracle_sql  # noqa: F401
from basalt.llm import history, layout, leakage, neighbours, packing, secrets, splitting, syntax
from basalt.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    r = history.rejects(table(spark, d, "facts"))
    return r.select(F.least("id", "earlier_id").alias("id_a"), F.greatest("id", "earlier_id").alias("id_b"))


def p1_rejects(spark: SparkSession, d: str) -> DataFrame:
    return history.rejects(table(spark, d, "facts"))


def p1_copies(spark: SparkSession, d: str) -> DataFrame:
    """Of the rejected facts those that repeat an earlier one of their group letter by letter."""
    f = table(spark, d, "facts").select("id", "group_id", "content", "created_at").dropDuplicates(["id"])
    first = f.where(F.trim("content") != "").groupBy("group_id", "content").agg(F.min(F.struct("created_at", "id")).alias("first"))
    copies = f.join(first, ["group_id", "content"]).where(F.struct("created_at", "id") > F.col("first")).select("id")
    return history.rejects(table(spark, d, "facts")).select("id").join(copies, "id", "left_semi")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.find_lines(table(spark, d, "chunks"))


#: tokens whose issuer fixes their form
FORMATS = r"(^|[^A-Za-z0-9])((AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|glpat-[A-Za-z0-9_-]{20})([^A-Za-z0-9_]|$)"


def p2_formats(spark: SparkSession, d: str) -> DataFrame:
    """Of the lines found those that hold a token of an issued format."""
    c = table(spark, d, "chunks").dropDuplicates(["id"])
    lines = c.select(F.col("id").alias("chunk_id"), F.posexplode(F.split("content", "\n", -1)).alias("at", "line")).where(F.col("line").rlike(FORMATS))
    return p2_found(spark, d).join(lines.select("chunk_id", (F.col("at") + 1).cast("bigint").alias("line_no")), ["chunk_id", "line_no"], "left_semi")


def p2_masked(spark: SparkSession, d: str) -> DataFrame:
    slim = table(spark, d, "chunks").select("id", "path", "content", "signature")
    return secrets.mask_columns(slim).where("n_secrets > 0").dropDuplicates(["id"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return layout.not_handwritten(table(spark, d, "source_files"))


def p3_layout(spark: SparkSession, d: str) -> DataFrame:
    return layout.classify(table(spark, d, "source_files"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return layout.measured(table(spark, d, "source_files"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for src in ("chunks", "facts"):
        got = neighbours.all_pairs(table(spark, d, src)).select(F.lit(src).alias("src"), "id_a", "id_b")
        out = got if out is None else out.unionByName(got)
    return out


def p4_top10(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for src in ("chunks", "facts"):
        df = table(spark, d, src)
        asked = df.where(F.conv(F.substring(F.regexp_replace("id", "-", ""), 1, 8), 16, 10).cast("bigint") % 100 == 0)
        got = neighbours.search(asked, df, k=10).select(F.lit(src).alias("src"), "id", "rank", "near_id", "cosine")
        out = got if out is None else out.unionByName(got)
    return out


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.broken(table(spark, d, "source_files"))


def p5_json(spark: SparkSession, d: str) -> DataFrame:
    """Of the files that do not parse those in JSON."""
    return syntax.broken(table(spark, d, "source_files").where("path like '%.json'"))


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(table(spark, d, "source_files"), table(spark, d, "files"))


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Each document's tokens over all its containers, and whether it was split."""
    packed = packing.pack(table(spark, d, "documents"))
    return packed.groupBy("doc_id").agg(F.sum("n_tokens").cast("bigint").alias("n_tokens"), (F.count("*") > 1).alias("split"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Tokens packed, containers above the capacity, and whether at most a twentieth of the space is unused."""
    boxes = packing.pack(table(spark, d, "documents")).groupBy("container").agg(F.sum("n_tokens").alias("n"))
    return boxes.agg(F.sum("n").cast("bigint").alias("n_tokens"), F.count_if(F.col("n") > packing.CAPACITY).alias("overfull"), (F.sum("n") >= 0.95 * packing.CAPACITY * F.count("*")).alias("filled"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


#: characters around the middle of an item's text
MIDDLE = 200


def p7_middle(spark: SparkSession, d: str) -> DataFrame:
    """Of the leaks found those where the document holds the middle of the item's text letter by letter."""
    docs, items = table(spark, d, "documents"), table(spark, d, "eval_items")
    middle = F.substring("text", (F.length("text") / 2).cast("int") - MIDDLE // 2, F.lit(MIDDLE))
    middles = items.where(F.length("text") >= 2 * MIDDLE).select("item_id", middle.alias("middle"))
    both = p7_found(spark, d).join(docs.select("doc_id", "text"), "doc_id").join(middles, "item_id")
    return both.where(F.contains("text", "middle")).select("doc_id", "item_id").distinct()


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(table(spark, d, "documents"))


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split(table(spark, d, "documents"))


def p8_cover(spark: SparkSession, d: str) -> DataFrame:
    """Of each split document its tokens, each counted once over the pieces, and whether pieces keep the limits."""
    pieces = splitting.split(table(spark, d, "documents"))
    ok = (F.max("n_tokens") <= 1024) & (F.max("n_repeated") <= 64) & (F.count("*") == F.max("piece") + 1)
    return pieces.groupBy("doc_id").agg(F.sum(F.col("n_tokens") - F.col("n_repeated")).cast("bigint").alias("n_tokens"), ok.alias("kept"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}
