"""Source slices by reference: chunks keep places, the text is read from the files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.functions import ids, text


def fetch(requests: DataFrame, chunks: DataFrame, source_files: DataFrame) -> DataFrame:
    """``request, path, symbol, start_line, end_line, source, error`` for each of ``requests (request, group_id, id,
    path, symbol)``: a chunk by its id, or by path and symbol, in its group; lines are clamped to the file.

    Errors, with no source: ``incomplete request`` (no group, or neither id nor path and symbol), ``chunk not
    found``, ``symbol not found``, ``file not found``. Bytes that are not UTF-8 are replaced. Every request gives one
    row; repeated rows of a chunk or file count once."""
    by_id = F.col("id").isNotNull() & (F.col("id") != "")
    named = (F.col("path") != "") & (F.col("symbol") != "")
    asked = requests.select(
        "request", F.col("group_id").alias("g"), F.when(by_id, F.col("id")).when(named, ids.chunk_id(F.col("path"), F.col("symbol"))).alias("cid"),
        by_id.alias("by_id"), ((by_id | F.coalesce(named, F.lit(False))) & F.col("group_id").isNotNull()).alias("whole"),
    )
    c = chunks.select(F.col("id").alias("cid"), F.col("group_id").alias("g"), "path", "symbol", "start_line", "end_line").dropDuplicates(["cid", "g"])
    found = asked.join(c, ["cid", "g"], "left")
    # only files that are asked for are decoded
    wanted = found.where("whole and path is not null").select("path").distinct()
    read = source_files.where("path is not null").join(wanted, "path", "left_semi").select("path", "content").dropDuplicates(["path"])
    body = read.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("body"), F.lit(True).alias("there"))
    j = found.join(body, "path", "left")
    error = (
        F.when(~F.coalesce("whole", F.lit(False)), "incomplete request").when(F.col("path").isNull(), F.when(F.coalesce("by_id", F.lit(False)), "chunk not found").otherwise("symbol not found"))
        .when(F.col("there").isNull(), "file not found")
    )
    ok = error.isNull()
    lines = F.size(text.lines(F.coalesce("body", F.lit(""))))
    return j.select(
        "request", *(F.when(~error.isin("incomplete request") | ok, F.col(x)).alias(x) for x in ("path", "symbol")),
        F.when(ok, F.greatest(F.lit(1), "start_line")).alias("start_line"), F.when(ok, F.least(lines, "end_line")).alias("end_line"),
        F.when(ok, text.line_slice(F.coalesce("body", F.lit("")), F.col("start_line"), F.col("end_line"))).alias("source"), error.alias("error"),
    )
