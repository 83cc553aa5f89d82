"""Windows over transcripts and session logs: what is new at a session's end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basalt.functions import text

ROLES = ("user", "human", "assistant")
TURNS, TURN_CHARS, DELTA_CHARS, LOG_LINES = 8, 1500, 10_000, 30
RULE = "\n\n---\n\n"


def turns(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """``conv_id, turn, role, text`` of transcripts kept as text: a turn is a paragraph, its role the mark
    it opens with (``user:``, ``Human>``, ``### assistant`` and the like) or NULL."""
    mark = r"^\s*(?:### )?(user|human|assistant|agent|User|Human|Assistant|Agent)(?:\n|:|>)\s*"
    para = documents.where("text is not null").select(F.col(key).alias("conv_id"), F.posexplode(F.split("text", "\n\n", -1)).alias("turn", "raw"))
    said = F.lower(F.regexp_extract("raw", mark, 1))
    role = F.when(said == "agent", "assistant").when(said != "", said)
    return para.select("conv_id", "turn", role.alias("role"), F.when(said != "", F.regexp_replace("raw", mark, "")).otherwise(F.col("raw")).alias("text"))


def qualifying(t: DataFrame) -> DataFrame:
    return t.where(F.col("role").isin(*ROLES) & (text.strip(F.col("text")) != ""))


def turn_tail(t: DataFrame, n: int = TURNS, chars: int = TURN_CHARS) -> DataFrame:
    """``conv_id, text``: the last ``n`` qualifying turns in their order, each cut to ``chars``."""
    w = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = qualifying(t).withColumn("n", F.row_number().over(w)).where(F.col("n") <= n)
    line = F.concat(F.lit("["), F.col("role"), F.lit("]: "), text.cut(text.strip(F.col("text")), chars))
    parts = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return last.groupBy("conv_id").agg(F.array_join(parts["line"], "\n\n").alias("text"))


def log_tail(logs: DataFrame, key: str = "doc_id", n: int = LOG_LINES, valid: str = r"^\d\d:\d\d:\d\d ") -> DataFrame:
    """``log_id, text``: of the last ``n`` lines of each log those that are well formed."""
    rows = logs.where("text is not null").select(F.col(key).alias("log_id"), F.split("text", "\n", -1).alias("l"))
    last = F.slice("l", F.greatest(F.lit(1), F.size("l") - n + 1), n)
    return rows.select("log_id", F.array_join(F.filter(last, lambda x: x.rlike(valid)), "\n").alias("text"))


def log_section(log: DataFrame, n: int = LOG_LINES, order: str = "ts") -> DataFrame:
    """``text``: the heading and ``tool  path`` of a session log's last ``n`` entries; no row without any.
    The log of one session is a bounded file, its entries come with ``sources.files.session_log``."""
    last = log.orderBy(F.desc(order), F.desc("path")).limit(n)
    parts = F.array_sort(F.collect_list(F.struct(order, F.concat(F.lit("  "), F.col("tool"), F.lit("  "), F.col("path")).alias("line"))))
    return last.agg(parts.alias("p")).where(F.size("p") > 0).select(F.concat(F.lit("Files modified this session:\n"), F.array_join("p.line", "\n")).alias("text"))


def delta(log: DataFrame, tail: DataFrame, chars: int = DELTA_CHARS) -> DataFrame:
    """``conv_id, text``: a log's tail and a conversation's, parted by a rule, the last ``chars`` of both;
    empty ones are left out."""
    j = tail.select("conv_id", F.col("text").alias("t")).join(log.select(F.col("log_id").alias("conv_id"), F.col("text").alias("l")), "conv_id", "full_outer")
    parts = F.filter(F.array("l", "t"), lambda x: x.isNotNull() & (x != ""))
    return j.select("conv_id", text.tail(F.array_join(parts, RULE), chars).alias("text")).where("text <> ''")
