"""Sources: repositories, transcripts, session logs, hook payloads and version-control status."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt import schema
from basalt.functions import paths, text

# Folders that are never read, suffixes that are never source, extensions with a parser.
SKIP_FOLDERS = ("node_modules", ".git", "__pycache__", ".venv", "venv", "dist", "build", ".next", ".nuxt", "target", "vendor", ".mypy_cache")
SKIP_SUFFIXES = (
    ".lock", ".sum", ".mod", ".min.js", ".min.css",
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico",
    ".woff", ".woff2", ".ttf", ".eot",
    ".pdf", ".zip", ".tar", ".gz",
    ".pyc", ".pyo", ".so", ".dylib", ".dll",
)
PARSED = (
    "py", "js", "jsx", "mjs", "cjs", "ts", "mts", "tsx", "go", "rs", "java", "c", "h", "cpp", "cc", "cxx", "hpp", "hxx",
    "cs", "rb", "php", "kt", "kts", "swift", "scala", "sc", "sh", "bash", "lua",
)


# Extensions that the graph reads beyond those with chunks.
GRAPH_ONLY = ("hs", "lhs", "ex", "exs")


def readable(path: Column, length: Column, root: str = "", ignored: str | None = None, extensions: tuple[str, ...] = PARSED, suffixes: tuple[str, ...] = SKIP_SUFFIXES) -> Column:
    """Whether a file is read: no skipped folder below the root, an extension of the list as it is written, no
    skipped suffix, at most the size limit, and not ignored (a regular expression over the relative path)."""
    inner = F.regexp_replace(path, "^" + re.escape(root), "") if root else path
    ok = ~F.arrays_overlap(F.split(inner, "/", -1), F.array(*map(F.lit, SKIP_FOLDERS)))
    ok = ok & paths.extension(path).isin(*extensions) & ~path.rlike("(" + "|".join(map(re.escape, suffixes or ("\n",))) + ")$") & (length <= schema.MAX_FILE)
    return ok if ignored is None else ok & ~F.ltrim(inner, F.lit("/")).rlike(ignored)


def _pattern(p: str) -> str:
    """One line of an ignore file as a regular expression over relative paths."""
    folder = p.endswith("/")
    p = p.rstrip("/")
    anchored = "/" in p
    p = p.lstrip("/")
    rx = ""
    i = 0
    while i < len(p):
        if p.startswith("**/", i):
            rx += "(?:.*/)?"
            i += 3
        elif p.startswith("**", i):
            rx += ".*"
            i += 2
        elif p[i] == "*":
            rx += "[^/]*"
            i += 1
        elif p[i] == "?":
            rx += "[^/]"
            i += 1
        elif p[i] == "[" and "]" in p[i + 2 :]:
            e = p.index("]", i + 2)
            rx += "[" + p[i + 1 : e].replace("!", "^", 1) + "]"
            i = e + 1
        elif p[i] == "\\" and i + 1 < len(p):
            rx += re.escape(p[i + 1])
            i += 2
        else:
            rx += re.escape(p[i])
            i += 1
    return ("^" if anchored else "(?:^|/)") + rx + ("/" if folder else "(?:/|$)")


def gitignore(lines: list[str]) -> str | None:
    """The lines of an ignore file as one regular expression over relative paths; NULL if none counts. The last
    line that matches a path decides: a pattern holds where no later one takes it back with ``!``."""
    rules = []
    for raw in lines:
        p = raw.rstrip()
        if p and not p.startswith("#"):
            rules.append((p.startswith("!"), _pattern(p[1:] if p[0] == "!" else p)))
    out = []
    for n, (kept, rx) in enumerate(rules):
        if not kept:
            back = [later for taken, later in rules[n + 1 :] if taken]
            out.append("".join(f"(?!.*?{b})" if not b.startswith("^") else f"(?!{b[1:]})" for b in back) + (f".*?{rx}" if not rx.startswith("^") else rx[1:]))
    # within a pattern ``(?:^|/)`` after ``.*?`` still means a path's beginning or a slash
    return "^(?:" + "|".join(out) + ")" if out else None


def repository(spark: SparkSession, root: str, ignored: str | None = None, graph: bool = False) -> DataFrame:
    """``path, ext, length, content`` of a folder's readable files; the length is tested before the
    content is read. ``graph``: for the call and import graph, which reads more extensions and skips no suffix."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^file:", "")
    ok = readable(F.col("path"), F.col("length"), root, ignored, PARSED + GRAPH_ONLY if graph else PARSED, () if graph else SKIP_SUFFIXES)
    return raw.withColumn("path", path).where(ok).select("path", paths.extension(F.col("path")).alias("ext"), "length", "content")


def ignore_file(spark: SparkSession, root: str) -> str | None:
    """The expression of a folder's own ignore file, NULL without one."""
    from basalt.sources import tables

    at = root.rstrip("/") + "/.gitignore"
    return gitignore([r[0] for r in spark.read.text(at).toLocalIterator()]) if tables.exists(spark, at) else None


def messages(lines: DataFrame, conv: str = "conv_id", turn: str = "turn", line: str = "line") -> DataFrame:
    """``conv_id, turn, role, text`` of a transcript's JSON lines; malformed lines have no role."""
    role, said = text.message(F.col(line))
    return lines.where(F.trim(line) != "").select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), role.alias("role"), said.alias("text"))


def transcript(spark: SparkSession, path: str) -> DataFrame:
    """The messages of transcript files. The file is the conversation; a line is a row and its place in the
    file the turn, so a long transcript is read in splits."""
    raw = spark.read.text(path).select(F.xxhash64("_metadata.file_path").alias("conv_id"), (F.col("_metadata.file_block_start") * (1 << 24) + F.monotonically_increasing_id() % (1 << 24)).alias("turn"), F.col("value").alias("line"))
    return messages(raw)


def session_log(spark: SparkSession, path: str, last: int = 30) -> DataFrame:
    """``tool, path, ts`` (seconds) of the last lines of a session's log; malformed ones among them are
    dropped, missing fields read ``?``. The log of one session is one small file, read in its order."""
    raw = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", "\n", -1), lambda x: F.trim(x) != "").alias("l"))
    return log_entries(raw.select(F.posexplode(F.slice("l", F.greatest(F.lit(1), F.size("l") - last + 1), last)).alias("n", "line")))


def log_entries(lines: DataFrame) -> DataFrame:
    """``n, tool, path, ts`` of JSON lines, without those that are none."""
    e = F.from_json("line", "tool string, path string, ts bigint, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.withColumn("e", e).where("e is not null and e._bad is null").select("n", F.coalesce("e.tool", F.lit("?")).alias("tool"), F.coalesce("e.path", F.lit("?")).alias("path"), "e.ts")


def hook_payload(lines: DataFrame, column: str = "value") -> DataFrame:
    """``tool_name, cwd, path`` of every file an edit event names; unreadable payloads give none."""
    p = F.from_json(column, "cwd string, tool_name string, transcript_path string, tool_input struct<file_path string, path string, edits array<struct<file_path string>>>", {"mode": "PERMISSIVE"})
    rows = lines.select(p.alias("p")).where("p.tool_name in ('Write', 'Edit', 'MultiEdit')")
    many = F.concat(F.array(F.coalesce("p.tool_input.file_path", "p.tool_input.path")), F.coalesce(F.col("p.tool_input.edits.file_path"), F.array().cast("array<string>")))
    return rows.select("p.tool_name", "p.cwd", F.explode(F.array_distinct(many)).alias("path")).where("path is not null")


def status_lines(spark: SparkSession, lines: list[str], root: str) -> DataFrame:
    """``path``: absolute paths of ``git status --porcelain`` output."""
    df = spark.createDataFrame([(x,) for x in lines if len(x) > 3], "line string")
    return df.select(F.concat(F.lit(root.rstrip("/") + "/"), text.porcelain_path(F.col("line"))).alias("path")).distinct()
