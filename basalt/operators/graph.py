"""Call and import edges, bounded reachability, neighbours and counts.

A callee is matched by equality with the last dotted part of a symbol (a callee has no dot), so the
suffix match becomes a hash join. Names that several chunks share are dropped before the join, on a
pre-aggregated table of one row per (group, name): a hot name or group costs that table one row.
Reachability is a loop of joins of the frontier with the edges; each round is written to the shared
folder, which cuts its lineage and survives the loss of an executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt import schema
from basalt.functions import code, ids, paths
from basalt.operators.search import symbol_match
from basalt.session import stage


def call_sites(chunks: DataFrame) -> DataFrame:
    """``group_id, src_id, callee, n``: the names that a chunk's text calls, and how often."""
    ext = paths.extension(F.col("path"))
    sites = chunks.where("content is not null").select("group_id", F.col("id").alias("src_id"), F.explode(code.calls(F.col("content"), ext)).alias("callee"))
    return sites.groupBy("group_id", "src_id", "callee").agg(F.count("*").alias("n"))


def call_edges(chunks: DataFrame) -> DataFrame:
    """``group_id, src_id, dst_id``: a valid chunk calls a name that exactly one valid chunk of its
    group bears; a chunk does not call itself."""
    sites = call_sites(chunks.where("valid")).select("group_id", "src_id", "callee")
    last = F.substring_index("symbol", ".", -1)
    owners = chunks.where("valid").select("group_id", last.alias("callee"), "id").groupBy("group_id", "callee").agg(F.min("id").alias("dst_id"), F.max("id").alias("other"))
    sole = owners.where("dst_id = other").drop("other")
    return sites.join(sole, ["group_id", "callee"]).where("src_id <> dst_id").select("group_id", "src_id", "dst_id").distinct()


def import_edges(specs: DataFrame, files: DataFrame) -> DataFrame:
    """``group_id, raw, src_id, dst_id``: of a specifier's candidates the first that exists in the group."""
    from basalt.operators.imports import candidates

    universe = files.where("path is not null").select("group_id", "path").distinct()
    wanted = candidates(specs.join(universe, "path"))
    hit = wanted.join(universe.select("group_id", F.col("path").alias("candidate")), ["group_id", "candidate"])
    best = hit.groupBy("group_id", "path", "raw").agg(F.min_by("candidate", "ordinal").alias("target"))
    return best.where("path <> target").select("group_id", "raw", ids.file_id(F.col("path")).alias("src_id"), ids.file_id(F.col("target")).alias("dst_id"))


def anchor_edges(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """``group_id, fact_id, chunk_id``: a fact is linked to every valid chunk of its anchor's symbol."""
    f = facts.where("anchor is not null and anchor <> ''").select("group_id", F.col("id").alias("fact_id"), F.col("anchor").alias("symbol")).distinct()
    c = chunks.where("valid").select("group_id", "symbol", F.col("id").alias("chunk_id")).distinct()
    return f.join(c, ["group_id", "symbol"]).select("group_id", "fact_id", "chunk_id")


def reach(edges: DataFrame, starts: DataFrame, chunks: DataFrame, depth: int, limit: int | None = schema.MAX_REACHED, backwards: bool = False) -> DataFrame:
    """``id, depth``: valid chunks within 1..depth calls of any start (its callees; ``backwards`` its
    callers), with the least number of calls. A start is returned if it lies on a cycle; chunks on the
    way need not be valid. ``limit`` is the reporting limit, in the order of depth and id."""
    src, dst = ("dst_id", "src_id") if backwards else ("src_id", "dst_id")
    step = edges.select(F.col(src).alias("id"), F.col(dst).alias("to")).distinct()
    frontier = starts.select("id").distinct()
    seen = None
    for n in range(1, max(1, min(depth, schema.MAX_DEPTH)) + 1):
        found = frontier.join(step, "id").select(F.col("to").alias("id")).distinct()
        if seen is not None:
            found = found.join(seen, "id", "left_anti")
        found = stage(found.withColumn("depth", F.lit(n)), "frontier")
        if found.isEmpty():
            break
        seen = found if seen is None else seen.unionByName(found)
        frontier = found.select("id")
    if seen is None:
        return starts.select("id", F.lit(0).alias("depth")).where("false")
    ok = seen.join(chunks.where("valid").select("id").distinct(), "id", "left_semi")
    return ok.orderBy("depth", "id").limit(limit) if limit else ok


DETAILS = ("symbol", "path", "kind", "signature", "start_line", "end_line")


def _around(chunks: DataFrame, edges: DataFrame, symbol: str, group_id: str, depth: int, backwards: bool) -> DataFrame:
    mine = chunks.where((F.col("group_id") == group_id) & F.col("valid"))
    starts = mine.where(symbol_match(F.col("symbol"), F.lit(symbol))).select("id")
    # the group's chunks are the targets; what lies between them need not be valid
    found = reach(edges.where(F.col("group_id") == group_id), starts, mine, depth, backwards=backwards)
    return found.join(mine.select("id", *DETAILS).dropDuplicates(["id"]), "id").select("id", *DETAILS, "depth")


def impact_of(chunks: DataFrame, edges: DataFrame, symbol: str, group_id: str, depth: int = 3) -> DataFrame:
    """``id, symbol, path, kind, signature, start_line, end_line, depth``: the valid chunks of a group that
    those of a symbol (itself, or the last part of a dotted one) reach by calls, nearest first up to the
    reporting limit. An unknown symbol gives no rows."""
    return _around(chunks, edges, symbol, group_id, depth, False)


def callers_of(chunks: DataFrame, edges: DataFrame, symbol: str, group_id: str, depth: int = 1) -> DataFrame:
    """The same for the chunks that call those of a symbol, at ``depth`` 1 directly."""
    return _around(chunks, edges, symbol, group_id, depth, True)


def neighbours(edges: DataFrame, files: DataFrame, path: str, backwards: bool = False, limit: int = schema.MAX_NEIGHBOURS) -> DataFrame:
    """``path, ext`` of the files that a file imports (``backwards``: that import it), by path."""
    here, there = ("dst_id", "src_id") if backwards else ("src_id", "dst_id")
    me = files.where(F.col("path") == path).select(F.col("id").alias(here)).distinct()
    other = files.select(F.col("id").alias(there), "path", "ext")
    return edges.join(F.broadcast(me), here).join(other, there).select("path", "ext").distinct().orderBy("path").limit(limit)


def purge(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges but those that start at one of ``gone.id``."""
    return edges.join(gone.select(F.col("id").alias("src_id")).distinct(), "src_id", "left_anti").select(*edges.columns)


def rebuild(edges: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """The edges after ``changed.id`` were read again: their old outgoing edges go, the fresh ones come."""
    return purge(edges, changed).unionByName(fresh.select(*edges.columns)).distinct()


def build(source_files: DataFrame, files: DataFrame, chunks: DataFrame, now: int) -> dict[str, DataFrame]:
    """A whole project's graph: ``files`` (the file nodes, targets of imports included), ``imports``, ``calls``
    and one row of ``counters`` (files, imports, calls_candidates, errors: files without content)."""
    from basalt.operators import imports, upsert

    read = source_files.where("path is not null").select("path", "content").dropDuplicates(["path"])
    known = files.where("path is not null").select("group_id", "path").distinct()
    edges = stage(import_edges(imports.extract(read.where("content is not null")), files), "imports")
    incoming = read.select("path", paths.extension(F.col("path")).alias("ext"), ids.file_id(F.col("path")).alias("id")).join(known, "path", "left")
    sites = call_sites(chunks.where("valid"))
    one = read.agg(F.count_if(F.col("content").isNotNull()).alias("files"), F.count_if(F.col("content").isNull()).alias("errors"))
    counters = one.crossJoin(F.broadcast(edges.agg(F.count("*").alias("imports")))).crossJoin(F.broadcast(sites.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("calls_candidates"))))
    return {"files": upsert.files(files, incoming, now), "imports": edges, "calls": call_edges(chunks), "counters": counters.select("files", "imports", "calls_candidates", "errors")}


def status(files: DataFrame, calls: DataFrame, imports: DataFrame) -> DataFrame:
    """``what, n``: files, call edges and import edges."""
    out = None
    for name, df in (("files", files.select("id").distinct()), ("calls", calls), ("imports", imports)):
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out
