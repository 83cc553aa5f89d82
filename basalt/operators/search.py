"""Vector, lexical and fused search.

Scores are cosine similarities (higher is closer). A search over-fetches ``2k`` rows of each list,
filters afterwards, as an index would (``prefilter`` turns that round), and fuses the lists by
reciprocal rank. The scans are exact: Spark keeps k rows per task (TakeOrderedAndProject) and reads
only the columns named. Nothing is written here; ``facts.access_bump`` is the explicit write.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basalt import schema
from basalt.functions import text, vectors


def knn(df: DataFrame, query: Sequence[float], k: int, keep: Column | None = None, id_: str = "id", emb: str = "emb", prefilter: bool = False, limit: int | None = None, group: str | None = None) -> DataFrame:
    """``id, sim``: the ``k`` nearest rows, then those of them that ``keep``; ``limit`` cuts last. With ``group``
    only that group's rows are searched, as each has an index of its own."""
    df = within(df, group)
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = df.withColumn("sim", vectors.cosine(vectors.pad(F.col(emb), len(query)), q)).where("sim is not null")
    flag = F.coalesce(keep, F.lit(False)) if keep is not None else F.lit(True)
    if prefilter:
        scored = scored.where(flag)
    top = scored.select(id_, "sim", flag.alias("kept")).orderBy(F.desc("sim"), id_).limit(k)
    out = top.where("kept").select(id_, F.round("sim", 6).alias("sim"))
    return out.orderBy(F.desc("sim"), id_).limit(limit) if limit else out


def lexical(df: DataFrame, words: Sequence[str], k: int, keep: Column | None = None, fields: Sequence[str] = ("content",), id_: str = "id", group: str | None = None) -> DataFrame:
    """``id, score``: rows by how many distinct query words they hold; ties by id."""
    df = within(df, group)
    held = F.array_intersect(text.tokens(F.concat_ws(" ", *fields)), F.array(*(F.lit(w.lower()) for w in dict.fromkeys(words))))
    flag = F.coalesce(keep, F.lit(False)) if keep is not None else F.lit(True)
    return df.withColumn("score", F.size(held)).where((F.col("score") > 0) & flag).select(id_, "score").orderBy(F.desc("score"), id_).limit(k)


def rrf(lists: Sequence[DataFrame], k: int, id_: str = "id", constant: int = schema.RRF_K) -> DataFrame:
    """Fuses ranked lists ``(id, score)``: the sum of ``1 / (constant + rank)``, rank from 0. Ties go to
    the earlier list, then the better rank in it. The inputs are top lists of bounded length."""
    ranked = None
    for n, one in enumerate(lists):
        order = W.orderBy(F.desc(one.columns[1]), id_)
        part = one.select(id_, (F.row_number().over(order) - 1).alias("rank"), F.lit(n).alias("list"))
        ranked = part if ranked is None else ranked.unionByName(part)
    fused = ranked.groupBy(id_).agg(F.sum(1.0 / (F.lit(constant) + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    return fused.orderBy(F.desc(F.round("score", 12)), "first").limit(k).select(id_, F.round("score", 6).alias("score"))


def within(df: DataFrame, group: str | None) -> DataFrame:
    return df if group is None else df.where(F.col("group_id") == group)


def hybrid_code(chunks: DataFrame, query: Sequence[float], words: Sequence[str], k: int = 10, model: str | None = None, group: str | None = None) -> DataFrame:
    """Vectors of ``model`` (all, if None) and words of all chunks, fused."""
    near = knn(of_model(chunks, model), query, 2 * k, F.col("valid"), group=group)
    said = lexical(chunks, words, 2 * k, F.col("valid"), ("symbol", "signature"), group=group)
    return rrf([near, said], k)


def hybrid_facts(facts: DataFrame, query: Sequence[float], words: Sequence[str], now: int, k: int = 10, model: str | None = None, group: str | None = None) -> DataFrame:
    near = knn(of_model(facts, model), query, 2 * k, temporal(now), group=group)
    said = lexical(facts, words, 2 * k, temporal(now), group=group)
    return rrf([near, said], k)


def of_model(df: DataFrame, model: str | None) -> DataFrame:
    return df if model is None else df.where(F.col("emb_model") == model)


def anchored(facts: DataFrame, query: Sequence[float], symbol: str | None, now: int, candidates: int = 20, k: int = 10, group: str | None = None) -> DataFrame:
    """The nearest ``candidates``, of them those at the anchor and valid, at most ``k``."""
    keep = temporal(now) if symbol is None else temporal(now) & (F.col("anchor") == symbol)
    return knn(facts, query, candidates, keep, limit=k, group=group)


def temporal(now: int) -> Column:
    """``valid_from <= now < invalid_at``; a NULL end is open."""
    return (F.col("valid_from") <= now) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > now))


def symbol_match(symbol: Column, wanted: Column) -> Column:
    return (symbol == wanted) | symbol.endswith(F.concat(F.lit("."), wanted))


def near_duplicates(probes: DataFrame, facts: DataFrame, now: int, threshold: float = schema.NEAR_DUPLICATE, block: int = 4096, slice_: int = 65_536) -> DataFrame:
    """``id, status, existing_id, sim``: each probe against the nearest fact before it of its group and model.
    As in the index, the nearest counts first and its validity is asked afterwards.

    The probes are a stated query set. Facts of one group and model lie in slices of about ``slice_`` rows,
    probes in blocks of about ``block``; a task multiplies a block with a slice and keeps one row a
    probe, so a hot group is many tasks and nothing comes to the driver but two counts.
    """
    import numpy as np
    import pyarrow as pa

    cols = ["id", "group_id", "emb_model", "emb", "created_at"]
    asked = probes.where("emb is not null and emb_model is not null and group_id is not null").select(*cols).dropDuplicates(["id"])
    # new names throughout, as probes may be rows of the same table
    base = facts.where("emb is not null and emb_model is not null and group_id is not null").select(*cols, temporal(now).alias("ok")).dropDuplicates(["id"])
    base = base.select(*(F.col(c).alias(f"_{c}") for c in base.columns)).toDF(*base.columns)
    key = ["group_id", "emb_model"]

    def parts(df: DataFrame, size: int) -> int:
        return max(1, -(-(df.groupBy(*key).count().agg(F.max("count")).collect()[0][0] or 0) // size))

    slices, blocks = parts(base, slice_), parts(asked, block)

    def numbered(df: DataFrame, mine: str, n: int, other: str, m: int) -> DataFrame:
        return df.withColumn(mine, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    def unit(column: pa.ChunkedArray, dim: int) -> np.ndarray:
        out = np.zeros((len(column), dim))
        for i, v in enumerate(column.to_pylist()):
            out[i, : min(dim, len(v))] = v[:dim]
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.where(size > 0, out / np.where(size > 0, size, 1), np.nan)

    def best(asked_: pa.Table, base_: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if asked_.num_rows and base_.num_rows:
            dim = max(len(v) for t in (asked_, base_) for v in t["emb"].to_pylist())
            x, y = unit(asked_["emb"], dim), unit(base_["emb"], dim)
            ids, ok = base_["id"].to_pylist(), base_["ok"].to_pylist()
            # facts in the order of (id), so that the first of equal cosines has the least id
            order = np.array(sorted(range(len(ids)), key=ids.__getitem__), np.int64)
            rank = {(m, i): n for n, (m, i) in enumerate(sorted({*zip(base_["created_at"].to_pylist(), ids, strict=True), *zip(asked_["created_at"].to_pylist(), asked_["id"].to_pylist(), strict=True)}, key=lambda r: (r[0] is None, r)))}
            mine = np.array([rank[r] for r in zip(asked_["created_at"].to_pylist(), asked_["id"].to_pylist(), strict=True)])
            theirs = np.array([rank[r] for r in zip(base_["created_at"].to_pylist(), ids, strict=True)])[order]
            for a in range(0, len(x), 512):
                s = np.round(x[a : a + 512] @ y[order].T, 6)
                s[np.isnan(s) | (theirs[None, :] >= mine[a : a + 512, None])] = -2
                at = s.argmax(axis=1)
                for r in np.flatnonzero(s[np.arange(len(s)), at] > -2):
                    k = int(order[at[r]])
                    rows.append((asked_["id"][int(a + r)].as_py(), float(s[r, at[r]]), ids[k], ok[k]))
        i, s, e, o = zip(*rows, strict=True) if rows else ((),) * 4
        return pa.table({"id": pa.array(i, pa.string()), "sim": pa.array(s, pa.float64()), "existing_id": pa.array(e, pa.string()), "ok": pa.array(o, pa.bool_())})

    p = numbered(asked, "block", blocks, "slice", slices).groupBy(*key, "slice", "block")
    b = numbered(base, "slice", slices, "block", blocks)
    b = b.toDF(*(f"{c}_" if c in (*key, "slice", "block") else c for c in b.columns)).groupBy(*(f"{c}_" for c in (*key, "slice", "block")))
    found = p.cogroup(b).applyInArrow(best, "id string, sim double, existing_id string, ok boolean")
    top = found.groupBy("id").agg(F.min(F.struct((-F.col("sim")).alias("far"), "existing_id", "ok")).alias("x"))
    dup = (F.coalesce(-F.col("x.far"), F.lit(-1.0)) >= threshold) & F.coalesce(F.col("x.ok"), F.lit(False))
    return asked.select("id").join(top, "id", "left").select(
        "id",
        F.when(dup, F.lit("duplicate")).otherwise(F.lit("new")).alias("status"),
        F.when(dup, F.col("x.existing_id")).alias("existing_id"),
        F.when(dup, -F.col("x.far")).alias("sim"),
    )
