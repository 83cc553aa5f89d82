"""Splitting oversized texts at natural boundaries.

Method. Token offsets are prefix sums over the text; the natural boundaries (blank line, line break,
end of sentence, white space, in falling rank) are sorted arrays of token numbers. A piece ends at
the last boundary of the best rank under the limit, found by binary search, if that fills at least
``fill`` of the limit; without any boundary it is cut hard at the limit. The next piece steps back
by at most ``overlap`` tokens, to a sentence's or line's start where one lies there.

A text is read by one task, whole; nothing is shuffled. Defined results: NULL, empty and blank texts
and texts within the limit give no pieces from ``split`` unless ``keep_small``; repeated rows give
their pieces each time; ids may be NULL and pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.llm import tokens

# Chosen here: what ends a unit of text, best first.
BOUNDARIES = (
    re.compile(r"\n[ \t\r]*\n\s*"),
    re.compile(r"\n"),
    re.compile(r"[.!?;:。！？]+[\"'”»)\]]*(?=\s)|[。！？]"),
    re.compile(r"\s+"),
)


def boundaries(text: str, starts: np.ndarray) -> list[np.ndarray]:
    """For each rank, sorted token numbers before which a cut may fall."""
    out = []
    for pattern in BOUNDARIES:
        ends = np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)
        out.append(np.unique(np.searchsorted(starts, ends, side="left")))
    return out


def pieces(text: str, limit: int, overlap: int, fill: float = 0.5) -> list[tuple[int, int, int, int]]:
    """(char start, char end, tokens, tokens repeated from the piece before) of each piece."""
    starts, ends = tokens.offsets(text)
    n = len(starts)
    if n == 0:
        return []
    ranks = boundaries(text, starts) if n > limit else []
    out, at, kept = [], 0, 0
    while True:
        stop = n
        if n - at > limit:
            stop = at + limit
            floor = at + max(int(limit * fill), kept + 1)
            for b in ranks:
                k = int(np.searchsorted(b, at + limit, side="right")) - 1
                if k >= 0 and b[k] >= floor:
                    stop = int(b[k])
                    break
        out.append((int(starts[at]), int(ends[stop - 1]), stop - at, kept))
        if stop >= n:
            return out
        back = max(at + 1, stop - overlap)
        for b in ranks[:3]:
            k = int(np.searchsorted(b, back, side="left"))
            if k < len(b) and b[k] < stop:
                back = int(b[k])
                break
        if not overlap:
            back = stop
        kept, at = stop - back, back


PIECE = "piece int, start bigint, stop bigint, n_tokens int, n_repeated int"


def split(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 1024, overlap: int = 64, keep_small: bool = False) -> DataFrame:
    """Pieces of every text above ``limit`` tokens: key, ``piece`` from 0, character range
    [start, stop), tokens, and tokens repeated from the piece before. With ``keep_small`` every
    text of at least one token comes out, a small one as one piece."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    kind = df.schema[key].dataType
    slim = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    if not keep_small:
        # a text has no more tokens than characters, so the scan drops most small texts unread
        slim = slim.where(F.length("t") > limit)
    ktype = T.StructType([T.StructField("k", kind)])
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(ktype["k"].dataType)
    names = [key, "piece", "start", "stop", "n_tokens", "n_repeated"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not keep_small and tokens.count(t) <= limit:
                    continue
                for i, p in enumerate(pieces(t, limit, overlap)):
                    for c, v in zip(cols, (k, i, *p), strict=True):
                        c.append(v)
            types = [arrow, pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return slim.mapInArrow(run, f"{key} {kind.simpleString()}, {PIECE}")


def oversized(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 1024, overlap: int = 64) -> DataFrame:
    """Keys of the texts that ``split`` cuts, once each."""
    return split(df, key, text, limit, overlap).where("piece = 0").select(key).distinct()
