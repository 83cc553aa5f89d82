"""Filling fixed-capacity containers.

Method. Vector best-fit, decreasing: an item takes tokens, one document place and an attention cost
(the square of its tokens) from a container. Of all containers that can take it under every
constraint it goes to the fullest: the one whose residuals (tokens after the item, places and attention
before it, each as a share of its capacity) have the least weighted square norm. Open containers lie in
a heap for each token residual, so the whole set is ranked and none is passed over.
No attention capacity that admits an item of the full token capacity can bind, as sizes that sum to at most the
capacity have squares that sum to at most its square; it binds where a caller sets it lower, and an item
above it alone gets a container of its own.

The token counts are taken where the texts lie; only (key, piece, tokens) is shuffled, to shards of
about ``per_shard`` items by a hash of the key, and each shard is packed by itself. A shard leaves a
handful of containers that are not full, so what sharding costs shrinks with ``per_shard``. Texts
above the capacity are cut by ``splitting.pieces`` without overlap; no smaller text is split.

Defined results: a NULL, empty or blank text has no tokens and takes one place in a container;
repeated rows are packed once each; order of input does not matter, ties go by key and piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from basalt.llm import splitting, tokens

CAPACITY = 2048


#: weights of the residuals of tokens, places and attention
WEIGHTS = (64.0, 1.0, 1.0)


class Bins:
    """Open containers in a heap for each token residual; a bit mask tells which residuals there are."""

    def __init__(self, capacity: int, places: int, attention: int, weights: tuple[float, float, float] = WEIGHTS):
        self.capacity, self.places, self.attention, self.weights = capacity, places, attention, weights
        self.by_residual: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
        self.mask = 0
        self.left: list[list[int]] = []

    def _norm(self, b: int) -> float:
        _, p, a = self.left[b]
        return self.weights[1] * (p / self.places) ** 2 + self.weights[2] * (a / self.attention) ** 2

    def put(self, size: int) -> int:
        cost = min(size * size, self.attention)
        best, norm, at = -1, 0.0, -1
        rest = self.mask >> size
        while rest:
            r = size + (rest & -rest).bit_length() - 1
            least = self.weights[0] * ((r - size) / self.capacity) ** 2
            if best >= 0 and least >= norm:
                break
            heap, passed = self.by_residual[r], []
            while heap and self.left[heap[0][1]][2] < cost:
                passed.append(heappop(heap))
            if heap and (best < 0 or least + heap[0][0] < norm):
                best, norm, at = heap[0][1], least + heap[0][0], r
            for x in passed:
                heappush(heap, x)
            rest &= rest - 1
        if best >= 0:
            heap, passed = self.by_residual[at], []
            while heap[0][1] != best:  # those above it have too little attention left
                passed.append(heappop(heap))
            heappop(heap)
            for x in passed:
                heappush(heap, x)
            if not heap:
                self.mask &= ~(1 << at)
            b = best
        else:
            b = len(self.left)
            self.left.append([self.capacity, self.places, self.attention])
        left = self.left[b]
        left[0] -= size
        left[1] -= 1
        left[2] -= cost
        if left[1] > 0:
            heappush(self.by_residual[left[0]], (self._norm(b), b))
            self.mask |= 1 << left[0]
        return b


def pack(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    places: int = 128,
    attention: int | None = None,
    per_shard: int = 25_000,
) -> DataFrame:
    """key, ``piece`` (0 unless the text is above the capacity), ``n_tokens``, character range
    [start, stop) and ``container``, a number unique over all shards."""
    attention = attention or capacity * capacity
    kind = df.schema[key].dataType
    arrow = to_arrow_type(kind)
    names = [key, "piece", "n_tokens", "start", "stop"]
    types = [arrow, pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = t or ""
                n = tokens.count(t)
                parts = [(0, len(t), n, 0)] if n <= capacity else splitting.pieces(t, capacity, 0, fill=0.9)
                for i, (a, z, m, _) in enumerate(parts):
                    for c, v in zip(cols, (k, i, m, a, z), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    items = df.select(F.col(key), F.col(text)).mapInArrow(measure, f"{key} {kind.simpleString()}, piece int, n_tokens int, start bigint, stop bigint")
    shards = max(1, -(-df.count() // per_shard))

    def fill(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["n_tokens"].to_pylist(), map(str, table[key].to_pylist()), table["piece"].to_pylist(), range(table.num_rows), strict=True), key=lambda r: (-r[0], r[1], r[2]))
        bins, where = Bins(capacity, places, attention), [0] * table.num_rows
        for size, _, _, i in rows:
            where[i] = bins.put(size)
        shard = table["shard"].to_pylist()
        box = pa.array([s * (1 << 32) + w for s, w in zip(shard, where, strict=True)], pa.int64())
        return table.drop(["shard"]).append_column("container", box)

    out = f"{key} {kind.simpleString()}, piece int, n_tokens int, start bigint, stop bigint, container bigint"
    sharded = items.withColumn("shard", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(shards)).cast("bigint"))
    return sharded.groupBy("shard").applyInArrow(fill, out)
