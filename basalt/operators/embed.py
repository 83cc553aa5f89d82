"""Encoding texts by a model that the user brings; without one, vectors come as a column."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from basalt import schema

Encoder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def encode(df: DataFrame, text: str, load: Callable[[], Encoder], out: str = "emb", batch: int = 32) -> DataFrame:
    """Adds ``out``: the encoder's vector of each text, at most ``schema.MAX_DIM`` long; NULL for NULL.

    ``load`` runs once per Python worker and returns the encoder, which gets at most ``batch`` texts."""
    at = df.columns.index(text)
    fields = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load()
        for b in batches:
            texts = b.column(at).to_pylist()
            known = [i for i, x in enumerate(texts) if x is not None]
            vectors: list = [None] * len(texts)
            for k in range(0, len(known), batch):
                part = known[k : k + batch]
                for i, v in zip(part, encoder([texts[i] for i in part]), strict=True):
                    vectors[i] = [float(x) for x in v][: schema.MAX_DIM]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*b.schema.names, out])

    return df.mapInArrow(run, fields)
