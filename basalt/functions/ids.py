"""Identifiers: prefixes of SHA-256 over what names a thing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hash(x: Column, n: int) -> Column:
    return F.substring(F.sha2(x, 256), 1, n)


def chunk_id(path: Column, symbol: Column) -> Column:
    return _hash(F.concat(path, F.lit("::"), symbol), 32)


def file_id(path: Column) -> Column:
    return _hash(path, 32)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def group_id(remote: Column, path: Column) -> Column:
    """Of the remote's URL, or of the absolute path where there is none."""
    url = F.btrim(remote)
    return _hash(F.coalesce(F.when(url != "", url), path), 16)


def fact_id(group: Column, content: Column, created_at: Column) -> Column:
    """A repeatable id for a new fact, so that writing a batch again writes the same rows."""
    return _hash(F.concat_ws("\u0001", group, content, created_at.cast("string")), 32)
