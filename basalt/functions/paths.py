"""Column functions on paths with ``/``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def stem(path: Column) -> Column:
    """The name without its last suffix; a leading dot belongs to the name."""
    return F.regexp_replace(base(path), r"(.)\.[^.]*$", "$1")


def extension(path: Column) -> Column:
    return F.regexp_extract(base(path), r".\.([^.]+)$", 1)


def normalize(path: Column) -> Column:
    """Collapses ``.`` and ``..``; above the root ``..`` is dropped."""
    rooted = path.startswith("/")
    parts = F.aggregate(
        F.filter(F.split(path, "/", -1), lambda p: ~p.isin("", ".")),
        F.array().cast("array<string>"),
        lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when((p == "..") & rooted, acc)
        .otherwise(F.concat(acc, F.array(p))),
    )
    return F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/"))
