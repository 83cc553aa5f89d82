"""Column functions on source text, transcripts and JSON. Lines end at ``\\n``; white space is ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n\f"
#: a line of nothing but comment marks and rules
SEPARATOR = r"^[\s#/*\-=~`]{5,}\s*$"


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANKS))


def lines(x: Column) -> Column:
    return F.split(x, "\n", -1)


def strip_noise(x: Column) -> Column:
    return F.array_join(F.filter(lines(x), lambda line: ~line.rlike(SEPARATOR)), "\n")


def signature(x: Column) -> Column:
    """The first line that is not blank, at most 200 characters; '' if there is none."""
    full = F.filter(F.transform(lines(x), strip), lambda line: line != "")
    return F.when(x.isNotNull(), F.coalesce(F.substring(F.get(full, F.lit(0)), 1, 200), F.lit("")))


def line_slice(x: Column, first: Column, last: Column) -> Column:
    """Lines first..last, counted from 1, clamped to the text."""
    all_ = lines(x)
    lo = F.greatest(F.lit(1), first)
    hi = F.least(F.size(all_), last)
    return F.when(hi >= lo, F.array_join(F.slice(all_, lo, hi - lo + 1), "\n")).otherwise(F.when(x.isNotNull(), F.lit("")))


def tokens(x: Column) -> Column:
    """Distinct lower-case words of ASCII letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", -1), lambda w: w != ""))


def cut(x: Column, n: int) -> Column:
    return F.substring(x, 1, n)


def tail(x: Column, n: int) -> Column:
    """The last ``n`` characters."""
    return F.when(F.length(x) > n, F.right(x, F.lit(n))).otherwise(x)


def flatten_content(raw: Column) -> Column:
    """Message content as text: a JSON string as it is; of a list, the texts of its blocks and its bare
    strings, joined by blanks; any other value as it is written."""
    blocks = F.from_json(raw, "array<string>")
    text = F.transform(
        blocks,
        lambda b: F.when(b.startswith("{"), F.when(F.get_json_object(b, "$.type") == "text", F.get_json_object(b, "$.text")).otherwise(F.lit(""))).otherwise(b),
    )
    joined = F.array_join(F.filter(text, lambda t: t.isNotNull() & (strip(t) != "")), " ")
    return F.when(F.ltrim(raw).startswith("["), joined).otherwise(raw)


def message(line: Column) -> tuple[Column, Column]:
    """Role and text of one line of a transcript; the envelope ``message`` is taken off, the role falls
    back to ``type``. Malformed lines give NULL."""
    inner = F.coalesce(F.get_json_object(line, "$.message"), line)
    role = F.coalesce(F.get_json_object(inner, "$.role"), F.get_json_object(line, "$.type"))
    return role, flatten_content(F.get_json_object(inner, "$.content"))


def porcelain_path(line: Column) -> Column:
    """The path of a ``git status --porcelain`` line: after two status letters and a blank."""
    path = F.substring(line, 4, 1_000_000)
    return F.when(F.instr(path, " -> ") > 0, F.substring_index(path, " -> ", -1)).otherwise(path)
