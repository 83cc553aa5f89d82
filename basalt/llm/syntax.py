"""Source files that do not parse.

Method. Every file is read by the lexer of its suffix and recognised by a generalised LL parser
(``gll``), which runs all start rules given to it together; a file is flagged if all of them reject
it. The test tables name one dialect per suffix (Python 3, ECMAScript modules and so on), so each
language has one start rule here; what a looser dialect would let through is to be flagged. For Python and JSON an exact check follows: a file that the
grammar rejects is handed to the language's own parser, which alone may clear it.

Files are independent, so the scan is one pass without a shuffle of contents; only the dropping of
repeated paths and the rates are shuffled, as narrow rows.

Defined results: NULL, empty, blank and comment-only files are valid (an empty JSON file too); a
byte-order mark is dropped and line ends are made ``\\n``; bytes that are not UTF-8 are read as Latin-1
unless they hold NUL, which is no text; suffixes without a grammar and NULL paths give ``valid`` NULL.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm import gll, grammars, lexers

SUFFIXES = {"py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "ts": "typescript", "mts": "typescript", "go": "go", "java": "java", "c": "c", "h": "c", "sh": "bash", "bash": "bash", "yaml": "yaml", "yml": "yaml", "json": "json"}


@lru_cache(maxsize=1)
def _script() -> gll.Grammar:
    def at_end(tokens, pos, w):
        return tokens[pos] in ends or w.breaks[pos]

    looks = {
        "ASI": at_end,
        "TS": lambda tokens, pos, w: w.typed,
        "PLAIN": lambda tokens, pos, w: tokens[pos] not in blocked,
        "NOBRACE": lambda tokens, pos, w: tokens[pos] != brace,
        "SAME": lambda tokens, pos, w: not w.breaks[pos],
        "SAMELINE": lambda tokens, pos, w: not w.breaks[pos],
        "CLOSE": lambda tokens, pos, w: tokens[pos] == close,
        "NEWTARGET": lambda tokens, pos, w: pos > 0 and tokens[pos - 1] == new,
    }
    g = gll.Grammar(grammars.SCRIPT, looks)
    t = g.terms
    ends = {t["}"], g.term("EOF")}
    blocked = {t["{"], t["function"], t["class"]}
    brace, close, new = t["{"], t["]"], t["new"]
    return g


@lru_cache(maxsize=None)
def _grammar(name: str) -> gll.Grammar:
    return gll.Grammar(getattr(grammars, name))


def _accepted(lang: str, text: str) -> bool:
    try:
        if lang in ("javascript", "typescript"):
            g = _script()
            tokens, words = lexers.script(text, g, lang == "typescript")
            return g.accepts(tokens, ("module",), words)[0]
        if lang == "bash":
            g = _grammar("SHELL")
            return all(g.accepts(x, ("script", "sub"))[0] for x in lexers.shell(text, g))
        name, lexer, start = {
            "python": ("PYTHON", lexers.python, "module"),
            "json": ("JSON", lexers.json, "json"),
            "go": ("GO", lexers.go, "file"),
            "java": ("JAVA", lexers.java, "file"),
            "c": ("C", lexers.c, "file"),
            "yaml": ("YAML", lexers.yaml, "stream"),
        }[lang]
        g = _grammar(name)
        return g.accepts(lexer(text, g), (start,))[0]
    except lexers.LexError:
        return False


COMMENTS = {
    "go": re.compile(r"(?:\s|//[^\n]*|/\*[\s\S]*?\*/)*"),
    "json": re.compile(r"\s*"),
    "java": re.compile(r"(?:\s|//[^\n]*|/\*[\s\S]*?\*/)*"),
}


def decode(raw: bytes) -> str:
    try:
        text = raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
    return text.replace("\r\n", "\n").replace("\r", "\n")


def valid(path: str | None, raw: bytes | None) -> bool | None:
    """Whether a file is valid for its suffix; None where there is no grammar for it."""
    base = (path or "").rsplit("/", 1)[-1]
    lang = SUFFIXES.get(base.rsplit(".", 1)[-1].lower()) if "." in base else None
    if lang is None:
        return None
    if not raw or not raw.strip():
        return True
    if b"\0" in raw:
        return False
    text = decode(raw)
    if lang in COMMENTS and COMMENTS[lang].fullmatch(text):
        return True
    if _accepted(lang, text):
        return True
    if lang == "python":
        try:
            ast.parse(text)
            return True
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
    if lang == "json":
        try:
            json.loads(text, parse_constant=_no_constant)
            return True
        except (ValueError, RecursionError):
            return False
    return False


def _no_constant(x: str) -> None:
    raise ValueError(x)


def checked(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``path, lang, valid``: one row per distinct path."""
    slim = df.where(F.col(path).isNotNull()).select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sys

        sys.setrecursionlimit(10_000)
        for b in batches:
            paths = b.column(0).to_pylist()
            langs = [SUFFIXES.get(p.rsplit(".", 1)[-1].lower()) if "." in p.rsplit("/", 1)[-1] else None for p in paths]
            ok = [valid(p, c) for p, c in zip(paths, b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(ok, pa.bool_())], names=["path", "lang", "valid"])

    return slim.mapInArrow(run, "path string, lang string, valid boolean").dropDuplicates(["path"])


def broken(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    return checked(df, path, content).where("not valid").select("path")


def rates(df: DataFrame, files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``group_id, lang, files, broken, rate``; files of no known group come out under NULL."""
    groups = files.where("path is not null").groupBy("path").agg(F.min("group_id").alias("group_id"))
    found = checked(df, path, content).where("valid is not null").join(groups, "path", "left")
    return found.groupBy("group_id", "lang").agg(F.count("*").alias("files"), F.sum(F.when(~F.col("valid"), 1).otherwise(0)).alias("broken")).withColumn("rate", F.round(F.col("broken") / F.col("files"), 6))
