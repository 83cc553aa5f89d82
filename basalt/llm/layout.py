"""Generated, minified, vendored and data-only source files.

Method. Per file: layout statistics (longest and mean line, white-space share, alphanumeric share,
density of numeric literals, longest run of encoded text, share of lines that repeat another line's
shape, share of text in rows of numbers, share of the two commonest line shapes where lines return things) against
thresholds per language, together with the file's place and the words of its comments, wherever in the file they stand.
One pass over each whole file in Arrow batches; nothing is shuffled but the dropping of repeated
paths, whose rows are the same. Statistics are counted in bytes: white space is ASCII, alphanumeric are ASCII
letters and digits and every byte beyond ASCII.

Defined results: NULL or empty content is hand-written (no statistics, place still counts); bytes
that are not UTF-8 are decoded with replacement; a NULL path has no place and no language; files of suffixes
without thresholds are judged by place and words if they are source (``SOURCE``), and configuration is never a case.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Chosen here: folders that by custom hold third-party copies or tools' output.
VENDORED = frozenset(
    "vendor vendors _vendor vendored third_party third-party thirdparty 3rdparty node_modules bower_components "
    "jspm_packages extern external externals deps site-packages pods carthage godeps".split()
)
GENERATED = frozenset("gen generated autogen auto_generated _generated __generated__ generated_src generated-sources".split())
NAMES = re.compile(
    r"(?i)(_pb2(_grpc)?\.pyi?|\.pb\.(go|c|cc|h)|\.min\.(js|mjs|css)|[._-]generated\.\w+|\.gen\.\w+|_gen\.(go|py|ts|js)|\.g\.(ts|dart|cs)|"
    r"\.designer\.cs|zz_generated\.\w+|_string\.go|_autogen\.\w+|_pb\.\w+|Grpc\.java|OuterClass\.java|[.\-](bundle|chunk)\.js|-[0-9a-f]{8,}\.(js|css|ts))$"
)
# Chosen here: wordings by which tools mark their output and projects their copies, and words that one of them always has.
MADE = re.compile(
    r"(?i)(@generated\b|<auto-?generated|auto-?generated\s+(file|by|code|from)|code generated (by|from)|generated (by|at build time|from)\b.{0,60}(do not|don't|v?\d+\.\d|\.(proto|tpl|schema|idl|g4|yaml|json))|"
    r"(this|the) (file|code|class|module) (is|was|has been) (auto-?matically |machine-?)?generated\b|automatically generated|machine generated|do not (edit|modify)( this file)? by hand|generated (file|code|source)[ ,;:.\-]+(do not|don't)|"
    r"output of \w+[;,] (regenerate|do not)|regenerate (it )?with\b|autogenerated|produced by \w+ v?\d|"
    r"machine[ -]made (from|by)|(hand|manual) edits (are|will be) (overwritten|lost)|sourceMappingURL=|"
    r"(automatically )?(written|emitted|created|compiled|rendered|derived) by (a script|a tool|a program|\w+[;,] (changes|source|see|from))|changes will be (lost|overwritten)|source of truth is \S+\.\w+|"
    r"produit(e)? par \w+ a partir de|ne pas modifier|erzeugt (von|aus|mit)|nicht (bearbeiten|aendern|ändern)|generado por|no (editar|modificar)|généré (par|automatiquement)|genere (par|automatiquement))"
)
COPIED = re.compile(
    r"(?i)(imported (unchanged|verbatim|without changes) from|"
    r"copyright \(c\) [\d\- ,]*+[\w .]*(?<=[\w .])(?<!\(c\) )\. redistribution and use|redistribution and use in source and binary forms|copied (unchanged|verbatim|from upstream)|"
    r"(?<!\d)v?\d++\.\d++\.\d++ - .{3,80} - https?://\S+ - (released|licensed|distributed) under|vendored (from|copy)|^[\W_]*!\s*\w+ v\d+\.\d+|upstream (commit|version|revision|release)|(released|distributed|licensed) under (the )?(mit|bsd|apache|gpl|lgpl|mpl|isc)\b)"
)
#: the same in two parts, the second anywhere after the first: one search each, as a line may repeat the first
COPIED_BY = (
    (re.compile(r"(?i)\(c\) (the )?[\w ]+? (authors|contributors|developers)\b"), re.compile(r"(?i)licen[cs]e")),
    (re.compile(r"(?i)spdx-license-identifier:"), re.compile(r"(?i)\b(upstream|vendored|from)\b")),
)
PART_OF, RELEASE = re.compile(r"(?i)this file is part of ([\w ]++)"), re.compile(r"(?i)[\w ] v?\d")
STEMS = (
    "generat", "generé", "généré", "genere", "generado", "edit", "modif", "bearbeiten", "ndern", "output of", "produced by", "produit", "machine", "sourcemappingurl", "written", "emitted",
    "created", "compiled", "rendered", "derived", "changes will be", "source of truth", "erzeugt", "copyright", "(c)", "spdx", "imported", "part of", "redistribution", "copied", "licen",
    "released", "distributed", "vendored", "upstream", "! ", "!",
)
OURS = re.compile(r"(?i)\b(our own|we (add|check|write|vendor|generate)|is hand-?written|kept by hand)\b")

LANGUAGES = {"py": "py", "pyi": "py", "js": "js", "mjs": "js", "jsx": "js", "ts": "ts", "tsx": "ts", "go": "go", "java": "java", "c": "c", "h": "c", "sh": "sh", "bash": "sh"}
#: other suffixes of source, without thresholds of their own
SOURCE = frozenset("cpp cc cxx hpp hxx rs cs rb php kt kts swift scala sc lua m mm pl r dart ex exs hs cjs mts css scss".split())
#: language: longest line, mean line, least white-space share, most numeric literals per word, longest encoded run
LIMITS = {
    "py": (800, 140, 0.09, 0.55, 1200),
    "js": (600, 140, 0.10, 0.55, 1200),
    "ts": (600, 140, 0.10, 0.55, 1200),
    "go": (800, 140, 0.09, 0.55, 1200),
    "java": (800, 140, 0.10, 0.55, 1200),
    "c": (800, 140, 0.09, 0.60, 1200),
    "sh": (1500, 200, 0.07, 0.60, 1200),
}
SPAN = 64
RUN = re.compile(rb"[A-Za-z0-9+/=]{64,}|(?:\\x[0-9a-fA-F]{2}){24,}")
NUMBER = re.compile(rb"(?<![\w.])-?(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)(?![\w])")
WORD = re.compile(rb"[A-Za-z_]\w*")
# three digits or hexadecimal numbers at least; every text is read in one way only, as lines may be of any length
TABLE = re.compile(rb"[\[({]*+(?:[-+]?+(?:0[xX][0-9a-fA-F](?:[0-9a-fA-F]*[a-dfA-DF])?+[eE]*+|\d[_.eE]*+)[\])}]*+\s*+(?:,\s*+)?+){3,}+[\])};]*+")
GIVES = re.compile(rb"(?m)\breturn\b|=>")
COMMENT = re.compile(r"(?m)^[ \t\ufeff]*(?:#|//|/\*|\*|<!--|\"\"\"|'''|;|--).*")
COUNTS = ("n_bytes", "n_lines", "max_line", "white", "alnum")
STATS = ("lines", "max_line", "mean_line", "white_share", "alnum_share", "number_share", "encoded_run", "encoded_share", "repeat_share", "literal_share", "accessor_share")

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
# the shape of a line: words as w, numbers as 0
_SHAPES = bytes(48 if 48 <= c <= 57 else 119 if 65 <= c <= 90 or 97 <= c <= 122 or c == 95 or c > 127 else c for c in range(256))
# bytes that no encoded run holds
_ELSE = np.ones(256, bool)
_ELSE[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/=\\"]] = False
_DIGIT, _WORD = np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[48:58] = True
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95]] = True
_WORDS, _NUMBERS = re.compile(rb"w[w0]+"), re.compile(rb"00+")


def counts(raw: bytes) -> dict[str, int]:
    """Bytes, lines (parted by line feeds), the longest line without its end, white and alphanumeric bytes."""
    at = np.frombuffer(raw, np.uint8)
    each = np.bincount(at, minlength=256)
    ends = np.flatnonzero(at == 10)
    lines = np.diff(np.concatenate([[-1], ends, [len(at)]])) - 1
    return dict(zip(COUNTS, (len(raw), len(lines), int(lines.max()), int(each[_WHITE].sum()), int(each[_ALNUM].sum())), strict=True))


def statistics(raw: bytes) -> dict[str, float]:
    """The layout statistics of one file."""
    lines = [x for x in map(bytes.strip, raw.splitlines()) if x]
    if not lines:
        return dict.fromkeys(STATS, 0.0)
    n, sizes = len(raw), [len(x.rstrip()) for x in raw.splitlines() if x.strip()]
    each = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    runs = [m.end() - m.start() for m in RUN.finditer(raw)]
    numbers, words = len(NUMBER.findall(raw)), len(WORD.findall(raw))
    literal = sum(len(x) for x in lines if x[0] in b"[({+-0123456789" and TABLE.fullmatch(x))
    shapes = _shapes(lines)
    kept = sum(shapes.values())
    common = sum(c for _, c in shapes.most_common(2))
    return {
        "lines": float(len(lines)),
        "max_line": float(max(sizes)),
        "mean_line": sum(sizes) / len(sizes),
        "white_share": int(each[_WHITE].sum()) / n,
        "alnum_share": int(each[_ALNUM].sum()) / n,
        "number_share": numbers / max(1, numbers + words),
        "encoded_run": float(max(runs, default=0)),
        "encoded_share": sum(runs) / n,
        "repeat_share": 1 - len(shapes) / kept if kept else 0.0,
        "literal_share": literal / sum(sizes),
        "accessor_share": common / kept if kept and len(GIVES.findall(raw)) > 0.15 * len(lines) else 0.0,
    }


def _shapes(lines: list[bytes]) -> Counter:
    return Counter(x for x in _NUMBERS.sub(b"0", _WORDS.sub(b"w", b"\n".join(lines).translate(_SHAPES))).split(b"\n") if len(x) > 6)


def _gap(at: np.ndarray, n: int) -> int:
    """The longest stretch of ``n`` places without one of the sorted places ``at``."""
    return int(max(at[0], n - 1 - at[-1], (at[1:] - at[:-1]).max(initial=1) - 1)) if len(at) else n


def _open(raw: bytes, lang: str) -> bool:
    """Whether the statistics can make a case at all, by bounds that cost a tenth of them."""
    longest, _, _, numeric, _ = LIMITS[lang]
    at = np.frombuffer(raw, np.uint8)
    # lines that end in a carriage return only are shorter
    if _gap(np.flatnonzero(at == 10), len(at)) > longest // 3:
        return True
    if _gap(np.flatnonzero(_ELSE[at]), len(at)) >= SPAN:
        return True
    # a number begins where a word might, and every other such place begins a word
    word = _WORD[at]
    starts = at[1:][word[1:] & ~word[:-1]]
    starts = np.append(starts, at[:1]) if word[0] else starts
    if int(_DIGIT[starts].sum()) > numeric / 2 * len(starts):
        return True
    lines = [x for x in map(bytes.strip, raw.splitlines()) if x]
    if raw.count(b"return") + raw.count(b"=>") <= 0.15 * len(lines) or len(GIVES.findall(raw)) <= 0.15 * len(lines):
        return False
    shapes = _shapes(lines)
    return sum(c for _, c in shapes.most_common(2)) > 0.6 * sum(shapes.values())


def _copied(s: str) -> bool:
    if COPIED.search(s) or any(RELEASE.search(m.group(1)) for m in PART_OF.finditer(s)):
        return True
    return any((m := first.search(s)) and then.search(s, m.end()) for first, then in COPIED_BY)


def _said(text: str) -> str:
    """What the comments of a file say about it."""
    low = text.lower()
    stems = [w for w in STEMS if w in low]
    if not stems:
        return ""
    for m in COMMENT.finditer(text):
        s = m.group(0).lstrip("\ufeff \t")
        at = s.lower()
        if any(w in at for w in stems) and not OURS.search(s):
            if MADE.search(s):
                return "generated"
            if _copied(s):
                return "vendored"
    return ""


def verdict(path: str | None, raw: bytes, st: dict[str, float] | None = None) -> str:
    """'' for hand-written source, else generated, minified, vendored or data."""
    parts = (path or "").split("/")
    base = parts[-1]
    suffix = base.rsplit(".", 1)[-1].lower() if "." in base else ""
    lang = LANGUAGES.get(suffix)
    if lang is None and suffix not in SOURCE:
        return ""
    folders = {x.lower() for x in parts[:-1]}
    if folders & VENDORED or re.search(r"(?i)(^|/)contrib/ext/", path or ""):
        return "vendored"
    if folders & GENERATED or NAMES.search(base):
        return "minified" if ".min." in base else "generated"
    if not raw.strip():
        return ""
    text = raw.decode("utf-8", "replace")
    if "\0" in text or sum(map(text.count, "\ufffd\x01\x02\x03\x04\x05\x06")) > 0.05 * len(text):
        return "data"  # bytes of no text
    if re.match(r"""\s*["']use strict["'];?\s*Object\.defineProperty\(exports, ["']__esModule["']""", text):
        return "generated"
    if (said := _said(text)) or lang is None:
        return said
    if st is None and not _open(raw, lang):
        return ""
    st = st or statistics(raw)
    longest, mean, white, numeric, run = LIMITS[lang]
    if st["encoded_share"] > 0.5 or st["encoded_run"] > run and st["encoded_share"] > 0.25:
        return "data"
    if st["number_share"] > numeric / 2 and st["lines"] * st["mean_line"] > 600 and st["literal_share"] > 0.4:
        return "data"
    if st["repeat_share"] > 0.8 and st["accessor_share"] > 0.6:
        return "generated"
    dense = st["white_share"] < white and st["mean_line"] > mean / 2
    if dense and st["max_line"] > longest / 3 and st["encoded_share"] < 0.25 and _long_code(text, longest // 3):
        return "minified"
    if st["max_line"] > longest and st["encoded_share"] < 0.25 and (st["mean_line"] > mean or dense) and _long_code(text, longest):
        return "minified"
    return ""


def _long_code(text: str, longest: int) -> bool:
    """Whether the long lines hold statements, not one long string or prose."""
    long = [x for x in text.splitlines() if len(x) > longest]
    code = sum(len(re.findall(r"[;{}()=]", x)) for x in long)
    return code > 0.08 * sum(map(len, long))


def _mapped(df: DataFrame, path: str, content: str, names: tuple[str, ...], ddl: str, of) -> DataFrame:
    slim = df.where(F.col(path).isNotNull()).select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content"))
    kinds = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64()}
    types = [kinds[x.split()[1]] for x in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [of(p, raw or b"") for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=list(names))

    return slim.mapInArrow(run, ddl).dropDuplicates(["path"])


def measured(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row per distinct path with the plain counts (``COUNTS``) that the shares are made of."""
    return _mapped(df, path, content, ("path", *COUNTS), "path string, " + ", ".join(f"{c} bigint" for c in COUNTS), lambda p, raw: (p, *counts(raw).values()))


def classify(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row per distinct path: ``path, verdict`` and the statistics behind it."""

    def of(p: str, raw: bytes) -> tuple:
        st = statistics(raw)
        return p, verdict(p, raw, st), *st.values()

    return _mapped(df, path, content, ("path", "verdict", *STATS), "path string, verdict string, " + ", ".join(f"{s} double" for s in STATS), of)


def not_handwritten(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Paths of the files that are not hand-written; statistics are taken where place and words leave it open."""
    return _mapped(df, path, content, ("path", "verdict"), "path string, verdict string", lambda p, raw: (p, verdict(p, raw))).where("verdict <> ''").select("path")
