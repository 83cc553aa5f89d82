"""Import specifiers and the paths they may stand for.

A specifier is extracted from a file's text, without comments and long strings, by its language's rule;
candidates are generated as rows with an ordinal, so that resolving is an equality join. Both are column
expressions: no text leaves the JVM. Languages whose imports name packages and not
files (Go, Java, C#, Kotlin, Swift, Scala, Lua, Haskell, Elixir) give specifiers but no candidates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.functions import paths

_SHORT = r"""("(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+')"""
#: comments and long strings; a short string is kept, as it may be the specifier
_NOISE = {
    "py": r'"""[\s\S]*?"""|' + r"'''[\s\S]*?'''|#[^\n]*|" + _SHORT,
    "js": r"//[^\n]*|/\*[\s\S]*?\*/|`(?:[^`\\]|\\[\s\S])*+`|" + _SHORT,
    "php": r"//[^\n]*|#[^\n]*|/\*[\s\S]*?\*/|" + _SHORT,
    "hash": r"(?m)(?:^|(?<=\s))#[^\n]*|" + _SHORT,
    "dash": r"--[^\n]*|" + _SHORT,
    "c": r"//[^\n]*|/\*[\s\S]*?\*/|" + '("(?:[^"\\\\\\n]|\\\\.)*+")',
}
#: family: comments, and patterns of which each one's group is a specifier
RULES: dict[str, tuple[str, tuple[str, ...]]] = {
    "py": ("py", (r"(?m)^import[ \t]+([\w.][^\n;]*)", r"(?m)^from[ \t]+([.\w]+)[ \t]+import\b")),
    "js": ("js", (r"""(?m)^\s*(?:import|export)\b[^;'"\n]*?(?:from\s*)?["']([^"'\n]+)["']""", r"""\brequire\(\s*["']([^"'\n]+)["']\s*\)""")),
    "c": ("c", (r'(?m)^[ \t]*#[ \t]*include[ \t]*"([^"\n]+)"',)),
    "go": ("c", (r'(?m)^\s*import\s+(?:[\w.]+\s+)?"([^"\n]+)"', r'(?m)^\s+(?:[\w.]+\s+)?"([^"\n]+)"\s*$')),
    "java": ("c", (r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)",)),
    "rs": ("c", (r"(?m)^\s*(?:pub\s+)?use\s+((?:crate|super|self)::[\w:]+)",)),
    "rb": ("hash", (r"""(?m)^\s*(require(?:_relative)?\s*\(?\s*["'][^"'\n]+)["']""",)),
    "php": ("php", (r"""\b(?:include|require)(?:_once)?\s*\(?\s*["']([^"'\n]+)["']""",)),
    "sh": ("hash", (r"(?m)^\s*(?:source|\.)\s+[\"']?([^\s\"';&|]+)",)),
    "cs": ("c", (r"(?m)^\s*using\s+(?:static\s+)?([\w.]+)\s*;",)),
    "kt": ("c", (r"(?m)^\s*import\s+([\w.]+)",)),
    "swift": ("c", (r"(?m)^\s*import\s+(\w[\w.]*)",)),
    "scala": ("c", (r"(?m)^\s*import\s+([\w.]+)",)),
    "lua": ("dash", (r"""\brequire\s*\(?\s*["']([^"'\n]+)["']""",)),
    "hs": ("dash", (r"(?m)^import\s+(?:qualified\s+)?([\w.]+)",)),
    "ex": ("hash", (r"(?m)^\s*(?:import|alias|use|require)\s+([A-Z][\w.]*)",)),
}
#: extension: family
FAMILY = {
    "py": "py", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "ts": "js", "tsx": "js", "mts": "js",
    "c": "c", "h": "c", "cpp": "c", "cc": "c", "cxx": "c", "hpp": "c", "hxx": "c", "rs": "rs", "rb": "rb", "php": "php", "sh": "sh", "bash": "sh",
    "go": "go", "java": "java", "cs": "cs", "kt": "kt", "kts": "kt", "swift": "swift", "scala": "scala", "sc": "scala", "lua": "lua", "hs": "hs", "lhs": "hs", "ex": "ex", "exs": "ex",
}


def _by_family(ext: Column, of: dict[str, Column], other: Column) -> Column:
    exts = {f: [e for e, g in FAMILY.items() if g == f] for f in of}
    first, *rest = of
    return reduce(lambda c, f: c.when(ext.isin(*exts[f]), of[f]), rest, F.when(ext.isin(*exts[first]), of[first])).otherwise(other)


def specifiers(body: Column, ext: Column) -> Column:
    """Specifiers of a text in the order of its language's patterns, each once; none for other suffixes. Python's
    top-level statements count; a name list gives one each; of Ruby's the keyword stays before the path."""

    def found(name: str) -> Column:
        noise, patterns = RULES[name]
        # the group of a short string is put back, a comment has none
        clean = F.regexp_replace(body, _NOISE[noise], "$1")
        lists = [F.regexp_extract_all(clean, F.lit(p), 1) for p in patterns]
        if name == "py":
            lists[0] = F.transform(F.flatten(F.transform(lists[0], lambda x: F.split(x, ",", -1))), lambda x: F.regexp_extract(x, r"([\w.]+)", 1))
        return F.array_distinct(F.filter(F.concat(*lists), lambda x: x != ""))

    return _by_family(ext, {name: found(name) for name in RULES}, F.array().cast("array<string>"))


def extract(source_files: DataFrame) -> DataFrame:
    """``path, raw, is_relative`` of every file, each specifier once a file; bytes that are not UTF-8 are replaced."""
    ext = F.lower(paths.extension(F.col("path")))
    body = F.make_valid_utf8(F.col("content").cast("string"))
    rows = source_files.where("path is not null and content is not null").select("path", ext.alias("ext"), F.explode(specifiers(body, ext)).alias("raw"))
    family = _by_family(F.col("ext"), {f: F.lit(f) for f in RULES}, F.lit(""))
    raw = F.when(family == "rb", F.regexp_replace("raw", r"^require(_relative)?\s*\(?\s*[\"']", "")).otherwise(F.col("raw"))
    relative = (
        F.when(family == "py", F.col("raw").startswith("."))
        .when(family.isin("c", "sh", "php"), F.lit(True))
        .when(family == "rb", F.col("raw").startswith("require_relative") | raw.startswith("./") | raw.startswith("../"))
        .otherwise(F.col("raw").startswith("./") | F.col("raw").startswith("../"))
    )
    return rows.select("path", raw.alias("raw"), relative.alias("is_relative")).distinct()


def paths_for(path: Column, raw: Column, relative: Column) -> Column:
    """Paths that a specifier may stand for, best first. The repository's root is the first three parts of an
    absolute path, '' of a relative one."""
    root = F.regexp_extract(path, r"^(/[^/]+/[^/]+/[^/]+)", 1)
    here = paths.folder(path)
    inner = F.ltrim(raw, F.lit("."))
    dots = F.length(raw) - F.length(inner)
    base = F.when(dots > 0, F.concat(here, F.repeat(F.lit("/.."), dots - 1))).otherwise(root)
    start = F.rtrim(F.concat(base, F.lit("/"), F.replace(inner, F.lit("."), F.lit("/"))), F.lit("/"))
    crate = F.replace(F.regexp_replace(F.regexp_replace(raw, "^(crate|self)::", ""), "^super::", "../"), F.lit("::"), F.lit("/"))
    none = F.array().cast("array<string>")
    of = {
        "py": F.array(F.concat(start, F.lit(".py")), F.concat(start, F.lit("/__init__.py"))),
        "js": F.when(relative, F.array(*(F.concat(here, F.lit("/"), raw, F.lit(end)) for end in ("", ".js", ".ts", ".jsx", ".tsx", "/index.js", "/index.ts")))).otherwise(none),
        "c": F.array(F.concat(here, F.lit("/"), raw), F.concat(root, F.lit("/"), raw)),
        "rs": F.array(F.concat(root, F.lit("/src/"), crate, F.lit(".rs")), F.concat(root, F.lit("/src/"), crate, F.lit("/mod.rs"))),
        "rb": F.array(F.concat(F.when(relative, here).otherwise(F.concat(root, F.lit("/lib"))), F.lit("/"), F.regexp_replace(raw, r"\.rb$", ""), F.lit(".rb"))),
        "sh": F.array(F.concat(here, F.lit("/"), raw)),
        "php": F.array(F.concat(here, F.lit("/"), raw)),
    }
    found = _by_family(F.lower(paths.extension(path)), of, none)
    return F.array_distinct(F.filter(F.transform(found, paths.normalize), lambda x: x != ""))


def candidates(specs: DataFrame) -> DataFrame:
    """``group_id, path, raw, ordinal, candidate``."""
    return specs.select("group_id", "path", "raw", F.posexplode(paths_for(F.col("path"), F.col("raw"), F.col("is_relative"))).alias("ordinal", "candidate"))
