"""Functions and methods of source files as chunks.

Python is read by its own parser; other languages by a scan of their text without strings and
comments for the forms of function and class heads, with brackets (in Ruby and Lua, ``end``) matched to find
a body's end. One chunk comes out per function; functions inside functions belong to the outer one; class
names extend the dotted symbol. Arrow functions, function expressions and literals outside of other functions are chunks
named ``<anonymous>``, as are the blocks of methods for a Rust type. A file that cannot be read gives no rows and
no failure.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basalt.functions import code as quiet
from basalt.functions import ids, text

ANONYMOUS = "<anonymous>"
_NAME = r"[A-Za-z_$][\w$]*"
_ARGS = r"\((?:[^(){};]|\((?:[^(){};]|\([^(){};]*\))*\))*\)"
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|synchronized|native|default|override|virtual|async|sealed|partial|extern|unsafe|readonly|open|inline|suspend|operator|infix|tailrec|mutating|fileprivate|implicit|lazy)\s+)*"
_TYPED = rf"(?m)^[ \t]*(?:@[\w.]+(?:\([^)]*\))?\s+)*{_MODS}(?:<[^>(){{}};]*>\s*)?(?:[\w.<>\[\],?*&:]+[ \t]+(?:[\w.<>\[\],?*&:]+[ \t]+)*)?[*&]*((?:~|operator\S+|[A-Za-z_]\w*::)*~?[A-Za-z_]\w*)\s*{_ARGS}"
#: by family: the forms of heads (the group, if there is one, is the name), where the body opens, and classes
_HEADS = {
    "script": (
        rf"(?m)^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<a>{_NAME})\s*(?:<[^>(]*>)?\(",
        rf"(?m)^[ \t]*(?:(?:public|private|protected|static|async|readonly|get|set|override)\s+)*\*?(?P<m>#?{_NAME})\s*(?:<[^>(]*>)?{_ARGS}\s*(?::[^;{{}}=]+)?\{{",
        r"(?<![\w$.])(?:async\s+)?function\s*\*?\s*\(",
        rf"(?<![\w$.])(?:async\s+)?(?:{_ARGS}(?:\s*:\s*[^=;{{}}]+?)?|{_NAME})\s*=>",
    ),
    "go": (r"(?m)^func\s+(?:\([^)]*\)\s*)?(?P<a>[A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\(", r"(?<![\w.])func\s*\("),
    "java": (_TYPED.replace("((?:~", "(?P<a>(?:~") + r"\s*(?:throws\s+[\w.,\s]+)?\{",),
    "c": (_TYPED.replace("((?:~", "(?P<a>(?:~") + r"\s*(?:const|noexcept|override|final|\s)*(?::[^;{}]*)?\{",),
    "cs": (_TYPED.replace("((?:~", "(?P<a>(?:~") + r"\s*(?:where\s[^{;]*|:\s*(?:base|this)\s*\([^;{}]*\)\s*)?(?:\{|=>)",),
    "rs": (rf"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|default|extern)\s+)*fn\s+(?P<a>[A-Za-z_]\w*)\s*(?:<[^(]*>)?{_ARGS}[^;{{}}]*\{{",),
    "php": (r"(?m)^[ \t]*(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?(?P<a>[A-Za-z_]\w*)\s*\([^;{}]*\)[^;{}]*\{",),
    "kt": (rf"(?m)^[ \t]*{_MODS}fun\s+(?:<[^>]*>\s*)?(?:[\w.<>?]+\.)?(?P<a>[A-Za-z_]\w*)\s*{_ARGS}[^;{{}}=\n]*(?:\{{|=)",),
    "swift": (rf"(?m)^[ \t]*(?:@\w+\s+)*{_MODS}func\s+(?P<a>[A-Za-z_]\w*)\s*(?:<[^>]*>)?{_ARGS}[^;{{}}\n]*\{{",),
    "scala": (rf"(?m)^[ \t]*{_MODS}def\s+(?P<a>[A-Za-z_]\w*)\s*(?:\[[^\]]*\])?(?:{_ARGS})*\s*(?::[^=\n{{]+)?(?:=\s*\{{|\{{|=)",),
    "sh": (r"(?m)^[ \t]*(?:function\s+(?P<a>[A-Za-z_][\w\-]*)\s*(?:\(\))?|(?P<b>[A-Za-z_][\w\-]*)\s*\(\))\s*\{",),
    "rb": (r"(?m)^[ \t]*(?:(?:private|public|protected)\s+)?def\s+(?:self\.|\w+\.)?(?P<a>[A-Za-z_]\w*[?!=]?)",),
    "lua": (r"(?m)^[ \t]*(?:local\s+)?function\s+(?P<a>[A-Za-z_][\w.:]*)\s*\(",),
}
_HEADS = {k: [re.compile(x) for x in v] for k, v in _HEADS.items()}
_CLASS = {
    "script": rf"(?m)^[ \t]*(?:(?:export|default|abstract)\s+)*class\s+({_NAME})[^;{{]*\{{",
    "java": rf"(?m)^[ \t]*(?:@[\w.]+(?:\([^)]*\))?\s+)*{_MODS}(?:class|interface)\s+([A-Za-z_]\w*)[^;{{]*\{{",
    "c": r"(?m)^[ \t]*(?:template\s*<[^{;]*>\s*)?(?:class|struct)\s+([A-Za-z_]\w*)[^;{()=]*\{",
    "rs": r"(?m)^[ \t]*(?:unsafe\s+)?impl\b()[^;{]*\{",
    "php": r"(?m)^[ \t]*(?:(?:abstract|final)\s+)*(?:class|interface)\s+([A-Za-z_]\w*)[^;{]*\{",
}
_CLASS = {k: re.compile(v) for k, v in ({**_CLASS, "cs": _CLASS["java"], "kt": _CLASS["java"], "swift": _CLASS["java"].replace("class|interface", "class|struct|protocol"), "scala": _CLASS["java"]}).items()}
# Extensions that give chunks, by the family that reads them.
FAMILY = {
    "js": "script", "jsx": "script", "mjs": "script", "cjs": "script", "ts": "script", "mts": "script", "tsx": "script", "go": "go", "rs": "rs", "java": "java", "c": "c", "h": "c", "cpp": "c", "cc": "c", "cxx": "c",
    "hpp": "c", "hxx": "c", "cs": "cs", "rb": "rb", "php": "php", "kt": "kt", "kts": "kt", "swift": "swift", "scala": "scala", "sc": "scala", "sh": "sh", "bash": "sh", "lua": "lua",
}
LANG = {
    "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "kt": "kotlin", "kts": "kotlin", "swift": "swift", "scala": "scala", "sc": "scala", "sh": "bash", "bash": "bash", "lua": "lua",
}
_QUIET = {ext: re.compile(rule) for name, rule in quiet.QUIET.items() for ext in quiet.FAMILIES[name]}
_SHELL = re.compile(r"""(?m)(?<![\w$])#[^\n]*|"(?:[^"\\]|\\[\s\S])*"|'[^']*'""")
_NOT_NAMES = frozenset("if for while switch catch return function else do try new foreach using lock fixed sizeof typeof elseif when match super this".split())
_BRACE = re.compile(r"[{}]")
_BLOCK = {
    "rb": re.compile(r"(?m)^[ \t]*(?:class|module|def|if|unless|case|while|until|for|begin)\b|(?<==)[ \t]*(?:if|case|begin|unless)\b|\bdo\b(?=[ \t]*(?:\|[^|]*\|)?[ \t]*$)|\bend\b"),
    "lua": re.compile(r"\b(?:function|if|do|repeat)\b|\b(?:end|until)\b"),
}


def _close(code: str, at: int) -> int:
    depth = 0
    for m in _BRACE.finditer(code, at):
        depth += 1 if m.group(0) == "{" else -1
        if depth == 0:
            return m.end()
    return len(code)


def _end(code: str, at: int, family: str) -> int:
    """Behind the ``end`` of the block whose opening word is at ``at``."""
    depth = 0
    for m in _BLOCK[family].finditer(code, at):
        depth += -1 if m.group(0).strip() in ("end", "until") else 1
        if depth == 0:
            return m.end()
    return len(code)


def _expression(code: str, at: int) -> int:
    """The end of an expression: before a comma, a semicolon, a closing bracket or a line's end outside of brackets."""
    depth = 0
    while at < len(code) and code[at] in " \t\r\n":
        at += 1
    for i in range(at, len(code)):
        c = code[i]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                return i
        elif depth == 0 and c in ",;\n":
            return i
    return len(code)


def functions(source: str, ext: str) -> list[tuple[str, str, int, int]]:
    """(dotted name below the module, kind, start, end) in characters, in order of text."""
    if ext == "py":
        return _python(source)
    family = FAMILY.get(ext)
    if family is None:
        return []
    blank = _SHELL if family == "sh" else _QUIET[ext]
    code = blank.sub(lambda m: re.sub(r"[^\n]", " ", m.group(0)), source)
    classes = [(m.group(1) or ANONYMOUS, m.start(), _close(code, m.end() - 1)) for m in _CLASS[family].finditer(code)] if family in _CLASS else []
    heads = sorted((m.start() + len(m.group(0)) - len(m.group(0).lstrip()), n, m) for n, h in enumerate(_HEADS[family]) for m in h.finditer(code))
    out, done = [], 0
    for start, n, m in heads:
        named = next((x for x in m.groups() if x), None)
        name = named or ANONYMOUS
        if start < done or name in _NOT_NAMES:
            continue
        owners = [c for c, a, z in classes if a < start < z]
        if family == "script" and n == 1 and not owners:
            continue
        if family in _BLOCK:
            end = _end(code, m.start(), family) if family == "rb" else _end(code, code.index("function", start), family)
        else:
            if m.group(0).endswith("=>") or m.group(0).endswith("="):
                rest = code[m.end() :]
                brace = m.end() + len(rest) - len(rest.lstrip())
                if not code.startswith("{", brace):
                    end = _expression(code, m.end())
                    out.append((".".join([*owners, name]), "method" if owners else "function", start, end))
                    done = end
                    continue
            else:
                brace = code.find("{", m.end() - 1)
            if brace < 0:
                continue
            end = _close(code, brace)
        out.append((".".join([*owners, name]), "method" if owners else "function", start, end))
        done = end
    return out


def _python(source: str) -> list[tuple[str, str, int, int]]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    starts = [0]
    for line in source.split("\n"):
        starts.append(starts[-1] + len(line) + 1)
    raw = source.split("\n")
    out: list[tuple[str, str, int, int]] = []

    def place(line: int, col: int) -> int:
        return starts[line - 1] + len(raw[line - 1].encode()[:col].decode("utf-8", "ignore"))

    def walk(body: list, owners: list[str]) -> None:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append((".".join([*owners, node.name]), "method" if owners else "function", place(node.lineno, node.col_offset), place(node.end_lineno, node.end_col_offset)))
            elif isinstance(node, ast.ClassDef):
                walk(node.body, [*owners, node.name])
            else:
                for field in ("body", "orelse", "finalbody"):
                    inner = getattr(node, field, None)
                    if isinstance(inner, list):
                        walk(inner, owners)

    walk(tree.body, [])
    return out


CHUNK = "path string, symbol string, kind string, lang string, start_line int, end_line int, start_byte int, end_byte int, content string"


def extract(source_files: DataFrame) -> DataFrame:
    """Chunks of every file with ids, hashes and signatures; of a symbol met twice in a file the last.

    A chunk's content is its text without separator lines. Files given twice are read twice and their chunks
    dropped by the same window, so no file is shuffled."""
    slim = source_files.where("path is not null and content is not null").select("path", "content")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                base = p.rsplit("/", 1)[-1]
                module, _, ext = base.rpartition(".")
                source = c.decode("utf-8", "replace")
                for name, kind, a, z in functions(source, ext.lower()):
                    first = source.count("\n", 0, a) + 1
                    start = len(source[:a].encode())
                    body = source[a:z]
                    rows.append((p, f"{module}.{name}", kind, LANG.get(ext.lower()), first, first + body.count("\n"), start, start + len(body.encode()), body))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 9
            s, i = pa.string(), pa.int32()
            names = [x.split()[0] for x in CHUNK.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (s, s, s, s, i, i, i, i, s), strict=True)], names=names)

    found = slim.mapInArrow(run, CHUNK).withColumn("content", text.strip_noise(F.col("content")))
    last = found.withColumn("n", F.row_number().over(W.partitionBy("path", "symbol").orderBy(F.desc("start_byte")))).where("n = 1").drop("n")
    return last.select(
        ids.chunk_id(F.col("path"), F.col("symbol")).alias("id"),
        "*",
        text.signature(F.col("content")).alias("signature"),
        ids.content_hash(F.col("content")).alias("content_hash"),
        (F.col("end_line") - F.col("start_line") + 1).alias("loc"),
    )
