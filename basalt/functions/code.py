"""Column functions on source code: comments and strings taken out, names called. All of it stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

STRING = r'"(?:[^"\\\n]|\\.)*+"'
QUOTED = r"'(?:[^'\\\n]|\\.)*+'"
LETTER = r"'(?:[^'\\\n]|\\[^\n]{1,9}?)'"
#: possessive loops, as a text may hold strings of any length;
#: how comments and strings look, by family of languages; earlier alternatives win
QUIET = {
    "python": r'"""[\s\S]*?"""|' + r"'''[\s\S]*?'''|" + STRING + "|" + QUOTED + r"|#[^\n]*",
    "script": r"//[^\n]*|/\*[\s\S]*?\*/|" + STRING + "|" + QUOTED + r"|`(?:[^`\\]|\\[\s\S])*+`",
    "letters": r"//[^\n]*|/\*[\s\S]*?\*/|`[^`]*`|" + STRING + "|" + LETTER,
    "hash": r"#[^\n]*|" + STRING + "|" + QUOTED,
    "dash": r"--[^\n]*|" + STRING + "|" + QUOTED,
}
FAMILIES = {
    "python": ("py",),
    "script": ("js", "jsx", "mjs", "cjs", "ts", "tsx", "mts", "php"),
    "letters": ("go", "rs", "java", "c", "h", "cpp", "cc", "cxx", "hpp", "hxx", "cs", "kt", "kts", "swift", "scala", "sc"),
    "hash": ("rb", "sh", "bash", "ex", "exs"),
    "dash": ("lua", "hs", "lhs"),
}
# Extensions whose calls are read, and those whose calls count with a receiver too.
CALLING = ("py", "js", "jsx", "mjs", "cjs", "ts", "tsx", "mts", "go", "rs", "java", "c", "h", "cpp", "cc", "cxx", "hpp", "cs", "rb", "php", "kt", "kts", "swift", "lua")
RECEIVING = ("java", "rb")
#: words that stand before a bracket and call nothing
WORDS = (
    "if elif elseif for foreach while until unless switch match case when catch except return yield await async throw raise assert sizeof typeof alignof not and or in is as lambda function func fn fun "
    "def class new delete del void do else try finally with using lock fixed synchronized this import defer go select range where let var const loop unsafe guard static"
).split()
HEAD = r"\b(?:def|function|func|fn|fun|class|new|interface|struct|enum|trait|impl)\b[ \t]*(?:\([^)\n]*\)[ \t]*)?\*?[ \t]*[A-Za-z_$][\w$.]*"


def quiet(code: Column, ext: Column) -> Column:
    """The text with a blank for every comment and string; other suffixes come out as they are."""
    rules = [(exts, F.regexp_replace(code, QUIET[name], " ")) for name, exts in FAMILIES.items()]
    return reduce(lambda c, r: c.when(ext.isin(*r[0]), r[1]), rules[1:], F.when(ext.isin(*rules[0][0]), rules[0][1])).otherwise(code)


def calls(code: Column, ext: Column) -> Column:
    """Names called in the text of one function, in order, repeats kept: direct names only, in Java and Ruby
    with a receiver as well. What the text defines (its own head first of all), decorators, constructors and words of
    the language are none. NULL text and other suffixes give none."""
    body = F.regexp_replace(F.regexp_replace(quiet(code, ext), r"@[A-Za-z_][\w.]*[ \t]*\(?", " "), HEAD, " ")
    body = F.regexp_replace(body, r"^[^(={;]*\(", " ")
    direct = F.regexp_extract_all(body, F.lit(r"(?<!->)(?<!::)(?<![\w$.@])([A-Za-z_]\w*)[ \t]*\("), 1)
    received = F.regexp_extract_all(body, F.lit(r"(?<![\w$@])([A-Za-z_]\w*)[ \t]*\("), 1)
    found = F.filter(F.when(ext.isin(*RECEIVING), received).otherwise(direct), lambda w: ~w.isin(*WORDS) & ~((w == "super") & (ext != "py")))
    return F.when(code.isNotNull() & ext.isin(*CALLING), found).otherwise(F.array().cast("array<string>"))
