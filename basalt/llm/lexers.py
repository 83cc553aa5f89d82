"""Tokens of the supported languages for ``gll``: lists of terminal numbers, or ``LexError``."""

from __future__ import annotations

import re


class LexError(ValueError):
    pass


def _terms(g, classes: tuple[str, ...]) -> dict[str, int]:
    for c in classes:
        g.term(c)
    return g.terms


# ---------------------------------------------------------------- Python

_PY_STR = r"""(?:[bBuUfFrRtT]{0,2})(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*')"""
_PY_NUM = r"(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)"
PY = re.compile(
    rf"(?P<space>[ \t\f]+|\\\n|#[^\n]*)|(?P<nl>\n)|(?P<str>{_PY_STR})|(?P<num>{_PY_NUM}(?!\w))|(?P<name>[^\W\d]\w*)|"
    r"(?P<op>\.\.\.|//=|\*\*=|>>=|<<=|->|:=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|==|!=|<=|>=|//|\*\*|<<|>>|[-+*/%@&|^~<>()\[\]{},:;.=])|(?P<bad>[\s\S])"
)
PY_WORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type".split()
)


def python(text: str, g) -> list[int]:
    t = _terms(g, ("NEWLINE", "INDENT", "DEDENT", "NAME", "NUMBER", "STRING", "EOF"))
    if "\0" in text:
        raise LexError("null byte")
    out: list[int] = []
    stack, depth, fresh = [0], 0, True
    name, newline = t["NAME"], t["NEWLINE"]
    at, n = 0, len(text)
    match = PY.match
    brackets: list[str] = []
    pairs = {")": "(", "]": "[", "}": "{"}
    while at < n:
        if fresh and not depth:
            col = 0
            while at < n and text[at] in " \t\f":
                col = col + 1 if text[at] == " " else (col // 8 + 1) * 8 if text[at] == "\t" else 0
                at += 1
            if at >= n:
                break
            if text[at] == "\n":
                at += 1
                continue
            if text[at] == "#":
                e = text.find("\n", at)
                at = n if e < 0 else e + 1
                continue
            if col > stack[-1]:
                stack.append(col)
                out.append(t["INDENT"])
            while col < stack[-1]:
                stack.pop()
                out.append(t["DEDENT"])
            if col != stack[-1]:
                raise LexError("indentation")
            fresh = False
        m = match(text, at)
        k, s = m.lastgroup, m.group(0)
        at = m.end()
        if k == "space":
            continue
        if k == "name":
            out.append(t.get(s, name) if s in PY_WORDS else name)
        elif k == "op":
            if s in "([{":
                brackets.append(s)
                depth += 1
            elif s in ")]}":
                if not brackets or brackets.pop() != pairs[s]:
                    raise LexError("bracket")
                depth -= 1
            out.append(t[s] if s in t else t["NAME"])
        elif k == "nl":
            if not depth:
                out.append(newline)
                fresh = True
        elif k == "str":
            out.append(t["STRING"])
        elif k == "num":
            if re.match(r"0\d*[1-9]\d*$", s):
                raise LexError("number")
            out.append(t["NUMBER"])
        else:
            raise LexError("character")
    if depth:
        raise LexError("open bracket")
    if out and out[-1] != newline:
        out.append(newline)
    out += [t["DEDENT"]] * (len(stack) - 1)
    out.append(t["EOF"])
    return out


# ---------------------------------------------------------------- JSON

JSON_TOKEN = re.compile(r'(?P<space>[ \t\r\n]+)|(?P<str>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<num>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<op>[{}\[\]:,]|true|false|null)|(?P<bad>[\s\S])')


def json(text: str, g) -> list[int]:
    t = _terms(g, ("STRING", "NUMBER", "EOF"))
    out = []
    for m in JSON_TOKEN.finditer(text):
        k = m.lastgroup
        if k == "space":
            continue
        if k == "bad":
            raise LexError("character")
        out.append(t["STRING"] if k == "str" else t["NUMBER"] if k == "num" else t[m.group(0)])
    out.append(t["EOF"])
    return out


# ---------------------------------------------------------------- ECMAScript and TypeScript

_JS_NUM = r"(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[bB][01](?:_?[01])*n?|0[oO][0-7](?:_?[0-7])*n?|(?:\d(?:_?\d)*n|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?))"
JS = re.compile(
    r"(?P<space>[ \t\f\v ﻿]+|//[^\n  ]*)|(?P<nl>[\n  ]+)|(?P<com>/\*[\s\S]*?\*/)|"
    r"""(?P<str>"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*')|"""
    rf"(?P<num>{_JS_NUM}(?![\w$]))|(?P<name>[^\W\d][\w$]*|\$[\w$]*)|(?P<priv>#[^\W\d][\w$]*|#\$[\w$]*)|(?P<tick>`)|"
    r"(?P<op>\.\.\.|>>>=|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|===|!==|=>|==|!=|<=|>=|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|&&|\|\||\?\?|\?\.(?!\d)|\*\*|[-+*/%&|^~!<>()\[\]{},:;.=?@])|(?P<bad>[\s\S])"
)
JS_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
TICK = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(?P<end>`|\$\{)")
JS_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do yield await instanceof extends default".split())
#: words that are names but for the grammars' own literals
JS_RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield await let static async of get set from as".split()
)
TS_WORDS = frozenset("type interface namespace module declare abstract public private protected readonly override implements is asserts keyof unique infer satisfies global out".split())


class Words:
    """Line breaks before tokens, for the predicates."""

    def __init__(self, typed: bool):
        self.typed, self.breaks = typed, []


def script(text: str, g, typed: bool) -> tuple[list[int], Words]:
    t = _terms(g, ("STRING", "NUMBER", "NAME", "REGEX", "PRIVATE", "TEMPLATE", "THEAD", "TMID", "TTAIL", "EOF"))
    out: list[int] = []
    w = Words(typed)
    breaks = w.breaks
    if text.startswith("#!"):
        text = "//" + text[2:]
    at, n, nl = 0, len(text), False
    ticks: list[int] = []
    depth = 0
    before = ""  # the last token that counts: a word, "x" for an operand, or its sign
    match = JS.match
    while at < n:
        m = match(text, at)
        k, s = m.lastgroup, m.group(0)
        at = m.end()
        if k == "space":
            continue
        if k == "nl":
            nl = True
            continue
        if k == "com":
            nl = nl or "\n" in s
            continue
        if k == "name":
            term = t.get(s) if s in JS_RESERVED or s in TS_WORDS else None
            out.append(t["NAME"] if term is None else term)
            before = s
        elif k == "op":
            if s in ("/", "/=") and (before in JS_BEFORE_REGEX or before in ("", "(", ",", "=", ":", "[", "!", "&", "|", "?", "{", "}", ";", "+", "-", "*", "%", "~", "^", "<", ">", "&&", "||", "??", "=>", "==", "===", "!=", "!==", "+=", "<=", ">=")):
                r = JS_REGEX.match(text, m.start())
                if r and not (before == "}" and text[r.end() - 1 : r.end()].isspace()):
                    out.append(t["REGEX"])
                    at = r.end()
                    breaks.append(nl)
                    nl, before = False, "x"
                    continue
            if s == "{":
                depth += 1
            elif s == "}":
                if ticks and ticks[-1] == depth:
                    ticks.pop()
                    x = TICK.match(text, at)
                    if not x:
                        raise LexError("open template")
                    at = x.end()
                    breaks.append(nl)
                    nl = False
                    if x.group("end") == "`":
                        out.append(t["TTAIL"])
                        before = "x"
                    else:
                        out.append(t["TMID"])
                        ticks.append(depth)
                        before = "("
                    continue
                depth -= 1
                if depth < 0:
                    raise LexError("bracket")
            if s not in t:
                raise LexError("operator")
            out.append(t[s])
            before = s
        elif k == "str":
            out.append(t["STRING"])
            before = "x"
        elif k == "num":
            if re.match(r"0\d", s):
                raise LexError("number")
            out.append(t["NUMBER"])
            before = "x"
        elif k == "tick":
            x = TICK.match(text, at)
            if not x:
                raise LexError("open template")
            at = x.end()
            if x.group("end") == "`":
                out.append(t["TEMPLATE"])
                before = "x"
            else:
                out.append(t["THEAD"])
                ticks.append(depth)
                before = "("
        elif k == "priv":
            out.append(t["PRIVATE"])
            before = "x"
        else:
            raise LexError("character")
        breaks.append(nl)
        nl = False
    if ticks:
        raise LexError("open template")
    out.append(t["EOF"])
    breaks += [True, True]
    return out, w


# ---------------------------------------------------------------- Go

_GO_NUM = r"(?:0[xX](?:_?[0-9a-fA-F])+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB](?:_?[01])+|0[oO]?(?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d+)?)i?"
GO = re.compile(
    r"(?P<space>[ \t\r]+|//[^\n]*)|(?P<nl>\n)|(?P<com>/\*[\s\S]*?\*/)|"
    r"""(?P<str>"(?:[^"\\\n]|\\.)*"|`[^`]*`)|(?P<chr>'(?:[^'\\\n]|\\(?:[abfnrtv\\'"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))')|"""
    rf"(?P<num>{_GO_NUM}(?!\w))|(?P<name>[^\W\d]\w*)|"
    r"(?P<op>\.\.\.|<<=|>>=|&\^=|&\^|:=|<-|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|[-+*/%&|^~!<>()\[\]{},:;.=])|(?P<bad>[\s\S])"
)
GO_WORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())


def go(text: str, g) -> list[int]:
    t = _terms(g, ("NAME", "NUMBER", "STRING", "CHAR", "EOF"))
    out: list[int] = []
    ends = False  # whether a line break here ends a statement
    semi = t[";"]
    for m in GO.finditer(text):
        k, s = m.lastgroup, m.group(0)
        if k == "space":
            continue
        if k == "nl" or k == "com":
            if ends and "\n" in s:
                out.append(semi)
                ends = False
            continue
        if k == "name":
            if s in GO_WORDS:
                out.append(t[s])
                ends = s in ("break", "continue", "fallthrough", "return")
            else:
                out.append(t["NAME"])
                ends = True
        elif k == "op":
            if s not in t:
                raise LexError("operator")
            out.append(t[s])
            ends = s in (")", "]", "}", "++", "--")
        elif k == "bad":
            raise LexError("character")
        else:
            out.append(t["STRING" if k == "str" else "CHAR" if k == "chr" else "NUMBER"])
            ends = True
    if ends:
        out.append(semi)
    out.append(t["EOF"])
    return out


# ---------------------------------------------------------------- Java

_JAVA_NUM = r"(?:0[xX][0-9a-fA-F](?:_*[0-9a-fA-F])*[lL]?|0[bB][01](?:_*[01])*[lL]?|(?:\d(?:_*\d)*\.?(?:\d(?:_*\d)*)?|\.\d(?:_*\d)*)(?:[eE][+-]?\d+)?[lLfFdD]?)"
JAVA = re.compile(
    r"(?P<space>[ \t\r\f\n]+|//[^\n]*|/\*[\s\S]*?\*/)|"
    r"""(?P<text>\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\")|(?P<str>"(?:[^"\\\n]|\\.)*")|(?P<chr>'(?:[^'\\\n]|\\(?:[btnfrs0"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4}))')|"""
    rf"(?P<num>{_JAVA_NUM}(?!\w))|(?P<name>non-sealed\b|[^\W\d][\w$]*|\$[\w$]*)|"
    r"(?P<op>\.\.\.|>>>=|<<=|>>=|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[-+*/%&|^~!<>()\[\]{},:;.=?@])|(?P<bad>[\s\S])"
)
JAVA_WORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null record var yield sealed permits non-sealed when module".split()
)


def java(text: str, g) -> list[int]:
    t = _terms(g, ("NAME", "NUMBER", "STRING", "CHAR", "TEXT", "EOF", "const", "goto"))
    out = []
    for m in JAVA.finditer(text):
        k, s = m.lastgroup, m.group(0)
        if k == "space":
            continue
        if k == "name":
            out.append(t.get(s, t["NAME"]) if s in JAVA_WORDS and s not in ("when", "module") else t["when"] if s == "when" and out and out[-1] == t["NAME"] else t["NAME"])
        elif k == "op":
            if s not in t:
                raise LexError("operator")
            out.append(t[s])
        elif k == "bad":
            raise LexError("character")
        else:
            out.append(t[{"str": "STRING", "chr": "CHAR", "text": "TEXT", "num": "NUMBER"}[k]])
    out.append(t["EOF"])
    return out


# ---------------------------------------------------------------- C

_C_NUM = r"(?:0[xX][0-9a-fA-F]+(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?\d+)?|0[bB][01]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)[uUlLfF]*"
C_TOKEN = re.compile(
    r"(?P<space>[ \t\r\f\v\n]+|\\\n|//(?:[^\\\n]|\\[\s\S])*|/\*[\s\S]*?\*/)|"
    r"""(?P<str>(?:u8|[uUL])?"(?:[^"\\\n]|\\[\s\S])*")|(?P<chr>[uUL]?'(?:[^'\\\n]|\\[\s\S])+')|"""
    rf"(?P<num>{_C_NUM}(?!\w))|(?P<name>[^\W\d][\w$]*)|"
    r"(?P<op>\.\.\.|<<=|>>=|->|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|[-+*/%&|^~!<>()\[\]{},:;.=?])|(?P<bad>[\s\S])"
)
C_TYPES = frozenset("void char short int long float double signed unsigned _Bool _Complex __int128".split())
C_WORDS = frozenset(
    "auto break case const continue default do else enum extern for goto if inline register restrict return sizeof static struct switch typedef union volatile while _Alignof _Atomic _Generic _Noreturn _Static_assert _Thread_local asm typeof __attribute__".split()
)
C_ALIKE = {"__inline": "inline", "__inline__": "inline", "__const": "const", "__volatile__": "volatile", "__restrict": "restrict", "__restrict__": "restrict", "__asm__": "asm", "__asm": "asm", "__typeof__": "typeof", "__extension__": None, "static_assert": "_Static_assert", "alignof": "_Alignof"}
DIRECTIVE = re.compile(r"(?m)^[ \t]*#[ \t]*([a-z_]*)(?:[^\\\n]|\\\n|\\[^\n])*")
KNOWN_DIRECTIVES = frozenset("include define undef if ifdef ifndef elif elifdef elifndef else endif error warning pragma line include_next import ident embed".split()) | {""}


def c(text: str, g) -> list[int]:
    t = _terms(g, ("NAME", "NUMBER", "STRING", "CHAR", "TYPE", "EOF"))
    depth = 0

    # directives go, but only outside comments; their conditionals must close
    def drop(m: re.Match) -> str:
        nonlocal depth
        word = m.group(1)
        if word not in KNOWN_DIRECTIVES:
            raise LexError("directive")
        if word in ("if", "ifdef", "ifndef"):
            depth += 1
        elif word == "endif":
            depth -= 1
            if depth < 0:
                raise LexError("endif")
        elif word in ("else", "elif") and not depth:
            raise LexError(word)
        return "\n" * m.group(0).count("\n")

    if "#" in text:
        text = re.sub(r"/\*[\s\S]*?\*/", lambda m: " " + "\n" * m.group(0).count("\n"), text) if "/*" in text else text
        text = DIRECTIVE.sub(drop, text)
        if depth:
            raise LexError("open conditional")
    out = []
    for m in C_TOKEN.finditer(text):
        k, s = m.lastgroup, m.group(0)
        if k == "space":
            continue
        if k == "name":
            s = C_ALIKE.get(s, s)
            if s is None:
                continue
            out.append(t["TYPE"] if s in C_TYPES else t.get(s, t["NAME"]) if s in C_WORDS else t["NAME"])
        elif k == "op":
            if s not in t:
                raise LexError("operator")
            out.append(t[s])
        elif k == "bad":
            raise LexError("character")
        else:
            out.append(t[{"str": "STRING", "chr": "CHAR", "num": "NUMBER"}[k]])
    out.append(t["EOF"])
    return out


# ---------------------------------------------------------------- shell

SHELL_WORDS = frozenset("if then elif else fi while until do done for select case in esac function coproc time { } !".split())
SHELL_OPS = ("&&", "||", ";;&", ";;", ";&", "|&", ";", "&", "|", "(", ")")
REDIR = re.compile(r"(?:\d+|\{\w+\})?(?:<<<|<>|>>|>\||>&|<&|&>>|&>|<|>)")
HEREDOC = re.compile(r"\d*<<(-?)[ \t]*")
ASSIGNMENT = re.compile(r"[A-Za-z_]\w*(?:\[[^\]\n]*\])?\+?=")
PLAIN_WORD = re.compile(r"[A-Za-z0-9_./:,@%^+=~\[\]*?\-]+")
META = " \t\n;&|()<>"


def shell(text: str, g) -> list[list[int]]:
    """Token lists: of the script, and of every command substitution in it."""
    t = _terms(g, ("WORD", "ASSIGN", "REDIRECT", "HEREDOC", "ARITH", "COND", "NL", "EOF"))
    lists: list[list[int]] = []
    _shell(text.replace("\\\r\n", "\\\n"), 0, t, lists, "")
    return lists


def _shell(s: str, at: int, t: dict[str, int], lists: list[list[int]], until: str) -> int:
    out: list[int] = []
    n = len(s)
    heredocs: list[tuple[str, bool]] = []
    command = True  # whether a word here would start a command
    cases = 0
    while True:
        while at < n and (s[at] in " \t\r" or s.startswith("\\\n", at)):
            at += 2 if s[at] == "\\" else 1
        if at >= n:
            if until:
                raise LexError("open substitution")
            break
        ch = s[at]
        if ch == "#":
            e = s.find("\n", at)
            at = n if e < 0 else e
            continue
        if ch == "\n":
            out.append(t["NL"])
            at += 1
            for word, strip in heredocs:
                while True:
                    e = s.find("\n", at)
                    line = s[at:] if e < 0 else s[at:e]
                    at = n if e < 0 else e + 1
                    if (line.lstrip("\t") if strip else line).rstrip("\r") == word or e < 0:
                        break
            heredocs = []
            command = True
            continue
        if ch == "`" and until == "`":
            at += 1
            break
        if command and s.startswith("((", at):
            e = _balanced(s, at + 2, "((")
            if e > 0:
                out.append(t["ARITH"])
                at = e
                command = False
                continue
        if ch == ")" and until == ")" and not _open_paren(out, t) and not cases:
            at += 1
            break
        if m := HEREDOC.match(s, at):
            if not s.startswith("<<<", m.end() - len(m.group(0)) + len(re.match(r"\d*", m.group(0)).group(0))):
                e = _word(s, m.end(), t, lists, until)
                if e == m.end():
                    raise LexError("heredoc")
                heredocs.append((re.sub(r"[\"'\\]", "", s[m.end() : e]), m.group(1) == "-"))
                out.append(t["HEREDOC"])
                at = e
                continue
        if not s.startswith(("<(", ">("), at) and (m := REDIR.match(s, at)):
            out.append(t["REDIRECT"])
            at = m.end()
            continue
        for op in SHELL_OPS:
            if s.startswith(op, at):
                break
        else:
            op = ""
        if op:
            if op not in t:
                raise LexError("operator")
            out.append(t[op])
            at += len(op)
            command = True
            continue
        e = _word(s, at, t, lists, until)
        if e == at:
            raise LexError("word")
        w = s[at:e]
        at = e
        if w == "[[" and command:
            at = _condition(s, at, t, lists)
            out.append(t["COND"])
            command = False
        elif w in SHELL_WORDS:
            out.append(t[w])
            if w == "case" and command:
                cases += 1
            elif w == "esac" and command and cases:
                cases -= 1
            command = command and w in ("if", "then", "elif", "else", "while", "until", "do", "{", "!", "time") or w in ("then", "do", "else") and command
        elif m := ASSIGNMENT.match(w):
            out.append(t["ASSIGN"])
            command = command and not s.startswith("(", at)
        else:
            out.append(t["WORD"])
            command = False
    out.append(t["EOF"])
    lists.append(out)
    return at


def _open_paren(out: list[int], t: dict[str, int]) -> bool:
    return out.count(t["("]) > out.count(t[")"])


def _balanced(s: str, at: int, kind: str) -> int:
    """The end of ``((...))``, or -1 if it is no arithmetic."""
    depth = 0
    while at < len(s):
        c = s[at]
        if c == "\\":
            at += 1
        elif c in "\"'":
            e = s.find(c, at + 1)
            if e < 0:
                return -1
            at = e
        elif c == "(":
            depth += 1
        elif c == ")":
            if depth == 0:
                return at + 2 if s.startswith("))", at) else -1
            depth -= 1
        at += 1
    return -1


def _condition(s: str, at: int, t: dict[str, int], lists: list[list[int]]) -> int:
    depth = 0
    while True:
        while at < len(s) and (s[at] in " \t\n\r" or s.startswith("\\\n", at)):
            at += 1
        if at >= len(s):
            raise LexError("open [[")
        if s[at] in "()":
            depth += 1 if s[at] == "(" else -1
            at += 1
            continue
        if s[at] in "&|<>;":
            at += 1
            continue
        e = _word(s, at, t, lists, "[[")
        w = s[at:e]
        if e == at:
            raise LexError("word")
        at = e
        if w == "]]":
            if depth:
                raise LexError("bracket")
            return at


def _word(s: str, at: int, t: dict[str, int], lists: list[list[int]], until: str) -> int:
    n = len(s)
    while at < n:
        if m := PLAIN_WORD.match(s, at):
            at = m.end()
            if at >= n:
                break
        c = s[at]
        if c == "\\":
            at += 2
        elif c == "'":
            e = s.find("'", at + 1)
            if e < 0:
                raise LexError("open quote")
            at = e + 1
        elif c == '"':
            at = _quoted(s, at + 1, t, lists)
        elif c == "$":
            if s.startswith("$'", at):
                m = re.compile(r"\$'(?:[^'\\]|\\[\s\S])*'").match(s, at)
                if not m:
                    raise LexError("open quote")
                at = m.end()
            else:
                at = _dollar(s, at, t, lists)
        elif c == "`":
            if until == "`":
                break
            at = _shell(s, at + 1, t, lists, "`")
        elif s.startswith(("<(", ">("), at):
            at = _shell(s, at + 2, t, lists, ")")
        elif c == "(" and s[at - 1 : at] in "?*+@!" and at and until == "[[":
            e = _balanced(s + ")", at + 1, "(")
            at = s.find(")", at) + 1 or n
        elif c in META:
            break
        else:
            at += 1
    return min(at, n)


def _quoted(s: str, at: int, t: dict[str, int], lists: list[list[int]]) -> int:
    n = len(s)
    while at < n:
        c = s[at]
        if c == '"':
            return at + 1
        if c == "\\":
            at += 2
        elif c == "$":
            at = _dollar(s, at, t, lists)
        elif c == "`":
            at = _shell(s, at + 1, t, lists, "`")
        else:
            m = re.compile(r'[^"\\$`]+').match(s, at)
            at = m.end()
    raise LexError("open quote")


def _dollar(s: str, at: int, t: dict[str, int], lists: list[list[int]]) -> int:
    if s.startswith("$((", at):
        e = _balanced(s, at + 3, "((")
        if e > 0:
            return e
    if s.startswith("$(", at):
        return _shell(s, at + 2, t, lists, ")")
    if s.startswith("${", at):
        at += 2
        while at < len(s):
            c = s[at]
            if c == "}":
                return at + 1
            if c == "\\":
                at += 2
            elif c == "'" :
                e = s.find("'", at + 1)
                at = e + 1 if e >= 0 else at + 1
            elif c == '"':
                at = _quoted(s, at + 1, t, lists)
            elif c == "$":
                at = _dollar(s, at, t, lists)
            elif c == "`":
                at = _shell(s, at + 1, t, lists, "`")
            else:
                at += 1
        raise LexError("open parameter")
    return at + 1


# ---------------------------------------------------------------- YAML

YAML_PLAIN = re.compile(r"(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[\-?:](?=[^\s]))(?:[^\s:#]|:(?=\S)|(?<=\S)#|[ \t]+(?=[^\s#]))*")
YAML_FLOW_PLAIN = re.compile(r"(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[\-?:](?=[^\s,\[\]{}]))(?:[^\s:#,\[\]{}]|:(?=[^\s,\[\]{}])|(?<=\S)#|[ \t]+(?=[^\s#,\[\]{}:]))*")
YAML_DOUBLE = re.compile(r'"(?:[^"\\]|\\(?:[0abt\tnvfre "/\\N_LP\n]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*"')
YAML_SINGLE = re.compile(r"'(?:[^']|'')*'")
YAML_PROP = re.compile(r"(?:&[^\s,\[\]{}]+|!(?:<[^>\s]*>|[^\s,\[\]{}]*))(?=[\s,\]}]|$)")
YAML_ALIAS = re.compile(r"\*[^\s,\[\]{}]+")
YAML_BLOCK = re.compile(r"[|>](?:[1-9][+-]?|[+-][1-9]?)?[ \t]*(?:#[^\n]*)?(?=\n|$)")


def yaml(text: str, g) -> list[int]:
    t = _terms(g, ("DOCSTART", "DOCEND", "PROP", "ALIAS", "SCALAR", "BLOCKTEXT", "MAP", "SEQ", "DASH", "END", "KEY", "VALUE", "EOF"))
    if re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", text):
        raise LexError("control character")
    out: list[int] = []
    levels: list[tuple[int, str]] = [(-1, "")]  # column and kind of the open collections
    at, n = 0, len(text)
    line = 0  # where the line starts
    fresh = True  # only white space and indicators so far in this line
    flow = 0
    last_line_value = False
    pending = -1  # a plain scalar's column may be followed by more lines of it

    def close(col: int) -> None:
        while levels[-1][0] > col:
            out.append(t["END"])
            levels.pop()

    while at < n:
        c = text[at]
        if c == "\n":
            at += 1
            line, fresh, last_line_value = at, True, False
            continue
        if c in " \t\r":
            if c == "\t" and fresh and not flow and not text[line:at].strip() and text[at:].lstrip(" \t")[:1] not in ("\n", "#", ""):
                raise LexError("tab")
            at += 1
            continue
        if c == "#" and (at == line or text[at - 1] in " \t\n"):
            e = text.find("\n", at)
            at = n if e < 0 else e
            continue
        col = at - line
        if flow:
            if c in "[{":
                flow += 1
                out.append(t[c])
                at += 1
            elif c in "]}":
                flow -= 1
                out.append(t[c])
                at += 1
                if not flow and YAML_KEY_AFTER.match(text, at):
                    raise LexError("flow key")
            elif c == ",":
                out.append(t[","])
                at += 1
            elif c == ":" and (text[at + 1 : at + 2] in " \t\n,[]{}" or at + 1 >= n or text[at - 1] in "\"'"):
                out.append(t[":"])
                at += 1
            elif c == "?" and text[at + 1 : at + 2] in " \t\n":
                out.append(t["?"])
                at += 1
            else:
                for kind, pattern in (("SCALAR", YAML_DOUBLE), ("SCALAR", YAML_SINGLE), ("PROP", YAML_PROP), ("ALIAS", YAML_ALIAS), ("SCALAR", YAML_FLOW_PLAIN)):
                    if m := pattern.match(text, at):
                        break
                else:
                    raise LexError("character")
                if not (kind == "SCALAR" and out[-1] == t["SCALAR"] and pattern is YAML_FLOW_PLAIN):
                    out.append(t[kind])
                at = m.end()
            continue
        if col == 0 and re.compile(r"(---|\.\.\.)(?=\s|$)").match(text, at):
            close(-1)
            out.append(t["DOCSTART" if c == "-" else "DOCEND"])
            at += 3
            fresh, last_line_value = False, False
            continue
        if col == 0 and c == "%" and (not out or out[-1] == t["DOCEND"]):
            e = text.find("\n", at)
            at = n if e < 0 else e
            continue
        if fresh:
            close(col)
            if levels[-1] == (col, "dash") and not (c == "-" and text[at + 1 : at + 2] in " \t\n\r"):
                levels.pop()  # a sequence at its key's own column ends without a token
        if c == "-" and (at + 1 >= n or text[at + 1] in " \t\n\r"):
            if last_line_value:
                raise LexError("sequence in a value")
            if levels[-1][0] < col:
                out.append(t["SEQ"])
                levels.append((col, "seq"))
            elif levels[-1] == (col, "map"):
                levels.append((col, "dash"))
            elif not fresh:
                raise LexError("sequence")
            out.append(t["DASH"])
            at += 1
            continue
        if c == "?" and (at + 1 >= n or text[at + 1] in " \t\n\r"):
            if levels[-1][0] < col:
                out.append(t["MAP"])
                levels.append((col, "map"))
            out.append(t["KEY"])
            at += 1
            continue
        if c == ":" and (at + 1 >= n or text[at + 1] in " \t\n\r"):
            if levels[-1][0] < col:
                out.append(t["MAP"])
                levels.append((col, "map"))
            out.append(t["VALUE"])
            at += 1
            last_line_value = True
            continue
        # a node: is it a key?
        start = at
        props = []
        while m := YAML_PROP.match(text, at):
            props.append(t["PROP"])
            at = m.end()
            while at < n and text[at] in " \t":
                at += 1
        if at >= n or text[at] == "\n" or text[at] == "#":
            out += props
            fresh = False
            continue
        c = text[at]
        if c in "[{":
            if last_line_value is False and fresh and levels[-1][0] >= col and levels[-1][1] == "map" and levels[-1][0] == col and out[-1:] != [t["VALUE"]]:
                pass
            out += props
            out.append(t[c])
            at += 1
            flow = 1
            fresh = False
            continue
        if (m := YAML_BLOCK.match(text, at)) and not fresh or (m and not levels[-1][1]):
            out += props
            out.append(t["BLOCKTEXT"])
            parent = max(levels[-1][0], 0) if levels[-1][1] != "" else -1
            at = m.end()
            # its lines are those that are blank or lie deeper than the parent
            while at < n:
                e = text.find("\n", at + 1)
                e = n if e < 0 else e
                body = text[at + 1 : e]
                if body.strip() and len(body) - len(body.lstrip(" ")) <= parent:
                    break
                at = e
            fresh = False
            continue
        for kind, pattern in (("SCALAR", YAML_DOUBLE), ("SCALAR", YAML_SINGLE), ("ALIAS", YAML_ALIAS), ("SCALAR", YAML_PLAIN)):
            if m := pattern.match(text, at):
                break
        else:
            raise LexError("character")
        at = m.end()
        after = YAML_KEY_AFTER.match(text, at)
        if after and "\n" not in m.group(0):
            if last_line_value:
                raise LexError("mapping value not allowed here")
            if levels[-1][0] < col_of(start, line):
                out.append(t["MAP"])
                levels.append((start - line, "map"))
            elif levels[-1][0] != start - line or levels[-1][1] == "seq":
                raise LexError("indentation")
            out.append(t["KEY"])
            out += props
            out.append(t[kind])
            out.append(t["VALUE"])
            at = after.end()
            last_line_value = True
            fresh = False
            continue
        if fresh and out and out[-1] == t["SCALAR"] and pattern is YAML_PLAIN and not props and start - line > levels[-1][0]:
            fresh = False
            continue  # a plain scalar goes on over lines
        if fresh and levels[-1][1] in ("map", "seq", "dash") and start - line <= levels[-1][0]:
            raise LexError("scalar beside a collection")
        out += props
        out.append(t[kind])
        if pattern in (YAML_DOUBLE, YAML_SINGLE):
            rest = text[at : text.find("\n", at) if text.find("\n", at) >= 0 else n].strip()
            if rest and not rest.startswith("#"):
                raise LexError("text after a quoted scalar")
            line = max(line, text.rfind("\n", 0, at) + 1)
        fresh = False
    if flow:
        raise LexError("open flow collection")
    close(-1)
    while len(levels) > 1:
        out.append(t["END"]) if levels[-1][1] != "dash" else None
        levels.pop()
    out.append(t["EOF"])
    return out


YAML_KEY_AFTER = re.compile(r"[ \t]*:(?=[ \t\r\n]|$)")


def col_of(at: int, line: int) -> int:
    return at - line
