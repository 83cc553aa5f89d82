"""Credentials embedded in source code: find and mask.

Method. One deterministic automaton (Aho-Corasick over the lower-cased text) holds every anchor: the
prefixes of issued token formats, key armor, ``://`` of connection strings, credential stems of
names, and authentication schemes. Each accepting state names the grammar to run at that place; a
grammar yields absolute character spans of the secret's own text. A text longer than ``WINDOW`` is
scanned for anchors in windows that overlap by ``OVERLAP``; a grammar reads its value to the end, however
long, and spans are absolute, so what two windows (or two grammars) find is one span. Masking splices
``MASK`` over the spans and leaves every other character.

Defined results: NULL content gives no spans and stays NULL; empty text gives none; repeated rows
give the same spans (``find_lines`` returns each id and line once); other columns pass through.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW, OVERLAP = 1 << 20, 1 << 14
MASK = "REDACTED"

# Prefixes and shapes of publicly documented token formats.
TOKEN_SHAPES = {
    "akia": r"(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "asia": r"(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "ghp_": r"gh[pousr]_[A-Za-z0-9]{20,}",
    "gho_": r"gh[pousr]_[A-Za-z0-9]{20,}",
    "ghs_": r"gh[pousr]_[A-Za-z0-9]{20,}",
    "ghu_": r"gh[pousr]_[A-Za-z0-9]{20,}",
    "ghr_": r"gh[pousr]_[A-Za-z0-9]{20,}",
    "github_pat_": r"github_pat_[A-Za-z0-9_]{20,}",
    "glpat-": r"glpat-[A-Za-z0-9_\-]{16,}",
    "xoxb-": r"xox[abprs]-[0-9A-Za-z\-]{10,}",
    "xoxp-": r"xox[abprs]-[0-9A-Za-z\-]{10,}",
    "xoxa-": r"xox[abprs]-[0-9A-Za-z\-]{10,}",
    "xoxs-": r"xox[abprs]-[0-9A-Za-z\-]{10,}",
    "xoxr-": r"xox[abprs]-[0-9A-Za-z\-]{10,}",
    "aiza": r"AIza[0-9A-Za-z_\-]{30,}",
    "sk_live_": r"[srp]k_live_[0-9A-Za-z]{16,}",
    "rk_live_": r"[srp]k_live_[0-9A-Za-z]{16,}",
    "sk-": r"sk-(?:proj-|ant-)?[A-Za-z0-9_\-]{20,}",
    "eyj": r"eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}",
    "npm_": r"npm_[A-Za-z0-9]{30,}",
    "pypi-": r"pypi-[A-Za-z0-9_\-]{30,}",
    "sg.": r"SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}",
    "hf_": r"hf_[A-Za-z0-9]{30,}",
    "dop_v1_": r"dop_v1_[a-f0-9]{40,}",
    "ya29.": r"ya29\.[A-Za-z0-9_\-]{20,}",
}
SHAPES = {k: re.compile(v) for k, v in TOKEN_SHAPES.items()}

# Chosen here: stems of names that hold credentials, and words that make a name speak of one only.
STEMS = ("pass", "pwd", "secret", "token", "key", "cred", "auth", "pw", "pin", "salt")
DIRECT = frozenset(
    "pass password passwd passphrase passcode pwd pw secret token apikey credential credentials cred creds auth pin".split()
)
KEY_OF = frozenset(
    "api access private secret signing encryption master licence license hmac service account deploy ssh client "
    "webhook session storage shared auth app admin crypt cipher decryption sign root".split()
)
ABOUT = frozenset(
    "header headers field fields name names kind column columns policy mode file files env path paths limit id ids "
    "hash digest ttl host port size window count url uri type types label hint help text len length min max ref "
    "expiry expires timeout regex pattern prefix suffix template param params arg index placeholder enabled".split()
)
PLAIN = re.compile(
    r"(?i)(change[_-]?me|redacted|placeholder|example|dummy|your[_-]|todo|fixme|^none$|^null$|^true$|^false$|"
    r"insert[_-]|replace[_-]|set[_-]me|fill[_-]|not[_-]?set|sample[_-]?(key|token|secret)|fake|[<>]|\$\{|\$\(|\{\{|%\(|#\{|\.\.\.|…|^\$|"
    r"^(vault|env|ssm|kms|arn|file|op|secretsmanager|keyring|sops|aws|gcp|azure):|^os\.|^process\.)"
)
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
NAME = re.compile(r"[A-Za-z0-9_$\-]")
STRING = re.compile(r"""(?:\b[bBuUrR]{1,2})?("(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)""")
ASSIGN = re.compile(
    r"""["'\]]{0,2}\s*(?:\?|!)?(?:\s*:\s*(?:string|str|String|any|&'static str|char\s*\*|Optional\[str\]|bytes)\s*(?=[=]))?\s*(?:\[\])?\s*(:=|=>|===?|!==?|=|:)\s*"""
)
WRAP = re.compile(
    r"(?:(?:await|new|String|str|bytes|base64\.|binascii\.|Base64\.getDecoder\(\)\.|base64\.StdEncoding\.)*\s*"
    r"(?:b64decode|atob|decode|DecodeString|Buffer\.from|getenv_default|a2b_base64|from_hex|fromhex|strdup|String|bytes|str)?\s*\(\s*)+"
)
JOIN = re.compile(r"(?:[ \t]*\\?\r?\n[ \t]*|[ \t]*)(?:[+.][ \t]*(?:\r?\n[ \t]*)?)?(?=[bBuUrR]{0,2}[\"'`])")
UNIT = re.compile(r"[^\s;,\"'`()\[\]{}<>|]+")
CODED = re.compile(r"(?i)b64|atob|base64|decodestring|unhex|fromhex")
DSN = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://([^\s/:@\"'`<>]*):([^\s/@\"'`]+)@[^\s\"'`]")
ARMOR = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY( BLOCK)?-----")
SCHEME = re.compile(r"(?i)\b(bearer|basic|token|apikey|digest|negotiate|key)\s+([A-Za-z0-9+/=_.\-~!&%#@:]{8,})(?=[\"'`\s\\;,)]|$)")
FLAG = re.compile(r"(?:-u|--user|--password|-p)[ =]\s*[\"']?([^\s:\"']+:)?([^\s\"'@]{6,})")


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    kinds: dict[str, set[str]] = {}
    for p in SHAPES:
        kinds.setdefault(p, set()).add("shape")
    for s in STEMS:
        kinds.setdefault(s, set()).add("name")
    kinds.setdefault("://", set()).add("dsn")
    kinds.setdefault("-----begin ", set()).add("armor")
    for s in ("bearer ", "basic ", "token ", "apikey ", "authorization", "x-auth"):
        kinds.setdefault(s, set()).add("scheme")
    for s in ("curl ", "sshpass ", "login ", "log in ", "sign in "):
        kinds.setdefault(s, set()).add("flag")
    for p, k in kinds.items():
        a.add_word(p, (p, tuple(sorted(k))))
    a.make_automaton()
    return a


def _credential_name(name: str) -> bool:
    words = [w.lower() for w in WORDS.findall(name) if not w.isdigit()]
    if not words or "public" in words or "pub" in words or words[-1] in ABOUT:
        return False
    joined = "".join(words[-2:])
    for k in range(len(words)):
        if words[k] in DIRECT:
            return True
        if words[k] == "key" and k and words[k - 1] in KEY_OF:
            return True
    return joined in ("apikey", "accesskey", "dbpass", "redisauth") or words[-1].endswith(("password", "passwd", "apikey", "secret"))


def _path_like(v: str) -> bool:
    return bool(re.fullmatch(r"(?:~|\.{0,2})(?:/[a-z0-9_.\-]+)+/?|[a-z_\-]+(?:/[a-z0-9_\-.]+)+", v))


def _key_like(v: str) -> bool:
    """A long run of mixed letters and digits: a placeholder's word in it is there by chance."""
    return len(v) > 256 and bool(re.fullmatch(r"[A-Za-z0-9+/_\-]+=*", v)) and len(set(v)) >= 48


def _usable(v: str, quoted: bool = True) -> bool:
    """Whether a value under a credential's name could be used as it stands."""
    if len(v) < 6 or re.search(r"\s", v) or PLAIN.search(v) and not _key_like(v) or _path_like(v):
        return False
    core = re.sub(r"[^A-Za-z0-9]", "", v)
    if len(set(core)) < 4 or not re.search(r"[A-Za-z]", v) and len(core) < 6:
        return False
    if re.match(r"[a-z][a-z0-9+.\-]*://", v):
        return False
    if re.search(r"\d", v):
        if re.fullmatch(r"\d+", v):
            return quoted and len(v) >= 8
        if re.fullmatch(r"[A-Z]+(_[A-Z0-9]+)+", v) or re.fullmatch(r"[a-z0-9\-]+(\.[a-z0-9\-]+)+", v):
            return False
        return True
    if re.search(r"[!&%#@^*~?+=$]", v) and re.search(r"[A-Za-z]{3}", v):
        return True
    if re.search(r"[a-z]", v) and re.search(r"[A-Z]", v) and re.fullmatch(r"[A-Za-z0-9+/=_\-]{8,}", v):
        # letters only: words in camel case or capitals are names, not keys
        return len(WORDS.findall(v)) >= max(4, len(v) / 4)
    return False


def _literal(text: str, at: int, end: int) -> tuple[str, list[tuple[int, int]], int] | None:
    """The string that starts at ``at``, with what is joined to it: text, spans of its parts, end."""
    parts, spans = [], []
    while m := STRING.match(text, at, end):
        a, b = m.start(1) + 1, m.end(1) - 1
        parts.append(text[a:b])
        spans.append((a, b))
        at = m.end()
        j = JOIN.match(text, at, end)
        if not j or not STRING.match(text, j.end(), end):
            break
        at = j.end()
    return ("".join(parts), spans, at) if spans else None


def _decoded(v: str) -> str:
    bare = re.sub(r"\s|\\[nr]", "", v)  # decoders skip line breaks
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True).decode("ascii")
    except (ValueError, binascii.Error):
        return v


def _key_text(body: str) -> bool:
    """Whether what stands between the armor lines can be a key and is no placeholder."""
    plain = re.sub(r"\\[nr]", "", body)
    return len(re.sub(r"[^A-Za-z0-9+/=]", "", plain)) >= 24 and not re.search(r"(?i)\.\.\.|<|redacted|placeholder|your|x{12}|\$\{", plain)


KEY_LINE = re.compile(r"(?P<before>[ \t\r#*/+\"'`,;(]*)(?P<key>[A-Za-z0-9+/]*={0,2})(?P<after>[ \t\r+\"'`,;)\\]*)(?P<rest>.*)")
KEY_HEADER = re.compile(r"[ \t\r#*/+\"'`,]*[A-Za-z][A-Za-z0-9-]*: ")


def _key_end(text: str, at: int) -> int:
    """Where a key without an END line stops: after its last line (real or escaped) of key text."""
    end, begun = at, False
    while at < len(text):
        cut = BREAK.search(text, at)
        stop = cut.start() if cut else len(text)
        line = KEY_LINE.match(text, at, stop)
        key = line.group("key")
        if len(key) >= 16:
            end, begun = line.end("key"), True
            if line.group("rest"):
                break
        elif key or line.group("rest"):
            if begun and not line.group("rest") and not re.fullmatch(r"[a-z]+", key):
                end = line.end("key")  # the last line is a short one
            if begun or not KEY_HEADER.match(text, at, stop):
                break
        at = cut.end() if cut else stop
    return end


BREAK = re.compile(r"\n|\\n")


def _in_comment_or_string(text: str, at: int) -> bool:
    start = text.rfind("\n", 0, at) + 1
    head = text[start:at]
    s = head.lstrip()
    if s.startswith(("#", "//", "*", "/*", "--", ";")) or " //" in head or " # " in head or "\t//" in head:
        return True
    for q in ('"', "'", "`"):
        if head.count(q) % 2:
            return True
    return False


def _name(text: str, at: int, end: int, low: int, high: int, config: bool) -> Iterator[tuple[int, int]]:
    """Grammar of ``name <- value``: the identifier around an anchor, an assignment, a literal."""
    a, b = at, end
    while a > low and NAME.match(text[a - 1]):
        a -= 1
    while b < high and NAME.match(text[b]):
        b += 1
    if text[a:b].lower() in ("password", "passphrase", "key", "token", "secret", "pwd", "passwd", "credential", "pin"):
        yield from _said(text, a, b, low, high)
    if not _credential_name(text[a:b].strip("-")):
        return
    m = ASSIGN.match(text, b, high)
    if not m or "\n" in m.group(0).rstrip():
        yield from _remarked(text, a, low, high)
        return
    op, at = m.group(1), m.end()
    if "\n" in text[b:at] and not config:
        at = m.end()
    coded = False
    w = WRAP.match(text, at, high)
    if w and STRING.match(text, w.end(), high):
        coded, at = bool(CODED.search(w.group(0))), w.end()
    elif text[at : at + 1] == "(":
        p = re.compile(r"\(\s*").match(text, at, high)
        at = p.end()
    if found := _literal(text, at, high):
        value, spans, _ = found
        if "\n" in text[b:at] and not w and text[at - 1 : at] not in "(\n \t":
            return
        clear = _decoded(value) if coded else value
        if coded and (key := ARMOR.search(clear)):
            if _key_text(clear[key.end() :].partition("-----END ")[0]):
                yield from spans
            return
        if _usable(clear):
            if not ARMOR.search(value) and not ("://" in value and DSN.search(value)):
                yield from spans
            return
        if inner := SCHEME.match(value):
            if _usable(inner.group(2)):
                s0 = spans[0][0]
                yield (s0 + inner.start(2), s0 + inner.end(2)) if len(spans) == 1 else (s0, spans[-1][1])
        return
    if op in ("==", "===", "!=", "!=="):
        return
    if "\n" in text[m.start() : at]:
        return
    if config or _in_comment_or_string(text, a):
        if (u := UNIT.match(text, at, high)) and not text.startswith(("(", "["), u.end()):
            v = u.group(0).rstrip(".") if not config else u.group(0)
            if _usable(v, quoted=False) and not SHAPES_ANY.match(v) and "://" not in v:
                if config or not re.fullmatch(r"[a-z_]+\d*|[a-z]+(?:\.[a-z_]+)+", v):
                    yield u.start(), u.start() + len(v)


SAID = re.compile(r"[ \t]+(?:(?:is|was|=|:)[ \t]+)?([^\s\"'`(),;<>]{6,})")
LOGIN = re.compile(r"(?i)(?:login|log in|sign in|signin)[ \t]+(?:with|as|is|using|:)[ \t]+\S+[ \t]*[/:][ \t]*([^\s\"'`(),;<>]{6,})")
SSHPASS = re.compile(r"sshpass[ \t]+-p[ \t]*[\"']?([^\s\"']{4,})")


def _said(text: str, at: int, b: int, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Grammar of a comment that tells a credential: ``temp password hammer-kettle-82 until Friday``."""
    m = SAID.match(text, b, high)
    if m and re.search(r"\d", m.group(1)) and _usable(m.group(1), quoted=False) and _in_comment_or_string(text, at):
        start = max(low, text.rfind("\n", low, at) + 1)
        if text[start:at].lstrip()[:2] in ("//", "/*") or text[start:at].lstrip()[:1] in ("#", "*"):
            yield m.span(1)


def _remarked(text: str, at: int, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Grammar of ``call("user", "value") # user and password``: a remark at the line's end names it."""
    start = max(low, text.rfind("\n", low, at) + 1)
    head = text[start:at]
    mark = max(head.rfind("//"), head.rfind(" #"), head.rfind("/*"))
    if mark < 0 or head[:mark].count('"') % 2 or not head[:mark].rstrip().endswith((")", ";", '"', "'", ",")):
        return
    found = list(STRING.finditer(text, start, start + mark))
    if found and _usable(text[found[-1].start(1) + 1 : found[-1].end(1) - 1]):
        yield found[-1].start(1) + 1, found[-1].end(1) - 1


SHAPES_ANY = re.compile("|".join(sorted(set(TOKEN_SHAPES.values()))))


def spans_of(text: str, config: bool = False) -> list[tuple[int, int]]:
    """Absolute, sorted, disjoint spans of the secrets' own text."""
    if not text:
        return []
    found: set[tuple[int, int]] = set()
    for w0 in range(0, max(1, len(text)), WINDOW - OVERLAP):
        low, high = w0, min(len(text), w0 + WINDOW)
        # a stem found at the window's edge is read again by the next window, with its whole value
        _scan(text, low, high, config, found)
        if high == len(text):
            break
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
        if a >= b:
            continue
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], b))
        else:
            merged.append((a, b))
    return merged


def _scan(text: str, low: int, high: int, config: bool, found: set[tuple[int, int]]) -> None:
    piece = text[low:high] if (low, high) != (0, len(text)) else text
    # an anchor lies within the window, its value may go beyond; a line is read to the end of the value at the edge
    edge = re.compile(r"\s|$").search(text, high).start()
    lowered = piece.lower()
    if len(lowered) != len(piece):  # a few letters grow when lowered; offsets must not move
        lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in piece)
    named = -1
    for stop, (anchor, kinds) in automaton().iter(lowered):
        at = low + stop - len(anchor) + 1
        for kind in kinds:
            if kind == "shape":
                m = SHAPES[anchor].match(text, at)
                if not m and at > low and text[at - 1] in "\"'`":
                    lit = _literal(text, at - 1, len(text))
                    if lit and len(lit[1]) > 1 and SHAPES[anchor].fullmatch(lit[0]) and not PLAIN.search(lit[0]):
                        found.update(lit[1])
                if m and not (at > low and re.match(r"[A-Za-z0-9]", text[at - 1])) and len(set(m.group(0))) >= 10 and not PLAIN.search(m.group(0)):
                    span = m.span()
                    if anchor in ("akia", "asia"):
                        found.add(span)
                        pair = re.compile(r"""["']?\s*[,;:/]\s*["']?([A-Za-z0-9/+=]{40})(?![A-Za-z0-9/+=])""").match(text, m.end())
                        if pair:
                            found.add(pair.span(1))
                    else:
                        lit = _around(text, span, low, len(text))
                        found.update(lit or [span])
            elif kind == "name":
                if at <= named:
                    continue
                named = at
                found.update(_name(text, at, at + len(anchor), low, len(text), config))
            elif kind == "dsn":
                start = at
                while start > low and re.match(r"[A-Za-z0-9+.\-]", text[start - 1]):
                    start -= 1
                m = DSN.match(text, start)
                if m and len(m.group(2)) >= 4 and not PLAIN.search(m.group(2)) and len(set(m.group(2))) > 2 and m.group(2).lower() not in ("password", "pass", "secret", "pwd", "passwd"):
                    found.add(m.span(2))
            elif kind == "armor":
                m = ARMOR.match(text, at)
                if m:
                    stop_at = re.compile(r"-----END [A-Z0-9 ]*-----").search(text, m.end())
                    body = text[m.end() : stop_at.start() if stop_at else _key_end(text, m.end())]
                    if _key_text(body):
                        found.add((m.start(), m.end() + len(body)))
            elif kind == "scheme":
                m = SCHEME.match(text, at)
                if m and _usable(m.group(2)) and len(m.group(2)) >= 12 and re.search(r"\d|[A-Z]", m.group(2)[1:]):
                    v = _decoded(m.group(2)) if m.group(1).lower() == "basic" else m.group(2)
                    if not PLAIN.search(v):
                        found.add(m.span(2))
                elif anchor in ("authorization", "x-auth"):
                    line = text.find("\n", at, edge)
                    line = edge if line < 0 else line
                    for m in SCHEME.finditer(text, at, line):
                        if _usable(m.group(2)):
                            found.add(m.span(2))
            elif kind == "flag":
                line = text.find("\n", at, edge)
                if anchor != "curl ":
                    m = (SSHPASS if anchor == "sshpass " else LOGIN).match(text, at, edge if line < 0 else line)
                    if m and _usable(m.group(1)):
                        found.add(m.span(1))
                    continue
                for m in FLAG.finditer(text, at, edge if line < 0 else line):
                    if m.group(1) and _usable(m.group(2)):
                        found.add(m.span(2))


def _around(text: str, span: tuple[int, int], low: int, high: int) -> list[tuple[int, int]] | None:
    """If the token starts a literal that is joined to others, the spans of all its parts."""
    a = span[0]
    if a > low and text[a - 1] in "\"'`":
        lit = _literal(text, a - 1, high)
        if lit and len(lit[1]) > 1:
            return lit[1]
    return None


def masked(text: str | None, config: bool = False) -> str | None:
    """The text with every secret replaced; armor lines and line breaks of a key block stay."""
    if not text:
        return text
    out, at = [], 0
    for a, b in spans_of(text, config):
        out.append(text[at:a])
        body = text[a:b]
        m = ARMOR.match(body)
        if m:
            out.append(m.group(0) + re.sub(r"(?<!\\)[A-Za-z0-9+/=]{4,}|(?<=\\n)[A-Za-z0-9+/=]{4,}", MASK, body[m.end() :]))
        else:
            out.append(MASK)
        at = b
    out.append(text[at:])
    return "".join(out)


def _lines(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """1-based numbers of the lines on which secrets begin; parts joined over lines count at the first."""
    lines, last_end = [], -1
    for a, b in spans:
        joined = last_end >= 0 and re.fullmatch(r"""["'`]\s*\\?\s*[+.]?\s*[bBuUrR]{0,2}["'`]""", text[last_end:a])
        if not joined:
            lines.append(text.count("\n", 0, a) + 1)
        last_end = b
    return sorted(set(lines))


CONFIG = r"\.(ya?ml|json|env|ini|toml|cfg|conf|properties|sh|bash)$"


def find_lines(df: DataFrame, key: str = "id", text: str = "content", path: str = "path", out: str = "chunk_id") -> DataFrame:
    """One row per key and line on which a usable literal credential begins.

    ``path`` (any column with the file's name; NULL counts as code) tells configuration, where values
    need no quotes. Only the key, text and path columns are read, so the scan is pruned to them.
    """
    slim = df.where(F.col(text).isNotNull() & (F.length(text) > 0)).select(
        F.col(key).alias("k"), F.col(text).alias("t"), F.coalesce(F.lower(F.col(path)).rlike(CONFIG), F.lit(False)).alias("c")
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ks, ns = [], []
            for k, t, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if s := spans_of(t, c):
                    for n in _lines(t, s):
                        ks.append(k)
                        ns.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.string()), pa.array(ns, pa.int64())], names=[out, "line_no"])

    return slim.mapInArrow(scan, f"{out} string, line_no bigint").distinct()


def mask_columns(df: DataFrame, text: str = "content", signature: str = "signature", path: str = "path") -> DataFrame:
    """All rows and columns, with ``text`` and ``signature`` masked and ``n_secrets`` added.

    The signature is masked by its own scan and, where it copies a line of the text, takes that
    line's masked form, so that a secret cut off at the signature's end is masked as well.
    """
    name = "n_secrets"
    while name in df.columns:
        name = "_" + name
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.IntegerType())])
    names = df.columns
    ti, si, pi = names.index(text), names.index(signature) if signature in names else -1, names.index(path) if path in names else -1
    config = re.compile(CONFIG)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(i) for i in range(b.num_columns)]
            texts = cols[ti].to_pylist()
            paths = cols[pi].to_pylist() if pi >= 0 else [None] * len(texts)
            sigs = cols[si].to_pylist() if si >= 0 else [None] * len(texts)
            counts = []
            for i, t in enumerate(texts):
                c = bool(paths[i] and config.search(paths[i].lower()))
                spans = spans_of(t, c) if t else []
                counts.append(len(spans))
                if spans:
                    texts[i] = masked(t, c)
                if sigs[i]:
                    sigs[i] = _masked_signature(sigs[i], t, spans, c)
            cols[ti] = pa.array(texts, pa.string())
            if si >= 0:
                cols[si] = pa.array(sigs, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int32())], names=[*names, name])

    return df.mapInArrow(scan, schema)


def _masked_signature(sig: str, text: str | None, spans: list[tuple[int, int]], config: bool) -> str:
    at = text.find(sig) if text and spans else -1
    if at < 0:
        return masked(sig, config) or ""
    out, pos, end = [], at, at + len(sig)
    for a, b in spans:
        if b <= at or a >= end:
            continue
        out += [text[pos : max(a, at)], MASK]
        pos = min(b, end)
    return "".join([*out, text[pos:end]])
