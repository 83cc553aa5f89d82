"""The same queries in SQL, for an independent engine on the same Parquet tables."""

from __future__ import annotations

from basalt import schema
from basalt.plans import queries as q

NOW = q.NOW
CHUNKS = "c AS (SELECT DISTINCT ON (id) * EXCLUDE (last_accessed_at) FROM chunks)"
FACTS = (
    "f AS (SELECT id, any_value(group_id) group_id, any_value(content) AS content, any_value(type) AS type, any_value(emb) emb, any_value(emb_model) emb_model, any_value(anchor) anchor, any_value(source) source, "
    "any_value(valid_from) valid_from, any_value(invalid_at) invalid_at, any_value(immune) immune, any_value(created_at) created_at, max(access_count) access_count, max(last_accessed_at) last_accessed_at FROM facts GROUP BY id)"
)
TEMPORAL = f"(valid_from <= {NOW} AND (invalid_at IS NULL OR invalid_at > {NOW}))"
# Fixed values, typed here and not taken from the code that is checked.
SKIPPED = ("node_modules", ".git", "__pycache__", ".venv", "venv", "dist", "build", ".next", ".nuxt", "target", "vendor", ".mypy_cache")
NEVER = (".lock", ".sum", ".mod", ".min.js", ".min.css", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".woff", ".woff2", ".ttf", ".eot", ".pdf", ".zip", ".tar", ".gz", ".pyc", ".pyo", ".so", ".dylib", ".dll")
READ = "py js jsx mjs cjs ts mts tsx go rs java c h cpp cc cxx hpp hxx cs rb php kt kts swift scala sc sh bash lua".split()
NOISE = r"^[\s#/*\-=~`]{5,}\s*$"
# the text of a file; bytes that are no UTF-8 are written as the engine shows them, which changes no line with an import
TEXT = "coalesce(try(decode(content)), replace(replace(replace(replace(content::VARCHAR, '\\x0A', chr(10)), '\\x0D', chr(13)), '\\x22', '\"'), '\\x27', ''''))"
EXT = r"regexp_extract(path, '\.([^./]+)$', 1)"


def _found(pattern: str, exts: str, relative: str) -> str:
    return f"SELECT path, unnest(regexp_extract_all(x, '{pattern}', 1)) AS raw, {relative} AS rel FROM t WHERE ext IN ({exts})"


IMPORTS = (
    f"t AS (SELECT path, {EXT} AS ext, {TEXT} AS x FROM (SELECT DISTINCT path, content FROM source_files)), raw AS ("
    + " UNION ALL ".join(
        (
            _found(r"(?m)^import[ \t]+([\w.]+)", "'py'", "false"),
            _found(r"(?m)^from[ \t]+([.\w]+)[ \t]+import", "'py'", "false"),
            _found(r"""(?m)^[ \t]*(?:import|export)\b[^;''"\n]*?(?:from[ \t]*)?["'']([^"''\n]+)["'']""", "'js', 'ts'", "false"),
            _found(r"""\brequire\([ \t]*["'']([^"''\n]+)["'']""", "'js', 'ts'", "false"),
            _found(r"""(?m)^[ \t]*#[ \t]*include[ \t]*"([^"\n]+)\"""", "'c', 'h'", "true"),
            _found(r"""(?m)^[ \t]*import[ \t]+(?:[\w.]+[ \t]+)?"([^"\n]+)\"""", "'go'", "false"),
            _found(r"""(?m)^[ \t]+(?:[\w.]+[ \t]+)?"([^"\n]+)"[ \t\r]*$""", "'go'", "false"),
            _found(r"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+)", "'java'", "false"),
            _found(r"""(?m)^[ \t]*(?:source|\.)[ \t]+["'']?([^ \t\r\n"'';&|]+)""", "'sh'", "true"),
        )
    )
    + "), spec AS (SELECT DISTINCT path, raw, rel OR starts_with(raw, './') OR starts_with(raw, '../') OR (path LIKE '%.py' AND starts_with(raw, '.')) AS is_relative FROM raw)"
)
# names called: comments and strings first, then heads, decorators and the text's own head; arrows and colons become
# points, and every bracket gets a blank, as this engine's patterns do not look behind
_STRING, _QUOTED = r'"(?:[^"\\\n]|\\.)*"', r"''(?:[^''\\\n]|\\.)*''"
_BODY = (
    "CASE WHEN ext = 'py' THEN regexp_replace(content, '\"\"\"[\\s\\S]*?\"\"\"|''''''[\\s\\S]*?''''''|" + _STRING + "|" + _QUOTED + "|#[^\\n]*', ' ', 'g') "
    "WHEN ext IN ('js', 'ts') THEN regexp_replace(content, '//[^\\n]*|/\\*[\\s\\S]*?\\*/|" + _STRING + "|" + _QUOTED + "|`(?:[^`\\\\]|\\\\[\\s\\S])*`', ' ', 'g') "
    "ELSE regexp_replace(content, '//[^\\n]*|/\\*[\\s\\S]*?\\*/|`[^`]*`|" + _STRING + "|''(?:[^''\\\\\\n]|\\\\[^\\n]{1,9}?)''', ' ', 'g') END"
)
_WORDS = (
    "if elif elseif for foreach while until unless switch match case when catch except return yield await async throw raise assert sizeof typeof alignof not and or in is as lambda function func fn fun "
    "def class new delete del void do else try finally with using lock fixed synchronized this import defer go select range where let var const loop unsafe guard static"
).split()
SITES = (
    f"v AS (SELECT id, group_id, {EXT} AS ext, content FROM c WHERE valid AND content IS NOT NULL), b AS (SELECT id, group_id, ext, {_BODY} AS x FROM v WHERE ext IN ('py', 'js', 'ts', 'go', 'java', 'c', 'h')), "
    "d AS (SELECT id, group_id, ext, regexp_replace(regexp_replace(regexp_replace(x, '@[A-Za-z_][\\w.]*[ \\t]*\\(?', ' ', 'g'), "
    "'\\b(?:def|function|func|fn|fun|class|new|interface|struct|enum|trait|impl)\\b[ \\t]*(?:\\([^)\\n]*\\)[ \\t]*)?\\*?[ \\t]*[A-Za-z_$][\\w$.]*', ' ', 'g'), '^[^(={;]*\\(', ' ') AS x FROM b), "
    "p AS (SELECT id, group_id, ext, replace(replace(replace(x, '->', '.'), '::', '.'), '(', '( ') AS x FROM d), "
    "n AS (SELECT id AS src_id, group_id, ext, unnest(regexp_extract_all(x, CASE WHEN ext = 'java' THEN '(?:^|[^\\w$@])([A-Za-z_]\\w*)[ \\t]*\\(' ELSE '(?:^|[^\\w$.@])([A-Za-z_]\\w*)[ \\t]*\\(' END, 1)) AS callee FROM p), "
    f"s AS (SELECT group_id, src_id, callee FROM n WHERE callee NOT IN ({', '.join(repr(w) for w in _WORDS)}) AND NOT (callee = 'super' AND ext <> 'py'))"
)
CALLS = (
    f"{SITES}, o AS (SELECT group_id, split_part(symbol, '.', -1) AS callee, min(id) AS dst_id FROM c WHERE valid GROUP BY 1, 2 HAVING count(DISTINCT id) = 1), "
    "e AS (SELECT DISTINCT group_id, src_id, dst_id FROM s JOIN o USING (group_id, callee) WHERE src_id <> dst_id)"
)
ORDER = "nx AS (SELECT group_id, id AS src_id, lead(id) OVER (PARTITION BY group_id, path ORDER BY start_byte, id) AS dst_id FROM c), ro AS (SELECT * FROM nx WHERE dst_id IS NOT NULL)"


def _around(last: bool, depth: int) -> str:
    """What a symbol of the largest file reaches by calls and by the order of the files' chunks, or what reaches it."""
    src, dst = ("dst_id", "src_id") if last else ("src_id", "dst_id")
    return (
        f"WITH RECURSIVE {CHUNKS}, {CALLS}, {ORDER}, g AS (SELECT * FROM e UNION SELECT * FROM ro), "
        f"m AS (SELECT group_id, path, count(*) AS n, {'arg_max' if last else 'arg_min'}(symbol, (start_byte, id)) AS sym FROM c WHERE valid GROUP BY 1, 2 ORDER BY n DESC, path LIMIT 1), "
        "s0 AS (SELECT c.id FROM c, m WHERE c.valid AND c.group_id = m.group_id AND (c.symbol = sym OR ends_with(c.symbol, '.' || sym))), "
        f"w AS (SELECT id, 0 AS depth FROM s0 UNION SELECT g.{dst}, w.depth + 1 FROM w JOIN g ON g.{src} = w.id WHERE w.depth < {depth}), "
        "r AS (SELECT id, min(depth)::INT AS depth FROM w WHERE depth > 0 GROUP BY id) "
        f"SELECT c.id, c.symbol, c.path, c.kind, c.signature, c.start_line, c.end_line, r.depth FROM r JOIN c ON c.id = r.id, m WHERE c.valid AND c.group_id = m.group_id ORDER BY r.depth, c.id LIMIT {schema.MAX_REACHED}"
    )


#: the calls of the sample chunks, read by hand
SAMPLE_SITES = (
    ("a.run", "load", 2), ("a.run", "parse", 1), ("a.run", "run", 1), ("b.load", "make", 2), ("b.make", "parse", 1), ("b.parse", "super", 1), ("c.send", "post", 1), ("c.send", "wrap", 1), ("c.post", "wrap", 1),
    ("c.wrap", "require", 1), ("d.Serve", "close", 1), ("d.Serve", "check", 1), ("E.E.read", "trim", 1), ("E.E.read", "take", 1), ("f.sum", "add", 1), ("g.push", "put", 1), ("g.put", "panic", 1), ("h.tidy", "sweep", 1),
)
SAMPLE_EDGES = (
    ("a.run", "b.load"), ("a.run", "b.parse"), ("b.load", "b.make"), ("b.make", "b.parse"), ("c.send", "c.post"), ("c.send", "c.wrap"), ("c.post", "c.wrap"), ("d.Serve", "d.check"),
    ("E.E.read", "E.E.trim"), ("f.sum", "f.add"), ("g.push", "g.put"), ("h.tidy", "h.sweep"),
)
SAMPLE_IMPORTS = (("a.py", "b", "b.py"), ("a.py", "pkg", "pkg/__init__.py"), ("pkg/x.py", "b", "b.py"), ("web/m.js", "./n", "web/n/index.ts"), ("c/x.c", "y.h", "c/y.h"), ("s/run.sh", "lib.sh", "s/lib.sh"), ("r/a.rb", "util", "r/util.rb"))
HOOKS = (("Edit", "/r", "/r/a.py"), ("MultiEdit", "/r", "/r/b.py"), ("MultiEdit", "/r", "/r/c.py"), ("Write", "/q", "/q/e.go"))
WORD_GRAPH = (
    "wg AS (SELECT split_part(split_part(symbol, '.', 1), '_', 1) AS src_id, split_part(split_part(symbol, '.', 1), '_', 2) AS dst_id, valid FROM c WHERE split_part(split_part(symbol, '.', 1), '_', 2) <> ''), "
    "e AS (SELECT DISTINCT src_id, dst_id FROM wg), s0 AS (SELECT src_id AS id FROM e GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
)
BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(12)"


def _list(xs) -> str:
    return ", ".join("'" + str(x).replace("'", "''") + "'" for x in xs)


def _vec(view: str, model: str) -> str:
    unit = "list_resize(emb::DOUBLE[], 64, 0.0::DOUBLE)"
    return (
        f"v AS (SELECT *, {unit} AS x FROM {view} WHERE emb_model = '{model}' AND emb IS NOT NULL), "
        "z AS (SELECT * FROM v WHERE list_dot_product(x, x) > 0), q AS (SELECT x AS y FROM z ORDER BY id LIMIT 1), "
        "n AS (SELECT z.*, list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))) AS sim FROM z, q)"
    )


def _near(keep: str, k: int) -> str:
    return f"k AS (SELECT * FROM n ORDER BY sim DESC, id LIMIT {k}), near AS (SELECT id, round(sim, 6) AS sim FROM k WHERE {keep})"


def _said(view: str, fields: str, words, keep: str, k: int, name: str = "said") -> str:
    toks = f"list_distinct(list_filter(string_split_regex(lower({fields}), '[^a-z0-9]+'), lambda w: w <> ''))"
    return f"{name} AS (SELECT * FROM (SELECT id, len(list_intersect({toks}, [{_list(words)}]))::INT AS score, {keep} AS ok FROM {view}) WHERE score > 0 AND ok ORDER BY score DESC, id LIMIT {k})"


def _fused(k: int, inner: bool = False) -> str:
    """The two lists fused; ``inner`` as a query of its own."""
    return ("WITH " if inner else "") + (
        "r AS (SELECT id, row_number() OVER (ORDER BY sim DESC, id) - 1 AS rank, 0 AS list FROM near UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1, 1 FROM said), "
        f"g AS (SELECT id, sum(1.0::DOUBLE / ({schema.RRF_K} + rank)) AS s, min(list * 1000 + rank) AS first FROM r GROUP BY id) "
        f"SELECT id, round(s, 6) AS score FROM g ORDER BY round(s, 12) DESC, first LIMIT {k}"
    )


INCOMING = f"i AS (SELECT * EXCLUDE (content_hash), sha256(array_to_string(list_filter(string_split(content, chr(10)), lambda l: NOT regexp_matches(l, '{NOISE}')), chr(10))) AS new_hash FROM c)"
EXISTING = "x AS (SELECT * FROM c WHERE created_at <= (SELECT (min(created_at) + max(created_at)) // 2 FROM c))"
UPSERT = (
    "u0 AS (SELECT coalesce(x.id, i.id) AS id, x.id IS NOT NULL AS had, i.id IS NOT NULL AS got, CASE WHEN i.id IS NULL THEN 'kept' WHEN x.id IS NULL THEN 'inserted' WHEN x.content_hash = new_hash THEN 'unchanged' ELSE 'updated' END AS action, x, i "
    "FROM x FULL JOIN i ON x.id = i.id), "
    "u AS (SELECT id, CASE WHEN action IN ('inserted', 'updated') THEN i.group_id ELSE x.group_id END AS group_id, CASE WHEN action IN ('inserted', 'updated') THEN i.path ELSE x.path END AS path, "
    "CASE WHEN action IN ('inserted', 'updated') THEN i.symbol ELSE x.symbol END AS symbol, CASE WHEN action IN ('inserted', 'updated') THEN i.kind ELSE x.kind END AS kind, "
    "CASE WHEN action IN ('inserted', 'updated') THEN i.new_hash ELSE x.content_hash END AS content_hash, CASE WHEN action IN ('inserted', 'updated') THEN i.emb_model ELSE x.emb_model END AS emb_model, "
    "CASE WHEN action IN ('inserted', 'updated') THEN i.emb_dim ELSE x.emb_dim END AS emb_dim, CASE WHEN action IN ('inserted', 'updated') THEN i.content ELSE x.content END AS content, "
    f"CASE WHEN got THEN true ELSE x.valid END AS valid, coalesce(x.created_at, {NOW})::BIGINT AS created_at, CASE WHEN action IN ('inserted', 'updated') THEN {NOW} ELSE x.updated_at END::BIGINT AS updated_at, "
    f"CASE WHEN action IN ('inserted', 'updated') THEN {NOW} ELSE x.indexed_at END::BIGINT AS indexed_at, action FROM u0)"
)


def _duplicates(probe: str, base: str) -> str:
    """Each fact against the nearest before it of its group and model, validity asked afterwards."""
    return (
        "va AS (SELECT *, list_resize(emb::DOUBLE[], 128, 0.0::DOUBLE) AS x FROM f WHERE emb_model IS NOT NULL AND emb IS NOT NULL), za AS (SELECT * FROM va WHERE list_dot_product(x, x) > 0), "
        f"pa AS (SELECT * FROM va WHERE {probe}), "
        "ja AS (SELECT p.id, z.id AS other, z.valid_from, z.invalid_at, round(list_dot_product(p.x, z.x) / (sqrt(list_dot_product(p.x, p.x)) * sqrt(list_dot_product(z.x, z.x))), 6) AS sim FROM pa p JOIN za z "
        f"ON p.group_id = z.group_id AND p.emb_model = z.emb_model AND (z.created_at, z.id) < (p.created_at, p.id) AND {base} WHERE list_dot_product(p.x, p.x) > 0), "
        "ba AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS n FROM ja), "
        f"ha AS (SELECT * FROM ba WHERE n = 1 AND sim >= {schema.NEAR_DUPLICATE} AND {TEMPORAL}), "
        "dup AS (SELECT pa.id, CASE WHEN other IS NULL THEN 'new' ELSE 'duplicate' END AS status, other AS existing_id, sim FROM pa LEFT JOIN ha ON pa.id = ha.id)"
    )


def _turns(n: int, chars: int) -> str:
    mark = r"^\s*(?:### )?(user|human|assistant|agent|User|Human|Assistant|Agent)(?:\n|:|>)\s*"
    return (
        "p AS (SELECT doc_id AS conv_id, unnest(string_split(text, chr(10) || chr(10))) AS raw, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) - 1 AS turn FROM documents WHERE kind = 'transcript' AND text IS NOT NULL), "
        f"w AS (SELECT *, lower(regexp_extract(raw, '{mark}', 1)) AS said FROM p), "
        f"t AS (SELECT conv_id, turn, CASE said WHEN 'agent' THEN 'assistant' WHEN '' THEN NULL ELSE said END AS role, trim(CASE WHEN said <> '' THEN regexp_replace(raw, '{mark}', '') ELSE raw END, {BLANKS}) AS body FROM w), "
        "l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM t WHERE role IS NOT NULL AND body <> ''), "
        f"tail AS (SELECT conv_id, string_agg('[' || role || ']: ' || substr(body, 1, {chars}), chr(10) || chr(10) ORDER BY turn) AS text FROM l WHERE n <= {n} GROUP BY conv_id)"
    )


LOG = (
    "log AS (SELECT doc_id AS log_id, array_to_string(list_filter(string_split(text, chr(10))[greatest(1, len(string_split(text, chr(10))) - 29):], "
    "lambda l: regexp_matches(l, '^\\d\\d:\\d\\d:\\d\\d ')), chr(10)) AS text FROM documents WHERE kind = 'log' AND text IS NOT NULL)"
)


def oracle_sql() -> dict[str, str]:
    ext = "regexp_extract(regexp_extract(path, '([^/]*)$', 1), '.\\.([^.]+)$', 1)"
    return {
        "hash_ids": f"WITH {CHUNKS} SELECT id, substr(sha256(path || '::' || symbol), 1, 32) AS chunk_id, substr(sha256(path), 1, 32) AS file_id, sha256(content) AS content_hash, substr(sha256(path), 1, 16) AS group_hash FROM c",
        "path_parts": f"SELECT DISTINCT path, regexp_replace(path, '/?[^/]*$', '') AS folder, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS stem, {ext} AS ext FROM files",
        "path_normalize": "SELECT * FROM (VALUES ('/a/b/../c', '/a/c'), ('./x//y/.', 'x/y'), ('/../up', '/up'), ('a/../../b', '../b'), ('', ''), ('/', '/'), ('src/./lib/../main.py', 'src/main.py')) t(raw, norm)",
        "clamp": f"SELECT d::INT AS d, greatest(1, least(d, {schema.MAX_DEPTH}))::INT AS clamped FROM (VALUES {', '.join(f'({x})' for x in q.DEPTHS)}) t(d)",
        "strip_noise": f"WITH {CHUNKS} SELECT id, array_to_string(list_filter(string_split(content, chr(10)), lambda l: NOT regexp_matches(l, '{NOISE}')), chr(10)) AS cleaned FROM c WHERE content IS NOT NULL",
        "signature": f"WITH {CHUNKS} SELECT id, coalesce(substr(list_filter(list_transform(string_split(content, chr(10)), lambda l: trim(l, {BLANKS})), lambda l: l <> '')[1], 1, 200), '') AS head FROM c WHERE content IS NOT NULL",
        "vec_pad": "SELECT vec_id, len(list_resize(embedding, 128, 0.0::FLOAT))::INT AS n, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings",
        "transcript_messages": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' END AS role, CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12)) = '' THEN '' ELSE text END END AS text FROM documents WHERE text IS NOT NULL",
        "hook_paths": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in HOOKS) + ") t(tool_name, cwd, path)",
        "log_entries": "SELECT n::INT AS n, CASE n % 5 WHEN 1 THEN 'Edit' WHEN 2 THEN '?' ELSE 'Write' END AS tool, CASE n % 5 WHEN 1 THEN '/r/a.py' WHEN 2 THEN '/r/b.py' ELSE '?' END AS path, (n % 5)::BIGINT AS ts FROM range(3, 33) r(n) WHERE n % 5 IN (1, 2, 4)",
        "fact_ids": f"WITH {FACTS} SELECT id, substr(sha256(concat_ws(chr(1), group_id, content, created_at::VARCHAR)), 1, 32) AS made FROM f WHERE content IS NOT NULL",
        "ignored": "WITH p AS (SELECT DISTINCT path, regexp_replace(path, '^/srv/repos/[^/]+/', '') AS r FROM source_files) SELECT path FROM p WHERE NOT (r LIKE 'services/%' OR (r LIKE '%.ts' AND NOT regexp_matches(r, '(^|/)kettle[^/]*\\.ts$')) "
        "OR regexp_matches(r, '^tests/(.*/)?[^/]*\\.py$') OR (regexp_matches(r, '^core/[^/]+/lantern/') AND NOT starts_with(r, 'core/ember/lantern/')))",
        "code_fetch": f"WITH {CHUNKS}, t AS (SELECT path, string_split(decode(content), chr(10)) AS l FROM (SELECT DISTINCT path, content FROM source_files WHERE path IN (SELECT path FROM c))), "
        "x AS (SELECT c.id, c.path, c.symbol, greatest(1, start_line)::INT AS start_line, least(len(l), end_line)::INT AS end_line, array_to_string(l[greatest(1, start_line):least(len(l), end_line)], chr(10)) AS source FROM c JOIN t USING (path)) "
        "SELECT id AS request, path, symbol, start_line, end_line, source, NULL::VARCHAR AS error FROM x UNION ALL SELECT 'named ' || id, path, symbol, start_line, end_line, source, NULL FROM x "
        "UNION ALL SELECT * FROM (VALUES ('no group', NULL, NULL, NULL, NULL, NULL, 'incomplete request'), ('no id', NULL, NULL, NULL, NULL, NULL, 'incomplete request'), ('unknown id', NULL, NULL, NULL, NULL, NULL, 'chunk not found'), "
        "('unknown symbol', NULL, NULL, NULL, NULL, NULL, 'symbol not found'))",
        "json_extract": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
        "fetch_slice": f"WITH {CHUNKS}, t AS (SELECT id, string_split(content, chr(10)) AS l FROM c WHERE content IS NOT NULL) SELECT id, array_to_string(l[1:3], chr(10)) AS head, coalesce(array_to_string(l[2:], chr(10)), '') AS rest FROM t",
        "porcelain_parse": "SELECT line, CASE WHEN contains(substr(line, 4), ' -> ') THEN split_part(substr(line, 4), ' -> ', 2) ELSE substr(line, 4) END AS path FROM (VALUES " + ", ".join(f"('{x}')" for x in q.STATUS) + ") t(line)",
        "scan_filter": f"SELECT DISTINCT path, {ext} AS ext, length FROM source_files WHERE NOT list_has_any(string_split(regexp_replace(path, '^/srv/repos', ''), '/'), [{_list(SKIPPED)}]) AND {ext} IN ({_list(READ)}) "
        f"AND length <= {schema.MAX_FILE} AND NOT (" + " OR ".join(f"ends_with(path, '{s}')" for s in NEVER) + ")",
        "point_lookup": f"WITH {CHUNKS} SELECT id, path, symbol, start_line, end_line FROM c WHERE id = (SELECT substr(sha256(path || '::' || symbol), 1, 32) FROM c WHERE path IS NOT NULL ORDER BY path, symbol LIMIT 1)",
        "filter_valid": f"WITH {CHUNKS} SELECT id, group_id FROM c WHERE valid",
        "temporal_valid": f"WITH {FACTS} SELECT id, group_id FROM f WHERE {TEMPORAL}",
        "symbol_match": f"WITH {CHUNKS}, w AS (SELECT min(split_part(symbol, '.', -1)) AS wanted FROM c WHERE valid) SELECT id, symbol FROM c, w WHERE valid AND (symbol = wanted OR ends_with(symbol, '.' || wanted))",
        "event_filter": "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error', 'purchase')",
        "call_edges": f"WITH {CHUNKS}, {CALLS} SELECT * FROM e",
        "anchor_join": f"WITH {CHUNKS}, {FACTS} SELECT DISTINCT f.group_id, f.id AS fact_id, c.id AS chunk_id FROM f JOIN c ON f.group_id = c.group_id AND f.anchor = c.symbol WHERE c.valid AND f.anchor <> ''",
        "impact_of": _around(False, 3),
        "callers_of": _around(True, 2),
        "sample_sites": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {n}::BIGINT)" for a, b, n in SAMPLE_SITES) + ") t(symbol, callee, n)",
        "sample_edges": "SELECT * FROM (VALUES " + ", ".join(f"('g', '{a}', '{b}')" for a, b in SAMPLE_EDGES) + ") t(group_id, caller, callee)",
        "reach_words": f"WITH RECURSIVE {CHUNKS}, {WORD_GRAPH}, w AS (SELECT id, 0 AS depth FROM s0 UNION SELECT e.dst_id, w.depth + 1 FROM w JOIN e ON e.src_id = w.id WHERE w.depth < 3) "
        f"SELECT id, min(depth)::INT AS depth FROM w WHERE depth > 0 AND id IN (SELECT src_id FROM wg WHERE valid) GROUP BY id ORDER BY 2, 1 LIMIT {schema.MAX_REACHED}",
        "reach_words_back": f"WITH RECURSIVE {CHUNKS}, {WORD_GRAPH}, w AS (SELECT id, 0 AS depth FROM s0 UNION SELECT e.src_id, w.depth + 1 FROM w JOIN e ON e.dst_id = w.id WHERE w.depth < 2) "
        f"SELECT id, min(depth)::INT AS depth FROM w WHERE depth > 0 AND id IN (SELECT src_id FROM wg WHERE valid) GROUP BY id ORDER BY 2, 1 LIMIT {schema.MAX_REACHED}",
        "purge_edges": f"WITH {CHUNKS}, {ORDER} SELECT * FROM ro WHERE src_id NOT IN (SELECT id FROM c WHERE path = (SELECT min(path) FROM c))",
        "graph_stats": f"WITH {CHUNKS}, {SITES} SELECT count(*)::BIGINT AS candidates, count(DISTINCT src_id)::BIGINT AS callers, count(DISTINCT (group_id, callee))::BIGINT AS names FROM s",
        "graph_build": f"WITH {CHUNKS}, {SITES} SELECT (SELECT count(DISTINCT path) FROM source_files WHERE content IS NOT NULL)::BIGINT AS files, 0::BIGINT AS imports, (SELECT count(*) FROM s)::BIGINT AS calls_candidates, "
        "(SELECT count(DISTINCT path) FROM source_files WHERE content IS NULL)::BIGINT AS errors",
        "graph_status": f"WITH {CHUNKS}, {CALLS} SELECT 'files' AS what, count(DISTINCT id)::BIGINT AS n FROM files UNION ALL SELECT 'calls', count(*) FROM e UNION ALL SELECT 'imports', 0",
        "import_specs": f"WITH {IMPORTS} SELECT * FROM spec",
        "extract_heads": f"WITH t AS (SELECT path, {EXT} AS ext, {TEXT} AS x FROM (SELECT DISTINCT path, content FROM source_files)) SELECT DISTINCT path, unnest(regexp_extract_all(x, CASE ext WHEN 'go' THEN '(?m)^func[ \\t]+(?:\\([^)]*\\)[ \\t]*)?(\\w+)[ \\t]*(?:\\[[^\\]]*\\])?\\(' "
        "ELSE '(?m)^[ \\t]*([A-Za-z_][\\w-]*)[ \\t]*\\(\\)[ \\t\\r\\n]*\\{' END, 1)) AS name FROM t WHERE ext IN ('go', 'sh')",
        "sample_imports": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in SAMPLE_IMPORTS) + ") t(source, raw, target)",
        "sample_imports_of": "SELECT * FROM (VALUES ('/srv/repos/r/b.py', 'py'), ('/srv/repos/r/pkg/__init__.py', 'py')) t(path, ext)",
        "sample_imported_by": "SELECT * FROM (VALUES ('/srv/repos/r/a.py', 'py'), ('/srv/repos/r/pkg/x.py', 'py')) t(path, ext)",
        "path_universe": "SELECT path FROM files UNION SELECT path FROM source_files",
        "knn_code": f"WITH {CHUNKS}, {_vec('c', 'codevec@1.0')}, {_near('valid', 20)} SELECT * FROM near",
        "knn_facts": f"WITH {FACTS}, {_vec('f', 'factvec@1.0')}, {_near(TEMPORAL, 20)} SELECT * FROM near",
        "knn_group": f"WITH {CHUNKS}, {_vec('c', 'codevec@1.0')}, k AS (SELECT * FROM n WHERE group_id = (SELECT min(group_id) FROM c WHERE emb_model = 'codevec@1.0') ORDER BY sim DESC, id LIMIT 20) SELECT id, round(sim, 6) AS sim FROM k WHERE valid",
        "anchored_knn": f"WITH {FACTS}, v AS (SELECT *, list_resize(emb::DOUBLE[], 64, 0.0::DOUBLE) AS x FROM f WHERE emb_model = 'factvec@1.0' AND emb IS NOT NULL), z AS (SELECT * FROM v WHERE list_dot_product(x, x) > 0), "
        f"q AS (SELECT x AS y, anchor AS sym FROM z WHERE {TEMPORAL} AND anchor IS NOT NULL ORDER BY id LIMIT 1), "
        "n AS (SELECT z.*, sym, list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))) AS sim FROM z, q), k AS (SELECT * FROM n ORDER BY sim DESC, id LIMIT 20) "
        f"SELECT id, round(sim, 6) AS sim FROM k WHERE {TEMPORAL} AND anchor = sym ORDER BY sim DESC, id LIMIT 10",
        "lexical_search": f"WITH {FACTS}, {_said('f', 'content', q.WORDS_FACTS, TEMPORAL, 20)} SELECT id, score FROM said",
        "hybrid_rrf": f"WITH {CHUNKS}, {_vec('c', 'codevec@1.0')}, {_near('valid', 20)}, {_said('c', chr(39) + chr(39) + ' || concat_ws(' + chr(39) + ' ' + chr(39) + ', symbol, signature)', q.WORDS_CODE, 'valid', 20)}, {_fused(10)}",
        "hybrid_facts": f"WITH {FACTS}, {_vec('f', 'factvec@1.0')}, {_near(TEMPORAL, 20)}, {_said('f', 'content', q.WORDS_FACTS, TEMPORAL, 20)}, {_fused(10)}",
        "hybrid_bump": f"WITH {CHUNKS}, {_vec('c', 'codevec@1.0')}, {_near('valid', 20)}, {_said('c', chr(39) + chr(39) + ' || concat_ws(' + chr(39) + ' ' + chr(39) + ', symbol, signature)', q.WORDS_CODE, 'valid', 20)}, h AS ({_fused(10, True)}) "
        f"SELECT id, CASE WHEN id IN (SELECT id FROM h) THEN {NOW} ELSE max(last_accessed_at) END::BIGINT AS last_accessed_at FROM chunks GROUP BY id",
        "near_dup": f"WITH {FACTS}, {_duplicates('true', 'true')} SELECT * FROM dup",
        "facts_taken": f"WITH {CHUNKS}, {FACTS}, mid AS (SELECT (min(created_at) + max(created_at)) // 2 AS cut FROM f), late AS (SELECT f.* FROM f, mid WHERE created_at > cut), {_duplicates('created_at > (SELECT cut FROM mid)', 'true')}, "
        "st AS (SELECT late.id, coalesce(status, 'new') AS status, existing_id, late.group_id, late.anchor FROM late LEFT JOIN dup ON late.id = dup.id), "
        "ln AS (SELECT st.id, count(DISTINCT c.id) AS links FROM st JOIN c ON c.group_id = st.group_id AND c.symbol = st.anchor AND c.valid WHERE status = 'new' AND st.anchor <> '' GROUP BY 1) "
        "SELECT st.id, status, existing_id, status = 'new' AS written, coalesce(links, 0)::BIGINT AS links FROM st LEFT JOIN ln ON st.id = ln.id",
        "upsert_chunks": f"WITH {CHUNKS}, {INCOMING}, {EXISTING}, {UPSERT} SELECT * FROM u",
        "ingest_stats": f"WITH {CHUNKS}, {INCOMING}, {EXISTING}, {UPSERT} SELECT count(*)::BIGINT AS total, count(*) FILTER (action IN ('inserted', 'updated'))::BIGINT AS embedded, count(*) FILTER (action = 'unchanged')::BIGINT AS skipped, 0::BIGINT AS errors FROM u WHERE action <> 'kept'",
        "upsert_files": f"WITH s AS (SELECT DISTINCT substr(sha256(path), 1, 32) AS id, path, ext FROM source_files), x AS (SELECT id, min(path) AS path, min(ext) AS ext, min(created_at) AS created_at, max(updated_at) AS updated_at FROM files GROUP BY id) "
        f"SELECT coalesce(x.id, s.id) AS id, coalesce(s.path, x.path) AS path, coalesce(s.ext, x.ext) AS ext, coalesce(created_at, {NOW})::BIGINT AS created_at, CASE WHEN s.path IS NOT NULL THEN {NOW} ELSE updated_at END::BIGINT AS updated_at FROM x FULL JOIN s ON x.id = s.id",
        "invalidate_file": f"WITH {CHUNKS}, j AS (SELECT *, path NOT IN (SELECT path FROM source_files) AS gone FROM c) SELECT id, valid AND NOT gone AS valid, CASE WHEN gone AND valid THEN {NOW} ELSE updated_at END::BIGINT AS updated_at FROM j",
        "invalidate_symbols": f"WITH {CHUNKS}, {EXISTING}, j AS (SELECT *, path IN (SELECT path FROM x) AND id NOT IN (SELECT id FROM x) AS gone FROM c) SELECT id, valid AND NOT gone AS valid, CASE WHEN gone AND valid THEN {NOW} ELSE updated_at END::BIGINT AS updated_at FROM j",
        "project_stamp": "SELECT group_id, created_at, greatest(last_full_scan_at, scanned) AS last_full_scan_at, coalesce(place, repo_path) AS repo_path FROM projects LEFT JOIN (SELECT group_id, max(indexed_at) AS scanned, min(regexp_extract(path, '^(/srv/repos/[^/]+)', 1)) AS place FROM chunks GROUP BY 1) USING (group_id)",
        "project_merge": f"WITH s AS (SELECT group_id FROM chunks UNION SELECT group_id FROM facts UNION SELECT 'new'), p AS (SELECT * FROM projects WHERE group_id < '8') SELECT coalesce(p.group_id, s.group_id) AS group_id, CASE WHEN s.group_id IS NOT NULL THEN 2 ELSE schema_version END::INT AS schema_version, "
        f"coalesce(created_at, {NOW})::BIGINT AS created_at, last_full_scan_at, repo_path FROM p FULL JOIN s ON p.group_id = s.group_id",
        "facts_add": f"WITH {FACTS} SELECT id, group_id, content, coalesce(lower(type), 'fact') AS type, emb_model, nullif(anchor, '') AS anchor, coalesce(source, 'session') AS source, coalesce(nullif(valid_from, 0), {NOW})::BIGINT AS valid_from, invalid_at, coalesce(immune, false) AS immune, "
        f"coalesce(created_at, {NOW})::BIGINT AS created_at, coalesce(last_accessed_at, {NOW})::BIGINT AS last_accessed_at, coalesce(access_count, 0)::BIGINT AS access_count FROM f",
        "access_bump": f"WITH {FACTS} SELECT id, CASE WHEN {TEMPORAL} THEN {NOW} ELSE last_accessed_at END::BIGINT AS last_accessed_at, CASE WHEN {TEMPORAL} THEN coalesce(access_count, 0) + 1 ELSE access_count END::BIGINT AS access_count FROM f",
        "set_immune": f"WITH {FACTS} SELECT id, CASE WHEN lower(type) = 'preference' THEN true ELSE immune END AS immune FROM f",
        "extend_expiry": f"WITH {FACTS} SELECT id, CASE WHEN invalid_at IS NULL THEN created_at ELSE created_at + {30 * schema.DAY_MS} END::BIGINT AS created_at, (invalid_at + {30 * schema.DAY_MS})::BIGINT AS invalid_at FROM f",
        "chunk_last_wins": f"WITH {CHUNKS} SELECT path, split_part(symbol, '.', -1) AS name, max(start_byte)::INT AS start_byte, arg_max(id, start_byte) AS id FROM c GROUP BY 1, 2",
        "turn_tail": f"WITH {_turns(3, 1500)} SELECT conv_id, text FROM tail",
        "log_tail": f"WITH {LOG} SELECT log_id, text FROM log",
        "delta_tail": f"WITH {_turns(8, 1500)}, {LOG}, j AS (SELECT coalesce(conv_id, log_id) AS conv_id, nullif(log.text, '') AS l, nullif(tail.text, '') AS t FROM tail FULL JOIN log ON conv_id = log_id), "
        "m AS (SELECT conv_id, concat_ws(chr(10) || chr(10) || '---' || chr(10) || chr(10), l, t) AS text FROM j) SELECT conv_id, right(text, 2000) AS text FROM m WHERE text <> ''",
        "stream_latest": "SELECT arg_max(event_id, event_id) AS event_id, user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    }
