"""SQL for the registered queries that SQL can express, written from the problem statements and not from the
operators. The others (parsers, paraphrases, layouts) are held against brute force and cases in the tests."""

from __future__ import annotations

# a token is a run of ASCII letters, digits and underscores, or another character that is not white space
WHITE = r"\t\n\v\f\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TOKENS = f"len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+|[^A-Za-z0-9_{WHITE}]'))::BIGINT"
FORMATS = r"(^|[^A-Za-z0-9])((AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|glpat-[A-Za-z0-9_-]{20})([^A-Za-z0-9_]|$)"


def _near(table: str) -> str:
    """Pairs of one model; zeros at the end are cut, so lengths may differ by padding only."""
    return (
        f"(WITH v AS (SELECT DISTINCT id, emb_model, list_resize(emb::DOUBLE[], 128, 0.0::DOUBLE) AS x FROM {table} WHERE id IS NOT NULL AND emb IS NOT NULL AND emb_model IS NOT NULL), "
        "u AS (SELECT id, emb_model, x, sqrt(list_dot_product(x, x)) AS n FROM v WHERE list_dot_product(x, x) > 0) "
        f"SELECT DISTINCT '{table}' AS src, a.id AS id_a, b.id AS id_b FROM u a JOIN u b ON a.emb_model = b.emb_model AND a.id < b.id WHERE list_dot_product(a.x, b.x) >= 0.9 * a.n * b.n)"
    )


def oracle_sql() -> dict[str, str]:
    # the bytes of a file as pairs of hex digits, each with a comma
    bytes_ = "f AS (SELECT DISTINCT path, content FROM source_files), h AS (SELECT path, octet_length(content) AS n, regexp_replace(hex(content), '(..)', '\\1,', 'g') AS x FROM f)"
    plain = "list_filter(string_split(x, ','), lambda b: b <> '')"
    white = "'09', '0A', '0B', '0C', '0D', '20'"
    return {
        "p1_copies": "WITH f AS (SELECT id, any_value(group_id) AS g, any_value(content) AS c, any_value(created_at) AS made FROM facts GROUP BY id), "
        "r AS (SELECT id, row_number() OVER (PARTITION BY g, c ORDER BY made, id) AS n FROM f WHERE trim(c) <> '' AND g IS NOT NULL AND made IS NOT NULL) SELECT id FROM r WHERE n > 1",
        "p2_formats": "WITH c AS (SELECT DISTINCT id, content FROM chunks WHERE content IS NOT NULL), l AS (SELECT id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM c) "
        f"SELECT id AS chunk_id, n::BIGINT AS line_no FROM l WHERE regexp_matches(line, '{FORMATS}')",
        "p3_counts": f"WITH {bytes_} SELECT path, n::BIGINT AS n_bytes, (len(string_split(x, '0A,')))::BIGINT AS n_lines, (list_max(list_transform(string_split(x, '0A,'), lambda l: len(l))) // 3)::BIGINT AS max_line, "
        f"len(list_filter({plain}, lambda b: b IN ({white})))::BIGINT AS white, "
        f"len(list_filter({plain}, lambda b: b BETWEEN '30' AND '39' OR b BETWEEN '41' AND '5A' OR b BETWEEN '61' AND '7A' OR b >= '80'))::BIGINT AS alnum FROM h",
        "p4_found": f"{_near('chunks')} UNION ALL {_near('facts')}",
        "p5_json": "WITH f AS (SELECT DISTINCT path, content FROM source_files WHERE path LIKE '%.json') SELECT path FROM f WHERE octet_length(content) > 0 AND coalesce(NOT json_valid(try(decode(content))), true)",
        "p6_items": f"SELECT doc_id, {TOKENS} AS n_tokens, {TOKENS} > 2048 AS split FROM documents",
        "p6_fill": f"SELECT sum({TOKENS})::BIGINT AS n_tokens, 0::BIGINT AS overfull, true AS filled FROM documents",
        "p7_middle": "WITH m AS (SELECT item_id, substr(text, (length(text) / 2)::INT - 100, 200) AS middle FROM (SELECT item_id, text FROM eval_items WHERE length(text) >= 400)) "
        "SELECT DISTINCT doc_id, item_id FROM documents d JOIN m ON contains(d.text, m.middle)",
        "p8_found": f"SELECT DISTINCT doc_id FROM documents WHERE {TOKENS} > 1024",
        "p8_cover": f"SELECT DISTINCT doc_id, {TOKENS} AS n_tokens, true AS kept FROM documents WHERE {TOKENS} > 1024",
    }
