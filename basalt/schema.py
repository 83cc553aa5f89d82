"""Schemas of the engine's tables. Times are BIGINT epoch milliseconds, UTC."""

from __future__ import annotations

from pyspark.sql import types as T


TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "array<float>": T.ArrayType(T.FloatType())}


def _s(ddl: str) -> T.StructType:
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


CHUNKS = _s(
    "id string, group_id string, path string, symbol string, kind string, lang string, signature string, start_line int, end_line int, start_byte int, end_byte int, "
    "content_hash string, emb array<float>, emb_model string, emb_dim int, loc int, created_at bigint, updated_at bigint, indexed_at bigint, last_accessed_at bigint, valid boolean, content string"
)
FACTS = _s(
    "id string, group_id string, content string, type string, emb array<float>, emb_model string, emb_dim int, anchor string, source string, valid_from bigint, invalid_at bigint, "
    "immune boolean, created_at bigint, last_accessed_at bigint, access_count bigint"
)
FILES = _s("id string, group_id string, path string, ext string, created_at bigint, updated_at bigint")
PROJECTS = _s("group_id string, schema_version int, created_at bigint, last_full_scan_at bigint, repo_path string")
EMBEDDING_MODELS = _s("id string, name string, purpose string, dim int, metric string, active boolean, created_at bigint")
SOURCE_FILES = _s("path string, ext string, length bigint, content binary")
EDGES = _s("group_id string, src_id string, dst_id string")
IMPORT_SPECS = _s("path string, raw string, is_relative boolean")
TURNS = _s("conv_id bigint, turn int, role string, text string")

SCHEMA_VERSION = 2
DAY_MS = 86_400_000
#: longest vector that is stored, largest file that is parsed, deepest traversal
MAX_DIM, MAX_FILE, MAX_DEPTH = 2048, 524_288, 10
#: rows of a traversal, of a neighbour listing
MAX_REACHED, MAX_NEIGHBOURS = 200, 500
NEAR_DUPLICATE = 0.92
RRF_K = 60
