"""The reference operators' queries over the test tables, and the SQL they are held against.

Repeated rows of one id count once. Every query runs over its whole tables; a limit stands only where
it is the operator (top-k, reporting limits).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basalt import schema
from basalt.functions import ids, paths, text, vectors
from basalt.operators import extract, facts, fetch, graph, imports, search, transcript, upsert
from basalt.session import fresh_path, table
from basalt.sources import files as sources
from basalt.streaming import reindex

#: the moment all time-dependent queries ask about
NOW = 1_750_000_000_000
WORDS_CODE = ("get", "field", "load", "function", "return", "list")
WORDS_FACTS = ("service", "cache", "table", "limit", "export", "empty")
RAW_PATHS = ("/a/b/../c", "./x//y/.", "/../up", "a/../../b", "", "/", "src/./lib/../main.py")
STATUS = (" M src/app.py", "?? new file.txt", "R  old.py -> lib/new.py", "A  added.go")
DEPTHS = (-3, 0, 1, 5, 10, 11)


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").drop("last_accessed_at").dropDuplicates(["id"])


def all_facts(spark: SparkSession, d: str) -> DataFrame:
    """Each fact once; of its counters the greatest."""
    raw = table(spark, d, "facts")
    first = [c for c in raw.columns if c not in ("id", "access_count", "last_accessed_at")]
    return raw.groupBy("id").agg(*(F.first(c).alias(c) for c in first), F.max("access_count").alias("access_count"), F.max("last_accessed_at").alias("last_accessed_at"))


def query_vector(df: DataFrame, model: str) -> list[float]:
    """The vector of the least id of the model that is neither NULL nor zero."""
    ok = df.where((F.col("emb_model") == model) & F.col("emb").isNotNull()).select("id", vectors.pad(F.col("emb"), 64).alias("v"))
    row = ok.where(vectors.norm(F.col("v")) > 0).orderBy("id").limit(1).collect()
    return list(row[0]["v"]) if row else [1.0] + [0.0] * 63


def code_vectors(spark: SparkSession, d: str) -> tuple[DataFrame, list[float]]:
    c = chunks(spark, d).where("emb_model = 'codevec@1.0'")
    return c, query_vector(c, "codevec@1.0")


def fact_vectors(spark: SparkSession, d: str) -> tuple[DataFrame, list[float]]:
    f = all_facts(spark, d).where("emb_model = 'factvec@1.0'")
    return f, query_vector(f, "factvec@1.0")


# ------------------------------------------------------------------ functions


def hash_ids(spark, d):
    c = chunks(spark, d)
    return c.select(
        "id", ids.chunk_id(F.col("path"), F.col("symbol")).alias("chunk_id"), ids.file_id(F.col("path")).alias("file_id"),
        ids.content_hash(F.col("content")).alias("content_hash"), ids.group_id(F.lit(None).cast("string"), F.col("path")).alias("group_hash"),
    )


def path_parts(spark, d):
    p = F.col("path")
    return table(spark, d, "files").select("path").distinct().select("path", paths.folder(p).alias("folder"), paths.stem(p).alias("stem"), paths.extension(p).alias("ext"))


def path_normalize(spark, d):
    return spark.createDataFrame([(x,) for x in RAW_PATHS], "raw string").select("raw", paths.normalize(F.col("raw")).alias("norm"))


def clamp(spark, d):
    return spark.createDataFrame([(x,) for x in DEPTHS], "d int").select("d", vectors.clamp(F.col("d"), 1, schema.MAX_DEPTH).alias("clamped"))


def strip_noise(spark, d):
    return chunks(spark, d).where("content is not null").select("id", text.strip_noise(F.col("content")).alias("cleaned"))


def signature(spark, d):
    return chunks(spark, d).where("content is not null").select("id", text.signature(F.col("content")).alias("head"))


def vec_pad(spark, d):
    v = vectors.pad(F.col("embedding"), 128)
    return table(spark, d, "embeddings").select("vec_id", F.size(v).alias("n"), F.round(vectors.norm(v), 6).alias("norm"))


def json_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def transcript_messages(spark, d):
    """Every document as a line of a transcript, in the envelopes that occur, read back as role and text."""
    docs = table(spark, d, "documents").where("text is not null")
    flat = F.to_json(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    block = F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(F.array(F.struct(F.lit("text").alias("type"), "text"), F.struct(F.lit("image").alias("type"), F.lit("x").alias("text"))).alias("content")).alias("message")))
    line = F.when(F.col("doc_id") % 3 == 0, flat).when(F.col("doc_id") % 3 == 1, block).otherwise(F.lit("{broken"))
    return sources.messages(docs.select("doc_id", F.lit(0).alias("turn"), line.alias("line")), conv="doc_id").select(F.col("conv_id").alias("doc_id"), "role", "text")


HOOKS = (
    '{"tool_name": "Edit", "cwd": "/r", "tool_input": {"file_path": "/r/a.py"}}', '{"tool_name": "MultiEdit", "cwd": "/r", "tool_input": {"file_path": "/r/b.py", "edits": [{"file_path": "/r/c.py"}, {"file_path": "/r/b.py"}]}}',
    '{"tool_name": "Read", "cwd": "/r", "tool_input": {"file_path": "/r/d.py"}}', '{"tool_name": "Write", "cwd": "/q", "tool_input": {"path": "/q/e.go"}}', "{nope", '{"tool_name": "Write", "cwd": "/q"}',
)


def hook_paths(spark, d):
    return sources.hook_payload(spark.createDataFrame([(x,) for x in HOOKS], "value string"))


LOG = ("{bad", '{"tool": "Edit", "path": "/r/a.py", "ts": 1}', '{"path": "/r/b.py", "ts": 2}', "nope", '{"tool": "Write", "ts": 4}')


def log_entries(spark, d):
    """A session log of 33 lines: its last 30, without those that are no JSON."""
    lines = [LOG[i % len(LOG)] for i in range(33)]
    numbered = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
    return sources.log_entries(numbered.where(F.col("n") >= len(lines) - 30))


def fact_ids(spark, d):
    f = all_facts(spark, d).where("content is not null")
    return f.select("id", ids.fact_id(F.col("group_id"), F.col("content"), F.col("created_at")).alias("made"))


def fetch_slice(spark, d):
    return chunks(spark, d).where("content is not null").select("id", text.line_slice(F.col("content"), F.lit(0), F.lit(3)).alias("head"), text.line_slice(F.col("content"), F.lit(2), F.lit(9999)).alias("rest"))


def porcelain_parse(spark, d):
    return spark.createDataFrame([(x,) for x in STATUS], "line string").select("line", text.porcelain_path(F.col("line")).alias("path"))


# ------------------------------------------------------------------ filters


def scan_filter(spark, d):
    s = table(spark, d, "source_files").select("path", "length").distinct()
    return s.where(sources.readable(F.col("path"), F.col("length"), "/srv/repos")).select("path", paths.extension(F.col("path")).alias("ext"), "length")


IGNORED = ("# generated", "/services/", "*.ts", "!kettle*.ts", "tests/**/*.py", "core/*/lantern/", "!core/ember/lantern/")


def ignored(spark, d):
    """Files that an ignore file leaves, with patterns taken back by later ones."""
    s = table(spark, d, "source_files").select("path").distinct()
    inner = F.regexp_replace("path", "^/srv/repos/[^/]+/", "")
    return s.where(~inner.rlike(sources.gitignore(list(IGNORED))))


def code_fetch(spark, d):
    """Every chunk by its id, read from its file, and the requests that fail."""
    c = chunks(spark, d)
    good = c.select(F.col("id").alias("request"), "group_id", "id", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("symbol"))
    named = c.select(F.concat(F.lit("named "), "id").alias("request"), "group_id", F.lit(None).cast("string").alias("id"), "path", "symbol")
    bad = spark.createDataFrame(
        [("no group", None, "x", None, None), ("no id", "g", None, "/r/a.py", None), ("unknown id", "g", "x", None, None), ("unknown symbol", "g", None, "/r/a.py", "a.f")],
        "request string, group_id string, id string, path string, symbol string",
    )
    return fetch.fetch(good.unionByName(named).unionByName(bad), c, table(spark, d, "source_files"))


def point_lookup(spark, d):
    c = chunks(spark, d)
    wanted = c.agg(F.min(F.struct("path", "symbol")).alias("x")).select(ids.chunk_id(F.col("x.path"), F.col("x.symbol")).alias("id"))
    return c.join(F.broadcast(wanted), "id").select("id", "path", "symbol", "start_line", "end_line")


def filter_valid(spark, d):
    return chunks(spark, d).where("valid").select("id", "group_id")


def temporal_valid(spark, d):
    return all_facts(spark, d).where(search.temporal(NOW)).select("id", "group_id")


def symbol_match(spark, d):
    c = chunks(spark, d).where("valid")
    wanted = c.agg(F.min(F.substring_index("symbol", ".", -1)).alias("wanted"))
    return c.crossJoin(F.broadcast(wanted)).where(search.symbol_match(F.col("symbol"), F.col("wanted"))).select("id", "symbol")


def event_filter(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("click", "error", "purchase")).select("event_id", "event_type")


# ------------------------------------------------------------------ graph


def call_edges(spark, d):
    return graph.call_edges(chunks(spark, d))


def anchor_join(spark, d):
    return graph.anchor_edges(all_facts(spark, d), chunks(spark, d))


def _starts(edges: DataFrame) -> DataFrame:
    """The chunk that calls the most others; of equals the least id."""
    return edges.groupBy(F.col("src_id").alias("id")).count().orderBy(F.desc("count"), "id").limit(1).select("id")


def _reading_order(c: DataFrame) -> DataFrame:
    """Edges from each chunk to the next of its file: a fixed graph over the tables' own chunks, for the
    traversals, as these tables hold few calls that resolve."""
    w = W.partitionBy("group_id", "path").orderBy("start_byte", "id")
    return c.select("group_id", F.col("id").alias("src_id"), F.lead("id").over(w).alias("dst_id")).where("dst_id is not null")


def _first_of_largest(c: DataFrame) -> tuple[str, str]:
    """The symbol and group of the first chunk of the file that holds the most valid ones."""
    most = c.where("valid").groupBy("group_id", "path").agg(F.count("*").alias("n"), F.min_by("symbol", F.struct("start_byte", "id")).alias("symbol"))
    row = most.orderBy(F.desc("n"), "path").limit(1).collect()
    return (row[0]["symbol"], row[0]["group_id"]) if row else ("", "")


def impact_of(spark, d):
    c = chunks(spark, d)
    symbol, group = _first_of_largest(c)
    return graph.impact_of(c, graph.call_edges(c).unionByName(_reading_order(c)).distinct(), symbol, group, 3)


def callers_of(spark, d):
    c = chunks(spark, d)
    most = c.where("valid").groupBy("group_id", "path").agg(F.count("*").alias("n"), F.max_by("symbol", F.struct("start_byte", "id")).alias("symbol"))
    row = most.orderBy(F.desc("n"), "path").limit(1).collect()
    e = graph.call_edges(c).unionByName(_reading_order(c)).distinct()
    return graph.callers_of(c, e, row[0]["symbol"] if row else "", row[0]["group_id"] if row else "", 2)


#: small chunks of every language whose calls are read: path, symbol, text
SAMPLES = (
    ("/r/a.py", "a.run", "def run(x):\n    # skip(1)\n    y = load('call(2)')\n    y.save(x)\n    return load(parse(x)) if x else run(x)"),
    ("/r/b.py", "b.load", "def load(x=make()):\n    return [make() for _ in x]"),
    ("/r/b.py", "b.make", "async def make():\n    @wrap(3)\n    def inner(q):\n        return parse(q)\n    return inner"),
    ("/r/b.py", "b.parse", 'def parse(x):\n    """parse(x) calls load(x)"""\n    return super().parse(x)'),
    ("/r/c.js", "c.send", "async send(a, b) {\n  if (a) { await post(`x${b}`); } // load(a)\n  return new Box(wrap(a)).open();\n}"),
    ("/r/c.js", "c.post", "function post(a) {\n  return a.map((x) => wrap(x));\n}"),
    ("/r/c.js", "c.wrap", "const wrap = async (a) => {\n  return require('x')(a);\n}"),
    ("/r/d.go", "d.Serve", "func (s *Server) Serve(w Writer) error {\n\tdefer close(w)\n\treturn check(s.next(w), 'x')\n}"),
    ("/r/d.go", "d.check", "func check(a int, c rune) error { return nil }"),
    ("/r/E.java", "E.E.read", "public String read(int n) {\n    return this.trim(buffer.take(n)) + new Box(n);\n}"),
    ("/r/E.java", "E.E.trim", "private static String trim(String s) { return s; }"),
    ("/r/f.c", "f.sum", "static int sum(int a)\n{\n    return add(a, sizeof(int)) + p->go(a);\n}"),
    ("/r/f.c", "f.add", "int add(int a, int b) { /* sum(a) */ return a + b; }"),
    ("/r/g.rs", "g.push", "fn push(v: &'static str) -> u8 { Vec::new(); put(v); v.len() }"),
    ("/r/g.rs", "g.put", "fn put(v: &str) { panic(v) }"),
    ("/r/h.rb", "h.tidy", "def tidy(x)\n  x.sweep(1) # put(2)\nend"),
    ("/r/h.rb", "h.sweep", "def sweep(n)\nend"),
    ("/r/i.sh", "i.main", "main() { put(1); }"),
)


def _samples(spark) -> DataFrame:
    rows = [("g", p, s, t, True) for p, s, t in SAMPLES] + [("g", "/r/z.py", "z.parse", "def parse(): pass", False), ("h", "/q/a.py", "a.load", "def load(): pass", True)]
    df = spark.createDataFrame(rows, "group_id string, path string, symbol string, content string, valid boolean")
    return df.withColumn("id", ids.chunk_id(F.col("path"), F.col("symbol")))


def sample_sites(spark, d):
    return graph.call_sites(_samples(spark)).join(_samples(spark).select(F.col("id").alias("src_id"), "symbol"), "src_id").select("symbol", "callee", "n")


def sample_edges(spark, d):
    c = _samples(spark)
    e = graph.call_edges(c)
    return e.join(c.select(F.col("id").alias("src_id"), F.col("symbol").alias("caller")), "src_id").join(c.select(F.col("id").alias("dst_id"), F.col("symbol").alias("callee")), "dst_id").select("group_id", "caller", "callee")


def _word_graph(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The modules' name words as a graph: the first word of ``a_b.f`` leads to the second; a word is
    valid if it opens the module of a valid chunk."""
    part = F.split(F.substring_index("symbol", ".", 1), "_", -1)
    w = c.select(F.lit("").alias("group_id"), F.get(part, F.lit(0)).alias("src_id"), F.get(part, F.lit(1)).alias("dst_id"), "valid").where("dst_id is not null and dst_id <> ''")
    return w.select("group_id", "src_id", "dst_id").distinct(), w.select(F.col("src_id").alias("id"), "valid").distinct()


def reach_words(spark, d):
    e, nodes = _word_graph(chunks(spark, d))
    return graph.reach(e, _starts(e), nodes, 3)


def reach_words_back(spark, d):
    e, nodes = _word_graph(chunks(spark, d))
    return graph.reach(e, _starts(e), nodes, 2, backwards=True)


def purge_edges(spark, d):
    """The graph without what starts in the first path."""
    c = chunks(spark, d)
    gone = c.join(F.broadcast(c.agg(F.min("path").alias("path"))), "path").select("id")
    return graph.purge(_reading_order(c), gone)


def graph_stats(spark, d):
    sites = graph.call_sites(chunks(spark, d).where("valid"))
    return sites.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("candidates"), F.countDistinct("src_id").alias("callers"), F.countDistinct("group_id", "callee").alias("names"))


def graph_build(spark, d):
    """The counters of a whole build."""
    return graph.build(table(spark, d, "source_files"), table(spark, d, "files").dropDuplicates(["id"]), chunks(spark, d), NOW)["counters"]


def path_universe(spark, d):
    return table(spark, d, "files").select("path").union(table(spark, d, "source_files").select("path")).distinct()


def import_specs(spark, d):
    return imports.extract(table(spark, d, "source_files"))


def _imports(spark, d):
    return graph.import_edges(imports.extract(table(spark, d, "source_files")), table(spark, d, "files"))


ROOT = "/srv/repos/r/"
#: small files that import each other, with imports in comments and strings
FILES = {
    "a.py": 'import b\nfrom pkg import x\n# import c\nS = """\nimport d\n"""\n',
    "b.py": "",
    "c.py": "",
    "d.py": "",
    "pkg/__init__.py": "",
    "pkg/x.py": "import b\n",
    "web/m.js": "import { q } from './n';\n// import z from '../a'\n/*\nimport y from './k';\n*/\nconst t = `\nimport w from './k';\n`;\nimport React from 'react';\n",
    "web/k.js": "",
    "web/n/index.ts": "",
    "c/x.c": '#include "y.h"\n#include <stdio.h>\n/* \n#include "no.h"\n*/\n',
    "c/y.h": "",
    "c/no.h": "",
    "s/run.sh": "source lib.sh\n# source other.sh\n",
    "s/lib.sh": "",
    "s/other.sh": "",
    "r/a.rb": "require_relative 'util'\n# require_relative 'no'\n",
    "r/util.rb": "",
    "r/no.rb": "",
}


def _sample_files(spark) -> tuple[DataFrame, DataFrame]:
    s = spark.createDataFrame([(ROOT + p, t.encode()) for p, t in FILES.items()], "path string, content binary")
    f = s.select(ids.file_id(F.col("path")).alias("id"), F.lit("g").alias("group_id"), "path", paths.extension(F.col("path")).alias("ext"))
    return graph.import_edges(imports.extract(s), f), f


def sample_imports(spark, d):
    e, f = _sample_files(spark)
    name = F.substring("path", len(ROOT) + 1, 999)
    return e.join(f.select(F.col("id").alias("src_id"), name.alias("source")), "src_id").join(f.select(F.col("id").alias("dst_id"), name.alias("target")), "dst_id").select("source", "raw", "target")


def sample_imports_of(spark, d):
    e, f = _sample_files(spark)
    return graph.neighbours(e, f, ROOT + "a.py")


def sample_imported_by(spark, d):
    e, f = _sample_files(spark)
    return graph.neighbours(e, f, ROOT + "b.py", backwards=True)


def graph_status(spark, d):
    return graph.status(table(spark, d, "files"), graph.call_edges(chunks(spark, d)), _imports(spark, d))


def chunk_extract(spark, d):
    return extract.extract(table(spark, d, "source_files")).drop("content")


def extract_heads(spark, d):
    """Of the chunks extracted those in Go and Bash, by path and bare name."""
    got = extract.extract(table(spark, d, "source_files")).where(paths.extension(F.col("path")).isin("go", "sh") & ~F.col("symbol").endswith(extract.ANONYMOUS))
    return got.select("path", F.substring_index("symbol", ".", -1).alias("name")).distinct()


# ------------------------------------------------------------------ search


def knn_code(spark, d):
    c, q = code_vectors(spark, d)
    return search.knn(c, q, 20, F.col("valid"))


def knn_group(spark, d):
    """Only the first group's chunks: groups are searched apart."""
    c, q = code_vectors(spark, d)
    group = c.agg(F.min("group_id")).collect()[0][0]
    return search.knn(c, q, 20, F.col("valid"), group=group)


def knn_facts(spark, d):
    f, q = fact_vectors(spark, d)
    return search.knn(f, q, 20, search.temporal(NOW))


def anchored_knn(spark, d):
    """Around the first valid anchored fact that has a vector, among its anchor's facts."""
    f = all_facts(spark, d).where("emb_model = 'factvec@1.0'")
    v = vectors.pad(F.col("emb"), 64)
    row = f.where(search.temporal(NOW) & F.col("anchor").isNotNull() & (vectors.norm(v) > 0)).orderBy("id").select("anchor", v.alias("v")).limit(1).collect()
    return search.anchored(f, list(row[0]["v"]) if row else [1.0] + [0.0] * 63, row[0]["anchor"] if row else None, NOW)


def lexical_search(spark, d):
    return search.lexical(all_facts(spark, d), WORDS_FACTS, 20, search.temporal(NOW))


def hybrid_rrf(spark, d):
    """The nearest of one model, and the words of all chunks."""
    c = chunks(spark, d)
    return search.hybrid_code(c, query_vector(c, "codevec@1.0"), WORDS_CODE, model="codevec@1.0")


def hybrid_facts(spark, d):
    f = all_facts(spark, d)
    return search.hybrid_facts(f, query_vector(f, "factvec@1.0"), WORDS_FACTS, NOW, model="factvec@1.0")


def hybrid_bump(spark, d):
    """A search and what it leaves behind: the returned chunks are read now."""
    return facts.access_bump(table(spark, d, "chunks").groupBy("id").agg(F.max("last_accessed_at").alias("last_accessed_at")), hybrid_rrf(spark, d), NOW)


def near_dup(spark, d):
    """Every fact against all that were there before it in its group and model."""
    f = all_facts(spark, d)
    return search.near_duplicates(f, f, NOW)


def facts_taken(spark, d):
    """Adding the facts of the second half of the time range to those of the first: what each becomes."""
    f = all_facts(spark, d)
    middle = f.agg(F.expr("(min(created_at) + max(created_at)) div 2").alias("cut"))
    both = f.crossJoin(F.broadcast(middle)).withColumn("late", F.col("created_at") > F.col("cut")).drop("cut")
    status, rows, edges = facts.add(both.where("not late").drop("late"), both.where("late").drop("late"), chunks(spark, d), NOW)
    return status.join(rows.select("id", F.lit(True).alias("written")), "id", "left").join(edges.groupBy(F.col("fact_id").alias("id")).agg(F.count("*").alias("links")), "id", "left").select(
        "id", "status", "existing_id", F.coalesce("written", F.lit(False)).alias("written"), F.coalesce("links", F.lit(0)).alias("links")
    )


# ------------------------------------------------------------------ writes as joins


def _incoming(spark, d):
    return chunks(spark, d).withColumn("content_hash", ids.content_hash(text.strip_noise(F.col("content"))))


def _existing(spark, d):
    c = chunks(spark, d)
    middle = c.agg(F.expr("(min(created_at) + max(created_at)) div 2").alias("cut"))
    return c.crossJoin(F.broadcast(middle)).where("created_at <= cut").drop("cut")


def upsert_chunks(spark, d):
    columns = ("id", "group_id", "path", "symbol", "kind", "content_hash", "emb_model", "emb_dim", "content", "valid", "created_at", "updated_at", "indexed_at", "action")
    return upsert.chunks(_existing(spark, d), _incoming(spark, d), NOW).select(*columns)


def ingest_stats(spark, d):
    return upsert.ingest_stats(upsert.chunks(_existing(spark, d), _incoming(spark, d), NOW), table(spark, d, "source_files").dropDuplicates(["path"]))


def upsert_files(spark, d):
    s = table(spark, d, "source_files").select("path", "ext").distinct().withColumn("id", ids.file_id(F.col("path")))
    return upsert.files(table(spark, d, "files"), s, NOW)


def invalidate_file(spark, d):
    return upsert.invalidate_paths(chunks(spark, d), table(spark, d, "source_files"), NOW)


def invalidate_symbols(spark, d):
    return upsert.invalidate_symbols(chunks(spark, d), _existing(spark, d), NOW)


def project_stamp(spark, d):
    scans = table(spark, d, "chunks").select("group_id", F.col("indexed_at").alias("at"), F.regexp_extract("path", "^(/srv/repos/[^/]+)", 1).alias("repo_path"))
    return upsert.stamp_projects(table(spark, d, "projects"), scans.groupBy("group_id").agg(F.max("at").alias("at"), F.min("repo_path").alias("repo_path")))


def project_merge(spark, d):
    """Groups of all tables and one more; the table's first half is there already."""
    p = table(spark, d, "projects")
    seen = table(spark, d, "chunks").select("group_id").union(table(spark, d, "facts").select("group_id")).union(spark.createDataFrame([("new",)], "group_id string"))
    return upsert.projects(p.where("group_id < '8'"), seen, NOW)


def facts_add(spark, d):
    return facts.with_defaults(all_facts(spark, d), NOW).drop("emb", "emb_dim")


def access_bump(spark, d):
    f = all_facts(spark, d)
    return facts.access_bump(f, f.where(search.temporal(NOW)), NOW)


def set_immune(spark, d):
    f = all_facts(spark, d)
    return facts.set_immune(f, f.where("lower(type) = 'preference'"), True)


def extend_expiry(spark, d):
    f = all_facts(spark, d)
    return facts.extend(f, f.where("invalid_at is not null"), 30)


def chunk_last_wins(spark, d):
    """Of the rows that bear one path and bare name, the last in the file."""
    c = chunks(spark, d).select("path", F.substring_index("symbol", ".", -1).alias("name"), "start_byte", "id")
    return upsert.latest(c, ["path", "name"], "start_byte")


# ------------------------------------------------------------------ transcripts and streams


def turn_tail(spark, d):
    return transcript.turn_tail(transcript.turns(table(spark, d, "documents").where("kind = 'transcript'")), n=3)


def log_tail(spark, d):
    return transcript.log_tail(table(spark, d, "documents").where("kind = 'log'"))


def delta_tail(spark, d):
    return transcript.delta(log_tail(spark, d), transcript.turn_tail(transcript.turns(table(spark, d, "documents").where("kind = 'transcript'"))), chars=2000)


def stream_latest(spark, d):
    """The latest event of each user, kept by a stream."""
    shape = table(spark, d, "events").select("event_id", "user_id", "event_type").schema
    out = fresh_path(spark, "latest")
    q = reindex.latest_by(reindex.source(spark, f"{d}/events.parque[t]", shape), "user_id", "event_id", out)
    q.awaitTermination()
    return spark.read.schema(shape).parquet(out)


def stream_reindex(spark, d):
    """The files as two edit events each in one stream, the longer text first and the real one last; then the
    table that the re-index keeps."""
    s = table(spark, d, "source_files").where("content is not null").dropDuplicates(["path"]).join(table(spark, d, "files").select("path", "group_id").dropDuplicates(["path"]), "path")
    old = s.select("group_id", "path", F.concat(F.col("content"), F.lit("\n\n").cast("binary"), F.col("content")).alias("content"), F.lit(1).cast("bigint").alias("at"))
    events = fresh_path(spark, "events")
    old.unionByName(s.select("group_id", "path", "content", F.lit(2).cast("bigint").alias("at"))).write.parquet(events)
    out, edges = fresh_path(spark, "chunks"), fresh_path(spark, "calls")
    reindex.reindex(reindex.source(spark, events, spark.read.parquet(events).schema), out, NOW, edges).awaitTermination()
    return spark.read.parquet(out).select("id", "group_id", "path", "symbol", "valid", "created_at", "content_hash")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        hash_ids, path_parts, path_normalize, clamp, strip_noise, signature, vec_pad, json_extract, transcript_messages, hook_paths, log_entries, fact_ids, fetch_slice, porcelain_parse, scan_filter, ignored, code_fetch, point_lookup, filter_valid,
        temporal_valid, symbol_match, event_filter, call_edges, anchor_join, impact_of, callers_of, sample_sites, sample_edges, reach_words, reach_words_back, purge_edges, graph_stats, graph_build, path_universe, import_specs, graph_status,
        sample_imports, sample_imports_of, sample_imported_by, chunk_extract, extract_heads, knn_code, knn_group, knn_facts, anchored_knn, lexical_search, hybrid_rrf, hybrid_facts, hybrid_bump, near_dup, facts_taken, upsert_chunks, ingest_stats, upsert_files,
        invalidate_file, invalidate_symbols, project_stamp, project_merge, facts_add, access_bump, set_immune, extend_expiry, chunk_last_wins, turn_tail, log_tail, delta_tail, stream_latest, stream_reindex,
    )
    return {f.__name__: f for f in named}
