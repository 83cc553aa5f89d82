import os
import random

import pytest
from pyspark.sql import functions as F

from basalt import schema
from basalt.operators import extract, facts, fetch, graph, imports, search, transcript, upsert
from basalt.sources import files, tables
from basalt.streaming import reindex

CHUNK = "id string, group_id string, path string, symbol string, valid boolean, content string"


def chunks(spark, rows):
    return spark.createDataFrame(rows, CHUNK)


def edges_of(df):
    return {(r.src_id, r.dst_id) for r in df.collect()}


def test_call_edges(spark):
    rows = [
        ("1", "g", "/r/m.js", "m.a", True, "function a() { b(); b(); dup(); a(); barfoo() }"),
        ("2", "g", "/r/m.js", "m.b", True, "function b() { a() }"),
        ("3", "g", "/r/m.js", "m.dup", True, ""),
        ("4", "g", "/r/m.js", "n.dup", True, None),
        ("5", "g", "/r/m.js", "m.foo", True, "function foo() { gone() }"),
        ("6", "g", "/r/m.js", "m.gone", False, "function gone() { a() }"),
        ("7", "h", "/r/m.js", "m.c", True, "function c() { b() }"),
    ]
    assert edges_of(graph.call_edges(chunks(spark, rows))) == {("1", "2"), ("2", "1")}


def test_impact_and_callers(spark):
    rows = [(i, g, f"/r/{i}.py", f"m.{i}", True, t) for i, g, t in (("a", "g", "def a(): b()"), ("b", "g", "def b(): c()"), ("c", "g", "def c(): a()"), ("d", "g", "def d(): b()"), ("a2", "h", "def a2(): b()"))]
    c = chunks(spark, rows).withColumns({"kind": F.lit("function"), "signature": F.col("content"), "start_line": F.lit(1), "end_line": F.lit(1)})
    e = graph.call_edges(c)
    got = lambda df: {(r.symbol, r.path, r.depth) for r in df.collect()}
    assert got(graph.impact_of(c, e, "a", "g", 2)) == {("m.b", "/r/b.py", 1), ("m.c", "/r/c.py", 2)}
    assert got(graph.callers_of(c, e, "m.b", "g")) == {("m.a", "/r/a.py", 1), ("m.d", "/r/d.py", 1)}
    assert graph.impact_of(c, e, "none", "g").count() == 0 and graph.callers_of(c, e, "b", "h").count() == 0


def test_reach(spark):
    e = spark.createDataFrame([("g", a, b) for a, b in ("ab", "ba", "ax", "xc", "cd")], "group_id string, src_id string, dst_id string")
    nodes = spark.createDataFrame([(x, x != "x") for x in "abxcd"], "id string, valid boolean")
    start = spark.createDataFrame([("a",)], "id string")
    got = lambda d, **k: [(r.id, r.depth) for r in graph.reach(e, start, nodes, d, **k).collect()]
    assert got(2) == [("b", 1), ("a", 2), ("c", 2)]
    assert got(0) == [("b", 1)]
    assert got(99) == [("b", 1), ("a", 2), ("c", 2), ("d", 3)]
    assert got(1, backwards=True) == [("b", 1)]
    assert got(3, limit=1) == [("b", 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_reach_against_a_loop(spark, seed):
    r = random.Random(seed)
    pairs = {(r.randrange(20), r.randrange(20)) for _ in range(40)}
    e = spark.createDataFrame([("g", str(a), str(b)) for a, b in pairs], "group_id string, src_id string, dst_id string")
    nodes = spark.createDataFrame([(str(i), True) for i in range(20)], "id string, valid boolean")
    front, want = {0}, {}
    for n in range(1, 4):
        front = {b for a, b in pairs if a in front}
        for x in front:
            want.setdefault(str(x), n)
    got = {x.id: x.depth for x in graph.reach(e, spark.createDataFrame([("0",)], "id string"), nodes, 3).collect()}
    assert got == want


def test_imports(spark):
    root = "/srv/repos/r"
    src = {
        f"{root}/a.py": "import b\nfrom pkg import x\nfrom . import y\nif 1:\n    import no\n",
        f"{root}/b.py": "",
        f"{root}/pkg/__init__.py": "",
        f"{root}/pkg.py": "",
        f"{root}/web/m.js": 'import { q } from "./n";\nconst z = require("../a");\nimport React from "react";',
        f"{root}/web/n/index.ts": "",
        f"{root}/c/x.c": '#include "y.h"\n#include <stdio.h>\n',
        f"{root}/c/y.h": "",
    }
    s = spark.createDataFrame([(p, c.encode()) for p, c in src.items()], "path string, content binary")
    from basalt.functions import ids

    f = spark.createDataFrame([("g", p) for p in src], "group_id string, path string").withColumn("id", ids.file_id(F.col("path"))).withColumn("ext", F.lit("x"))
    e = graph.import_edges(imports.extract(s), f)
    name = {r.id: r.path.removeprefix(root + "/") for r in f.collect()}
    assert {(name[a], name[b]) for a, b in edges_of(e)} == {("a.py", "b.py"), ("a.py", "pkg.py"), ("web/m.js", "web/n/index.ts"), ("c/x.c", "c/y.h")}
    assert [r.path for r in graph.neighbours(e, f, f"{root}/a.py").collect()] == [f"{root}/b.py", f"{root}/pkg.py"]
    assert [r.path for r in graph.neighbours(e, f, f"{root}/c/y.h", backwards=True).collect()] == [f"{root}/c/x.c"]


def test_extract(spark):
    py = "class A:\n    def m(self):\n        def inner():\n            pass\n\ndef f():\n    return 1\n\ndef f():\n    return 2\n"
    js = "export class B {\n  run(a) {\n    return '}';\n  }\n}\nfunction top() {\n}\n"
    rows = [("/r/x.py", py.encode()), ("/r/y.js", js.encode()), ("/r/bad.py", b"def ("), ("/r/z.txt", b"x")]
    got = {r.symbol: r for r in extract.extract(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert set(got) == {"x.A.m", "x.f", "y.B.run", "y.top"}
    assert got["x.f"].content.endswith("return 2") and got["x.f"].start_line == 9 and got["x.f"].loc == 2
    assert got["x.A.m"].kind == "method" and got["y.B.run"].signature == "run(a) {"
    assert py.encode()[got["x.A.m"].start_byte : got["x.A.m"].end_byte].decode() == got["x.A.m"].content


@pytest.mark.parametrize(
    ("ext", "source", "want"),
    [
        ("cjs", "const a = (x) => {\n  return x;\n};\nfunction b(y) { return () => y; }\n", ["<anonymous>", "b"]),
        ("ts", "export default class A<T> {\n  private async go(x: number): Promise<void> { if (x) { } }\n}\nlist.map((q: T) => q.id);\n", ["A.go", "<anonymous>"]),
        ("go", "func (s *S) Run(a int) error {\n\tif a > 0 { }\n\treturn nil\n}\nvar f = func(x int) int { return x }\n", ["Run", "<anonymous>"]),
        ("rs", "impl<'a> Tree<'a> {\n    pub fn put(&mut self, v: &'a str) -> u8 { if v == \"}\" { 1 } else { 2 } }\n}\nfn main() {}\ntrait T { fn no(&self); }\n", ["<anonymous>.put", "main"]),
        ("java", "class A {\n  @Override\n  public <T> List<T> all(Map<String, T> m) throws E {\n    if (m.isEmpty()) { }\n  }\n  A(int n) { }\n}\n", ["A.all", "A.A"]),
        ("cpp", "namespace n {\nclass Box : public Base {\n public:\n  Box(int a) : a_(a) {}\n  int size() const { return a_; }\n};\n}\nint n::Box::area(const std::vector<int>& v) {\n  return 1;\n}\n", ["Box.Box", "Box.size", "n::Box::area"]),
        ("cs", "class A {\n    public int Add(int a, int b) => a + b;\n    protected override void Go() { while (true) { } }\n}\n", ["A.Add", "A.Go"]),
        ("rb", "class A\n  def run(x)\n    if x\n      y do |z|\n      end\n    end\n  end\n\n  def self.make\n  end\nend\n", ["run", "make"]),
        ("php", "<?php\nfinal class A {\n  public function go(array $x): ?int { return f(fn($y) => $y); }\n}\nfunction top() { }\n", ["A.go", "top"]),
        ("kt", "class A(val x: Int) {\n    suspend fun go(a: Int): Int {\n        return a\n    }\n    fun one() = 1\n}\n", ["A.go", "A.one"]),
        ("swift", "struct A {\n    func go(_ x: Int) -> Int {\n        return x\n    }\n}\n", ["A.go"]),
        ("scala", "class A {\n  def go(x: Int): Int = {\n    x\n  }\n  def one: Int = 1\n}\n", ["A.go", "A.one"]),
        ("lua", "local function a(x)\n  if x then return 1 end\nend\nfunction M.b()\nend\n", ["a", "M.b"]),
        ("sh", "go() {\n  echo \"}\"\n}\nfunction stop {\n  :\n}\n", ["go", "stop"]),
        ("hs", "main = 1\n", []),
    ],
)
def test_extract_languages(ext, source, want):
    got = extract.functions(source, ext)
    assert [n for n, *_ in got] == want
    assert all(source[a:z] and source[a:z] == source[a:z].strip() for _, _, a, z in got)


def test_rrf_ties_go_to_the_vector_list(spark):
    near = spark.createDataFrame([("v", 0.9)], "id string, sim double")
    said = spark.createDataFrame([("t", 3)], "id string, score int")
    assert [(r.id, r.score) for r in search.rrf([near, said], 5).collect()] == [("v", round(1 / 60, 6)), ("t", round(1 / 60, 6))]


def test_knn_filters_after_the_limit(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], False), ("b", [0.9, 0.1], True), ("c", [0.0, 1.0], True), ("n", None, True)], "id string, emb array<float>, valid boolean")
    assert [r.id for r in search.knn(df, [1.0, 0.0], 2, F.col("valid")).collect()] == ["b"]
    assert [r.id for r in search.knn(df, [1.0, 0.0], 2, F.col("valid"), prefilter=True).collect()] == ["b", "c"]


def test_temporal_edges(spark):
    df = spark.createDataFrame([("in", 10, None), ("end", 1, 10), ("later", 11, None), ("open", 1, 11)], "id string, valid_from bigint, invalid_at bigint")
    assert sorted(r.id for r in df.where(search.temporal(10)).collect()) == ["in", "open"]


def test_near_duplicates(spark):
    ddl = "id string, group_id string, emb array<float>, emb_model string, created_at bigint, valid_from bigint, invalid_at bigint"
    rows = [
        ("a", "g", [1.0, 0.0], "m", 1, 0, None), ("b", "g", [1.0, 0.01, 0.0], "m", 2, 0, None), ("c", "h", [1.0, 0.0], "m", 3, 0, None), ("d", "g", None, "m", 4, 0, None),
        ("e", "g", [0.0, 1.0], "m", 5, 0, 6), ("f", "g", [0.0, 1.0], "m", 6, 0, None), ("z", "g", [0.0, 0.0], "m", 7, 0, None),
    ]
    df = spark.createDataFrame(rows, ddl)
    got = {r.id: (r.status, r.existing_id) for r in search.near_duplicates(df, df, 100).collect()}
    assert got == {"a": ("new", None), "b": ("duplicate", "a"), "c": ("new", None), "e": ("new", None), "f": ("new", None), "z": ("new", None)}


def test_upsert_is_idempotent(spark):
    ddl = "id string, content_hash string, valid boolean, created_at bigint, updated_at bigint, path string"
    old = spark.createDataFrame([("same", "h", False, 1, 1, "p"), ("new", "h", True, 1, 1, "p"), ("kept", "h", False, 1, 1, "q")], ddl).withColumn("emb", F.array(F.lit(1.0)))
    new = spark.createDataFrame([("same", "h", "r"), ("new", "i", "r"), ("more", "j", "r")], "id string, content_hash string, path string")
    got = {r.id: tuple(r)[1:] for r in upsert.chunks(old, new, 9).collect()}
    assert got == {
        "same": ("h", True, 1, 1, "p", [1.0], "unchanged"), "new": ("i", True, 1, 9, "r", None, "updated"),
        "more": ("j", True, 9, 9, "r", None, "inserted"), "kept": ("h", False, 1, 1, "q", [1.0], "kept"),
    }
    again = upsert.chunks(upsert.chunks(old, new, 9), new, 10)
    assert tuple(upsert.ingest_stats(again).collect()[0]) == (3, 0, 3, 0)
    read = spark.createDataFrame([("a", b"x"), ("b", None)], "path string, content binary")
    assert tuple(upsert.ingest_stats(again, read).collect()[0]) == (3, 0, 3, 1)


def test_invalidate(spark):
    c = spark.createDataFrame([("1", "p", True, 1), ("2", "p", True, 1), ("3", "q", True, 1)], "id string, path string, valid boolean, updated_at bigint")
    alive = c.where("id = '1'")
    assert {(r.id, r.valid, r.updated_at) for r in upsert.invalidate_symbols(c, alive, 5).collect()} == {("1", True, 1), ("2", False, 5), ("3", True, 1)}
    assert {(r.id, r.valid) for r in upsert.invalidate_paths(c, alive, 5).collect()} == {("1", True), ("2", True), ("3", False)}


def test_fact_changes(spark):
    f = spark.createDataFrame([("a", 1, None, None, False), ("b", 1, 2, 3, False)], "id string, created_at bigint, invalid_at bigint, access_count bigint, immune boolean").withColumn("last_accessed_at", F.lit(0))
    b = f.where("id = 'b'")
    assert {tuple(r) for r in facts.extend(f, b, 1).collect()} == {("a", 1, None), ("b", 86_400_001, 86_400_002)}
    assert {tuple(r) for r in facts.access_bump(f, f.where("id = 'a'"), 7).collect()} == {("a", 7, 1), ("b", 0, 3)}
    assert {tuple(r) for r in facts.set_immune(f, b, True).collect()} == {("a", False), ("b", True)}


def test_transcript_tail(spark):
    rows = [(1, i, "user" if i % 2 else "tool", f"t{i}") for i in range(24)] + [(1, 30, "user", "  ")]
    t = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    assert transcript.turn_tail(t, n=8).collect()[0]["text"] == "\n\n".join(f"[user]: t{i}" for i in range(9, 24, 2))


def test_log_section(spark):
    log = spark.createDataFrame([("Edit", f"p{i}", i) for i in range(40)], "tool string, path string, ts bigint")
    got = transcript.log_section(log).collect()[0]["text"].split("\n")
    assert got[0] == "Files modified this session:" and got[1:] == [f"  Edit  p{i}" for i in range(10, 40)]
    assert transcript.log_section(log.where("false")).count() == 0


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "repo/src").mkdir(parents=True)
    (tmp_path / "repo/src/a.py").write_text("def f():\n    pass\n")
    (tmp_path / "repo/src/b.txt").write_text("x")
    got = files.repository(spark, str(tmp_path / "repo"))
    assert [r.ext for r in got.collect()] == ["py"]
    lines = '{"role": "user", "content": "hi"}\nbroken\n{"role": "assistant", "content": "yo"}\n'
    (tmp_path / "t.jsonl").write_text(lines)
    assert [(r.turn, r.role, r.text) for r in files.transcript(spark, str(tmp_path / "t.jsonl")).orderBy("turn").collect()] == [(0, "user", "hi"), (1, None, None), (2, "assistant", "yo")]
    (tmp_path / "log.jsonl").write_text('{"tool": "Edit", "path": "p", "ts": 1}\nnope\n{"path": "q", "ts": 2}\n')
    assert {(r.tool, r.path, r.ts) for r in files.session_log(spark, str(tmp_path / "log.jsonl")).collect()} == {("Edit", "p", 1), ("?", "q", 2)}


def test_reindex(spark, tmp_path):
    """The latest event counts, deletes too; every column and the other groups stay; edges follow."""
    ddl = "group_id string, path string, content binary, at bigint"
    out, edges = str(tmp_path / "chunks"), str(tmp_path / "edges")
    other = spark.createDataFrame([("x", "h", "/q/z.py", "z.f", [1.0], True, 1, 1)], "id string, group_id string, path string, symbol string, emb array<float>, valid boolean, created_at bigint, updated_at bigint")
    tables.replace_parts(other.unionByName(spark.createDataFrame([], schema.CHUNKS), allowMissingColumns=True).select(*schema.CHUNKS.names), out)
    steps = [
        [("g", "/r/a.py", b"def f():\n    g()\n\ndef g():\n    pass\n", 1)],
        [("g", "/r/a.py", b"def f():\n    pass\n\n\n\n\ndef g():\n    return 'a longer text'\n", 2), ("g", "/r/a.py", b"def f():\n    return 1\n", 3)],
        [("g", "/r/a.py", None, 5), ("g", "/r/a.py", b"def f():\n    return 2\n", 4)],
    ]
    want = [{"a.f": (True, 1, 1), "a.g": (True, 1, 1)}, {"a.f": (True, 1, 2), "a.g": (False, 1, 2)}, {"a.f": (False, 1, 3), "a.g": (False, 1, 2)}]
    for n, rows in enumerate(steps):
        spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / f"in{n}"))
        s = reindex.source(spark, str(tmp_path / f"in{n}"), spark.createDataFrame([], ddl).schema)
        reindex.reindex(s, out, n + 1, edges).awaitTermination()
        now = spark.read.parquet(out)
        assert {r.symbol: (r.valid, r.created_at, r.updated_at) for r in now.where("group_id = 'g'").collect()} == want[n]
        assert [(r.id, r.emb) for r in now.where("group_id = 'h'").collect()] == [("x", [1.0])]
        assert {*schema.CHUNKS.names} <= {*now.columns}
        assert len([1 for _ in os.scandir(edges) if _.name == "group_id=g"]) == (n == 0)


def test_claim(spark, tmp_path):
    at = str(tmp_path)
    assert tables.claim(spark, at, "g") and not tables.claim(spark, at, "g") and tables.claim(spark, at, "h")
    tables.release(spark, at, "g")
    assert tables.claim(spark, at, "g")


def test_adding_facts(spark):
    ddl = "id string, group_id string, content string, emb array<float>, emb_model string, created_at bigint, anchor string"
    old = facts.with_defaults(spark.createDataFrame([("a", "g", "x", [1.0, 0.0], "m", 1, None)], ddl), 1)
    new = spark.createDataFrame([("b", "g", "y", [1.0, 0.01], "m", 5, "s.f"), ("c", "g", "z", [0.0, 1.0], "m", 5, "s.f"), ("d", "g", "v", None, None, None, None), ("e", "h", "x", [1.0, 0.0], "m", 5, "")], ddl)
    c = spark.createDataFrame([("k", "g", "s.f", True)], "id string, group_id string, symbol string, valid boolean")
    status, rows, edges = facts.add(old, new, c, 9)
    assert {(r.id, r.status, r.existing_id) for r in status.collect()} == {("b", "duplicate", "a"), ("c", "new", None), ("d", "new", None), ("e", "new", None)}
    assert {(r.id, r.type, r.source, r.valid_from, r.invalid_at, r.created_at, r.anchor, r.emb_dim) for r in rows.collect()} == {
        ("c", "fact", "session", 9, None, 5, "s.f", 2), ("d", "fact", "session", 9, None, 9, None, None), ("e", "fact", "session", 9, None, 5, None, 2),
    }
    assert {(r.fact_id, r.chunk_id) for r in edges.collect()} == {("c", "k")}


def test_fetch(spark):
    c = spark.createDataFrame([("k", "g", "/r/a.py", "a.f", 2, 99), ("m", "g", "/r/gone.py", "gone.f", 1, 2)], "id string, group_id string, path string, symbol string, start_line int, end_line int")
    s = spark.createDataFrame([("/r/a.py", b"one\ntwo\nthr\xffee"), ("/r/a.py", b"one\ntwo\nthr\xffee")], "path string, content binary")
    q = spark.createDataFrame([("1", "g", "k", None, None), ("2", "h", "k", None, None), ("3", "g", "m", None, None), ("4", "g", None, "/r/a.py", "a.q"), ("5", "g", None, "/r/a.py", None), ("6", None, "k", None, None)], "request string, group_id string, id string, path string, symbol string")
    got = {r.request: (r.source, r.start_line, r.end_line, r.error) for r in fetch.fetch(q, c, s).collect()}
    assert got["1"] == ("two\nthr\ufffdee", 2, 3, None)
    assert {k: v[3] for k, v in got.items() if k != "1"} == {"2": "chunk not found", "3": "file not found", "4": "symbol not found", "5": "incomplete request", "6": "incomplete request"}


def test_replace_keeps_rows(spark, tmp_path):
    p = str(tmp_path / "t")
    tables.replace(spark.createDataFrame([("g", 1)], "group_id string, x int"), p)
    tables.replace(spark.read.parquet(p).withColumn("x", F.col("x") + 1), p)
    assert [tuple(r) for r in spark.read.parquet(p).select("group_id", "x").collect()] == [("g", 2)]
    assert tables.embedding_models(spark, 5).count() == 2


def test_rebuild_and_purge(spark):
    ddl = "group_id string, src_id string, dst_id string"
    e = spark.createDataFrame([("g", "a", "b"), ("g", "b", "c")], ddl)
    changed = spark.createDataFrame([("a",)], "id string")
    assert edges_of(graph.rebuild(e, changed, spark.createDataFrame([("g", "a", "c")], ddl))) == {("a", "c"), ("b", "c")}
    assert edges_of(graph.rebuild(e, changed, e.where("false"))) == {("b", "c")}


def test_encode(spark):
    from basalt.operators import embed

    df = spark.createDataFrame([("ab",), (None,), ("",)], "t string")
    sizes = lambda: lambda texts: [[len(x), 1.0] for x in texts]
    assert [r.emb for r in embed.encode(df, "t", sizes, batch=1).collect()] == [[2.0, 1.0], None, [0.0, 1.0]]


def test_retention(spark):
    day = 86_400_000
    rows = [("new", 95 * day, None, False), ("read", 1 * day, 90 * day, False), ("old", 1 * day, 2 * day, False), ("kept", 1 * day, None, True)]
    df = spark.createDataFrame(rows, "id string, created_at bigint, last_accessed_at bigint, immune boolean")
    assert {r.id for r in facts.retained(df, 100 * day).collect()} == {"new", "read", "kept"}
