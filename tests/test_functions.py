from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basalt.functions import ids, paths, text, vectors
from basalt.sources import files


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).collect()[0]["y"]


def test_ids(spark):
    import hashlib

    r = spark.createDataFrame([("/a.py", "a.f", " ", "t")], "p string, s string, u string, c string").select(
        ids.chunk_id(F.col("p"), F.col("s")), ids.file_id(F.col("p")), ids.group_id(F.col("u"), F.col("p")), ids.content_hash(F.col("c"))
    ).collect()[0]
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert list(r) == [h("/a.py::a.f")[:32], h("/a.py")[:32], h("/a.py")[:16], h("t")]


def test_signature_and_noise(spark):
    assert one(spark, "\n  \n\tdef f():  \n x", text.signature) == "def f():"
    assert one(spark, "  \n", text.signature) == ""
    assert one(spark, None, text.signature) is None
    assert one(spark, "y" * 300, text.signature) == "y" * 200
    assert one(spark, "a\n# ------\n----\n=====\nb", text.strip_noise) == "a\n----\nb"


def test_line_slice_clamps(spark):
    cut = lambda a, b: one(spark, "1\n2\n3", lambda x: text.line_slice(x, F.lit(a), F.lit(b)))
    assert (cut(0, 2), cut(2, 99), cut(3, 3), cut(5, 9)) == ("1\n2", "2\n3", "3", "")


def test_messages(spark):
    lines = [
        '{"message": {"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image", "text": "no"}, "b"]}}',
        '{"type": "assistant", "content": "plain"}',
        "not json",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    role, said = text.message(F.col("line"))
    assert [tuple(r) for r in df.select(role, said).collect()] == [("user", "a b"), ("assistant", "plain"), (None, None)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", ".", "..", ""]), max_size=7), st.booleans())
def test_normalize_against_a_loop(spark, parts, rooted):
    raw = ("/" if rooted else "") + "/".join(parts)
    out = []
    for p in raw.split("/"):
        if p in ("", "."):
            continue
        if p == ".." and out and out[-1] != "..":
            out.pop()
        elif p == ".." and raw.startswith("/"):
            continue
        else:
            out.append(p)
    assert one(spark, raw, paths.normalize) == ("/" if raw.startswith("/") else "") + "/".join(out)


def test_path_parts(spark):
    for raw, stem, ext in (("/x/a.b.py", "a.b", "py"), ("/x/.env", ".env", ""), ("noext", "noext", ""), ("/d.d/f", "f", "")):
        assert (one(spark, raw, paths.stem), one(spark, raw, paths.extension)) == (stem, ext)


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, None, None, None]
    assert one(spark, [1.0], lambda x: vectors.pad(x, 3), "array<float>") == [1.0, 0.0, 0.0]
    assert one(spark, [1.0, 2.0, 3.0], lambda x: vectors.pad(x, 2), "array<float>") == [1.0, 2.0]
    assert [one(spark, d, lambda x: vectors.clamp(x, 1, 10), "int") for d in (-1, 4, 11)] == [1, 4, 10]


def test_readable_and_ignore(spark):
    rows = [("/r/a.py", 1), ("/r/node_modules/a.py", 1), ("/r/a.min.js", 1), ("/r/b.js", 600_000), ("/r/c.txt", 1), ("/r/gen/x.py", 1), ("/r/keep/gen/y.py", 1)]
    df = spark.createDataFrame(rows, "path string, length bigint")
    got = lambda ignored: [r.path for r in df.where(files.readable(F.col("path"), F.col("length"), "/r", ignored)).collect()]
    assert got(None) == ["/r/a.py", "/r/gen/x.py", "/r/keep/gen/y.py"]
    assert got(files.gitignore(["# no", "", "/gen/"])) == ["/r/a.py", "/r/keep/gen/y.py"]
    assert got(files.gitignore(["gen/"])) == ["/r/a.py"]
    assert files.gitignore(["#x"]) is None
    # the last match decides
    names = spark.createDataFrame([(x,) for x in ("a.log", "keep.log", "d/keep.log", "other.txt")], "p string")
    left = lambda *lines: sorted(r.p for r in names.where(~F.col("p").rlike(files.gitignore(list(lines)))).collect())
    assert left("*.log", "!keep.log") == ["d/keep.log", "keep.log", "other.txt"]
    assert left("*.log", "!keep.log", "keep.log") == ["other.txt"]
    assert left("*.log", "!/keep.log") == ["keep.log", "other.txt"]
    # the graph reads more extensions and skips no suffix
    more = spark.createDataFrame([("/r/a.hs", 1), ("/r/b.min.js", 1), ("/r/C.PY", 1)], "path string, length bigint")
    kept = more.where(files.readable(F.col("path"), F.col("length"), "/r", None, files.PARSED + files.GRAPH_ONLY, ()))
    assert [r.path for r in kept.collect()] == ["/r/a.hs", "/r/b.min.js"]


def test_porcelain(spark):
    assert one(spark, " M a b.py", text.porcelain_path) == "a b.py"
    assert one(spark, "R  a -> b", text.porcelain_path) == "b"
    got = files.status_lines(spark, [" M x.py", "", "?? y/z.go"], "/r/")
    assert sorted(r.path for r in got.collect()) == ["/r/x.py", "/r/y/z.go"]


def test_hook_payload(spark):
    rows = ['{"tool_name": "Edit", "cwd": "/r", "tool_input": {"file_path": "a.py", "edits": [{"file_path": "b.py"}, {"file_path": "a.py"}]}}', '{"tool_name": "Read", "tool_input": {"path": "c"}}', "oops"]
    got = files.hook_payload(spark.createDataFrame([(x,) for x in rows], "value string"))
    assert sorted((r.tool_name, r.path) for r in got.collect()) == [("Edit", "a.py"), ("Edit", "b.py")]
