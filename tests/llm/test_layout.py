import random

import pytest

from basalt.llm import layout

CODE = "import os\n\n\ndef f(a, b):\n    if a:\n        return b\n    return os.path.join(a, b)\n" * 4
R = random.Random(3)
NUMBERS = "X = [\n" + "".join("    " + ", ".join(str(R.randrange(256)) for _ in range(20)) + ",\n" for _ in range(30)) + "]\n"
BLOB = "B = [\n" + "".join('    "' + "".join(R.choice("ABCDEFGHabcdefgh0123+/") for _ in range(90)) + '",\n' for _ in range(20)) + "]\n"
MIN = "!function(e){" + "".join(f"function a{i}(b,c){{return b?c+{i}:c*{i}}}var d{i}={{x:{i},y:!0}};" for i in range(60)) + "}(this);"
TABLE = "NAMES = {\n" + "".join(f'    "{w}": "{w} kept in order",\n' for w in ("apple", "pear", "plum", "fig") * 20) + "}\n"


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("a/b.py", CODE, ""),
        ("a/vendor/b.py", CODE, "vendored"),
        ("a/vendors_api/b.py", CODE, ""),
        ("a/gen/b.go", "package x\n", "generated"),
        ("a/b_pb2.py", CODE, "generated"),
        ("a/b.py", "# Code generated by apiweave v1.2.3. DO NOT EDIT.\n" + CODE, "generated"),
        ("a/b.py", "# This file is part of Prism 1.2.3. Imported unchanged from upstream commit abc.\n" + CODE, "vendored"),
        ("a/b.py", '"""Do not edit this order without asking the owners."""\n' + CODE, ""),
        ("a/b.py", "# Licence check for our own files, (c) headers are added on release.\n" + CODE, ""),
        ("a/b.py", NUMBERS, "data"),
        ("a/b.py", BLOB, "data"),
        ("a/b.py", "\ufffdPNG\r\n\x1a\n\0\ufffd\ufffd", "data"),
        ("a/b.js", "<!DOCTYPE html>\n<html><body>page</body></html>\n", ""),
        ("a/b.py", TABLE, ""),
        ("a/b.js", MIN, "minified"),
        ("a/b.yaml", "x: 1\n", ""),
        ("a/b.js", "", ""),
        (None, CODE, ""),
        ("vendor/x.rs", "fn main() {}\n", "vendored"),
        ("vendor/x.yaml", "x: 1\n", ""),
        ("src/x.rb", "# Code generated by apiweave v1.2.3. DO NOT EDIT.\n", "generated"),
        ("a/b.py", CODE * 9 + "# Code generated by apiweave v1.2.3. DO NOT EDIT.\n" + CODE * 9, "generated"),
        ("a/b.py", CODE * 400 + "# Copied unchanged from upstream\n" + CODE * 400, "vendored"),
    ],
)
def test_verdict(path, text, want):
    assert layout.verdict(path, text.encode()) == want


def test_tables(spark):
    rows = [("v/a.py", CODE.encode()), ("v/a.py", CODE.encode()), ("v/b.py", None), (None, b"x"), ("v/c.js", MIN.encode()), ("v/d.py", b"\xff\xfe\x00"), ("vendor/e.py", None)]
    df = spark.createDataFrame(rows, "path string, content binary").selectExpr("*", "'x' as verdict")
    assert {r.path for r in layout.not_handwritten(df).collect()} == {"v/c.js", "v/d.py", "vendor/e.py"}
    assert layout.classify(df).count() == 5
    assert layout.classify(df.where("false")).count() == 0


def test_statistics_of_a_long_line():
    st = layout.statistics(b"a" * 1_000_000)
    assert st["max_line"] == 1_000_000 and st["white_share"] == 0


@pytest.mark.parametrize("mark", ["Code generated by protoc v3. DO NOT EDIT.", "Copied unchanged from upstream"])
@pytest.mark.parametrize("block", [False, True])
def test_marker_below_a_long_preamble(mark, block):
    lines = [f" * Clause {i} of the terms under which the parts of this work may be used." for i in range(90)]
    head = "/*\n" + "\n".join(lines) + f"\n * {mark}\n */\n" if block else "".join(f"//{x[2:]}\n" for x in [*lines, f" * {mark}"])
    code = "".join(f"int add_{k}(int first, int second) {{\n    return first + second * {k};\n}}\n" for k in range(4))
    assert layout.verdict("src/add.c", (head + code).encode())
    assert layout.verdict("src/add.c", (head.replace(mark, "Kept in order.") + code).encode()) == ""


def test_counts_are_bytes():
    assert layout.counts("é a1\n\tb\n".encode()) == {"n_bytes": 9, "n_lines": 3, "max_line": 5, "white": 4, "alnum": 5}
    assert layout.counts(b"") == {"n_bytes": 0, "n_lines": 1, "max_line": 0, "white": 0, "alnum": 0}


@pytest.mark.parametrize(
    "line",
    [
        ", ".join(str(100 + 7 * i) for i in range(40)) + ", // and the rest",
        "1" * 200_000 + "!",
        "[" + ",   ".join("12" * 9 for _ in range(5000)) + " x",
        "// " + "1" * 100_000 + " released",
        "// copyright (c) " + "1 " * 50_000 + "generated",
        "// " + "(c) the authors " * 20_000,
        "// " + "SPDX-License-Identifier: (c) " * 10_000,
        "// " + "this file is part of " * 10_000,
    ],
)
def test_long_lines_end(line):
    """Each took hours or minutes when a line could be read in many ways."""
    from time import process_time

    start = process_time()
    layout.verdict("src/a.c", (line + "\nint x;\n").encode())
    layout.statistics((line + "\n").encode())
    assert process_time() - start < 10


@pytest.mark.parametrize(
    ("line", "row"),
    [(b"12, 200, 31,", True), (b"200,", True), (b"20,", False), (b"0x1F, 0xA0, 0x3", True), (b"0x1F,", False), (b"{-1.5e-3, 2, +4};", True), (b"12, 200, 31, // x", False), (b"100x200", True)],
)
def test_rows_of_numbers(line, row):
    assert bool(layout.TABLE.fullmatch(line)) == row


@pytest.mark.parametrize("text", [CODE, NUMBERS, BLOB, MIN, TABLE, "x = 1", "\n", "a" * 63 + "\n", "a" * 64, "def a(): return b\n" * 30, "x = 5\n" * 9, '"' + r"\x41" * 300 + '"\n'])
def test_bounds_leave_verdicts_as_they_are(text):
    for suffix in ("py", "js", "sh", "c"):
        raw = text.encode()
        assert layout.verdict(f"a/b.{suffix}", raw) == layout.verdict(f"a/b.{suffix}", raw, layout.statistics(raw))
