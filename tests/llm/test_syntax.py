import ast
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from basalt.llm import gll, syntax

VALID = {
    "py": [
        "x: int = 1\n", "def f(a, /, b=1, *c, d: int = 2, **e) -> int:\n    return lambda x, *y: x\n", "match x:\n    case {'a': [1, *_]} | None if y:\n        ...\n    case A.B(c=1) as d: pass\n",
        "async def f():\n    async with a as b, c:\n        yield [x async for x in y if x]\n", "type X[T] = list[T]\nmatch = type = 1\nprint(f'{x!r:>{w}}', end='')\n", "try:\n    pass\nexcept* E as e:\n    pass\n", "x = '''\n<<<<<<< HEAD\n'''\n",
        "with (a as b, c as d):\n    pass\nx[1:2, ::3] = y = {**a, 'b': 1}\ndel x, y\n", "if (n := f()) > 1 and not a in b: pass\n", "@a.b(1)\nclass C[T](B, metaclass=M):\n    x = 1; y = 2\n", "# only\n", "",
    ],
    "js": [
        "import a, { b as c } from './x';\nexport default class extends A { #p = 1; static async *g() { yield* 1 } get x() { return this.#p } }\n", "const f = async ({ a = 1, ...b }, [c, , d]) => ({ ...b, [a]: c?.d ?? 1 })\n",
        "for (const x of y) { if (a) continue; else break }\nlabel: for (;;) {}\n", "let r = /a[/]b/g.test(x) ? `t${`n${1}`} }}` : x / y / z\n", "export { a, b as default } from 'm'\nexport * as n from 'm'\n", "const x = 1\nconst y = 2\nx\n++y\n",
        "switch (a) { case 1: { } default: throw new Error('x') }\ntry { } catch { } finally { }\n", "/*\n<<<<<<< HEAD\n*/\nvar a = function* () {}\n",
    ],
    "ts": [
        "interface A<T extends object = {}> { readonly x?: number; [k: string]: any; m<U>(a: U): void; new (x: string): A<T> }\n", "export abstract class B<T> extends C<T> implements D, E { constructor(private readonly a: string, public b?: number) { super() } abstract f(): Promise<Map<string, T[]>>; static #x = 1 }\n",
        "type F = { [K in keyof T]-?: T[K] extends infer U ? U : never } | `a${string}` | [a: string, ...b: number[]]\n", "enum E { A = 1, B = 'x' }\ndeclare module 'm' { export const x: unique symbol }\n",
        "function g(this: Window, a?: string, ...r: any[]): a is string { return (a as unknown as string)!.length > 1 }\nlet z = f<string>(x)\n", "namespace N.M { export type T = typeof import('x') }\nconst v = <T,>(x: T): T => x\n", "const module = 1, type = module satisfies number\n",
    ],
    "go": [
        "package a\n\nimport (\n\tf \"fmt\"\n\t. \"os\"\n)\n\ntype T[K comparable, V any] struct {\n\tA int `x`\n\t*B\n}\n\nfunc (t *T[K, V]) M(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[1]; !ok {\n\t\treturn\n\t} else if x == (T{1}) {\n\t}\n\tfor i := range 10 {\n\t}\n\tswitch y := z.(type) {\n\tcase int, *T:\n\t\tfallthrough\n\tdefault:\n\t}\n\tselect {\n\tcase c <- 1:\n\tcase v := <-d:\n\t}\n\tgo func() {}()\n\tdefer f.Close()\n\treturn 1, nil\n}\n",
        "package a\n// c\nvar x = map[string][]int{\"a\": {1, 2}, \"b\": nil}\nconst (\n\tA = iota\n\tB\n)\nvar s = `\n=======\n`\n", "// only a comment\n",
    ],
    "java": [
        "package a.b;\nimport static x.Y.*;\n@A(b = {1, 2}) public final class C<T extends D & E> extends F<T> implements G, H<? super T> {\n  private static final int[] X = {1, 2}, Y[] = {};\n  static { }\n  C(int a) throws X { this.a = a; }\n  <U> List<Map<String, U[]>> f(final U u, int... r) { for (var x : y) { if (x instanceof String s && s.length() > 1) return (T) null; } return a < b ? x -> x + 1 : String::valueOf; }\n}\n",
        "record P(int x, String y) implements Q { P { } }\nenum E { A(1) { void f() { } }, B; int z; }\nsealed interface S permits A, B { default void f() { try (var a = b; c) { } catch (X | Y e) { } finally { } } }\n",
        "class A { int f(Object o) { return switch (o) { case Integer i when i > 1 -> 1; case null, default -> { yield 2; } }; } String t = \"\"\"\n  a \"b\"\n  \"\"\"; Runnable r = () -> { int[][] a = new int[3][]; label: while (true) { break label; } }; }\n",
    ],
    "c": [
        "#include <stdio.h>\n#define X(a) \\\n  (a)\ntypedef struct a { int x : 3; union { int y; } z[2]; } a_t;\nstatic inline const char *f(void (*g)(int, ...), a_t *b, int n[static 3]) {\n  for (int i = 0, *p = &i; i < 10; ++i) { if (!g) goto end; else *p++ = (int)sizeof(a_t) * b->x; }\n  switch (n[0]) { case 'a': case 2 ... 3: break; default: ; }\n  do { } while (0);\nend:\n  return \"a\" \"b\";\n}\nenum e { A = 1, B, };\nint x[] = { [1] = 2, 3 }, (*fp)(void) = 0;\na_t q = { .x = 1, .z[0] = { 2 } };\n",
        "int main() { unsigned long long x = 1ULL << 3, y; y = (x) + 1; T * z; f(sizeof(int), (char *)z); return x ? y : -1; }\n",
    ],
    "sh": [
        "#!/bin/bash\nset -eu\nf() {\n  local x=\"$(g \"$1\" | sort -u)\" y=${z:-\"a b\"}\n  if [ -z \"$1\" ] && [[ $x =~ ^(a|b)$ ]]; then echo if; elif true; then :; else return 1; fi >&2\n}\nfor i in \"$@\"; do echo $((i + 1)); done < \"$1\"\ncase $x in a|b) ;; *) echo 'x' ;; esac\ncat <<'E' > f\n<<<<<<< HEAD\n) } (\nE\nwhile read -r l; do ((n++)) || true; done\na=(1 2 \"3\")\n{ a; b; } | (c & d)\nfunction g { select x in a; do break; done; }\necho `ls` 2>&1 >/dev/null &\n",
    ],
    "yaml": [
        "a: 1\nb:\n  - x\n  - y: 2\n    z: [1, {a: b}, 'q']\n# c\nc: |\n  text: here\n   more\nd: \"e: f\"\n? k\n: v\n", "- a\n- - b\n  - c\n-\n  d: e\n", "---\na: &x {b: c}\nd: *x\n...\n---\n- !t s\n", "a:\n- b\n- c\nd: plain text\n  goes on\n", "a: http://x.y/z?q=1#f\nb: \"\"\nc:\n", "just text\n",
    ],
    "json": ['{"a": [1, -2.5e3, true, null, {"b": "\\u00e9\\n"}]}', "3", "[]"],
}
BROKEN = {
    "py": ["def f(\n", "x = = 1\n", "if x\n    y\n", "  x\n y\n", "class A:\n", "print 'a'\n", "<<<<<<< HEAD\nx = 1\n", "x = 'a\n", "a b\n", "def f():\nx\n", "41: panel | expand the rest\n", "import { a } from './b';\n"],
    "js": ["function f( {", "const = 1", "if (a { }", "a => ", "<<<<<<< HEAD\na\n", "let x = `a${b`", "import time\nx = 1:\n", "class { f( }", "<!DOCTYPE html>", "interface A { x: string }", "const x: number = 1", "a b", "}"],
    "ts": ["interface A { x: }", "type = ;", "enum { A }", "function f(a: { }", "let x: = 1", "def f():\n    pass\n"],
    "go": ["package a\nfunc f( {\n}\n", "package a\nfunc f() {\n\tx :=\n}\n", "func f() {}\n", "package a\nfunc f() {\n", "package a;\nimport java.util.List;\n", "package a\nvar x = \"a\n"],
    "java": ["class A { void f( { } }", "class A {", "class A { int x = ; }", "package a\nimport (\n", "class A { void f() { return } }", "class A { void f() { int x } }"],
    "c": ["int f( { }", "int f() { return 1 }", "int f() {", "int x = ;", "#if A\nint x;\n", "/* open\nint x;", "import os\n", "int f() { if (a { } }"],
    "sh": ["if true; then\n", "f() {\n", "echo 'a\n", "for x in a; do\n", "case x in\n", "done\n", "<<<<<<< HEAD\na\n>>>>>>> b\n", "echo $(ls\n", "a | | b\n", "fi\n"],
    "yaml": ["a: b: c\n", "a: [1\n", "a: 'x\n", "a:\n\tb: 1\n", "a: 1\n  b: 2\n", "a: 1\nb\nc: 2\n", "{ a: 1\n", "a: 1\n- b\n", "a: @x\n"],
    "json": ['{"a": 1,}', "{'a': 1}", "[1 2]", '{"a" 1}', "// c\n{}", '{"a": NaN}', "[1,", '"a'],
}


@pytest.mark.parametrize(("ext", "text"), [(e, t) for e, ts in VALID.items() for t in ts])
def test_valid(ext, text):
    assert syntax.valid("x." + ext, text.encode()) is True
    if text.strip() and not (ext == "go" and text.startswith("//")):
        assert syntax._accepted(syntax.SUFFIXES[ext], text)


@pytest.mark.parametrize(("ext", "text"), [(e, t) for e, ts in BROKEN.items() for t in ts])
def test_broken(ext, text):
    assert syntax.valid("x." + ext, text.encode()) is False


def test_decisions():
    assert syntax.valid("x.env", b"(((") is None and syntax.valid(None, b"x") is None and syntax.valid("py", b"(") is None
    assert syntax.valid("x.py", None) is True and syntax.valid("x.json", b" \n") is True
    assert syntax.valid("x.py", b"\xef\xbb\xbfx = 1\r\n") is True and syntax.valid("x.py", b"# \xe9\nx = 1\n") is True and syntax.valid("x.go", b"\x89PNG\0") is False


def test_ambiguous_and_left_recursive_grammars():
    g = gll.Grammar("s: e EOF ; e: e '+' e | NUM ;")
    ids = g.terms
    expr = [ids["NUM"], ids["+"]] * 30 + [ids["NUM"], ids["EOF"]]
    assert g.accepts(expr, ("s",))[0] and not g.accepts(expr[:-2] + [ids["EOF"]], ("s",))[0]
    h = gll.Grammar("s: a* 'b'? EOF ; a: 'a' | 'a' 'a' | ;")
    t = h.terms
    assert h.accepts([t["a"]] * 25 + [t["b"], t["EOF"]], ("s",))[0]
    two = gll.Grammar("x: 'a' EOF ; y: 'b' EOF ;")
    assert two.accepts([two.terms["b"], two.terms["EOF"]], ("x", "y"))[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["x", "1", "+", "(", ")", "[", "]", ",", ":", "if", "else", "lambda", "=", "not", "for", "in", "\n", "    ", ".a", "'s'"]), max_size=9))
def test_python_grammar_takes_all_that_python_takes(parts):
    text = " ".join(parts)
    try:
        ast.parse(text)
    except (SyntaxError, ValueError):
        return
    assert syntax._accepted("python", text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet='{}[]:,"1a \\-.e', max_size=14))
def test_json_against_the_parser(text):
    try:
        json.loads(text, parse_constant=syntax._no_constant)
        want = True
    except ValueError:
        want = not text.strip()
    assert syntax.valid("x.json", text.encode()) is want


def test_tables(spark):
    rows = [("/g/a.py", b"x = 1\n"), ("/g/b.py", b"x = \n"), ("/g/b.py", b"x = \n"), (None, b"("), ("/g/c.json", None), ("/g/d.env", b"A=("), ("/g/e.js", b"(")]
    df = spark.createDataFrame(rows, "path string, content binary").selectExpr("*", "1 as valid", "'x' as lang")
    assert {r.path for r in syntax.broken(df).collect()} == {"/g/b.py", "/g/e.js"}
    files = spark.createDataFrame([("g", "/g/a.py"), ("g", "/g/b.py"), ("h", "/g/e.js")], "group_id string, path string")
    got = {(r.group_id, r.lang): (r.files, r.broken, r.rate) for r in syntax.rates(df, files).collect()}
    assert got == {("g", "python"): (2, 1, 0.5), ("h", "javascript"): (1, 1, 1.0), (None, "json"): (1, 0, 0.0)}
    assert syntax.broken(df.where("false")).count() == 0


def test_very_long_file():
    assert syntax.valid("x.py", b"x = [1, (2)]\n" * 30_000) is True
    assert syntax.valid("x.json", b"[" + b"[1, 2], " * 40_000 + b"0]") is True
    assert syntax.valid("x.js", ("f(a, b);\n" * 20_000 + "f(").encode()) is False
