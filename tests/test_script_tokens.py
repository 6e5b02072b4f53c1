"""The token machine for scripts: declarations over several lines, comments, calls, and what it must not trip over."""

import time

import pytest

from lodestar.functions.script import rows_of, tokenise
from lodestar.operators import resolve

SERVICE = """
import { Store } from './store';
import http from 'http';

/**
 * Keeps invoices.
 * In two lines.
 */
export class InvoiceService extends Store {
  /**
   * Writes one.
   * @param owner whose it is
   * @returns whether it worked
   */
  public async write(owner: string, sum: number = 0.0): Promise<boolean> {
    const fine = this.known(owner);
    return fine;
  }

  private known(id: string): boolean {
    return id.length > 0;
  }
}

/** Shows money. */
export function money(
  value: number
): string {
  return '$' + value.toFixed(2);
}

export const cut = (
  total: number,
  rate: number,
): number => {
  return total * rate;
};
"""


def pick(text, what, *keys):
    return [tuple(r.get(k) for k in keys) if len(keys) > 1 else r.get(keys[0]) for r in rows_of(text) if r["what"] == what]


def test_service_file():
    assert pick(SERVICE, "symbol", "owner", "name", "kind", "line", "end_line", "exported") == [
        (None, "InvoiceService", "class", 9, 23, True),
        ("InvoiceService", "write", "method", 15, 18, True),
        ("InvoiceService", "known", "method", 20, 22, True),
        (None, "money", "function", 26, 30, True),
        (None, "cut", "function", 32, 37, True),
    ]
    assert pick(SERVICE, "symbol", "summary", "description")[:3] == [("Keeps invoices.", "In two lines."), ("Writes one.", None), (None, None)]
    write = next(r for r in rows_of(SERVICE) if r.get("name") == "write")
    assert [(p["name"], p["type_hint"], p["default_value"]) for p in write["params"]] == [("owner", "string", None), ("sum", "number", "0.0")]
    assert write["returns"] == "Promise<boolean>"
    assert pick(SERVICE, "import", "name", "module") == [("Store", "./store"), ("http", "http")]
    assert pick(SERVICE, "call", "name", "owner") == [("self.known", "InvoiceService.write"), ("value.toFixed", "money")]


@pytest.mark.parametrize(
    ("text", "calls"),
    [
        ("a(`x ${b(`${c()}`)} d()`)", ["a", "b", "c"]),
        ("x = y / z(1) / 2; w = /q(r)\\/[/(]/.exec(s)", ["z", ".exec"]),
        ("if (a) { b() } else while (c) { d?.(e) }", ["b", "d"]),
        ("// a()\n/* b()\n c() */ d() /* e( */", ["d"]),
        ("'a(' + \"b(\" + c('\\'d(')", ["c"]),
        ("new a.B<C<D>>(e); new F; new G().h()", ["a.B", "F", "G", ".h"]),
        ("const o = { m() { n() }, async p(q) { r() }, get s() { return t() }, [u()]: 1, v: w() }", ["n", "r", "t", "u", "w"]),
        ("interface A { b(c): d; e(): f }\nenum G { H = i(1) }\nj()", ["j"]),
        ("a.b<C>(d); e < f; g > (h)", ["a.b"]),
        ("import('x'); super(y); this.z(); super.q()", ["self.z", "super().q"]),
        ("@Deco({ a: b() }) class X { @In(c()) y = d(); m(e = f()) { g() } }", ["g"]),
        ("x\n  .then(a => b(a))\n  .catch(c)", ["x.then", "b", ".catch"]),
        ("function f(a = g()) { return h() }\nfoo(function k() { l() })", ["h", "foo", "l"]),
        ("}}} ))) a() ((( b( [", ["a", "b"]),
        ("`never closed ${a(", ["a"]),
        ("", []),
    ],
)
def test_calls(text, calls):
    assert sorted(pick(text, "call", "name")) == sorted(calls)


@pytest.mark.parametrize(
    ("text", "symbols"),
    [
        ("export default class A\n  extends B(C) implements D<E, F>, G.H\n{ constructor(private readonly x: Y) { super() } }", [("A", "class"), ("constructor", "method")]),
        ("const a = async x => b, c = function* () {}, d = class E {}, e = 1, { f } = g", [("a", "async_function"), ("c", "function"), ("d", "class")]),
        ("let a: (x: number) => void = (x) => {\n}\nvar b\nvar c = (1, 2)", [("a", "function")]),
        ("function a(x: string): string\nfunction a(x: any): any { return x }", [("a", "function"), ("a", "function")]),
        ("class A { static #p() {} static { q() } get r() { return 1 } 's t'() {} [u]() {} async *v() {} w = () => {}; abstract x(): y\n z?(): void }", [("A", "class"), ("#p", "class_method"), ("r", "method"), ("s t", "method"), ("[u]", "method"), ("v", "method"), ("x", "method"), ("z", "method")]),
        ("export async function\nlong\n<T extends U>\n(\na: T\n)\n:\nPromise<T>\n{ function inner() {} }", [("long", "async_function"), ("inner", "function")]),
        ("const f = function named() { return 1 }; g(function h() {})", [("f", "function")]),
        ("export const a = (x: { y: () => void }): x is string =>\n  x.y()\nfunction b() {}", [("a", "function"), ("b", "function")]),
    ],
)
def test_symbols(text, symbols):
    assert pick(text, "symbol", "name", "kind") == symbols


def test_bases_and_parameters():
    rows = rows_of("class A<T> extends m.B<C<T>> implements D, E<F, G> {}\nfunction f({ a, b }: { a: number, b: string } = {}, c?: Map<string, () => void>, ...d: any[]) {}")
    assert rows[0]["bases"] == ["m.B", "D", "E"]
    assert [(p["name"], p["type_hint"], p["default_value"], p["kind"]) for p in rows[1]["params"]] == [("{ a, b }", "{ a: number, b: string }", "{}", "positional"), ("c", "Map<string, () => void>", None, "positional"), ("d", "any[]", None, "args")]


def test_comments_belong_to_the_next_declaration():
    text = "f() // of f\nconst a = () => 1\n// one\n// two\n\nfunction b() {}\n/* c */ function c() {}\n/** gone */\nd()\nclass E {}"
    assert pick(text, "symbol", "name", "summary") == [("a", None), ("b", "two"), ("c", "c"), ("E", None)]


def test_imports():
    text = "import 'side';\nimport type { A } from \"./a\"\nimport d, { type B, c as e } from '../b.js';\nimport * as all from 'x/y';\nimport type F from 'f'; const g = import('h');"
    assert pick(text, "import", "module", "name", "alias") == [("./a", "A", None), ("../b.js", "d", None), ("../b.js", "B", None), ("../b.js", "c", "e"), ("x/y", None, "all"), ("f", "F", None)]


def test_brackets_have_partners():
    tokens, _, partner = tokenise("a(b[c{d}]`${e}f`)")
    for i, t in enumerate(tokens):
        if t.text in ("(", "[", "{", "${"):
            assert partner[partner[i]] == i


def test_long_and_deep_texts_take_linear_time():
    began = time.perf_counter()
    assert len(pick("class A {\n" + "  m(a: B<C>): D {\n    return this.n(`x ${y(1)}`);\n  }\n" * 30_000 + "}", "call", "name")) == 60_000
    assert len(pick("(" * 50_000 + "a()" + ")" * 50_000, "call", "name")) == 1
    assert len(pick("function f() {" * 3000 + "}" * 3000, "symbol", "name")) == 3000
    assert time.perf_counter() - began < 60


def test_relative_modules(spark):
    files = [("web/a/x.ts",), ("web/a/y/index.jsx",), ("web/z.tsx",), ("top.js",), ("web/index.ts",), ("web/both.ts",), ("web/both/index.ts",), ("web/plain.css",)]
    wanted = {"./x": "web/a/x.ts", "./y": "web/a/y/index.jsx", "../z": "web/z.tsx", "../../top": "top.js", "..": "web/index.ts", "../": "web/index.ts", "../both": "web/both.ts", "./x.js": "web/a/x.ts", ".././a/./x": "web/a/x.ts", "../plain.css": "web/plain.css", "../../../top": None, "./none": None, "x": None, ".x": None, "": None}
    rows = [(i, "web/a/from.ts", m) for i, m in enumerate(wanted)] + [(99, "top.ts", "./web/z"), (100, "web/a/from.ts", None)]
    imports = spark.createDataFrame(rows, "imp_ord int, file_path string, module_name string")
    got = {r["imp_ord"]: r["path"] for r in resolve.resolve_script(imports, spark.createDataFrame(files, "file_path string")).collect()}
    assert got == {**{i: p for i, p in enumerate(wanted.values()) if p}, 99: "web/z.tsx"}


def test_tokens_stand_in_columns():
    """No object for each token: texts, starts and ends by columns, over comments, patterns, divisions and code in templates."""
    text = "a /* x */ = /[/]b/g.test(`c${d / 2}` + e) // f\n  \n"
    tokens, notes, _ = tokenise(text)
    assert tokens.texts == ["a", "=", "/[/]b/g", ".", "test", "(", "`", "${", "d", "/", "2", "}", "`", "+", "e", ")"]
    assert [text[a:b] for a, b in zip(tokens.starts, tokens.ends, strict=True)] == ["a", "=", "/[/]b/g", ".", "test", "(", "`c${", "", "d", "/", "2", "}", "`", "+", "e", ")"]
    assert [text[a:b] for a, b in notes.values()] == ["/* x */", "// f"]
