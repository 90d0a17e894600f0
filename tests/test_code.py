"""Edges and definitions by the rules of each language, with rows written by hand; hostile texts; equality of the batch form with the rows of single files."""

import time

import pytest

from corpusmill.operators import code, graph
from corpusmill.operators.lexer import tokens
from corpusmill.operators.stripping import strip_code

RUST = """use a::{b, c::{d, e}};
pub use x::y;
impl<T: Fn(u8)> Shop<T> for Z where T: A {
    pub fn run(&self, n: u8) -> Option<u8> {
        let Some(x) = Foo::bar(1) else { return None };
        std::fs::read(path)?.lines().map(|l| helper(l));
        vec![skipped(1)];
        match self.go() { Some(q) if ok(q) => Item(q), Other(z) => z.parse::<u8>(), _ => Ok(1) };
    }
}
"""
SCRIPT = """import { b } from "b";
export default async function main(x = first()) {
  await go(`v ${inner(1)} w`);
  new Door(1).open();
}
class Shop extends Base {
  #p = field();
  static async shut() { return super.shut(); }
}
const q = { m(a) { return called(a); } };
const C2 = class Named { z() { zz(); } };
tagged`x`;
"""
TYPED = """import type { A } from './t';
export class Shop<T> extends Base<T> implements Open {
  constructor(private readonly x: X) { super(); init(); }
  async open(n: number): Promise<void> { load<T>(n); }
  abstract shut(a: string): void;
}
interface W { f(a: number): void; }
declare function d(a: number): void
export function sum(x: number): { a: number } { return add(x)!.b(); }
"""
GO = """package main
import (
\t"fmt"
\tx "net/http"
)
type ( A interface { Foo(a int) error }
 B int )
func (s *Shop) Open(n int) error {
\tdefer s.mu.Unlock()
\tgo func() { load(n) }()
\treturn fmt.Errorf("x %w", []byte(s))
}
func Map[T any](a []T) { len(a); x.Get(u).Body.Close() }
"""
JAVA = """import java.util.*;
import static a.B.c;
public class A<T extends B> extends Base<T> implements I<X, Y>, J {
    private int f = make();
    public A(int n) { this(n, 1); setup(); }
    abstract void no(int a);
    public <R> List<R> open(int n) throws E {
        for (int i = 0; i < size(); i++) { step(i).then(x -> done(x)); }
        new Door(n) { void inner() { deep(); } }.width();
        return super.open(n);
    }
}
enum Color { RED(1), BLUE(two()); Color(int x) { paint(); } int v() { return w(); } }
interface W extends X { int q(int a); }
"""


def edges(text, language):
    return sorted({e for e in code._edges(text, language)}, key=str)


def rows(imports=(), bases=(), calls=""):
    """Calls as ``scope>name@line``."""
    found = [(None, n, "imports", at) for n, at in imports] + [(s, t, k, at) for s, t, k, at in bases]
    for c in calls.split():
        (scope, rest), at = c.split(">", 1), int(c.rsplit("@", 1)[1])
        found.append((scope or None, rest.rsplit("@", 1)[0], "calls", at))
    return sorted(found, key=str)


@pytest.mark.parametrize(("language", "text", "want"), [
    ("rust", RUST, rows([("a::{b, c::{d, e}}", 1), ("pub use x::y", 2)], (), "run>Foo::bar@5 run>bar@5 run>Foo@5 run>std::fs::read@6 run>read@6 run>std::fs@6 run>lines@6 run>map@6 run>helper@6 run>go@8 run>ok@8 run>Item@8")),
    ("javascript", SCRIPT, rows([("b", 1)], (), "main>first@2 main>go@3 main>inner@3 main>open@4 Shop>field@7 Shop>shut@8 >called@10 >zz@11 >tagged@12")),
    ("typescript", TYPED, rows([("./t", 1)], (), "Shop>init@3 Shop>load@4 sum>add@9 sum>b@9")),
    ("go", GO, rows([("fmt", 3), ("net/http", 4)], (), "Open>s.mu.Unlock@9 Open>load@10 Open>fmt.Errorf@11 Map>x.Get@13 Map>x.Get(u).Body.Close@13")),
    ("java", JAVA, rows([("java.util", 1), ("a.B.c", 2)], [("A", "Base<T>", "extends", 3), ("A", "I<X", "implements", 3), ("A", "Y>", "implements", 3), ("A", "J", "implements", 3)], "A>make@4 A>setup@5 open>size@8 open>step@8 open>then@8 open>done@8 inner>deep@9 open>width@9 open>open@10 >two@13 >paint@13 v>w@13")),
])
def test_edges(language, text, want):
    assert edges(text, language) == want


def test_definitions():
    got = lambda text, x: [(d.kind, d.name, d.first, d.last) for d in code.definitions(text, x)]
    assert got(JAVA, "java") == [("class", "A", 3, 12), ("method", "A", 5, 5), ("method", "no", 6, 6), ("method", "open", 7, 11), ("method", "inner", 9, 9), ("enum", "Color", 13, 13), ("method", "Color", 13, 13), ("method", "v", 13, 13), ("interface", "W", 14, 14), ("method", "q", 14, 14)]
    assert got(TYPED, "tsx") == [("class", "Shop", 2, 6), ("method", "constructor", 3, 3), ("method", "open", 4, 4), ("interface", "W", 7, 7), ("function", "d", 8, 8), ("function", "sum", 9, 9)]
    assert got("@Ann(1)\nclass A(\n  val n: Int = f()\n) : B()\nfun g() = h(1)\ninterface I { fun f(): Int\n fun g() }\n", "kotlin") == [("class", "A", 1, 4), ("function", "g", 5, 5), ("class", "I", 6, 7), ("function", "f", 6, 6), ("function", "g", 7, 7)]
    assert got("def a = b(1)\ndef self.c\n  x = if d then e(1) else 2 end\n  while f(1) do\n  end\nend\nmodule M; end\n", "ruby") == [("method", "a", 1, 1), ("method", "c", 2, 6), ("module", "M", 7, 7)]


def test_strings_comments_and_patterns_hide_nothing_else():
    assert edges("a('b(1)'); // c(1)\n/* d(1) */ e(/[/\"(]f(1)/.g(2) / h(3));", "javascript") == rows((), (), ">a@1 >e@2 >g@2 >h@2")
    assert edges("x(r#\"a(1) \" b(2)\"#, 'c', '\\'') /* /* d(1) */ e(1) */; fn f<'a>() { g(1) }", "rust") == rows((), (), ">x@1 f>g@1")
    assert edges("x = <<~SQL + foo(\"#{bar 1}\")\n baz(1)\nSQL\nqux(a / b / c)\n", "ruby") == rows((), (), ">foo@1 >bar@1 >qux@4")
    assert edges("val s = \"a ${f(\"b ${g(1)}\")} $y\" + \"\"\"q \" h(1) ${i(1)}\"\"\"", "kotlin") == rows((), (), ">f@1 >g@1 >i@1")
    assert edges('a(@"p""q(1)\\", $"{{b(1)}} {c(1)}");', "csharp") == rows((), (), ">a@1 >c@1")
    assert strip_code("a = `x ${f(1)} y`; // z", "typescript").split() == ["a", "=", "${f(1)}", ";"]


def test_python_edges(spark):
    text = "from __future__ import annotations\nfrom .a import b\nfrom .. import c\nimport d.e as f\n@deco(1)\nclass K(Base(2)):\n    @other(3)\n    def m(self, x=first()):\n        return vars(x).go(len(x))\n"
    got = graph.python_edges(spark.createDataFrame([("p", text), ("q", None), ("r", "def (")], "path string, text string"), "path", "text").collect()
    want = rows([(".a", 2), ("..", 3), ("d.e", 4)], (), ">deco@5 K>Base@6 K>other@7 m>first@8 m>vars@9 m>go@9")
    assert sorted([(r.source_name, r.target_name, r.kind, r.line) for r in got], key=str) == want


def test_files_of_all_languages(spark):
    """Nulls, empty texts, unknown languages and repeated rows; JSX and TSX have definitions and no edges."""
    files = [("a", GO, "go"), ("a", GO, "go"), ("b", TYPED, "tsx"), ("c", None, "go"), ("d", "", "rust"), ("e", "f(1)", None), ("f", "f(1)", "sql"), *((f"x{x}", "}}{{ ( [ < ' \" ` # / *", x) for x in code.LANGUAGES)]
    got = code.code_edges(spark.createDataFrame(files, "path string, text string, language string"), "path", "text", "language").collect()
    assert sorted([(r.source_name, r.target_name, r.kind, r.line) for r in got], key=str) == edges(GO, "go") and {r.source_file for r in got} == {"a"}


@pytest.mark.parametrize("language", code.LANGUAGES)
def test_hostile_texts_take_linear_time(language):
    for unit in ("f(", "{", "(", "class A ", "class A : ", "fn f() ", "function f(", "fun f(", "def f ", "a.b().", "a::b::", "x<", "@A ", "[", "/[ ", "`${", '"', "/*", "impl A for ", "enum A { f(1), ", "do "):
        start = time.perf_counter()
        code.scan(("<?php " if language == "php" else "") + unit * 3_000, language)
        assert time.perf_counter() - start < 3
    assert sum(b - a for _, a, b in tokens("a ( b", "go")) == 3
