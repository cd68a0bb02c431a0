import pytest

from cairnset.operators import syntax as S

SOURCES = {
    "rust": ('use std::io::{self, Read};\n// a "comment {\n/* outer /* inner */ fn not_me() {} */\n/// Doc of it.\n#[inline]\npub fn load(p: &str) -> Result<Vec<u8>> {\n    let x = parse::deep(p);\n    self.store(x); Some(x)\n}\n\nimpl Store {\n    fn keep(&self) { helper(\'{\'); }\n}\nstruct Unit;\nconst LIMIT: usize = 5;\ntrait Walk { fn go(&self); }\n',
             {("Function", "load", None, 6, 9), ("Impl", None, None, 11, 13), ("Function", "keep", None, 12, 12), ("Struct", "Unit", None, 14, 14), ("Constant", "LIMIT", None, 15, 15), ("Trait", "Walk", None, 16, 16)},
             {(None, "std::io::{self, Read}", "imports"), ("load", "parse::deep", "calls"), ("load", "deep", "calls"), ("load", "parse", "calls"), ("load", "store", "calls"), ("keep", "helper", "calls")}),
    "python": ('import os, sys as s\nfrom a.b import c\n\nclass Store(Base):\n    """Doc."""\n    # why\n    def keep(self,\n             x: int):\n        return helper(x).finish()\n\n    @cached\n    async def other(self):\n        len(self)\n\ndef top(): return keep(1)\n',
               {("Class", "Store", None, 4, 13), ("Function", "keep", "class_definition Store", 7, 9), ("Function", "other", "class_definition Store", 12, 13), ("Function", "top", None, 15, 15)},
               {(None, "os", "imports"), (None, "sys", "imports"), (None, "a.b", "imports"), ("keep", "helper", "calls"), ("keep", "finish", "calls"), ("top", "keep", "calls")}),
    "typescript": ("import { a } from './a';\nexport interface Box {\n  size: number;\n}\ntype Pair = [number, number];\nexport class Store extends Base {\n  constructor(x: number) { super(x); }\n  async keep(x: string): Promise<void> {\n    await this.run(x, `if ( {`);\n  }\n}\nexport async function top() { return fetch(load()); }\n",
                   {("Interface", "Box", None, 2, 4), ("TypeAlias", "Pair", None, 5, 5), ("Class", "Store", None, 6, 11), ("Method", "constructor", "class_declaration Store", 7, 7), ("Method", "keep", "class_declaration Store", 8, 10), ("Function", "top", None, 12, 12)},
                   {(None, "./a", "imports"), ("Store", "run", "calls"), ("top", "load", "calls")}),
    "go": ('package x\nimport (\n\t"fmt"\n\tlog "a/b"\n)\ntype Store struct {\n\tn int\n}\nfunc (s *Store) Keep(x int) error {\n\treturn fmt.Errorf("no %d {", helper(x))\n}\nfunc top() { make([]int, 1) }\n',
           {("Struct", "Store", None, 6, 8), ("Method", "Keep", None, 9, 11), ("Function", "top", None, 12, 12)},
           {(None, "fmt", "imports"), (None, "a/b", "imports"), ("Keep", "fmt.Errorf", "calls"), ("Keep", "helper", "calls")}),
    "java": ("import java.util.List;\npublic class Store extends Base<A> implements Walk, Keep<B, C> {\n  private int n = 1;\n  public Store(int x) { this.n = x; }\n  @Override\n  public List<String> keep(String a) throws X {\n    if (a == null) { return other(a); }\n    return a.trim();\n  }\n}\ninterface Walk { void go(); }\nenum Kind { A, B }\n",
             {("Class", "Store", None, 2, 10), ("Method", "Store", "class_declaration Store", 4, 4), ("Method", "keep", "class_declaration Store", 6, 9), ("Interface", "Walk", None, 11, 11), ("Enum", "Kind", None, 12, 12)},
             {(None, "java.util.List", "imports"), ("Store", "Base<A>", "extends"), ("Store", "Walk", "implements"), ("Store", "Keep<B, C>", "implements"), ("keep", "other", "calls"), ("keep", "trim", "calls")}),
    "c": ('#include <stdio.h>\n#include "own.h"\nstruct point { int x; };\nenum kind { A };\nstatic int scan(const char *s, int n) {\n  if (n) return walk(s);\n  printf("{");\n  return 0;\n}\n',
          {("Struct", "point", None, 3, 3), ("Enum", "kind", None, 4, 4), ("Function", "scan", None, 5, 9)}, {(None, "stdio.h", "imports"), (None, "own.h", "imports"), (None, "walk", "calls")}),
    "cpp": ("class Store : public Base {\n public:\n  int keep(int x) const { return help(x); }\n};\n", {("Class", "Store", None, 1, 4), ("Function", "keep", "class_specifier Store", 3, 3)}, {(None, "help", "calls")}),
    "php": ("<?php\nuse A\\B;\nrequire_once 'x.php';\nclass Store extends Base implements Walk, Keep {\n  public function keep($a) { return $this->run(strlen($a)); }\n}\nfunction top() { help(); } # {\n",
            {("Class", "Store", None, 4, 6), ("Method", "keep", "class_declaration Store", 5, 5), ("Function", "top", None, 7, 7)},
            {(None, "A\\B", "imports"), (None, "x.php", "imports"), ("Store", "Base", "extends"), ("Store", "Walk", "implements"), ("Store", "Keep", "implements"), ("keep", "run", "calls"), ("top", "help", "calls")}),
    "ruby": ("require 'set'\nmodule Out\n  # kept\n  class Store < Base\n    include Walk\n    def keep(x)\n      if x\n        help(x)\n      end\n      [1].each do |y|\n        run(y)\n      end\n    end\n  end\nend\n",
             {("Module", "Out", None, 2, 15), ("Class", "Store", None, 4, 14), ("Method", "keep", "class Store", 6, 13)},
             {(None, "set", "imports"), ("Store", "Base", "extends"), ("Store", "Walk", "implements"), ("keep", "help", "calls"), ("keep", "run", "calls")}),
    "csharp": ("using System.Text;\npublic class Store : Base, IWalk<A, B> {\n  public Store() { }\n  public async Task<int> Keep(string a) { return await Help(a); }\n}\npublic struct Point { }\n",
               {("Class", "Store", None, 2, 5), ("Method", "Store", "class_declaration Store", 3, 3), ("Method", "Keep", "class_declaration Store", 4, 4), ("Struct", "Point", None, 6, 6)},
               {(None, "System.Text", "imports"), ("Store", "Base", "extends"), ("Store", "IWalk<A, B>", "extends"), ("Keep", "Help", "calls")}),
    "kotlin": ("import a.b.C\nclass Store(val x: Int) : Base(x), Walk {\n  fun keep(a: String): Int { return help(a) }\n}\nobject One { fun go() = run { x() } }\n",
               {("Class", "Store", None, 2, 4), ("Function", "keep", "class_declaration Store", 3, 3), ("Class", "One", None, 5, 5), ("Function", "go", "object_declaration One", 5, 5)},
               {(None, "a.b.C", "imports"), ("Store", "Base", "extends"), ("Store", "Walk", "extends"), ("keep", "help", "calls"), ("go", "x", "calls"), ("Store", "Base", "calls")}),
    "swift": ("import Foundation\nclass Store: Base, Walk {\n  init(x: Int) { load(x) }\n  func keep(_ a: String) -> Int { return self.help(a) }\n}\nprotocol Walk { }\n",
              {("Class", "Store", None, 2, 5), ("Method", "init", "class_declaration Store", 3, 3), ("Function", "keep", "class_declaration Store", 4, 4), ("Interface", "Walk", None, 6, 6)},
              {(None, "Foundation", "imports"), ("Store", "Base", "extends"), ("Store", "Walk", "extends"), ("init", "load", "calls"), ("keep", "help", "calls")}),
    "hcl": ('resource "aws_x" "main" {\n  a = "{"\n  tags { b = 1 }\n}\nlocals {\n  c = 1 # }\n}\n', {("Module", "resource.aws_x.main", None, 1, 4), ("Module", "locals", None, 5, 7)}, set()),
    "proto": ('message Ask {\n  string q = 1;\n}\nservice Say {\n  rpc Hear(Ask) returns (Ask);\n}\n', {("Struct", "Ask", None, 1, 3), ("Interface", "Say", None, 4, 6), ("Method", "Hear", None, 5, 5)}, set()),
    "sql": ("-- all;\nCREATE TABLE IF NOT EXISTS a.t (x int);\ncreate or replace view v as\nselect ';' as y;\n", {("Struct", "a.t", None, 2, 2), ("TypeAlias", "v", None, 3, 4)}, set()),
    "css": ('@import url("base.css");\n.a, .b { margin: 0; }\n@media print {\n  p { color: red; }\n}\n', {("Rule", ".a, .b", None, 2, 2), ("Module", "@media", None, 3, 5), ("Rule", "p", None, 4, 4)}, {(None, "base.css", "imports")}),
    "html": ('<a href="x.html">q</a><a href="#y"></a>\n<script src="s.js">\nf();\n</script>\n<style>\np {}\n</style>\n', {("Function", "s.js", None, 2, 4), ("Module", "style", None, 5, 7)}, {(None, "x.html", "imports"), (None, "s.js", "imports")}),
}


@pytest.mark.parametrize("language", SOURCES)
def test_chunks(language):
    text, want, _ = SOURCES[language]
    got = {c[:5] for c in S.chunk_source(text, language)}
    assert got == want, (got - want, want - got)


@pytest.mark.parametrize("language", SOURCES)
def test_edges(language):
    text, _, want = SOURCES[language]
    got = {e[:3] for e in S.source_edges(text, language)}
    assert got == want, (got - want, want - got)


def test_oversized_containers_give_way_to_their_members_and_others_are_windowed():
    body = "\n".join(f"        x{i} = compute({i})" for i in range(60))
    text = "class Big:\n" + "\n".join(f"    # number {k}\n    def m{k}(self):\n{body}\n" for k in range(3)) + "\ndef small():\n    pass\n"
    got = S.chunk_source(text, "python")
    assert {(k, n, p) for k, n, p, *_ in got} == {("Function", f"m{k}", "class_definition Big") for k in range(3)} | {("Function", "small", None)}
    assert [d for *_, d in got] == ["# number 0", "# number 1", "# number 2", None]
    cut = S.chunk_source(text, "python", cap_tokens=100)
    assert {(k, n) for k, n, *_ in cut} == {("Verbatim", f"m{k}") for k in range(3)} | {("Function", "small")}
    assert max(len(c[5]) for c in cut) <= 400 + 40


def test_docstrings_of_the_line_before():
    text = "// about\n// it\n#[test]\nfn a() { }\n\nlet x = 1; // not this\nfn b() { }\n"
    assert [c[6] for c in S.chunk_source(text, "rust")] == ["// about\n// it", None]


@pytest.mark.parametrize("language", [*SOURCES, "json", "", "unknown"])
def test_any_text_is_read(language):
    for text in ("", "{", "}}}}", "def", "class", '"unclosed {', "/* open", "<!-- ", '"""', "\0\n\r\n", "def f(:\n  x", "fn (", "@" * 50, SOURCES["java"][0][:77]):
        S.chunk_source(text, language), S.source_edges(text, language)
    assert S.chunk_source("a\nb", "json") == [("Verbatim", None, None, 1, 2, "a\nb", None)]


def test_tables(spark):
    files = spark.createDataFrame([(1, "a.py", "python", "import os\n\ndef f():\n    g()\n"), (2, "b.rs", "rust", None), (3, "c", None, "x"), (4, "d.py", "python", "import os, re\nfrom x import y\n")], "file_id long, path string, language string, text string")
    assert sorted((r.file_id, r.kind, r.name) for r in S.file_chunks(files).collect()) == [(1, "Function", "f"), (3, "Verbatim", None), (4, "Verbatim", None)]
    assert {tuple(r) for r in S.file_edges(files).where("source_file = 'a.py'").collect()} == {("a.py", "f", "g", "calls", 4), ("a.py", None, "os", "imports", 1)}
    assert {(r.path, r.found) for r in S.pattern_edges(files, "imports").collect()} == {("a.py", "os"), ("d.py", "os, re"), ("d.py", "x")}
    assert S.file_edges(files.limit(0)).count() == 0
