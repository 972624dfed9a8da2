import json
import os
import subprocess

import pytest

from duplet import cli, render, report
from duplet.config import Config, ConfigError
from duplet.sources.git import GitError, Repo
from duplet.sources.registry import LANGUAGES, for_path
from duplet.sources.walk import WalkError, WalkOptions, _pattern, discover, read_tree
from duplet.syntax.provider import LexicalProvider, PythonProvider, UnsupportedLanguage, provider

TWINS = ["def {0}(rate, years, base):\n    result = base\n    for year in range(years):\n        result = result * (1 + rate)\n        if result > 1000:\n            result = result - 5\n    return result\n"]


def test_config():
    assert Config.parse("").function.min_similarity == 0.85
    assert Config.parse("excludes = ['x']\n[blocks]\nmin_tokens = 7").blocks.min_tokens == 7
    assert Config.parse("[report]\nmax_findings = 0").report.max_findings == 0
    for bad in ("oops = 1", "[function]\noops = 1", "[function]\nmin_similarity = 1.1", "[vocab]\nmin_overlap = nan", "[blocks]\nmin_tokens = 0", "x ="):
        with pytest.raises(ConfigError):
            Config.parse(bad)


def test_walk(tmp_path):
    for name in ("a/b.py", "a.b.py", "a/skip.py", ".hidden/x.py", "gen/y.py", "notes.txt", "big.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x" * (50 if name == "big.py" else 3))
    (tmp_path / ".gitignore").write_text("gen/\n/a/skip.py\n")
    found = lambda **k: [r for _, r in discover(WalkOptions((str(tmp_path),), **k))]
    assert found() == ["a/b.py", "a.b.py", "big.py"]
    assert found(max_bytes=3) == ["a/b.py", "a.b.py"] and found(excludes=("a/",)) == ["a.b.py", "big.py"]
    assert "gen/y.py" in found(honor_ignore=False)
    assert len(discover(WalkOptions((str(tmp_path), str(tmp_path / "a"))))) == 3  # a folder's own rules and those above it hold
    with pytest.raises(WalkError):
        discover(WalkOptions((str(tmp_path / "none"),)))
    os.symlink(tmp_path, tmp_path / "a" / "loop")
    assert found() == ["a/b.py", "a.b.py", "big.py"]
    with pytest.raises(WalkError):
        found(follow_links=True)


def test_bytes_that_are_not_text_fail(spark, tmp_path):
    (tmp_path / "x.py").write_bytes(b"\xff\xfe\xff")
    with pytest.raises(Exception, match="not UTF-8"):
        read_tree(spark, [(str(tmp_path / "x.py"), "x.py")]).collect()


@pytest.mark.parametrize(
    ("language", "code", "names"),
    [
        ("python", "class Circle:\n    def area(self):\n        return 3 * self.r\n\ndef add(a, b):\n    return a + b\n", ["Circle.area", "add"]),
        ("javascript", "class Circle { area() { return 3 * this.r; } }\nfunction add(a, b) { return a + b; }", ["Circle.area", "add"]),
        ("typescript", "class Circle { area(): number { return 3; } }\nfunction add(a: number) { return a; }", ["Circle.area", "add"]),
        ("java", "class Circle { int area(int r) { return 3 * r; } }", ["Circle.area"]),
        ("go", "func (c Circle) Area() int { return 3 * c.r }\nfunc add(a int) int { return a }", ["Area", "add"]),
        ("rust", "impl Circle { fn area(&self) -> i32 { 3 * self.r } }\nfn add(a: i32) -> i32 { a }", ["Circle.area", "add"]),
        ("ruby", "class Circle\n  def area\n    3 * @r\n  end\nend\ndef add(a)\n  a\nend\n", ["Circle.area", "add"]),
        ("php", "<?php class Circle { function area() { return 3; } }\nfunction add($a) { return $a; }", ["Circle.area", "add"]),
        ("csharp", "namespace N { class Circle { int Area() { return 3; } } }", ["N.Circle.Area"]),
        ("cpp", "class Circle { int area() { return 3; } };\nint add(int a) { return a; }", ["Circle.area()", "add(int a)"]),
        ("cpp", "class B { B(int a) : x(a) { y = 1; } int at(int i) const { return x; } };\nint* N::C<int>::go(int a) { return 0; }", ["B.B(int a)", "B.at(int i) const", "* N::C<int>::go(int a)"]),
        ("c", "int outer() { int inner() { return 1; } return inner(); }\nchar *name(struct s *x) { return x->n; }\nstruct s make(void) { return 1; }", ["outer()", "outer().inner()", "*name(struct s *x)", "make(void)"]),
        ("c", "int square(int n) { return n * n; }", ["square(int n)"]),
    ],
)
def test_units_have_qualified_names(language, code, names):
    got = provider(language).extract(code, language, 1)
    assert [u.qualname for u in got.units] == names and not got.had_syntax_errors


@pytest.mark.parametrize(
    ("language", "code", "units"),
    [
        ("javascript", "const f = x => x + 1\nconst g = async (a, b) => {\n  return a;\n};\nfoo(y => y * 2, 3);", [("f", 1, 1), ("g", 2, 4), ("<anonymous@5>", 5, 5)]),
        ("typescript", "const f = (a: number): number => a;\nlist.map(x => ({ y: x }));", [("f", 1, 1), ("<anonymous@2>", 2, 2)]),
        ("java", "class A {\n  void f() {\n    run(x -> x + 1, y);\n    go((a, b) -> {\n      use(a);\n    });\n  }\n}", [("A.f", 2, 7), ("A.f.<anonymous@3>", 3, 3), ("A.f.<anonymous@4>", 4, 6)]),
        ("java", "class A { Run f() { return new Run() { void go() { use(1); } }; } }", [("A.f", 1, 1), ("A.f.go", 1, 1)]),
        ("javascript", "function* gen() { yield 1; }\nrun(function (a) { return a; });", [("gen", 1, 1), ("<anonymous@2>", 2, 2)]),
        ("go", "func f() {\n  g := func(a int) int {\n    return a\n  }\n}", [("f", 1, 5), ("f.<anonymous@2>", 2, 4)]),
        ("java", "class A { int f(int k) { return switch (k) { case 1 -> 2; default -> 3; }; } }", [("A.f", 1, 1)]),
        ("csharp", "class A {\n  int Twice(int a) => a + a;\n  void F() {\n    Run(x => x + 1);\n  }\n}", [("A.Twice", 2, 2), ("A.F", 3, 5), ("A.F.<anonymous@4>", 4, 4)]),
        ("cpp", "int f() {\n  auto g = [&](int a) -> int {\n    return a;\n  };\n  int x[2] = {p->a, y[0]};\n  return g(1);\n}", [("f()", 1, 7), ("f().<anonymous@2>", 2, 4)]),
        ("rust", "fn f(v: Vec<i32>) -> i32 {\n  let g = |a, b| a + b;\n  let h = move || {\n    1\n  };\n  if v.ok || self.x || w | 1 { 2 } else { 3 }\n}\nfn m(o: O) { match o { A => { 1 } } }", [("f", 1, 7), ("f.<anonymous@2>", 2, 2), ("f.<anonymous@3>", 3, 5), ("m", 8, 8)]),
        ("rust", "impl<'a, T: Into<Vec<T>>> std::fmt::Display for Line<'a> { fn fmt(&self) { 'x'; } }\nimpl<'a> Page<'a> { fn of(s: &'static str) { 1 } }", [("Line.fmt", 1, 1), ("Page.of", 2, 2)]),
        ("php", "<?php function f($a) {\n  return array_map(fn($x) => $x + 1, ['k' => $a->b]);\n}\n$g = function ($y) { return $y; };", [("f", 1, 3), ("f.<anonymous@2>", 2, 2), ("<anonymous@4>", 4, 4)]),
        ("ruby", "def f(v)\n  v.map { |x| x + 1 }\n  h = { a: 1 }\n  while v do v.pop end\n  g = ->(a) {\n    a\n  }\nend\n", [("f", 1, 8), ("f.<anonymous@2>", 2, 2), ("f.<anonymous@5>", 5, 7), ("f.<anonymous@5>", 5, 7)]),
        ("c", "int helper(int a);\nint main(void) { for (int i = 0; i < 3; i++) { helper(i); } return 0; }", [("main(void)", 2, 2)]),
    ],
)
def test_functions_without_names_are_units(language, code, units):
    got = provider(language).extract(code, language, 1)
    assert [(u.qualname, u.start_line, u.end_line) for u in got.units] == units and not got.had_syntax_errors


def test_a_head_of_any_length_and_arrows_without_end():
    words = "\n".join(f"  int a{i}[{i}]," for i in range(400))
    assert [u.qualname for u in provider("java").extract(f"class K {{ void f(\n{words} int z) {{ return z; }} }}", "java", 1).units] == ["K.f"]
    chain = provider("javascript").extract("x => " * 3000 + "1", "javascript", 1).units
    assert len(chain) == 3000 and chain[0].tokens.count("=>") in (1, 3000)


@pytest.mark.parametrize(("language", "code"), [("javascript", "function {0}({1}, b) {{ return {1} {2} b; }}"), ("go", "func {0}({1} int, b int) int {{ return {1} {2} b }}"), ("rust", "fn {0}({1}: i32, b: i32) -> i32 {{ {1} {2} b }}"), ("python", "def {0}({1}, b):\n    return {1} {2} b\n"), ("java", "class K {{ int {0}(int {1}, int b) {{ return {1} {2} b; }} }}")])
def test_renaming_changes_nothing_and_an_operator_does(language, code):
    tokens = lambda *a: provider(language).extract(code.format(*a), language, 1).units[0].tokens
    assert tokens("add", "x", "+") == tokens("sum", "first", "+") != tokens("add", "x", "-")


def test_literals_are_abstracted_and_errors_are_told():
    assert PythonProvider().extract("def f():\n    return 0.05\n", "python", 1).units[0].tokens == PythonProvider().extract("def f():\n    return 3\n", "python", 1).units[0].tokens
    broken = PythonProvider().extract("def f(:\n    return 1\n", "python", 1)
    assert broken.had_syntax_errors and [u.qualname for u in broken.units] == ["f"]
    assert LexicalProvider().extract("function f( { ", "javascript", 1).had_syntax_errors
    with pytest.raises(UnsupportedLanguage):
        provider("cobol")


def test_languages():
    assert len(LANGUAGES) == 12 and for_path("x/A.PY").name == "python" and for_path("py") is None
    assert cli.listing()[0].startswith("c           c h")


def test_report_contract(tmp_path):
    empty = report.build_empty()
    assert report.loads(report.dumps(empty)) == empty
    for bad in ("{", "[]", json.dumps(empty | {"version": 2}), json.dumps({k: v for k, v in empty.items() if k != "blocks"}), json.dumps(empty | {"clones": [{"similarity": 1.0}]})):
        with pytest.raises(report.ReportError):
            report.loads(bad)
    with pytest.raises(report.ReportError, match="none.json"):
        report.read(tmp_path / "none.json")


def test_rendering():
    a = render.Annotation("a:b,c.py", "50% of\nit", 3, 4, "t:x")
    assert a.command() == "::warning file=a%3Ab%2Cc.py,line=3,endLine=4,title=t%3Ax::50%25 of%0Ait"
    page = render.Summary().heading(2, "H").bullet("one").bullet("two").table(["A", "B"], [["x|y", "z"]])
    assert page.render() == "## H\n\n- one\n- two\n| A | B |\n| --- | --- |\n| x\\|y | z |\n"
    assert render.percent(0.625) == "62%" and render.Summary().render() == ""
    assert "withheld" in render.summary({"clones": [], "vocab": [], "blocks": []}, 4).render()
    with pytest.raises(ValueError):
        page.heading(7, "x")


def git(where, *args):
    subprocess.run(["git", "-C", str(where), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)


def test_ci_reports_what_the_working_tree_adds(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "one.py").write_text(TWINS[0].format("total"))
    (tmp_path / "duplet.toml").write_text("[function]\nmin_nodes = 10\n[blocks]\nmin_tokens = 500\n")
    git(tmp_path, "init", "-q", "-b", "main")
    git(tmp_path, "add", ".")
    git(tmp_path, "commit", "-qm", "one")
    monkeypatch.chdir(tmp_path)
    assert cli.main(["ci", "--base", "main"]) == 0
    assert render.NOTHING in capsys.readouterr().out
    (tmp_path / "two.py").write_text(TWINS[0].format("compute").replace("rate", "pct"))
    out = tmp_path.parent / f"{tmp_path.name}-count"  # not in the tree, which is committed below
    assert cli.main(["ci", "--base", "main", "--github-annotations", "--findings-out", str(out)]) == 0
    said = capsys.readouterr().out
    assert "100%25 duplicate of `compute` at two.py:1-7" in said and out.read_text() == "1\n"
    repo = Repo.discover(tmp_path)
    git(tmp_path, "add", ".")
    git(tmp_path, "commit", "-qm", "two")
    assert repo.changed_files("HEAD~1") == ["two.py"]
    with pytest.raises(GitError):
        repo.resolve("nothing")
    assert cli.main(["diff", "--head", "none", "--base", "none"]) == 1


def test_streaming_finds_copies_across_batches(spark, tmp_path):
    from duplet.streaming.incremental import watch

    source = tmp_path / "in"
    for n, rows in enumerate(([("a", "x y z"), ("b", "x y z"), ("c", "one two three")], [("d", "one two three"), ("e", "new words here")])):
        spark.createDataFrame(rows, "path string, text string").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("path string, text string").parquet(str(source))
        watch(spark, stream, str(tmp_path / "known"), str(tmp_path / "out"), str(tmp_path / "check"), min_tokens=1).awaitTermination()
        del n
    assert {(r.path, r.first) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("b", "a"), ("d", "c")}


@pytest.mark.parametrize(("line", "path", "ignored"), [("/a?b", "a/b", False), ("/a?b", "axb", True), ("*.py", "d/x.py", True), ("a/**/b", "a/x/y/b", True), ("d/*.c", "d/e/f.c", False), ("x.c", "xzc", False), ("a*b*c", "a1b2c", True), ("a*b*c", "a/b2c", False), ("x[!a]y", "x/y", False)])
def test_ignore_patterns_keep_to_a_component(line, path, ignored):
    assert bool(_pattern(line)[0].match(path)) == ignored
