"""Search, resolution, extraction, routes, paths and streams on small inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skein.functions.extract import extract, extract_file, split
from skein.functions.routes import routes_in
from skein.operators import resolve, search
from skein.sources.files import scan
from skein.sources.paths import glob_rule, is_ignored, is_test, language
from skein.streaming import watch


def test_query_fields():
    q = search.parse('kind:class lang:go path:"a b" name:x foo bad:y kind:nothing')
    assert (q.kinds, q.languages, q.paths, q.names, q.text) == (["class"], ["go"], ["a b"], ["x"], "foo bad:y kind:nothing")


@pytest.mark.parametrize("path,want", [("src/a.test.ts", 1), ("test_x.py", 1), ("src/FooTest.java", 1), ("src/__tests__/x.js", 1), ("tests/a.py", 1), ("examples/a.py", 1), ("src/latest.ts", 0), ("src/contest/a.ts", 0), ("a_spec.rb", 1)])
def test_test_files(spark, path, want):
    assert spark.range(1).select(is_test(F.lit(path)).cast("int")).first()[0] == want


def test_ignore_rules(spark):
    paths = ["node_modules/a.js", "src/a.js", "a.egg-info/x.py", "logs/x.log", "keep/x.log", "build-x/y"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    out = {r[0] for r in df.filter(is_ignored(F.col("path"), ("*.log", "!keep/*.log"))).collect()}
    assert out == {"node_modules/a.js", "a.egg-info/x.py", "logs/x.log"}
    assert glob_rule("/a/*.c") == "^a/[^/]*\\.c(/|$)"


def test_languages(spark):
    df = spark.createDataFrame([("a.h", "@interface X"), ("b.h", "class A {"), ("c.h", "int x;"), ("d.RS", ""), ("e", "")], "path string, text string")
    assert [r[0] for r in df.select(language(F.col("path"), F.col("text"))).collect()] == ["objc", "cpp", "c", "rust", "unknown"]


def test_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "node_modules/b.py").write_text("x = 1\n")
    (tmp_path / "big.py").write_text("#" * 2_000_000)
    (tmp_path / "note.txt").write_text("no source")
    rows = scan(spark, str(tmp_path)).collect()
    assert [(r.path, r.language, r.content) for r in rows] == [("src/a.py", "python", "x = 1\n")]


SOURCES = {
    "typescript": ("export class Foo extends Bar implements Baz {\n  run(a: number): string { return help(a); }\n}\n", [("class", "Foo"), ("method", "Foo::run")], [("extends", "Bar"), ("implements", "Baz"), ("returns", "string"), ("calls", "help")]),
    "python": ("class A(B):\n    def f(self) -> C:\n        return g()\n", [("class", "A"), ("method", "A::f")], [("extends", "B"), ("returns", "C"), ("calls", "g")]),
    "go": ("package a\ntype S struct {\n}\nfunc (s *S) Run() { help() }\n", [("struct", "S"), ("method", "S::Run")], [("calls", "help")]),
    "rust": ("struct P;\nimpl Show for P {\n  fn show(&self) { go() }\n}\n", [("struct", "P"), ("method", "P::show")], [("implements", "Show"), ("calls", "go")]),
    "java": ("class J extends K implements L {\n  int run() { return go(); }\n}\n", [("class", "J"), ("method", "J::run")], [("extends", "K"), ("implements", "L"), ("returns", "int"), ("calls", "go")]),
    "ruby": ("class A < B\n  def run\n    help(1)\n  end\nend\n", [("class", "A"), ("method", "A::run")], [("extends", "B"), ("calls", "help")]),
    "csharp": ("namespace N {\n  class A : B {\n    public int Run() { return Go(); }\n  }\n}\n", [("namespace", "N"), ("class", "N::A"), ("method", "N::A::Run")], [("extends", "B"), ("returns", "int"), ("calls", "Go")]),
    "php": ("<?php\nclass A extends B {\n  public function run() { help(); }\n}\n", [("class", "A"), ("method", "A::run")], [("extends", "B"), ("calls", "help")]),
    "kotlin": ("class A : B() {\n  fun run() { help() }\n}\n", [("class", "A"), ("method", "A::run")], [("extends", "B"), ("calls", "help")]),
    "swift": ("class A: B {\n  func run() { help() }\n}\n", [("class", "A"), ("method", "A::run")], [("extends", "B"), ("calls", "help")]),
    "c": ("int run(int x) {\n  return go(x);\n}\n", [("function", "run")], [("calls", "go")]),
    "lua": ("function M.run(x)\n  help(x)\nend\n", [("method", "M::run")], [("calls", "help")]),
}


@pytest.mark.parametrize("lang", SOURCES)
def test_extractors(lang):
    text, nodes, refs = SOURCES[lang]
    out = extract_file("f", lang, text)
    assert [(r["kind"], r["qualified_name"]) for r in out if r["row"] == "node"][1:] == nodes
    assert sorted((r["reference_kind"], r["reference_name"]) for r in out if r["row"] == "ref") == sorted(refs)


def test_comments_and_strings_hold_no_code():
    out = extract_file("f.ts", "typescript", "// class A {}\n/* class B {\n} */\nconst s = \"class C {\";\nfunction d() {}\n")
    assert [r["name"] for r in out if r["row"] == "node"] == ["f.ts", "s", "d"]


def test_broken_python_falls_back(spark):
    out = extract_file("f.py", "python", "def f(:\n  pass\ndef g():\n  f()\n")
    assert [r["name"] for r in out if r["row"] == "node"] == ["f.py", "f", "g"]


@pytest.mark.parametrize("lang,one", [("typescript", "function f%d() { g%d(); }\n\n"), ("python", "def f%d():\n    g%d()\n"), ("rust", "fn f%d() { g%d(); } // " + "x" * 50 + "\n")])
def test_large_files_take_line_rules(lang, one):
    text = "".join(one % (i, i) for i in range(3000))
    assert text.count("\n") >= 6000 or len(text) > 128 * 1024
    out = extract_file("f", lang, text)
    assert [r["name"] for r in out if r["row"] == "node"] == ["f", *(f"f{i}" for i in range(3000))]
    assert [r["target"] for r in out if r["row"] == "edge"] == [r["id"] for r in out if r["row"] == "node"][1:]
    assert [r["reference_name"] for r in out if r["row"] == "ref"] == [f"g{i}" for i in range(3000)]


def test_extract_and_resolve(spark):
    files = spark.createDataFrame([("a.py", "python", "def helper():\n    pass\n"), ("b.py", "python", "def main():\n    helper()\n    missing()\n"), ("c.txt", "unknown", None)], "path string, language string, content string")
    nodes, edges, refs = split(extract(files))
    assert nodes.count() == 5 and edges.count() == 2
    found = resolve.resolve(refs, nodes)
    made = resolve.to_edges(found, refs, nodes).collect()
    assert [(r.kind, r.metadata["resolvedBy"]) for r in made] == [("calls", "exact-match")]


ROUTES = [
    ("javascript", "app.get('/x', auth, show);\n", [("GET /x", "show")]),
    ("go", 'r.POST("/x", h.Create)\n', [("POST /x", "Create")]),
    ("python", "@app.route('/x', methods=['POST'])\ndef make():\n    pass\n", [("POST /x", "make")]),
    ("python", "@app.get('/y')\nasync def y():\n    pass\n", [("GET /y", "y")]),
    ("python", "path('z/', views.Show.as_view())\n", [("ANY z/", "Show")]),
    ("php", "Route::get('/x', [UserController::class, 'index']);\n", [("GET /x", "UserController@index")]),
    ("ruby", "resources :users, only: [:index]\n", [("GET /users", "users#index")]),
    ("java", '@GetMapping("/x")\npublic String show() {\n', [("GET /x", "show")]),
    ("rust", '.route("/x", get(show))\n', [("GET /x", "show")]),
    ("csharp", '[HttpGet("x")]\npublic int Show() {\n', [("GET x", "Show")]),
]


@pytest.mark.parametrize("lang,text,want", ROUTES)
def test_routes(lang, text, want):
    assert [(r["name"], r["handler"]) for r in routes_in("f", lang, text)] == want


def test_candidates_of_the_wrong_language_do_not_resolve(spark):
    refs = spark.createDataFrame([(1, "x", "f", "calls", 1, "a.ts", "typescript")], "ref_id long, from_node_id string, reference_name string, reference_kind string, line int, file_path string, language string")
    nodes = spark.createDataFrame([(f"n{i}", "struct", "f", "f", f"z{i}/b.go", "go", 1, False) for i in range(2)], "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, is_exported boolean")
    assert resolve.exact(refs, nodes).count() == 0


def test_bursts_with_a_cap(spark):
    rows = [("f", f"2024-01-01 00:00:{s:02d}") for s in range(25)] + [("g", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "path string, t string").select("path", F.to_timestamp("t").alias("ts"))
    assert sorted((r.path, r.n) for r in watch.bursts(df).collect()) == [("f", 25), ("g", 1)]
    assert sorted((r.path, r.n) for r in watch.capped_bursts(df, 2, 10).collect()) == [("f", 5), ("f", 10), ("f", 10), ("g", 1)]


def test_stream_of_changes(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", "2024-01-01 00:00:00", "m"), ("a", "2024-01-01 00:00:05", "m"), ("b", "2024-01-01 00:00:01", "m")], "path string, t string, kind string").select("path", F.to_timestamp("t").alias("ts"), "kind").write.parquet(src)
    got = []
    q = watch.run_sync(watch.read_changes(spark, src), lambda batch, n: got.extend((r.path, r.n) for r in batch.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(got) == [("a", 2), ("b", 1)]


def test_sync_equals_a_rebuild(spark):
    def index(files):
        nodes, edges, refs = split(extract(files))
        return nodes, edges

    def table(contents):
        rows = [(p, "python", c) for p, c in contents.items()]
        return spark.createDataFrame(rows, "path string, language string, content string").withColumn("content_hash", F.sha2("content", 256))

    old, new = table({"a.py": "def f(): pass\n", "b.py": "x = 1\n", "c.py": "y = 1\n"}), table({"a.py": "def g(): pass\n", "b.py": "x = 1\n", "d.py": "z = 1\n"})
    n, e = index(old)
    nodes, edges, files = watch.sync((n, e, old), new, index)
    want_n, want_e = index(new)
    key = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    assert key(nodes, "id") == key(want_n, "id") and key(edges, "source", "target") == key(want_e, "source", "target") and key(files, "path") == key(new, "path")
