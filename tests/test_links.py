"""Links read from text, and the parts of an exploration, on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skein.operators import explore, links
from skein.sources.paths import is_test
from skein.streaming import watch

NODE = "id string, kind string, name string, file_path string, language string, start_line int"


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_includes_prefer_modules(spark):
    files = spark.createDataFrame([("a/urls.py", "include('b.urls')\ninclude( 'c.urls')\ninclude(\"b.urls\")\ninclude('a.urls')"), ("x.js", "include('b.urls')"), ("n.py", None)], "path string, content string")
    nodes = spark.createDataFrame([(p, "file", "f", p, "python", 1) for p in ("a/urls.py", "b/urls.py", "b/urls/__init__.py", "c/urls.py", "x.js", "n.py")], NODE)
    assert pairs(links.python_includes(files, nodes), "source", "target", "line") == [("a/urls.py", "b/urls.py", 1)]
    assert links.python_includes(files.limit(0), nodes).isEmpty()


def test_calls_of_test_files(spark):
    files = spark.createDataFrame([("tests/a.js", "go (1)\r\n# go()\nif (x) { o.go(); go() }"), ("tests/b.js", "go()"), ("src/c.js", "go()")], "path string, content string")
    nodes = spark.createDataFrame([("f1", "file", "a", "tests/a.js", "js", 1), ("f2", "file", "b", "tests/b.js", "js", 1), ("g2", "function", "go", "z.js", "js", 1), ("g1", "function", "go", "y.js", "js", 9), ("h", "function", "own", "tests/b.js", "js", 1)], NODE)
    assert pairs(links.test_file_calls(files, nodes, is_test), "source", "target", "line") == [("f1", "g1", 1), ("f1", "g1", 3)]


def test_gin_handlers_outside_comments(spark):
    text = 'r.Use(Log(a), // r.Use(No1)\n  mid.Auth)\n/* r.GET("/x", No2) */ r.GET("http://x", func() { f() }, Show)'
    files = spark.createDataFrame([("a.go", text), ("b.py", "r.Use(No3)")], "path string, content string")
    assert pairs(links.gin_registered(files), "name") == [("Auth",), ("Log",), ("Show",)]
    nodes = spark.createDataFrame([(n, "function", n, "h.go", "go", 1) for n in ("Auth", "Log", "No1")] + [("d", "method", "Context.Next", "g.go", "go", 5), ("e", "method", "Next", "g.go", "go", 6)], NODE)
    bodies = spark.createDataFrame([("d", "c.handlers[i](c)"), ("e", "c.handlers[i](c)")], "id string, body string")
    assert pairs(links.gin_chain(bodies, files, nodes), "source", "target") == [("d", "Auth"), ("d", "Log")]
    assert pairs(links.gin_chain(bodies, files, nodes, 1), "source", "target") == [("d", "Auth")]


def test_text_callers_stay_in_their_application(spark):
    bodies = spark.createDataFrame([("a", "apps/web/a.ts", "pay(1)"), ("b", "apps/shop/b.ts", "pay(1)"), ("c", "apps/web/c.ts", "repay(1); pay"), ("d", "apps/web/d.ts", None)], "id string, file_path string, body string")
    targets = spark.createDataFrame([("t", "pay", "apps/web/p.ts"), ("a", "pay", "apps/web/a.ts")], "id string, name string, file_path string")
    assert pairs(links.text_callers(bodies, targets), "source", "target") == [("a", "t")]


@pytest.mark.parametrize(("importer", "module"), [("web/n3/a.ts", "./base"), ("web/n4/a.ts", "../n3/base"), ("web/a.ts", "./n3/base"), ("a.ts", "./web/n3/base"), ("lib/x/y/a.ts", "../../../web/n3/base")])
def test_relative_modules(spark, importer, module):
    assert spark.createDataFrame([(importer,)], "p string").select(links.relative_module(F.col("p"), "web/n3/base")).first()[0] == module


def test_text_dependents(spark):
    rows = [("web/n3/a.ts", "import './base'"), ("web/n3/b.ts", "import './base2'"), ("x.ts", 'require("web/n3/base")'), ("y.ts", "'base'"), ("web/n3/base.ts", "'base'"), ("z.ts", None)]
    files = spark.createDataFrame(rows, "path string, content string")
    assert pairs(links.text_dependents(files, "./web/n3/base.ts"), "path") == [("web/n3/a.ts",), ("x.ts",), ("y.ts",)]


def test_project_tokens(spark):
    files = spark.createDataFrame([("go.mod", "// x\nmodule example.org/team/fast-store v2\n"), ("package.json", '{"name": "@team/web_Client"}'), ("a/package.json", '{"name": "other-name"}')], "path string, content string")
    assert explore.project_tokens(files, "My Tree") == {"faststore", "webclient", "mytree"}
    broken = spark.createDataFrame([("package.json", "{")], "path string, content string")
    assert explore.project_tokens(broken, "tree") == set()


def test_budgets():
    assert [explore.output_budget(n).max_output_chars for n in (0, 149, 150, 499, 500, 4_999, 5_000)] == [13_000, 13_000, 18_000, 18_000, 24_000, 24_000, 24_000]
    assert explore.output_budget(10**6).gap == 15 and explore.output_budget(149).without_low_value
    assert [watch.most_wait(2_000), watch.most_wait(20_000), watch.most_wait(2_000, 500), watch.most_wait(2_000, 90_000)] == [10_000, 60_000, 2_000, 60_000]


def test_file_view():
    assert explore.file_view("a\nb\nc", 2) == "2\tb\n3\tc"
    assert explore.file_view("a\nb\nc", 1, 1) == "1\ta" and explore.file_view("a", 5) == ""


def test_inner_and_compound_names(spark):
    rows = [("1", "class", "DataTask", "a.ts", "ts", 1), ("2", "class", "TaskData", "a.ts", "ts", 2), ("3", "class", "Task", "a.ts", "ts", 3), ("4", "class", "MyDataTask", "tests/a.ts", "ts", 4), ("5", "method", "DataTask", "a.ts", "ts", 5)]
    nodes = spark.createDataFrame(rows, NODE)
    assert pairs(explore.inner_matches(nodes, ["task"], "zz", 10), "id", "score") == [("1", 13.0 * 2)]
    assert pairs(explore.inner_matches(nodes, [], "zz", 10), "id") == []
    assert pairs(explore.compound_matches(nodes, ["task", "data"], "zz", 10), "id", "score") == [("1", 35.0), ("2", 35.0)]
    found = nodes.filter("id = '1'")
    assert pairs(explore.compound_matches(nodes, ["task", "data"], "zz", 10, found), "id") == [("2",)]
