"""An index of a small tree, end to end."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from skein.api import CodeIndex
from skein.operators import imports, terms

FILES = {
    "src/base.py": "class Base:\n    def run(self):\n        pass\n",
    "src/app.py": "from src.base import Base\n\nclass App(Base):\n    def run(self):\n        return start_engine()\n\ndef start_engine():\n    return stop_engine()\n\ndef stop_engine():\n    pass\n\ndef _unused():\n    pass\n",
    "tests/test_app.py": "def test_run():\n    start_engine()\n",
    "src/web.py": "@app.get('/engine')\ndef show_engine():\n    return start_engine()\n",
}


@pytest.fixture(scope="module")
def code(spark):
    rows = [(p, "python", t) for p, t in FILES.items()]
    return CodeIndex.from_files(spark.createDataFrame(rows, "path string, language string, content string").withColumn("content_hash", F.sha2("content", 256)))


def names(df):
    return sorted(r.name for r in df.collect())


def test_calls(code):
    assert names(code.callers("start_engine")) == ["run", "show_engine", "test_run"]
    assert names(code.callees("start_engine")) == ["stop_engine"]
    assert names(code.callers("stop_engine", 2)) == ["run", "show_engine", "start_engine", "test_run"]
    assert code.callers("nothing").count() == 0


def test_impact_and_affected(code):
    assert "test_run" in names(code.impact("stop_engine", 2))
    assert [r.file_path for r in code.affected(["./src/app.py"]).collect()] == ["tests/test_app.py"]


def test_routes_and_hierarchy(code):
    kinds = {(r.kind, r.n) for r in code.graph.edges.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert ("extends", 1) in kinds and ("references", 1) in kinds
    assert names(code.graph.nodes.filter("kind = 'route'")) == ["GET /engine"]


def test_dead_code(code):
    assert names(code.dead_code()) == ["_unused"]


def test_search(code):
    assert code.search("start_engine").first().name == "start_engine"
    assert names(code.search("kind:class"))[:2] == ["App", "Base"]
    assert code.search("strat_engine").first().name == "start_engine"


def test_explore(code):
    out = json.loads(code.explore("how does start_engine stop?", "json"))
    assert out["nodes"][0]["name"] and "src/app.py" in out["files"] and out["confidence"] == "high"
    assert "start_engine" in code.explore("start_engine") and "start_engine" in code.explore("start_engine", "tree")


def test_status_and_files(code):
    s = {(r.measure, r.name): r.n for r in code.status().collect()}
    assert s[("files", "")] == 4 and s[("nodes_by_kind", "file")] == 4
    assert code.list_files("src/", "*.py").first().n == 3
    assert [r.id for r in code.path("run", "stop_engine").collect()][-1].startswith("function:")


def test_terms():
    assert terms.stems("running") == ["runn", "runne", "run"] and terms.stems("queries") == ["query"] and terms.stems("class") == []
    assert terms.search_terms("How does parseHTTPRequest work", False) == ["parsehttprequest", "parse", "http", "request"]
    assert terms.term_groups(["run", "runner", "stop"]) == [["runner", "run"], ["stop"]]


def test_bindings():
    assert imports.bindings("import A, {b as c, d} from './x';\nimport * as E from \"y\";") == [("A", "default", "./x"), ("c", "b", "./x"), ("d", "d", "./x"), ("E", "*", "y")]
    assert imports.bindings("from a.b import c as d, e") == [("d", "c", "a.b"), ("e", "e", "a.b")]
    assert imports.reexports("export * from './a';\nexport {x as y} from './b'") == [("*", "*", "./a"), ("x", "y", "./b")]


def test_import_paths(spark):
    files = spark.createDataFrame([(p,) for p in ["src/a/b.ts", "src/c/index.ts", "pkg/m.py", "pkg/sub/n.py", "lib/z.js"]], "path string")
    asks = [(1, "src/a/x.ts", "typescript", "./b"), (2, "src/a/x.ts", "typescript", "../c"), (3, "pkg/sub/n.py", "python", "..m"), (4, "pkg/m.py", "python", "pkg.sub.n"), (5, "src/a/x.ts", "typescript", "@/a/b"), (6, "src/a/x.ts", "typescript", "react"), (7, "q.js", "javascript", "z")]
    out = imports.resolve_paths(spark.createDataFrame(asks, "import_id long, file_path string, language string, source string"), files, {"@/*": "src/*"})
    assert {r.import_id: r.resolved_path for r in out.collect()} == {1: "src/a/b.ts", 2: "src/c/index.ts", 3: "pkg/m.py", 4: "pkg/sub/n.py", 5: "src/a/b.ts", 6: None, 7: "lib/z.js"}


def test_exports(spark):
    nodes = spark.createDataFrame([("f", "function", "go", "b.ts", 1, True), ("g", "class", "Main", "c.ts", 1, True)], "id string, kind string, name string, file_path string, start_line int, is_exported boolean")
    again = spark.createDataFrame([("a.ts", "*", "*", "b.ts"), ("a.ts", "go", "start", "b.ts")], "path string, local string, exported string, to_path string")
    asks = spark.createDataFrame([(1, "a.ts", "go"), (2, "a.ts", "start"), (3, "c.ts", "default"), (4, "a.ts", "none")], "ref_id long, path string, name string")
    assert sorted(tuple(r) for r in imports.follow_exports(asks, nodes, again).collect()) == [(1, "f"), (2, "f"), (3, "g")]


def test_a_ring_of_five_files_is_a_cycle(spark):
    rows = [(f"r{i}.py", "python", f"def f{i}():\n    f{(i + 1) % 5}()\n") for i in range(5)]
    files = spark.createDataFrame(rows, "path string, language string, content string").withColumn("content_hash", F.sha2("content", 256))
    found = CodeIndex.from_files(files).cycles().collect()
    assert sorted(tuple(r) for r in found) == [(f"r{i}.py", "r0.py") for i in range(5)]


def test_builtins_and_imports(spark):
    files = {
        "src/a.py": "def helper():\n    pass\n\ndef print():\n    pass\n\ndef append():\n    pass\n",
        "src/b.py": "def helper():\n    pass\n",
        "src/deep/c.py": "from src.a import helper as aid\nfrom src.b import helper\n\ndef main(items):\n    print(1)\n    aid()\n    helper()\n",
        "web/ui.ts": "export function Panel() {\n  return 1\n}\nexport function log() {\n  return 2\n}\n",
        "web/app.ts": "import Panel from './ui'\nfunction start() {\n  console.log(1)\n  Panel()\n  useState(2)\n}\nfunction useState() {\n  return 0\n}\n",
    }
    rows = [(p, "python" if p.endswith("py") else "typescript", t) for p, t in files.items()]
    code = CodeIndex.from_files(spark.createDataFrame(rows, "path string, language string, content string").withColumn("content_hash", F.sha2("content", 256)))
    called = {(r.name, r.file_path) for name in ("main", "start") for r in code.callees(name).filter("kind <> 'file'").collect()}
    assert ("helper", "src/a.py") in called and ("helper", "src/b.py") in called and ("Panel", "web/ui.ts") in called
    assert not {n for n, _ in called} & {"print", "log", "useState"}


def test_builtin_rules(spark):
    from skein.functions.builtins import without_builtins

    refs = [("python", n) for n in ("print", "list.append", "queue.append", "rows.append", "append", "sort", "len2")] + [("go", "fmt.Println"), ("go", "mine.Println"), ("go", "len"), ("typescript", "console.log"), ("typescript", "Math.max"), ("typescript", "logger.log"), ("tsx", "useMemo"), ("cpp", "std::move"), ("java", "print")]
    nodes = spark.createDataFrame([("Queue",), ("append",)], "name string")
    out = without_builtins(spark.createDataFrame(refs, "language string, reference_name string"), nodes)
    assert {(r.language, r.reference_name) for r in out.collect()} == {("python", "queue.append"), ("python", "append"), ("python", "len2"), ("go", "mine.Println"), ("typescript", "logger.log"), ("java", "print")}
