"""The store's smaller tables, depth-first search, flows and output."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skein.graphview import Graph
from skein.operators import store, traversal


@pytest.fixture(scope="module")
def g(spark):
    names = "abcdefgh"
    nodes = spark.createDataFrame([(x, "file" if x == "h" else "function", x, f"m::{x}", f"src/{x}.ts", k, "sig {" if x == "b" else None) for k, x in enumerate(names)], "id string, kind string, name string, qualified_name string, file_path string, start_line int, signature string")
    edges = [("a", "c", "references"), ("a", "b", "calls"), ("a", "d", "contains"), ("b", "e", "calls"), ("e", "a", "calls"), ("d", "e", "calls"), ("c", "f", "calls"), ("a", "h", "calls"), ("h", "g", "calls"), ("a", "zz", "calls")]
    return Graph(nodes, spark.createDataFrame(edges, "source string, target string, kind string"))


def test_depth_first(g):
    walk = lambda **kv: [(r.id, r.depth, r.parent, r.edge_kind) for r in traversal.dfs(g, "a", **kv).orderBy("position").collect()]
    assert walk() == [("a", 0, None, None), ("d", 1, "a", "contains"), ("e", 2, "d", "calls"), ("b", 1, "a", "calls"), ("h", 1, "a", "calls"), ("g", 2, "h", "calls"), ("c", 1, "a", "references"), ("f", 2, "c", "calls")]
    assert [w[0] for w in walk(max_depth=1)] == ["a", "d", "b", "h", "c"]
    assert [w[0] for w in walk(limit=3)] == ["a", "d", "e"]
    assert [w[0] for w in walk(edge_kinds=("calls",), node_kinds=("function",))] == ["a", "b", "e"]
    assert [w[0] for w in walk(direction="incoming")] == ["a", "e", "b", "d"]


def test_deep_search_is_not_cut_off(spark):
    ring = spark.createDataFrame([(f"n{i:03}", f"n{(i + 1) % 40:03}", "calls") for i in range(40)], "source string, target string, kind string")
    found = traversal.closure(traversal.arcs(ring), spark.createDataFrame([("n000",)], "id string"))
    assert sorted((r.id, r.depth) for r in found.collect()) == [(f"n{i:03}", i) for i in range(40)]


def test_flows(g, spark):
    named = spark.createDataFrame([("a",), ("e",), ("g",)], "id string")
    assert sorted(map(tuple, traversal.static_flows(g, named).collect())) == [("a", "e", 2), ("a", "g", 2), ("e", "a", 1), ("e", "g", 3)]
    path = lambda a, b: [r.id for r in traversal.named_flow(g, a, b).orderBy("step").collect()]
    assert path("e", "f") == ["e", "a", "c", "f"] and path("a", "g") == []  # not through a file
    assert path("a", "a") == ["a"] and path("f", "a") == []


def test_store(g, spark):
    assert [r.id for r in store.nodes_of_kind(g.nodes, "file")] == ["h"]
    files = spark.createDataFrame([("src/a.ts", 5), ("src/b.ts", 9)], "path string, indexed_at long")
    assert store.last_indexed(files).first()[0] == 9 and store.last_indexed(files.limit(0)).first()[0] is None
    assert store.file_at(files, "src/b.ts").count() == 1
    assert [t.count() for t in store.cleared(g.nodes, g.edges, files)] == [0, 0, 0]
    meta = store.with_metadata(spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string"), spark.createDataFrame([("b", "3")], "key string, value string"))
    assert store.metadata_value(meta, "b").first()[0] == "3" and meta.count() == 2
    assert [r.id for r in store.nodes_of_file(g.nodes, "c.ts").collect()] == ["c"]
    assert [r.id for r in store.symbols(g.nodes, "M::B").collect()] == ["b"] and store.symbols(g.nodes, "src/").count() == 8
    assert [r.path for r in store.stale_notice(files.select("path"), ["src/b.ts", "x"]).collect()] == ["src/b.ts"]
    capped = store.non_production_capped(g.nodes, F.col("id") > "b", 10)
    assert sorted(r.id for r in capped.collect()) == list("abcde")


def test_edges_of_one_name(spark):
    nodes = spark.createDataFrame([("1", "function", "f", "a.ts", None), ("2", "function", "f", "a.ts", "f() {"), ("3", "class", "g", "a.ts", None)], "id string, kind string, qualified_name string, file_path string, signature string")
    edges = spark.createDataFrame([("3", "1", "calls", {"a": "1"}), ("3", "2", "calls", {"a": "2"}), ("3", "1", "references", {"a": "1"}), ("3", "1", "references", {"a": "2"}), ("3", "9", "calls", None)], "source string, target string, kind string, metadata map<string,string>")
    out = sorted((r.source, r.target, r.kind, str(r.metadata)) for r in store.distinct_by_name(edges, nodes).collect())
    assert out == [("3", "1", "references", "{'a': '1'}"), ("3", "1", "references", "{'a': '2'}"), ("3", "2", "calls", "{'a': '2'}"), ("3", "9", "calls", "None")]


def test_truncated():
    assert store.truncated("abc", 3) == "abc" and store.truncated("abc", 0) == ""
    assert store.truncated("ää", 3, "more") == "ä\n\nmore"
    assert store.truncated("x" * 90 + "\n" + "y" * 20, 100, "more") == "x" * 90 + "\n\nmore"
    assert store.truncated("x" * 10 + "\n" + "y" * 100, 100, "more") == "x" * 10 + "\n" + "y" * 89 + "\n\nmore"
