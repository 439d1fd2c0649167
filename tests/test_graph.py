"""Hand-drawn graphs with drawn results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skein.graphview import Graph
from skein.operators import mutate, stats, structure, synth, traversal
from skein.sources.paths import is_test


def make(spark, edges, nodes=None):
    nodes = nodes or {}
    names = sorted({x for e in edges for x in e[:2]} | set(nodes))
    rows = [(n, nodes.get(n, ("function", "a.ts"))[0], n, n, nodes.get(n, ("function", "a.ts"))[1], "typescript", i, True) for i, n in enumerate(names)]
    n = spark.createDataFrame(rows, "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, is_exported boolean")
    e = spark.createDataFrame([(a, b, k, i) for i, (a, b, k) in enumerate(edges)], "source string, target string, kind string, line int")
    return Graph(n, e)


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


CHAIN = [("a", "b", "calls"), ("b", "c", "calls"), ("c", "d", "calls"), ("d", "e", "calls")]
DIAMOND = [("a", "b", "calls"), ("a", "c", "calls"), ("b", "d", "calls"), ("c", "d", "calls")]


@pytest.mark.parametrize("depth,want", [(1, ["b"]), (2, ["b", "c"]), (9, ["b", "c", "d", "e"])])
def test_callees_of_a_chain(spark, depth, want):
    g = make(spark, CHAIN)
    assert sorted(r.id for r in traversal.callees(g, "a", depth).collect()) == want


def test_callers_keep_parallel_edges_and_drop_self(spark):
    g = make(spark, [("a", "b", "calls"), ("a", "b", "calls"), ("b", "b", "calls"), ("c", "b", "contains")])
    assert [r.id for r in traversal.callers(g, "b").collect()] == ["a", "a"]


def test_bfs_directions_limits_and_kinds(spark):
    g = make(spark, [*DIAMOND, ("z", "a", "calls")], {"c": ("class", "b.ts")})
    assert pairs(traversal.bfs(g, "a", "both"), "id", "depth") == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("z", 1)]
    assert pairs(traversal.bfs(g, "a", node_kinds=("class",), include_start=False), "id") == [("c",)]
    assert traversal.bfs(g, "a", "both", limit=2).count() == 2


def test_least_depth_wins_whatever_the_order(spark):
    g = make(spark, [("a", "b", "calls"), ("b", "c", "calls"), ("c", "d", "calls"), ("a", "d", "calls")])
    assert ("d", 1) in pairs(traversal.bfs(g, "a"), "id", "depth")


def test_hierarchy_has_both_sides(spark):
    g = make(spark, [("sub", "base", "extends"), ("base", "root", "implements"), ("other", "base", "extends")])
    assert pairs(traversal.type_hierarchy(g, "base"), "id", "side") == [("other", "descendant"), ("root", "ancestor"), ("sub", "descendant")]


def test_impact_pulls_members_of_containers(spark):
    g = make(spark, [("C", "m", "contains"), ("x", "m", "calls"), ("y", "x", "calls")], {"C": ("class", "a.ts")})
    assert pairs(traversal.impact(g, "C", 1), "id", "depth") == [("C", 0), ("m", 0), ("x", 1)]
    assert pairs(traversal.impact(g, "m", 2), "id", "depth") == [("m", 0), ("x", 1), ("y", 2)]


def test_shortest_path(spark):
    g = make(spark, DIAMOND)
    assert pairs(traversal.shortest_path(g, "a", "d"), "step", "id") == [(0, "a"), (1, "b"), (2, "d")]
    assert traversal.shortest_path(g, "d", "a").count() == 0
    assert pairs(traversal.shortest_path(g, "a", "a"), "step", "id") == [(0, "a")]


def test_cycles(spark):
    g = make(spark, [("a", "a", "calls"), ("a", "b", "calls"), ("b", "a", "calls"), ("b", "c", "calls"), ("c", "a", "calls"), ("c", "t", "calls")])
    assert pairs(traversal.simple_cycles(g.edges, 3), "cycle") == [("a",), ("a>b",), ("a>b>c",)]
    assert traversal.simple_cycles(make(spark, CHAIN).edges, 4).count() == 0


def test_cycles_of_any_length(spark):
    ring = [(f"r{i}", f"r{(i + 1) % 5}", "calls") for i in range(5)]
    more = [("r2", "m", "calls"), ("m", "a", "calls"), ("a", "z", "calls"), ("z", "a", "calls"), ("z", "end", "calls"), ("self", "self", "calls"), ("r1", "r1", "calls"), ("in", "r4", "calls"), ("a", "o", "calls"), ("o", "p", "calls"), ("p", "o", "calls")]
    want = [("a", "a"), ("o", "o"), ("p", "o"), *((f"r{i}", "r0") for i in range(5)), ("self", "self"), ("z", "a")]
    assert pairs(traversal.cyclic_groups(make(spark, ring + more).edges), "id", "component") == sorted(want)
    assert traversal.cyclic_groups(make(spark, CHAIN).edges).count() == 0


def test_chains_and_affected(spark):
    g = make(spark, CHAIN, {"a": ("function", "tests/a_test.ts"), "e": ("function", "e.ts")})
    starts = spark.createDataFrame([("a",)], "id string")
    assert pairs(traversal.call_chains(traversal.arcs(g.edges), starts, 3, 4), "chain") == [("a>b>c",), ("a>b>c>d",)]
    changed = spark.createDataFrame([("e.ts",)], "file_path string")
    assert pairs(traversal.affected_files(g, changed, 5, is_test), "file_path") == [("tests/a_test.ts",)]


def test_empty_tables(spark):
    g = make(spark, [], {"a": ("function", "a.ts")})
    assert traversal.bfs(g, "a").count() == 1
    assert structure.dead_code(Graph(g.nodes.withColumn("is_exported", F.lit(False)), g.edges)).count() == 1
    assert stats.status_counts(g).filter("measure = 'edges'").first().n == 0


def test_metrics_and_dead_code(spark):
    g = make(spark, [("C", "m", "contains"), ("x", "m", "calls"), ("m", "m", "calls")], {"C": ("class", "a.ts")})
    m = {r.id: r for r in structure.node_metrics(g).collect()}
    assert (m["m"].incoming, m["m"].outgoing, m["m"].callers, m["C"].children) == (3, 1, 2, 1)
    hidden = Graph(g.nodes.withColumn("is_exported", F.lit(False)), g.edges)
    assert pairs(structure.dead_code(hidden), "id") == [("C",), ("x",)]


def test_stores(spark):
    g = make(spark, CHAIN)
    gone = spark.createDataFrame([("c",)], "id string")
    nodes, edges = mutate.without_nodes(g.nodes, g.edges, gone)
    assert nodes.count() == 4 and pairs(edges, "source", "target") == [("a", "b"), ("d", "e")]
    assert mutate.attached(g.edges, nodes).count() == 2
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, content_hash string")
    new = spark.createDataFrame([("b", "1"), ("c", "2"), ("d", "1")], "path string, content_hash string")
    assert pairs(mutate.changes(old, new), "path", "change") == [("a", "removed"), ("c", "modified"), ("d", "added")]


def test_invalid_nodes_are_dropped(spark):
    rows = [("a", "n", "", "f", 0), ("b", "", "q", "f", 5), (None, "n", "q", "f", 5)]
    n = mutate.valid_nodes(spark.createDataFrame(rows, "id string, name string, qualified_name string, file_path string, updated_at long"), 99).collect()
    assert [tuple(r) for r in n] == [("a", "n", "n", "f", 99)]


def test_overrides_and_division(spark):
    g = make(spark, [("Sub", "Base", "extends"), ("Base", "b1", "contains"), ("Sub", "s1", "contains")], {"Sub": ("class", "a"), "Base": ("class", "a"), "b1": ("method", "a"), "s1": ("method", "a")})
    named = Graph(g.nodes.withColumn("name", F.when(F.col("kind") == "method", "run").otherwise(F.col("name"))), g.edges)
    assert pairs(synth.overrides(named), "source", "target") == [("b1", "s1")]
    types = spark.createDataFrame([("T", "x"), ("T", "y"), ("U", "x")], "type string, method string")
    contract = spark.createDataFrame([("I", "x"), ("I", "y")], "contract string, method string")
    assert pairs(synth.structural_implements(types, contract), "source", "target") == [("T", "I")]


def test_busy_channels_are_skipped(spark):
    emits = spark.createDataFrame([("e", f"s{i}") for i in range(7)] + [("f", "s0")], "event string, source string")
    hears = spark.createDataFrame([("e", "t"), ("f", "t")], "event string, target string")
    assert pairs(synth.event_emitters(emits, hears), "source", "target") == [("s0", "t")]


def test_merge_keeps_the_first_pass(spark):
    p = lambda by: spark.createDataFrame([("a", "b", "calls", by)], "source string, target string, kind string, synthesized_by string")
    assert pairs(synth.merge(p("one"), p("two")), "synthesized_by") == [("one",)]


def test_enclosing_is_the_innermost(spark):
    points = spark.createDataFrame([("f", 5), ("f", 20)], "file_path string, line int")
    spans = spark.createDataFrame([("f", "outer", 1, 10), ("f", "inner", 4, 6)], "file_path string, id string, start_line int, end_line int")
    assert pairs(structure.enclosing(points, spans), "line", "id") == [(5, "inner")]
