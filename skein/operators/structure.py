"""Structure queries over nodes and edges that need no iteration."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.graphview import Graph

DEAD_KINDS = ("function", "method", "class")
GLOB_KINDS = ("function", "method", "class", "interface", "struct", "module", "namespace")


def usages(g: Graph, target: str) -> DataFrame:
    """Every incoming edge with its source."""
    e = g.edges.filter(F.col("target") == target).select(F.col("source").alias("id"), F.col("kind").alias("edge_kind"), "line")
    return e.join(g.nodes.select("id", "name", "kind", "file_path"), "id")


def children(g: Graph, parent: str) -> DataFrame:
    inner = g.edges.filter((F.col("source") == parent) & (F.col("kind") == "contains")).select(F.col("target").alias("id"))
    return g.nodes.join(inner, "id", "left_semi")


def context(g: Graph, focal: str) -> DataFrame:
    """(section, id, edge_kind): children, references in and out, types used, and who contains it."""
    e = g.edges
    parts = [
        e.filter((F.col("target") == focal) & (F.col("kind") == "contains")).select(F.lit("ancestor").alias("section"), F.col("source").alias("id"), F.col("kind").alias("edge_kind")),
        e.filter((F.col("source") == focal) & (F.col("kind") == "contains")).select(F.lit("child"), "target", "kind"),
        e.filter((F.col("target") == focal) & (F.col("kind") != "contains")).select(F.lit("incoming"), "source", "kind"),
        e.filter((F.col("source") == focal) & (F.col("kind") != "contains")).select(F.lit("outgoing"), "target", "kind"),
        e.filter((F.col("source") == focal) & F.col("kind").isin("type_of", "returns")).select(F.lit("type"), "target", "kind").distinct(),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _between_files(g: Graph) -> DataFrame:
    place = g.nodes.select("id", "file_path")
    e = g.edges.filter("kind <> 'contains'").select("source", "target")
    both = e.join(place.toDF("source", "from_file"), "source").join(place.toDF("target", "to_file"), "target")
    return both.filter("from_file <> to_file").select("from_file", "to_file")


def file_dependencies(g: Graph, file_path: str) -> DataFrame:
    return _between_files(g).filter(F.col("from_file") == file_path).select(F.col("to_file").alias("file_path")).distinct()


def file_dependents(g: Graph, file_path: str) -> DataFrame:
    return _between_files(g).filter(F.col("to_file") == file_path).select(F.col("from_file").alias("file_path")).distinct()


def file_graph(g: Graph) -> DataFrame:
    """(source, target, n): edges between files; the sums are partial before they move."""
    return _between_files(g).groupBy(F.col("from_file").alias("source"), F.col("to_file").alias("target")).agg(F.count("*").alias("n"))


def exported(g: Graph, file_path: str) -> DataFrame:
    return g.nodes.filter((F.col("file_path") == file_path) & F.col("is_exported"))


def glob_regex(pattern: str) -> str:
    """A glob of * and ? as an anchored regular expression."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


def by_qualified_glob(g: Graph, pattern: str, kinds: Sequence[str] = GLOB_KINDS) -> DataFrame:
    return g.nodes.filter(F.col("kind").isin(*kinds) & F.col("qualified_name").rlike(glob_regex(pattern)))


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def module_structure(g: Graph) -> DataFrame:
    """(directory, n_files, files): distinct files of each directory, in order."""
    paths = g.nodes.select("file_path").distinct().select(directory(F.col("file_path")).alias("directory"), "file_path")
    return paths.groupBy("directory").agg(F.count("*").alias("n_files"), F.array_join(F.array_sort(F.collect_list("file_path")), ",").alias("files"))


def node_metrics(g: Graph) -> DataFrame:
    """One row for each node: edges in and out, distinct calls made and received, children."""
    e = g.edges
    call = F.col("kind") == "calls"
    out = e.groupBy(F.col("source").alias("id")).agg(
        F.count("*").alias("outgoing"),
        F.count_distinct(F.when(call, F.struct("target", "line"))).alias("calls"),
        F.count_if(F.col("kind") == "contains").alias("children"),
    )
    into = e.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("incoming"), F.count_distinct(F.when(call, F.struct("source", "line"))).alias("callers"))
    both = g.nodes.select("id").join(out, "id", "left").join(into, "id", "left")
    return both.select("id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("incoming", "outgoing", "calls", "callers", "children")))


def dead_code(g: Graph, kinds: Sequence[str] = DEAD_KINDS) -> DataFrame:
    used = g.edges.filter("kind <> 'contains'").select(F.col("target").alias("id"))
    return g.nodes.filter(F.col("kind").isin(*kinds) & ~F.col("is_exported")).join(used, "id", "left_anti")


def filtered_subgraph(g: Graph, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes that satisfy keep, and the edges among them."""
    nodes = g.nodes.filter(keep)
    return nodes, induced(g.edges, nodes)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    return edges.join(ids, F.col("source") == F.col("id"), "left_semi").join(ids, F.col("target") == F.col("id"), "left_semi")


def blast_radius(g: Graph, targets: DataFrame, is_test) -> DataFrame:
    """(id, n_callers, n_files, n_tests) for each of targets(id): who depends on it, and which of these are tests."""
    e = g.edges.filter("kind NOT IN ('contains', 'imports', 'exports')").select(F.col("target").alias("id"), F.col("source").alias("by")).filter("id <> by")
    by = g.nodes.select(F.col("id").alias("by"), "file_path")
    met = e.join(targets, "id", "left_semi").join(by, "by")
    counts = met.groupBy("id").agg(
        F.count_distinct("by").alias("n_callers"), F.count_distinct("file_path").alias("n_files"), F.count_distinct(F.when(is_test(F.col("file_path")), F.col("file_path"))).alias("n_tests")
    )
    return targets.select("id").distinct().join(counts, "id", "left").select("id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_callers", "n_files", "n_tests")))


def enclosing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points(file_path, line) with the innermost of spans(file_path, id, start_line, end_line) around each:
    an equality on the file with a range inside it, and the latest start wins."""
    met = points.join(spans, "file_path").filter(F.col("line").between(F.col("start_line"), F.col("end_line")))
    return met.groupBy(*points.columns).agg(F.max_by("id", F.struct("start_line", "id")).alias("id"))
