"""The facade: one object over an index, with the operations that users and tools call.

Operations return DataFrames; those that render text collect what their limits bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.builtins import without_builtins
from skein.functions.extract import extract, split
from skein.functions.routes import routes
from skein.graphview import Graph
from skein.model import HIERARCHY_EDGES, ContextOptions
from skein.operators import context, imports, mutate, resolve, search, stats, structure, traversal
from skein.scratch import cut
from skein.sources import files as sources
from skein.sources.paths import is_test


class CodeIndex:
    """nodes, edges and files of a source tree."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, files: DataFrame):
        self.graph, self.files = Graph(nodes, edges), files

    @classmethod
    def index(cls, spark: SparkSession, root: str, ignore: tuple[str, ...] = ()) -> CodeIndex:
        """Scan, extract, resolve: the graph of the files under root."""
        return cls.from_files(cut(sources.scan(spark, root, ignore), "files"))

    @classmethod
    def from_files(cls, files: DataFrame) -> CodeIndex:
        """files: path, language, content, content_hash."""
        rows = cut(extract(files), "extracted")
        nodes, contains, refs = split(rows)
        nodes = mutate.first_wins(nodes, ["id"], "start_line", "file_path")
        found = routes(files)
        more = found.select(
            "id", F.lit("route").alias("kind"), "name", F.col("name").alias("qualified_name"), "file_path", F.lit("unknown").alias("language"), F.col("line").alias("start_line"),
            F.col("line").alias("end_line"), F.lit(None).cast("string").alias("signature"), F.lit(None).cast("string").alias("docstring"), F.lit(True).alias("is_exported"),
        )
        handled = found.filter("handler <> ''").join(files.select(F.col("path").alias("file_path"), "language"), "file_path").select(
            F.xxhash64("id", "handler").alias("ref_id"), F.col("id").alias("from_node_id"), F.regexp_extract("handler", r"([\w$]+)$", 1).alias("reference_name"),
            F.col("handler_kind").alias("reference_kind"), "line", "file_path", "language",
        )
        nodes = cut(nodes.unionByName(more.dropDuplicates(["id"])), "nodes")
        refs = cut(refs.unionByName(handled.dropDuplicates(["ref_id"])), "refs")
        bound = cut(imports.bound(files), "imports")
        bound = imports.resolve_paths(bound, files).filter("resolved_path IS NOT NULL")
        inherits = refs.filter(F.col("reference_kind").isin(*HIERARCHY_EDGES)).join(nodes.select(F.col("id").alias("from_node_id"), "name"), "from_node_id")
        supertypes = inherits.select(F.col("name").alias("sub"), resolve.last_segment(F.col("reference_name")).alias("super")).distinct()
        found = resolve.resolve(without_builtins(refs, nodes), nodes, imports=bound, supertypes=supertypes)
        linked = resolve.to_edges(found, refs, nodes).select("source", "target", "kind", "line")
        edges = cut(mutate.attached(contains.unionByName(linked).dropDuplicates(), nodes), "edges")
        return cls(nodes, edges, files)

    def search(self, query: str, limit: int = 20) -> DataFrame:
        return search.search(self.graph.nodes, query, max(1, min(limit, 100)), self.graph.index)

    def find(self, name: str) -> DataFrame:
        """Definitions of a name: exact, or of a qualified name by its end."""
        n = self.graph.nodes
        exact = n.filter((F.col("name") == name) | (F.col("qualified_name") == name))
        return exact if not exact.isEmpty() else n.filter(F.lower("name") == name.lower())

    def _ids(self, name: str, file_hint: str | None = None) -> list[str]:
        found = self.find(name)
        if file_hint:
            found = found.filter(F.col("file_path").contains(file_hint))
        return [r.id for r in found.select("id").orderBy("id").limit(50).collect()]  # overloads of one name

    def _each(self, operation, name: str, file_hint: str | None, *args) -> DataFrame:
        out = None
        for i in self._ids(name, file_hint):
            part = operation(self.graph, i, *args).select("id").distinct().withColumn("of", F.lit(i))
            out = part if out is None else out.unionByName(part)
        if out is None:
            return self.graph.nodes.limit(0).withColumn("of", F.lit(""))
        return out.join(self.graph.nodes, "id")

    def callers(self, name: str, depth: int = 1, file_hint: str | None = None) -> DataFrame:
        return self._each(traversal.callers, name, file_hint, depth)

    def callees(self, name: str, depth: int = 1, file_hint: str | None = None) -> DataFrame:
        return self._each(traversal.callees, name, file_hint, depth)

    def impact(self, name: str, depth: int = 3, file_hint: str | None = None) -> DataFrame:
        return self._each(traversal.impact, name, file_hint, depth)

    def path(self, start: str, end: str, kinds: Sequence[str] = ()) -> DataFrame:
        a, b = self._ids(start)[:1], self._ids(end)[:1]
        return traversal.shortest_path(self.graph, a[0] if a else start, b[0] if b else end, kinds)

    def affected(self, changed: Sequence[str], depth: int = 5) -> DataFrame:
        paths = [p.replace("\\", "/").removeprefix("./") for p in changed]
        return traversal.affected_files(self.graph, self.graph.spark.createDataFrame([(p,) for p in paths], "file_path string"), depth, is_test)

    def node(self, name: str) -> DataFrame:
        """(section, id, edge_kind) around each definition of a name."""
        out = None
        for i in self._ids(name):
            part = structure.context(self.graph, i).withColumn("of", F.lit(i))
            out = part if out is None else out.unionByName(part)
        return out

    def explore(self, question: str, form: str = "markdown", options: ContextOptions = ContextOptions()) -> str:
        roots = cut(context.relevant(self.graph, question, options), "roots")
        nodes, edges = context.subgraph(self.graph, roots, options)
        n = [r.asDict() for r in nodes.orderBy(F.desc("is_root"), "file_path", "start_line", "id").collect()]  # at most twice max_nodes
        e = [r.asDict() for r in edges.orderBy("source", "kind", "target").limit(200).collect()]
        if form == "tree":
            return context.to_tree(n, e, [x["id"] for x in n if x["is_root"]])
        return (context.to_json if form == "json" else context.to_markdown)(question, n, e)

    def dead_code(self) -> DataFrame:
        return structure.dead_code(self.graph)

    def cycles(self, length: int | None = None) -> DataFrame:
        """(id, component): files on cycles of any length. With length: (cycle, length), the simple cycles up to it."""
        files = structure.file_graph(self.graph)
        return traversal.cyclic_groups(files) if length is None else traversal.simple_cycles(files, length)

    def status(self) -> DataFrame:
        return stats.status_counts(self.graph, self.files)

    def list_files(self, prefix: str = "", glob: str | None = None) -> DataFrame:
        f = self.files.filter(F.col("path").startswith(prefix))
        f = f.filter(F.col("path").rlike(structure.glob_regex(glob))) if glob else f
        return f.groupBy("language").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("path")).alias("paths")).orderBy(F.desc("n"), "language")
