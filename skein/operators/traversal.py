"""Traversal: level-synchronous searches over the edge table.

Each level joins the frontier with the edges and drops what was seen; frontiers are written to scratch
tables, so plans stay flat however deep a search goes, and their size is known when Spark plans the
next join. A node's depth is its least distance, whatever the order of edges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.graphview import Graph
from skein.model import CALLER_EDGES, CONTAINERS, HIERARCHY_EDGES
from skein.operators.mutate import capped
from skein.scratch import cut

#: A search keeps what it has seen in at most so many tables, and then writes them as one.
TABLES = 8
FLOW_EDGES = ("calls", "references", "instantiates", "decorates", "overrides")
NO_FLOW = ("file", "import", "export", "parameter")


def arcs(edges: DataFrame, direction: str = "outgoing", kinds: Sequence[str] = ()) -> DataFrame:
    """(a, b): steps from a to b along, against, or both ways along edges of the given kinds."""
    e = edges.filter(F.col("kind").isin(*kinds)) if kinds else edges
    out = e.select(F.col("source").alias("a"), F.col("target").alias("b"))
    back = e.select(F.col("target").alias("a"), F.col("source").alias("b"))
    return {"outgoing": out, "incoming": back, "both": out.unionByName(back)}[direction]


def closure(steps: DataFrame, seeds: DataFrame, max_depth: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(id, depth) of all nodes within max_depth steps(a, b) of seeds(id). allowed(id) limits whom a
    search may enter and pass through; seeds are exempt."""
    seen = frontier = cut(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "frontier")
    depth, tables = 0, 1
    while max_depth is None or depth < max_depth:
        depth += 1
        near = frontier.join(steps, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct()
        if allowed is not None:
            near = near.join(allowed, "id", "left_semi")
        frontier = cut(near.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        seen, tables = seen.unionByName(frontier), tables + 1
        if tables == TABLES:
            seen, tables = cut(seen, "seen"), 1
    return seen


def one(g: Graph, *ids: str) -> DataFrame:
    return g.spark.createDataFrame([(i,) for i in ids], "id string")


def bfs(g: Graph, start: str, direction: str = "outgoing", edge_kinds: Sequence[str] = (), node_kinds: Sequence[str] = (), max_depth: int | None = None, limit: int = 1000, include_start: bool = True) -> DataFrame:
    """(id, depth), nearest first and cut at limit by (depth, id). node_kinds also blocks passing through."""
    allowed = g.nodes.filter(F.col("kind").isin(*node_kinds)).select("id") if node_kinds else None
    found = closure(arcs(g.edges, direction, edge_kinds), one(g, start), max_depth, allowed)
    found = found if include_start else found.filter("depth > 0")
    return found.orderBy("depth", "id").limit(limit)


def edge_priority(kind: Column) -> Column:
    """Structure first, then calls, then all else."""
    return F.when(kind == "contains", 0).when(kind == "calls", 1).otherwise(2)


def dfs(g: Graph, start: str, direction: str = "outgoing", edge_kinds: Sequence[str] = (), node_kinds: Sequence[str] = (), max_depth: int | None = None, limit: int = 1000) -> DataFrame:
    """(position, id, depth, parent, edge_kind): a depth-first search in pre-order, at most `limit` nodes.

    Neighbours are taken by (edge priority, id). An order of visits is one sequence by nature, so the
    driver walks; it holds what the limit bounds, and asks for the neighbours of all waiting nodes at once.
    """
    e = g.edges.filter(F.col("kind").isin(*edge_kinds)) if edge_kinds else g.edges
    out = e.select(F.col("source").alias("a"), F.col("target").alias("b"), "kind")
    back = e.select(F.col("target").alias("a"), F.col("source").alias("b"), "kind")
    steps = {"outgoing": out, "incoming": back, "both": out.unionByName(back)}[direction]
    nodes = g.nodes.filter(F.col("kind").isin(*node_kinds)) if node_kinds else g.nodes
    steps = steps.join(nodes.select(F.col("id").alias("b")), "b", "left_semi").groupBy("a", "b").agg(F.min(F.struct(edge_priority(F.col("kind")).alias("p"), "kind")).alias("e"))
    known: dict[str, list[tuple[str, str]]] = {}

    def neighbours(at: str, waiting: list[str]) -> list[tuple[str, str]]:
        if at not in known:
            asked = list(dict.fromkeys([at, *(w for w in reversed(waiting) if w not in known)]))[:limit]
            known.update((w, []) for w in asked)
            # visited ones may come first, and there are at most `limit` of them
            for r in capped(steps.join(one(g, *asked).toDF("a"), "a", "left_semi"), ["a"], 2 * limit, "e.p", "b").orderBy("a", "e.p", "b").collect():
                known[r.a].append((r.b, r.e.kind))
        return known[at]

    visits: list[tuple] = []
    visited: set[str] = set()
    stack = [(start, 0, None, None)]
    while stack and len(visits) < limit:
        at, depth, parent, kind = stack.pop()
        if at in visited:
            continue
        visited.add(at)
        visits.append((len(visits), at, depth, parent, kind))
        if max_depth is None or depth < max_depth:
            near = neighbours(at, [s[0] for s in stack])
            stack += [(b, depth + 1, at, k) for b, k in reversed(near) if b not in visited]
    return g.spark.createDataFrame(visits, "position int, id string, depth int, parent string, edge_kind string")


def static_flows(g: Graph, named: DataFrame, most: int = 6) -> DataFrame:
    """(seed, target, depth): which of named(id) reach another by at most so many calls."""
    steps = arcs(g.edges, "outgoing", ("calls",))
    seeds = named.select("id").distinct()
    seen = frontier = cut(seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth")), "flows")
    for depth in range(1, most + 1):
        near = frontier.join(steps, F.col("id") == F.col("a")).select("seed", F.col("b").alias("id")).distinct()
        frontier = cut(near.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("depth", F.lit(depth)), "flows")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.filter("seed <> id").join(seeds, "id", "left_semi").select("seed", F.col("id").alias("target"), "depth")


def named_flow(g: Graph, source: str, target: str, most: int = 8) -> DataFrame:
    """(step, id): how execution gets from one symbol to another, past files, imports, exports and parameters."""
    allowed = g.nodes.filter(~F.col("kind").isin(*NO_FLOW)).select("id")
    return shortest_path(g, source, target, FLOW_EDGES, most, allowed)


def callers(g: Graph, target: str, depth: int = 1, kinds: Sequence[str] = CALLER_EDGES) -> DataFrame:
    """Depth 1: one row for each edge (id, kind, line). Beyond: (id, depth) of the reverse closure."""
    if depth == 1:
        e = g.edges.filter((F.col("target") == target) & (F.col("source") != target) & F.col("kind").isin(*kinds))
        return e.select(F.col("source").alias("id"), "kind", "line")
    return closure(arcs(g.edges, "incoming", kinds), one(g, target), depth).filter("depth > 0")


def callees(g: Graph, source: str, depth: int = 1, kinds: Sequence[str] = CALLER_EDGES) -> DataFrame:
    if depth == 1:
        e = g.edges.filter((F.col("source") == source) & (F.col("target") != source) & F.col("kind").isin(*kinds))
        return e.select(F.col("target").alias("id"), "kind", "line")
    return closure(arcs(g.edges, "outgoing", kinds), one(g, source), depth).filter("depth > 0")


def call_graph(g: Graph, focal: str, depth: int = 2) -> DataFrame:
    """(id, side): callers and callees within depth, and the focal node."""
    parts = [one(g, focal).withColumn("side", F.lit("focal"))]
    for side, found in (("caller", callers), ("callee", callees)):
        parts.append(found(g, focal, depth).select("id").distinct().withColumn("side", F.lit(side)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def type_hierarchy(g: Graph, focal: str) -> DataFrame:
    """(id, side, depth): ancestors along extends and implements, and descendants against them."""
    sides = []
    for side, direction in (("ancestor", "outgoing"), ("descendant", "incoming")):
        found = closure(arcs(g.edges, direction, HIERARCHY_EDGES), one(g, focal)).filter("depth > 0")
        sides.append(found.select("id", F.lit(side).alias("side"), "depth"))
    return sides[0].unionByName(sides[1])


def impact(g: Graph, start: str, max_depth: int = 3) -> DataFrame:
    """(id, depth): what a change may reach. At each depth containers bring in what they hold, at no
    cost; then whatever points at the set, by any edge but contains, is one step further."""
    holds = arcs(g.edges, "outgoing", ("contains",))
    reaches = arcs(g.edges.filter("kind <> 'contains'"), "incoming")
    containers = g.nodes.filter(F.col("kind").isin(*CONTAINERS)).select("id")
    seen: DataFrame | None = None
    fresh = one(g, start)
    for depth in range(max_depth + 1):
        level = fresh.withColumn("depth", F.lit(depth))
        while True:  # to a fixpoint: containers inside containers
            level = cut(level, "impact")
            before = level if seen is None else seen.unionByName(level)
            inner = level.join(containers, "id", "left_semi").join(holds, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct()
            inner = cut(inner.join(before.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)), "impact")
            if inner.isEmpty():
                break
            level = level.unionByName(inner)
        seen = level if seen is None else seen.unionByName(level)
        if depth == max_depth:
            break
        fresh = level.join(reaches, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct()
        fresh = cut(fresh.join(seen.select("id"), "id", "left_anti"), "impact")
        if fresh.isEmpty():
            break
    return seen


def shortest_path(g: Graph, source: str, target: str, kinds: Sequence[str] = (), max_depth: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(step, id) of a shortest path, of several the one through the smallest ids from the end; no row if
    there is none. allowed(id) limits what it may pass through."""
    steps = arcs(g.edges, "outgoing", kinds)
    if allowed is not None:
        steps = steps.join(allowed.union(one(g, target)).toDF("b").distinct(), "b", "left_semi")
    levels = [cut(one(g, source).withColumn("parent", F.lit(None).cast("string")), "path")]
    seen = levels[0].select("id")
    reached = source == target
    while not reached and (max_depth is None or len(levels) <= max_depth):
        near = levels[-1].select("id").join(steps, F.col("id") == F.col("a")).groupBy(F.col("b").alias("id")).agg(F.min("a").alias("parent"))
        fresh = cut(near.join(seen, "id", "left_anti"), "path")
        if fresh.isEmpty():
            return g.spark.createDataFrame([], "step int, id string")
        levels.append(fresh)
        seen = seen.unionByName(fresh.select("id"))
        if len(levels) % TABLES == 0:
            seen = cut(seen, "seen")
        reached = not fresh.filter(F.col("id") == target).isEmpty()
    if not reached:
        return g.spark.createDataFrame([], "step int, id string")
    at, path = target, [target]
    for level in reversed(levels[1:]):  # one row of each level: a path, not a set
        at = level.filter(F.col("id") == at).first()["parent"]
        path.append(at)
    return g.spark.createDataFrame([(k, i) for k, i in enumerate(reversed(path))], "step int, id string")


def ancestors(g: Graph, node: str) -> DataFrame:
    """(id, depth): the chain of containers, by the smallest parent where there are several."""
    parents = g.edges.filter("kind = 'contains'").groupBy(F.col("target").alias("a")).agg(F.min("source").alias("b"))
    return closure(parents, one(g, node)).filter("depth > 0")


def simple_cycles(edges: DataFrame, max_length: int = 4) -> DataFrame:
    """(cycle, length): simple cycles of (source, target) with up to max_length nodes, each once, written
    from its smallest node. Self-loops are cycles of one node."""
    steps = cut(edges.select(F.col("source").alias("a"), F.col("target").alias("b")).distinct(), "steps")
    paths = steps.select(F.col("a").alias("first"), F.array("a").alias("path"), F.col("b").alias("next"))
    found = paths.filter("first = next").select("path")
    paths = paths.filter("next > first")
    for _ in range(max_length - 1):
        paths = cut(paths, "paths")
        grown = paths.join(steps, F.col("next") == F.col("a")).select("first", F.concat("path", F.array("next")).alias("path"), F.col("b").alias("next"))
        found = found.unionByName(grown.filter("next = first").select("path"))
        paths = grown.filter((F.col("next") > F.col("first")) & ~F.array_contains("path", F.col("next")))
    return found.select(F.array_join("path", ">").alias("cycle"), F.size("path").alias("length"))


def cyclic_groups(edges: DataFrame) -> DataFrame:
    """(id, component): nodes of (source, target) that lie on a cycle of any length; those of one strongly
    connected component have its smallest node as component.

    Each round, the smallest node that reaches a node colours it; whoever reaches the node of its own
    colour within that colour makes a component with it, and leaves. Nodes without steps in or out leave first.
    """
    own = edges.filter("source = target").select(F.col("source").alias("id")).distinct().withColumn("component", F.col("id"))
    steps = cut(edges.filter("source <> target").select(F.col("source").alias("a"), F.col("target").alias("b")).distinct(), "steps")
    found, left = None, steps.count()
    while left:
        while True:  # trim to a core where every node has steps both ways
            kept = steps.join(steps.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(steps.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
            steps, before = cut(kept.select("a", "b"), "steps"), left
            left = steps.count()
            if left == before:
                break
        if not left:
            break
        colour = cut(steps.select(F.col("a").alias("id")).distinct().withColumn("colour", F.col("id")), "colours")
        fresh = colour
        while not fresh.isEmpty():
            near = fresh.join(steps, F.col("id") == F.col("a")).groupBy(F.col("b").alias("id")).agg(F.min("colour").alias("lower"))
            grown = cut(colour.join(near, "id", "left").select("id", F.least("colour", "lower").alias("colour"), (F.col("lower") < F.col("colour")).alias("changed")), "colours")
            colour, fresh = grown.select("id", "colour"), grown.filter("changed").select("id", "colour")
        inner = steps.join(colour.select(F.col("id").alias("a"), F.col("colour").alias("ca")), "a").join(colour.select(F.col("id").alias("b"), F.col("colour").alias("cb")), "b")
        inner = cut(inner.filter("ca = cb").select(F.col("b").alias("a"), F.col("a").alias("b")), "inner")  # against the steps
        members = colour.join(closure(inner, colour.filter("id = colour").select("id")).select("id"), "id", "left_semi")
        members = cut(members.select("id", F.col("colour").alias("component")), "members")
        found = members if found is None else found.unionByName(members)
        gone = members.select("id")
        steps = steps.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b")
        steps = cut(steps, "steps")
        left = steps.count()
    if found is None:
        return own
    # a component of one node is on a cycle only by a step to itself
    many = found.groupBy("component").count().filter("count > 1").select("component")
    found = found.join(many, "component", "left_semi").select("id", "component")
    return found.unionByName(own.join(found.select("id"), "id", "left_anti"))


def call_chains(steps: DataFrame, starts: DataFrame, least: int = 3, most: int = 6) -> DataFrame:
    """(chain, length): simple paths of least..most nodes from starts(id)."""
    paths = starts.select(F.array("id").alias("path"), F.col("id").alias("last"))
    found = None
    for n in range(2, most + 1):
        grown = paths.join(steps, F.col("last") == F.col("a")).filter(~F.array_contains("path", F.col("b")))
        paths = cut(grown.select(F.concat("path", F.array("b")).alias("path"), F.col("b").alias("last")).distinct(), "chains")
        if n >= least:
            found = paths if found is None else found.unionByName(paths)
    return found.select(F.array_join("path", ">").alias("chain"), F.size("path").alias("length"))


def affected_files(g: Graph, changed: DataFrame, depth: int = 5, is_test=None) -> DataFrame:
    """(file_path): files whose symbols call into changed(file_path) within depth; if any are tests, these alone."""
    seeds = g.nodes.join(changed, "file_path", "left_semi").select("id")
    reached = closure(arcs(g.edges, "incoming", ("calls",)), seeds, depth)
    paths = cut(g.nodes.join(reached.select("id"), "id", "left_semi").select("file_path").distinct(), "affected")
    if is_test is None:
        return paths
    tests = paths.filter(is_test(F.col("file_path")))
    return paths if tests.isEmpty() else tests
