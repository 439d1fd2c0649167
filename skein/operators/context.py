"""Context for a task: which symbols matter to a question, and how they are laid out."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.graphview import Graph
from skein.model import ContextOptions
from skein.operators import search, terms
from skein.operators.mutate import capped
from skein.operators.structure import directory
from skein.operators.traversal import arcs
from skein.sources.paths import is_test


def relevant(g: Graph, question: str, options: ContextOptions = ContextOptions()) -> DataFrame:
    """(id, name, kind, file_path, start_line, score): symbols by how many words of the question they
    answer. Exact names weigh most, then prefixes, then words inside; more words of the question raise a
    score, tests lower it unless asked for, and the commonest directory among the best gains a little."""
    words = terms.search_terms(question) or [question.lower()]
    names = {s.lower() for s in terms.symbols(question)} | set(terms.search_terms(question, False))
    n, q = F.lower("name"), F.lower("qualified_name")
    score, hits = F.lit(0.0), F.lit(0)
    for w in words:
        found = F.when(n == w, 50.0 if w in names else 30.0).when(n.startswith(w), F.lit(15.0) + 10.0 * len(w) / F.length("name")).when(n.contains(w), 8.0).when(q.contains(w), 3.0).otherwise(0.0)
        score, hits = score + found, hits + (found > 0).cast("int")
    rows = g.nodes.withColumn("_hits", hits).withColumn("score", score + search.kind_bonus(F.col("kind"))).filter("_hits > 0")
    several = F.when(F.lit(len(words) > 1) & (F.col("_hits") > 1), 1 + 0.5 * F.col("_hits")).otherwise(1.0)
    rows = rows.withColumn("score", F.col("score") * several)
    if not any("test" in w or "spec" in w for w in words):
        rows = rows.withColumn("score", F.when(is_test(F.col("file_path")), F.col("score") * 0.3).otherwise(F.col("score")))
    best = rows.orderBy(F.desc("score"), "id").limit(options.max_nodes * 5).withColumn("_dir", directory(F.col("file_path")))
    share = F.count("*").over(Window.partitionBy("_dir"))
    best = best.withColumn("score", F.round(F.col("score") + F.when(share >= options.max_nodes, 25).otherwise(0), 6)).filter(F.col("score") >= options.min_score)
    per_file = max(5, math.ceil(options.max_nodes * 0.2))
    kept = capped(best, ["file_path"], per_file, F.desc("score"), "id")
    return kept.select("id", "name", "kind", "file_path", "start_line", "score").orderBy(F.desc("score"), "file_path", "start_line", "name", "id").limit(options.max_nodes)


def subgraph(g: Graph, roots: DataFrame, options: ContextOptions = ContextOptions()) -> tuple[DataFrame, DataFrame]:
    """(nodes with is_root, edges): the roots, as many of their neighbours as fit, and the edges among these."""
    near = roots.select("id").join(arcs(g.edges, "both"), F.col("id") == F.col("a")).groupBy(F.col("b").alias("id")).agg(F.count("*").alias("_n"))
    near = near.join(roots.select("id"), "id", "left_anti").orderBy(F.desc("_n"), "id").limit(options.max_nodes)
    ids = roots.select("id", F.lit(True).alias("is_root")).unionByName(near.select("id", F.lit(False).alias("is_root")))
    nodes = g.nodes.join(F.broadcast(ids), "id")  # at most twice max_nodes
    among = g.edges.join(F.broadcast(ids.select("id")), F.col("source") == F.col("id"), "left_semi").join(F.broadcast(ids.select("id")), F.col("target") == F.col("id"), "left_semi")
    return nodes, among


def confidence(question: str, names: list[str]) -> str:
    """low if the question has several words and no name answers two of them."""
    groups = terms.term_groups(terms.search_terms(question, False))
    best = max((sum(any(t in n.lower() for t in g) for g in groups) for n in names), default=0)
    return "low" if len(groups) >= 2 and best < 2 else "high"


def code_blocks(nodes: DataFrame, files: DataFrame, options: ContextOptions = ContextOptions()) -> DataFrame:
    """(id, file_path, block): the lines of the first symbols, cut to a size."""
    lines = files.select(F.col("path").alias("file_path"), F.split("content", "\n").alias("lines"))
    top = nodes.orderBy(F.desc("score"), "id").limit(options.max_code_blocks)
    text = F.array_join(F.slice("lines", F.greatest("start_line", F.lit(1)), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(1))), "\n")
    return top.join(lines, "file_path").select("id", "file_path", F.substring(text, 1, options.max_block_size).alias("block"))


def to_json(question: str, nodes: list, edges: list) -> str:
    return json.dumps({
        "query": question,
        "confidence": confidence(question, [n["name"] for n in nodes]),
        "nodes": [{k: n[k] for k in ("id", "kind", "name", "file_path", "start_line")} for n in nodes],
        "edges": [{k: e[k] for k in ("source", "target", "kind")} for e in edges],
        "files": sorted({n["file_path"] for n in nodes}),
    })


def to_markdown(question: str, nodes: list, edges: list) -> str:
    names = {n["id"]: n["name"] for n in nodes}
    out = [f"## {question}", "", f"{len(nodes)} symbols, {len(edges)} relations; confidence {confidence(question, list(names.values()))}.", "", "### Symbols"]
    out += [f"- `{n['name']}` ({n['kind']}) {n['file_path']}:{n['start_line']}" for n in nodes]
    if edges:
        out += ["", "### Relations", *(f"- {names.get(e['source'], e['source'])} {e['kind']} {names.get(e['target'], e['target'])}" for e in edges)]
    return "\n".join(out)


def to_tree(nodes: list, edges: list, roots: list[str], depth: int = 4) -> str:
    """An indented tree from the roots; each node is expanded once."""
    names, kids = {n["id"]: n["name"] for n in nodes}, {}
    for e in edges:
        kids.setdefault(e["source"], []).append(e)
    out, seen = [], set()

    def walk(node: str, level: int, by: str) -> None:
        out.append("  " * level + (f"{by} " if by else "") + names.get(node, node))
        if node in seen or level >= depth:
            return
        seen.add(node)
        for e in sorted(kids.get(node, ()), key=lambda e: (e["kind"], e["target"])):
            walk(e["target"], level + 1, e["kind"])

    for r in roots:
        walk(r, 0, "")
    return "\n".join(out)
