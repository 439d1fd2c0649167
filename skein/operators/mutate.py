"""Changing the store: upserts, cascades and dedupes as anti-joins, unions and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(table: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """fresh replaces rows of table with the same keys."""
    return table.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh, allowMissingColumns=True)


def last_wins(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key by order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def first_wins(rows: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def valid_nodes(rows: DataFrame, now_ms: int) -> DataFrame:
    """Rows that may be stored: those without id, name or file are dropped; an empty qualified name
    becomes the name, a zero time becomes now."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    kept = rows.filter(filled("id") & filled("name") & filled("file_path"))
    kept = kept.withColumn("qualified_name", F.when(filled("qualified_name"), F.col("qualified_name")).otherwise(F.col("name")))
    return kept.withColumn("updated_at", F.when(F.coalesce("updated_at", F.lit(0)) == 0, F.lit(now_ms)).otherwise(F.col("updated_at")))


def attached(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both exist."""
    ids = nodes.select("id")
    return edges.join(ids, F.col("source") == F.col("id"), "left_semi").join(ids, F.col("target") == F.col("id"), "left_semi")


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables less the nodes in gone(id) and every edge that touches them."""
    left = edges.join(gone, F.col("source") == F.col("id"), "left_anti").join(gone, F.col("target") == F.col("id"), "left_anti")
    return nodes.join(gone, "id", "left_anti"), left


def without_files(nodes: DataFrame, edges: DataFrame, files: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three tables less what belongs to paths(path)."""
    gone = nodes.join(paths, nodes.file_path == paths.path, "left_semi").select("id")
    kept, edges = without_nodes(nodes, edges, gone)
    return kept, edges, files.join(paths, "path", "left_anti")


def without_refs(refs: DataFrame, done: DataFrame) -> DataFrame:
    """Unresolved references less those in done(from_node_id, reference_name, reference_kind)."""
    return refs.join(done, ["from_node_id", "reference_name", "reference_kind"], "left_anti")


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (source, target, kind, line, col, provenance), by metadata too unless a call."""
    key = F.when(F.col("kind") == "calls", F.lit("")).otherwise(F.coalesce(F.to_json("metadata"), F.lit("")))
    return edges.withColumn("_meta", key).dropDuplicates(["source", "target", "kind", "line", "col", "provenance", "_meta"]).drop("_meta")


def distinct_stored_edges(edges: DataFrame) -> DataFrame:
    """Of stored edges with edge_id, the first for each (source, target, kind, provenance, metadata unless
    a call): places do not count."""
    key = F.when(F.col("kind") == "calls", F.lit("")).otherwise(F.coalesce(F.to_json("metadata"), F.lit("")))
    return first_wins(edges.withColumn("_meta", key), ["source", "target", "kind", "provenance", "_meta"], "edge_id").drop("_meta")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): added, removed or modified, from two tables of (path, content_hash)."""
    both = before.select("path", F.col("content_hash").alias("old")).join(after.select("path", F.col("content_hash").alias("new")), "path", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return both.select("path", change.alias("change")).filter("change IS NOT NULL")


def capped(rows: DataFrame, keys: Sequence[str], most: int | Column, *order: Column | str) -> DataFrame:
    """At most so many rows of each key, in order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")
