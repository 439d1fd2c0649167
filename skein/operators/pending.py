"""Pending references, resolved while indexing: by qualified name, name and relaxed key, the closest wins.

The choice among candidates is the greatest of one struct: relative source, same directory, path suffix,
shared directories, language family, shorter path; then the smallest (file, line, id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.resolve import family, last_segment, shared_directories
from skein.operators.structure import directory

#: What a reference of each kind may point at.
TARGETS = {
    "calls": ("function", "method", "class", "struct", "component", "constant", "variable"),
    "instantiates": ("class", "struct", "interface", "component"),
    "extends": ("class", "struct", "interface", "trait", "protocol"),
    "implements": ("interface", "trait", "protocol", "class"),
    "decorates": ("function", "method", "class", "interface"),
    "type_of": ("class", "struct", "interface", "trait", "protocol", "enum", "type_alias"),
    "returns": ("class", "struct", "interface", "trait", "protocol", "enum", "type_alias"),
    "imports": ("file", "module", "namespace", "class", "function", "interface", "struct", "component"),
}


def compatible(reference_kind: Column, node_kind: Column) -> Column:
    out = None
    for kind, targets in TARGETS.items():
        fits = node_kind.isin(*targets)
        out = F.when(reference_kind == kind, fits) if out is None else out.when(reference_kind == kind, fits)
    return out.otherwise(True)


def closeness() -> Column:
    r, n = (lambda c: F.col(f"r.{c}")), (lambda c: F.col(f"n.{c}"))
    return F.struct(
        (r("reference_name").startswith(".") & (directory(r("file_path")) == directory(n("file_path")))).alias("relative"),
        (directory(r("file_path")) == directory(n("file_path"))).alias("beside"),
        F.coalesce(n("file_path").contains(F.regexp_replace(r("reference_name"), r"[.:]+", "/")), F.lit(False)).alias("suffix"),
        shared_directories(r("file_path"), n("file_path")).alias("shared"),
        (family(r("language")) == family(n("language"))).alias("family"),
        (-F.length(n("file_path"))).alias("shorter"),
    )


def resolve_pending(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref_id, target_id): the first form that finds anything, and of what it finds the closest. Forms:
    the qualified name, the name, the last segment as a member, a configuration key whatever its dashes."""
    plain = lambda c: F.lower(F.regexp_replace(c, "[-_]", ""))
    asked = refs.withColumn("_last", last_segment(F.col("reference_name"))).withColumn("_plain", plain(F.col("reference_name"))).alias("r")
    there = nodes.withColumn("_plain", F.when(F.col("language").isin("yaml", "properties"), plain(F.col("name")))).alias("n")
    forms = (
        F.col("r.reference_name") == F.col("n.qualified_name"),
        F.col("r.reference_name") == F.col("n.name"),
        F.col("r._last") == F.col("n.name"),
        F.col("r._plain") == F.col("n._plain"),
    )
    every = None
    for rank, form in enumerate(forms):
        met = asked.join(there, form).filter(compatible(F.col("r.reference_kind"), F.col("n.kind")) & (F.col("r.from_node_id") != F.col("n.id")))
        met = met.select(F.col("r.ref_id").alias("ref_id"), F.col("n.id").alias("target_id"), F.lit(rank).alias("rank"), closeness().alias("close"), F.col("n.file_path").alias("file_path"), F.col("n.start_line").alias("start_line"))
        every = met if every is None else every.unionByName(met)
    order = Window.partitionBy("ref_id").orderBy("rank", F.desc("close"), "file_path", "start_line", "target_id")
    return every.withColumn("_k", F.row_number().over(order)).filter("_k = 1").select("ref_id", "target_id")


def pending_edges(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """One edge for each (source, target, kind)."""
    met = resolve_pending(refs, nodes).join(refs.select("ref_id", "from_node_id", "reference_kind"), "ref_id")
    return met.select(F.col("from_node_id").alias("source"), F.col("target_id").alias("target"), F.col("reference_kind").alias("kind")).distinct()
