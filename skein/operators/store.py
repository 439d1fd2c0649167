"""The store's smaller tables: references that wait for resolution, files, metadata; and row output."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from skein.operators.mutate import capped, upsert


def nodes_of_kind(nodes: DataFrame, kind: str) -> Iterator[Row]:
    """Nodes of a kind, one after the other: the driver holds a partition at a time."""
    return nodes.filter(F.col("kind") == kind).toLocalIterator(prefetchPartitions=True)


def file_at(files: DataFrame, path: str) -> DataFrame:
    return files.filter(F.col("path") == path)


def last_indexed(files: DataFrame) -> DataFrame:
    """(last_indexed): the latest time at which a file was indexed; null if none was."""
    return files.agg(F.max("indexed_at").alias("last_indexed"))


def cleared(*tables: DataFrame) -> tuple[DataFrame, ...]:
    """The tables without rows."""
    return tuple(t.limit(0) for t in tables)


def with_metadata(metadata: DataFrame, fresh: DataFrame) -> DataFrame:
    """metadata(key, value) where the keys of fresh have its values."""
    return upsert(metadata, fresh, ["key"])


def metadata_value(metadata: DataFrame, key: str) -> DataFrame:
    return metadata.filter(F.col("key") == key).select("value")


def refs_named(refs: DataFrame, name: str) -> DataFrame:
    return refs.filter(F.col("reference_name") == name)


def refs_in_files(refs: DataFrame, paths: DataFrame) -> DataFrame:
    """References of the files in paths(file_path)."""
    return refs.join(paths, "file_path", "left_semi")


def refs_page(refs: DataFrame, after: int | None, size: int) -> DataFrame:
    """The next page of references behind ref_id `after`: pages by key cost the same wherever they start."""
    rest = refs if after is None else refs.filter(F.col("ref_id") > after)
    return rest.orderBy("ref_id").limit(size)


def refs_count(refs: DataFrame) -> DataFrame:
    return refs.agg(F.count("*").alias("n"))


def nodes_of_file(nodes: DataFrame, path: str) -> DataFrame:
    """Nodes of files whose path is, or ends with, the given one; slashes of either kind."""
    end = path.replace("\\", "/")
    return nodes.filter((F.col("file_path") == path) | F.col("file_path").endswith(end)).orderBy("file_path", "start_line", "id")


def _holds(column: str, needle: str) -> Column:
    return F.lower(column).contains(needle.lower())


def query(nodes: DataFrame, text: str, kind: str | None = None, limit: int = 50) -> DataFrame:
    """Nodes whose name, qualified name or path holds the text, whatever its case, in order of place."""
    found = nodes.filter(_holds("name", text) | _holds("qualified_name", text) | _holds("file_path", text))
    found = found.filter(F.col("kind") == kind) if kind else found
    return found.orderBy("file_path", "start_line", "name", "id").limit(limit)


def symbols(nodes: DataFrame, name: str, limit: int = 50) -> DataFrame:
    """Nodes of that name or qualified name whatever its case; if none, those that hold it; if none, query()."""
    low = name.lower()
    order = ("file_path", "start_line", "id")
    for found in (nodes.filter((F.lower("name") == low) | (F.lower("qualified_name") == low)), nodes.filter(_holds("name", low) | _holds("qualified_name", low))):
        if not found.isEmpty():
            return found.orderBy(*order).limit(limit)
    return query(nodes, name, None, limit)


def in_output_order(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy("file_path", "start_line", "name", "id")


def distinct_by_name(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One edge for each (kind, names and places of its ends, metadata unless a call). Of several, one
    whose target's, then source's signature shows a body is preferred; then the first by its ends."""
    end = lambda side: nodes.select(
        F.col("id").alias(side), F.struct("kind", "qualified_name", "file_path").alias(f"_{side}"), F.coalesce(F.col("signature").contains("{"), F.lit(False)).cast("int").alias(f"_{side}_body")
    )
    met = edges.join(end("source"), "source", "left").join(end("target"), "target", "left")
    named = lambda side: F.coalesce(F.to_json(f"_{side}"), F.col(side))
    meta = F.to_json("metadata") if "metadata" in edges.columns else F.lit(None).cast("string")
    met = met.select(*edges.columns, named("source").alias("_s"), named("target").alias("_t"), F.when(F.col("kind") != "calls", meta).alias("_meta"), F.coalesce("_target_body", F.lit(0)).alias("_tb"), F.coalesce("_source_body", F.lit(0)).alias("_sb"))
    return capped(met, ["_s", "_t", "kind", "_meta"], 1, F.desc("_tb"), F.desc("_sb"), "source", "target").select(edges.columns)


def non_production_capped(nodes: DataFrame, is_test: Column, max_nodes: int) -> DataFrame:
    """All nodes outside tests, and of those in tests the first by id: three, or 15 per cent of max_nodes if that is more."""
    most = max(3, -(-max_nodes * 15 // 100))
    tests = nodes.filter(is_test).orderBy("id").limit(most)
    return nodes.filter(~is_test).unionByName(tests)


def truncated(text: str, most: int, note: str = "... (output truncated)") -> str:
    """The text within so many bytes of UTF-8, cut between characters, at a line's end if one is near."""
    raw = text.encode()
    if len(raw) <= most:
        return text
    if most <= 0:
        return ""
    part = raw[:most].decode(errors="ignore")
    size = len(part.encode())
    line = len(part[: part.rfind("\n")].encode()) if "\n" in part else size
    return (part.encode()[:line].decode() if line > size * 8 // 10 else part) + "\n\n" + note


def stale_notice(pending: DataFrame, shown: Sequence[str]) -> DataFrame:
    """(path): files that an answer shows and that have changes which the index lacks."""
    return pending.filter(F.col("path").isin(*shown)).select("path").distinct()
