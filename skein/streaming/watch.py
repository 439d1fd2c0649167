"""File changes as streams: debounced bursts, pending paths and incremental sync.

Changes are rows (path, ts, kind). Streams are read from a folder of Parquet files, so that a burst of
writes on one host and a queue on a cluster look alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.operators.mutate import changes, without_files

CHANGE = "path string, ts timestamp, kind string"


#: A burst ends after so many quiet periods at most, and never later than so many milliseconds.
PERIODS, MOST_MS = 5, 60_000


def most_wait(quiet_ms: int, option: int | None = None) -> int:
    """Milliseconds after which a burst ends however busy its path stays: never less than the quiet period."""
    return min(max(quiet_ms * PERIODS if option is None else option, quiet_ms), MOST_MS)


def read_changes(spark: SparkSession, folder: str, schema: str = CHANGE) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def relevant(changes_: DataFrame, keep) -> DataFrame:
    """Source files that are not ignored: keep is a predicate over the path."""
    return changes_.filter(keep(F.col("path")))


def bursts(changes_: DataFrame, quiet: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """(path, first_seen, last_seen, n): changes of a path until it was quiet for a while. On a stream the
    watermark says how late a change may come; on a batch it has no effect."""
    timed = changes_.withWatermark("ts", late) if changes_.isStreaming else changes_
    found = timed.groupBy("path", F.session_window("ts", quiet).alias("w")).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("n"))
    return found.select("path", "first_seen", "last_seen", "n")


def capped_bursts(changes_: DataFrame, quiet_s: float = 2.0, most_s: float = 10.0) -> DataFrame:
    """(path, first_seen, last_seen, n) of a batch, where a burst also ends most_s after its first change,
    however busy the path stays. Rows of a path come in order, and only running figures are kept."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = None
        for b in batches:
            out = []
            for path, ts in zip(b["path"], b["ts"], strict=True):
                if at and at[0] == path and (ts - at[2]).total_seconds() <= quiet_s and (ts - at[1]).total_seconds() < most_s:
                    at = (path, at[1], ts, at[3] + 1)
                else:
                    out += [at] if at else []
                    at = (path, ts, ts, 1)
            yield pd.DataFrame(out, columns=["path", "first_seen", "last_seen", "n"])
        if at:
            yield pd.DataFrame([at], columns=["path", "first_seen", "last_seen", "n"])

    kind = changes_.schema["ts"].dataType.simpleString()
    return changes_.select("path", "ts").repartition("path").sortWithinPartitions("path", "ts").mapInPandas(fold, f"path string, first_seen {kind}, last_seen {kind}, n long")


def pending(changes_: DataFrame) -> DataFrame:
    """(path, first_seen, last_seen, n) of all changes not yet synced."""
    return changes_.groupBy("path").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("n"))


def cleared(pending_: DataFrame, started) -> DataFrame:
    """What stays pending after a sync that began at `started`: changes seen since."""
    return pending_.filter(F.col("last_seen") >= started)


def throttled(changes_: DataFrame, least: str = "1 second") -> DataFrame:
    """One row for each path and interval: the last change in it."""
    slot = F.window("ts", least)
    last = F.row_number().over(Window.partitionBy("path", slot).orderBy(F.desc("ts")))
    return changes_.withColumn("_k", last).filter("_k = 1").drop("_k")


def sync(before: tuple[DataFrame, DataFrame, DataFrame], files: DataFrame, index: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, files) after bringing an index up to files(path, content_hash, ...). Whatever touches
    a changed file goes; changed files, and those with edges into them, are indexed again, so the result
    equals a rebuild."""
    nodes, edges, old = before
    change = changes(old, files)
    touched = change.select("path")
    place = nodes.select("id", "file_path")
    into = edges.join(place.toDF("source", "path"), "source").join(place.toDF("target", "to"), "target").join(touched.toDF("to"), "to", "left_semi").select("path")
    again = touched.union(into).distinct()
    nodes, edges, old = without_files(nodes, edges, old, again)
    fresh = files.join(again, "path", "left_semi")
    more_nodes, more_edges = index(fresh)
    return nodes.unionByName(more_nodes), edges.unionByName(more_edges), old.unionByName(fresh.select(*old.columns))


def run_sync(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Call apply with each batch of pending paths; progress is kept in checkpoint, so a batch that failed
    comes again with the same number."""

    def each(batch: DataFrame, number: int) -> None:
        apply(pending(batch), number)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
