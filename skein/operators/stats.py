"""Aggregations: status, dominant files, routing, run metrics and scoring of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.graphview import Graph


def status_counts(g: Graph, files: DataFrame | None = None) -> DataFrame:
    """(measure, name, n): totals, nodes by kind and language, edges by kind; and files."""
    n = g.nodes.groupingSets([["kind"], ["language"]], "kind", "language").agg(F.count("*").alias("n"), F.grouping("kind").alias("gk"))
    out = n.select(F.when(F.col("gk") == 0, "nodes_by_kind").otherwise("nodes_by_language").alias("measure"), F.coalesce("kind", "language", F.lit("")).alias("name"), "n")
    out = out.unionByName(g.edges.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("edges_by_kind").alias("measure"), F.col("kind").alias("name"), "n"))
    # totals on their own: grouping sets have no row for an empty table
    for measure, table in (("nodes", g.nodes), ("edges", g.edges)):
        out = out.unionByName(table.groupBy().agg(F.count("*").alias("n")).select(F.lit(measure).alias("measure"), F.lit("").alias("name"), "n"))
    if files is not None:
        out = out.unionByName(files.groupBy().agg(F.count("*").alias("n")).select(F.lit("files").alias("measure"), F.lit("").alias("name"), "n"))
    return out


def dominant_files(g: Graph, least: int = 20, most: int = 20, low_value=None) -> DataFrame:
    """(file_path, internal_edges): files by edges among their own symbols; top `most` of at least `least`."""
    place = g.nodes.select("id", "file_path")
    e = g.edges.filter("kind <> 'contains'").join(place.toDF("source", "file_path"), "source").join(place.toDF("target", "other"), "target").filter("file_path = other")
    top = e.groupBy("file_path").agg(F.count("*").alias("internal_edges")).filter(F.col("internal_edges") >= least)
    if low_value is not None:
        top = top.filter(~low_value(F.col("file_path")))
    return top.orderBy(F.desc("internal_edges"), "file_path").limit(most)


def top_share(rows: DataFrame, key: str, least_total: int = 3, least_top: int = 3, least_share: float = 0.30) -> DataFrame:
    """(key, n, total) of the commonest key, if it is common enough."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    top = counts.orderBy(F.desc("n"), key).limit(1).crossJoin(total)  # one row with one row
    return top.filter((F.col("total") >= least_total) & (F.col("n") >= least_top) & (F.col("n") >= least_share * F.col("total")))


def routing_manifest(g: Graph, limit: int = 40, least: int = 3) -> DataFrame:
    """(route, handler, file_path): routes with their handlers, none if there are fewer than `least`."""
    routes = g.nodes.filter("kind = 'route'").select(F.col("id").alias("source"), F.col("name").alias("route"))
    handlers = g.nodes.select(F.col("id").alias("target"), F.col("name").alias("handler"), "file_path")
    met = g.edges.filter("kind IN ('references', 'calls')").join(routes, "source").join(handlers, "target")
    top = met.select("route", "handler", "file_path").orderBy("file_path", "route", "handler").limit(limit)
    return top.withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(1)))).filter(F.col("_n") >= least).drop("_n")


def call_budget(n_files):
    """Explore calls that a project of n files is worth: a step function."""
    return F.when(n_files < 500, 1).when(n_files < 5000, 2).when(n_files < 15000, 3).when(n_files < 25000, 4).otherwise(5)


def size_tier(n_files):
    return F.when(n_files < 200, "S").when(n_files < 800, "M").otherwise("L")


def run_metrics(turns: DataFrame) -> DataFrame:
    """turns(run, ord, tool, chars): one row for each run, with counts by kind of tool and sizes."""
    tool = F.col("tool")
    return turns.groupBy("run").agg(
        F.count("*").alias("n"),
        *(F.count_if(tool == t).alias(f"n_{t}") for t in ("user", "assistant", "system")),
        F.sum("chars").cast("long").alias("chars"),
        F.max("ord").alias("last"),
    )


def after_first(turns: DataFrame, tool: str) -> DataFrame:
    """(run, n_before, n_after): turns before and after the first of a tool; runs without it have no row."""
    first = F.min(F.when(F.col("tool") == tool, F.col("ord"))).over(Window.partitionBy("run"))
    marked = turns.withColumn("_first", first).filter("_first IS NOT NULL")
    return marked.groupBy("run").agg(F.count_if(F.col("ord") < F.col("_first")).alias("n_before"), F.count_if(F.col("ord") > F.col("_first")).alias("n_after"))


def arm_report(turns: DataFrame, arm) -> DataFrame:
    """Medians and means of run metrics by arm(run)."""
    runs = run_metrics(turns).withColumn("arm", arm(F.col("run")))
    return runs.groupBy("arm").agg(
        F.count("*").alias("runs"), F.round(F.median("chars"), 6).alias("median_chars"), F.round(F.avg("n"), 6).alias("mean_turns"), F.round(F.avg("chars"), 6).alias("mean_chars")
    )


def saving_percent(less, more):
    return F.when(more == 0, F.lit(0.0)).otherwise(F.round((1 - less / more) * 100, 0))


def retrieval_scores(expected: DataFrame, ranked: DataFrame, least_recall: float = 0.5) -> DataFrame:
    """expected(case, item), ranked(case, item, rank): recall, reciprocal rank and verdict of each case."""
    met = expected.join(ranked.groupBy("case", "item").agg(F.min("rank").alias("rank")), ["case", "item"], "left")
    out = met.groupBy("case").agg(F.count("*").alias("n_expected"), F.count("rank").alias("n_found"), F.min("rank").alias("_best"))
    recall = F.col("n_found") / F.col("n_expected")
    return out.select("case", "n_expected", "n_found", F.round(recall, 6).alias("recall"), F.round(F.coalesce(1 / F.col("_best"), F.lit(0.0)), 6).alias("mrr"), (recall >= least_recall).alias("passed"))
