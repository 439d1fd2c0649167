"""Queries of the store's smaller tables, of flows and of output."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.graphview import FILES_PRELUDE, PRELUDE, files, graph
from skein.operators import store, traversal
from skein.plans.graph_queries import TEST_SQL
from skein.plans.registry import register
from skein.plans.search_queries import _refs, _refs_sql
from skein.sources.paths import is_test

NODE = "id, kind, name, file_path, start_line"


def _sql(rest: str) -> str:
    return PRELUDE + rest


def _nodes(df):
    return df.select(*NODE.split(", "))


@register("refs_count", _sql(_refs_sql("p_name") + "SELECT count(*) AS n FROM refs"))
def refs_count(spark, sf_dir):
    return store.refs_count(_refs(spark, sf_dir, "p_name"))


@register("refs_by_name", _sql(_refs_sql("p_name") + "SELECT ref_id, from_node_id, line FROM refs WHERE reference_name = (SELECT max(p_name) FROM part)"))
def refs_by_name(spark, sf_dir):
    refs = _refs(spark, sf_dir, "p_name")
    name = refs.agg(F.max("reference_name")).first()[0]
    return store.refs_named(refs, name).select("ref_id", "from_node_id", "line")


@register("refs_by_files", _sql(_refs_sql("p_name") + "SELECT ref_id, file_path FROM refs WHERE file_path IN (SELECT 'lib/parts/size' || n_nationkey || '.rs' FROM nation)"))
def refs_by_files(spark, sf_dir):
    paths = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("lib/parts/size"), F.col("n_nationkey").cast("string"), F.lit(".rs")).alias("file_path"))
    return store.refs_in_files(_refs(spark, sf_dir, "p_name"), paths).select("ref_id", "file_path")


@register("refs_page", _sql(_refs_sql("p_name") + "SELECT ref_id, reference_name FROM refs WHERE ref_id > 50 ORDER BY ref_id LIMIT 25"))
def refs_page(spark, sf_dir):
    return store.refs_page(_refs(spark, sf_dir, "p_name"), 50, 25).select("ref_id", "reference_name")


@register("file_lookup", FILES_PRELUDE + " SELECT path, language, size FROM files WHERE path = (SELECT min(path) FROM files)")
def file_lookup(spark, sf_dir):
    f = files(spark, sf_dir)
    return store.file_at(f, f.agg(F.min("path")).first()[0]).select("path", "language", "size")


@register("last_indexed", "SELECT max(n_chars) AS last_indexed FROM documents")
def last_indexed(spark, sf_dir):
    return store.last_indexed(files(spark, sf_dir).withColumn("indexed_at", F.col("size")))


@register("metadata_upsert", "SELECT 'nation' || n_nationkey AS key, CASE WHEN n_nationkey % 2 = 0 THEN 'fresh' ELSE n_name END AS value FROM nation UNION ALL SELECT 'schema', '2'")
def metadata_upsert(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    key = F.concat(F.lit("nation"), F.col("n_nationkey").cast("string")).alias("key")
    fresh = nation.filter("n_nationkey % 2 = 0").select(key, F.lit("fresh").alias("value")).union(spark.createDataFrame([("schema", "2")], "key string, value string"))
    return store.with_metadata(nation.select(key, F.col("n_name").alias("value")), fresh)


@register("nodes_by_file_suffix", _sql(f"SELECT {NODE} FROM nodes WHERE ends_with(file_path, 'NATION_2/customer.ts')"))
def nodes_by_file_suffix(spark, sf_dir):
    return _nodes(store.nodes_of_file(graph(spark, sf_dir).nodes, "NATION_2\\customer.ts"))


@register("text_query", _sql(f"SELECT {NODE} FROM nodes WHERE kind = 'class' AND (contains(lower(name), 'nation_2') OR contains(lower(qualified_name), 'nation_2') OR contains(lower(file_path), 'nation_2')) ORDER BY file_path, start_line, name, id LIMIT 40"))
def text_query(spark, sf_dir):
    return _nodes(store.query(graph(spark, sf_dir).nodes, "Nation_2", "class", 40))


@register("symbol_lookup", _sql(f"SELECT {NODE} FROM nodes WHERE name <> 'order_10' AND (contains(lower(name), 'order_10') OR contains(lower(qualified_name), 'order_10')) ORDER BY file_path, start_line, id LIMIT 50"))
def symbol_lookup(spark, sf_dir):
    """No symbol is called just that, so those that hold it are found."""
    return _nodes(store.symbols(graph(spark, sf_dir).nodes.filter("name <> 'order_10'"), "ORDER_10"))


BY_NAME_SQL = """
, n AS (SELECT id, kind || '|' || qualified_name || '|' || file_path AS place FROM nodes WHERE kind IN ('method', 'struct')),
k AS (SELECT e.source, e.target, e.kind, row_number() OVER (PARTITION BY s.place, t.place, e.kind ORDER BY e.source, e.target) AS r
      FROM (SELECT DISTINCT source, target, kind FROM edges WHERE kind IN ('references', 'instantiates')) e JOIN n s ON s.id = e.source JOIN n t ON t.id = e.target)
SELECT source, target, kind FROM k WHERE r = 1
"""


@register("edges_distinct_by_name", _sql(BY_NAME_SQL))
def edges_distinct_by_name(spark, sf_dir):
    g = graph(spark, sf_dir)
    edges = g.edges.filter("kind IN ('references', 'instantiates')").select("source", "target", "kind").distinct()
    return store.distinct_by_name(edges, g.nodes.filter("kind IN ('method', 'struct')"))


@register("non_production_cap", _sql(f", t AS (SELECT *, regexp_matches(file_path, '{TEST_SQL}') AS is_test FROM nodes WHERE kind = 'method') (SELECT id FROM t WHERE NOT is_test) UNION ALL (SELECT id FROM t WHERE is_test ORDER BY id LIMIT 15)"))
def non_production_cap(spark, sf_dir):
    return store.non_production_capped(graph(spark, sf_dir).nodes.filter("kind = 'method'"), is_test(F.col("file_path")), 100).select("id")


@register("output_order", _sql("SELECT id, row_number() OVER (ORDER BY file_path, start_line, name, id) AS place FROM nodes WHERE kind = 'struct' QUALIFY place <= 200"))
def output_order(spark, sf_dir):
    first = store.in_output_order(graph(spark, sf_dir).nodes.filter("kind = 'struct'")).limit(200)
    return first.select("id", F.row_number().over(Window.orderBy("file_path", "start_line", "name", "id")).cast("long").alias("place"))


REACH_SQL = """
, w(id) AS (SELECT 'order:100' UNION SELECT e.target FROM w JOIN edges e ON e.source = w.id AND e.kind IN ('calls', 'instantiates'))
SELECT id FROM w
"""


@register("dfs_reach", _sql(REACH_SQL))
def dfs_reach(spark, sf_dir):
    """Without bounds a depth-first search reaches what any search reaches."""
    return traversal.dfs(graph(spark, sf_dir), "order:100", edge_kinds=("calls", "instantiates"), limit=100_000).select("id")


@register("adjacent_by_priority", _sql("SELECT target AS id, kind, CASE kind WHEN 'contains' THEN 0 WHEN 'calls' THEN 1 ELSE 2 END AS priority FROM edges WHERE source IN ('order:100', 'nation:3')"))
def adjacent_by_priority(spark, sf_dir):
    e = graph(spark, sf_dir).edges.filter("source IN ('order:100', 'nation:3')")
    return e.select(F.col("target").alias("id"), "kind", traversal.edge_priority(F.col("kind")).alias("priority")).orderBy("priority", "id")


FLOW_SQL = """
, named AS (SELECT 'order:' || o_orderkey AS id FROM orders),
w(seed, id, depth) AS (SELECT id, id, 0 FROM named UNION SELECT seed, target, depth + 1 FROM w JOIN edges e ON e.source = w.id AND e.kind = 'calls' WHERE depth < 6)
SELECT seed, id AS target, min(depth) AS depth FROM w WHERE id IN (SELECT id FROM named) AND id <> seed GROUP BY 1, 2
"""


@register("static_flows", _sql(FLOW_SQL))
def static_flows(spark, sf_dir):
    named = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("id"))
    return traversal.static_flows(graph(spark, sf_dir), named)


PATH_SQL = """
, c AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS k FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders))
SELECT k - 1 AS step, 'order:' || o_orderkey AS id FROM c WHERE k <= 6
"""


@register("named_flow", _sql(PATH_SQL))
def named_flow(spark, sf_dir):
    """The orders of a customer call each other in turn: the only flow from the first to the sixth."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    least = orders.agg(F.min("o_custkey")).first()[0]
    ids = [f"order:{r.o_orderkey}" for r in orders.filter(F.col("o_custkey") == least).orderBy("o_orderdate", "o_orderkey").limit(6).collect()]
    return traversal.named_flow(graph(spark, sf_dir), ids[0], ids[-1]).select(F.col("step").cast("long").alias("step"), "id")
