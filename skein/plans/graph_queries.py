"""Queries over the graph view, each with the SQL that DuckDB must agree on."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.graphview import PRELUDE, graph
from skein.operators import mutate, stats, structure, traversal
from skein.plans.registry import register
from skein.sources.paths import TEST_PATTERN, is_test

START, FILE = "order:100", "app/ASIA/NATION_2/order.ts"
#: The test-file rule for DuckDB.
TEST_SQL = TEST_PATTERN.replace("'", "''")
CALLS = "('calls', 'references', 'imports', 'instantiates')"


def _sql(rest: str) -> str:
    return PRELUDE + rest


def _closure(seed: str, step: str, depth: int) -> str:
    """Recursive closure as SQL: r(id, depth) from seed over step(a, b)."""
    return (
        f", step AS ({step}), walk(id, depth) AS (SELECT id, 0 FROM ({seed}) s UNION SELECT b, depth + 1 FROM walk JOIN step ON id = a WHERE depth < {depth}),"
        " r AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id) "
    )


# scans


@register("node_scan_by_kind", _sql("SELECT id, name FROM nodes WHERE kind = 'interface'"))
def node_scan_by_kind(spark, sf_dir):
    return graph(spark, sf_dir).nodes.filter("kind = 'interface'").select("id", "name")


@register("node_by_id", _sql("SELECT id, kind, name, qualified_name, file_path, start_line FROM nodes WHERE id = 'order:100'"))
def node_by_id(spark, sf_dir):
    return graph(spark, sf_dir).nodes.filter(F.col("id") == START).select("id", "kind", "name", "qualified_name", "file_path", "start_line")


@register("nodes_by_ids", _sql("SELECT id, name FROM nodes WHERE id IN (SELECT 'part:' || n_nationkey FROM nation)"))
def nodes_by_ids(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("part:"), F.col("n_nationkey").cast("string")).alias("id"))
    return graph(spark, sf_dir).nodes.join(ids, "id", "left_semi").select("id", "name")


@register("nodes_in_file", _sql(f"SELECT id, start_line FROM nodes WHERE file_path = '{FILE}'"))
def nodes_in_file(spark, sf_dir):
    return graph(spark, sf_dir).nodes.filter(F.col("file_path") == FILE).select("id", "start_line").orderBy("start_line", "id")


@register("nodes_by_name", _sql("SELECT id, name FROM nodes WHERE name = (SELECT min(p_name) FROM part)"))
def nodes_by_name(spark, sf_dir):
    name = spark.read.parquet(f"{sf_dir}/part.parquet").agg(F.min("p_name").alias("name"))
    return graph(spark, sf_dir).nodes.join(name, "name", "left_semi").select("id", "name")


@register("nodes_by_qualified_name", _sql("SELECT id FROM nodes WHERE qualified_name = 'ASIA::NATION_2'"))
def nodes_by_qualified_name(spark, sf_dir):
    return graph(spark, sf_dir).nodes.filter("qualified_name = 'ASIA::NATION_2'").select("id")


@register("nodes_by_lower_name", _sql("SELECT id, name FROM nodes WHERE lower(name) = 'order_100'"))
def nodes_by_lower_name(spark, sf_dir):
    return graph(spark, sf_dir).nodes.filter(F.lower("name") == "order_100").select("id", "name")


@register("distinct_names", _sql("SELECT DISTINCT name FROM nodes"))
def distinct_names(spark, sf_dir):
    return graph(spark, sf_dir).nodes.select("name").distinct()


@register("outgoing_edges", _sql("SELECT target, kind, line FROM edges WHERE source = 'order:100'"))
def outgoing_edges(spark, sf_dir):
    return graph(spark, sf_dir).edges.filter(F.col("source") == START).select("target", "kind", "line")


@register("incoming_edges", _sql("SELECT source, kind, line FROM edges WHERE target = 'part:10' AND kind IN ('calls', 'references')"))
def incoming_edges(spark, sf_dir):
    return graph(spark, sf_dir).edges.filter("target = 'part:10' AND kind IN ('calls', 'references')").select("source", "kind", "line")


@register("induced_edges", _sql(", s AS (SELECT id FROM nodes WHERE kind IN ('class', 'namespace')) SELECT source, target, kind FROM edges WHERE source IN (SELECT id FROM s) AND target IN (SELECT id FROM s)"))
def induced_edges(spark, sf_dir):
    g = graph(spark, sf_dir)
    _, edges = structure.filtered_subgraph(g, F.col("kind").isin("class", "namespace"))
    return edges.select("source", "target", "kind")


# structure


@register("usages", _sql("SELECT n.id, n.name, n.kind, n.file_path, e.kind AS edge_kind, e.line FROM edges e JOIN nodes n ON n.id = e.source WHERE e.target = 'part:10'"))
def usages(spark, sf_dir):
    return structure.usages(graph(spark, sf_dir), "part:10")


@register("children", _sql("SELECT n.id, n.kind, n.name FROM edges e JOIN nodes n ON n.id = e.target WHERE e.source = 'nation:3' AND e.kind = 'contains'"))
def children(spark, sf_dir):
    return structure.children(graph(spark, sf_dir), "nation:3").select("id", "kind", "name")


CONTEXT_SQL = """
SELECT 'ancestor' AS section, source AS id, kind AS edge_kind FROM edges WHERE target = 'order:100' AND kind = 'contains'
UNION ALL SELECT 'child', target, kind FROM edges WHERE source = 'order:100' AND kind = 'contains'
UNION ALL SELECT 'incoming', source, kind FROM edges WHERE target = 'order:100' AND kind <> 'contains'
UNION ALL SELECT 'outgoing', target, kind FROM edges WHERE source = 'order:100' AND kind <> 'contains'
"""


@register("node_context", _sql(CONTEXT_SQL))
def node_context(spark, sf_dir):
    return structure.context(graph(spark, sf_dir), START)


BETWEEN = ", b AS (SELECT DISTINCT s.file_path AS f, t.file_path AS t FROM edges e JOIN nodes s ON s.id = e.source JOIN nodes t ON t.id = e.target WHERE e.kind <> 'contains' AND s.file_path <> t.file_path) "


@register("file_dependencies", _sql(BETWEEN + f"SELECT t AS file_path FROM b WHERE f = '{FILE}'"))
def file_dependencies(spark, sf_dir):
    return structure.file_dependencies(graph(spark, sf_dir), FILE)


@register("file_dependents", _sql(BETWEEN + "SELECT f AS file_path FROM b WHERE t = 'lib/parts/size7.rs'"))
def file_dependents(spark, sf_dir):
    return structure.file_dependents(graph(spark, sf_dir), "lib/parts/size7.rs")


@register("file_graph", _sql("SELECT s.file_path AS source, t.file_path AS target, count(*) AS n FROM edges e JOIN nodes s ON s.id = e.source JOIN nodes t ON t.id = e.target WHERE e.kind <> 'contains' AND s.file_path <> t.file_path GROUP BY 1, 2"))
def file_graph(spark, sf_dir):
    return structure.file_graph(graph(spark, sf_dir))


@register("exported_symbols", _sql(f"SELECT id, name FROM nodes WHERE file_path = '{FILE}' AND is_exported"))
def exported_symbols(spark, sf_dir):
    return structure.exported(graph(spark, sf_dir), FILE).select("id", "name")


@register("qualified_glob", _sql("SELECT id FROM nodes WHERE qualified_name GLOB 'ASIA::*::Customer#*1' AND kind IN ('function', 'method', 'class', 'interface', 'struct', 'module', 'namespace')"))
def qualified_glob(spark, sf_dir):
    return structure.by_qualified_glob(graph(spark, sf_dir), "ASIA::*::Customer#*1").select("id")


@register("module_structure", _sql(", f AS (SELECT DISTINCT file_path, CASE WHEN contains(file_path, '/') THEN regexp_replace(file_path, '/[^/]*$', '') ELSE '.' END AS directory FROM nodes) SELECT directory, count(*) AS n_files, string_agg(file_path, ',' ORDER BY file_path) AS files FROM f GROUP BY directory"))
def module_structure(spark, sf_dir):
    return structure.module_structure(graph(spark, sf_dir))


METRICS_SQL = """
, o AS (SELECT source AS id, count(*) AS outgoing, count(DISTINCT CASE WHEN kind = 'calls' THEN target || '@' || coalesce(line, -1) END) AS calls, count(*) FILTER (kind = 'contains') AS children FROM edges GROUP BY 1),
i AS (SELECT target AS id, count(*) AS incoming, count(DISTINCT CASE WHEN kind = 'calls' THEN source || '@' || coalesce(line, -1) END) AS callers FROM edges GROUP BY 1)
SELECT id, coalesce(incoming, 0) AS incoming, coalesce(outgoing, 0) AS outgoing, coalesce(calls, 0) AS calls, coalesce(callers, 0) AS callers, coalesce(children, 0) AS children
FROM nodes LEFT JOIN o USING (id) LEFT JOIN i USING (id)
"""


@register("node_metrics", _sql(METRICS_SQL))
def node_metrics(spark, sf_dir):
    return structure.node_metrics(graph(spark, sf_dir))


@register("dead_code", _sql("SELECT id, file_path FROM nodes n WHERE kind IN ('function', 'method', 'class') AND NOT is_exported AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.target = n.id AND e.kind <> 'contains')"))
def dead_code(spark, sf_dir):
    return structure.dead_code(graph(spark, sf_dir)).select("id", "file_path")


BLAST_SQL = f"""
SELECT t.id, count(DISTINCT s.id) AS n_callers, count(DISTINCT s.file_path) AS n_files,
       count(DISTINCT CASE WHEN regexp_matches(s.file_path, '{TEST_SQL}') THEN s.file_path END) AS n_tests
FROM nodes t LEFT JOIN edges e ON e.target = t.id AND e.kind NOT IN ('contains', 'imports', 'exports') AND e.source <> t.id LEFT JOIN nodes s ON s.id = e.source
WHERE t.kind = 'struct' GROUP BY t.id
"""


@register("blast_radius", _sql(BLAST_SQL))
def blast_radius(spark, sf_dir):
    g = graph(spark, sf_dir)
    return structure.blast_radius(g, g.nodes.filter("kind = 'struct'").select("id"), is_test)


@register("test_files", _sql(f"SELECT DISTINCT file_path FROM nodes WHERE regexp_matches(file_path, '{TEST_SQL}')"))
def test_files(spark, sf_dir):
    return graph(spark, sf_dir).nodes.filter(is_test(F.col("file_path"))).select("file_path").distinct()


# traversal


@register("callers", _sql(f"SELECT source AS id, kind, line FROM edges WHERE target = 'part:10' AND source <> target AND kind IN {CALLS}"))
def callers(spark, sf_dir):
    return traversal.callers(graph(spark, sf_dir), "part:10")


@register("callers_depth3", _sql(_closure("SELECT 'part:10' AS id", f"SELECT target AS a, source AS b FROM edges WHERE kind IN {CALLS}", 3) + "SELECT id, depth FROM r WHERE depth > 0"))
def callers_depth3(spark, sf_dir):
    return traversal.callers(graph(spark, sf_dir), "part:10", 3)


@register("callees_depth4", _sql(_closure("SELECT 'order:100' AS id", f"SELECT source AS a, target AS b FROM edges WHERE kind IN {CALLS}", 4) + "SELECT id, depth FROM r WHERE depth > 0"))
def callees_depth4(spark, sf_dir):
    return traversal.callees(graph(spark, sf_dir), START, 4)


CALL_GRAPH_SQL = f"""
, up(id, depth) AS (SELECT 'order:100', 0 UNION SELECT source, depth + 1 FROM up JOIN edges ON target = id WHERE depth < 2 AND kind IN {CALLS}),
down(id, depth) AS (SELECT 'order:100', 0 UNION SELECT target, depth + 1 FROM down JOIN edges ON source = id WHERE depth < 2 AND kind IN {CALLS})
SELECT 'order:100' AS id, 'focal' AS side UNION ALL SELECT DISTINCT id, 'caller' FROM up WHERE id <> 'order:100' UNION ALL SELECT DISTINCT id, 'callee' FROM down WHERE id <> 'order:100'
"""


@register("call_graph", _sql(CALL_GRAPH_SQL))
def call_graph(spark, sf_dir):
    return traversal.call_graph(graph(spark, sf_dir), START)


@register("bfs_both", _sql(_closure("SELECT 'nation:3' AS id", "SELECT source AS a, target AS b FROM edges WHERE kind = 'contains' UNION ALL SELECT target, source FROM edges WHERE kind = 'contains'", 2) + "SELECT id, depth FROM r"))
def bfs_both(spark, sf_dir):
    return traversal.bfs(graph(spark, sf_dir), "nation:3", "both", ("contains",), max_depth=2, limit=1_000_000)


@register("bfs_node_kinds", _sql(", ok AS (SELECT id FROM nodes WHERE kind IN ('method', 'class'))" + _closure("SELECT 'order:100' AS id", "SELECT source AS a, target AS b FROM edges WHERE target IN (SELECT id FROM ok)", 50) + "SELECT id, depth FROM r"))
def bfs_node_kinds(spark, sf_dir):
    return traversal.bfs(graph(spark, sf_dir), START, node_kinds=("method", "class"), max_depth=50, limit=1_000_000)


HIERARCHY_SQL = (
    ", up(id, depth) AS (SELECT 'supplier:5', 0 UNION SELECT target, depth + 1 FROM up JOIN edges ON source = id WHERE kind IN ('extends', 'implements') AND depth < 9),"
    " down(id, depth) AS (SELECT 'supplier:5', 0 UNION SELECT source, depth + 1 FROM down JOIN edges ON target = id WHERE kind IN ('extends', 'implements') AND depth < 9)"
    " SELECT id, 'ancestor' AS side, min(depth) AS depth FROM up WHERE depth > 0 GROUP BY id UNION ALL SELECT id, 'descendant', min(depth) FROM down WHERE depth > 0 GROUP BY id"
)


@register("type_hierarchy", _sql(HIERARCHY_SQL))
def type_hierarchy(spark, sf_dir):
    return traversal.type_hierarchy(graph(spark, sf_dir), "supplier:5")


IMPACT_SQL = """
, holds AS (SELECT source AS a, target AS b FROM edges e JOIN nodes n ON n.id = e.source WHERE e.kind = 'contains' AND n.kind IN ('class', 'interface', 'struct', 'trait', 'protocol', 'module', 'enum')),
step AS (SELECT a, b, 0 AS cost FROM holds UNION ALL SELECT target, source, 1 FROM edges WHERE kind <> 'contains'),
walk(id, depth) AS (SELECT 'customer:3', 0 UNION SELECT b, depth + cost FROM walk JOIN step ON id = a WHERE depth + cost <= 2)
SELECT id, min(depth) AS depth FROM walk GROUP BY id
"""


@register("impact_radius", _sql(IMPACT_SQL))
def impact_radius(spark, sf_dir):
    return traversal.impact(graph(spark, sf_dir), "customer:3", 2)


ENDS_SQL = ", chain AS (SELECT target AS last FROM edges WHERE kind = 'calls' AND source LIKE 'order:%' AND target LIKE 'order:%')"


@register("shortest_path_length", _sql(_closure("SELECT 'region:2' AS id", "SELECT source AS a, target AS b FROM edges", 6) + "SELECT CAST(depth + 1 AS BIGINT) AS nodes FROM r WHERE id = 'supplier:7'"))
def shortest_path_length(spark, sf_dir):
    path = traversal.shortest_path(graph(spark, sf_dir), "region:2", "supplier:7", max_depth=6)
    return path.agg(F.count("*").alias("nodes")).filter("nodes > 0")


@register("ancestors", _sql(", walk(id, depth) AS (SELECT 'order:100', 0 UNION SELECT source, depth + 1 FROM walk JOIN edges ON target = id AND kind = 'contains') SELECT id, depth FROM walk WHERE depth > 0"))
def ancestors(spark, sf_dir):
    return traversal.ancestors(graph(spark, sf_dir), START)


EVENT_EDGES = """
SELECT DISTINCT user_id AS source, next AS target FROM (
    SELECT user_id, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS next FROM {events}) e WHERE next IS NOT NULL
"""
CYCLE_SQL = f"""
WITH RECURSIVE e AS ({EVENT_EDGES.format(events="events")}),
w(f, path, nxt) AS (SELECT source, [source], target FROM e WHERE target >= source
    UNION ALL SELECT f, list_append(path, nxt), e.target FROM w JOIN e ON e.source = nxt WHERE len(path) < 3 AND nxt > f AND NOT list_contains(path, nxt) AND e.target >= f)
SELECT array_to_string(path, '>') AS cycle, len(path)::INT AS length FROM w WHERE nxt = f
"""


@register("circular_dependencies", CYCLE_SQL)
def circular_dependencies(spark, sf_dir):
    edges = spark.sql(EVENT_EDGES, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return traversal.simple_cycles(edges, 3)


CHAIN_SQL = """
, step AS (SELECT DISTINCT source AS a, target AS b FROM edges WHERE kind = 'calls'),
w(path, last_id) AS (SELECT [id], id FROM (SELECT 'order:' || (n_nationkey * 7 + 1) AS id FROM nation WHERE n_nationkey < 5) s UNION ALL SELECT list_append(path, b), b FROM w JOIN step ON a = last_id WHERE len(path) < 6 AND NOT list_contains(path, b))
SELECT array_to_string(path, '>') AS chain, len(path)::INT AS length FROM w WHERE len(path) >= 3
"""


@register("call_chains", _sql(CHAIN_SQL))
def call_chains(spark, sf_dir):
    g = graph(spark, sf_dir)
    starts = spark.createDataFrame([(f"order:{n * 7 + 1}",) for n in range(5)], "id string")
    steps = traversal.arcs(g.edges, kinds=("calls",)).distinct()
    return traversal.call_chains(steps, starts)


AFFECTED_SQL = _closure("SELECT id FROM nodes WHERE file_path = 'lib/parts/size7.rs'", "SELECT target AS a, source AS b FROM edges WHERE kind = 'calls'", 3)
AFFECTED_SQL += f"SELECT DISTINCT file_path FROM nodes WHERE id IN (SELECT id FROM r) AND regexp_matches(file_path, '{TEST_SQL}')"


@register("affected_tests", _sql(AFFECTED_SQL))
def affected_tests(spark, sf_dir):
    changed = spark.createDataFrame([("lib/parts/size7.rs",)], "file_path string")
    return traversal.affected_files(graph(spark, sf_dir), changed, 3, is_test)


# dedupes and changes


@register("distinct_edges", _sql("SELECT DISTINCT source, target, kind, coalesce(line, -1) AS line FROM edges"))
def distinct_edges(spark, sf_dir):
    null = lambda t: F.lit(None).cast(t)
    e = graph(spark, sf_dir).edges.select("*", null("int").alias("col"), null("string").alias("provenance"), null("map<string,string>").alias("metadata"))
    return mutate.distinct_edges(e).select("source", "target", "kind", F.coalesce("line", F.lit(-1)).alias("line"))


@register("stored_edge_dedupe", _sql("SELECT source, target, kind, min(line) AS line FROM edges WHERE kind IN ('calls', 'references', 'instantiates') GROUP BY 1, 2, 3"))
def stored_edge_dedupe(spark, sf_dir):
    e = graph(spark, sf_dir).edges.filter("kind IN ('calls', 'references', 'instantiates')")
    return mutate.first_wins(e, ["source", "target", "kind"], "line").select("source", "target", "kind", "line")


@register("dangling_edges_dropped", _sql("SELECT count(*) AS n FROM edges WHERE source IN (SELECT id FROM nodes WHERE kind <> 'struct') AND target IN (SELECT id FROM nodes WHERE kind <> 'struct')"))
def dangling_edges_dropped(spark, sf_dir):
    g = graph(spark, sf_dir)
    return mutate.attached(g.edges, g.nodes.filter("kind <> 'struct'")).agg(F.count("*").alias("n"))


@register("delete_cascade", _sql("SELECT kind, count(*) AS n FROM edges WHERE source NOT IN (SELECT id FROM nodes WHERE file_path = 'lib/parts/size7.rs') AND target NOT IN (SELECT id FROM nodes WHERE file_path = 'lib/parts/size7.rs') GROUP BY kind"))
def delete_cascade(spark, sf_dir):
    g = graph(spark, sf_dir)
    gone = g.nodes.filter("file_path = 'lib/parts/size7.rs'").select("id")
    return mutate.without_nodes(g.nodes, g.edges, gone)[1].groupBy("kind").agg(F.count("*").alias("n"))


CHANGES_SQL = """
WITH f AS (SELECT concat_ws('/', source, lang, doc_id) AS path, sha256(text) AS h, lang, source FROM documents),
o AS (SELECT * FROM f WHERE lang <> 'es'), n AS (SELECT path, CASE WHEN lang = 'de' THEN 'x' ELSE h END AS h FROM f WHERE source <> 'src1')
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM o FULL JOIN n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.h <> n.h
"""


@register("changed_files", CHANGES_SQL)
def changed_files(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("h"))
    old = d.filter("lang <> 'es'").select("path", F.col("h").alias("content_hash"))
    new = d.filter("source <> 'src1'").select("path", F.when(F.col("lang") == "de", "x").otherwise(F.col("h")).alias("content_hash"))
    return mutate.changes(old, new)


@register("upsert_nodes", _sql(", fresh AS (SELECT id, upper(name) AS name FROM nodes WHERE kind = 'class' UNION ALL SELECT 'new:1', 'NEW') SELECT id, name FROM fresh UNION ALL SELECT id, name FROM nodes WHERE id NOT IN (SELECT id FROM fresh)"))
def upsert_nodes(spark, sf_dir):
    n = graph(spark, sf_dir).nodes.select("id", "kind", "name")
    fresh = n.filter("kind = 'class'").select("id", F.upper("name").alias("name")).union(spark.createDataFrame([("new:1", "NEW")], "id string, name string"))
    return mutate.upsert(n.select("id", "name"), fresh, ["id"])


@register("file_diversity_cap", _sql("SELECT id, file_path FROM (SELECT id, file_path, row_number() OVER (PARTITION BY file_path ORDER BY start_line DESC, id) AS k FROM nodes WHERE kind = 'method') r WHERE k <= 5"))
def file_diversity_cap(spark, sf_dir):
    n = graph(spark, sf_dir).nodes.filter("kind = 'method'")
    return mutate.capped(n, ["file_path"], 5, F.desc("start_line"), "id").select("id", "file_path")


# aggregates

STATUS_SQL = """
SELECT 'nodes' AS measure, '' AS name, count(*) AS n FROM nodes UNION ALL SELECT 'nodes_by_kind', kind, count(*) FROM nodes GROUP BY kind
UNION ALL SELECT 'nodes_by_language', language, count(*) FROM nodes GROUP BY language UNION ALL SELECT 'edges', '', count(*) FROM edges
UNION ALL SELECT 'edges_by_kind', kind, count(*) FROM edges GROUP BY kind UNION ALL SELECT 'files', '', count(DISTINCT file_path) FROM nodes
"""


@register("status_counts", _sql(STATUS_SQL))
def status_counts(spark, sf_dir):
    g = graph(spark, sf_dir)
    return stats.status_counts(g, g.nodes.select("file_path").distinct())


@register("dominant_files", _sql(f"SELECT s.file_path, count(*) AS internal_edges FROM edges e JOIN nodes s ON s.id = e.source JOIN nodes t ON t.id = e.target WHERE e.kind <> 'contains' AND s.file_path = t.file_path AND NOT regexp_matches(s.file_path, '{TEST_SQL}') GROUP BY 1 HAVING count(*) >= 20 ORDER BY 2 DESC, 1 LIMIT 20"))
def dominant_files(spark, sf_dir):
    return stats.dominant_files(graph(spark, sf_dir), low_value=is_test)


TURNS_SQL = "WITH t AS (SELECT conv_id AS run, turn AS ord, role AS tool, length(text) AS chars FROM conversations) "


def _turns(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select(F.col("conv_id").alias("run"), F.col("turn").alias("ord"), F.col("role").alias("tool"), F.length("text").alias("chars"))


@register("run_metrics", TURNS_SQL + "SELECT run, count(*) AS n, count(*) FILTER (tool = 'user') AS n_user, count(*) FILTER (tool = 'assistant') AS n_assistant, count(*) FILTER (tool = 'system') AS n_system, sum(chars)::BIGINT AS chars, max(ord) AS last FROM t GROUP BY run")
def run_metrics(spark, sf_dir):
    return stats.run_metrics(_turns(spark, sf_dir))


@register("sequence_after_first", TURNS_SQL + ", f AS (SELECT run, min(ord) AS first FROM t WHERE tool = 'assistant' GROUP BY run) SELECT run, count(*) FILTER (ord < first) AS n_before, count(*) FILTER (ord > first) AS n_after FROM t JOIN f USING (run) GROUP BY run")
def sequence_after_first(spark, sf_dir):
    return stats.after_first(_turns(spark, sf_dir), "assistant")


@register("arm_report", TURNS_SQL + ", r AS (SELECT run, count(*) AS n, sum(chars) AS chars FROM t GROUP BY run) SELECT run % 4 AS arm, count(*) AS runs, round(median(chars), 6)::DOUBLE AS median_chars, round(avg(n), 6) AS mean_turns, round(avg(chars), 6) AS mean_chars FROM r GROUP BY 1")
def arm_report(spark, sf_dir):
    return stats.arm_report(_turns(spark, sf_dir), lambda run: run % 4)


@register("tool_tally", TURNS_SQL + "SELECT tool, count(*) AS n, sum(chars)::BIGINT AS chars FROM t GROUP BY tool")
def tool_tally(spark, sf_dir):
    return _turns(spark, sf_dir).groupBy("tool").agg(F.count("*").alias("n"), F.sum("chars").cast("long").alias("chars"))


RETRIEVAL_SQL = """
WITH e AS (SELECT source AS c, doc_id AS item FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
k AS (SELECT source AS c, doc_id AS item, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
m AS (SELECT e.c, e.item, k.rank FROM e LEFT JOIN k ON k.c = e.c AND k.item = e.item AND k.rank <= 10)
SELECT c AS "case", count(*) AS n_expected, count(rank) AS n_found, round(count(rank) / count(*), 6) AS recall, round(coalesce(1 / min(rank), 0), 6) AS mrr, count(rank) / count(*) >= 0.5 AS passed FROM m GROUP BY c
"""


@register("retrieval_scores", RETRIEVAL_SQL)
def retrieval_scores(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("case"), F.col("doc_id").alias("item"), "n_chars")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select(F.col("doc_id").alias("item"))
    ranked = mutate.capped(d.withColumn("_o", -F.col("n_chars")), ["case"], 10, "_o", "item")
    from pyspark.sql import Window

    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("case").orderBy("_o", "item"))).select("case", "item", "rank")
    return stats.retrieval_scores(d.join(good, "item", "left_semi").select("case", "item"), ranked)
