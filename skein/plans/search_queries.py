"""Queries of search, resolution and inferred edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.graphview import PRELUDE, graph
from skein.operators import resolve, search, synth
from skein.plans.registry import register


def _sql(rest: str) -> str:
    return PRELUDE + rest


LIKE_SQL = """
SELECT id, name, CASE WHEN lower(name) = 'red' THEN 1.0 WHEN starts_with(lower(name), 'red') THEN 0.9 WHEN contains(lower(name), 'red') THEN 0.8
  WHEN contains(lower(qualified_name), 'red') THEN 0.7 WHEN contains(lower(coalesce(signature, '')), 'red') OR contains(lower(coalesce(docstring, '')), 'red') THEN 0.5 END::DOUBLE AS score
FROM nodes WHERE score IS NOT NULL ORDER BY score DESC, length(name), id LIMIT 100
"""


@register("like_search", _sql(LIKE_SQL))
def like_search(spark, sf_dir):
    return search.like(graph(spark, sf_dir).nodes, "red")


FUZZY_SQL = """
, d AS (SELECT name, levenshtein(lower(name), 'small rinq') AS d FROM (SELECT DISTINCT name FROM nodes WHERE length(name) BETWEEN 8 AND 12) x)
SELECT id, name, round(1 / (1 + d), 6) AS score FROM (SELECT n.id, n.name, d.d, row_number() OVER (PARTITION BY n.name ORDER BY n.id) AS k FROM nodes n JOIN d ON n.name = d.name WHERE d.d <= 2) r
WHERE k <= 5 ORDER BY score DESC, name, id LIMIT 100
"""


@register("fuzzy_search", _sql(FUZZY_SQL))
def fuzzy_search(spark, sf_dir):
    return search.fuzzy(graph(spark, sf_dir).nodes, "small rinq")


EXACT_SQL = """
, m AS (SELECT *, lower(name) AS key FROM nodes WHERE lower(name) IN ('small ring', 'red widget', 'asia')), f AS (SELECT key, count(DISTINCT file_path) AS n_files FROM m GROUP BY key)
SELECT id, name, score FROM (SELECT id, name, CASE WHEN n_files < 10 THEN 21.0 ELSE 1.0 END::DOUBLE AS score,
  row_number() OVER (PARTITION BY key ORDER BY CASE WHEN n_files < 10 THEN 21 ELSE 1 END DESC, file_path, start_line, id) AS k FROM m JOIN f USING (key)) r WHERE k <= 14
"""


@register("exact_name_search", _sql(EXACT_SQL))
def exact_name_search(spark, sf_dir):
    return search.exact_names(graph(spark, sf_dir).nodes, ["small ring", "Red Widget", "ASIA"])


@register("substring_search", _sql("SELECT id, name FROM nodes WHERE contains(lower(name), 'widget') AND NOT starts_with(lower(name), 'widget') ORDER BY length(name), name, id LIMIT 50"))
def substring_search(spark, sf_dir):
    return search.substring(graph(spark, sf_dir).nodes, "widget", True, 50)


BM25_SQL = r"""
, t AS (SELECT id, w, list_filter(string_split_regex(lower(coalesce(x, '')), '[^\p{L}\p{N}]+'), lambda y: y <> '') AS ts
        FROM (SELECT id, unnest([0.0, 20.0, 5.0, 1.0, 2.0]) AS w, unnest([id, name, qualified_name, docstring, signature]) AS x FROM nodes) c),
l AS (SELECT id, sum(len(ts)) AS length FROM t GROUP BY id), s AS (SELECT count(*) AS n_docs, avg(length) AS mean FROM l),
u AS (SELECT id, w, unnest(ts) AS term FROM t), p AS (SELECT unnest(['red', 'wid', 'promo']) AS phrase),
h AS (SELECT id, phrase, sum(w) AS tf FROM u JOIN p ON starts_with(term, phrase) GROUP BY id, phrase), f AS (SELECT phrase, count(*) AS n_hit FROM h GROUP BY phrase)
SELECT id, round(sum(greatest(ln((n_docs - n_hit + 0.5) / (n_hit + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
FROM h JOIN f USING (phrase) JOIN l USING (id), s GROUP BY id ORDER BY score DESC, id LIMIT 200
"""


@register("bm25_search", _sql(BM25_SQL))
def bm25_search(spark, sf_dir):
    g = graph(spark, sf_dir)
    return search.bm25(g.nodes, "red wid promo", 200, g.index)


FILTER_SQL = "SELECT id, name, kind, file_path, 1.0::DOUBLE AS score FROM nodes WHERE kind = 'class' AND language = 'typescript' AND contains(lower(file_path), 'asia') ORDER BY name, id LIMIT 50"


@register("filter_search", _sql(FILTER_SQL))
def filter_search(spark, sf_dir):
    return search.search(graph(spark, sf_dir).nodes, 'kind:class lang:typescript path:"asia"', 50)


BONUS_SQL = """
SELECT id, CASE kind WHEN 'method' THEN 10 WHEN 'interface' THEN 9 WHEN 'class' THEN 8 WHEN 'struct' THEN 6 ELSE 4 END AS kind_bonus,
  CASE WHEN lower(name) = 'redwidget' THEN 80.0 WHEN lower(name) IN ('red', 'widget') THEN 60.0 WHEN starts_with(lower(name), 'redwidget') THEN round(10 + 30 * 9 / length(name))
       WHEN contains(lower(name), 'red') AND contains(lower(name), 'widget') THEN 15.0 WHEN contains(lower(name), 'redwidget') THEN 10.0 ELSE 0.0 END::DOUBLE AS name_bonus
FROM nodes WHERE kind IN ('module', 'namespace', 'struct', 'interface', 'class', 'method')
"""


@register("name_and_kind_bonus", _sql(BONUS_SQL))
def name_and_kind_bonus(spark, sf_dir):
    n = graph(spark, sf_dir).nodes
    return n.select("id", search.kind_bonus(F.col("kind")).alias("kind_bonus"), search.name_bonus(F.col("name"), "red widget").alias("name_bonus"))


@register("ranked_search")
def ranked_search(spark, sf_dir):
    g = graph(spark, sf_dir)
    return search.search(g.nodes, "red widget kind:struct", 25, g.index)


# resolution: every part refers to something by name

REFS = """
SELECT p_partkey AS ref_id, 'part:' || CAST(p_partkey AS STRING) AS from_node_id, {name} AS reference_name,
       CASE CAST(p_size % 3 AS INT) WHEN 0 THEN 'calls' WHEN 1 THEN 'instantiates' ELSE 'references' END AS reference_kind, CAST(p_size AS INT) AS line,
       'lib/parts/size' || CAST(p_size AS STRING) || '.rs' AS file_path, CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN 'rust' ELSE 'go' END AS language FROM {part}
"""


def _refs(spark, sf_dir, name):
    return spark.sql(REFS.replace("{name}", name), part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def _refs_sql(name):
    return ", refs AS (" + REFS.format(name=name, part="part") + ")"


PROXIMITY = "least(80, 15 * CASE WHEN r.file_path = n.file_path OR starts_with(n.file_path, 'lib/parts/') THEN 2 ELSE 0 END)"
EXACT_RESOLVE_SQL = f"""
, m AS (SELECT r.ref_id, n.id AS target_id, n.file_path, n.start_line, r.language = n.language AS same, count(*) OVER (PARTITION BY r.ref_id) AS n, {PROXIMITY} AS prox,
    CASE WHEN r.file_path = n.file_path THEN 100 + greatest(20 - abs(n.start_line - r.line) / 10, 0) ELSE 0 END + {PROXIMITY} + CASE WHEN r.language = n.language THEN 50 ELSE -80 END
    + CASE WHEN r.reference_kind = 'instantiates' THEN 25 ELSE 0 END + CASE WHEN n.is_exported THEN 10 ELSE 0 END AS score
  FROM refs r JOIN nodes n ON n.name = r.reference_name)
SELECT ref_id, target_id, CASE WHEN same THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence FROM m WHERE n = 1
UNION ALL SELECT ref_id, target_id, CASE WHEN prox >= 30 THEN 0.7 ELSE 0.4 END FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, file_path, start_line, target_id) AS k FROM m WHERE n > 1 AND score > -1) x WHERE k = 1
"""


@register("resolve_exact", _sql(_refs_sql("p_name") + EXACT_RESOLVE_SQL))
def resolve_exact(spark, sf_dir):
    return resolve.exact(_refs(spark, sf_dir, "p_name"), graph(spark, sf_dir).nodes).select("ref_id", "target_id", "confidence")


QUALIFIED_SQL = """
, w AS (SELECT r.ref_id, n.id, count(*) OVER (PARTITION BY r.ref_id) AS n FROM refs r JOIN nodes n ON n.qualified_name = r.reference_name),
t AS (SELECT r.ref_id, n.id, row_number() OVER (PARTITION BY r.ref_id ORDER BY n.file_path, n.start_line, n.id) AS k FROM refs r JOIN nodes n ON n.name = split_part(r.reference_name, '::', 2) AND ends_with(n.qualified_name, r.reference_name))
SELECT ref_id, id AS target_id, 0.95::DOUBLE AS confidence FROM w WHERE n = 1 UNION ALL SELECT ref_id, id, 0.85 FROM t WHERE k = 1
"""


@register("resolve_qualified", _sql(_refs_sql("'parts::' || p_name") + QUALIFIED_SQL))
def resolve_qualified(spark, sf_dir):
    return resolve.qualified(_refs(spark, sf_dir, "'parts::' || p_name"), graph(spark, sf_dir).nodes).select("ref_id", "target_id", "confidence")


FUZZY_RESOLVE_SQL = """
, m AS (SELECT r.ref_id, n.id, count(*) OVER (PARTITION BY r.ref_id) AS n FROM refs r JOIN nodes n ON lower(n.name) = lower(r.reference_name) AND n.kind IN ('function', 'method', 'class'))
SELECT ref_id, id AS target_id, 0.3::DOUBLE AS confidence FROM m WHERE n = 1
"""


@register("resolve_fuzzy", _sql(_refs_sql("'CUSTOMER#' || lpad(CAST(p_partkey AS STRING), 9, '0')") + FUZZY_RESOLVE_SQL))
def resolve_fuzzy(spark, sf_dir):
    return resolve.fuzzy(_refs(spark, sf_dir, "'CUSTOMER#' || lpad(CAST(p_partkey AS STRING), 9, '0')"), graph(spark, sf_dir).nodes).select("ref_id", "target_id", "confidence")


#: These names have one strategy; references then stay within their language.
_tail = EXACT_RESOLVE_SQL[EXACT_RESOLVE_SQL.index("SELECT ref_id") :]
RESOLVED = EXACT_RESOLVE_SQL[: EXACT_RESOLVE_SQL.index("SELECT ref_id")] + f""", x AS ({_tail}),
z AS (SELECT x.*, 'exact-match' AS resolved_by, r.from_node_id, r.line, CASE WHEN r.reference_kind = 'calls' AND n.kind IN ('class', 'struct') THEN 'instantiates' ELSE r.reference_kind END AS kind
      FROM x JOIN refs r USING (ref_id) JOIN nodes n ON n.id = x.target_id WHERE r.reference_kind <> 'references' OR r.language = n.language)
"""


@register("resolve_all", _sql(_refs_sql("p_name") + RESOLVED + "SELECT ref_id, target_id, confidence, resolved_by FROM z"))
def resolve_all(spark, sf_dir):
    return resolve.resolve(_refs(spark, sf_dir, "p_name"), graph(spark, sf_dir).nodes)


@register("resolved_edges", _sql(_refs_sql("p_name") + RESOLVED + "SELECT from_node_id AS source, target_id AS target, kind, line FROM z"))
def resolved_edges(spark, sf_dir):
    refs, nodes = _refs(spark, sf_dir, "p_name"), graph(spark, sf_dir).nodes
    return resolve.to_edges(resolve.resolve(refs, nodes), refs, nodes).select("source", "target", "kind", "line")


# inferred edges

DIVISION_SQL = """
, t AS (SELECT DISTINCT target AS type, CAST(split_part(source, ':', 2) AS BIGINT) % 40 AS method FROM edges WHERE kind = 'implements'),
c AS (SELECT DISTINCT 'contract:' || n_regionkey AS contract, n_nationkey + 3 AS method FROM nation), z AS (SELECT contract, count(*) AS n FROM c GROUP BY contract), m AS (SELECT type, contract, count(*) AS m FROM t JOIN c USING (method) GROUP BY 1, 2)
SELECT type AS source, contract AS target, 'implements' AS kind FROM m JOIN z USING (contract) WHERE m = n
"""


@register("structural_implements", _sql(DIVISION_SQL))
def structural_implements(spark, sf_dir):
    e = graph(spark, sf_dir).edges.filter("kind = 'implements'")
    types = e.select(F.col("target").alias("type"), (F.element_at(F.split("source", ":"), 2).cast("long") % 40).alias("method"))
    contracts = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("contract:"), F.col("n_regionkey").cast("string")).alias("contract"), (F.col("n_nationkey") + 3).cast("long").alias("method"))
    return synth.structural_implements(types, contracts).select("source", "target", "kind")


EMITTER_SQL = """
WITH e AS (SELECT user_id || '@' || strftime(ts, '%Y-%m-%d') AS event, event_type, CAST(event_id AS STRING) AS id FROM events),
s AS (SELECT event, id AS source FROM e WHERE event_type = (SELECT min(event_type) FROM events)), r AS (SELECT event, id AS target FROM e WHERE event_type = (SELECT max(event_type) FROM events))
SELECT DISTINCT source, target FROM s JOIN r USING (event) WHERE event IN (SELECT event FROM s GROUP BY event HAVING count(*) <= 6) AND event IN (SELECT event FROM r GROUP BY event HAVING count(*) <= 6)
"""


@register("event_emitters", EMITTER_SQL)
def event_emitters(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ends = e.agg(F.min("event_type").alias("sends"), F.max("event_type").alias("hears"))
    e = e.select(F.concat_ws("@", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("event"), "event_type", F.col("event_id").cast("string").alias("id")).crossJoin(F.broadcast(ends))
    emits = e.filter("event_type = sends").select("event", F.col("id").alias("source"))
    listens = e.filter("event_type = hears").select("event", F.col("id").alias("target"))
    return synth.event_emitters(emits, listens).select("source", "target")


COUNTERPART_SQL = "SELECT a.id AS source, b.id AS target FROM nodes a JOIN nodes b ON a.name = b.name AND a.docstring = b.docstring AND a.file_path = b.file_path AND a.language <> b.language WHERE a.kind = 'struct' AND b.kind = 'struct'"


@register("cross_platform", _sql(COUNTERPART_SQL))
def cross_platform(spark, sf_dir):
    n = graph(spark, sf_dir).nodes.filter("kind = 'struct'")
    return synth.counterparts(n, F.concat_ws("|", "name", "docstring", "file_path"), "language", "cross-platform").select("source", "target")


UNIQUE_SQL = ", r AS (SELECT name AS key, min(id) AS target FROM nodes WHERE kind = 'struct' GROUP BY name HAVING count(*) = 1) SELECT n.id AS source, target FROM nodes n JOIN r ON r.key = n.name"


@register("unique_counterparts", _sql(UNIQUE_SQL))
def unique_counterparts(spark, sf_dir):
    n = graph(spark, sf_dir).nodes
    left = n.select(F.col("name").alias("key"), F.col("id").alias("source"))
    right = n.filter("kind = 'struct'").select(F.col("name").alias("key"), F.col("id").alias("target"))
    return synth.unique_counterparts(left, right, "unique").select("source", "target")


OVERRIDE_SQL = """
, held AS (SELECT source AS owner, target AS id, CAST(split_part(target, ':', 2) AS BIGINT) % 12 AS name FROM edges WHERE kind = 'contains' AND target LIKE 'order:%'),
up AS (SELECT DISTINCT 'customer:' || (c_custkey + 25) AS sub, 'customer:' || c_custkey AS super FROM customer),
m AS (SELECT DISTINCT b.id AS base, i.id AS impl FROM up JOIN held b ON b.owner = super JOIN held i ON i.owner = sub AND i.name = b.name)
SELECT base AS source, impl AS target FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY impl) AS k FROM m) x WHERE k <= 40
"""


@register("override_edges", _sql(OVERRIDE_SQL))
def override_edges(spark, sf_dir):
    from skein.graphview import Graph

    g = graph(spark, sf_dir)
    # members are named by a remainder, so that classes share names; each class extends another
    nodes = g.nodes.withColumn("name", F.when(F.col("kind") == "method", (F.element_at(F.split("id", ":"), 2).cast("long") % 12).cast("string")).otherwise(F.col("name")))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    up = c.select(F.concat(F.lit("customer:"), (F.col("c_custkey") + 25).cast("string")).alias("source"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("target"), F.lit("extends").alias("kind"), F.lit(None).cast("int").alias("line"))
    return synth.overrides(Graph(nodes, g.edges.unionByName(up)), ("extends",)).select("source", "target")


@register("task_context")
def task_context(spark, sf_dir):
    from skein.operators import context

    return context.relevant(graph(spark, sf_dir), "where is the red widget part")


@register("context_edges")
def context_edges(spark, sf_dir):
    from skein.operators import context

    g = graph(spark, sf_dir)
    _, edges = context.subgraph(g, context.relevant(g, "where is the red widget part"))
    return edges.select("source", "target", "kind", "line")
