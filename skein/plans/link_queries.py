"""Queries of links read from text, and of what an exploration adds to a search."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.graphview import PRELUDE, Graph, graph, read
from skein.operators import explore, links, structure, traversal
from skein.plans.registry import register
from skein.sources.paths import is_test

INCLUDE_FILES = """
SELECT 'shop/c' || CAST(c_custkey AS STRING) || '/urls.py' AS path, 'import x' || chr(10) || 'urls = [include("shop.n' || CAST(c_nationkey AS STRING) || '.urls"),' || chr(10) ||
       ' include(''shop.r' || CAST(c_nationkey % 5 AS STRING) || '.urls''), include("shop.none.urls"), include("shop.n0.views")]' AS content FROM {customer}
"""
INCLUDE_NODES = """
SELECT 'file:' || path AS id, 'file' AS kind, path AS file_path FROM (
SELECT 'shop/c' || CAST(c_custkey AS STRING) || '/urls.py' AS path FROM {customer}
UNION ALL SELECT 'shop/n' || CAST(n_nationkey AS STRING) || '/urls.py' FROM {nation}
UNION ALL SELECT 'shop/r' || CAST(r_regionkey AS STRING) || '/urls/__init__.py' FROM {region}) p
"""
INCLUDE_SQL = """
SELECT 'file:shop/c' || c_custkey || '/urls.py' AS source, 'file:shop/n' || c_nationkey || '/urls.py' AS target, 'imports' AS kind, 2 AS line FROM customer
UNION ALL SELECT 'file:shop/c' || c_custkey || '/urls.py', 'file:shop/r' || c_nationkey % 5 || '/urls/__init__.py', 'imports', 3 FROM customer
"""


@register("python_includes", INCLUDE_SQL)
def python_includes(spark, sf_dir):
    customer, nation, region = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return links.python_includes(spark.sql(INCLUDE_FILES, customer=customer), spark.sql(INCLUDE_NODES, customer=customer, nation=nation, region=region))


TEST_FILES = """
SELECT 'tests/c' || CAST(c_custkey AS STRING) || '_test.js' AS path,
       '// skipped_' || CAST(c_nationkey AS STRING) || '()' || chr(10) || 'if (check_' || CAST(c_nationkey AS STRING) || ' (1)) app.run_' || CAST(c_custkey AS STRING) || '(check_' || CAST(c_nationkey AS STRING) || '(2))' AS content FROM {customer}
"""
TEST_NODES = """
SELECT 'file:tests/c' || CAST(c_custkey AS STRING) || '_test.js' AS id, 'file' AS kind, 'f' AS name, 'tests/c' || CAST(c_custkey AS STRING) || '_test.js' AS file_path, 1 AS start_line FROM {customer}
UNION ALL SELECT 'run:' || CAST(c_custkey AS STRING), 'method', 'run_' || CAST(c_custkey AS STRING), 'src/run.js', 1 FROM {customer}
UNION ALL SELECT 'check:b' || CAST(n_nationkey AS STRING), 'function', 'check_' || CAST(n_nationkey AS STRING), 'src/b.js', 1 FROM {nation}
UNION ALL SELECT 'check:a' || CAST(n_nationkey AS STRING), 'function', 'check_' || CAST(n_nationkey AS STRING), 'src/a.js', 1 FROM {nation}
UNION ALL SELECT 'skipped:' || CAST(n_nationkey AS STRING), 'function', 'skipped_' || CAST(n_nationkey AS STRING), 'src/a.js', 2 FROM {nation}
"""
TEST_CALLS_SQL = """
SELECT 'file:tests/c' || c_custkey || '_test.js' AS source, 'check:a' || c_nationkey AS target, 'calls' AS kind, 2 AS line FROM customer
UNION ALL SELECT 'file:tests/c' || c_custkey || '_test.js', 'run:' || c_custkey, 'calls', 2 FROM customer
"""


@register("test_file_calls", TEST_CALLS_SQL)
def test_file_calls(spark, sf_dir):
    customer, nation = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    return links.test_file_calls(spark.sql(TEST_FILES, customer=customer), spark.sql(TEST_NODES, customer=customer, nation=nation), is_test)


PAGE_NODES = """
SELECT 'page:' || CAST(c_custkey AS STRING) AS id, 'component' AS kind, 'Page' AS name, 'routes/c' || CAST(c_custkey AS STRING) || '/+page.svelte' AS file_path, 1 AS start_line FROM {customer}
UNION ALL SELECT 'load:' || CAST(c_custkey AS STRING), 'function', 'load', 'routes/c' || CAST(c_custkey AS STRING) || '/+page.server.ts', 4 FROM {customer} WHERE c_acctbal > 0
UNION ALL SELECT 'actions:' || CAST(c_custkey AS STRING), 'constant', 'actions', 'routes/c' || CAST(c_custkey AS STRING) || '/+page.js', 9 FROM {customer} WHERE c_nationkey < 9
UNION ALL SELECT 'other:' || CAST(c_custkey AS STRING), 'function', 'load', 'routes/c' || CAST(c_custkey AS STRING) || '/+layout.ts', 2 FROM {customer}
"""
PAGE_SQL = """
SELECT 'page:' || c_custkey AS source, 'load:' || c_custkey AS target, 'references' AS kind, 1 AS line FROM customer WHERE c_acctbal > 0
UNION ALL SELECT 'page:' || c_custkey, 'actions:' || c_custkey, 'references', 1 FROM customer WHERE c_nationkey < 9
"""


@register("page_loaders", PAGE_SQL)
def page_loaders(spark, sf_dir):
    return links.page_loaders(spark.sql(PAGE_NODES, customer=read(spark, sf_dir, "customer")))


GIN_FILES = """
SELECT 'web/c' || CAST(c_custkey AS STRING) || '.go' AS path, 'r.Use(Log' || CAST(c_nationkey AS STRING) || '(a, b(c)), mid.Auth' || CAST(c_custkey % 7 AS STRING) || ') // r.Use(Never)' || chr(10) ||
       'r.GET("/a//b", func() {{}}, h.Show' || CAST(c_custkey AS STRING) || ')' AS content FROM {customer}
"""
GIN_NODES = """
SELECT 'log:' || CAST(n_nationkey AS STRING) AS id, 'function' AS kind, 'Log' || CAST(n_nationkey AS STRING) AS name, 'go' AS language, 'mid.go' AS file_path, 1 AS start_line FROM {nation}
UNION ALL SELECT 'auth:' || CAST(n_nationkey AS STRING), 'function', 'Auth' || CAST(n_nationkey AS STRING), 'go', 'mid.go', 2 FROM {nation}
UNION ALL SELECT 'show:' || CAST(c_custkey AS STRING), 'method', 'Show' || CAST(c_custkey AS STRING), 'go', 'h.go', 3 FROM {customer}
UNION ALL SELECT 'never', 'function', 'Never', 'go', 'mid.go', 3
UNION ALL SELECT 'next:' || CAST(r_regionkey AS STRING), 'method', 'Context.Next' || CAST(r_regionkey AS STRING), 'go', 'gin.go', 4 FROM {region}
"""
GIN_SQL = """
WITH h AS (SELECT DISTINCT 'Log' || c_nationkey AS name, 'log:' || c_nationkey AS target FROM customer UNION SELECT DISTINCT 'Auth' || c_custkey % 7, 'auth:' || c_custkey % 7 FROM customer
           UNION SELECT 'Show' || c_custkey, 'show:' || c_custkey FROM customer),
f AS (SELECT * FROM h ORDER BY name LIMIT 40)
SELECT 'next:' || r_regionkey AS source, target, 'calls' AS kind, 4 AS line FROM region, f
"""


@register("gin_chain", GIN_SQL)
def gin_chain(spark, sf_dir):
    customer, nation, region = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    nodes = spark.sql(GIN_NODES, customer=customer, nation=nation, region=region)
    bodies = nodes.filter("kind = 'method'").select("id", F.when(F.col("id").startswith("next:"), "c.handlers[c.index](c)").otherwise("c.JSON(200)").alias("body"))
    return links.gin_chain(bodies, spark.sql(GIN_FILES, customer=customer), nodes)


CALLER_BODIES = """
SELECT 'o' || CAST(o_orderkey AS STRING) AS id, CASE WHEN o_orderstatus = 'F' THEN 'apps/web/a.ts' ELSE 'lib/a.ts' END AS file_path,
       'x = price_' || CAST(o_custkey AS STRING) || ' (1) + my_rate_' || CAST(o_custkey AS STRING) || '; rate_' || CAST(o_custkey AS STRING) || '[0]; f(2)' AS body FROM {orders}
"""
CALLER_TARGETS = """
SELECT 'price:' || CAST(c_custkey AS STRING) AS id, 'price_' || CAST(c_custkey AS STRING) AS name, CASE WHEN c_acctbal > 0 THEN 'apps/web/p.ts' ELSE 'lib/p.ts' END AS file_path FROM {customer}
UNION ALL SELECT 'rate:' || CAST(c_custkey AS STRING), 'rate_' || CAST(c_custkey AS STRING), 'lib/p.ts' FROM {customer}
UNION ALL SELECT 'f', 'f', 'lib/p.ts'
"""
CALLER_SQL = "SELECT 'o' || o_orderkey AS source, 'price:' || o_custkey AS target FROM orders JOIN customer ON o_custkey = c_custkey WHERE (o_orderstatus = 'F') = (c_acctbal > 0)"


@register("text_callers", CALLER_SQL)
def text_callers(spark, sf_dir):
    return links.text_callers(spark.sql(CALLER_BODIES, orders=read(spark, sf_dir, "orders")), spark.sql(CALLER_TARGETS, customer=read(spark, sf_dir, "customer")))


DEPENDENT_FILES = """
SELECT 'web/n' || CAST(c_nationkey AS STRING) || '/c' || CAST(c_custkey AS STRING) || '.ts' AS path,
       CASE WHEN c_nationkey % 2 = 0 THEN 'import x from "../n3/base"' ELSE 'import x from ''./base''' END AS content FROM {customer}
"""
DEPENDENT_SQL = "SELECT 'web/n' || c_nationkey || '/c' || c_custkey || '.ts' AS path FROM customer WHERE c_nationkey % 2 = 0 OR c_nationkey = 3"


@register("text_dependents", DEPENDENT_SQL)
def text_dependents(spark, sf_dir):
    return links.text_dependents(spark.sql(DEPENDENT_FILES, customer=read(spark, sf_dir, "customer")), "web/n3/base.ts")


@register("families", PRELUDE + """
SELECT n.id, n.name, n.file_path, f.n FROM nodes n JOIN (SELECT target, count(*) AS n FROM edges WHERE kind IN ('implements', 'extends') GROUP BY target HAVING count(*) >= 3) f ON f.target = n.id
WHERE n.kind IN ('class', 'interface')""")  # fmt: skip
def families(spark, sf_dir):
    return explore.families(graph(spark, sf_dir))


@register("family_files", PRELUDE + """
, f AS (SELECT target FROM edges WHERE kind IN ('implements', 'extends') AND target IN (SELECT id FROM nodes WHERE kind IN ('class', 'interface')) GROUP BY target HAVING count(*) >= 3)
SELECT DISTINCT file_path FROM nodes WHERE id IN (SELECT source FROM edges WHERE kind IN ('implements', 'extends') AND target IN (SELECT target FROM f))""")  # fmt: skip
def family_files(spark, sf_dir):
    return explore.family_files(graph(spark, sf_dir))


@register("unique_callables", PRELUDE + """
, t AS (SELECT DISTINCT name AS token FROM nodes UNION SELECT DISTINCT qualified_name FROM nodes WHERE kind = 'method'),
m AS (SELECT name, qualified_name, file_path FROM nodes WHERE kind = 'method'),
f AS (SELECT name AS token, qualified_name, file_path FROM m UNION SELECT qualified_name, qualified_name, file_path FROM m)
SELECT token, min(file_path) AS file_path FROM f WHERE token IN (SELECT token FROM t) GROUP BY token HAVING count(*) = 1""")  # fmt: skip
def unique_callables(spark, sf_dir):
    nodes = graph(spark, sf_dir).nodes
    tokens = nodes.select(F.col("name").alias("token")).union(nodes.filter("kind = 'method'").select("qualified_name"))
    return explore.unique_callables(nodes, tokens)


TITLED = ", s AS (SELECT id, file_path, start_line, upper(name[1]) || split_part(name, ' ', 1)[2:] || upper(split_part(name, ' ', 2)[1]) || split_part(name, ' ', 2)[2:] AS name FROM nodes WHERE kind = 'struct')"


def _titled(g: Graph):
    return g.nodes.filter("kind = 'struct'").withColumn("name", F.regexp_replace(F.initcap("name"), " ", ""))


@register("inner_matches", PRELUDE + TITLED + """
, w AS (SELECT * FROM (VALUES ('Anvil'), ('Gear'), ('Widget')) w(word)),
h AS (SELECT id, file_path, start_line, word, 8.0 + greatest(6.0 - (length(name) - length(word)) / 4.0, 0.0) AS score FROM s JOIN w ON strpos(name, word) > 1),
r AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY word ORDER BY score DESC, file_path, start_line, id) <= 40)
SELECT id, (score * 2)::DOUBLE AS score FROM r ORDER BY score DESC, file_path, start_line, id LIMIT 20""")  # fmt: skip
def inner_matches(spark, sf_dir):
    return explore.inner_matches(_titled(graph(spark, sf_dir)), ["anvil", "gear", "ANVIL", "widget"], "zz", 20)


@register("compound_matches", PRELUDE + TITLED + """
SELECT id, (30.0 + greatest(6.0 - length(name) / 8.0, 0.0))::DOUBLE AS score FROM s WHERE name IN ('BlueAnvil', 'BlueGear') ORDER BY score DESC, file_path, start_line, id LIMIT 10""")  # fmt: skip
def compound_matches(spark, sf_dir):
    return explore.compound_matches(_titled(graph(spark, sf_dir)), ["blue", "anvil", "gear"], "zz", 20)


@register("definitions_behind", PRELUDE + """
SELECT id, max(score)::DOUBLE AS score FROM (SELECT id, 1.0 AS score FROM nodes WHERE kind <> 'namespace'
UNION ALL SELECT e.target, 2.0 FROM edges e JOIN nodes n ON n.id = e.source AND n.kind = 'namespace' WHERE e.kind = 'contains') x GROUP BY id""")  # fmt: skip
def definitions_behind(spark, sf_dir):
    """Nations stand for imports, what they contain for what these name."""
    g = graph(spark, sf_dir)
    kind = F.when(F.col("kind") == "namespace", "import").otherwise(F.col("kind"))
    nodes, edges = g.nodes.withColumn("kind", kind), g.edges.withColumn("kind", F.when(F.col("kind") == "contains", "imports").otherwise(F.col("kind")))
    return explore.definitions_behind(nodes.select("id", F.when(F.col("kind") == "import", 2.0).otherwise(1.0).alias("score")), Graph(nodes, edges))


CYCLIC_SQL = PRELUDE + """
, place AS (SELECT id, file_path FROM nodes),
fe AS (SELECT DISTINCT s.file_path AS a, t.file_path AS b FROM edges e JOIN place s ON s.id = e.source JOIN place t ON t.id = e.target WHERE e.kind <> 'contains' AND s.file_path <> t.file_path),
reach(a, b) AS (SELECT a, b FROM fe UNION SELECT r.a, fe.b FROM reach r JOIN fe ON fe.a = r.b)
SELECT x.a AS id, min(x.b) AS component FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY x.a
"""


@register("cyclic_files", CYCLIC_SQL)
def cyclic_files(spark, sf_dir):
    """Files on cycles of any length in the graph of files."""
    return traversal.cyclic_groups(structure.file_graph(graph(spark, sf_dir)))
