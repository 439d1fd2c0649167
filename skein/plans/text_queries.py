"""Queries of extraction, files and change streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import extract, routes, templates
from skein.graphview import FILES_PRELUDE, files, read
from skein.plans.registry import register
from skein.sources.paths import is_generated, is_ignored, language
from skein.streaming import watch


def _source(spark, sf_dir):
    """A source file for each nation, with a class of three lines for each customer."""
    c = read(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("export class C"), key, F.lit(" extends Base {\n  run(a) { return call"), key, F.lit("(a); }\n}\n"))
    rows = c.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", text.alias("t")))).alias("all"))
    body = F.array_join(F.transform("all", lambda x: x["t"]), "")
    return rows.select(F.concat(F.lit("app/n"), F.col("c_nationkey").cast("string"), F.lit(".ts")).alias("path"), F.lit("typescript").alias("language"), body.alias("content"))


SYMBOLS_SQL = """
WITH c AS (SELECT 'app/n' || c_nationkey || '.ts' AS file_path, c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) * 3 + 1 AS line FROM customer),
n AS (SELECT 'class' AS kind, 'C' || c_custkey AS name, 'C' || c_custkey AS qualified_name, file_path, line AS start_line, line + 2 AS end_line FROM c
  UNION ALL SELECT 'method', 'run', 'C' || c_custkey || '::run', file_path, line + 1, line + 1 FROM c
  UNION ALL SELECT 'file', split_part(file_path, '/', 2), split_part(file_path, '/', 2), file_path, 1, max(line) + 3 FROM c GROUP BY file_path)
SELECT CASE kind WHEN 'file' THEN 'file:' || file_path ELSE kind || ':' || substr(sha256(file_path || ':' || kind || ':' || name || ':' || start_line), 1, 32) END AS id,
  kind, name, qualified_name, file_path, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line FROM n
"""


@register("extract_symbols", SYMBOLS_SQL)
def extract_symbols(spark, sf_dir):
    nodes, _, _ = extract.split(extract.extract(_source(spark, sf_dir)))
    return nodes.select("id", "kind", "name", "qualified_name", "file_path", "start_line", "end_line")


REFS_SQL = """
WITH c AS (SELECT 'app/n' || c_nationkey || '.ts' AS file_path, c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) * 3 + 1 AS line FROM customer)
SELECT file_path, 'Base' AS reference_name, 'extends' AS reference_kind, CAST(line AS INT) AS line FROM c UNION ALL SELECT file_path, 'call' || c_custkey, 'calls', CAST(line + 1 AS INT) FROM c
"""


@register("extract_references", REFS_SQL)
def extract_references(spark, sf_dir):
    _, _, refs = extract.split(extract.extract(_source(spark, sf_dir)))
    return refs.select("file_path", "reference_name", "reference_kind", "line")


ROUTE_SQL = """
SELECT 'route:app/' || n_name || '.go:' || line || ':GET:/' || n_name || '/' || line AS id, 'GET /' || n_name || '/' || line AS name, 'Show' || n_nationkey AS handler
FROM nation, (SELECT unnest(range(1, 4)) AS line) l
"""


@register("extract_routes", ROUTE_SQL)
def extract_routes(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    line = lambda i: F.concat(F.lit('r.GET("/'), "n_name", F.lit(f'/{i}", h.Show'), F.col("n_nationkey").cast("string"), F.lit(")\n"))
    source = n.select(F.concat(F.lit("app/"), "n_name", F.lit(".go")).alias("path"), F.lit("go").alias("language"), F.concat(*(line(i) for i in (1, 2, 3))).alias("content"))
    return routes.routes(source).select("id", "name", "handler")


@register("page_links", "SELECT page_id, place::INT AS place, href FROM (SELECT page_id, unnest(l) AS href, generate_subscripts(l, 1) - 1 AS place FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS l FROM pages) x) y")
def page_links(spark, sf_dir):
    return templates.links(read(spark, sf_dir, "pages"))


@register("page_tags", "SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9]*)', 1)) AS tag FROM pages) x GROUP BY 1, 2")
def page_tags(spark, sf_dir):
    return templates.tags(read(spark, sf_dir, "pages"))


@register("file_hashes", FILES_PRELUDE + " SELECT path, sha256(content) AS content_hash, size FROM files")
def file_hashes(spark, sf_dir):
    return files(spark, sf_dir).select("path", "content_hash", "size")


@register("files_by_language", FILES_PRELUDE + " SELECT language, count(*) AS n, sum(size)::BIGINT AS size FROM files GROUP BY language")
def files_by_language(spark, sf_dir):
    return files(spark, sf_dir).groupBy("language").agg(F.count("*").alias("n"), F.sum("size").cast("long").alias("size"))


PATHS = "SELECT 'app/' || source || CASE lang WHEN 'en' THEN '/node_modules/' ELSE '/src/' END || doc_id || CASE lang WHEN 'de' THEN '.pb.go' WHEN 'fr' THEN '.test.ts' ELSE '.py' END AS path FROM {documents}"


@register("path_predicates", f"WITH p AS ({PATHS.format(documents='documents')}) SELECT path, CASE WHEN ends_with(path, '.py') THEN 'python' WHEN ends_with(path, '.go') THEN 'go' ELSE 'typescript' END AS language, ends_with(path, '.pb.go') AS is_generated, contains(path, '/node_modules/') AS is_ignored FROM p")
def path_predicates(spark, sf_dir):
    p = spark.sql(PATHS, documents=read(spark, sf_dir, "documents"))
    path = F.col("path")
    return p.select("path", language(path).alias("language"), is_generated(path).alias("is_generated"), is_ignored(path).alias("is_ignored"))


def _changes(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"))


BURST_SQL = """
WITH c AS (SELECT 'f' || user_id AS path, ts FROM events), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM c WINDOW w AS (PARTITION BY path ORDER BY ts)),
i AS (SELECT *, sum(opens) OVER (PARTITION BY path ORDER BY ts) AS burst FROM g)
SELECT path, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, count(*) AS n FROM i GROUP BY path, burst
"""


@register("change_bursts", BURST_SQL)
def change_bursts(spark, sf_dir):
    b = watch.bursts(_changes(spark, sf_dir), "6 hours")
    when = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return b.select("path", when("first_seen"), when("last_seen"), "n")


@register("pending_files", "SELECT 'f' || user_id AS path, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, count(*) AS n FROM events GROUP BY 1")
def pending_files(spark, sf_dir):
    when = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return watch.pending(_changes(spark, sf_dir)).select("path", when("first_seen"), when("last_seen"), "n")


@register("stale_files", "SELECT concat_ws('/', source, lang, doc_id) AS path FROM documents WHERE lang = 'fr' AND text <> ''")
def stale_files(spark, sf_dir):
    f = files(spark, sf_dir).select("path", "content_hash", "language")
    old = f.select("path", F.when(F.col("language") == "fr", F.sha2(F.lit(""), 256)).otherwise(F.col("content_hash")).alias("old"))
    return f.join(old, "path").filter("content_hash <> old").select("path")
