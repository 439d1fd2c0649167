"""The graph view of the driver's tables: pure projections to nodes, edges and files.

The SQL is plain enough for Spark and DuckDB alike; table names are format fields. `graph()` builds
the index of a directory once a session, as the indexed store that all queries read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.scratch import cut

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

NODES_SQL = """
SELECT 'region:' || CAST(r_regionkey AS STRING) AS id, 'module' AS kind, r_name AS name, r_name AS qualified_name, 'app/regions.ts' AS file_path,
       'typescript' AS language, CAST(r_regionkey AS INT) AS start_line, TRUE AS is_exported, 'region' AS docstring, CAST(NULL AS STRING) AS signature FROM {region}
UNION ALL
SELECT 'nation:' || CAST(n_nationkey AS STRING), 'namespace', n_name, r_name || '::' || n_name, 'app/' || r_name || '/nations.ts', 'typescript',
       CAST(n_nationkey AS INT), TRUE, 'nation of ' || r_name, CAST(NULL AS STRING) FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL
SELECT 'customer:' || CAST(c_custkey AS STRING), 'class', c_name, r_name || '::' || n_name || '::' || c_name, 'app/' || r_name || '/' || n_name || '/customer.ts',
       CASE CAST(c_custkey % 2 AS INT) WHEN 0 THEN 'typescript' ELSE 'javascript' END, CAST(c_custkey % 1000 AS INT), c_acctbal > 0, c_mktsegment, 'class ' || c_name
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION ALL
SELECT 'supplier:' || CAST(s_suppkey AS STRING), 'interface', s_name, r_name || '::' || n_name || '::' || s_name, 'app/' || r_name || '/' || n_name || '/Supplier.java',
       CASE CAST(s_suppkey % 2 AS INT) WHEN 0 THEN 'java' ELSE 'kotlin' END, CAST(s_suppkey % 1000 AS INT), s_acctbal > 0, CAST(NULL AS STRING), 'interface ' || s_name
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION ALL
SELECT 'part:' || CAST(p_partkey AS STRING), 'struct', p_name, 'parts::' || p_name, 'lib/parts/size' || CAST(p_size AS STRING) || '.rs',
       CASE CAST(p_partkey % 2 AS INT) WHEN 0 THEN 'rust' ELSE 'go' END, CAST(p_partkey % 1000 AS INT), p_retailprice > 1000, p_type, 'struct ' || p_brand FROM {part}
UNION ALL
SELECT 'order:' || CAST(o_orderkey AS STRING), 'method', 'order_' || CAST(o_orderkey AS STRING), r_name || '::' || n_name || '::' || c_name || '::order_' || CAST(o_orderkey AS STRING),
       CASE WHEN o_orderkey % 10 = 0 THEN 'app/' || r_name || '/' || n_name || '/tests/order_test.ts' ELSE 'app/' || r_name || '/' || n_name || '/order.ts' END,
       CASE CAST(o_custkey % 2 AS INT) WHEN 0 THEN 'typescript' ELSE 'javascript' END, CAST(o_orderkey % 1000 AS INT), o_orderstatus = 'F', o_orderpriority, CAST(NULL AS STRING)
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

EDGES_SQL = """
SELECT 'region:' || CAST(n_regionkey AS STRING) AS source, 'nation:' || CAST(n_nationkey AS STRING) AS target, 'contains' AS kind, CAST(NULL AS INT) AS line FROM {nation}
UNION ALL
SELECT 'nation:' || CAST(c_nationkey AS STRING), 'customer:' || CAST(c_custkey AS STRING), 'contains', CAST(NULL AS INT) FROM {customer}
UNION ALL
SELECT 'nation:' || CAST(s_nationkey AS STRING), 'supplier:' || CAST(s_suppkey AS STRING), 'contains', CAST(NULL AS INT) FROM {supplier}
UNION ALL
SELECT 'customer:' || CAST(o_custkey AS STRING), 'order:' || CAST(o_orderkey AS STRING), 'contains', CAST(NULL AS INT) FROM {orders}
UNION ALL
SELECT 'order:' || CAST(l_orderkey AS STRING), 'part:' || CAST(l_partkey AS STRING),
       CASE l_returnflag WHEN 'N' THEN 'calls' WHEN 'A' THEN 'references' ELSE 'instantiates' END, CAST(l_linenumber AS INT) FROM {lineitem}
UNION ALL
SELECT before, 'order:' || CAST(o_orderkey AS STRING), 'calls', place FROM (
    SELECT o_orderkey, lag('order:' || CAST(o_orderkey AS STRING)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before,
           CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INT) AS place FROM {orders}) chained WHERE before IS NOT NULL
UNION ALL
SELECT DISTINCT 'part:' || CAST(l_partkey AS STRING), 'supplier:' || CAST(l_suppkey AS STRING), 'implements', CAST(NULL AS INT) FROM {lineitem}
"""

FILES_SQL = """
SELECT concat_ws('/', source, lang, CAST(doc_id AS STRING)) AS path, lang AS language, CAST(n_chars AS BIGINT) AS size, text AS content FROM {documents}
"""

#: For DuckDB: the view as common table expressions; queries follow after a comma or a select.
PRELUDE = "WITH RECURSIVE nodes AS (" + NODES_SQL.format(**{t: t for t in TABLES}) + "), edges AS (" + EDGES_SQL.format(**{t: t for t in TABLES}) + ")"
FILES_PRELUDE = "WITH RECURSIVE files AS (" + FILES_SQL.format(documents="documents") + ")"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Graph:
    """Nodes and edges, written once: nodes by id, edges with both of their ends' order kept by Spark."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges
        self._index = None

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    @property
    def index(self):
        """The inverted index, built when first asked for."""
        if self._index is None:
            from skein.operators.search import build_index

            self._index = build_index(self.nodes)
        return self._index


_built: dict[tuple[int, str], Graph] = {}


def project(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph view as plans over the tables, without writing anything."""
    tables = {t: read(spark, sf_dir, t) for t in TABLES}
    return Graph(spark.sql(NODES_SQL, **tables), spark.sql(EDGES_SQL, **tables))


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The indexed graph of a directory: clustered by kind, so that scans of a kind skip row groups."""
    key = (id(spark.sparkContext), sf_dir)
    if key not in _built:
        g = project(spark, sf_dir)
        _built[key] = Graph(cut(g.nodes.sortWithinPartitions("kind", "id"), "nodes"), cut(g.edges.sortWithinPartitions("kind", "source"), "edges"))
    return _built[key]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = spark.sql(FILES_SQL, documents=read(spark, sf_dir, "documents"))
    return f.withColumn("content_hash", F.sha2(F.col("content"), 256))
