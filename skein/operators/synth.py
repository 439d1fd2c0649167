"""Inferred edges: one function for each pass; merging keeps the first pass that found a pair.

Each pass returns (source, target, kind, synthesized_by). Caps on fan-out are windows, so no pass
emits more than its cap for a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.graphview import Graph
from skein.operators.structure import directory

FANOUT, EMITTER_CAP, CLOSURE_CAP = 40, 6, 8


def _edges(df: DataFrame, source: str, target: str, by: str, kind: str = "calls") -> DataFrame:
    return df.select(F.col(source).alias("source"), F.col(target).alias("target"), F.lit(kind).alias("kind"), F.lit(by).alias("synthesized_by")).distinct()


def merge(*passes: DataFrame) -> DataFrame:
    """The first edge of each (source, target), in the order of passes."""
    every = None
    for i, p in enumerate(passes):
        p = p.withColumn("_pass", F.lit(i))
        every = p if every is None else every.unionByName(p)
    first = F.row_number().over(Window.partitionBy("source", "target").orderBy("_pass", "kind"))
    return every.withColumn("_k", first).filter("_k = 1").drop("_k", "_pass")


def members(g: Graph, kinds: tuple[str, ...] = ("method", "function")) -> DataFrame:
    """(owner, id, name, start_line): what containers hold."""
    inner = g.nodes.filter(F.col("kind").isin(*kinds)).select(F.col("id").alias("target"), "name", "start_line")
    held = g.edges.filter("kind = 'contains'").select("source", "target")
    return held.join(inner, "target").select(F.col("source").alias("owner"), F.col("target").alias("id"), "name", "start_line")


def overrides(g: Graph, relations: tuple[str, ...] = ("extends", "implements"), cap: int = FANOUT, by: str = "override") -> DataFrame:
    """From a member of a supertype to the member of that name in each subtype, so many for each of the former."""
    held = members(g)
    up = g.edges.filter(F.col("kind").isin(*relations)).select(F.col("source").alias("sub"), F.col("target").alias("super"))
    met = up.join(held.select(F.col("owner").alias("super"), F.col("id").alias("base"), "name"), "super").join(held.select(F.col("owner").alias("sub"), F.col("id").alias("impl"), "name"), ["sub", "name"])
    rank = F.row_number().over(Window.partitionBy("base").orderBy("impl"))
    return _edges(met.select("base", "impl").distinct().withColumn("_k", rank).filter(F.col("_k") <= cap), "base", "impl", by)


def structural_implements(types: DataFrame, contracts: DataFrame) -> DataFrame:
    """types(type, method), contracts(contract, method): types that have every method of a contract.
    Division by counting: matched methods equal the contract's."""
    size = contracts.distinct().groupBy("contract").agg(F.count("*").alias("n"))
    met = types.distinct().join(contracts.distinct(), "method").groupBy("type", "contract").agg(F.count("*").alias("m"))
    return _edges(met.join(size, "contract").filter("m = n AND type <> contract"), "type", "contract", "structural-implements", "implements")


def by_channel(senders: DataFrame, receivers: DataFrame, keys: list[str], by: str, cap: int = EMITTER_CAP) -> DataFrame:
    """senders(key.., source), receivers(key.., target): joined on their channel, unless either side of a
    channel has more than cap members. Counts come first, so a busy channel never meets itself."""
    s, r = senders.distinct(), receivers.distinct()
    few = lambda df: df.groupBy(*keys).count().filter(F.col("count") <= cap).select(*keys)
    return _edges(s.join(few(s), keys, "left_semi").join(few(r), keys, "left_semi").join(r, keys).filter("source <> target"), "source", "target", by)


def event_emitters(emits: DataFrame, listens: DataFrame) -> DataFrame:
    return by_channel(emits, listens, ["event"], "event-emitter")


def field_channels(dispatchers: DataFrame, registrars: DataFrame) -> DataFrame:
    return by_channel(dispatchers, registrars, ["file_path", "field"], "field-callback", FANOUT)


def closure_collections(runs: DataFrame, appends: DataFrame) -> DataFrame:
    return by_channel(runs, appends, ["field"], "closure-collection", CLOSURE_CAP)


def counterparts(nodes: DataFrame, key: Column, differs: str, by: str) -> DataFrame:
    """Both ways between nodes of the same key that differ in a column: platforms, expect and actual."""
    n = nodes.withColumn("_key", key).select("_key", "id", differs)
    met = n.toDF("_key", "source", "_a").join(n.toDF("_key", "target", "_b"), "_key").filter("_a <> _b")
    return _edges(met, "source", "target", by)


def unique_counterparts(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """left(key, source), right(key, target): only where the key has a single target."""
    alone = right.distinct().groupBy("key").agg(F.count("*").alias("n"), F.min("target").alias("target")).filter("n = 1")
    return _edges(left.join(alone, "key"), "source", "target", by)


def suffixed(components: DataFrame, natives: DataFrame, suffixes: tuple[str, ...], by: str) -> DataFrame:
    """components(name, source), natives(name, target): a native class named as a component with a suffix."""
    forms = components.withColumn("name", F.explode(F.array(*(F.concat("name", F.lit(s)) for s in suffixes))))
    return _edges(forms.join(natives, "name"), "source", "target", by)


def siblings(g: Graph, trigger: DataFrame, name: str, by: str, cap: int = FANOUT) -> DataFrame:
    """From each of trigger(id) to the member `name` of the same owner: setState to render or build."""
    held = members(g)
    met = held.join(trigger, "id", "left_semi").select("owner", F.col("id").alias("source")).join(held.filter(F.col("name") == name).select("owner", F.col("id").alias("target")), "owner")
    rank = F.row_number().over(Window.partitionBy("target").orderBy("source"))
    return _edges(met.filter("source <> target").withColumn("_k", rank).filter(F.col("_k") <= cap), "source", "target", by)


def orphan_methods(g: Graph, receivers: DataFrame) -> DataFrame:
    """receivers(id, receiver): methods that nothing contains, given to the type of that name in their directory."""
    held = g.edges.filter("kind = 'contains'").select(F.col("target").alias("id"))
    place = g.nodes.withColumn("_dir", directory(F.col("file_path")))
    orphans = place.join(receivers, "id").join(held, "id", "left_anti").select("_dir", F.col("receiver").alias("name"), F.col("id").alias("method"))
    types = place.filter(F.col("kind").isin("struct", "class", "interface", "type_alias")).groupBy("_dir", "name").agg(F.min("id").alias("owner"))
    return _edges(orphans.join(types, ["_dir", "name"]), "owner", "method", "go-cross-file", "contains")


def mentions(bodies: DataFrame, names: DataFrame, by: str, kind: str = "references", shadows: DataFrame | None = None, per_source: int | None = None) -> DataFrame:
    """bodies(id, file_path, body), names(name, target, file_path): words of a body that name something in
    the same file, less shadows(id, name), what the body declares itself."""
    words = bodies.select("id", "file_path", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"([\p{L}_$][\p{L}\p{N}_$]*)"), 1))).alias("name"))
    met = words.join(names, ["file_path", "name"]).filter("id <> target")
    if shadows is not None:
        met = met.join(shadows, ["id", "name"], "left_anti")
    if per_source is not None:
        met = met.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy("target"))).filter(F.col("_k") <= per_source)
    return _edges(met, "id", "target", by, kind)
