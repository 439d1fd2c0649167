"""Reference resolution: every strategy is a join that yields candidates, and one ranking chooses.

A candidate is (ref_id, target_id, confidence, resolved_by, rank, tie...). Strategies run over all
references at once; the order in which a strategy would be tried is its rank, and ties fall by
(file_path, start_line, id), so a result never depends on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.model import LANGUAGE_FAMILIES
from skein.operators.structure import directory

#: refs need ref_id, from_node_id, reference_name, reference_kind, line, file_path, language.
CANDIDATE = ("ref_id", "target_id", "confidence", "resolved_by", "rank", "file_path", "start_line")


def family(language: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in LANGUAGE_FAMILIES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, language), language)


def shared_directories(a: Column, b: Column) -> Column:
    """How many leading directories two paths share."""
    da, db = F.split(directory(a), "/"), F.split(directory(b), "/")
    same = F.zip_with(da, db, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_off = F.array_position(same, False)
    return F.when(first_off == 0, F.size(same)).otherwise(first_off - 1)


def proximity(a: Column, b: Column) -> Column:
    return F.least(shared_directories(a, b) * 15, F.lit(80))


def last_segment(name: Column) -> Column:
    return F.regexp_extract(name, r"([^.:]+)[.:]*$", 1)


def candidate_score(refs: str = "r", nodes: str = "n") -> Column:
    """How well a node of the right name suits a reference; columns are qualified by the aliases."""
    r, n = (lambda c: F.col(f"{refs}.{c}")), (lambda c: F.col(f"{nodes}.{c}"))
    same_file = r("file_path") == n("file_path")
    kind = r("reference_kind")
    suits = (
        F.when((kind == "calls") & n("kind").isin("function", "method"), 25)
        .when((kind == "instantiates") & n("kind").isin("class", "struct", "interface"), 25)
        .when((kind == "decorates") & n("kind").isin("function", "method"), 25)
        .when((kind == "decorates") & n("kind").isin("class", "interface"), 15)
        .otherwise(0)
    )
    near = F.when(same_file, F.greatest(F.lit(20) - F.abs(n("start_line") - r("line")) / 10, F.lit(0))).otherwise(0)
    return (
        F.when(same_file, 100).otherwise(0) + proximity(r("file_path"), n("file_path")) + F.when(r("language") == n("language"), 50).otherwise(-80) + suits + F.when(n("is_exported"), 10).otherwise(0) + near
    )


def _out(df: DataFrame, confidence: Column, by: str, rank: int) -> DataFrame:
    return df.select(
        F.col("r.ref_id").alias("ref_id"), F.col("n.id").alias("target_id"), confidence.cast("double").alias("confidence"), F.lit(by).alias("resolved_by"), F.lit(rank).alias("rank"),
        F.col("n.file_path").alias("file_path"), F.col("n.start_line").alias("start_line"),
    )


def _best(df: DataFrame, *order: Column) -> DataFrame:
    tie = [F.col("n.file_path"), F.col("n.start_line"), F.col("n.id")]
    return df.withColumn("_k", F.row_number().over(Window.partitionBy("r.ref_id").orderBy(*order, *tie))).filter("_k = 1")


def _first(rows: DataFrame, *keys: str) -> DataFrame:
    """Of rows(id, file_path, start_line, ...) the first of each group of keys, with the group's size: all
    that a strategy needs to know of namesakes that it can't tell apart."""
    place = F.min(F.struct("file_path", "start_line", "id")).alias("_at")
    return rows.groupBy(*keys).agg(place, F.count("*").alias("_n")).select(*keys, "_n", "_at.*")


def exact(refs: DataFrame, nodes: DataFrame, rank: int = 6) -> DataFrame:
    """By name: a single node with 0.9 (0.5 across languages), else the best scored with 0.7 when near, 0.4 when far.

    Only within its own file does a reference's line tell nodes apart. All others compete by directory,
    language, kind and export, so references and nodes are met in groups of these, however many share a name.
    """
    named = nodes.withColumn("_dir", directory(F.col("file_path")))
    totals = nodes.groupBy("name").agg(F.count("*").alias("_total"))
    asked = refs.join(totals, F.col("reference_name") == F.col("name")).drop("name")
    singles = _first(nodes.withColumn("language_", F.col("language")), "name", "language_").select(F.col("name").alias("_name"), "language_", "file_path", "start_line", "id")
    alone = asked.filter("_total = 1").alias("r").join(singles.alias("n"), F.col("r.reference_name") == F.col("n._name"))
    single = _out(alone, F.when(F.col("r.language") == F.col("n.language_"), 0.9).otherwise(0.5), "exact-match", rank)

    many = asked.filter("_total > 1").withColumn("_dir", directory(F.col("file_path")))
    here = many.alias("r").join(named.alias("n"), (F.col("r.reference_name") == F.col("n.name")) & (F.col("r.file_path") == F.col("n.file_path")))
    near = _out(here, candidate_score(), "exact-match", rank).withColumn("_near", proximity(F.col("file_path"), F.col("file_path")) >= 30)
    groups = _first(named, "name", "_dir", "language", "kind", "is_exported").alias("n")
    keys = ["reference_name", "_dir", "language", "reference_kind"]
    # the file of a group's references stands for its directory alone: no score here asks for the same file
    askers = many.select(*keys).distinct().withColumn("file_path", F.concat("_dir", F.lit("/"))).withColumn("line", F.lit(0)).alias("r")
    met = askers.join(groups, F.col("r.reference_name") == F.col("n.name")).select(*(F.col(f"r.{k}").alias(k) for k in keys), F.col("n.id").alias("id"), F.col("n.file_path").alias("_path"), F.col("n.start_line").alias("_line"), candidate_score().alias("_score"), (proximity(F.col("r.file_path"), F.col("n.file_path")) >= 30).alias("_near"))
    best = met.groupBy(*keys).agg(F.min(F.struct((-F.col("_score")).alias("s"), "_path", "_line", "id", "_near")).alias("_b"))
    far = many.select("ref_id", *keys).join(best, keys).select(
        "ref_id", F.col("_b.id").alias("target_id"), (-F.col("_b.s")).cast("double").alias("confidence"), F.lit("exact-match").alias("resolved_by"), F.lit(rank).alias("rank"),
        F.col("_b._path").alias("file_path"), F.col("_b._line").alias("start_line"), F.col("_b._near").alias("_near"),
    )
    # here `confidence` is still the score
    order = Window.partitionBy("ref_id").orderBy(F.desc("confidence"), "file_path", "start_line", "target_id")
    chosen = near.unionByName(far).filter("confidence > -1").withColumn("_k", F.row_number().over(order)).filter("_k = 1")
    return single.unionByName(chosen.withColumn("confidence", F.when(F.col("_near"), 0.7).otherwise(0.4)).select(*CANDIDATE))


def qualified(refs: DataFrame, nodes: DataFrame, rank: int = 2) -> DataFrame:
    """By qualified name: the only one with 0.95, else a node of the last segment whose qualified name ends so, with 0.85."""
    dotted = refs.filter(F.col("reference_name").contains("::") | F.col("reference_name").contains("."))
    names = _first(nodes, "qualified_name", "name")
    whole = nodes.groupBy(F.col("qualified_name").alias("_q")).agg(F.min("id").alias("id"), F.min("file_path").alias("file_path"), F.min("start_line").alias("start_line"), F.count("*").alias("_n")).filter("_n = 1")
    alone = dotted.alias("r").join(whole.alias("n"), F.col("r.reference_name") == F.col("n._q"))
    # each name once; an equality on the last segment first: the suffix is only looked at among its namesakes
    asked = dotted.select("reference_name").distinct().withColumn("ref_id", F.col("reference_name")).withColumn("_last", last_segment(F.col("reference_name"))).alias("r")
    tail = asked.join(names.alias("n"), F.col("r._last") == F.col("n.name")).filter(F.col("n.qualified_name").endswith(F.col("r.reference_name")))
    found = _out(_best(tail), F.lit(0.85), "qualified-name", rank).withColumnRenamed("ref_id", "reference_name")
    return _out(alone, F.lit(0.95), "qualified-name", rank).unionByName(dotted.select("ref_id", "reference_name").join(found, "reference_name").select(*CANDIDATE))


def file_path(refs: DataFrame, nodes: DataFrame, rank: int = 1) -> DataFrame:
    """References that look like paths: the file itself 0.95, files that end so 0.85 (the closest)."""
    base = F.regexp_extract("reference_name", "([^/]+)$", 1)
    paths = refs.filter(F.col("reference_name").contains("/")).withColumn("_base", base).alias("r")
    files = nodes.filter("kind = 'file'").withColumn("_base", F.regexp_extract("file_path", "([^/]+)$", 1)).alias("n")
    met = paths.join(files, F.col("r._base") == F.col("n._base"))
    same = F.col("n.file_path") == F.col("r.reference_name")
    ends = same | F.col("n.file_path").endswith(F.concat(F.lit("/"), F.col("r.reference_name")))
    best = _best(met.filter(ends), same.desc(), proximity(F.col("r.file_path"), F.col("n.file_path")).desc())
    return _out(best, F.when(same, 0.95).otherwise(0.85), "file-path", rank)


def fuzzy(refs: DataFrame, nodes: DataFrame, rank: int = 7) -> DataFrame:
    """Whatever the case, callables and classes, only if single: 0.5, or 0.3 across languages."""
    callable_ = nodes.filter(F.col("kind").isin("function", "method", "class")).withColumn("_low", F.lower("name"))
    lone = callable_.groupBy("_low").agg(F.count("*").alias("_n"), *(F.min(c).alias(c) for c in ("id", "file_path", "start_line", "language"))).filter("_n = 1")
    met = refs.alias("r").join(lone.alias("n"), F.lower("r.reference_name") == F.col("n._low"))
    return _out(met, F.when(F.col("r.language") == F.col("n.language"), 0.5).otherwise(0.3), "fuzzy", rank)


def method_call(refs: DataFrame, nodes: DataFrame, rank: int = 5) -> DataFrame:
    """receiver.method or Receiver::method: a method of the class of that name 0.85, of its capitalised
    name 0.8, or the only method of that name 0.7."""
    parts = refs.withColumn("_recv", F.regexp_extract("reference_name", r"^([A-Za-z_]\w*)(\.|::)(\w+)$", 1)).withColumn("_meth", F.regexp_extract("reference_name", r"^([A-Za-z_]\w*)(\.|::)(\w+)$", 3))
    methods = nodes.filter("kind = 'method'").withColumn("_owner", F.regexp_extract("qualified_name", r"([^:.]+)(::|\.)[^:.]+$", 1))
    met = parts.filter("_meth <> ''").alias("r").join(methods.alias("n"), F.col("r._meth") == F.col("n.name"))
    capital = F.concat(F.upper(F.substring("r._recv", 1, 1)), F.expr("substring(r._recv, 2)"))
    # the same family of languages, and for a class the closest one
    met = met.filter(family(F.col("r.language")) == family(F.col("n.language"))).withColumn("_n", F.count("*").over(Window.partitionBy("r.ref_id")))
    level = F.when(F.col("n._owner") == F.col("r._recv"), 0.85).when(F.col("n._owner") == capital, 0.8).when(F.col("_n") == 1, 0.7)
    met = met.withColumn("_level", level).filter("_level IS NOT NULL")
    return _out(_best(met, F.desc("_level"), proximity(F.col("r.file_path"), F.col("n.file_path")).desc()), F.col("_level"), "instance-method", rank)


def function_ref(refs: DataFrame, nodes: DataFrame, rank: int = 3) -> DataFrame:
    """Functions used as values: in the same file 0.95 if single there, 0.9 else; elsewhere only if single, 0.8."""
    wanted = refs.filter("reference_kind = 'function_ref'")
    callables = nodes.filter(F.col("kind").isin("function", "method"))
    met = wanted.alias("r").join(callables.alias("n"), F.col("r.reference_name") == F.col("n.name")).withColumn("_here", (F.col("r.file_path") == F.col("n.file_path")).cast("int"))
    w = Window.partitionBy("r.ref_id")
    met = met.withColumn("_in_file", F.sum("_here").over(w)).withColumn("_n", F.count("*").over(w))
    here = _best(met.filter("_here = 1"))
    there = met.filter("_in_file = 0 AND _n = 1")
    return _out(here, F.when(F.col("_in_file") == 1, 0.95).otherwise(0.9), "function-ref", rank).unionByName(_out(there, F.lit(0.8), "function-ref", rank))


def via_import(refs: DataFrame, nodes: DataFrame, imports: DataFrame, rank: int = 0) -> DataFrame:
    """imports(file_path, local_name, exported_name, resolved_path): what a file's binding stands for, 0.9."""
    first = F.regexp_extract("reference_name", r"^([^.:]+)", 1)
    bound = refs.withColumn("_first", first).join(imports.select(F.col("file_path").alias("_f"), "local_name", "exported_name", "resolved_path"), (F.col("file_path") == F.col("_f")) & (F.col("_first") == F.col("local_name")))
    member = last_segment(F.col("reference_name"))
    wanted = F.when(F.col("reference_name") == F.col("local_name"), F.col("exported_name")).otherwise(member)
    met = bound.withColumn("_want", wanted).alias("r").join(nodes.alias("n"), (F.col("r._want") == F.col("n.name")) & (F.col("r.resolved_path") == F.col("n.file_path")))
    return _out(_best(met, F.desc("n.is_exported")), F.lit(0.9), "import", rank)


def jvm_import(refs: DataFrame, nodes: DataFrame, rank: int = 0) -> DataFrame:
    """`pkg.Sym` as the qualified name `pkg::Sym`, 0.95; the closest, and of a pair the expected side."""
    jvm = refs.filter((family(F.col("language")) == "jvm") & F.col("reference_name").contains(".")).withColumn("_q", F.regexp_replace("reference_name", r"\.([^.]+)$", "::$1"))
    met = jvm.alias("r").join(nodes.filter(family(F.col("language")) == "jvm").alias("n"), F.col("r._q") == F.col("n.qualified_name"))
    return _out(_best(met, shared_directories(F.col("r.file_path"), F.col("n.file_path")).desc()), F.lit(0.95), "import", rank)


def own_member(refs: DataFrame, nodes: DataFrame, rank: int = 0) -> DataFrame:
    """`this.x` and `self.x`: the member x of the type around the reference, 0.95; the first in the file."""
    mine = refs.withColumn("_x", F.regexp_extract("reference_name", r"^(?:this|self)\.(\w+)$", 1)).filter("_x <> ''")
    around = nodes.select(F.col("id").alias("from_node_id"), F.regexp_replace("qualified_name", "::[^:]+$", "").alias("_type"))
    asked = mine.join(around, "from_node_id").withColumn("_q", F.concat_ws("::", "_type", "_x"))
    met = asked.alias("r").join(nodes.alias("n"), (F.col("r.file_path") == F.col("n.file_path")) & (F.col("r._q") == F.col("n.qualified_name")))
    return _out(_best(met), F.lit(0.95), "instance-method", rank)


def inherited_member(refs: DataFrame, nodes: DataFrame, supertypes: DataFrame, depth: int = 5, rank: int = 4) -> DataFrame:
    """`this.x` where x is a member of a supertype: supertypes(sub, super) by name, the nearest, 0.85."""
    mine = refs.withColumn("_x", F.regexp_extract("reference_name", r"^(?:this|self|super)\.(\w+)$", 1)).filter("_x <> ''")
    around = nodes.select(F.col("id").alias("from_node_id"), F.regexp_extract("qualified_name", r"([^:]+)::[^:]+$", 1).alias("_type"))
    at = mine.join(around, "from_node_id").select(*refs.columns, "_x", F.col("_type").alias("_at"))
    up, every = supertypes.toDF("_at", "_super").distinct(), None
    for step in range(1, depth + 1):
        at = at.join(up, "_at").select(*refs.columns, "_x", F.col("_super").alias("_at")).distinct()
        here = at.withColumn("_step", F.lit(step))
        every = here if every is None else every.unionByName(here)
    members = nodes.withColumn("_owner", F.regexp_extract("qualified_name", r"([^:]+)::[^:]+$", 1))
    met = every.alias("r").join(members.alias("n"), (F.col("r._at") == F.col("n._owner")) & (F.col("r._x") == F.col("n.name")))
    met = met.filter(family(F.col("r.language")) == family(F.col("n.language")))
    return _out(_best(met, F.col("r._step")), F.lit(0.85), "instance-method", rank)


def chained_call(refs: DataFrame, nodes: DataFrame, returns: DataFrame, rank: int = 4) -> DataFrame:
    """`A.f().m` and `A::f().m`: m on the type that f is declared to return; returns(id, type). 0.85."""
    shape = r"^(?:(\w+)(?:\.|::))?(\w+)\(\)\.(\w+)$"
    parts = refs.select("*", *(F.regexp_extract("reference_name", shape, i).alias(c) for i, c in ((1, "_owner"), (2, "_f"), (3, "_m")))).filter("_m <> ''")
    made = nodes.join(returns, "id").select(F.col("name").alias("_f"), F.regexp_extract("qualified_name", r"([^:]+)::[^:]+$", 1).alias("_has"), "type").distinct()
    typed = parts.join(made, "_f").filter((F.col("_owner") == "") | (F.col("_owner") == F.col("_has"))).select(*refs.columns, "_m", "type")
    members = nodes.withColumn("_of", F.regexp_extract("qualified_name", r"([^:]+)::[^:]+$", 1))
    met = typed.alias("r").join(members.alias("n"), (F.col("r.type") == F.col("n._of")) & (F.col("r._m") == F.col("n.name")))
    return _out(_best(met, proximity(F.col("r.file_path"), F.col("n.file_path")).desc()), F.lit(0.85), "instance-method", rank)


def word_overlap(refs: DataFrame, nodes: DataFrame, least: int = 2, rank: int = 5) -> DataFrame:
    """receiver.method where the receiver shares words with the owner of such a method, 0.65."""
    words = lambda c: F.filter(F.split(F.lower(F.regexp_replace(c, "(?<=[a-z0-9])(?=[A-Z])|_+", " ")), " +"), lambda w: F.length(w) > 1)
    parts = refs.withColumn("_recv", F.regexp_extract("reference_name", r"^(\w+)\.(\w+)$", 1)).withColumn("_m", F.regexp_extract("reference_name", r"^(\w+)\.(\w+)$", 2)).filter("_m <> ''")
    # methods of one name and owner can't be told apart
    methods = _first(nodes.filter("kind = 'method'").withColumn("_owner", F.regexp_extract("qualified_name", r"([^:]+)::[^:]+$", 1)), "name", "_owner")
    met = parts.alias("r").join(methods.alias("n"), F.col("r._m") == F.col("n.name")).withColumn("_same", F.size(F.array_intersect(words(F.col("r._recv")), words(F.col("n._owner")))))
    return _out(_best(met.filter(F.col("_same") >= least), F.desc("_same")), F.lit(0.65), "instance-method", rank)


def config_key(refs: DataFrame, nodes: DataFrame, rank: int = 6) -> DataFrame:
    """Keys whatever their case, dashes and underscores, 0.9 where single."""
    plain = lambda c: F.lower(F.regexp_replace(c, "[-_]", ""))
    keys = nodes.filter(F.col("language").isin("properties", "yaml"))
    met = refs.alias("r").join(keys.alias("n"), plain(F.col("r.reference_name")) == plain(F.col("n.name"))).withColumn("_n", F.count("*").over(Window.partitionBy("r.ref_id")))
    return _out(met.filter("_n = 1"), F.lit(0.9), "qualified-name", rank)


def prune(refs: DataFrame, nodes: DataFrame, builtins: DataFrame | None = None) -> DataFrame:
    """References that some name could satisfy: any segment is a known name; and no built-in of the language."""
    names = nodes.select(F.col("name").alias("_name")).distinct()
    segments = refs.select("ref_id", F.explode(F.array_union(F.split("reference_name", r"[.:/]+"), F.array("reference_name"))).alias("_name"))
    known = segments.join(names, "_name", "left_semi").select("ref_id").distinct()
    kept = refs.join(known, "ref_id", "left_semi")
    if builtins is not None:
        kept = kept.join(builtins.toDF("language", "reference_name"), ["language", "reference_name"], "left_anti")
    return kept


def admissible(candidates: DataFrame, refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The language gate: references and types stay within a family of languages."""
    r = refs.select("ref_id", "reference_kind", family(F.col("language")).alias("_rf"))
    n = nodes.select(F.col("id").alias("target_id"), family(F.col("language")).alias("_nf"))
    met = candidates.join(r, "ref_id").join(n, "target_id")
    return met.filter(~F.col("reference_kind").isin("references", "type_of", "returns", "extends", "implements") | (F.col("_rf") == F.col("_nf"))).select(*CANDIDATE)


def choose(*strategies: DataFrame) -> DataFrame:
    """(ref_id, target_id, confidence, resolved_by): the highest confidence, then the strategy tried first."""
    every = strategies[0]
    for s in strategies[1:]:
        every = every.unionByName(s)
    order = Window.partitionBy("ref_id").orderBy(F.desc("confidence"), "rank", "file_path", "start_line", "target_id")
    return every.withColumn("_k", F.row_number().over(order)).filter("_k = 1").select("ref_id", "target_id", "confidence", "resolved_by")


def resolve(refs: DataFrame, nodes: DataFrame, imports: DataFrame | None = None, builtins: DataFrame | None = None, supertypes: DataFrame | None = None, returns: DataFrame | None = None) -> DataFrame:
    """All strategies over all references; those that need imports, supertypes or return types run where these are given."""
    kept = prune(refs, nodes, builtins)
    values = kept.filter("reference_kind = 'function_ref'")
    plain = kept.filter("reference_kind <> 'function_ref'")
    found = [f(plain, nodes) for f in (jvm_import, own_member, file_path, qualified, method_call, word_overlap, exact, fuzzy)] + [function_ref(values, nodes)]
    if imports is not None:
        # what a file imports may go by a name that the project lacks
        found.append(via_import(refs.filter("reference_kind <> 'function_ref'"), nodes, imports))
    if supertypes is not None:
        found.append(inherited_member(plain, nodes, supertypes))
    if returns is not None:
        found.append(chained_call(refs, nodes, returns))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return choose(admissible(every, refs, nodes))


def to_edges(resolved: DataFrame, refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of resolved references: a value reference is a reference, extending an interface implements
    it, and calling a class instantiates it."""
    target = nodes.select(F.col("id").alias("target_id"), F.col("kind").alias("_tk"))
    met = resolved.join(refs.select("ref_id", "from_node_id", "reference_kind", "line"), "ref_id").join(target, "target_id")
    k = F.col("reference_kind")
    kind = (
        F.when(k == "function_ref", "references")
        .when((k == "extends") & F.col("_tk").isin("interface", "protocol", "trait"), "implements")
        .when((k == "calls") & F.col("_tk").isin("class", "struct"), "instantiates")
        .otherwise(k)
    )
    meta = F.create_map(F.lit("confidence"), F.col("confidence").cast("string"), F.lit("resolvedBy"), F.col("resolved_by"))
    return met.select(F.col("from_node_id").alias("source"), F.col("target_id").alias("target"), kind.alias("kind"), meta.alias("metadata"), "line")
