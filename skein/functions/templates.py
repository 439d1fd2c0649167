"""Markup extractors that are plain patterns, as native expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def found(rows: DataFrame, text: str, pattern: str, name: str, keys: list[str], group: int = 1) -> DataFrame:
    """One row for each match of pattern in a column, with its place among them."""
    return rows.select(*keys, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), group)).alias("place", name))


def links(pages: DataFrame) -> DataFrame:
    return found(pages, "html", r'href="([^"]*)"', "href", ["page_id"])


def tags(pages: DataFrame) -> DataFrame:
    """(page_id, tag, n): opening tags of each page."""
    return found(pages, "html", r"<([A-Za-z][A-Za-z0-9]*)", "tag", ["page_id"]).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def components(files: DataFrame, text: str = "content") -> DataFrame:
    """Capitalised tags: the components that a template uses."""
    return found(files, text, r"<([A-Z][A-Za-z0-9]*)", "component", ["path"])


def handlers(files: DataFrame, text: str = "content") -> DataFrame:
    """Handlers bound in a template: @event="name" and on:event={name}."""
    return found(files, text, r"(?:@[\w.-]+=\"|on:\w+=\{)\s*([A-Za-z_$][\w$]*)", "handler", ["path"])


def mybatis(files: DataFrame, text: str = "content") -> DataFrame:
    """(path, name): `Class::id` of the statements of a mapper, by the last part of its namespace."""
    owner = F.regexp_extract(text, r'<mapper[^>]*namespace="(?:[^"]*\.)?([^".]+)"', 1)
    ids = found(files.withColumn("_owner", owner), text, r"<(?:select|insert|update|delete)[^>]*\bid=\"([^\"]+)\"", "id", ["path", "_owner"])
    return ids.filter("_owner <> ''").select("path", F.concat_ws("::", "_owner", "id").alias("name"))


def config_keys(files: DataFrame, text: str = "content") -> DataFrame:
    """(path, key): keys of property files; values stay where they are."""
    lines = files.select("path", F.explode(F.split(text, "\n")).alias("line"))
    return lines.select("path", F.regexp_extract("line", r"^\s*([A-Za-z0-9_.-]+)\s*[=:]", 1).alias("key")).filter("key <> ''")


def liquid(files: DataFrame, text: str = "content") -> DataFrame:
    return found(files, text, r"\{%-?\s*(?:render|include|section)\s+['\"]([^'\"]+)['\"]", "partial", ["path"])


def delphi_forms(files: DataFrame, text: str = "content") -> DataFrame:
    """(path, place, name, type): the objects of a form file, in order."""
    head = r"(?m)^\s*(?:object|inherited|inline)\s+(\w+)\s*:\s*(\w+)"
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(head), 1).alias("name"), F.regexp_extract_all(text, F.lit(head), 2).alias("type"))
    return files.select("path", F.posexplode(both).alias("place", "o")).select("path", "place", F.col("o.name").alias("name"), F.col("o.type").alias("type"))


def delphi_handlers(files: DataFrame, text: str = "content") -> DataFrame:
    """(path, place, handler): methods that a form binds to events."""
    return found(files, text, r"(?m)^\s*On\w+\s*=\s*(\w+)\s*$", "handler", ["path"])


def razor(files: DataFrame, text: str = "content") -> DataFrame:
    """(path, directive, name): models, injected services, usings and base classes of a view."""
    line = r"(?m)^\s*@(model|inject|using|inherits|implements|page)\s+\"?([\w.<>/]+)"
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(line), 1).alias("d"), F.regexp_extract_all(text, F.lit(line), 2).alias("n"))
    return files.select("path", F.explode(both).alias("o")).select("path", F.col("o.d").alias("directive"), F.col("o.n").alias("name"))


#: Names that native code offers to scripts: (framework, pattern whose first group is the name).
BRIDGES = (
    ("react-native", r"RCT_(?:EXPORT|REMAP)_METHOD\(\s*(\w+)"),
    ("react-native", r"@ReactMethod(?:\([^)]*\))?\s*(?:public\s+)?(?:fun|void|\w+)\s+(\w+)"),
    ("expo", r"\b(?:Async)?Function\(\s*\"(\w+)\""),
    ("fabric", r"codegenNativeComponent(?:<[^>]*>)?\(\s*['\"](\w+)"),
    ("swiftui", r"\bstruct\s+(\w+)\s*:\s*(?:[\w, ]*\b)?View\b"),
    ("uikit", r"\bclass\s+(\w+)\s*:\s*\w*ViewController\b"),
)


def bridges(files: DataFrame, text: str = "content") -> DataFrame:
    """(path, framework, name) of what native code offers."""
    sites = [F.transform(F.regexp_extract_all(text, F.lit(p), 1), _as(framework)) for framework, p in BRIDGES]
    return files.select("path", F.explode(F.flatten(F.array(*sites))).alias("s")).select("path", "s.framework", "s.name").distinct()


def _as(framework: str):
    return lambda n: F.struct(F.lit(framework).alias("framework"), n.alias("name"))


def path_routes(files: DataFrame) -> DataFrame:
    """(path, framework, route): routes that a framework reads off file paths; [x] and _x are parameters."""
    p = F.col("path")
    rules = (
        ("sveltekit", r"(?:^|/)src/routes(.*?)/\+(?:page|server|layout)(?:\.server)?\.(?:svelte|ts|js)$"),
        ("next", r"(?:^|/)app(.*?)/(?:page|route)\.(?:tsx|ts|jsx|js)$"),
        ("next", r"(?:^|/)pages(/.*?)(?:/index)?\.(?:tsx|jsx)$"),
        ("nuxt", r"(?:^|/)pages(/.*?)(?:/index)?\.vue$"),
        ("astro", r"(?:^|/)src/pages(/.*?)(?:/index)?\.astro$"),
    )
    framework = route = None
    for name, pattern in rules:
        hit, at = p.rlike(pattern), F.regexp_extract(p, pattern, 1)
        framework = F.when(hit, name) if framework is None else framework.when(hit, name)
        route = F.when(hit, at) if route is None else route.when(hit, at)
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(route, r"/\([^)]*\)", ""), r"\[+(?:\.\.\.)?(\w+)\]+", ":$1"), r"/(?:index)?$", "")
    return files.select("path", framework.alias("framework"), F.when(clean == "", "/").otherwise(clean).alias("route")).filter("framework IS NOT NULL")


def cargo_members(files: DataFrame, text: str = "content") -> DataFrame:
    """(crate, directory) of each Cargo.toml."""
    name = F.regexp_extract(text, r"(?s)\[package\].*?\bname\s*=\s*\"([^\"]+)\"", 1)
    return files.filter(F.col("path").rlike(r"(^|/)Cargo\.toml$")).select(name.alias("crate"), F.regexp_replace("path", "/?Cargo[.]toml$", "").alias("directory")).filter("crate <> ''")


def go_module(files: DataFrame, text: str = "content") -> DataFrame:
    """(module, directory) of each go.mod."""
    return files.filter(F.col("path").rlike(r"(^|/)go\.mod$")).select(F.regexp_extract(text, r"(?m)^module\s+(\S+)", 1).alias("module"), F.regexp_replace("path", "/?go[.]mod$", "").alias("directory"))
