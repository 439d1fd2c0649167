"""From import statements to files: bindings, path candidates and exports, as joins over the file table."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.ship import ship

#: What a path without extension may stand for, by language, in order.
PROBES = {
    "typescript": ".ts .tsx .d.ts .js .jsx /index.ts /index.tsx /index.js",
    "tsx": ".tsx .ts .d.ts .js .jsx /index.tsx /index.ts /index.js",
    "javascript": ".js .jsx .mjs .cjs /index.js /index.jsx",
    "jsx": ".jsx .js /index.jsx /index.js",
    "python": ".py /__init__.py",
    "rust": ".rs /mod.rs",
    "ruby": ".rb",
    "lua": ".lua /init.lua",
    "luau": ".luau .lua /init.luau",
    "php": ".php",
    "c": ".h .c",
    "cpp": ".h .hpp .hxx .cpp .cc .cxx",
}

_FROM = r"import\s+(?:type\s+)?(?P<what>[^'\";]+?)\s+from\s+['\"](?P<source>[^'\"]+)['\"]"


def bindings(text: str) -> list[tuple[str, str, str]]:
    """(local, exported, source) of each binding of an import statement: default, namespace (*) and named."""
    out = []
    for m in re.finditer(_FROM, text):
        what, source = m["what"], m["source"]
        named = re.search(r"\{([^}]*)\}", what)
        rest = re.sub(r"\{[^}]*\}", "", what)
        for part in filter(None, (p.strip() for p in rest.split(","))):
            star = re.match(r"\*\s+as\s+(\w+)", part)
            out.append((star[1], "*", source) if star else (part, "default", source))
        for part in filter(None, (p.strip() for p in (named[1] if named else "").split(","))):
            name, _, alias = (x.strip() for x in re.sub(r"^type\s+", "", part).partition(" as "))
            out.append((alias or name, name, source))
    for m in re.finditer(r"^\s*from\s+(?P<source>[\w.]+)\s+import\s+\(?(?P<what>[^)\n]+)", text, re.M):
        for part in filter(None, (p.strip() for p in m["what"].split(","))):
            name, _, alias = (x.strip() for x in part.partition(" as "))
            out.append((alias or name, name, m["source"]))
    for m in re.finditer(r"(?:const|let|var)\s+(?:(?P<one>\w+)|\{(?P<many>[^}]*)\})\s*=\s*require\(\s*['\"](?P<source>[^'\"]+)['\"]\s*\)", text):
        for part in filter(None, (p.strip() for p in (m["one"] or m["many"]).split(","))):
            name, _, alias = (x.strip() for x in part.partition(":"))
            out.append((alias or name, "default" if m["one"] else name, m["source"]))
    return out


def bound(files: DataFrame) -> DataFrame:
    """import_id, file_path, language, local_name, exported_name, source for each binding that the import
    statements of files(path, language, content) make; a default import goes by its local name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (path, language, local, local if exported == "default" else exported, source)
                for path, language, text in zip(*(b.column(c).to_pylist() for c in ("path", "language", "content")), strict=True)
                for local, exported, source in bindings(text or "")
            ]
            names = ["file_path", "language", "local_name", "exported_name", "source"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(5)], names=names)

    ship(files.sparkSession)
    found = files.select("path", "language", "content").mapInArrow(run, "file_path string, language string, local_name string, exported_name string, source string")
    return found.distinct().withColumn("import_id", F.xxhash64("file_path", "local_name", "exported_name", "source"))


def reexports(text: str) -> list[tuple[str, str, str]]:
    """(local, exported, source): `export {a as b} from` and `export * from` (* for both)."""
    out = [("*", "*", m[1]) for m in re.finditer(r"export\s+\*\s+from\s+['\"]([^'\"]+)['\"]", text)]
    for m in re.finditer(r"export\s+(?:type\s+)?\{([^}]*)\}\s+from\s+['\"]([^'\"]+)['\"]", text):
        for part in filter(None, (p.strip() for p in m[1].split(","))):
            name, _, alias = (x.strip() for x in part.partition(" as "))
            out.append((name, alias or name, m[2]))
    return out


def normalised(path: Column) -> Column:
    """A path without `.` and `..` segments."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    up = lambda done, p: F.when((p == "..") & (F.size(done) > 0), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/")


def resolve_paths(imports: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None, prefixes: tuple[str, ...] = ("src", "app", "lib")) -> DataFrame:
    """imports(import_id, file_path, language, source) with resolved_path, where a file of files(path)
    answers: relative sources from their directory, Python dots as levels, aliases by their longest
    prefix, else from the root and the usual folders. Every base is probed with every ending, in order;
    the first that exists wins."""
    folder = F.regexp_replace("file_path", "[^/]*$", "")
    source = F.col("source")
    dots = F.length(F.regexp_extract("source", r"^(\.+)", 1))
    module = F.regexp_replace(F.regexp_replace("source", r"^\.+", ""), r"\.", "/")
    python = F.col("language") == "python"
    bases = [
        F.when(python & (dots > 0), F.concat(folder, F.repeat(F.lit("../"), dots - 1), module)),
        F.when(~python & source.startswith("."), F.concat(folder, source)),
    ]
    for alias, target in sorted((aliases or {}).items(), key=lambda kv: -len(kv[0])):
        head = alias.rstrip("*")
        bases.append(F.when(source.startswith(head), F.concat(F.lit(target.rstrip("*")), F.expr(f"substring(source, {len(head) + 1})"))))
    bare = F.when(python, module).otherwise(source)
    absolute = ~source.startswith(".")
    bases += [F.when(absolute, bare), F.when(absolute, F.concat(folder, bare)), *(F.when(absolute, F.concat(F.lit(f"{p}/"), bare)) for p in prefixes)]
    probes = F.create_map(*(x for k, v in PROBES.items() for x in (F.lit(k), F.array(*map(F.lit, [*v.split(), ""])))))
    ends = F.coalesce(F.try_element_at(probes, F.col("language")), F.array(F.lit("")))
    tried = F.flatten(F.transform(F.filter(F.array(*bases), lambda b: b.isNotNull()), lambda b: F.transform(ends, lambda e: F.concat(b, e))))
    asked = imports.select("*", F.posexplode(tried).alias("_rank", "_try")).withColumn("path", normalised(F.col("_try")))
    met = asked.join(files.select("path"), "path")
    first = met.withColumn("_k", F.row_number().over(Window.partitionBy("import_id").orderBy("_rank"))).filter("_k = 1")
    return imports.join(first.select("import_id", F.col("path").alias("resolved_path")), "import_id", "left")


def follow_exports(wanted: DataFrame, nodes: DataFrame, reexports_: DataFrame, depth: int = 8) -> DataFrame:
    """wanted(ref_id, path, name) to (ref_id, target_id): the exported symbol of that name, `default` being
    the exported component, function or class; else through reexports_(path, local, exported, to_path),
    named ones before wildcards, at most depth files on."""
    exported = nodes.filter("is_exported").select(F.col("id").alias("target_id"), F.col("name").alias("_name"), F.col("kind").alias("_kind"), F.col("file_path").alias("_path"), "start_line")
    at = wanted.select("ref_id", "path", "name", F.lit(0).alias("step"))
    every = at
    for step in range(1, depth + 1):
        r = reexports_.toDF("path", "local", "exported", "to_path")
        at = at.join(r, "path").filter((F.col("exported") == F.col("name")) | (F.col("exported") == "*"))
        at = at.select("ref_id", F.col("to_path").alias("path"), F.when(F.col("exported") == "*", F.col("name")).otherwise(F.col("local")).alias("name"), (F.lit(step * 2) + F.when(F.col("exported") == "*", 1).otherwise(0)).alias("step")).distinct()
        every = every.unionByName(at)
        if step >= 2 and at.isEmpty():
            break
    usual = F.when(F.col("_kind") == "component", 0).when(F.col("_kind") == "function", 1).when(F.col("_kind") == "class", 2)
    met = every.join(exported, every.path == exported._path).filter((F.col("_name") == F.col("name")) | ((F.col("name") == "default") & usual.isNotNull()))
    order = Window.partitionBy("ref_id").orderBy("step", F.coalesce(usual, F.lit(3)), "start_line", "target_id")
    return met.withColumn("_k", F.row_number().over(order)).filter("_k = 1").select("ref_id", "target_id")
