"""Links that are read from source text: each pass explodes what a text names and joins it by equality.

Tables: files(path, content), nodes as in the model, bodies(id, file_path, body). Edges come out as
(source, target, kind, line). Texts are read whole, and a name that many texts share is a key of a join,
never a list on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.synth import FANOUT

#: Words before a parenthesis that call nothing.
NO_CALLS = "if for while switch catch return function typeof sizeof match loop elif and or not in assert with lambda await yield new".split()
CALLABLE = ("function", "method")
GIN_DISPATCH = r"\.handlers\s*\[[^\]]*\]\s*\("
#: A registration and its arguments, which may hold calls that hold calls.
GIN_REGISTER = r"\.(?:Use|GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD|Any|Handle)\s*\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)"
GO_COMMENTS = r'("(?:\\.|[^"\\\n])*"|`[^`]*`)|//[^\n]*|/\*[\s\S]*?\*/'


def lines(files: DataFrame) -> DataFrame:
    """path, line (from 1), text of each line."""
    split = F.posexplode(F.split(F.coalesce("content", F.lit("")), "\r?\n"))
    return files.select("path", split.alias("line", "text")).withColumn("line", F.col("line") + 1)


def _files(nodes: DataFrame) -> DataFrame:
    return nodes.filter("kind = 'file'").select("file_path", "id")


def python_includes(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """From a Python file to the file of each `include('a.b.urls')`: a module before a package of that name."""
    named = lines(files.filter(F.col("path").endswith(".py"))).filter(F.col("text").contains("include("))
    module = F.explode(F.regexp_extract_all("text", F.lit(r"""include\((?:"\s*([A-Za-z0-9_.]*\.urls)\s*"|'\s*([A-Za-z0-9_.]*\.urls)\s*')"""), 0))
    named = named.select("path", "line", module.alias("call")).withColumn("stem", F.translate(F.regexp_extract("call", r"([A-Za-z0-9_.]+\.urls)", 1), ".", "/"))
    probes = F.explode(F.array(*(F.struct(F.lit(i).alias("rank"), F.concat("stem", F.lit(end)).alias("file_path")) for i, end in enumerate((".py", "/__init__.py")))))
    probed = named.select("path", "line", "stem", probes.alias("p")).select("path", "line", "stem", "p.*")
    met = probed.join(_files(nodes), "file_path").groupBy("path", "line", "stem").agg(F.min_by("id", "rank").alias("target"))
    own = _files(nodes).select(F.col("file_path").alias("path"), F.col("id").alias("source"))
    return met.join(own, "path").filter("source <> target").groupBy("source", "target").agg(F.min("line").alias("line")).select("source", "target", F.lit("imports").alias("kind"), "line")


def test_file_calls(files: DataFrame, nodes: DataFrame, is_test) -> DataFrame:
    """From the node of a test file without callables to the first callable of each name it calls, by line."""
    callables = nodes.filter(F.col("kind").isin(*CALLABLE))
    has_some = callables.select(F.col("file_path").alias("path")).distinct()
    tests = lines(files.filter(is_test(F.col("path"))).join(has_some, "path", "left_anti"))
    names = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([\p{L}_$][\p{L}\p{N}_$]*)\s*\("), 1)))
    called = tests.filter(~F.trim("text").rlike("^(//|#)")).select("path", "line", names.alias("name")).filter(~F.col("name").isin(*NO_CALLS))
    first = callables.groupBy("name").agg(F.min_by("id", F.struct("file_path", "start_line", "id")).alias("target"))
    own = _files(nodes).select(F.col("file_path").alias("path"), F.col("id").alias("source"))
    met = called.join(first, "name").join(own, "path").filter("source <> target")
    return met.select("source", "target", F.lit("calls").alias("kind"), "line").distinct()


def page_loaders(nodes: DataFrame) -> DataFrame:
    """From the component of a +page or +layout to `load` and `actions` in the scripts beside it."""
    page = F.regexp_extract("file_path", r"^(.*/\+(?:page|layout))\.svelte$", 1)
    script = F.regexp_extract("file_path", r"^(.*/\+(?:page|layout))(?:\.server)?\.[jt]s$", 1)
    pages = nodes.filter("kind = 'component'").withColumn("at", page).filter("at <> ''")
    pages = pages.groupBy("at").agg(F.min_by(F.struct("id", "start_line"), F.struct("start_line", "id")).alias("p"))
    hooks = nodes.filter(F.col("kind").isin(*CALLABLE, "constant", "variable") & F.col("name").isin("load", "actions")).withColumn("at", script).filter("at <> ''")
    met = hooks.select("at", F.col("id").alias("target")).join(pages, "at")
    return met.select(F.col("p.id").alias("source"), "target", F.lit("references").alias("kind"), F.col("p.start_line").alias("line"))


def gin_registered(files: DataFrame) -> DataFrame:
    """name, at: handlers that Go files register, each with the first place by (path, line)."""
    go = files.filter(F.col("path").endswith(".go"))
    code = F.regexp_replace("content", GO_COMMENTS, "$1")
    args = go.select("path", F.explode(F.regexp_extract_all(code, F.lit(GIN_REGISTER), 1)).alias("args"))
    bare = F.regexp_replace("args", r"\((?:[^()]|\([^()]*\))*\)", "")  # Logger(x) is registered as Logger
    each = args.select("path", F.explode(F.split(bare, ",")).alias("arg")).withColumn("arg", F.trim("arg"))
    each = each.filter("arg <> ''").filter(~F.col("arg").rlike('^("|`|func)'))
    name = F.regexp_extract("arg", r"([A-Za-z0-9_]+)[^A-Za-z0-9_]*$", 1)
    return each.select(name.alias("name"), "path").filter("name <> ''").groupBy("name").agg(F.min("path").alias("at"))


def gin_chain(bodies: DataFrame, files: DataFrame, nodes: DataFrame, cap: int = FANOUT) -> DataFrame:
    """From each Go method that runs `.handlers[..](` to the registered handlers, the first `cap` by name.

    The names are cut to cap + 1 before they meet the dispatchers, which is enough where one of them is
    the dispatcher itself, so the work grows with dispatchers and never with their product."""
    go = nodes.filter("language = 'go'")
    runs = bodies.filter(F.col("body").rlike(GIN_DISPATCH)).select("id")
    dispatchers = go.filter(F.col("kind").eqNullSafe("method") & F.col("name").rlike(r"\.|::")).join(runs, "id", "left_semi").select(F.col("id").alias("source"), F.col("start_line").alias("line"))
    handlers = go.filter(F.col("kind").isin(*CALLABLE)).groupBy("name").agg(F.min_by("id", F.struct("file_path", "start_line", "id")).alias("target"))
    few = handlers.join(gin_registered(files), "name").select("name", "target").orderBy("name").limit(cap + 1)
    met = dispatchers.withColumn("_one", F.lit(1)).join(F.broadcast(few.withColumn("_one", F.lit(1))), "_one").filter("source <> target")
    rank = F.row_number().over(Window.partitionBy("source").orderBy("name"))
    return met.withColumn("_k", rank).filter(F.col("_k") <= cap).select("source", "target", F.lit("calls").alias("kind"), "line")


def app_scope(path: Column) -> Column:
    """The application of a path under apps/; empty elsewhere."""
    return F.regexp_extract(path, r"(?:^|/)apps/([^/]+)/", 1)


def text_callers(bodies: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target): bodies that call a target by name, within one application.

    Names of fewer than three characters are not looked for. The called names of each body are exploded
    once and joined on scope and name, so many targets cost one pass over the bodies."""
    names = F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"(?:^|[^\w$])([A-Za-z_]\w*)\s*\("), 1)))
    called = bodies.select(F.col("id").alias("source"), app_scope(F.col("file_path")).alias("scope"), names.alias("name"))
    wanted = targets.filter(F.length("name") >= 3).select(F.col("id").alias("target"), app_scope(F.col("file_path")).alias("scope"), "name")
    return called.join(wanted, ["scope", "name"]).filter("source <> target").select("source", "target")


def relative_module(importer: Column, target: str) -> Column:
    """How a file names the module `target` (a path without its ending) from where it is."""
    parts = target.split("/")
    folder, last = parts[:-1], parts[-1]
    here = F.when(importer.contains("/"), F.split(F.regexp_replace(importer, "/[^/]*$", ""), "/")).otherwise(F.array().cast("array<string>"))
    out = None
    for n in range(len(folder), -1, -1):  # the longest shared beginning
        ups = F.size(here) - n
        name = F.concat(F.when(ups == 0, F.lit("./")).otherwise(F.repeat(F.lit("../"), ups)), F.lit("/".join([*folder[n:], last])))
        same = F.slice(here, 1, n) == F.array(*map(F.lit, folder[:n])) if n else F.lit(True)
        out = F.when(same, name) if out is None else out.when(same, name)
    return out


def text_dependents(files: DataFrame, path: str) -> DataFrame:
    """(path): files that quote the module of `path`: relative to themselves, from the root, or by its last name."""
    path = path.replace("\\", "/").removeprefix("./")
    head, _, last = path.rpartition("/")
    last = last.rsplit(".", 1)[0] if "." in last[1:] else last
    stem = f"{head}/{last}" if head else last
    forms = (relative_module(F.col("path"), stem), F.lit(stem), F.lit(last))
    quoted = [F.col("content").contains(F.concat(F.lit(q), form, F.lit(q))) for form in forms for q in "'\""]
    found = quoted[0]
    for q in quoted[1:]:
        found = found | q
    return files.filter((F.col("path") != path) & found).select("path")
