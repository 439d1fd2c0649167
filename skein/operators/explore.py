"""What an exploration adds to a search: compound names, definitions behind imports, families, budgets."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.graphview import Graph
from skein.operators.search import path_relevance
from skein.sources.paths import is_test

DEFINITIONS = ("class", "interface", "struct", "trait", "protocol", "enum", "type_alias")
BEST = (F.desc, "score"), (F.asc, "file_path"), (F.asc, "start_line"), (F.asc, "id")


@dataclass(frozen=True)
class OutputBudget:
    max_output_chars: int
    max_files: int
    max_chars_per_file: int
    gap: int
    symbols_in_header: int
    edges_per_kind: int
    with_relationships: bool
    without_low_value: bool


#: Projects of fewer files than the first figure have the budget behind it.
BUDGETS = (
    (150, OutputBudget(13_000, 4, 3_800, 7, 5, 4, False, True)),
    (500, OutputBudget(18_000, 5, 3_800, 8, 6, 6, False, True)),
    (5_000, OutputBudget(24_000, 8, 6_500, 12, 10, 10, True, False)),
    (None, OutputBudget(24_000, 8, 7_000, 15, 15, 15, True, False)),
)


def output_budget(n_files: int) -> OutputBudget:
    return next(budget for below, budget in BUDGETS if below is None or n_files < below)


def project_tokens(files: DataFrame, root_name: str) -> set[str]:
    """Names of the project itself, which say nothing in a question: of its Go module, its package and its folder."""
    found = {r.path: r.content or "" for r in files.filter(F.col("path").isin("go.mod", "package.json")).select("path", "content").collect()}  # two rows at most
    names = [root_name]
    if module := re.search(r"(?m)^\s*module (\S+)", found.get("go.mod", "")):
        names.append(module[1].rsplit("/", 1)[-1])
    try:
        package = json.loads(found.get("package.json", "{}"))
    except ValueError:
        package = {}
    if isinstance(package, dict) and isinstance(package.get("name"), str):
        names.append(package["name"].rsplit("/", 1)[-1])
    plain = (re.sub(r"[^A-Za-z0-9]", "", n).lower() for n in names)
    return {n for n in plain if len(n) >= 5}


def _titled(words: Sequence[str]) -> list[str]:
    """Words as they stand inside a compound name; each once, none of fewer than three letters."""
    return [w for w in dict.fromkeys(w[:1].upper() + w[1:].lower() for w in words) if len(w) >= 3]


def _best(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy(*(f(c) for f, c in BEST)).limit(n)


def _definitions(nodes: DataFrame, query: str, found: DataFrame | None) -> DataFrame:
    rows = nodes.filter(F.col("kind").isin(*DEFINITIONS))
    if not re.search("test|spec", query.lower()):
        rows = rows.filter(~is_test(F.col("file_path")))
    return rows if found is None else rows.join(found.select("id"), "id", "left_anti")


def _brevity(by: Column, each: float) -> Column:
    return F.greatest(F.lit(6.0) - by / F.lit(each), F.lit(0.0))


def inner_matches(nodes: DataFrame, words: Sequence[str], query: str, limit: int, found: DataFrame | None = None) -> DataFrame:
    """(id, score): definitions with a word inside their name, behind a letter; those of several words first.

    Of each word the best 4 * ceil(limit / 2) count."""
    titled = _titled(words)
    if not titled:
        return nodes.select("id", F.lit(0.0).alias("score")).limit(0)
    rows = _definitions(nodes, query, found)
    hits = []
    for k, word in enumerate(titled):
        at = F.instr("name", word)
        inside = (at > 1) & F.substring("name", at - 1, F.lit(1)).rlike("[A-Za-z]")
        score = F.lit(8.0) + _brevity(F.length("name") - len(word), 4.0) + path_relevance(F.col("file_path"), query)
        hits.append(F.when(inside, F.struct(F.lit(k).alias("k"), score.cast("double").alias("score"))))
    each = rows.select("id", "file_path", "start_line", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("id", "file_path", "start_line", "h.*")
    place = F.row_number().over(Window.partitionBy("k").orderBy(*(f(c) for f, c in BEST)))
    each = each.withColumn("_place", place).filter(F.col("_place") <= 4 * -(-limit // 2))
    one = each.groupBy("id", "file_path", "start_line").agg(F.min_by("score", "k").alias("first"), F.count("*").alias("n"))
    return _best(one.withColumn("score", F.col("first") * (1 + F.col("n")) + 30.0 * (F.col("n") - 1)), limit).select("id", "score")


def compound_matches(nodes: DataFrame, words: Sequence[str], query: str, limit: int, found: DataFrame | None = None) -> DataFrame:
    """(id, score): the best ceil(limit / 2) definitions whose name holds two words of the question or more, in any case."""
    titled = _titled(words)
    rows = _definitions(nodes, query, found)
    n = sum((F.lower("name").contains(w.lower()).cast("int") for w in titled), F.lit(0))
    score = F.lit(10.0) + 20.0 * (F.col("n") - 1) + path_relevance(F.col("file_path"), query) + _brevity(F.length("name"), 8.0)
    return _best(rows.withColumn("n", n).filter("n >= 2").withColumn("score", score.cast("double")), -(-limit // 2)).select("id", "score")


def definitions_behind(results: DataFrame, g: Graph) -> DataFrame:
    """(id, score): results(id, score) where imports and exports give way to what they name, at their score; each once, at its best."""
    met = results.join(g.nodes.select("id", "kind"), "id")
    names = met.filter(F.col("kind").isin("import", "export")).withColumn("by", F.concat("kind", F.lit("s")))
    ends = g.edges.filter(F.col("kind").isin("imports", "exports")).select(F.col("source").alias("id"), F.col("kind").alias("by"), "target")
    behind = names.join(ends, ["id", "by"]).select(F.col("target").alias("id"), "score").join(g.nodes.select("id"), "id", "left_semi")
    plain = met.filter(~F.col("kind").isin("import", "export")).select("id", "score")
    return plain.unionByName(behind).groupBy("id").agg(F.max("score").alias("score"))


def families(g: Graph, least: int = 3) -> DataFrame:
    """(id, name, file_path, n): classes and interfaces with so many subtypes or more, which are shown as skeletons."""
    sizes = g.edges.filter("kind IN ('implements', 'extends')").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return g.nodes.filter("kind IN ('class', 'interface')").select("id", "name", "file_path").join(sizes, "id")


def family_files(g: Graph, least: int = 3) -> DataFrame:
    """(file_path): files that hold a member of such a family."""
    big = families(g, least).select(F.col("id").alias("target"))
    members = g.edges.filter("kind IN ('implements', 'extends')").join(big, "target", "left_semi").select(F.col("source").alias("id")).distinct()
    return g.nodes.join(members, "id", "left_semi").select("file_path").distinct()


def unique_callables(nodes: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, file_path): tokens(token) that name one function or method alone, by its name, qualified name or the latter's end."""
    own = nodes.filter("kind IN ('function', 'method')")
    end = F.concat_ws("::", F.element_at(F.split("qualified_name", r"::|\."), -2), "name")
    forms = F.explode(F.array_distinct(F.array_compact(F.array("name", "qualified_name", F.when(F.col("qualified_name").rlike(r"::|\."), end)))))
    named = own.select("id", "file_path", forms.alias("token")).join(tokens.select("token").distinct(), "token", "left_semi")
    one = named.groupBy("token").agg(F.count("*").alias("n"), F.min("file_path").alias("file_path"))
    return one.filter("n = 1").select("token", "file_path")


def file_view(content: str, start: int = 1, count: int | None = None) -> str:
    """Lines of a file with their numbers, from the start-th on."""
    rows = content.split("\n")
    first = max(start, 1) - 1
    last = len(rows) if count is None else min(len(rows), first + max(count, 0))
    return "\n".join(f"{i + 1}\t{rows[i]}" for i in range(first, last))
