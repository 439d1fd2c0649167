"""Search and ranking: field queries, BM25 over postings, substring, fuzzy and exact names, and bonuses."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.model import KIND_BONUS, NODE_KINDS
from skein.operators.mutate import capped
from skein.scratch import cut
from skein.sources.paths import basename, is_test

#: Weights of the indexed columns and parameters of the ranking function.
WEIGHTS = {"id": 0.0, "name": 20.0, "qualified_name": 5.0, "docstring": 1.0, "signature": 2.0}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


@dataclass
class Query:
    text: str = ""
    kinds: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)


def parse(raw: str) -> Query:
    """kind:, lang: or language:, path: and name: fields, values quoted or bare; all else is text."""
    q, text = Query(), []
    into = {"kind": q.kinds, "lang": q.languages, "language": q.languages, "path": q.paths, "name": q.names}
    for token in re.findall(r'(?:[^\s"]|"[^"]*"?)+', raw):
        key, colon, value = token.partition(":")
        value = value.strip('"')
        if colon and value and key.lower() in into and (key.lower() != "kind" or value in NODE_KINDS):
            into[key.lower()].append(value)
        else:
            text.append(token.strip('"'))
    q.text = " ".join(x for x in text if x)
    return q


def tokens(text: Column) -> Column:
    """Words of letters and digits, lower-cased; underscores and dots part words."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(nodes: DataFrame) -> DataFrame:
    """(id, term, tf, length): weighted occurrences of each term and the tokens of the whole row."""
    columns = list(WEIGHTS)
    length = sum((F.size(tokens(F.col(c))) for c in columns), F.lit(0))
    every = F.flatten(F.array(*map(_weighted, columns)))
    rows = nodes.select("id", length.alias("length"), F.explode(every).alias("t"))
    return rows.groupBy("id", "length", F.col("t.term").alias("term")).agg(F.sum("t.w").alias("tf"))


def _weighted(column: str) -> Column:
    weight = WEIGHTS[column]
    return F.transform(tokens(F.col(column)), lambda t: F.struct(t.alias("term"), F.lit(weight).alias("w")))


@dataclass(frozen=True)
class Index:
    """The inverted index of a node table: postings, and one row with the number of rows and their mean length."""

    terms: DataFrame
    size: DataFrame


def sizes(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("n_docs"), F.avg(sum((F.size(tokens(F.col(c))) for c in WEIGHTS), F.lit(0))).alias("mean"))


def build_index(nodes: DataFrame) -> Index:
    """Written once, in the order of terms, so that a search by prefix skips the row groups of all others."""
    terms = postings(nodes)
    return Index(cut(terms.repartitionByRange("term").sortWithinPartitions("term"), "postings"), cut(sizes(nodes), "sizes"))


def bm25(nodes: DataFrame, text: str, limit: int = 100, index: Index | None = None, within: DataFrame | None = None) -> DataFrame:
    """(id, score): rows with any word of text as a prefix of a term, best first. Each prefix is one
    phrase: its frequency sums over terms, its document count is of rows with any such term. Counts are of
    the whole table, also where only rows in within(id) are asked for."""
    words = sorted(set(re.findall(r"[^\W_]+", text.lower())))
    index = index or Index(postings(nodes), sizes(nodes))
    if not words:
        return nodes.select("id", F.lit(0.0).alias("score")).limit(0)
    some = F.lit(False)
    for w in words:
        some = some | F.col("term").startswith(w)
    phrase = F.explode(F.filter(F.array(*(F.when(F.col("term").startswith(w), F.lit(w)) for w in words)), lambda x: x.isNotNull()))
    hits = index.terms.filter(some).withColumn("phrase", phrase).groupBy("id", "length", "phrase").agg(F.sum("tf").alias("tf"))
    found = hits.groupBy("phrase").agg(F.count("*").alias("n_hit"))
    if within is not None:
        hits = hits.join(within.select("id"), "id", "left_semi")
    idf = F.greatest(F.log((F.col("n_docs") - F.col("n_hit") + 0.5) / (F.col("n_hit") + 0.5)), F.lit(LEAST_IDF))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    # one row of sizes and one of each phrase: both bounded by the query
    scored = hits.join(F.broadcast(found), "phrase").crossJoin(F.broadcast(index.size)).groupBy("id").agg(F.round(F.sum(part), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(limit)


def like(nodes: DataFrame, text: str, limit: int = 100) -> DataFrame:
    """(id, name, score): exact 1, prefix .9, inside the name .8, inside the qualified name .7, in the
    signature or docstring .5; shorter names first."""
    t = text.lower()
    has = lambda c: F.coalesce(F.lower(c).contains(t), F.lit(False))
    score = (
        F.when(F.lower("name") == t, 1.0).when(F.lower("name").startswith(t), 0.9).when(has("name"), 0.8).when(has("qualified_name"), 0.7).when(has("signature") | has("docstring"), 0.5)
    )
    return nodes.select("id", "name", score.alias("score")).filter("score IS NOT NULL").orderBy(F.desc("score"), F.length("name"), "id").limit(limit)


def fuzzy(nodes: DataFrame, text: str, per_name: int = 5, limit: int = 100) -> DataFrame:
    """(id, name, score): names within one edit (two for words longer than four letters); distinct names
    are measured, not rows, and of each so many rows are taken."""
    most = 1 if len(text) <= 4 else 2
    names = nodes.select("name").distinct().filter(F.length("name").between(len(text) - most, len(text) + most))
    near = names.withColumn("d", F.levenshtein(F.lower("name"), F.lit(text.lower()), most)).filter("d >= 0")
    rank = F.row_number().over(Window.partitionBy("name").orderBy("id"))
    out = nodes.join(near, "name").withColumn("_k", rank).filter(F.col("_k") <= per_name)
    return out.select("id", "name", F.round(1 / (1 + F.col("d")), 6).alias("score")).orderBy(F.desc("score"), "name", "id").limit(limit)


def exact_names(nodes: DataFrame, names: Sequence[str], limit: int = 40) -> DataFrame:
    """(id, name, score): rows by name whatever the case; 20 more in files where the name is rare
    (fewer than 10 files); each name has a quota."""
    wanted = [n.lower() for n in names]
    met = nodes.withColumn("key", F.lower("name")).filter(F.col("key").isin(*wanted))
    spread = met.groupBy("key").agg(F.count_distinct("file_path").alias("n_files"))
    quota = max(8, -(-limit // max(1, len(wanted))))
    scored = met.join(spread, "key").withColumn("score", F.when(F.col("n_files") < 10, 21.0).otherwise(1.0))
    ranked = scored.withColumn("_k", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "file_path", "start_line", "id")))
    return ranked.filter(F.col("_k") <= quota).select("id", "name", "score")


def substring(nodes: DataFrame, part: str, not_prefix: bool = False, limit: int = 100) -> DataFrame:
    """(id, name): names that hold part, shortest first."""
    met = nodes.filter(F.lower("name").contains(part.lower()))
    if not_prefix:
        met = met.filter(~F.lower("name").startswith(part.lower()))
    return met.select("id", "name").orderBy(F.length("name"), "name", "id").limit(limit)


def kind_bonus(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in KIND_BONUS.items() for x in kv)), kind), F.lit(0))


def name_bonus(name: Column, query: str) -> Column:
    """80 for the name itself, 60 for one of several words, up to 40 for a prefix, 15 for all words inside, 10 for the whole inside."""
    words = [w.lower() for w in query.split() if len(w) >= 2]
    terms = [t.lower() for w in re.split(r"[\s_.\-]+", query) for t in re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", w).split() if len(t) >= 2]
    joined = "".join(query.split()).lower()
    n = F.lower(name)
    out = F.when(n == joined, 80.0)
    if len(words) > 1:
        out = out.when(n.isin(*words), 60.0)
    if joined:
        out = out.when(n.startswith(joined), F.round(10 + 30 * len(joined) / F.length(n)))
    if len(terms) > 1:
        every = F.lit(True)
        for t in terms:
            every = every & n.contains(t)
        out = out.when(every, 15.0)
    return out.when(n.contains(joined), 10.0).otherwise(0.0) if joined else out.otherwise(0.0)


def path_relevance(path: Column, query: str) -> Column:
    """For each word 10 in the file name and 5 in its directory, or else 3 anywhere; 15 less for tests unless asked for."""
    p, score = F.lower(path), F.lit(0)
    name = basename(p)
    folder = F.regexp_replace(p, "[^/]*$", "")
    for word in query.lower().split():
        score = score + F.when(name.contains(word), 10).otherwise(0) + F.when(folder.contains(word), 5).when(p.contains(word), 3).otherwise(0)
    if "test" in query.lower() or "spec" in query.lower():
        return score
    return score - F.when(is_test(path), 15).otherwise(0)


def search(nodes: DataFrame, raw: str, limit: int = 20, index: Index | None = None) -> DataFrame:
    """(id, name, kind, file_path, score): fields filter first; then BM25, substrings and, failing both,
    fuzzy names; exact names come in at the top; bonuses for kind, name and path; best first."""
    q = parse(raw)
    rows = nodes
    if q.kinds:
        rows = rows.filter(F.col("kind").isin(*q.kinds))
    if q.languages:
        rows = rows.filter(F.col("language").isin(*q.languages))
    for p in q.paths:
        rows = rows.filter(F.lower("file_path").contains(p.lower()))
    for n in q.names:
        rows = rows.filter(F.lower("name").contains(n.lower()))
    if not q.text:
        return rows.select("id", "name", "kind", "file_path", F.lit(1.0).alias("score")).orderBy("name", "id").limit(limit)
    found = cut(bm25(nodes, q.text, max(5 * limit, 100), index, None if rows is nodes else rows), "found")
    if found.isEmpty() and len(q.text) >= 2:
        found = like(rows, q.text, max(5 * limit, 100)).select("id", "score")
    if found.isEmpty() and len(q.text) >= 3:
        found = fuzzy(rows, q.text, limit=limit).select("id", "score")
    named = rows.filter(F.lower("name").isin(*[w.lower() for w in q.text.split()])).withColumn("_word", F.lower("name"))
    exact = capped(named, ["_word"], 20, "id").select("id")  # of each word, so that none pushes out another
    top = found.agg(F.coalesce(F.max("score"), F.lit(1.0)).alias("score"))
    every = found.unionByName(exact.crossJoin(top)).groupBy("id").agg(F.max("score").alias("score"))
    bonus = kind_bonus(F.col("kind")) + path_relevance(F.col("file_path"), q.text) + name_bonus(F.col("name"), q.text)
    out = rows.join(every, "id").select("id", "name", "kind", "file_path", F.round(F.col("score") + bonus, 6).alias("score"))
    return out.orderBy(F.desc("score"), "file_path", "name", "id").limit(limit)
